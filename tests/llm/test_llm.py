import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallysheet.llm import group_split, leak, mojibake, pack, target_sample

from ..conftest import rows

# ---- sampling ---------------------------------------------------------------------------------------

TARGETS = "request_id int, source_table string, sample_size int, class_name string, target_share double, min_count int"


def test_swap_repair_meets_targets_and_floors():
    take = target_sample.swap_repair({"a": 1000, "b": 1000, "c": 5}, {"a": 0.7, "b": 0.28, "c": 0.02}, {"a": 3, "b": 3, "c": 5}, 100, 1)
    assert sum(take.values()) == 100 and take["c"] == 5 and abs(take["a"] - 69) <= 2


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 100), st.integers(0, 5)), min_size=1, max_size=6), st.integers(0, 400), st.integers(0, 99))
def test_swap_repair_is_locally_best(given_, size, seed):
    total = sum(w for _, w, _ in given_)
    have = {str(i): a for i, (a, _, _) in enumerate(given_)}
    share = {str(i): w / total for i, (_, w, _) in enumerate(given_)}
    floor = {str(i): f for i, (_, _, f) in enumerate(given_)}
    take = target_sample.swap_repair(have, share, floor, size, seed)
    low = {c: min(floor[c], have[c]) for c in have}
    assert all(low[c] <= take[c] <= have[c] for c in have)
    assert sum(take.values()) == max(sum(low.values()), min(size, sum(have.values())))
    gap = {c: take[c] - share[c] * size for c in have}
    for a in have:
        for b in have:
            if a != b and take[a] > low[a] and take[b] < have[b]:
                assert (gap[a] - 1) ** 2 + (gap[b] + 1) ** 2 >= gap[a] ** 2 + gap[b] ** 2 - 1e-6


def test_sample_is_exact_and_reported(spark):
    boxes = spark.createDataFrame([(i, ["Fan", " FAN ", "fan "][i % 3], "clash", 1) for i in range(300)] + [(1000 + i, "LOUVER", "x", 1) for i in range(4)] + [(5, "FAN", "dup", 2), (9999, None, "n", 1), (None, "FAN", "n", 1)], "box_id bigint, cls string, signature string, bucket int")
    t = spark.createDataFrame([(1, "ls_boxes", 50, "FAN", 0.8, 3), (1, "ls_boxes", 50, "LOUVER", 0.2, 3), (2, "ls_boxes", 5, "FAN", 1.0, 1), (3, "other", 5, "FAN", 1.0, 1), (4, "ls_boxes", None, "FAN", 1.0, 1)], TARGETS)
    sample, report = target_sample.draw_samples({"ls_boxes": target_sample.box_records(boxes)}, t)
    got = {(r["request_id"], r["signature"]): r["n"] for r in sample.groupBy("request_id", "signature").agg(F.count_distinct("id").alias("n")).collect()}
    assert got == {(1, "FAN"): 46, (1, "LOUVER"): 4, (2, "FAN"): 5}
    assert sample.count() == 55
    assert [(r["request_id"], r["class_name"]) for r in report.where("short").collect()] == [(1, "LOUVER")]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_records_of_several_categories(seed):
    rng = random.Random(seed)
    cats = ["a", "b", "c", "d"]
    have = {tuple(sorted(rng.sample(cats, rng.randint(1, 3)))): rng.randint(0, 200) for _ in range(6)}
    share = {c: rng.random() for c in cats}
    floor = {c: rng.randint(0, 5) for c in cats}
    size = rng.randint(5, 150)
    take = target_sample.swap_repair(have, share, floor, size, seed)
    assert all(0 <= take[s] <= have[s] for s in have)
    count = {c: sum(n for s, n in take.items() if c in s) for c in cats}
    low = {c: min(floor[c], sum(n for s, n in have.items() if c in s)) for c in cats}
    assert all(count[c] >= low[c] for c in cats)
    assert sum(take.values()) >= min(size, sum(have.values()))
    off = lambda k: sum((k[c] - share[c] * size) ** 2 for c in cats)
    for s in have:
        for t in have:
            if take[s] and take[t] < have[t] and s != t:
                after = {c: count[c] - (c in s) + (c in t) for c in cats}
                if all(after[c] >= low[c] for c in cats):
                    assert off(after) >= off(count) - 1e-6


def test_the_start_is_random_and_the_end_close():
    have, share = {"a": 500, "b": 500, "c": 500}, {"a": 0.5, "b": 0.3, "c": 0.2}
    draws = {tuple(target_sample._draw(np.random.default_rng(s), np.array([500, 500, 500]), 100)) for s in range(8)}
    assert len(draws) > 4
    for s in range(8):
        assert target_sample.swap_repair(have, share, {}, 100, s) == {"a": 50, "b": 30, "c": 20}


def test_floors_above_the_size_are_reported(spark):
    b = target_sample.box_records(spark.createDataFrame([(i, "AB"[i % 2]) for i in range(100)], "box_id bigint, cls string"))
    t = spark.createDataFrame([(1, "ls_boxes", 10, "A", 0.5, 20), (1, "ls_boxes", 10, "B", 0.5, 20), (2, "ls_boxes", 10, " a\u200b", 0.3, 1), (2, "ls_boxes", 10, "A\ufeff", 0.3, 2), (2, "ls_boxes", 10, "b", 0.4, 1)], TARGETS)
    r = target_sample.plan_samples({"ls_boxes": b}, t)[0].collect()
    assert all(x["floors_exceed"] == (x["request_id"] == 1) for x in r)
    assert {(x["request_id"], target_sample.fold(x["class_name"])): x["taken"] for x in r} == {(1, "A"): 20, (1, "B"): 20, (2, "A"): 6, (2, "B"): 4}


def test_counts_are_never_laid_out(spark):
    s = spark.createDataFrame([("p", "FAN", 2_000_000_000), ("q", "FAN", 5), ("q", "VAV", 3)], "project string, class string, count int")
    t = spark.createDataFrame([(1, "sample_per_project", 1000, "FAN", 0.5, 1), (1, "sample_per_project", 1000, "VAV", 0.5, 1)], TARGETS)
    r = {x["class_name"]: (x["available"], x["taken"], x["short"]) for x in target_sample.plan_samples({"sample_per_project": target_sample.counted_records(s)}, t)[0].collect()}
    assert r == {"FAN": (2_000_000_005, 997, False), "VAV": (3, 3, True)}


def test_counted_symbols_are_drawn_once(spark):
    s = spark.createDataFrame([(f"p{i}", "FAN", 1 + i * 7) for i in range(40)], "project string, class string, count int")
    t = spark.createDataFrame([(1, "sample_per_project", 500, "FAN", 1.0, 1)], TARGETS)
    got = target_sample.draw_samples({"sample_per_project": target_sample.counted_records(s)}, t)[0]
    assert got.count() == 500 == got.select("id", "symbol").distinct().count()
    most = {r["id"]: r["m"] for r in got.groupBy("id").agg(F.max("symbol").alias("m")).collect()}
    assert len(most) > 10 and all(m < int(k.split("\u0001")[-1]) for k, m in most.items())


def test_counted_records_and_empty(spark):
    s = spark.createDataFrame([("p", "Fan", 3), ("p", "Fan", 3), ("q", "FAN", None), ("q", "FAN", 0), (None, "fan", 2)], "project string, class string, count int")
    assert target_sample.counted_records(s).agg(F.sum("weight")).first()[0] == 5
    t = spark.createDataFrame([(1, "sample_per_project", 4, "FAN", 1.0, 9)], TARGETS)
    _, report = target_sample.draw_samples({"sample_per_project": target_sample.counted_records(s.limit(0))}, t)
    assert report.first()["short"] and report.first()["taken"] == 0


# ---- job names and splits ---------------------------------------------------------------------------

SAME = ["Alderwick Gardens Surgery Center - Caldoville Bldg A", "3.16.26 Alderwick Gardens Surgery Center - Caldoville Bldg A", "ALDERWICK GARDENS SURGERY CENTER - CALDOVILLE BLDG A", "12_Alderwick_Gardens_Surgery_Center_Caldoville_Bldg_A", "Alderwick Gardens Surgery Ctr, Caldoville, BLDG-A", "Alderwck Gardens Surgery Center - Caldoville Bldg A", " Alderwick Gardens  Surgery Center – Caldoville Bldg A", "Alderwick Gardens Surgery Center - Caldoville Bldg A (BID SET)", "Alderwick Gardens Surgery Center - Caldoville Bldg A REV 2"]
OTHER = ["Alderwick Gardens Surgery Center - Caldoville Bldg B", "Alderwick Summit Surgery Center - Caldoville Bldg A", "Alderwick Gardens Dental Clinic - Caldoville Bldg A", "O'Dellan Point Brewery - Farlumbria", "O_Dellan_Point_Brewery_Farlumbria", "O'Dellan Point Brewery - Farlumb", "Farlumbria, O'Dellan Point Brewery 2.3.26", "", "---", None]


def jobs(spark, names):
    b = spark.createDataFrame([(n, "x") for n in names], "project string, job string")
    return group_split.job_of_names(b, b.limit(0))


def test_names_of_one_job(spark):
    got = {r["name"]: r["job"] for r in jobs(spark, SAME + OTHER).collect()}
    assert len({got[n] for n in SAME}) == 1
    assert len({got[n] for n in [SAME[0], *OTHER[:3]]}) == 4
    assert len({got[n] for n in OTHER[3:7]}) == 1 and got[OTHER[3]] != got[SAME[0]]
    assert "" not in got and "---" not in got
    pairs = rows(group_split.same_job_pairs(jobs(spark, SAME + OTHER)))
    assert len(pairs) == len(SAME) * (len(SAME) - 1) // 2 + 6 and all(a < b for a, b in pairs)


def test_no_names(spark):
    assert jobs(spark, [None, ""]).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8), st.integers(1, 200))
def test_subset_sum_is_closest(sizes, target):
    got = group_split.subset_counts(sizes, target, sorted(sizes))
    assert all(0 <= n <= sizes[s] for s, n in got.items())
    sums = {0}
    for s, n in sizes.items():
        sums = {x + s * k for x in sums for k in range(n + 1)}
    assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(x - target) for x in sums)


@pytest.mark.parametrize(
    ("sizes", "most"),
    [({5000: 20, 1: 1}, 1), ({5000: 20, 1: 3}, 1), ({3000: 30, 2: 4, 1: 1}, 10), ({900: 1, 2500: 40, 1: 2}, 110), ({10_000: 10}, 0), ({40_000: 1, 6000: 10}, 4000)],
)
def test_few_large_jobs_and_tiny_ones_meet_the_shares(sizes, most):
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = sum(s * n for s, n in sizes.items())
    for seed in range(4):
        plan = group_split.choose_splits(sizes, shares, seed)
        assert {s: sum(p.get(s, 0) for p in plan.values()) for s in sizes} == sizes
        for name in ("validation", "test"):
            assert abs(sum(s * n for s, n in plan[name].items()) - shares[name] * rows) <= most


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 3000), st.integers(1, 60), min_size=1, max_size=12), st.integers(1, 20_000), st.sampled_from([64, 256, 1024]))
def test_sums_beyond_the_bitset(sizes, target, bits):
    sizes = {**sizes, 1: 70}  # small items can fill what is left
    got = group_split.closest_counts(sizes, target, sorted(sizes), bits)
    assert all(0 <= n <= sizes[s] for s, n in got.items())
    exact = group_split.subset_counts(sizes, target, sorted(sizes))
    miss = lambda took: abs(sum(s * n for s, n in took.items()) - target)
    assert miss(got) <= miss(exact) + max(0, max(s for s in sizes if s <= 2 * target or s == 1) // 2)


def test_very_large_splits_are_met_exactly():
    sizes = {1_000_003: 500, 77_777: 900, 1_313: 4000, 13: 400, 1: 40}
    rows = sum(s * n for s, n in sizes.items())
    plan = group_split.choose_splits(sizes, {"train": 0.8, "validation": 0.1, "test": 0.1}, 0)
    for name in ("validation", "test"):
        assert abs(sum(s * n for s, n in plan[name].items()) - 0.1 * rows) <= 1
    huge = {s * 10**5 + 7: n for s, n in sizes.items()} | {3: 1000, 1: 1000, 5000: 300, 10**6: 300}
    rows = sum(s * n for s, n in huge.items())
    got = group_split.closest_counts(huge, rows // 10, sorted(huge))
    assert abs(sum(s * n for s, n in got.items()) - rows // 10) < 2 * 10**5 * 1_000


def test_subset_sum_beyond_the_goal():
    assert group_split.subset_counts({40: 1}, 21, [40]) == {40: 1}


def test_splits_keep_jobs_whole(spark):
    rng = random.Random(3)
    recs = [(f"job {i}", f"c{rng.randint(0, 3)}") for i in range(80) for _ in range(rng.randint(1, 30))] + [("big", "c1")] * 400
    r = spark.createDataFrame(recs, "name string, cls string")
    j = r.select("name").distinct().withColumn("job", F.col("name"))
    s = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    got = group_split.assign_splits(j, r, s)
    assert got.count() == 81 and got.select("job").distinct().count() == 81
    share = {x["split_name"]: x["n"] / len(recs) for x in got.groupBy("split_name").agg(F.sum("rows").alias("n")).collect()}
    assert abs(share["test"] - 0.1) < 0.01 and abs(share["validation"] - 0.1) < 0.01
    assert group_split.assign_splits(j.limit(0), r.limit(0), s).count() == 0
    report = {x["split_name"]: (x["rows"], x["miss"]) for x in group_split.split_report(got, s).collect()}
    assert sum(n for n, _ in report.values()) == len(recs) and all(m <= 0.01 * len(recs) for _, m in report.values())


# ---- packing ----------------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 20), min_size=1, max_size=12))
def test_packing_holds_everything(hist):
    plan = pack.solve(hist, 64)
    held: dict[int, int] = {}
    for config, n in plan:
        assert n > 0 and sum(s * k for s, k in config.items()) <= 64
        for s, k in config.items():
            held[s] = held.get(s, 0) + k * n
    assert held == hist


def test_packing_is_tight():
    rng = random.Random(0)
    hist: dict[int, int] = {}
    for _ in range(5000):
        s = rng.randint(20, 900)
        hist[s] = hist.get(s, 0) + 1
    plan = pack.solve(hist, 2048)
    assert sum(n for _, n in plan) <= 1.01 * sum(s * n for s, n in hist.items()) / 2048 + 1


def test_pack_documents(spark):
    docs = spark.createDataFrame([(i, "duct " * (5 + i % 7), i) for i in range(200)] + [(900, "fan coil " * 400, 0), (901, "", 0), (902, None, 0), (None, "x", 0), (1, "duct " * 6, 0)], "doc_id bigint, text string, size int")
    p = pack.pack_documents(docs, spark.createDataFrame([(1, 64), (2, 1024), (3, None)], "pack_id int, capacity_tokens int"), bucket_rows=7)
    lengths = {r["doc_id"]: r["tokens"] for r in pack.token_lengths(docs).collect()}
    for cap in (64, 1024):
        got = p.where(F.col("capacity_tokens") == cap)
        assert got.groupBy("container").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] <= cap
        assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("size").alias("n")).collect()} == lengths
    assert {(r["capacity_tokens"], r["doc_id"]) for r in pack.cut_documents(p).collect()} == {(64, 900)}
    assert pack.pack_documents(docs.limit(0), spark.createDataFrame([(1, 64)], "pack_id int, capacity_tokens int")).count() == 0


@pytest.mark.parametrize(("kind", "capacity"), [("lognormal", 2048), ("uniform", 2048), ("lognormal", 8192), ("short", 512)])
def test_the_program_makes_most_containers_close_to_its_bound(kind, capacity):
    rng = np.random.default_rng(1)
    x = {"lognormal": rng.lognormal(5.2, 0.9, 8000), "uniform": rng.uniform(20, 900, 5000), "short": rng.integers(1, 12, 20_000)}[kind]
    hist: dict[int, int] = {}
    for v in np.clip(x.astype(int), 1, capacity).tolist():
        hist[v] = hist.get(v, 0) + 1
    q = pack.quality(hist, capacity)
    assert q["gap"] <= 0.004 and q["program_share"] >= 0.6


@pytest.mark.parametrize("unit", ["word ", "a  b\n", "é, x—y ", "longwithoutblank" * 3 + " \n ", "12 34", " \t "])
def test_parts_have_the_tokens_of_the_whole(unit):
    old, pack.PART_CHARS = pack.PART_CHARS, 50
    encode = pack.encoder(pack.TOKENIZER).encode_ordinary
    try:
        for n in (1, 40, 333):
            text = unit * n + "end"
            got = list(pack.parts(text))
            assert "".join(got) == text
            assert sum((encode(p) for p in got), []) == encode(text)
    finally:
        pack.PART_CHARS = old


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1é .,\n\t-'’\u00a0日", max_size=300))
def test_parts_of_any_text(text):
    old, pack.PART_CHARS = pack.PART_CHARS, 7
    encode = pack.encoder(pack.TOKENIZER).encode_ordinary
    try:
        assert sum((encode(p) for p in pack.parts(text)), []) == encode(text)
    finally:
        pack.PART_CHARS = old


# ---- leaks ------------------------------------------------------------------------------------------

WORDS = [f"w{i}" for i in range(60)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200), st.lists(st.lists(st.integers(1, 6), min_size=3, max_size=3), min_size=1, max_size=10))
def test_index_against_brute_force(text, phrases):
    sym = np.array([0, *text, 0], np.int64)
    ph = np.array(phrases)
    ix = leak.FMIndex(sym, 6)
    who, lo, hi = ix.search(ph)
    got = sorted((int(w), int(p)) for w, a, b in zip(who, lo, hi, strict=True) for p in ix.locate(np.arange(a, b)))
    want = sorted((i, j) for i, p in enumerate(phrases) for j in range(len(sym) - 2) if list(sym[j : j + 3]) == p)
    assert got == want


def item(seed):
    return random.Random(seed).choices(WORDS, k=80)


def leaks(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    i = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return leak.leaked_spans(d, i)


def test_passages_and_decoys(spark):
    it = item(1)
    shuffled = it[:40]
    random.Random(2).shuffle(shuffled)
    changed = it[10:60]
    changed[5], changed[20], changed[37] = "zz", "yy", "xx"
    left_out = it[:30][:15] + it[:30][16:] + it[30:45]
    docs = ["Intro. " + " ".join(it[5:32]) + " end", " ".join(w.upper() + "," for w in it[20:50]), "a " + "\n".join(changed), "q " + " ".join(it[:10]) + " q", " ".join(shuffled), " ".join(it[:12]) + " x y z " + " ".join(it[40:52]), "", None, " ".join(left_out), "tail &amp; " + " &amp; ".join(it[30:60])]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark, docs, [" ".join(it), "short item", None]).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (8, 0), (9, 0)}


def test_spans_cover_the_passage(spark):
    it = item(4)
    text = "é ü — before " + " ".join(it[10:45]) + " after"
    r = leaks(spark, [text], [" ".join(it)]).first()
    assert text[r["span_start"] : r["span_end"]] == " ".join(it[10:45])


def words(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    s, e, h = leak.words_of(buf)
    return [buf[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)], h.tolist()


def test_words_are_hashed_whole_and_of_any_script():
    _, h = words("electrostaticallyA electrostaticallyB electrostaticallya " + "x" * 3000 + "1 " + "x" * 3000 + "2")
    assert h[0] == h[2] and len(set(h)) == 4
    assert words("éclairage général; l’œuvre (Größe) 5°C")[0] == ["éclairage", "général", "l", "œuvre", "Größe", "5", "C"]
    assert words("Привет, мир! ёлка")[0] == ["Привет", "мир", "ёлка"]
    assert len(words("日本語")[0]) == 3
    assert words("")[0] == [] and words("—…!")[0] == []
    one = [words(t)[1] for t in ("relevé Général", "releve\u0301 general", "RELEVE GENERAL", "relev&eacute; g&#233;n&#xE9;ral")]
    assert all(h == one[0] for h in one)
    assert words("a &amp; b &nbsp; &zz; c")[0] == ["a", "b", "zz", "c"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abC9 é\u0301ñ—.,\nП日", max_size=60))
def test_words_against_plain_reading(text):
    plain, cur = [], ""
    import unicodedata

    for c in text:
        kind = leak.character(ord(c))[0] if ord(c) > 127 else leak._LETTER if c.isalnum() else leak._APART
        if kind == leak._MARK:
            continue
        if kind == leak._SIGN:
            plain += [cur, c]
            cur = ""
        elif kind == leak._LETTER:
            cur += unicodedata.normalize("NFKD", c.lower())[0]
        else:
            plain.append(cur)
            cur = ""
    plain = [w for w in [*plain, cur] if w]
    got, h = words(text)
    fold = lambda w: "".join(unicodedata.normalize("NFKD", x.lower())[0] for x in w if not unicodedata.combining(x))
    assert [fold(w) for w in got] == plain
    assert [h[i] == h[j] for i in range(len(h)) for j in range(len(h))] == [a == b for a in plain for b in plain]


FRENCH = "Le relevé général de l’éclairage prévoit que chaque bouche à débit réglé sera équilibrée après la réception des réseaux et que l’écart mesuré ne dépasse jamais la tolérance fixée à l’étage".split()


def test_accents_do_not_matter(spark):
    text = " ".join(FRENCH)
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    docs = ["Avant : " + text.upper(), "x " + unicodedata.normalize("NFD", text), plain, text.replace("é", "&eacute;"), " ".join(FRENCH[:12])]
    assert {r["doc_id"] for r in leaks(spark, docs, [text]).collect()} == {0, 1, 2, 3}


def test_items_in_several_passes_and_one_very_long(spark):
    rng = random.Random(9)
    long = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(100_000)]
    items = [" ".join(long), " ".join(item(1)), " ".join(item(2))]
    docs = [" ".join(long[70_000:70_040]), " ".join(item(1)[:30]), " ".join(item(2)[30:70])]
    want = {(0, 0), (1, 1), (2, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in leaks(spark, docs, items).collect()} == want
    old, leak.PASS_BYTES = leak.PASS_BYTES, 1000
    try:
        assert {(r["doc_id"], r["item_id"]) for r in leaks(spark, docs[1:], items[1:]).collect()} == {(0, 0), (1, 1)}
    finally:
        leak.PASS_BYTES = old


def test_no_items_or_documents(spark):
    assert leaks(spark, ["x"], ["y"]).limit(0).count() == 0
    d = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert leak.leaked_spans(d, i).count() == 0 and leak.leaked_spans(d.limit(0), i).count() == 0


def test_very_long_text_and_repeats(spark):
    it = item(5)
    long = "filler text " * 50_000 + " ".join(it[:30]) + " filler" * 1000
    got = rows(leaks(spark, [long, long, " ".join(it[:30])], [" ".join(it)]).select("doc_id", "item_id").distinct())
    assert got == [(0, 0), (1, 0), (2, 0)]


# ---- encodings --------------------------------------------------------------------------------------

CLEAN = ["Le relevé n° 71 décale le débit 3152 m³/h, d’où un écart.", "A instalação não está na folha; É PRÓXIMA REVISÃO.", "Größer als 5 °C – „Maß“ prüfen", "El año “según” ¿Quién instala? ½ × 3", "L&rsquo;e&eacute; plain ascii", "ATENÇÃO: CÂMARA FRIA", "naïve façade — NÃO”", "decomposed é à"]


@pytest.mark.parametrize("text", CLEAN)
def test_correct_text_is_left_alone(text):
    assert mojibake.repair(text) == (text, 0, 0)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250"])
@pytest.mark.parametrize("text", CLEAN[:4])
def test_round_trip_of_utf8_damage(text, wrong):
    try:
        bad = text.encode().decode(wrong)
    except UnicodeDecodeError:
        pytest.skip("bytes that this encoding does not define")
    good, n, lost = mojibake.repair(bad)
    assert n > 0 and lost == 0 and good == text


def test_damage_in_part_and_twice():
    clean = "Le débit à 5 °C; "
    bad = "relevé n° 7 d’où".encode().decode("cp1252")
    assert mojibake.repair(clean + bad)[0] == clean + "relevé n° 7 d’où"
    twice = "relevé".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.repair(twice)[0] == "relevé"


@pytest.mark.parametrize("wrong", ["cp437", "cp850", "mac_roman"])
def test_single_byte_damage_is_found(wrong):
    text = "Supply is 72 °F ± 2°; the façade side, després del año, tamaño, débit à relever."
    assert mojibake.damage(text.encode("cp1252").decode(wrong))


@pytest.mark.parametrize(
    ("true", "wrong"),
    [("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "latin-1"), ("cp850", "mac_roman"), ("mac_roman", "cp850"), *[("cp1252", w) for w in ("cp1250", "cp1251", "cp1253", "koi8-r", "iso8859-2", "cp866", "cp1257")]],
)
def test_single_byte_damage_of_all_pairs(true, wrong):
    text = "Relevé du débit près de la fenêtre."
    bad = text.encode(true).decode(wrong, errors="ignore")
    assert bad != text and mojibake.damage(bad)
    for word in ("relevé", "débit"):
        assert mojibake.damage(word.encode(true).decode(wrong)) or word.encode(true).decode(wrong) == word


@pytest.mark.parametrize(("true", "wrong"), [("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "koi8-r")])
def test_single_byte_damage_of_all_pairs_is_restored(true, wrong):
    text = "Relevé du débit, relever près de la fenêtre, côté."
    assert mojibake.repair(mojibake._decode(text.encode(true), wrong)) == (text, 6, 0)


@pytest.mark.parametrize("first", ["cp437", "mac_roman", "cp1251", "koi8-r"])
@pytest.mark.parametrize("second", ["cp1252", "cp850", "cp1250", "cp1251"])
def test_double_damage_of_all_pairs(first, second):
    bad = mojibake._decode("relevé".encode().decode(first).encode(), second)
    assert mojibake.repair(bad)[0] == "relevé"


def test_impossible_characters_without_an_original_are_lost():
    assert mojibake.repair("pla\u0491ta") == ("pla\u0491ta", 0, 1)
    assert mojibake.repair("t ≤ 5 K, 10 kΩ, Привет, Tomás") == ("t ≤ 5 K, 10 kΩ, Привет, Tomás", 0, 0)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250"])
@pytest.mark.parametrize("text", ["Привет, мир: воздуховод", "Łódź, Kraków, żółć", "Αθήνα και Πάτρα", "日本語の図面", "空調"])
def test_other_scripts_are_told_back_or_left_alone(text, wrong):
    bad = mojibake._decode(text.encode(), wrong)
    if bad is None:
        pytest.skip("bytes that this encoding does not define")
    assert mojibake.damage(bad)
    got, _, lost = mojibake.repair(bad)
    assert got == text or lost
    for a, b in zip(got.split(), text.split(), strict=False):
        assert a == b or lost  # nothing else is made up
    if "Ł" not in text:  # Polish letters are also what other damage makes of French ones
        assert mojibake.repair(text)[0] == text


def test_long_runs_that_are_no_text_are_left_alone():
    bad = "plan \u00cf\u00f0\u00e8\u00e2\u00e5\u00f2\u0081\u008d ok"
    got, n, lost = mojibake.repair(bad)
    assert got == bad and n == 0


def test_lost_characters_count():
    assert mojibake.repair("dise�o de M598") == ("dise�o de M598", 0, 1)


def test_garbled_documents(spark):
    d = spark.createDataFrame([(1, "dÃ©bit", 0), (2, "débit", 0), (3, None, 0), (4, "", 0), (5, "plain", 0), (6, "x" * 300_000 + " dÃ©bit", 0), (None, "dÃ©bit", 0)], "doc_id bigint, text string, spans int")
    assert [r[0] for r in rows(mojibake.garbled_documents(d))] == [1, 6]
    assert {r["doc_id"]: r["text"][-6:].strip() for r in mojibake.restored_documents(d).collect()} == {1: "débit", 6: "débit"}
    assert mojibake.garbled_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("how", ["empty", "dirty"])
def test_queries_bear_empty_null_and_clashing_tables(spark, tmp_path_factory, how):
    import os

    from tallysheet.llm import queries

    from .. import tables

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    d = tables.write(spark, "/root/testdata/sf0.001", str(tmp_path_factory.mktemp(how)), how)
    for name, q in queries.QUERIES.items():
        n = q(spark, d).count()
        assert n >= 0 and (how == "dirty" or n == 0 or name == "p6_shares"), name  # shares: one row per split in any case
