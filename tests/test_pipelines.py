from pyspark.sql import functions as F

from tallysheet.operators import cascade, schedules, takeoff
from tallysheet.operators import windows as W

from .conftest import rows

RAW = "project string, page int, table_ix int, cells array<array<string>>, page_text string"


def tables(spark, *cells, text="SCHEDULE"):
    return spark.createDataFrame([("p", 0, i, c, text) for i, c in enumerate(cells)], RAW)


def test_vertical_schedule(spark):
    t = tables(spark, [["FAN SCHEDULE", None, None], ["MARK", "TYPE", "DESCRIPTION"], ["EF-1, EF-2", "CEILING EXHAUST", None], ["", "", ""], ["EF-3 thru EF-5", None, "SEE EF-9"]])
    s = schedules.extract_schedules(t)
    r = s.first()
    assert (r["schedule_name"], r["header"], r["mark_columns"], len(r["rows"])) == ("FAN SCHEDULE", ["MARK", "TYPE", "DESCRIPTION"], [0], 2)
    v = schedules.extract_variables(s).orderBy("ord").collect()
    assert [x["tag"] for x in v] == ["EF-1", "EF-2", "EF-3", "EF-4", "EF-5", "EF-9"]
    assert v[0]["cls"] == "AD-GRD" and v[2]["cls"] == "EXHAUST FAN"


def test_horizontal_schedule_is_turned(spark):
    t = tables(spark, [["MARK", "CU-1", "CU-2"], ["MANUFACTURER", "ACME", "BOLT"], ["MODEL", "X1", "X2"]])
    v = schedules.extract_variables(schedules.extract_schedules(t)).orderBy("ord").collect()
    assert [(x["tag"], [(p["key"], p["value"]) for p in x["props"]]) for x in v] == [("CU-1", [("MANUFACTURER", "ACME"), ("MODEL", "X1")]), ("CU-2", [("MANUFACTURER", "BOLT"), ("MODEL", "X2")])]


def test_rejects(spark):
    blank = [[None, ""], [" ", None]]
    plumbing = [["PLUMBING FIXTURE SCHEDULE", ""], ["MARK", "TYPE"], ["WC-1", "X"]]
    assert schedules.extract_schedules(tables(spark, blank, plumbing)).count() == 0
    assert schedules.extract_schedules(spark.createDataFrame([], RAW)).count() == 0
    assert schedules.extract_schedules(tables(spark, [["a", "b"], ["c", "d"]], text=None)).count() == 0


def test_fallback_only_where_tags_are_few(spark):
    t = lambda *r: spark.createDataFrame(list(r), "project string, tag string")
    p = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", None]], "project string")
    text = t(("a", "1"), ("a", "2"), ("a", "3"), ("b", "1"), ("b", "1"), ("b", None), ("c", "1"))
    tables_ = t(("a", "9"), ("b", "1"), ("b", "2"), ("b", "3"), ("c", "2"))
    anywhere = t(("a", "8"), ("b", "8"), ("c", "8"), ("d", "8"))
    got = rows(schedules.with_fallback(p, text, tables_, anywhere))
    assert got == sorted([("a", "1", "text"), ("a", "2", "text"), ("a", "3", "text"), ("b", "1", "text"), ("b", "2", "ocr_table"), ("b", "3", "ocr_table"), ("c", "1", "text"), ("c", "2", "ocr_table"), ("c", "8", "ocr_tag"), ("d", "8", "ocr_tag")], key=repr)
    assert schedules.with_fallback(p.limit(0), text, tables_, anywhere).count() == 0


def test_stacked_and_spatial_title_fields(spark):
    text = "Project Name\n\nDESCRIPTION\nNorth Wing Clinic\nSCALE\nISSUED FOR BID\n1/8\" = 1'-0\"\nSHEET NO.\nx\ny\nz\nM-101"
    r = schedules.title_block(spark.createDataFrame([("p", text)], "project string, text string")).first()
    assert (r["info_project"], r["info_scale"], r["info_sheet"]) == ("North Wing Clinic", "1/8\" = 1'-0\"", None)
    s = spark.createDataFrame([("p", 0, 1, 100.0, 100.0, 160.0, 108.0, "Project Name:"), ("p", 0, 2, 90.0, 75.0, 300.0, 95.0, "North Wing Clinic"), ("p", 0, 3, 170.0, 100.0, 260.0, 108.0, "to the right"), ("p", 0, 4, 500.0, 100.0, 530.0, 108.0, "Scale"), ("p", 0, 5, 540.0, 100.0, 560.0, 108.0, "NTS"), ("p", 1, 6, 0.0, 0.0, 30.0, 8.0, "Date"), ("p", 1, 7, 40.0, 0.0, 80.0, 8.0, "1/2/2026"), ("p", 0, 8, 0.0, 0.0, 1.0, 1.0, "--")], "project string, page int, span_id int, x0 double, y0 double, x1 double, y1 double, text string")
    assert rows(schedules.spatial_fields(s, ["project"])) == [("p", "project", "North Wing Clinic"), ("p", "scale", "NTS")]


def test_legend(spark):
    t = spark.createDataFrame([("p", 0, [["CU", "CONDENSING UNIT"], ["A", "B", "C"]])], "project string, page int, cells array<array<string>>")
    lines = spark.createDataFrame([("p", 0, 1, "CU - COPPER UNIT"), ("p", 1, 0, "EF: EXHAUST FAN"), ("p", 0, 2, "no legend")], "project string, page int, line_no int, line string")
    assert rows(schedules.legend(t, lines)) == [("p", "CU", "COPPER UNIT"), ("p", "EF", "EXHAUST FAN")]


def test_title_block(spark):
    text = "PROJECT NAME: Tower One\nDATE\n01/02/2026\nSHEET NO: M-101\nSMITH ENGINEERING INC\nDRAWN BY: AB"
    r = schedules.title_block(spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "project string, text string")).orderBy("project").collect()
    assert (r[0]["info_project"], r[0]["info_date"], r[0]["info_sheet"], r[0]["info_firm"]) == ("Tower One", "01/02/2026", "M-101", "SMITH ENGINEERING INC")
    assert r[1]["info_project"] is None and r[2]["info_project"] is None


def test_cascade_levels(spark):
    dets = spark.createDataFrame([("p", 0, 1, "LOUVER", 0.0, 0.0), ("p", 0, 2, "FAN", 100.0, 100.0), ("p", 0, 3, "VAV", 500.0, 500.0), ("p", 0, 4, "VAV", 900.0, 900.0), ("p", 0, 5, "ZZZ", 0.0, 0.0), ("p", 0, 6, "VAV", 1500.0, 1500.0)], "project string, page int, det_id bigint, cls string, cx double, cy double")
    tags = spark.createDataFrame([("p", "LOUVER", "L-1", 1), ("p", "EXHAUST FAN", "EF-1", 2), ("p", "EXHAUST FAN", "EF-2", 3), ("p", "VAV", "VAV-1", 4), ("p", "VAV", "VAV-2", 5)], "project string, cls string, tag string, ord bigint")
    words = spark.createDataFrame([("p", 0, 510.0, 500.0, "24X24"), ("p", 0, 1510.0, 1500.0, "VAV-1")], "project string, page int, x double, y double, text string")
    bubbles = spark.createDataFrame([("p", 0, 1, 120.0, 100.0, "EF-2"), ("p", 0, 2, 905.0, 900.0, "vav 2")], "project string, page int, bubble_id bigint, x double, y double, text string")
    index = spark.createDataFrame([("p", "VAV-1", "24X24")], "project string, tag string, tok string")
    got = {r["det_id"]: (r["tag"], r["tag_method"], r["cls"], r["untagged_reason"]) for r in cascade.tag_cascade(dets, tags, words, bubbles, index).collect()}
    assert got[1] == ("L-1", "direct", "LOUVER", None)
    assert got[2] == ("EF-2", "bubble_detect", "EXHAUST FAN", None)  # reclassified
    assert got[3] == ("VAV-1", "fingerprint", "VAV", None)
    assert got[4] == ("VAV-2", "bubble_detect", "VAV", None)
    assert got[5] == (None, "none", "ZZZ", "no_candidate_tags")
    assert got[6] == ("VAV-1", "bubble_ocr", "VAV", None)


def test_bubble_pairs_in_both_orders(spark):
    b = spark.createDataFrame([("p", 0, 1, 0.0, 0.0, "EF"), ("p", 0, 2, 0.0, 30.0, "1"), ("p", 0, 3, 500.0, 0.0, "9")], "project string, page int, bubble_id bigint, x double, y double, text string")
    assert sorted(r["text"] for r in cascade.split_bubble_pairs(b).collect()) == ["1EF", "1EF", "EF1", "EF1"]


def test_takeoff_details(spark):
    tagged = spark.createDataFrame([("p", 0, "AD-GRD", "CD-1"), ("p", 2, "AD-T-BAR SUPPLY", "CD-1"), ("p", 0, "FAN", None)], "project string, page int, cls string, tag string")
    d = spark.createDataFrame([("p", "CD-1", [("MANUFACTURER & MODEL", "ACME X1"), ("NECK SIZE", "10"), ("SERVICE", "SUPPLY"), ("TYPE", "DIFFUSER")], "AD-T-BAR SUPPLY")], "project string, tag string, props array<struct<key:string,value:string>>, cls string")
    r = {x["product"]: x for x in takeoff.assemble(tagged, d).collect()}
    x = r["AD-T-BAR SUPPLY"]
    assert (x["qty"], x["brand"], x["model"], x["neck_size"], x["type"], x["remark"]) == (2, "ACME", "X1", "10", "SUPPLY DIFFUSER", "Pages: 1, 3")
    assert r["FAN"]["remark"] == "Pages: 1"


def test_fill_down_and_runs(spark):
    df = spark.createDataFrame([("f", 1, "FAN"), ("f", 2, ""), ("f", 3, "FAN Total"), ("f", 4, None), ("f", 5, "VAV")], "file string, r int, p string")
    got = [r["filled"] for r in W.fill_down(df, ["file"], "r", F.col("p"), F.coalesce(F.contains("p", F.lit("Total")), F.lit(False))).orderBy("r").collect()]
    assert got == ["FAN", "FAN", "FAN", "FAN", "VAV"]
    flags = spark.createDataFrame([("a", i, i in (1, 2, 3, 6)) for i in range(8)], "k string, i int, on boolean")
    assert rows(W.runs(flags, ["k"], "i", F.col("on"))) == [("a", 1, 3, 2), ("a", 6, 6, 6)]


def test_latest_ngrams_budget(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 3, 1, "bad"), ("a", 2, 1, "y"), ("a", 2, 2, "z")], "k string, t int, o int, v string")
    assert rows(W.latest(df, ["k"], "t", "o", F.col("v") != "bad").select("k", "v")) == [("a", "z")]
    tok = spark.createDataFrame([("a", i, w) for i, w in enumerate("ABC")], "k string, i int, w string")
    assert sorted(r["gram"] for r in W.ngrams(tok, ["k"], "i", "w").collect()) == ["A", "AB", "ABC", "B", "BC", "C"]
    cost = spark.createDataFrame([("a", i, 10.0) for i in range(5)], "k string, i int, c double")
    assert W.budget_cut(cost, ["k"], ["i"], "c", 25.0).count() == 2


def test_blocked_procedures_equal_plain_windows(spark):
    import random

    from pyspark.sql import Window

    rng = random.Random(7)
    # one key holds most rows, one is NULL
    data = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, "x", "y", ""]), float(rng.randint(0, 9))) for i in range(400)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, i int, v string, c double")
    w = Window.partitionBy("k").orderBy("i")
    full = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r["i"]: r for r in df.select("i", F.last(F.when(F.col("v") != "", F.col("v")), True).over(full).alias("f"), F.sum("c").over(full).alias("s"), F.lag("c").over(w).alias("p")).collect()}
    filled = W.fill_down(df, ["k"], "i", F.col("v"), F.lit(False))
    assert {r["i"]: r["filled"] for r in filled.collect()} == {i: r["f"] for i, r in want.items()}
    b = W.blocked(df, ["k"], [F.col("i")])
    assert b.select("_blk").distinct().count() > 1
    s = W.running_sum(b, ["k"], [F.col("i")], F.col("c"), "s")
    assert {r["i"]: r["s"] for r in s.collect()} == {i: r["s"] for i, r in want.items()}
    p = W.previous(b, ["k"], [F.col("i")], {"p": F.col("c")})
    assert {r["i"]: r["p"] for r in p.collect()} == {i: r["p"] for i, r in want.items()}
    assert W.fill_down(df.limit(0), ["k"], "i", F.col("v"), F.lit(False)).count() == 0


def test_bubble_pairs_equal_all_pairs_and_leave_no_copy(spark, monkeypatch):
    import random
    import re

    rng = random.Random(3)
    coordinate = lambda: rng.choice([float(rng.randint(-3, 9) * 80), rng.uniform(-300, 900), float("nan"), None])
    data = [(rng.choice(["p", "p", "q", None]), 0, i, coordinate(), coordinate(), rng.choice(["EF", "1", "VAV", "A1", "22", "LONGER", None])) for i in range(400)]
    data += [("p", 0, 1000 + i, float(i % 5), 0.0, "EF" if i % 2 else "7") for i in range(60)]
    isnan = lambda v: v is None or v != v
    ok = [d for d in data if d[0] and not isnan(d[3]) and not isnan(d[4]) and d[5] and len(d[5]) <= 4]
    want = [(*a[:2], a[2], b[2], (a[3] + b[3]) / 2, (a[4] + b[4]) / 2, t) for a in ok for b in ok if a[:2] == b[:2] and a[2] != b[2] and abs(a[3] - b[3]) <= 60 and abs(a[4] - b[4]) <= 80 and a[3:5] != b[3:5] and (a[5].isalpha() or b[5].isalpha()) for t in (a[5] + b[5], b[5] + a[5])]
    b = spark.createDataFrame(data, "project string, page int, bubble_id bigint, x double, y double, text string")
    got = cascade.split_bubble_pairs(b)
    assert rows(got.select("project", "page", "a", "b", "x", "y", "text")) == sorted(want, key=repr)
    assert not re.search(r"LogicalRDD \[_|explode\(\[", got._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(cascade, "DENSE", 10)
    monkeypatch.setattr("tallysheet.operators.spatial.DENSE", 10)
    assert rows(cascade.split_bubble_pairs(b).select("project", "page", "a", "b", "x", "y", "text")) == sorted(want, key=repr)
