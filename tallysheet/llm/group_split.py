"""Splits that keep related records together.

Job names are linked in bounded steps without pairs: a canonical form (dates, list numbers, remarks,
layout and short forms removed), then words corrected towards the corpus vocabulary (a rare word one
slip away from, or the cut-off start of, a much more frequent one), then star edges between names
that agree in all words but one which differs by a slip. Components over these edges (parallel
hooking and shortcutting) are the jobs. Jobs are assigned to splits by subset-sum bitsets over the
multiplicities of job sizes; of several seeded choices that meet the row shares, the one closest in
class shares is kept.

Defined results: NULL names and names without any word belong to no job and to no pair; repeated rows
count once per box and run; empty tables give empty results; more than one name for a job never falls
into two splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.operators.components import hook_and_shortcut
from tallysheet.llm.target_sample import class_key
from tallysheet.session import cut

# Short forms of words in job names.
SHORT_FORMS = {
    "CTR": "CENTER", "CNTR": "CENTER", "APT": "APARTMENT", "APTS": "APARTMENT", "VET": "VETERINARY", "HOSP": "HOSPITAL", "WHSE": "WAREHOUSE", "COMM": "COMMUNITY", "LAB": "LABORATORY", "ELEM": "ELEMENTARY",
    "MED": "MEDICAL", "OFC": "OFFICE", "RENO": "RENOVATION", "REST": "RESTAURANT", "STR": "STRUCTURE", "STRUCT": "STRUCTURE", "PKG": "PARKING", "SCH": "SCHOOL", "STA": "STATION", "ACAD": "ACADEMY", "LIB": "LIBRARY", "MKT": "MARKET",
    "HS": "HIGH SCHOOL", "ES": "ELEMENTARY SCHOOL", "FS": "FIRE STATION", "MOB": "MEDICAL OFFICE BUILDING", "GARD": "GARDENS", "GDNS": "GARDENS", "XING": "CROSSING", "ST": "SAINT", "HBR": "HARBOUR", "HARBOR": "HARBOUR", "THEATER": "THEATRE",
}
REMARKS = r"\([^)]*\)|\[[^\]]*\]|\b\d+\s*%(?:\s*(?:CD|DD|SD))?(?:\s*SETS?)?|\b(?:BID|PERMIT|CD|DD|SD|IFC|PRICING|CHECK|ISSUED?)\s+SETS?\b|\bREV(?:ISION)?S?[ .\-]*\d+\w?\b|\bADD(?:ENDUM|ENDA)?[ .\-]*\d+\b|\bMECH(?:ANICAL)?\s+ONLY\b|\b(?:FOR|FINAL|DRAFT|COPY|REVISED|UPDATED?)\b|\bBULLETIN\s+\d+\b"
DATES = r"\b\d{1,4}[.\-/]\d{1,2}[.\-/]\d{2,4}\b"
MIN_WORD = 5  # shorter words, digits and part letters link no names
MIN_CORRECTED = 2  # shorter words are never corrected
RATIO = 4  # a word is corrected only towards one at least this many times as frequent
SHORT_RATIO = 20  # the same for words of fewer than four letters


def job_words(name: Column) -> Column:
    """The words of a job name, canonical and sorted.

    Phase and building letter make one word with a digit in it, which keeps it from being corrected.
    """
    n = F.upper(F.translate(name, "\u00a0  –—‐‑’`´\t\n\r", "   ----'''   "))
    n = F.regexp_replace(n, r"(?<![A-Z])(?<!BLDG_)([ODL])[_'](?=[A-Z]{3,})", "$1")
    n = F.regexp_replace(n, r"([A-Z]{3,})[_']S(?![A-Z])", "$1S")
    n = F.regexp_replace(F.translate(n, "_", " "), DATES, " ")
    n = F.regexp_replace(n, REMARKS, " ")
    n = F.regexp_replace(n, r"^[\s\-#]*\d{1,5}[\s.\-]+(?=[A-Z])", "")
    n = F.regexp_replace(n, r"\bPH(?:ASE)?[\s.\-]*(\d+|I{1,3}|IV)\b", "PHASE0$1")
    n = F.regexp_replace(n, r"\b(?:BLDG|BLD)[\s.\-]*([A-Z0-9])\b", "BLDG0$1")
    n = F.regexp_replace(n, r"\bBUILDING[\s.\-]+([A-Z0-9])\b", "BLDG0$1")
    words = F.filter(F.split(F.regexp_replace(n, "'", ""), r"[^A-Z0-9]+"), lambda w: w != "")
    short = F.create_map(*[F.lit(x) for kv in SHORT_FORMS.items() for x in kv])
    return F.array_sort(F.flatten(F.transform(words, lambda w: F.split(F.coalesce(F.try_element_at(short, w), w), " "))))


def _slips(w: Column) -> Column:
    """The word and all its forms with one letter left out: two words one slip apart share a form."""
    n = F.length(w)
    return F.array_union(F.array(w), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, n))))


def correct_words(names: DataFrame) -> DataFrame:
    """names(name, words) with rare words corrected towards the corpus vocabulary."""
    vocabulary = cut(names.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df")))
    rare = vocabulary.where((F.length("w") >= MIN_CORRECTED) & ~F.col("w").rlike(r"\d"))
    common = rare.where(F.length("w") >= MIN_WORD).select(F.col("w").alias("v"), F.col("df").alias("vdf"))
    # one slip: words that share a form; the most frequent of a form stands for it
    form = rare.withColumn("form", F.explode(_slips(F.col("w"))))
    best = form.groupBy("form").agg(F.max_by(F.struct("w", "df"), F.struct("df", "w")).alias("b"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    close = (F.levenshtein("w", F.col("b.w")) <= F.when(F.length("w") > MIN_WORD, 2).otherwise(1)) | (letters(F.col("w")) == letters(F.col("b.w")))
    ratio = F.when(F.length("w") < 4, SHORT_RATIO).otherwise(RATIO)
    slip = form.join(best, "form").where((F.length("b.w") >= 3) & (F.col("b.df") >= ratio * F.col("df")) & close).select("w", F.col("b.w").alias("v"), F.col("b.df").alias("vdf"), F.lit(0).alias("how"))
    # cut off: a word that is the start of exactly one much more frequent word
    starts = common.select("v", "vdf", F.explode(F.transform(F.sequence(F.lit(MIN_WORD - 1), F.length("v") - 1), lambda i: F.substring("v", F.lit(1), i))).alias("w"))
    start = starts.join(vocabulary, "w").where(F.col("vdf") >= RATIO * F.col("df")).groupBy("w").agg(F.count_distinct("v").alias("n"), F.max("v").alias("v"), F.max("vdf").alias("vdf")).where("n = 1").select("w", "v", "vdf", F.lit(1).alias("how"))
    fixes = slip.unionByName(start).groupBy("w").agg(F.max_by("v", F.struct(-F.col("how"), "vdf", "v")).alias("v"))
    words = names.select("name", F.posexplode("words").alias("at", "w")).join(fixes, "w", "left").select("name", F.coalesce("v", "w").alias("w"))
    return words.groupBy("name").agg(F.array_sort(F.collect_list("w")).alias("words"))  # a name's own few words


def _stars(keys: DataFrame) -> DataFrame:
    """Edges to the smallest key of every group of keys that agree but for one slip or cut in one word."""
    each = keys.select("key", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at")).select("key", F.get("words", F.col("at")).alias("w"), F.array_join(F.filter(F.transform("words", lambda x, i: F.when(i != F.col("at"), x)), lambda x: x.isNotNull()), " ").alias("rest"))
    each = each.where((F.length("w") >= MIN_WORD) & ~F.col("w").rlike(r"\d") & (F.col("rest") != ""))
    slip = each.select("key", "rest", F.explode(_slips(F.col("w"))).alias("form"))
    heads = slip.groupBy("rest", "form").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z")
    slips = slip.join(heads, ["rest", "form"]).where("key <> a").select("a", F.col("key").alias("b"))
    # a cut-off word joins its only completion
    longer = each.select("key", "rest", "w", F.explode(F.transform(F.sequence(F.lit(MIN_WORD - 1), F.length("w") - 1), lambda i: F.substring("w", F.lit(1), i))).alias("form"))
    only = longer.groupBy("rest", "form").agg(F.count_distinct("w").alias("n"), F.min("key").alias("a")).where("n = 1")
    cuts = each.select(F.col("key").alias("b"), "rest", F.col("w").alias("form")).join(only, ["rest", "form"]).select("a", "b")
    return slips.unionByName(cuts)


def job_of_names(batch_results: DataFrame, ls_boxes: DataFrame) -> DataFrame:
    """(name, job): every distinct job name of both tables with the component it belongs to."""
    names = cut(batch_results.select("project").unionByName(ls_boxes.select("project")).where("project is not null").groupBy(F.col("project").alias("name")).agg(F.count("*").alias("rows")))
    words = names.select("name", job_words(F.col("name")).alias("words")).where(F.size("words") > 0)
    keyed = cut(correct_words(words).select("name", "words", F.array_join("words", " ").alias("key")))
    keys = keyed.select("key", "words").dropDuplicates(["key"])
    comp = hook_and_shortcut(keys.select(F.col("key").alias("node")), _stars(keys))
    return keyed.join(comp, keyed["key"] == comp["node"]).select("name", F.col("component").alias("job"))


def same_job_pairs(jobs: DataFrame) -> DataFrame:
    """(project_a, project_b), a < b: different strings that name one job (the result asks for pairs)."""
    return jobs.select("job", F.col("name").alias("project_a")).join(jobs.select("job", F.col("name").alias("project_b")), "job").where("project_a < project_b").select("project_a", "project_b")


def closest_counts(sizes: dict[int, int], target: int, order: list[int], bits: int = 1 << 18) -> dict[int, int]:
    """subset_counts for targets of any size: what ``bits`` sums cannot tell apart is settled level by level.

    Beyond ``bits`` the sums are first taken in quanta, with sizes rounded up so that they stay below the
    target; what is left of it is sought again among the items left, in finer quanta, and in the end exactly.
    The miss is the exact sum's; the last level leaves none where small items can fill it.
    """
    taken: dict[int, int] = {}
    left = dict(sizes)
    goal = target
    while goal > bits:
        q = -(-goal // bits)
        large = {s: n for s, n in left.items() if n > 0 and q <= s <= goal}
        took = subset_counts(large, goal, [s for s in order if s in large], q, math.ceil) if large else {}
        got = sum(s * n for s, n in took.items())
        if not got or got > goal:
            break
        for s, n in took.items():
            taken[s] = taken.get(s, 0) + n
            left[s] -= n
        goal -= got
    if goal > bits:  # only small items are left, or none: whole runs of them, then the rest
        for s in sorted((s for s, n in left.items() if n > 0), reverse=True):
            n = min(left[s], max(0, goal - bits // 2) // s)
            if n:
                taken[s] = taken.get(s, 0) + n
                left[s] -= n
                goal -= s * n
    if 0 < goal <= bits:
        rest = {s: n for s, n in left.items() if n > 0 and s <= 2 * goal}
        for s, n in subset_counts(rest, goal, [s for s in order if s in rest]).items():
            taken[s] = taken.get(s, 0) + n
    miss = target - sum(s * n for s, n in taken.items())
    one = min((s for s, n in sizes.items() if n > taken.get(s, 0)), key=lambda s: abs(miss - s), default=0)
    if one and abs(miss - one) < abs(miss):  # one more item that goes beyond the target by less
        taken[one] = taken.get(one, 0) + 1
    return taken


def subset_counts(sizes: dict[int, int], target: int, order: list[int], quantum: int = 1, rounded: Callable[[float], int] = round) -> dict[int, int]:
    """How many items of each size to take so that their sum is closest to ``target``.

    Bitsets hold the reachable sums; multiplicities enter in binary parts, so the number of shifts is
    logarithmic in each multiplicity. ``quantum`` coarsens sums to bound the bitsets.
    """
    goal = max(1, round(target / quantum))
    # the closest sum lies beyond the goal by half a size at most, and never by the goal itself
    largest = max((round(s / quantum) for s in order if sizes[s] > 0 and round(s / quantum) <= goal * 2), default=0)
    mask = (1 << (goal + min(goal, largest // 2) + 2)) - 1
    parts: list[tuple[int, int]] = []
    for s in order:
        k, m = 1, sizes[s]
        while m > 0:
            k = min(k, m)
            parts.append((s, k))
            m -= k
            k *= 2
    reach, trail = 1, []
    for s, k in parts:
        step = rounded(s * k / quantum)
        nxt = reach | (reach << step) & mask if 0 < step <= goal * 2 else reach
        trail.append(reach)
        reach = nxt
        if reach >> goal & 1:
            trail = trail[: len(trail)]
            parts = parts[: len(trail)]
            break
    total = min((b for b in range(reach.bit_length()) if reach >> b & 1), key=lambda b: (abs(b - goal), b))
    taken: dict[int, int] = {}
    for (s, k), before in zip(reversed(parts), reversed(trail), strict=True):
        if before >> total & 1:
            continue
        taken[s] = taken.get(s, 0) + k
        total -= rounded(s * k / quantum)
    return taken


def choose_splits(sizes: dict[int, int], shares: dict[str, float], seed: int, bits: int = 1 << 18) -> dict[str, dict[int, int]]:
    """Split -> size -> number of jobs. The largest split takes what the others leave."""
    import random

    rng = random.Random(seed)
    left = dict(sizes)
    rows = sum(s * n for s, n in sizes.items())
    rest = max(shares, key=lambda k: (shares[k], k))
    out: dict[str, dict[int, int]] = {}
    for name in sorted((n for n in shares if n != rest), key=lambda n: (shares[n], n)):
        goal = shares[name] * rows
        usable = {s: n for s, n in left.items() if n > 0 and s <= 2 * goal}  # a larger job misses by more than none does
        order = sorted(usable, key=lambda _: rng.random())
        small = {s: n for s, n in usable.items() if s <= goal / 3}
        # no size class may be used up by one split: each offers at most its share and a little more
        some = {s: min(n, max(1, round(n * shares[name] * 1.6) + (rng.random() < shares[name]))) for s, n in small.items()}
        out[name] = {}
        missed = goal
        # small jobs mix classes best; where they do not meet the goal, jobs of every size are offered
        for offer in (some, small, usable):
            if goal < 1 or missed < 1:
                break
            took = closest_counts(offer, round(goal), [s for s in order if s in offer], bits)
            miss = abs(sum(s * n for s, n in took.items()) - goal)
            if miss < missed:
                out[name], missed = took, miss
        for s, n in out[name].items():
            left[s] -= n
    out[rest] = {s: n for s, n in left.items() if n > 0}
    return out


def assign_splits(jobs: DataFrame, records: DataFrame, split_targets: DataFrame, seeds: int = 4) -> DataFrame:
    """(job, split_name, rows): jobs whole in one split, shares met over rows and over classes.

    ``records(name, cls)`` are all runs (cls NULL) and boxes. Driver-side are only the histogram of
    job sizes and, per seed, the class totals of the splits.
    """
    spark = jobs.sparkSession
    shares = {r["split_name"]: float(r["share"]) for r in split_targets.dropna().limit(1001).collect()}
    if not shares or len(shares) > 1000:
        raise ValueError("split_targets must hold between 1 and 1,000 splits")
    per = cut(records.groupBy("name", "cls").agg(F.count("*").alias("n")).join(jobs, "name").groupBy("job", "cls").agg(F.sum("n").alias("n")))
    size = cut(per.groupBy("job").agg(F.sum("n").alias("rows")))
    histogram = {r["rows"]: r["jobs"] for r in size.groupBy("rows").agg(F.count("*").alias("jobs")).collect()}  # distinct sizes only
    if not histogram:
        return spark.createDataFrame([], "job string, split_name string, rows bigint")
    # rank of a job among those of its size, by seeded hash: buckets first, so no size is sorted as a whole
    tries = []
    for seed in range(seeds):
        plan = choose_splits(histogram, shares, seed)
        cuts = []
        for s in histogram:
            at = 0
            for name in sorted(plan):
                n = plan[name].get(s, 0)
                if n:
                    cuts.append((seed, s, at, at + n, name))
                at += n
        tries += cuts
    cuts = spark.createDataFrame(tries, "seed int, rows bigint, low bigint, high bigint, split_name string")
    b = size.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("h", F.xxhash64("seed", "job")).withColumn("bucket", F.pmod("h", F.lit(256)))
    offsets = b.groupBy("seed", "rows", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(Window.partitionBy("seed", "rows").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = b.withColumn("r", F.row_number().over(Window.partitionBy("seed", "rows", "bucket").orderBy("h", "job")) - 1).join(offsets, ["seed", "rows", "bucket"]).withColumn("rank", F.col("r") + F.col("offset"))
    placed = cut(ranked.join(cuts, ["seed", "rows"]).where("rank >= low and rank < high").select("seed", "job", "rows", "split_name"))
    shape = placed.join(per, "job").groupBy("seed", "split_name", "cls").agg(F.sum("n").alias("n")).collect()  # seeds x splits x classes
    total: dict = {}
    by: dict = {}
    for r in shape:
        by[r["seed"], r["split_name"], r["cls"]] = r["n"]
        if r["seed"] == 0:
            total[r["cls"]] = total.get(r["cls"], 0) + r["n"]
    everything = sum(total.values())
    miss = lambda k: sum(abs(by.get((k, s, c), 0) - shares[s] * n) for s in shares for c, n in total.items()) + 4 * sum(abs(sum(by.get((k, s, c), 0) for c in total) - shares[s] * everything) for s in shares)
    best = min(range(seeds), key=miss)
    return placed.where(F.col("seed") == best).select("job", "split_name", "rows")


def split_report(assigned: DataFrame, split_targets: DataFrame) -> DataFrame:
    """(split_name, share, jobs, rows, goal, miss): how nearly the row shares are met."""
    got = assigned.groupBy("split_name").agg(F.count("*").alias("jobs"), F.sum("rows").alias("rows"))
    total = assigned.agg(F.sum("rows").alias("all"))  # one row
    t = split_targets.dropna().select("split_name", "share").distinct()
    j = t.join(got, "split_name", "left").join(F.broadcast(total))
    rows = F.coalesce("rows", F.lit(0))
    return j.select("split_name", "share", F.coalesce("jobs", F.lit(0)).alias("jobs"), rows.alias("rows"), (F.col("share") * F.col("all")).alias("goal"), F.abs(rows - F.col("share") * F.col("all")).alias("miss"))


def split_records(batch_results: DataFrame, ls_boxes: DataFrame) -> DataFrame:
    """(name, cls): distinct runs and boxes of named jobs."""
    boxes = ls_boxes.where("project is not null and box_id is not null").select("box_id", F.col("project").alias("name"), class_key(F.col("cls")).alias("cls")).distinct().select("name", "cls")
    runs = batch_results.where("project is not null").select(F.col("project").alias("name"), "plan", "run_at").distinct().select("name", F.lit(None).cast("string").alias("cls"))
    return boxes.unionByName(runs)
