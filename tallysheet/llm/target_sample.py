"""Sample matching target category proportions, by swap repair over category signatures.

Records are grouped by signature, the set of categories they carry (one class here, any number in
``swap_repair``), and only signature counts, a small table of requests x signatures, are handled on the
driver: a random sample (hypergeometric draws) that is made to satisfy the floors is the start; then records
of one signature are exchanged for records of another while an exchange lowers the deviation of the categories
from their targets, until none does. A class is short when the repaired sample holds all its records and still
fewer than it needs, or when further exchanges into it alone would end so.

The sample is materialised by a seeded hash order: per signature whole hash buckets are taken, and only the
one bucket in which the cut falls is ranked, so no group is sorted as a whole however hot it is. Counted
symbols stay counts: a row is dealt out in pieces of ``PIECE`` symbols, and only taken ones become rows.

Defined results: records of a NULL class belong to none; repeated records count once; a class
without records is reported short; an empty source gives an empty sample and every class with a
need above zero short; targets with NULL in any member are ignored; two spellings of one class in a request
are one class with the sum of their shares and the larger of their floors, reported for each spelling; floors
that exceed the sample size make the sample larger, which the report says (``floors_exceed``); ties of the
hash are cut by id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Hashable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TARGETS = 100_000  # rows of the request table that the driver will handle
BUCKETS = 4096
PIECE = 8  # counted symbols that are dealt out together
BLANKS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_BLANKS = re.compile("[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]+")  # the same for plain texts


def class_key(c: Column) -> Column:
    """Classes are the same but for letter case and blanks (kind, outer, repeated)."""
    return F.upper(F.trim(F.regexp_replace(c, BLANKS, " ")))


def fold(name: str) -> str:
    """class_key of a plain text."""
    return _BLANKS.sub(" ", name).strip(" ").upper()


def box_records(ls_boxes: DataFrame) -> DataFrame:
    """(signature, id, weight): one record per distinct box of a class."""
    return ls_boxes.where("cls is not null and box_id is not null").select(class_key(F.col("cls")).alias("signature"), F.col("box_id").cast("string").alias("id")).where("signature <> ''").distinct().withColumn("weight", F.lit(1).cast("bigint"))


def counted_records(sample_per_project: DataFrame) -> DataFrame:
    """(signature, id, weight): the distinct rows with the symbols they count."""
    rows = sample_per_project.where("class is not null and count > 0").select("project", "class", "count").distinct()
    key = F.concat_ws("\u0001", F.coalesce("project", F.lit("")), F.col("project").isNull().cast("string"), "class", F.col("count").cast("string"))
    return rows.select(class_key(F.col("class")).alias("signature"), key.alias("id"), F.col("count").cast("bigint").alias("weight")).where("signature <> ''")


def pieces(records: DataFrame) -> DataFrame:
    """(signature, id, first, weight): records in pieces of at most PIECE symbols, numbered from ``first``."""
    k = F.explode(F.expr(f"sequence(0L, (weight - 1) div {PIECE})"))
    return records.where("weight > 0").withColumn("k", k).select("signature", "id", (F.col("k") * PIECE).alias("first"), F.least(F.lit(PIECE).cast("bigint"), F.col("weight") - F.col("k") * PIECE).alias("weight"))


def _hash(seed: int, *more: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col("id"), F.col("first"), *more)


def _draw(rng: np.random.Generator, available: np.ndarray, size: int) -> np.ndarray:
    """Counts per signature of a random sample without replacement."""
    out = np.zeros(len(available), np.int64)
    left, total = size, int(available.sum())
    for i, n in enumerate(available.tolist()):
        if not left or not total:
            break
        # the generator takes up to a billion records; beyond that replacement makes no difference
        k = int(rng.hypergeometric(n, total - n, left)) if total < 10**9 else int(rng.binomial(left, n / total))
        k = max(min(k, n, left), left - (total - n))
        out[i] = k
        left -= k
        total -= n
    return out


def swap_repair(available: dict[Hashable, int], targets: dict[str, float], floors: dict[str, int], size: int, seed: int) -> dict[Hashable, int]:
    """Records per signature: a random floor-satisfying start, then exchanges until none improves.

    A signature is a category or a tuple of categories; categories without target count for nothing. Floors
    are met as far as there are records, beyond ``size`` if need be.
    """
    sigs = sorted(available, key=repr)
    cats = sorted(targets)
    held = np.zeros((len(sigs), len(cats)), np.int64)
    for i, s in enumerate(sigs):
        for c in s if isinstance(s, tuple) else (s,):
            if c in targets:
                held[i, cats.index(c)] = 1
    have = np.array([available[s] for s in sigs], np.int64)
    low = np.array([min(floors.get(c, 0), int((held[:, j] * have).sum())) for j, c in enumerate(cats)], np.int64)
    want = np.array([targets[c] * size for c in cats])
    rng = np.random.default_rng(seed)
    take = _draw(rng, have, min(size, int(have.sum()))) if len(sigs) else np.zeros(0, np.int64)
    count = held.T @ take if len(sigs) else np.zeros(len(cats), np.int64)
    # floors: records of a category come in, for records that no floor needs where there are such
    for j in rng.permutation(len(cats)).tolist():
        while count[j] < low[j]:
            into = max((i for i in range(len(sigs)) if held[i, j] and take[i] < have[i]), key=lambda i: (-held[i].sum(), have[i] - take[i]))
            need = int(min(low[j] - count[j], have[into] - take[into]))
            spare = [(int(min([take[i], *(count[q] - low[q] for q in np.flatnonzero(held[i]))])), i) for i in range(len(sigs)) if take[i] and not held[i, j]]
            most, out = max(spare, default=(0, -1))
            if most > 0 and take.sum() >= size:
                need = min(need, most)
                take[out] -= need
                count -= need * held[out]
            take[into] += need
            count += need * held[into]
    # exchanges: n records of signature a for n of signature b change the counts by n * (held[b] - held[a])
    step = held[None, :, :] - held[:, None, :] if len(sigs) else np.zeros((0, 0, len(cats)), np.int64)
    norm = (step**2).sum(axis=2)
    while len(sigs) > 1:
        gap = count - want
        gain = -(step * gap).sum(axis=2)  # per record exchanged, before the squares of the step
        # how many records may leave a: those taken, and no floor may break
        leave = np.array([min([int(take[i]), *(int(count[q] - low[q]) for q in np.flatnonzero(held[i]))]) for i in range(len(sigs))])
        both = (held[:, None, :] * held[None, :, :]).sum(axis=2) > 0
        leave = np.where(both, take[:, None], leave[:, None])  # what b brings back breaks no floor of shared categories
        with np.errstate(divide="ignore", invalid="ignore"):
            n = np.floor(np.minimum(np.minimum(leave, (have - take)[None, :]), np.where(norm > 0, gain / norm + 0.5, 0.0)))
        n = np.maximum(n, 0)
        better = 2 * n * gain - n * n * norm
        if both.any():  # floors of categories that only a holds
            for x, y in zip(*np.nonzero(both & (n > 0)), strict=True):
                only = [int(count[q] - low[q]) for q in np.flatnonzero((held[x] == 1) & (held[y] == 0))]
                n[x, y] = min([n[x, y], *only])
            better = 2 * n * gain - n * n * norm
        x, y = np.unravel_index(int(better.argmax()), better.shape)
        if better[x, y] <= 1e-9:
            break
        take[x] -= int(n[x, y])
        take[y] += int(n[x, y])
        count += int(n[x, y]) * step[x, y]
    return {s: int(t) for s, t in zip(sigs, take, strict=True)}


def reach(available: int, taken: int, need: int) -> int:
    """Records of a class after exchanges into it alone, until its need is met or it has no more."""
    return taken + min(max(0, need - taken), available - taken)


def plan_samples(sources: dict[str, DataFrame], sample_targets: DataFrame, seed: int = 42) -> tuple[DataFrame, dict[str, dict]]:
    """The report per request and class, and per source the counts to take.

    Only one count per class asked for comes to the driver, whatever the corpus.
    """
    spark = sample_targets.sparkSession
    rows = sample_targets.select("request_id", "source_table", "sample_size", "class_name", "target_share", "min_count").dropna().distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"sample_targets must stay a small request table (at most {MAX_TARGETS} rows)")
    report, plans = [], {}
    for name, records in sources.items():
        own = [r for r in rows if r["source_table"] == name]
        if not own:
            continue
        wanted = sorted({fold(r["class_name"]) for r in own})
        counts = records.where(F.col("signature").isin(wanted)).groupBy("signature").agg(F.sum("weight").alias("n"))
        available = {r["signature"]: r["n"] for r in counts.collect()}  # at most the classes asked for
        takes: dict[tuple[int, str], int] = {}
        for request in sorted({r["request_id"] for r in own}):
            mine = [r for r in own if r["request_id"] == request]
            size = max(r["sample_size"] for r in mine)
            shares: dict[str, float] = {}
            floors: dict[str, int] = {}
            for r in mine:
                c = fold(r["class_name"])
                shares[c] = shares.get(c, 0.0) + r["target_share"]
                floors[c] = max(floors.get(c, 0), r["min_count"])
            take = swap_repair({c: available.get(c, 0) for c in shares}, shares, floors, size, seed + request)
            over = sum(min(f, available.get(c, 0)) for c, f in floors.items()) > size
            for r in mine:
                c = fold(r["class_name"])
                takes[request, c] = take[c]
                need = max(r["min_count"], math.floor(r["target_share"] * r["sample_size"] + 0.5))
                there = available.get(c, 0)
                report.append((request, name, r["class_name"], float(r["target_share"]), need, there, take[c], reach(there, take[c], need) < need, over))
        plans[name] = {"takes": takes, "wanted": wanted}
    schema = "request_id int, source_table string, class_name string, target_share double, needed bigint, available bigint, taken bigint, short boolean, floors_exceed boolean"
    return spark.createDataFrame(report, schema), plans


def draw_samples(sources: dict[str, DataFrame], sample_targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: request_id, source_table, signature, id, symbol (its number in a counted row, from 0)."""
    report, plans = plan_samples(sources, sample_targets, seed)
    spark = sample_targets.sparkSession
    parts = []
    for name, plan in plans.items():
        rec = pieces(sources[name].where(F.col("signature").isin(plan["wanted"]))).withColumn("bucket", F.pmod(_hash(seed), F.lit(BUCKETS)).cast("int"))
        by: dict[str, dict[int, int]] = {}
        for r in rec.groupBy("signature", "bucket").agg(F.sum("weight").alias("n")).collect():  # at most classes asked for x BUCKETS rows
            by.setdefault(r["signature"], {})[r["bucket"]] = r["n"]
        cuts = []  # (request, signature, whole buckets below, symbols still wanted from the cut bucket)
        for (request, c), n in plan["takes"].items():
            b, left = 0, n
            while b < BUCKETS and left > 0 and left >= by.get(c, {}).get(b, 0):
                left -= by.get(c, {}).get(b, 0)
                b += 1
            cuts.append((request, c, b, left))
        cut = spark.createDataFrame(cuts, "request_id int, signature string, cut int, rest bigint")  # as many rows as targets
        hit = rec.join(F.broadcast(cut), "signature").where("bucket < cut or (bucket = cut and rest > 0)")
        each = F.explode(F.expr("sequence(first, first + weight - 1)")).alias("symbol")
        whole = hit.where("bucket < cut").select("request_id", "signature", "id", each)
        edge = hit.where("bucket = cut").select("request_id", "signature", "id", "first", "rest", each)
        w = Window.partitionBy("request_id", "signature").orderBy(F.xxhash64(F.lit(seed + 1), F.col("id"), F.col("symbol")), "id", "symbol")
        part = edge.withColumn("rank", F.row_number().over(w)).where("rank <= rest").select("request_id", "signature", "id", "symbol")
        parts.append(whole.unionByName(part).select("request_id", F.lit(name).alias("source_table"), "signature", "id", "symbol"))
    if not parts:
        return spark.createDataFrame([], "request_id int, source_table string, signature string, id string, symbol bigint"), report
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, report
