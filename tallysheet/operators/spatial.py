"""Spatial joins, suppression and one-to-one matching, without pairs of a whole page.

Distance joins hash both sides onto a grid whose cell is the search radius and compare the 3 x 3
neighbourhood only; the work of a dense cell is split over tasks.

Ordered greedy procedures (non-max suppression, one-to-one matching) give exactly the sequential result in
two ways. Groups of bounded size (``MAX_GROUP`` rows: pages, or connected components of what is left) are
visited in order in one task each. Larger ones are worked off in rounds: whatever is first in order among all
it conflicts with is decided, its conflicts fall; after ``ROUNDS`` of them the rest is parted into groups
again. So a page may hold any share of all rows, and a long chain of conflicts costs no round per link.

Defined results: rows with a NULL key or coordinate match nothing (and survive suppression); ties are
broken by the given order columns, which must be unique; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions.geometry import distance, iou
from tallysheet.operators.components import hook_and_shortcut
from tallysheet.session import cut

MAX_GROUP = 1_000_000  # rows (boxes or edges) of a group that one task visits in order
ROUNDS = 4  # rounds over larger groups before the rest is parted again
DENSE = 1_000_000  # pairs to compare in a cell from which its work is split
CHUNK = 1_000_000  # pairs that a visit compares at once


def distance_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float, lx: str = "cx", ly: str = "cy", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Pairs of one key at most ``radius`` apart, with their ``dist``; a grid equi-join."""
    r = F.lit(float(radius))
    cell = lambda c, d: (F.floor(F.col(c) / r) + d).cast("bigint")
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    lhs = left.withColumns({"_gx": cell(lx, 0), "_gy": cell(ly, 0)})
    rhs = right.withColumn("_n", F.explode(near)).withColumns({"_gx": cell(rx, F.col("_n.a")), "_gy": cell(ry, F.col("_n.b"))}).drop("_n")
    lhs, rhs, on = _salted(lhs, rhs, [*keys, "_gx", "_gy"])
    return lhs.join(rhs, on).drop("_gx", "_gy", "_salt").withColumn("dist", distance(F.col(lx), F.col(ly), F.col(rx), F.col(ry))).where(F.col("dist") <= r)


def _salted(lhs: DataFrame, rhs: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt for cells of more than ``DENSE`` comparisons: the left rows of such a cell are
    dealt out, the right ones repeated. Counting the cells is a small aggregation; without a dense cell
    nothing else is done."""
    a, b = lhs.groupBy(*on).agg(F.count("*").alias("_a")), rhs.groupBy(*on).agg(F.count("*").alias("_b"))
    dense = cut(a.where("_a > 1").join(b.where("_b > 1"), on).where(F.col("_a") * F.col("_b") > DENSE).select(*on, F.least(F.ceil(F.col("_a") * F.col("_b") / DENSE), F.col("_a")).cast("int").alias("_salts")))
    if dense.isEmpty():
        return lhs, rhs, on
    salts = F.coalesce("_salts", F.lit(1))
    lhs = lhs.join(dense, on, "left").withColumn("_salt", F.floor(F.rand(17) * salts).cast("int")).drop("_salts")
    rhs = rhs.join(dense, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return lhs, rhs, [*on, "_salt"]


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 256.0) -> DataFrame:
    """Pairs of overlapping boxes (a_x1.. and b_x1..) of one key; each pair once, by the cell of its overlap's corner."""
    r = F.lit(float(cell))
    at = lambda c: F.floor(F.col(c) / r).cast("bigint")

    def spread(df: DataFrame, p: str) -> DataFrame:
        ok = df.where((F.col(f"{p}x2") > F.col(f"{p}x1")) & (F.col(f"{p}y2") > F.col(f"{p}y1")))
        return ok.withColumn("_gx", F.explode(F.sequence(at(f"{p}x1"), at(f"{p}x2")))).withColumn("_gy", F.explode(F.sequence(at(f"{p}y1"), at(f"{p}y2"))))

    j = spread(left, "a_").join(spread(right, "b_"), [*keys, "_gx", "_gy"])
    x, y = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    over = (x < F.least("a_x2", "b_x2")) & (y < F.least("a_y2", "b_y2"))
    return j.where(over & (F.floor(x / r) == F.col("_gx")) & (F.floor(y / r) == F.col("_gy"))).drop("_gx", "_gy")


def window_join(windows: DataFrame, points: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Points inside windows of one key: windows(keys.., wx1, wy1, wx2, wy2), points(keys.., px, py).

    A window goes to every grid cell it touches and a point to its one cell, so each pair comes up once,
    whatever the sizes of the windows. NULL coordinates match nothing.
    """
    r = F.lit(float(cell))
    at = lambda c: F.floor(F.col(c) / r).cast("bigint")
    ok = windows.where("wx1 <= wx2 and wy1 <= wy2")
    lhs = ok.withColumn("_gx", F.explode(F.sequence(at("wx1"), at("wx2")))).withColumn("_gy", F.explode(F.sequence(at("wy1"), at("wy2"))))
    rhs = points.withColumns({"_gx": at("px"), "_gy": at("py")})
    return lhs.join(rhs, [*keys, "_gx", "_gy"]).where("px between wx1 and wx2 and py between wy1 and wy2").drop("_gx", "_gy")


def nearest(pairs: DataFrame, by: list[str], value: Column, *order: Column) -> DataFrame:
    """Per group the value with the least (dist, order...)."""
    return pairs.groupBy(*by).agg(F.min_by(value, F.struct("dist", *order)).alias("nearest"), F.min("dist").alias("dist"))


def _parted(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most MAX_GROUP rows, rows of larger groups or None); ``df`` is a cut frame."""
    large = cut(df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > MAX_GROUP).select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)]))
    if large.isEmpty():
        return df, None
    same = reduce(lambda x, y: x & y, [df[b].eqNullSafe(large[f"_k{i}"]) for i, b in enumerate(by)])
    return df.join(large, same, "left_anti"), cut(df.join(large, same, "left_semi"))


def _together(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, frames) if frames else None


def _bundled(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Rows with ``_bundle``: groups dealt to bundles of a quarter of MAX_GROUP rows or so, each one call of a
    worker, as a call for each of many small groups would cost more than its work. ``df`` is a cut frame, or its
    number of rows is given."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(df.count() if rows is None else rows) * 4 // MAX_GROUP))
    return df.withColumn("_bundle", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def keep_first(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Greedy suppression in rank order: nodes(id, rank), conflicts(a, b) -> ids kept.

    ``rank`` is unique and small ranks come first. Equal to visiting the nodes in rank order and
    dropping whatever conflicts with a node kept before.
    """
    rank = nodes.select("id", "rank")
    both = conflicts.select("a", "b").where("a <> b").join(rank.toDF("a", "ra"), "a").join(rank.toDF("b", "rb"), "b")
    before = F.col("ra") < F.col("rb")
    # an edge points from the earlier to the later node
    edges = cut(both.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("later"), F.least("ra", "rb").alias("r")).distinct())
    dropped: list[DataFrame] = []
    typed = edges.schema["later"].dataType.simpleString()

    def visit(t: pa.Table) -> pa.Table:
        gone: set = set()
        order = np.argsort(t["_o"].to_numpy(), kind="stable")
        first, later = t["first"].to_pylist(), t["later"].to_pylist()
        for i in order:
            if first[i] not in gone:
                gone.add(later[i])
        return pa.table({"id": pa.array(list(gone), t["later"].type)})

    while not edges.isEmpty():
        if edges.count() <= MAX_GROUP:  # all that is left fits one group
            small, edges = edges.withColumn("component", F.lit(0)), None
        else:
            ends = edges.select(F.col("first").alias("node")).unionByName(edges.select(F.col("later").alias("node")))
            held = cut(edges.join(hook_and_shortcut(ends, edges.select(F.col("first").alias("a"), F.col("later").alias("b"))), edges["first"] == F.col("node")).drop("node"))
            small, edges = _parted(held, ["component"])
        placed = _bundled(small, ["component"]).withColumn("_o", F.dense_rank().over(Window.partitionBy("_bundle").orderBy("r")))
        dropped.append(cut(placed.select("_bundle", "first", "later", "_o").groupBy("_bundle").applyInArrow(visit, f"id {typed}")))
        if edges is None:
            break
        edges = edges.drop("component")
        for _ in range(ROUNDS):
            # kept for sure: nodes that come first in some edge and later in none
            sure = edges.select(F.col("first").alias("id")).distinct().join(edges.select(F.col("later").alias("id")).distinct(), "id", "left_anti")
            gone = cut(edges.join(sure, edges["first"] == sure["id"], "left_semi").select(F.col("later").alias("id")).distinct())
            dropped.append(gone)
            rest = edges.join(gone, edges["first"] == gone["id"], "left_anti")
            edges = cut(rest.join(gone, rest["later"] == gone["id"], "left_anti").join(sure, rest["first"] == sure["id"], "left_anti"))
        dropped = [cut(_together(dropped))]
    out = _together(dropped)
    return nodes if out is None else nodes.join(out, "id", "left_anti")


def greedy_match(edges: DataFrame, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one matching of edges(l, r, ...) visited in order: an edge is taken when both ends are free.

    The order columns decide, then l, then r. ``by`` names columns that all edges of an end share (its page),
    so that groups need not be searched for.
    """
    columns = edges.columns
    # least edge at each end: structs of the order columns compare left to right
    left: DataFrame | None = cut(edges.withColumn("_e", F.struct(*order, "l", "r")))
    taken: list[DataFrame] = []

    def visit(t: pa.Table) -> pa.Table:
        ls, rs, out = set(), set(), []
        l, r = t["l"].to_pylist(), t["r"].to_pylist()
        for i in np.argsort(t["_o"].to_numpy(), kind="stable"):
            if l[i] not in ls and r[i] not in rs:
                ls.add(l[i])
                rs.add(r[i])
                out.append(i)
        return t.take(pa.array(out, pa.int64())).select(columns)

    def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
        # groups share no end, so those of a bundle may be visited together
        placed = _bundled(df, keys).withColumn("_o", F.row_number().over(Window.partitionBy("_bundle").orderBy("_e"))).drop("_e")
        return placed.groupBy("_bundle").applyInArrow(visit, edges.schema)

    if by:
        small, left = _parted(left, list(by))
        taken.append(ordered(small, list(by)))
    while left is not None and not left.isEmpty():
        if left.count() <= MAX_GROUP:
            taken.append(ordered(left.withColumn("_c", F.lit(0)), ["_c"]))
            break
        end = lambda side: F.concat(F.lit(f"{side}\u0001"), F.col(side).cast("string"))
        pairs = left.select(end("l").alias("a"), end("r").alias("b"))
        comp = hook_and_shortcut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), pairs)
        held = cut(left.withColumn("_a", end("l")).join(comp.select(F.col("node").alias("_a"), F.col("component").alias("_c")), "_a").drop("_a"))
        small, left = _parted(held, ["_c"])
        taken.append(cut(ordered(small, ["_c"])))
        if left is None:
            break
        left = left.drop("_c")
        for _ in range(ROUNDS):
            best_l = left.groupBy("l").agg(F.min("_e").alias("_el"))
            best_r = left.groupBy("r").agg(F.min("_e").alias("_er"))
            won = cut(left.join(best_l, "l").join(best_r, "r").where("_e = _el and _e = _er").select(*left.columns))
            taken.append(won.select(columns))
            left = cut(left.join(won.select("l"), "l", "left_anti").join(won.select("r"), "r", "left_anti"))
        taken = [cut(_together(taken))]
    out = _together(taken)
    return edges.limit(0) if out is None else out.select(columns)


def _near_pairs(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], radius: float, visit) -> None:
    """Calls ``visit(left rows, right rows)`` with the candidates of the left rows a to b, in their order and some
    CHUNK at a time: the right rows of the 3 x 3 cells around each. left and right: (group, end, x, y), rows of one
    left end stand together and come in one call."""
    (lg, le, lx, ly), (rg, _, rx, ry) = left, right
    gx, gy = np.floor(rx / radius), np.floor(ry / radius)
    xs, ys = np.unique(gx), np.unique(gy)
    key = lambda g, x, y: (g * len(xs) + x) * len(ys) + y
    at = key(rg, np.searchsorted(xs, gx), np.searchsorted(ys, gy))
    order = np.argsort(at, kind="stable")
    at = at[order]
    gx, gy = np.floor(lx / radius), np.floor(ly / radius)
    y1, y2 = np.searchsorted(ys, gy - 1), np.searchsorted(ys, gy + 1, "right")
    starts, counts = [], []
    for a in (-1, 0, 1):  # cells of one column follow one another
        x = np.minimum(np.searchsorted(xs, gx + a), len(xs) - 1)
        starts.append(np.searchsorted(at, key(lg, x, y1)))
        counts.append(np.where((xs[x] == gx + a) & (y2 > y1), np.searchsorted(at, key(lg, x, y2 - 1), "right") - starts[-1], 0))
    start, count = np.stack(starts, axis=1), np.stack(counts, axis=1)
    upto = np.append(0, np.cumsum(count.sum(axis=1)))
    bounds = np.append(np.flatnonzero(np.append(True, le[1:] != le[:-1])), len(le))  # where an end begins
    k = 0
    while k < len(bounds) - 1:
        j = max(k + 1, int(np.searchsorted(upto[bounds], upto[bounds[k]] + CHUNK, "right")) - 1)
        a, b = bounds[k], bounds[j]
        n = count[a:b].ravel()
        first = np.repeat(start[a:b].ravel() - np.append(0, np.cumsum(n)[:-1]), n)
        visit(np.repeat(np.repeat(np.arange(a, b), 3), n), order[first + np.arange(len(first))])
        k = j


def first_fit(ends: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """One-to-one matching (l, r) of one key: the lefts by rising ``l`` take their least unused ``r`` that is nearer
    than ``radius`` (to nine places).

    Each row of ends(keys.., l, cx, cy, r, rx, ry) holds a left end, a right one (the other's columns are NULL) or
    both; rows may repeat. The pairs of a group are compared within its visit, so what is shuffled grows with the
    rows, not with the pairs. A NULL id matches nothing.
    """
    rows, most = ends.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    small, large = (ends, None) if (most or 0) <= MAX_GROUP else _parted(cut(ends), keys)

    def side(t: pa.Table, names: list[str]) -> tuple[np.ndarray, ...]:
        """(group, end, x, y) and the group and id of each end, all by group and id."""
        t = t.select(["_g", *names]).drop_null()
        g, ids, x, y = (c.to_numpy() for c in t.columns)
        ok = np.isfinite(x) & np.isfinite(y)
        by = np.lexsort((ids[ok], g[ok]))
        g, ids, x, y = (c[ok][by] for c in (g, ids, x, y))
        new = np.append(True, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1])) if len(g) else np.zeros(0, bool)
        return g.astype(np.int64), np.cumsum(new) - 1, x, y, ids[new]

    def visit(t: pa.Table) -> pa.Table:
        (*left, l), (*right, r) = side(t, ["l", "cx", "cy"]), side(t, ["r", "rx", "ry"])
        (_, le, lx, ly), (_, re, rx, ry) = left, right
        used, taken = np.zeros(len(r), bool), np.full(len(l), -1)

        def take(i: np.ndarray, j: np.ndarray) -> None:
            free = ~used[re[j]]
            i, j = i[free], j[free]
            dx, dy = lx[i] - rx[j], ly[i] - ry[j]
            near = np.sqrt(dx * dx + dy * dy) < radius - 5e-10  # what rounds to the radius is not nearer
            a, b = le[i[near]], re[j[near]]
            by = np.lexsort((b, a))
            done, gone = -1, set()
            for x, y in zip(a[by].tolist(), b[by].tolist(), strict=True):
                if x != done and y not in gone:
                    gone.add(y)
                    taken[x] = y
                    done = x
            used[list(gone)] = True

        if len(l) and len(r):
            _near_pairs(tuple(left), tuple(right), radius, take)
        return pa.table({"l": pa.array(l[taken >= 0], t["l"].type), "r": pa.array(r[taken[taken >= 0]], t["r"].type)})

    kind = lambda c: ends.schema[c].dataType.simpleString()
    placed = _bundled(small.dropna(subset=keys), keys, rows or 0).withColumn("_g", F.dense_rank().over(Window.partitionBy("_bundle").orderBy(*keys)))
    out = placed.select("_bundle", "_g", "l", "cx", "cy", "r", "rx", "ry").groupBy("_bundle").applyInArrow(visit, f"l {kind('l')}, r {kind('r')}")
    if large is None:
        return out
    finite = lambda *c: reduce(lambda x, y: x & y, [F.abs(v) < float("inf") for v in c])
    lefts, rights = large.select(*keys, "l", "cx", "cy").dropna().where(finite("cx", "cy")), large.select(*keys, "r", "rx", "ry").dropna().where(finite("rx", "ry"))
    pairs = distance_join(lefts, rights, keys, radius).where(F.round("dist", 9) < radius)
    own = lambda c: F.to_json(F.struct(*keys, c)).alias(c)  # an id may stand in several groups
    edges = pairs.select(*keys, F.col("l").alias("first"), F.col("r").alias("second"), own("l"), own("r")).distinct()
    return out.unionByName(greedy_match(edges, "first", "second", by=tuple(keys)).select(F.col("first").alias("l"), F.col("second").alias("r")))


BOX = ["x1", "y1", "x2", "y2"]


def _distinct(boxes: DataFrame, keys: list[str], shape: list[str]) -> DataFrame:
    """Per key and shape the first box in rank order (``rep``): boxes(id, rank, shape..)."""
    return boxes.groupBy(*keys, *shape).agg(F.min_by("id", "rank").alias("rep"), F.min("rank").alias("rank"))


def _visited(d: DataFrame, keys: list[str], visit, shape: list[str]) -> DataFrame:
    """Ids that ``visit`` keeps of each group, its rows in rank order: visit(array of shapes) -> kept positions."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["_o"].to_numpy(), kind="stable")))
        group = t["_g"].to_numpy()
        at = np.stack([t[c].to_numpy() for c in shape], axis=1).astype(float)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
        kept = [a + i for a, b in zip(starts, [*starts[1:], len(group)], strict=True) for i in visit(at[a:b])]
        return pa.table({"id": t["rep"].take(pa.array(kept, pa.int64()))})

    by = lambda *order: Window.partitionBy("_bundle").orderBy(*keys, *order)
    placed = _bundled(d, keys).select("_bundle", "rep", *shape, F.dense_rank().over(by()).alias("_g"), F.row_number().over(by("rank")).alias("_o"))
    return placed.groupBy("_bundle").applyInArrow(run, f"id {d.schema['rep'].dataType.simpleString()}")


def _whole(d: DataFrame, keys: list[str], shape: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that can conflict, the others): a NULL key or coordinate conflicts with nothing."""
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*keys, *shape]])
    return d.where(whole), d.where(~whole)


def suppress_near(boxes: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """Ids kept when, in rank order, a box goes whose centre is closer than ``distance`` on both axes to a
    kept one. boxes(keys.., id, rank, cx, cy); rank is unique.

    Boxes of one grid cell of that side conflict, so a cell keeps one box at most: no pairs are made. Of
    boxes with one centre only the first can stay (what drops it drops them all), so copies are reduced first.
    """

    def visit(at: np.ndarray) -> list[int]:
        kept: dict[tuple[int, int], tuple[float, float]] = {}
        out = []
        for i, (x, y) in enumerate(at.tolist()):
            gx, gy = int(x // distance), int(y // distance)
            near = (kept.get((gx + a, gy + b)) for a in (-1, 0, 1) for b in (-1, 0, 1))
            if not any(k and abs(k[0] - x) < distance and abs(k[1] - y) < distance for k in near):
                kept[gx, gy] = (x, y)
                out.append(i)
        return out

    d, odd = _whole(_distinct(boxes, keys, ["cx", "cy"]), keys, ["cx", "cy"])
    left: DataFrame | None = cut(d)
    kept: list[DataFrame] = [odd.select(F.col("rep").alias("id"))]
    cell = lambda c, k: (F.floor(F.col(c) / F.lit(float(distance))) + k).cast("bigint")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    close = (F.abs(F.col("cx") - F.col("sx")) < distance) & (F.abs(F.col("cy") - F.col("sy")) < distance)
    while left is not None:
        small, left = _parted(left, keys)
        kept.append(_visited(small, keys, visit, ["cx", "cy"]))
        if left is None:
            break
        at = [*keys, "_gx", "_gy"]
        for _ in range(ROUNDS):
            placed = left.withColumns({"_gx": cell("cx", 0), "_gy": cell("cy", 0)})
            # only the first of a cell can be first among all its conflicts
            heads = placed.groupBy(*at).agg(F.min_by(F.struct("rep", "rank", "cx", "cy"), "rank").alias("h")).select(*keys, F.col("h.rep").alias("sid"), F.col("h.rank").alias("srank"), F.col("h.cx").alias("sx"), F.col("h.cy").alias("sy"))
            reach = cut(heads.withColumn("_n", F.explode(around)).withColumns({"_gx": cell("sx", F.col("_n.a")), "_gy": cell("sy", F.col("_n.b"))}).drop("_n"))
            hits = placed.join(reach, at).where(close)
            blocked = hits.where("rank < srank").select("sid").distinct()
            sure = cut(heads.join(blocked, "sid", "left_anti"))
            kept.append(sure.select(F.col("sid").alias("id")))
            gone = hits.join(sure.select("sid"), "sid", "left_semi").select("rep").distinct()
            left = cut(left.join(gone, "rep", "left_anti"))
        kept = [cut(_together(kept))]
    return _together(kept)


def suppress_overlaps(boxes: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Ids kept when, in rank order, a box goes that overlaps a kept one by more than ``limit`` (IoU, to nine
    places). boxes(keys.., id, rank, x1, y1, x2, y2); rank is unique; copies of one box are reduced first.
    """
    least = limit + 5e-10  # the share that rounds to more than the limit

    def visit(at: np.ndarray) -> list[int]:
        side = max(1.0, float(np.median(np.maximum(at[:, 2] - at[:, 0], at[:, 3] - at[:, 1])))) if len(at) else 1.0
        held: dict[tuple[int, int], list[int]] = defaultdict(list)
        out = []
        size = np.maximum(at[:, 2] - at[:, 0], 0) * np.maximum(at[:, 3] - at[:, 1], 0)
        for i, (x1, y1, x2, y2) in enumerate(at.tolist()):
            # a box can only be dropped by one that holds its centre's cell or any other it touches
            cells = [(a, b) for a in range(int(x1 // side), int(x2 // side) + 1) for b in range(int(y1 // side), int(y2 // side) + 1)] if x2 > x1 and y2 > y1 else []
            near = list({k for c in cells for k in held.get(c, ())})
            if near:
                o = at[near]
                w, h = np.minimum(o[:, 2], x2) - np.maximum(o[:, 0], x1), np.minimum(o[:, 3], y2) - np.maximum(o[:, 1], y1)
                both = np.maximum(w, 0) * np.maximum(h, 0)
                if (both >= least * (size[near] + size[i] - both)).any() and ((both > 0) & (both >= least * (size[near] + size[i] - both))).any():
                    continue
            for c in cells:
                held[c].append(i)
            out.append(i)
        return out

    d, odd = _whole(_distinct(boxes, keys, BOX), keys, BOX)
    small, large = _parted(cut(d), keys)
    kept = [odd.select(F.col("rep").alias("id")), _visited(small, keys, visit, BOX)]
    if large is not None:
        side = lambda p: large.select(*keys, F.col("rep").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in BOX])
        over = overlap_join(side("a_"), side("b_"), keys).where(F.col("a_id") < F.col("b_id"))
        kept.append(keep_first(large.select(F.col("rep").alias("id"), "rank"), over.where(F.round(iou("a_", "b_"), 9) > limit).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).select("id"))
    return _together(kept)


def adjacent_cells(cells: DataFrame, keys: list[str], gap: float, share: float = 0.3) -> DataFrame:
    """Edges (a, b) between ruled cells(keys.., id, x1, y1, x2, y2) of one table: edges that touch within ``gap``
    on one axis, and an overlap above ``share`` of the lesser side on the other."""
    grown = cells.select(*keys, "id", *BOX, (F.col("x1") - gap).alias("g1"), (F.col("y1") - gap).alias("g2"), (F.col("x2") + gap).alias("g3"), (F.col("y2") + gap).alias("g4"))

    def side(p: str) -> DataFrame:
        own = [F.col(c).alias(f"{p}o{c}") for c in BOX]
        return grown.select(*keys, F.col("id").alias(f"{p}id"), *own, *[F.col(g).alias(f"{p}{c}") for g, c in zip(("g1", "g2", "g3", "g4"), BOX, strict=True)])

    j = overlap_join(side("a_"), side("b_"), keys).where(F.col("a_id") < F.col("b_id"))

    def axis(lo: str, hi: str) -> tuple[Column, Column]:
        a1, a2, b1, b2 = F.col(f"a_o{lo}"), F.col(f"a_o{hi}"), F.col(f"b_o{lo}"), F.col(f"b_o{hi}")
        touch = (F.abs(b1 - a2) < gap) | (F.abs(b2 - a1) < gap)
        return touch, F.least(a2, b2) - F.greatest(a1, b1) > share * F.least(a2 - a1, b2 - b1)

    (touch_x, along_x), (touch_y, along_y) = axis("x1", "x2"), axis("y1", "y2")
    return j.where((touch_x & along_y) | (touch_y & along_x)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def overlap_edges(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b) that connect overlapping boxes(keys.., id, x1, y1, x2, y2): copies of a box as a star
    to their least id, then overlaps between different boxes."""
    d = cut(boxes.groupBy(*keys, *BOX).agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    copies = boxes.join(d.where("n > 1"), [*keys, *BOX]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    side = lambda p: d.select(*keys, F.col("rep").alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in BOX])
    over = overlap_join(side("a_"), side("b_"), keys).where(F.col("a_id") < F.col("b_id")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return copies.unionByName(over)
