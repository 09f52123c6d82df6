"""Queries of the spatial, matching and dataset operators, with their SQL counterparts.

The detections of these queries are the reviewed boxes moved by a few pixels and in part relabelled,
by fixed arithmetic on the box id, so both engines see the same rows; every box takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysheet.functions import geometry as G
from tallysheet.functions import maps
from tallysheet.operators import spatial
from tallysheet.operators.components import hook_and_shortcut
from tallysheet.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


PAGE = ["project", "page"]


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed boxes with area, corners in order, class folded; they may repeat."""
    cls = F.trim(F.regexp_replace(F.upper("cls"), r"[\s ]+", " "))
    b = table(spark, d, "ls_boxes").where("project is not null and page is not null and cls is not null and x1 <> x2 and y1 <> y2")
    return b.select("box_id", "project", "page", F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"), cls.alias("cls"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed boxes, once each."""
    return _reviewed(spark, d).distinct()


def _moved() -> dict[str, Column]:
    """The corners of a box as its detection has them."""
    dx, dy = (F.col("box_id") * 37) % 23 - 11, (F.col("box_id") * 91) % 17 - 8
    return {"x1": F.col("x1") + dx, "y1": F.col("y1") + dy, "x2": F.col("x2") + dx, "y2": F.col("y2") + dy}


def _relabelled() -> Column:
    """The class of a box as its detection has it."""
    return F.when(F.col("box_id") % 10 == 0, "FAN").otherwise(F.col("cls"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Detections: the boxes moved and in part relabelled."""
    return truth(spark, d).select("box_id", "project", "page", *[v.alias(c) for c, v in _moved().items()], _relabelled().alias("cls"), ((F.col("box_id") * 53) % 100 / 100).alias("conf"))


TRUTH = r"truth AS (SELECT DISTINCT box_id, project, page, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2, trim(regexp_replace(upper(cls), '[\s\x{00A0}]+', ' ', 'g')) AS cls FROM ls_boxes WHERE project IS NOT NULL AND page IS NOT NULL AND cls IS NOT NULL AND x1 <> x2 AND y1 <> y2)"
FOUND = "found AS (SELECT box_id, project, page, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2, CASE WHEN box_id % 10 = 0 THEN 'FAN' ELSE cls END AS cls, (box_id * 53) % 100 / 100.0 AS conf FROM (SELECT *, (box_id * 37) % 23 - 11 AS dx, (box_id * 91) % 17 - 8 AS dy FROM truth))"
IOU = "(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
OVER = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c) if c in PAGE else F.col(c).alias(f"{p}{c}") for c in df.columns])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping (detection, truth) pairs of one page with their IoU."""
    j = spatial.overlap_join(_prefixed(found(spark, d), "a_"), _prefixed(truth(spark, d), "b_"), PAGE)
    return j.withColumn("iou", G.iou("a_", "b_"))


def fold_sql(edges: str, order: str) -> str:
    """SQL of the sequential greedy matching: a fold over the ordered edges of each page."""
    return f"""
SELECT project, page, unnest(list_reduce(list_transform(es, lambda e: [e]), lambda acc, x: CASE WHEN list_contains(list_transform(acc, lambda t: t.l), x[1].l) OR list_contains(list_transform(acc, lambda t: t.r), x[1].r) THEN acc ELSE list_concat(acc, x) END)) AS m
FROM (SELECT project, page, list({{'l': l, 'r': r}} ORDER BY {order}) AS es FROM ({edges}) GROUP BY project, page)"""


PAIRS = f"SELECT a.project, a.page, a.box_id AS l, b.box_id AS r, {IOU} AS iou FROM found a JOIN truth b ON a.project = b.project AND a.page = b.page AND {OVER}"


@query("iou_greedy_match", f"WITH {TRUTH}, {FOUND}, m AS ({fold_sql(f'SELECT * FROM ({PAIRS}) WHERE iou >= 0.4', 'l, -round(iou, 9), r')}) SELECT m.l AS det_id, m.r AS truth_id FROM m")
def iou_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-14: detections in order take their best unused truth at IoU 0.4 or more."""
    e = _pairs(spark, d).where("iou >= 0.4").select(*PAGE, F.col("a_box_id").alias("l"), F.col("b_box_id").alias("r"), (-F.round("iou", 9)).alias("o"))
    e = e.withColumn("first", F.col("l"))
    return spatial.greedy_match(e, "first", "o", by=("project", "page")).select(F.col("l").alias("det_id"), F.col("r").alias("truth_id"))


NEAR = "SELECT a.project, a.page, a.box_id AS l, b.box_id AS r, sqrt((a.x1 + a.x2 - b.x1 - b.x2) * (a.x1 + a.x2 - b.x1 - b.x2) + (a.y1 + a.y2 - b.y1 - b.y2) * (a.y1 + a.y2 - b.y1 - b.y2)) / 2 AS dist FROM found a JOIN truth b ON a.project = b.project AND a.page = b.page AND abs(a.x1 + a.x2 - b.x1 - b.x2) <= {2r} AND abs(a.y1 + a.y2 - b.y1 - b.y2) <= {2r}"


def _near(spark: SparkSession, d: str, radius: float) -> DataFrame:
    mid = lambda df, x, y: df.withColumns({x: (F.col("x1") + F.col("x2")) / 2, y: (F.col("y1") + F.col("y2")) / 2})
    left = mid(found(spark, d), "cx", "cy").select(*PAGE, F.col("box_id").alias("l"), "cx", "cy", F.col("cls").alias("l_cls"))
    right = mid(truth(spark, d), "rx", "ry").select(*PAGE, F.col("box_id").alias("r"), "rx", "ry", F.col("cls").alias("r_cls"))
    return spatial.distance_join(left, right, PAGE, radius)


@query("first_fit_match", f"WITH {TRUTH}, {FOUND}, m AS ({fold_sql(f'SELECT * FROM ({NEAR.replace("{2r}", "160")}) WHERE round(dist, 9) < 80', 'l, r')}) SELECT m.l AS det_id, m.r AS truth_id FROM m")
def first_fit_match(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-15: detections in order take the first unused truth nearer than 80 px."""
    m = _moved()
    mid = {"cx": (m["x1"] + m["x2"]) / 2, "cy": (m["y1"] + m["y2"]) / 2, "rx": (F.col("x1") + F.col("x2")) / 2, "ry": (F.col("y1") + F.col("y2")) / 2}
    # both ends of a box in one row; repeated rows change nothing
    e = _reviewed(spark, d).select(*PAGE, F.col("box_id").alias("l"), F.col("box_id").alias("r"), *[v.alias(c) for c, v in mid.items()])
    return spatial.first_fit(e, PAGE, 80.0).select(F.col("l").alias("det_id"), F.col("r").alias("truth_id"))


@query("top_score_match", f"WITH {TRUTH}, {FOUND}, m AS ({fold_sql(f'SELECT * FROM ({PAIRS}) WHERE iou > 0', '-round(iou, 9), l, r')}) SELECT m.l AS det_id, m.r AS truth_id FROM m")
def top_score_match(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-16: pairs by falling score, each side once."""
    e = _pairs(spark, d).where("iou > 0").select(*PAGE, F.col("a_box_id").alias("l"), F.col("b_box_id").alias("r"), (-F.round("iou", 9)).alias("o"))
    return spatial.greedy_match(e, "o", by=("project", "page")).select(F.col("l").alias("det_id"), F.col("r").alias("truth_id"))


@query(
    "review_status",
    f"""WITH {TRUTH}, {FOUND}, m AS ({fold_sql(f'SELECT * FROM ({PAIRS}) WHERE iou >= 0.4', 'l, -round(iou, 9), r')}), k AS (SELECT m.l, m.r FROM m)
SELECT status, count(*) AS n FROM (
SELECT CASE WHEN r IS NULL THEN 'deleted' WHEN f.cls = t.cls THEN 'accepted' ELSE 'relabeled' END AS status FROM found f LEFT JOIN k ON k.l = f.box_id LEFT JOIN truth t ON t.box_id = k.r
UNION ALL SELECT 'added' FROM truth t WHERE box_id NOT IN (SELECT r FROM k)) GROUP BY status""",
)
def review_status(spark: SparkSession, d: str) -> DataFrame:
    """CMP-13, AGG-16: accepted, relabelled, deleted and added boxes of a review."""
    m = iou_greedy_match(spark, d)
    f, t = found(spark, d).select(F.col("box_id").alias("det_id"), F.col("cls").alias("f_cls")), truth(spark, d).select(F.col("box_id").alias("truth_id"), F.col("cls").alias("t_cls"))
    seen = f.join(m, "det_id", "left").join(t, "truth_id", "left").select(F.when(F.col("truth_id").isNull(), "deleted").when(F.col("f_cls") == F.col("t_cls"), "accepted").otherwise("relabeled").alias("status"))
    added = t.join(m, "truth_id", "left_anti").select(F.lit("added").alias("status"))
    return seen.unionByName(added).groupBy("status").agg(F.count("*").alias("n"))


def nms_sql(conflict: str) -> str:
    return f"""WITH {TRUTH}, {FOUND}, p AS (SELECT project, page, list({{'id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY -conf, box_id) AS bs FROM found GROUP BY project, page),
k AS (SELECT unnest(list_reduce(list_transform(bs, lambda z: [z]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: {conflict})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS b FROM p)
SELECT b.id AS box_id FROM k"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rank = F.struct((-F.col("conf")).alias("c"), "box_id").alias("rank")
    return found(spark, d).select(*PAGE, F.col("box_id").alias("id"), rank, "x1", "y1", "x2", "y2")


@query("nms_center", nms_sql("abs(a.x1 + a.x2 - x[1].x1 - x[1].x2) < 100 AND abs(a.y1 + a.y2 - x[1].y1 - x[1].y2) < 100"))
def nms_center(spark: SparkSession, d: str) -> DataFrame:
    """GEO-10, ORD-01: by falling confidence, drop what lies within 50 px of a kept box on both axes."""
    f = _ranked(spark, d).withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    return spatial.suppress_near(f, PAGE, 50.0).select(F.col("id").alias("box_id"))


NMS_IOU = "a.x1 < x[1].x2 AND x[1].x1 < a.x2 AND a.y1 < x[1].y2 AND x[1].y1 < a.y2 AND round(" + IOU.replace("b.", "x[1].") + ", 9) > 0.5"


@query("nms_iou", nms_sql(NMS_IOU))
def nms_iou(spark: SparkSession, d: str) -> DataFrame:
    """GEO-10: by falling confidence, drop what overlaps a kept box by more than half."""
    return spatial.suppress_overlaps(_ranked(spark, d), PAGE, 0.5).select(F.col("id").alias("box_id"))


@query("nearest_within", f"WITH {TRUTH}, {FOUND} SELECT l AS det_id, arg_min(r, {{'d': round(dist, 9), 'r': r}}) AS truth_id, round(min(dist), 6) AS dist FROM ({NEAR.replace('{2r}', '700')}) WHERE dist <= 350 GROUP BY l")
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-04/06/07: the nearest truth within 350 px, by a grid equi-join."""
    n = _near(spark, d, 350.0).withColumn("dist", F.round("dist", 9))
    return spatial.nearest(n, ["l"], F.col("r"), F.col("r")).select(F.col("l").alias("det_id"), F.col("nearest").alias("truth_id"), F.round("dist", 6).alias("dist"))


@query("penalised_nearest", f"WITH {TRUTH}, {FOUND} SELECT l AS det_id, arg_min(r, {{'s': round(dist - 80 * length(cls), 6), 'r': r}}) AS truth_id FROM (SELECT n.*, t.cls FROM ({NEAR.replace('{2r}', '700')}) n JOIN truth t ON t.box_id = n.r) WHERE dist <= 350 GROUP BY l")
def penalised_nearest(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-06: the least distance less 80 px per character of the text read."""
    n = _near(spark, d, 350.0).withColumn("dist", F.round(F.col("dist") - 80 * F.length("r_cls"), 6))
    return spatial.nearest(n, ["l"], F.col("r"), F.col("r")).select(F.col("l").alias("det_id"), F.col("nearest").alias("truth_id"))


@query("components", f"WITH RECURSIVE {TRUTH}, e AS (SELECT a.box_id AS a, b.box_id AS b FROM truth a JOIN truth b ON a.project = b.project AND a.page = b.page AND a.box_id <> b.box_id AND {OVER}), r AS (SELECT box_id AS node, box_id AS root FROM truth UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def components(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18: groups of overlapping boxes by hooking and shortcutting."""
    t = truth(spark, d).withColumnRenamed("box_id", "id")
    return hook_and_shortcut(t.select(F.col("id").alias("node")), spatial.overlap_edges(t, PAGE))


@query(
    "component_boxes",
    f"WITH RECURSIVE {TRUTH}, e AS (SELECT a.box_id AS a, b.box_id AS b FROM truth a JOIN truth b ON a.project = b.project AND a.page = b.page AND a.box_id <> b.box_id AND {OVER}), r AS (SELECT box_id AS node, box_id AS root FROM truth UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY node) SELECT component, count(*) AS boxes, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM c JOIN truth ON box_id = node GROUP BY component HAVING count(*) >= 2",
)
def component_boxes(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18: bounding boxes of groups of at least two boxes."""
    c = components(spark, d)
    return truth(spark, d).join(c, F.col("box_id") == F.col("node")).groupBy("component").agg(F.count("*").alias("boxes"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).where("boxes >= 2")


_ADJACENT = "ABS(b.{lo} - a.{hi}) < 24 OR ABS(b.{hi} - a.{lo}) < 24"
_ALONG = "least(a.{hi}, b.{hi}) - greatest(a.{lo}, b.{lo}) > 0.3 * least(a.{hi} - a.{lo}, b.{hi} - b.{lo})"


def _axis(t: str, axis: str) -> str:
    return "(" + t.format(lo=f"{axis}1", hi=f"{axis}2") + ")"


@query(
    "adjacent_components",
    f"""WITH RECURSIVE {TRUTH}, e AS (SELECT a.box_id AS a, b.box_id AS b FROM truth a JOIN truth b ON a.project = b.project AND a.page = b.page AND a.box_id <> b.box_id AND (({_axis(_ADJACENT, 'x')} AND {_axis(_ALONG, 'y')}) OR ({_axis(_ADJACENT, 'y')} AND {_axis(_ALONG, 'x')}))),
r AS (SELECT box_id AS node, box_id AS root FROM truth UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node""",
)
def adjacent_components(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-22, AGG-18: groups of cells that share a ruled edge."""
    t = truth(spark, d).withColumnRenamed("box_id", "id")
    return hook_and_shortcut(t.select(F.col("id").alias("node")), spatial.adjacent_cells(t, PAGE, 24.0))


TILE, OVERLAP, SIDE = 640, 100, 7200


@query(
    "tile_assign",
    f"""WITH {TRUTH}, s AS (SELECT DISTINCT least(t, {SIDE - TILE}) AS s FROM (SELECT unnest(generate_series(0, {SIDE - 1}, {TILE - OVERLAP})) AS t)),
c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM truth)
SELECT box_id, a.s AS tx, b.s AS ty, floor((least(greatest(x1 - a.s, 0), {TILE}) + least(greatest(x2 - a.s, 0), {TILE})) / 2 / {TILE} * 1e6 + 0.5) / 1e6 AS cx, floor((least(greatest(y1 - b.s, 0), {TILE}) + least(greatest(y2 - b.s, 0), {TILE})) / 2 / {TILE} * 1e6 + 0.5) / 1e6 AS cy
FROM c JOIN s a ON cx >= a.s AND cx < a.s + {TILE} JOIN s b ON cy >= b.s AND cy < b.s + {TILE}""",
)
def tile_assign(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-24, GEO-07/08: a box goes to every tile that holds its centre; tiles come from a sequence, not a join."""
    starts = G.tile_starts(F.lit(SIDE), TILE, OVERLAP)
    c = truth(spark, d).withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    hold = lambda v: F.filter(starts, lambda s: (F.col(v) >= s) & (F.col(v) < s + TILE))
    t = c.withColumn("tx", F.explode(hold("mx"))).withColumn("ty", F.explode(hold("my")))
    n = G.clip_normalise(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("tx"), F.col("ty"), TILE)
    return t.withColumn("n", n).select("box_id", F.col("tx").cast("bigint").alias("tx"), F.col("ty").cast("bigint").alias("ty"), G.share6(F.col("n.cx")).alias("cx"), G.share6(F.col("n.cy")).alias("cy"))


@query(
    "rotate_points",
    f"WITH {TRUTH}, p AS (SELECT box_id, x1, y1, (page % 4) * 90 AS r FROM truth) SELECT box_id, CASE r WHEN 90 THEN {SIDE} - y1 WHEN 180 THEN {SIDE} - x1 WHEN 270 THEN y1 ELSE x1 END AS x, CASE r WHEN 90 THEN x1 WHEN 180 THEN {SIDE} - y1 WHEN 270 THEN {SIDE} - x1 ELSE y1 END AS y FROM p",
)
def rotate_points(spark: SparkSession, d: str) -> DataFrame:
    """GEO-05: media-box points in display space, by page rotation."""
    r = (F.col("page") % 4) * 90
    return truth(spark, d).select("box_id", G.rotate_to_display(F.col("x1"), F.col("y1"), F.lit(float(SIDE)), F.lit(float(SIDE)), r).alias("p")).select("box_id", "p.x", "p.y")


@query("percent_boxes", f"WITH {TRUTH} SELECT box_id, round(x1 / {SIDE} * 100, 6) AS x, round(y1 / {SIDE} * 100, 6) AS y, round((x2 - x1) / {SIDE} * 100, 6) AS width, round((y2 - y1) / {SIDE} * 100, 6) AS height FROM truth")
def percent_boxes(spark: SparkSession, d: str) -> DataFrame:
    """GEO-09, CMP-14: boxes in percent of their image, as a review tool wants them."""
    b = truth(spark, d).select("box_id", G.percent_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(float(SIDE)), F.lit(float(SIDE))).alias("p"))
    return b.select("box_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


EDGES = list(range(0, SIDE + 1, 450))


@query("cell_grid", f"WITH {TRUTH} SELECT project, page, (floor(((y1 + y2) / 2) / 450))::BIGINT AS r, (floor(((x1 + x2) / 2) / 450))::BIGINT AS c, count(*) AS n FROM truth WHERE (x1 + x2) / 2 BETWEEN 0 AND {EDGES[-1] - 1e-6} AND (y1 + y2) / 2 BETWEEN 0 AND {EDGES[-1] - 1e-6} GROUP BY ALL")
def cell_grid(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-11: tokens into half-open bands on both axes, by expression instead of a range join."""
    edges = F.array(*[F.lit(float(e)) for e in EDGES])
    t = truth(spark, d).select("project", "page", maps.band_index(edges, (F.col("y1") + F.col("y2")) / 2).cast("bigint").alias("r"), maps.band_index(edges, (F.col("x1") + F.col("x2")) / 2).cast("bigint").alias("c"))
    return t.where("r is not null and c is not null").groupBy("project", "page", "r", "c").agg(F.count("*").alias("n"))


@query("top_pages", f"WITH {TRUTH}, n AS (SELECT project, page, count(*) AS n FROM truth GROUP BY ALL) SELECT project, page, n FROM n QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, page) <= 2")
def top_pages(spark: SparkSession, d: str) -> DataFrame:
    """ORD-04: the two fullest pages of every project (a top-k report)."""
    n = truth(spark, d).groupBy("project", "page").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "page"))).where("k <= 2").drop("k")


@query("rare_class_drop", f"WITH {TRUTH} SELECT cls, count(*) AS n FROM truth GROUP BY cls HAVING count(*) >= 30")
def rare_class_drop(spark: SparkSession, d: str) -> DataFrame:
    """FIL-21: classes with at least 30 examples."""
    return truth(spark, d).groupBy("cls").agg(F.count("*").alias("n")).where("n >= 30")


@query("class_order", f"WITH {TRUTH}, n AS (SELECT cls, count(*) AS n FROM truth GROUP BY cls) SELECT cls, n, row_number() OVER (ORDER BY CASE cls WHEN 'WALL LOUVER' THEN 0 WHEN 'DUCT SILENCER' THEN 1 ELSE 2 END, n DESC, cls) - 1 AS idx FROM n")
def class_order(spark: SparkSession, d: str) -> DataFrame:
    """AGG-24: known classes in their order, then by frequency (one row per class)."""
    n = truth(spark, d).groupBy("cls").agg(F.count("*").alias("n"))
    known = F.when(F.col("cls") == "WALL LOUVER", 0).when(F.col("cls") == "DUCT SILENCER", 1).otherwise(2)
    return n.withColumn("idx", (F.row_number().over(Window.orderBy(known, F.desc("n"), "cls")) - 1).cast("bigint"))


@query("confusion_matrix", f"WITH {TRUTH}, {FOUND}, c AS (SELECT f.cls AS predicted, t.cls AS actual, count(*) AS n FROM found f JOIN truth t USING (box_id) GROUP BY ALL) SELECT predicted, actual, n, sum(n) OVER (PARTITION BY predicted) AS predicted_total, sum(n) OVER (PARTITION BY actual) AS actual_total, round(n / sum(n) OVER (PARTITION BY actual), 6) AS share_of_actual FROM c")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05: predicted x actual with marginals."""
    from tallysheet.operators.aggregates import confusion_matrix as cm

    return cm(_labelled(spark, d), "predicted", "actual")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d).select(F.col("cls").alias("actual"), F.when(F.col("box_id") % 10 == 0, "FAN").otherwise(F.col("cls")).alias("predicted"))


@query(
    "class_scores",
    f"WITH {TRUTH}, {FOUND}, p AS (SELECT f.cls AS predicted, t.cls AS actual FROM found f JOIN truth t USING (box_id)), a AS (SELECT actual AS cls, count(*) AS truth, count(*) FILTER (predicted = actual) AS hits FROM p GROUP BY 1), b AS (SELECT predicted AS cls, count(*) AS predicted FROM p GROUP BY 1) SELECT a.cls, truth, coalesce(predicted, 0) AS predicted, hits, round(hits / truth, 6) AS recall, round(coalesce(hits / nullif(predicted, 0), 0), 6) AS precision FROM a LEFT JOIN b USING (cls)",
)
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05: recall and precision of classes that occur as truth."""
    from tallysheet.operators.aggregates import class_scores as cs

    return cs(_labelled(spark, d), "predicted", "actual")


@query("paired_confusion", f"WITH {TRUTH}, {FOUND} SELECT least(f.cls, t.cls) AS class_a, greatest(f.cls, t.cls) AS class_b, count(*) AS n FROM found f JOIN truth t USING (box_id) WHERE f.cls <> t.cls GROUP BY ALL HAVING count(*) >= 5")
def paired_confusion(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06: unordered pairs of confused classes."""
    from tallysheet.operators.aggregates import error_pairs

    return error_pairs(_labelled(spark, d), "predicted", "actual")


@query("summary_by_tag", f"WITH {TRUTH}, {FOUND} SELECT cls, page::VARCHAR AS tag, count(*) AS n, round(avg(conf), 6) AS mean_conf FROM found GROUP BY ALL")
def summary_by_tag(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01: count and mean confidence by class and tag."""
    from tallysheet.operators.aggregates import summary_by_tag as s

    return s(found(spark, d).withColumn("tag", F.col("page").cast("string")))


@query(
    "position_recall",
    f"""WITH {TRUTH}, {FOUND}, m AS ({fold_sql(f'SELECT * FROM ({NEAR.replace("{2r}", "160")}) WHERE round(dist, 9) < 80', 'l, r')}), k AS (SELECT m.l, m.r FROM m), j AS (SELECT t.project, t.box_id, f.cls = t.cls AS same, k.r IS NOT NULL AS hit FROM truth t LEFT JOIN k ON k.r = t.box_id LEFT JOIN found f ON f.box_id = k.l)
SELECT project, count(*) AS truth, count(*) FILTER (hit) AS placed, count(*) FILTER (hit AND same) AS full_hits, round(count(*) FILTER (hit) / greatest(count(*), 1), 6) AS position_recall, CASE WHEN count(*) FILTER (hit) / count(*) >= 0.8 THEN 'good' WHEN count(*) FILTER (hit) / count(*) >= 0.6 THEN 'fair' WHEN count(*) FILTER (hit) / count(*) >= 0.3 THEN 'weak' ELSE 'poor' END AS verdict FROM j GROUP BY project""",
)
def position_recall(spark: SparkSession, d: str) -> DataFrame:
    """AGG-08/09: recall by position and class per project, with its verdict."""
    from tallysheet.operators.aggregates import verdict

    m = first_fit_match(spark, d)
    # one shuffle by box serves both classes: equal rows share a box, so they are told apart where they are; boxes
    # without id, which match nothing, are kept out of it, as a filter on one side only would make it two shuffles
    b = _reviewed(spark, d)
    t = spread(b.where("box_id is not null"), "box_id").distinct()
    f = t.select(F.col("box_id").alias("det_id"), _relabelled().alias("f_cls"))
    j = t.select("project", F.col("box_id").alias("truth_id"), "cls").join(m.join(f, "det_id", "left"), "truth_id", "left")
    j = j.unionByName(b.where("box_id is null").distinct().select("project", "cls"), allowMissingColumns=True)
    g = j.groupBy("project").agg(F.count("*").alias("truth"), F.count("det_id").alias("placed"), F.count_if(F.col("f_cls") == F.col("cls")).alias("full_hits"))
    share = F.col("placed") / F.greatest("truth", F.lit(1))
    return g.withColumns({"position_recall": F.round(share, 6), "verdict": verdict(share)})
