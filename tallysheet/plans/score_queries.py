"""Queries of scores, rollups, ordered procedures and set operations, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions import dims
from tallysheet.functions import strings as S
from tallysheet.operators import aggregates as A
from tallysheet.operators import datasets
from tallysheet.operators import windows as W
from tallysheet.operators.resolution import class_expansion, class_resolution, fingerprint_index, fingerprint_scores, only_tag_per_class
from tallysheet.session import table

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


# ---- scores --------------------------------------------------------------------------------------

_ROWS = "SELECT l_suppkey AS project, CASE WHEN l_linestatus = 'O' THEN 'team' ELSE 'ours' END AS side, p_type AS product, p_brand AS tag, l_quantity::BIGINT AS qty FROM lineitem JOIN part ON p_partkey = l_partkey"


def takeoff_rows(spark: SparkSession, d: str) -> DataFrame:
    """Takeoff rows of two sides: project, side, product, tag, qty."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("project"), F.when(F.col("l_linestatus") == "O", "team").otherwise("ours").alias("side"), F.col("p_type").alias("product"), F.col("p_brand").alias("tag"), F.col("l_quantity").cast("bigint").alias("qty"))


def _score_sql(key: str) -> str:
    return f"""WITH r AS ({_ROWS}), k AS (SELECT project, {key}, sum(qty) FILTER (side = 'team') AS team, sum(qty) FILTER (side = 'ours') AS ours FROM r GROUP BY ALL)
SELECT project, coalesce(sum(team), 0) AS team_total, coalesce(sum(ours), 0) AS our_total, sum(least(coalesce(team, 0), coalesce(ours, 0))) AS matched,
CASE WHEN count(team) > 0 AND count(ours) > 0 THEN round(coalesce(sum(least(coalesce(team, 0), coalesce(ours, 0))) / nullif(sum(team), 0), 0), 6) END AS recall,
CASE WHEN count(team) > 0 AND count(ours) > 0 THEN round(coalesce(sum(least(coalesce(team, 0), coalesce(ours, 0))) / nullif(sum(ours), 0), 0), 6) END AS precision FROM k GROUP BY project"""


@query("overlap_score", _score_sql("product"))
def overlap_score(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-17, AGG-03/04, CMP-10: agreement of two takeoffs per project by product."""
    return A.overlap_score(takeoff_rows(spark, d), ["project"], ["product"], "side", "qty")


@query("overlap_score_by_tag", _score_sql("product, tag"))
def overlap_score_by_tag(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-17, AGG-03: the same by product and tag."""
    return A.overlap_score(takeoff_rows(spark, d), ["project"], ["product", "tag"], "side", "qty")


@query("per_product_delta", f"WITH r AS ({_ROWS}) SELECT project, product, coalesce(sum(qty) FILTER (side = 'team'), 0) AS team, coalesce(sum(qty) FILTER (side = 'ours'), 0) AS ours, coalesce(sum(qty) FILTER (side = 'ours'), 0) - coalesce(sum(qty) FILTER (side = 'team'), 0) AS delta FROM r GROUP BY ALL")
def per_product_delta(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-17, SET-01: quantities of both sides per product."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("qty"))), F.lit(0))
    return takeoff_rows(spark, d).groupBy("project", "product").agg(side("team").alias("team"), side("ours").alias("ours"), (side("ours") - side("team")).alias("delta"))


@query("quantity_sets", f"WITH r AS ({_ROWS}) SELECT project, product, tag, sum(qty) AS qty, grouping_id(product, tag) AS level FROM r GROUP BY GROUPING SETS ((project, product), (project, product, tag))")
def quantity_sets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03: both keys in one pass by grouping sets."""
    r = takeoff_rows(spark, d)
    return r.groupingSets([[F.col("project"), F.col("product")], [F.col("project"), F.col("product"), F.col("tag")]], "project", "product", "tag").agg(F.sum("qty").alias("qty"), F.grouping("tag").cast("bigint").alias("level"))


@query(
    "upper_median_summary",
    """WITH b AS (SELECT DISTINCT project, plan, run_at, lower(trim(status)) AS status, tagged_pct FROM batch_results WHERE tagged_pct IS NOT NULL AND status IS NOT NULL)
SELECT status, count(*) AS scored, round(avg(tagged_pct), 6) AS mean, max(tagged_pct) AS best, count(*) FILTER (tagged_pct >= 0.5) AS half_or_more, list_sort(list(tagged_pct))[count(*) // 2 + 1] AS upper_median FROM b GROUP BY status""",
)
def upper_median_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10: upper median, mean, best and threshold count per status."""
    b = table(spark, d, "batch_results").where("tagged_pct is not null and status is not null").select("project", "plan", "run_at", F.lower(F.trim("status")).alias("status"), "tagged_pct").distinct()
    return A.score_summary(b, "tagged_pct", ["status"])


_RUNS = "runs AS (SELECT DISTINCT project, plan, size_mb, lower(trim(status)) AS status, sched_tags, detections, tagged, tagged_pct, untag_no_cand, untag_unmatched, distinct_tags, xlsx, runtime_s, run_at FROM batch_results)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Batch runs once each (repeated rows differ in load time only), status folded."""
    cols = ["project", "plan", "size_mb", "sched_tags", "detections", "tagged", "tagged_pct", "untag_no_cand", "untag_unmatched", "distinct_tags", "xlsx", "runtime_s", "run_at"]
    return table(spark, d, "batch_results").select(*cols, F.lower(F.trim("status")).alias("status")).distinct()


@query("health_gate", f"WITH {_RUNS} SELECT CASE WHEN sched_tags = 0 THEN '0' WHEN sched_tags < 10 THEN '1-9' WHEN sched_tags >= 10 THEN '10+' END AS schedule_health, count(*) AS plans, sum(untag_no_cand) AS no_candidate, sum(untag_unmatched) AS unmatched FROM runs GROUP BY 1")
def health_gate(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26: untagged detections by schedule health."""
    return A.health_gate(runs(spark, d))


@query("batch_totals", f"WITH {_RUNS} SELECT status, count(*) AS plans, sum(detections) AS detections, sum(tagged) AS tagged, round_even(100.0 * sum(tagged) / nullif(sum(detections), 0), 1) AS tagged_pct, count(*) FILTER (xlsx) AS workbooks, round(sum(runtime_s), 3) AS runtime_s FROM runs GROUP BY status")
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13/14: totals per status, percentages rounded half to even."""
    pct = F.bround(F.try_divide(F.sum("tagged") * F.lit(100.0), F.sum("detections")), 1)
    return runs(spark, d).groupBy("status").agg(F.count("*").alias("plans"), F.sum("detections").alias("detections"), F.sum("tagged").alias("tagged"), pct.alias("tagged_pct"), F.count_if("xlsx").alias("workbooks"), F.round(F.sum("runtime_s"), 3).alias("runtime_s"))


_VARS = "vars AS (SELECT DISTINCT var_id, project, tag, schedule_name, page, inferred_yolo_class AS cls, source_row_index FROM tag_variables)"


def variables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tag_variables").select("var_id", "project", "tag", "schedule_name", "page", F.col("inferred_yolo_class").alias("cls"), "source_row_index").distinct()


@query(
    "takeoff_rollup",
    f"""WITH {_VARS}, b AS (SELECT project, cls, coalesce(nullif(tag, ''), '(no-tag)') AS tag, page, count(*) AS n FROM vars WHERE cls IS NOT NULL AND project IS NOT NULL AND page IS NOT NULL GROUP BY ALL)
SELECT project, cls, tag, sum(n) AS qty, array_to_string(list_sort(list_distinct(list(page + 1))), ',') AS pages, grouping_id(project, cls, tag) AS level FROM b GROUP BY GROUPING SETS ((project, cls, tag), (project, cls), (project))""",
)
def takeoff_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02, CMP-09, SNK-01: counts and pages by class and tag with totals."""
    v = variables(spark, d).where("cls is not null and project is not null and page is not null")
    return A.takeoff_rollup(v, ["project"])


@query("tag_diagnostics", f"WITH {_VARS} SELECT cls, count(*) AS total, count(*) FILTER (source_row_index >= 0) AS tagged, grouping_id(cls) AS level FROM vars GROUP BY ROLLUP (cls)")
def tag_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: tagged and all per class and in total."""
    return variables(spark, d).rollup("cls").agg(F.count("*").alias("total"), F.count_if(F.col("source_row_index") >= 0).alias("tagged"), F.grouping_id().alias("level"))


@query("detection_diagnostics")
def detection_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12 over all sidecar files, read into the base shape."""
    from tallysheet.operators.schema_drift import unified_detections

    return A.diagnostics(unified_detections(table(spark, d, "detections")), ["cls"])


@query("schedule_tag_counts", f"WITH {_VARS} SELECT project, count(*) AS variables, count(DISTINCT tag) AS distinct_tags FROM vars GROUP BY project")
def schedule_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-22: number of variables and of distinct tags; both are called schedule tags by some."""
    return variables(spark, d).groupBy("project").agg(F.count("*").alias("variables"), F.count_distinct("tag").alias("distinct_tags"))


# ---- ordered procedures --------------------------------------------------------------------------


@query("fill_down", f"WITH {_VARS} SELECT var_id, last_value(CASE WHEN trim(schedule_name) <> '' AND NOT contains(schedule_name, 'LOUVER') THEN schedule_name END IGNORE NULLS) OVER (PARTITION BY project ORDER BY var_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM vars WHERE project IS NOT NULL")
def fill_down(spark: SparkSession, d: str) -> DataFrame:
    """WIN-01: the last schedule name so far; skipped rows neither give nor reset it."""
    v = variables(spark, d).where("project is not null")
    return W.fill_down(v, ["project"], "var_id", F.col("schedule_name"), F.coalesce(F.contains("schedule_name", F.lit("LOUVER")), F.lit(False))).select("var_id", "filled")


@query("repeat_blank", f"WITH {_VARS} SELECT var_id, CASE WHEN lag(cls) OVER w IS NOT DISTINCT FROM cls AND row_number() OVER w > 1 THEN '' ELSE cls END AS shown FROM vars WHERE cls IS NOT NULL AND project IS NOT NULL WINDOW w AS (PARTITION BY project ORDER BY cls, var_id)")
def repeat_blank(spark: SparkSession, d: str) -> DataFrame:
    """WIN-02: a class only on its first row."""
    v = variables(spark, d).where("cls is not null and project is not null")
    return W.blank_repeats(v, ["project"], ["cls", "var_id"], "cls").select("var_id", "shown")


_TOK = "tok AS (SELECT DISTINCT box_id, project, page, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM ls_boxes WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL AND project IS NOT NULL AND page IS NOT NULL)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ls_boxes").where("x1 is not null and x2 is not null and y1 is not null and y2 is not null and project is not null and page is not null")
    return t.select("box_id", "project", "page", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy")).distinct()


@query(
    "line_islands",
    f"""WITH {_TOK}, f AS (SELECT *, coalesce(abs(cy - lag(cy) OVER w) > 22 OR cx - lag(cx) OVER w > 140, true)::INT AS b FROM tok WINDOW w AS (PARTITION BY project, page ORDER BY round_even(cy / 22, 0), cx, box_id)), g AS (SELECT *, sum(b) OVER (PARTITION BY project, page ORDER BY round_even(cy / 22, 0), cx, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS line FROM f)
SELECT project, page, line, count(*) AS tokens, round(min(cx), 4) AS x1, round(max(cx), 4) AS x2, round(avg(cy), 4) AS cy FROM g GROUP BY ALL""",
)
def line_islands(spark: SparkSession, d: str) -> DataFrame:
    """WIN-03, AGG-20: tokens to lines and the lines' extents."""
    g = W.line_islands(tokens(spark, d), ["project", "page"], "cx", "cy", "box_id")
    return g.groupBy("project", "page", "line").agg(F.count("*").alias("tokens"), F.round(F.min("cx"), 4).alias("x1"), F.round(F.max("cx"), 4).alias("x2"), F.round(F.avg("cy"), 4).alias("cy"))


@query(
    "edge_clusters",
    f"""WITH {_TOK}, v AS (SELECT project, page, floor(cx)::BIGINT AS v FROM tok), f AS (SELECT *, coalesce(v - lag(v) OVER (PARTITION BY project, page ORDER BY v) > 6, true)::INT AS b FROM v), g AS (SELECT *, sum(b) OVER (PARTITION BY project, page ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM f)
SELECT project, page, cluster, floor(sum(v) / count(*))::BIGINT AS edge, count(*) AS members FROM g GROUP BY ALL""",
)
def edge_clusters(spark: SparkSession, d: str) -> DataFrame:
    """WIN-04: edges chained within six pixels."""
    return W.edge_clusters(tokens(spark, d).select("project", "page", F.floor("cx").cast("bigint").alias("v")), ["project", "page"], "v", 6)


@query("page_runs", f"WITH {_TOK}, p AS (SELECT DISTINCT project, page FROM tok), g AS (SELECT *, page - row_number() OVER (PARTITION BY project ORDER BY page) AS g FROM p) SELECT project, min(page) AS first, max(page) AS last, ((min(page) + max(page)) // 2)::BIGINT AS centre FROM g GROUP BY project, g")
def page_runs(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05: runs of consecutive reviewed pages and their centres."""
    return W.runs(tokens(spark, d).select("project", "page").distinct(), ["project"], "page", F.lit(True))


@query("latest_valid", "SELECT project, plan, arg_max({'status': status, 'tagged': tagged}, {'a': run_at, 'b': loaded_at}) AS r, FROM batch_results WHERE run_at IS NOT NULL AND loaded_at IS NOT NULL AND project IS NOT NULL AND plan IS NOT NULL AND lower(trim(status)) <> 'crashed' GROUP BY project, plan".replace(" AS r,", " AS r").replace("SELECT project", "SELECT project, plan, r.status AS status, r.tagged AS tagged FROM (SELECT project", 1) + ")")
def latest_valid(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06/07: the latest run that did not crash, by partial aggregation instead of a window."""
    b = table(spark, d, "batch_results").where("run_at is not null and loaded_at is not null and project is not null and plan is not null").select("project", "plan", "status", "tagged", "run_at", "loaded_at")
    return W.latest(b, ["project", "plan"], "run_at", "loaded_at", F.lower(F.trim("status")) != "crashed").select("project", "plan", "status", "tagged")


@query(
    "header_ngrams",
    """WITH h AS (SELECT DISTINCT table_id, header FROM schedule_tables WHERE header IS NOT NULL), t AS (SELECT table_id, unnest(header) AS w, generate_subscripts(header, 1) - 1 AS i FROM h), g AS (SELECT table_id, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM t WINDOW o AS (PARTITION BY table_id ORDER BY i))
SELECT gram, n, count(*) AS hits FROM (SELECT w AS gram, 1 AS n FROM g UNION ALL SELECT w || w1, 2 FROM g UNION ALL SELECT w || w1 || w2, 3 FROM g) WHERE gram IS NOT NULL GROUP BY ALL""",
)
def header_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """WIN-08: one to three running tokens joined."""
    t = table(spark, d, "schedule_tables").where("header is not null").select("table_id", "header").distinct().select("table_id", F.posexplode("header").alias("i", "w"))
    return W.ngrams(t, ["table_id"], "i", "w").groupBy("gram", "n").agg(F.count("*").alias("hits"))


@query("budget_cut", f"WITH {_RUNS}, s AS (SELECT project, plan, run_at, size_mb, sum(runtime_s) OVER (PARTITION BY project ORDER BY size_mb, plan, run_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM runs WHERE size_mb IS NOT NULL AND runtime_s IS NOT NULL AND project IS NOT NULL) SELECT project, plan, run_at, round(spent, 4) AS spent FROM s WHERE spent <= 1200")
def budget_cut(spark: SparkSession, d: str) -> DataFrame:
    """WIN-10, ORD-06: smallest plans first while the running time stays within a budget."""
    r = runs(spark, d).where("size_mb is not null and runtime_s is not null and project is not null")
    return W.budget_cut(r, ["project"], ["size_mb", "plan", "run_at"], "runtime_s", 1200.0).select("project", "plan", "run_at", F.round("spent", 4).alias("spent"))


@query("tag_reserve", f"WITH {_RUNS} SELECT project, plan, run_at, least(coalesce(sum(detections) OVER (PARTITION BY project ORDER BY run_at, plan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1.0, 270.0)::DOUBLE AS reserve FROM runs WHERE project IS NOT NULL AND run_at IS NOT NULL")
def tag_reserve(spark: SparkSession, d: str) -> DataFrame:
    """WIN-11: time to keep back for the detections found so far."""
    r = runs(spark, d).where("project is not null and run_at is not null")
    return W.reserve(r, ["project"], ["run_at", "plan"], "detections", 540.0).select("project", "plan", "run_at", F.col("reserve").cast("double").alias("reserve"))


# ---- order, picks and sets -----------------------------------------------------------------------


@query("leaderboard", f"WITH {_RUNS} SELECT project, sum(tagged) AS tagged, sum(detections) AS detections FROM runs WHERE project IS NOT NULL GROUP BY project ORDER BY tagged DESC, project LIMIT 10")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """ORD-03: the ten best projects (a top-k report)."""
    return runs(spark, d).where("project is not null").groupBy("project").agg(F.sum("tagged").alias("tagged"), F.sum("detections").alias("detections")).orderBy(F.desc("tagged"), "project").limit(10)


@query("arg_max_pick", f"WITH {_RUNS} SELECT project, arg_max(plan, {{'k': contains(upper(plan), 'HVAC')::INT, 's': size_mb, 'p': plan}}) AS plan FROM runs WHERE size_mb IS NOT NULL AND plan IS NOT NULL AND project IS NOT NULL GROUP BY project")
def arg_max_pick(spark: SparkSession, d: str) -> DataFrame:
    """ORD-05, FIL-16: per project the plan with a keyword, else the largest."""
    r = runs(spark, d).where("size_mb is not null and plan is not null and project is not null")
    return r.groupBy("project").agg(F.max_by("plan", F.struct(F.contains(F.upper("plan"), F.lit("HVAC")).cast("int"), "size_mb", "plan")).alias("plan"))


@query("resume_antijoin", "SELECT DISTINCT project FROM ls_boxes WHERE project IS NOT NULL AND project NOT IN (SELECT project FROM batch_results WHERE project IS NOT NULL AND lower(trim(status)) = 'ok')")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-13, SRC-19: projects still to do."""
    done = table(spark, d, "batch_results").where(F.lower(F.trim("status")) == "ok").select("project").distinct()
    return table(spark, d, "ls_boxes").where("project is not null").select("project").distinct().join(done, "project", "left_anti")


_MARKS = "SELECT DISTINCT project, upper(tag) AS tag FROM tag_variables WHERE tag IS NOT NULL AND project IS NOT NULL"
_CELLS = "SELECT DISTINCT project, upper(e.value) AS tag FROM (SELECT project, unnest(map_entries(r)) AS e FROM (SELECT project, unnest(rows) AS r FROM schedule_tables)) WHERE e.key IN ('MARK', 'TAG', 'SYMBOL', 'UNIT NO.') AND e.value IS NOT NULL AND project IS NOT NULL"


@query("tag_set_diff", f"WITH v AS ({_MARKS}), c AS ({_CELLS}) SELECT project, tag, CASE WHEN v.tag IS NULL THEN 'schedule only' WHEN c.tag IS NULL THEN 'variable only' ELSE 'both' END AS side FROM v FULL JOIN c USING (project, tag)".replace("v.tag IS NULL", "v.tag IS NULL"))
def tag_set_diff(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-18, SET-02: tags of variables and of schedule cells compared as sets, in one aggregation."""
    v = table(spark, d, "tag_variables").where("tag is not null and project is not null").select("project", F.upper("tag").alias("tag"), F.lit(1).alias("v"), F.lit(0).alias("c"))
    rows = table(spark, d, "schedule_tables").where("project is not null").select("project", F.explode("rows").alias("r")).select("project", F.explode("r").alias("key", "value"))
    c = rows.where(F.col("key").isin("MARK", "TAG", "SYMBOL", "UNIT NO.") & F.col("value").isNotNull()).select("project", F.upper("value").alias("tag"), F.lit(0).alias("v"), F.lit(1).alias("c"))
    g = v.unionByName(c).groupBy("project", "tag").agg(F.max("v").alias("v"), F.max("c").alias("c"))
    return g.select("project", "tag", F.when(F.col("v") == 0, "schedule only").when(F.col("c") == 0, "variable only").otherwise("both").alias("side"))


@query("first_and_last_wins", f"WITH {_VARS} SELECT project, tag, arg_min(schedule_name, var_id) AS first_schedule, arg_max(page, var_id) AS last_page FROM vars WHERE project IS NOT NULL AND tag IS NOT NULL AND schedule_name IS NOT NULL AND page IS NOT NULL GROUP BY project, tag")
def first_and_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06, D8, D9: first and last occurrence of a tag."""
    v = variables(spark, d).where("project is not null and tag is not null and schedule_name is not null and page is not null")
    return v.groupBy("project", "tag").agg(F.min_by("schedule_name", "var_id").alias("first_schedule"), F.max_by("page", "var_id").alias("last_page"))


@query("most_properties", "WITH t AS (SELECT DISTINCT var_id, project, page, tag, cardinality(properties) AS n FROM tag_variables WHERE properties IS NOT NULL AND tag IS NOT NULL AND project IS NOT NULL AND page IS NOT NULL) SELECT project, page, tag, arg_max(var_id, {'n': n, 'o': -var_id}) AS var_id FROM t GROUP BY project, page, tag")
def most_properties(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17: of one tag on a page the row with most properties, the first of equals."""
    t = table(spark, d, "tag_variables").where("properties is not null and tag is not null and project is not null and page is not null")
    return t.groupBy("project", "page", "tag").agg(F.max_by("var_id", F.struct(F.size("properties"), -F.col("var_id"))).alias("var_id"))


@query("group_split", "WITH p AS (SELECT DISTINCT project FROM ls_boxes WHERE project IS NOT NULL), r AS (SELECT project, row_number() OVER (ORDER BY md5(project || ':42'), project) AS r, greatest(1, floor(count(*) OVER () * 0.1)) AS v FROM p) SELECT project, CASE WHEN r <= v THEN 'val' ELSE 'train' END AS split FROM r")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """ORD-10/11: whole projects to validation by a seeded hash order, at least one.

    The cut is found by counts of hash buckets, not by one sorted window.
    """
    p = table(spark, d, "ls_boxes").where("project is not null").select("project")
    return datasets.holdout(p)


# ---- class resolution and fingerprints ------------------------------------------------------------

_HAS = f"{_VARS}, has AS (SELECT DISTINCT cls FROM (SELECT coalesce(v, t.k) AS cls FROM (SELECT regexp_extract(upper(tag), '^([A-Z]+)', 1) AS k FROM vars WHERE tag IS NOT NULL) t JOIN (SELECT * FROM {dims.sql_values(dims.TAG_PREFIX)}) d ON d.k = t.k))"
_ALIAS = "alias(k, a, n) AS (VALUES " + ", ".join(f"('{k}', '{a}', {len(v)})" for k, v in dims.DETECTOR_ALIAS.items() for a in v) + ")"
_FAM = "fam(f, c) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, f in enumerate(dims.CLASS_FAMILIES) for c in f) + ")"
_ALL = "allc AS (SELECT k AS cls FROM alias UNION SELECT c FROM fam UNION SELECT cls FROM has)"


def classes_with_tags(spark: SparkSession, d: str) -> DataFrame:
    """Classes that schedule tags are filed under, by tag prefix."""
    m = dims.literal_map(dims.TAG_PREFIX)
    return table(spark, d, "tag_variables").where("tag is not null").select(F.try_element_at(m, F.regexp_extract(F.upper("tag"), "^([A-Z]+)", 1)).alias("cls")).where("cls is not null").distinct()


@query(
    "class_resolution",
    f"""WITH {_HAS}, {_ALIAS}, {_FAM}, {_ALL}, one AS (SELECT m.c AS cls, min(s.c) AS s, count(*) AS n FROM fam m JOIN fam s ON s.f = m.f JOIN has h ON h.cls = s.c GROUP BY m.c)
SELECT a.cls, CASE WHEN a.cls IN (SELECT cls FROM has) THEN a.cls WHEN a.cls IN (SELECT k FROM alias WHERE n > 1) THEN NULL WHEN x.a IN (SELECT cls FROM has) THEN x.a WHEN one.n = 1 THEN one.s END AS resolved FROM allc a LEFT JOIN alias x ON x.k = a.cls AND x.n = 1 LEFT JOIN one ON one.cls = a.cls""",
)
def class_resolution_query(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-02: direct, else alias, else the only sibling with tags; a list of aliases is ambiguous."""
    return class_resolution(classes_with_tags(spark, d))


@query(
    "class_expansion",
    f"""WITH {_HAS}, {_ALIAS}, {_FAM}, {_ALL}, e AS (SELECT cls, cls AS candidate FROM allc UNION SELECT k, a FROM alias UNION SELECT m.c, s.c FROM fam m JOIN fam s ON s.f = m.f) SELECT e.cls, candidate FROM e JOIN has h ON h.cls = candidate""",
)
def class_expansion_query(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-03: direct, aliases and family siblings that have tags."""
    return class_expansion(classes_with_tags(spark, d)).select("cls", "candidate").distinct()


@query("direct_map", f"WITH {_VARS} SELECT project, cls, min(tag) AS tag FROM vars WHERE project IS NOT NULL AND cls IS NOT NULL AND tag IS NOT NULL GROUP BY project, cls HAVING count(DISTINCT tag) = 1")
def direct_map(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-01: classes with exactly one tag in a project."""
    return only_tag_per_class(variables(spark, d))


_FP = r"fp AS (SELECT DISTINCT project, tag, tok FROM (SELECT project, tag, unnest(regexp_split_to_array(trim(regexp_replace(regexp_replace(upper(v), '[\"'']', '', 'g'), '[\s\x{00A0}]+', ' ', 'g')), '[\s/,]+')) AS tok FROM (SELECT project, tag, unnest(map_values(properties)) AS v FROM tag_variables WHERE tag IS NOT NULL AND project IS NOT NULL)) WHERE length(tok) >= 2 AND regexp_matches(tok, '[0-9]'))"


@query("fingerprint_index", f"WITH {_FP}, k AS (SELECT project, tok FROM fp GROUP BY project, tok HAVING count(*) <= 2) SELECT project, tag, tok FROM fp JOIN k USING (project, tok)")
def fingerprint_index_query(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15, FIL-17: tokens with a digit that occur on at most two tags."""
    return fingerprint_index(table(spark, d, "tag_variables"))


_DOC = r"docs AS (SELECT DISTINCT doc_id, project, tok FROM (SELECT doc_id, project, unnest(regexp_split_to_array(upper(text), '[\s/,]+')) AS tok FROM documents WHERE project IS NOT NULL AND text IS NOT NULL) WHERE length(tok) >= 2 AND regexp_matches(tok, '[0-9]'))"


@query("fingerprint_scores", f"WITH {_FP}, {_DOC}, k AS (SELECT project, tok FROM fp GROUP BY project, tok HAVING count(*) <= 2), i AS (SELECT project, tag, tok FROM fp JOIN k USING (project, tok)) SELECT doc_id, tag, count(*) AS score FROM docs JOIN i USING (project, tok) GROUP BY ALL")
def fingerprint_scores_query(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-05: shared tokens of whole texts and tags of a project, by an equi-join on tokens."""
    docs = table(spark, d, "documents").where("project is not null and text is not null").select("doc_id", "project", F.upper("text").alias("text"))
    return fingerprint_scores(docs, "doc_id", "text", fingerprint_index(table(spark, d, "tag_variables")))


@query("project_union", "SELECT project FROM ls_boxes WHERE project IS NOT NULL UNION SELECT project FROM batch_results WHERE project IS NOT NULL UNION SELECT project FROM documents WHERE project IS NOT NULL")
def project_union(spark: SparkSession, d: str) -> DataFrame:
    """SET-01/06/07: names of all tables, once."""
    parts = [table(spark, d, t).where("project is not null").select("project").distinct() for t in ("ls_boxes", "batch_results", "documents")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("variables_not_in_schedules", f"WITH {_VARS}, o AS (SELECT * FROM vars WHERE source_row_index < 0), t AS (SELECT DISTINCT project, tag FROM vars WHERE source_row_index >= 0) SELECT o.project, o.tag, min(o.var_id) AS var_id FROM o LEFT JOIN t ON t.project = o.project AND t.tag = o.tag WHERE t.tag IS NULL AND o.tag IS NOT NULL AND o.project IS NOT NULL GROUP BY ALL")
def variables_not_in_schedules(spark: SparkSession, d: str) -> DataFrame:
    """SET-03: tag-only variables whose tag no schedule row has, once each."""
    v = variables(spark, d).where("tag is not null and project is not null")
    text = v.where("source_row_index >= 0").select("project", "tag").distinct()
    return v.where("source_row_index < 0").join(text, ["project", "tag"], "left_anti").groupBy("project", "tag").agg(F.min("var_id").alias("var_id"))


@query("reason_histogram", f"WITH {_RUNS}, n AS (SELECT status, count(*) AS n FROM runs GROUP BY status) SELECT status, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM n")
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16/29: histogram with percent of the total."""
    n = runs(spark, d).groupBy("status").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.join(F.broadcast(total)).select("status", "n", F.round(F.col("n") * 100.0 / F.col("t"), 6).alias("pct"))  # total is one row


@query("best_run", f"WITH {_RUNS} SELECT status, arg_max(plan, {{'t': tagged_pct, 'p': plan}}) AS plan, max(tagged_pct) AS tagged_pct FROM runs WHERE tagged_pct IS NOT NULL AND plan IS NOT NULL GROUP BY status")
def best_run(spark: SparkSession, d: str) -> DataFrame:
    """AGG-30: the row of the greatest score."""
    return runs(spark, d).where("tagged_pct is not null and plan is not null").groupBy("status").agg(F.max_by("plan", F.struct("tagged_pct", "plan")).alias("plan"), F.max("tagged_pct").alias("tagged_pct"))


@query("cross_version", f"WITH {_RUNS}, p AS (SELECT project, sum(tagged) FILTER (run_at < TIMESTAMPTZ '2026-07-01 00:00:00+00') AS before, sum(tagged) FILTER (run_at >= TIMESTAMPTZ '2026-07-01 00:00:00+00') AS after FROM runs WHERE project IS NOT NULL GROUP BY project) SELECT project, before, after, CASE WHEN after > before THEN 'rose' WHEN after < before THEN 'fell' ELSE 'same' END AS moved FROM p WHERE before IS NOT NULL AND after IS NOT NULL")
def cross_version(spark: SparkSession, d: str) -> DataFrame:
    """AGG-25, JOIN-20: two batches of the same projects compared in one pass."""
    cut = F.expr("TIMESTAMP '2026-07-01 00:00:00+00:00'")
    p = runs(spark, d).where("project is not null").groupBy("project").agg(F.sum(F.when(F.col("run_at") < cut, F.col("tagged"))).alias("before"), F.sum(F.when(F.col("run_at") >= cut, F.col("tagged"))).alias("after"))
    return p.where("before is not null and after is not null").withColumn("moved", F.when(F.col("after") > F.col("before"), "rose").when(F.col("after") < F.col("before"), "fell").otherwise("same"))


@query("strict_tags")
def strict_tags(spark: SparkSession, d: str) -> DataFrame:
    """STR-08/27/29: tags held to the stricter rule for OCR rows, with their class."""
    t = table(spark, d, "tag_variables").where("tag is not null").select("var_id", "tag", "schedule_name").distinct()
    return t.select("var_id", S.strict_tag(F.col("tag")).alias("tag"), "schedule_name").where("tag is not null").withColumn("class", S.resolved_class(F.col("tag"), F.col("schedule_name"))).drop("schedule_name")




@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly totals per event type; the streaming form is ``streaming.ingest.running_totals``."""
    e = table(spark, d, "events").where("ts is not null")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
