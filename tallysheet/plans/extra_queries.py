"""Queries of page filters, OCR matching, picks and dataset operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions import dims
from tallysheet.functions import geometry as G
from tallysheet.operators import datasets, filters, ocr
from tallysheet.operators import aggregates as A
from tallysheet.plans.box_queries import FOUND, TRUTH, _labelled, truth
from tallysheet.plans.text_queries import normal_tag_sql
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


_WORDS = " OR ".join(f"contains(upper(tok), '{w}')" for w in dims.SCHEDULE_PAGE_WORDS)


@query("ocr_page_gate", rf"SELECT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS tok FROM documents WHERE text IS NOT NULL) WHERE {_WORDS} GROUP BY doc_id HAVING count(*) >= 2")
def ocr_page_gate(spark: SparkSession, d: str) -> DataFrame:
    """FIL-10: texts with at least two schedule-looking tokens."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", r"\s+")).alias("text"))
    return filters.ocr_page_gate(t, ["doc_id"])


@query("near_empty_pages", r"SELECT source, doc_id FROM documents WHERE source IS NOT NULL AND length(regexp_replace(coalesce(text, ''), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) < 400 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 8")
def near_empty_pages(spark: SparkSession, d: str) -> DataFrame:
    """FIL-11, ORD-09: the first eight short texts of every source (a top-k report)."""
    return filters.near_empty_pages(table(spark, d, "documents").where("source is not null").select("source", "doc_id", "text"), ["source"], "doc_id", least=400).select("source", "doc_id")


@query("first_pages_text", "SELECT project, page, array_to_string(list(schedule_name ORDER BY table_id), chr(10)) AS text FROM (SELECT DISTINCT project, page, table_id, schedule_name FROM schedule_tables WHERE project IS NOT NULL AND page < 4 AND table_id IS NOT NULL AND schedule_name IS NOT NULL) GROUP BY project, page")
def first_pages_text(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03: texts of a project's first pages, joined in order."""
    t = table(spark, d, "schedule_tables").where("project is not null and page < 4 and table_id is not null and schedule_name is not null").select("project", "page", "table_id", F.col("schedule_name").alias("text")).distinct()
    return filters.first_pages_text(t, ["project", "page"], "table_id", first=2**31 - 1)


@query(
    "title_lines",
    f"WITH {TRUTH}, m AS (SELECT project, page, list_sort(list(y2 - y1))[count(*) // 2 + 1] AS mid FROM truth GROUP BY ALL) SELECT box_id FROM truth JOIN m USING (project, page) WHERE regexp_matches(cls, '(?i)\\bDIFFUSER\\b') AND y2 - y1 >= 1.15 * mid",
)
def title_lines(spark: SparkSession, d: str) -> DataFrame:
    """FIL-19, AGG-10: lines with a word, clearly higher than the page's median."""
    lines = truth(spark, d).select("project", "page", "box_id", F.col("cls").alias("text"), (F.col("y2") - F.col("y1")).alias("h"))
    return filters.title_lines(lines, ["project", "page"], r"(?i)\bDIFFUSER\b").select("box_id")


@query("sized_cells", f"WITH {TRUTH} SELECT box_id FROM truth WHERE x2 - x1 BETWEEN 12 AND 150 AND y2 - y1 BETWEEN 8 AND 60")
def sized_cells(spark: SparkSession, d: str) -> DataFrame:
    """FIL-20: boxes of plausible size."""
    return filters.sized_cells(truth(spark, d), (12.0, 150.0), (8.0, 60.0)).select("box_id")


@query("centre_inside", f"WITH {TRUTH} SELECT box_id FROM truth WHERE (x1 + x2) / 2 >= 0 AND (x1 + x2) / 2 < 4000 AND (y1 + y2) / 2 >= 0 AND (y1 + y2) / 2 < 3000")
def centre_inside(spark: SparkSession, d: str) -> DataFrame:
    """FIL-23: boxes whose centre lies on the sheet."""
    return filters.centre_inside(truth(spark, d), 4000.0, 3000.0).select("box_id")


@query("without_prefixes", "SELECT DISTINCT var_id, tag FROM tag_variables WHERE tag IS NOT NULL AND NOT coalesce(upper(CASE WHEN regexp_extract(tag, '^([A-Za-z]+)', 1) <> '' THEN regexp_extract(tag, '^([A-Za-z]+)', 1) ELSE split_part(tag, '-', 1) END) IN ('RG', 'CD'), false)")
def without_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """FIL-18: tags without excluded prefixes."""
    return filters.without_prefixes(table(spark, d, "tag_variables").where("tag is not null").select("var_id", "tag").distinct(), ["RG", "CD"])


@query(
    "over_predicted",
    f"WITH {TRUTH}, {FOUND}, p AS (SELECT f.cls AS predicted, t.cls AS actual FROM found f JOIN truth t USING (box_id)), a AS (SELECT actual AS cls, count(*) AS truth, count(*) FILTER (predicted = actual) AS hits FROM p GROUP BY 1), s AS (SELECT cls, truth, round(hits / truth, 6) AS recall FROM a) SELECT cls, truth, recall FROM (SELECT * FROM s ORDER BY recall, cls LIMIT 5) WHERE recall < 0.95 AND truth > 5",
)
def over_predicted(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07: the five worst classes, then the bound (a top-k report)."""
    s = A.class_scores(_labelled(spark, d), "predicted", "actual")
    return filters.extremes(s, "recall", "truth", below=0.95).select("cls", "truth", "recall")


@query("most_common", f"WITH {TRUTH} SELECT cls, count(*) AS n FROM truth GROUP BY cls ORDER BY n DESC, cls LIMIT 15")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    """ORD-07, AGG-16/23: the fifteen most common classes (a top-k report)."""
    return filters.most_common(truth(spark, d), "cls", 15)


@query("running_index", "WITH v AS (SELECT DISTINCT project, table_id FROM schedule_tables WHERE project IS NOT NULL) SELECT project, table_id, row_number() OVER (PARTITION BY project ORDER BY table_id) - 1 AS idx FROM v")
def running_index(spark: SparkSession, d: str) -> DataFrame:
    """WIN-09: a running number per project."""
    t = table(spark, d, "schedule_tables").where("project is not null").select("project", "table_id").distinct()
    return filters.running_index(t, ["project"], ["table_id"]).withColumn("idx", F.col("idx").cast("bigint"))


@query("files_to_stage", "WITH a AS (SELECT DISTINCT plan AS name, size_mb AS size_bytes FROM batch_results WHERE plan IS NOT NULL AND size_mb IS NOT NULL), b AS (SELECT DISTINCT plan AS name, size_mb AS size_bytes FROM batch_results WHERE xlsx AND plan IS NOT NULL AND size_mb IS NOT NULL) SELECT name, size_bytes FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.name = a.name AND b.size_bytes = a.size_bytes)")
def files_to_stage(spark: SparkSession, d: str) -> DataFrame:
    """SNK-13: plans without a workbook of the same name and size."""
    a = table(spark, d, "batch_results").where("plan is not null and size_mb is not null").select(F.col("plan").alias("name"), F.col("size_mb").alias("size_bytes"), "xlsx")
    return filters.to_stage(a.select("name", "size_bytes").distinct(), a.where("xlsx"))


@query("labelled_to_raw", "WITH l AS (SELECT DISTINCT project, plan AS file, sched_tags AS pages FROM batch_results WHERE project IS NOT NULL AND plan IS NOT NULL AND xlsx), r AS (SELECT DISTINCT project, plan AS raw_file, sched_tags AS raw_pages FROM batch_results WHERE project IS NOT NULL AND plan IS NOT NULL AND NOT xlsx) SELECT l.project, l.file, arg_min(raw_file, {'a': coalesce(pages <> raw_pages, true)::INT, 'b': raw_file}) AS raw_file FROM l LEFT JOIN r ON r.project = l.project GROUP BY ALL")
def labelled_to_raw(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-25: the file with equal page count, else the first."""
    b = table(spark, d, "batch_results").where("project is not null and plan is not null")
    left = b.where("xlsx").select("project", F.col("plan").alias("file"), F.col("sched_tags").alias("pages")).distinct()
    return filters.labelled_to_raw(left, b.where("not xlsx").select("project", F.col("plan").alias("raw_file"), F.col("sched_tags").alias("raw_pages")).distinct())


_SCHED = "SELECT DISTINCT project, table_id * 1000 + i AS word_id, e.value AS text FROM (SELECT project, table_id, i, unnest(map_entries(rows[i])) AS e FROM schedule_tables, unnest(generate_series(1, len(rows))) AS g(i)) WHERE e.key IN ('MARK', 'TAG', 'SYMBOL', 'UNIT NO.') AND project IS NOT NULL AND e.value IS NOT NULL"


@query(
    "word_to_tag",
    f"""WITH w AS ({_SCHED}), t AS (SELECT project, regexp_replace(upper(tag), '[^A-Z0-9]', '', 'g') AS fold, arg_max(tag, var_id) AS tag FROM (SELECT DISTINCT project, tag, var_id FROM tag_variables WHERE project IS NOT NULL AND tag IS NOT NULL) GROUP BY ALL),
p AS (SELECT project, word_id, list_concat([regexp_replace(upper(text), '[^A-Z0-9]', '', 'g')], list_filter(regexp_split_to_array(upper(text), '[^A-Z0-9]+'), lambda x: x <> '')) AS ps FROM w), e AS (SELECT project, word_id, i, ps[i] AS fold FROM p, unnest(generate_series(1, len(ps))) AS g(i) WHERE ps[i] <> '')
SELECT project, word_id, arg_min(tag, i) AS tag FROM e JOIN t USING (project, fold) GROUP BY ALL""",
)
def word_to_tag(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-08: words to tags by the whole fold, else by their first part."""
    rows = table(spark, d, "schedule_tables").where("project is not null").select("project", "table_id", F.posexplode("rows").alias("i", "r")).select("project", "table_id", "i", F.explode("r").alias("key", "text"))
    words = rows.where(F.col("key").isin("MARK", "TAG", "SYMBOL", "UNIT NO.") & F.col("text").isNotNull()).select("project", (F.col("table_id") * 1000 + F.col("i") + 1).alias("word_id"), "text").distinct()
    tags = table(spark, d, "tag_variables").where("project is not null and tag is not null").select("project", "tag", F.col("var_id").alias("ord")).distinct()
    return ocr.word_to_tag(words, tags, ["project"])


_BARE = ["A", "B", "C", "D", "CD", "RG", "SG", "EG", "TG", "LD"]
_HARVEST = normal_tag_sql(r"SELECT DISTINCT project AS id, tok AS raw FROM (SELECT project, unnest(regexp_split_to_array(text, '[\s,;]+')) AS tok FROM documents WHERE project IS NOT NULL AND text IS NOT NULL)")


@query(
    "tag_harvest",
    f"""SELECT DISTINCT id AS project, tag, coalesce(a.v, b.v, c.v, e.v) AS cls, -1 AS source_row_index FROM ({_HARVEST}) n LEFT JOIN (SELECT * FROM {dims.sql_values(dims.TAG_PREFIX)}) a ON a.k = tag[1:4] LEFT JOIN (SELECT * FROM {dims.sql_values(dims.TAG_PREFIX)}) b ON b.k = tag[1:3] LEFT JOIN (SELECT * FROM {dims.sql_values(dims.TAG_PREFIX)}) c ON c.k = tag[1:2] LEFT JOIN (SELECT * FROM {dims.sql_values(dims.TAG_PREFIX)}) e ON e.k = tag[1:1]
WHERE tag IS NOT NULL AND (list_contains({dims.sql_list(list(dims.TAG_PREFIX))}, regexp_extract(tag, '^([A-Z]+)', 1)) OR list_contains({dims.sql_list(_BARE)}, regexp_extract(tag, '^([A-Z]+)', 1))) AND (regexp_matches(tag, '[0-9]') OR list_contains({dims.sql_list(_BARE)}, tag))""",
)
def tag_harvest(spark: SparkSession, d: str) -> DataFrame:
    """CMP-04, STR-08/27: strict tags of whole texts, tag only."""
    t = table(spark, d, "documents").where("project is not null and text is not null").select("project", F.explode(F.split("text", r"[\s,;]+")).alias("text")).distinct()
    return ocr.harvest_tags(t, ["project"])


@query("ocr_table_rows")
def ocr_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """CMP-03, JOIN-11, AGG-17/27, STR-12/22/29: schedule tables laid out as tokens and read back."""
    t = table(spark, d, "schedule_tables").where("table_id is not null and header is not null and project is not null").select("table_id", "project", "page", "header", "rows").dropDuplicates(["table_id"])
    line = lambda r: F.transform("header", lambda h: F.try_element_at(r, h))
    lines = t.select("table_id", "project", "page", F.posexplode(F.concat(F.array("header"), F.transform(F.filter(F.coalesce("rows", F.array()), lambda r: r.isNotNull()), line))).alias("r", "cells"))
    cells = lines.select("project", "page", "table_id", "r", F.posexplode("cells").alias("c", "value")).where("value is not null")
    return ocr.table_variables(cells, ["project", "page"]).select("project", "page", "tag", "cls", F.to_json("properties").alias("properties"))


_STARTS = "SELECT DISTINCT greatest(least(t, {side} - 640), 0) AS s FROM (SELECT unnest(generate_series(0, {side} - 1, 480)) AS t)"


@query(
    "empty_tiles",
    f"""WITH {TRUTH}, sx AS ({_STARTS.format(side=7200)}), sy AS ({_STARTS.format(side=5400)}), t AS (SELECT project, page, sx.s AS tx, sy.s AS ty FROM (SELECT DISTINCT project, page FROM truth) p, sx, sy),
boxed AS (SELECT DISTINCT project, page, sx.s AS tx, sy.s AS ty FROM truth JOIN sx ON (x1 + x2) / 2 >= sx.s AND (x1 + x2) / 2 < sx.s + 640 JOIN sy ON (y1 + y2) / 2 >= sy.s AND (y1 + y2) / 2 < sy.s + 640)
SELECT project, page, tx::BIGINT AS tx, ty::BIGINT AS ty FROM t ANTI JOIN boxed USING (project, page, tx, ty) WHERE ('0x' || md5(concat_ws(':', project, page::VARCHAR, tx::VARCHAR, ty::VARCHAR))[1:8])::BIGINT % 10 = 0""",
)
def empty_tiles(spark: SparkSession, d: str) -> DataFrame:
    """CMP-15, GEO-07/08, JOIN-24: tiles of reviewed pages; of those without a box one in ten (a sampling operator)."""
    pages = truth(spark, d).select("project", "page").distinct().withColumns({"width": F.lit(7200), "height": F.lit(5400)})
    kept = datasets.kept_empty_tiles(pages, datasets.tile_boxes(truth(spark, d), pages))
    return kept.select("project", "page", F.col("tx").cast("bigint").alias("tx"), F.col("ty").cast("bigint").alias("ty"))


@query(
    "training_boxes",
    f"""WITH {TRUTH}, keep AS (SELECT cls FROM truth GROUP BY cls HAVING count(*) >= 30), sx AS ({_STARTS.format(side=7200)}), sy AS ({_STARTS.format(side=5400)}),
c AS (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM truth SEMI JOIN keep USING (cls)), j AS (SELECT c.*, sx.s AS tx, sy.s AS ty FROM c JOIN sx ON mx >= sx.s AND mx < sx.s + 640 JOIN sy ON my >= sy.s AND my < sy.s + 640),
k AS (SELECT project, page, tx, ty, cls, least(greatest(x1 - tx, 0), 640) AS a, least(greatest(y1 - ty, 0), 640) AS b, least(greatest(x2 - tx, 0), 640) AS d, least(greatest(y2 - ty, 0), 640) AS e FROM j)
SELECT project, page, tx, ty, coalesce(v, cls) AS cls, floor((a + d) / 2 / 640 * 1e6 + 0.5) / 1e6 AS cx, floor((b + e) / 2 / 640 * 1e6 + 0.5) / 1e6 AS cy, floor((d - a) / 640 * 1e6 + 0.5) / 1e6 AS w, floor((e - b) / 640 * 1e6 + 0.5) / 1e6 AS h FROM k LEFT JOIN (SELECT * FROM {dims.sql_values(dims.CLASS_ALIAS)}) al ON al.k = cls""",
)
def training_boxes(spark: SparkSession, d: str) -> DataFrame:
    """CMP-15, FIL-21: normalised boxes of frequent classes in every tile that holds their centre."""
    pages = truth(spark, d).select("project", "page").distinct().withColumns({"width": F.lit(7200), "height": F.lit(5400)})
    b = datasets.tile_boxes(datasets.frequent_classes(truth(spark, d)), pages)
    return b.select("project", "page", F.col("tx").cast("bigint").alias("tx"), F.col("ty").cast("bigint").alias("ty"), "cls", *[G.share6(F.col(c)).alias(c) for c in ("cx", "cy", "w", "h")])
