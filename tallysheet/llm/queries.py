"""Queries of the language-model data operators (problems 1 and 6 to 9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.llm import group_split, leak, mojibake, pack, target_sample
from tallysheet.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"ls_boxes": target_sample.box_records(table(spark, d, "ls_boxes")), "sample_per_project": target_sample.counted_records(table(spark, d, "sample_per_project"))}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Classes whose records do not suffice for a request."""
    report, _ = target_sample.plan_samples(_sources(spark, d), table(spark, d, "sample_targets"))
    return report.where("short").select("request_id", "class_name").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Needed, available and taken records of every class of every request."""
    return target_sample.plan_samples(_sources(spark, d), table(spark, d, "sample_targets"))[0]


def p1_needs(spark: SparkSession, d: str) -> DataFrame:
    """Needed and available records of every class of every request."""
    return p1_report(spark, d).select("request_id", "class_name", "needed", "available")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn records of every request."""
    return target_sample.draw_samples(_sources(spark, d), table(spark, d, "sample_targets"))[0]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different strings that name the same job."""
    return group_split.same_job_pairs(group_split.job_of_names(table(spark, d, "batch_results"), table(spark, d, "ls_boxes")))


def p6_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Every job name with the job it belongs to (its representative)."""
    return group_split.job_of_names(table(spark, d, "batch_results"), table(spark, d, "ls_boxes"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """How nearly the splits meet their row shares."""
    runs, boxes = table(spark, d, "batch_results"), table(spark, d, "ls_boxes")
    targets = table(spark, d, "split_targets")
    return group_split.split_report(group_split.assign_splits(group_split.job_of_names(runs, boxes), group_split.split_records(runs, boxes), targets), targets)


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every job name with its job and split."""
    runs, boxes = table(spark, d, "batch_results"), table(spark, d, "ls_boxes")
    jobs = group_split.job_of_names(runs, boxes)
    return jobs.join(group_split.assign_splits(jobs, group_split.split_records(runs, boxes), table(spark, d, "split_targets")), "job").select("name", "job", "split_name", F.col("rows").alias("job_rows"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that exceed a capacity and so are cut."""
    return pack.cut_documents(_packed(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document or piece, for every capacity."""
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused share per capacity."""
    return pack.fill_report(_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items of which they hold a passage."""
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The leaked spans to remove."""
    return leak.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with garbled characters."""
    return mojibake.garbled_documents(table(spark, d, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """The restored text of every affected document."""
    return mojibake.restored_documents(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_needs": p1_needs,
    "p1_sample": p1_sample,
    "p6_found": p6_found,
    "p6_jobs": p6_jobs,
    "p6_splits": p6_splits,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}
_CLASS = r"upper(trim(regexp_replace({c}, '[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')))"
_RECORDS = f"""WITH rec AS (SELECT 'ls_boxes' AS source_table, {_CLASS.replace('{c}', 'cls')} AS k, count(DISTINCT box_id) AS n FROM ls_boxes WHERE cls IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'sample_per_project', {_CLASS.replace('{c}', 'class')}, sum(count) FROM (SELECT DISTINCT project, class, count FROM sample_per_project WHERE count > 0 AND class IS NOT NULL) GROUP BY ALL),
t AS (SELECT DISTINCT s.*, coalesce(n, 0)::BIGINT AS available, greatest(min_count, floor(target_share * sample_size + 0.5))::BIGINT AS needed FROM sample_targets s LEFT JOIN rec ON rec.source_table = s.source_table AND k = {_CLASS.replace('{c}', 'class_name')})"""
# Leaks by plain SQL: words without case, accents and entities, equal runs of six words, the words along each
# alignment and those up to three places beside it, and windows of 25 words with 22 of them.
_WORDS = r"""regexp_extract_all(strip_accents(lower(nfc_normalize(regexp_replace(regexp_replace(text, '&([A-Za-z])(?:acute|grave|circ|uml|tilde|cedil|ring|caron|slash);', '\1', 'g'), '&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', ' ', 'g')))), '[\p{L}\p{N}]+')"""
_LEAKS = f"""WITH it AS (SELECT item_id, ws, len(ws) AS n FROM (SELECT DISTINCT item_id, {_WORDS} AS ws FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(ws) >= 25),
iw AS (SELECT item_id, k, ws[k] AS w, n, array_to_string(ws[k:k + 5], ' ') AS gram FROM it, unnest(generate_series(1, n)) AS g(k)),
dw AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT DISTINCT doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0)),
dg AS (SELECT doc_id, p, ws[p] AS w, array_to_string(ws[p:p + 5], ' ') AS gram FROM dw, unnest(generate_series(1, n)) AS g(p)),
al AS (SELECT DISTINCT doc_id, item_id, p - k AS shift FROM (SELECT * FROM dg SEMI JOIN iw USING (gram)) d JOIN iw i USING (gram) WHERE k <= n - 5),
hit AS (SELECT DISTINCT a.doc_id, a.item_id, a.shift, i.k FROM al a JOIN al b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND abs(b.shift - a.shift) <= 3 JOIN iw i ON i.item_id = a.item_id JOIN dg d ON d.doc_id = a.doc_id AND d.p = i.k + b.shift AND d.w = i.w),
win AS (SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING) AS same FROM hit)
SELECT DISTINCT doc_id, item_id FROM win WHERE same >= 22"""
ORACLES: dict[str, str] = {
    # lengths keep clear of the capacities, so words, digits and signs tell them as well as tokens do
    "p7_found": r"SELECT DISTINCT capacity_tokens, doc_id FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]')) AS pieces FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), pack_sizes WHERE pieces > capacity_tokens",
    "p8_found": _LEAKS,
    "p1_found": f"{_RECORDS} SELECT DISTINCT request_id, class_name FROM t WHERE available < needed",
    "p1_needs": f"{_RECORDS} SELECT request_id, class_name, needed, available FROM t",
}
