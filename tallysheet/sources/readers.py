"""Readers: keyed CSV, JSON lines, sidecars, workbooks, annotation objects, reports, folder catalogs.

All are lazy DataFrames. Files whose format needs Python (workbooks) are read as ``binaryFile`` and
decoded in Arrow batches by the standard library only.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysheet.functions import strings as S

BATCH_SCHEMA = "project string, plan string, size_mb double, status string, sched_tags int, detections int, tagged int, tagged_pct double, untag_no_cand int, untag_unmatched int, distinct_tags int, xlsx boolean, annotated boolean, runtime_s double"
SURVEY_SCHEMA = "project string, class string, count int"
DISCREPANCY_SCHEMA = "page int, status string, v10_class string, truth_class string, iou double, x1 double, y1 double, x2 double, y2 double"
TRUTH_SCHEMA = "map<string,array<struct<x1:double,y1:double,x2:double,y2:double,cls:string>>>"
ANNOTATION_SCHEMA = "page int, page_w double, page_h double, rotation int, cx double, cy double, rect array<double>, subject string, tag string, count_style string, properties map<string,string>, project string, raw_pdf string, takeoff_pdf string"


def keyed_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; empty cells are NULL; by name, so the order of columns is free."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    if schema is None:
        return raw
    wanted = spark.createDataFrame([], schema).schema
    have = {c.lower(): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; a line that does not parse is left out here and kept by ``bad_json_lines``."""
    r = spark.read.option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).json(path).dropna("all")


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the lines that are no JSON objects, blank ones aside."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return t.where((F.trim("line") != "") & F.try_parse_json("line").isNull())


def reviewed_truth(spark: SparkSession, path: str) -> DataFrame:
    """(project, page, box or NULL): a page reviewed and found empty keeps one row without a box."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", TRUTH_SCHEMA).alias("m"), _folder(F.col("_metadata.file_path")).alias("project"))
    pages = files.select("project", F.explode("m").alias("page", "boxes"))
    return pages.select("project", F.col("page").cast("int").alias("page"), F.explode_outer("boxes").alias("b")).select("project", "page", "b.*")


def _folder(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def discrepancy_reports(spark: SparkSession, path: str) -> DataFrame:
    """Review rows of all projects with 0-based pages and boxes; the file order is kept as ``ord``."""
    raw = spark.read.csv(path, header=True, schema=DISCREPANCY_SCHEMA)
    d = raw.select("*", _folder(F.col("_metadata.file_path")).alias("project"), F.monotonically_increasing_id().alias("ord"))
    return d.withColumn("page", F.col("page") - 1)


def text_report(spark: SparkSession, path: str, labels: dict[str, str]) -> DataFrame:
    """One row per report with the number after each label (``label.*?: N``), NULL where it is missing."""
    t = spark.read.text(path, wholetext=True)
    num = lambda lb: F.regexp_extract("value", rf"(?i){lb}[^\n]*?:\s*(\d+)", 1).try_cast("int")
    return t.select(_folder(F.col("_metadata.file_path")).alias("project"), *[num(rx).alias(n) for n, rx in labels.items()])


def folder_catalog(spark: SparkSession, root: str, suffix: str = "pdf", skip: tuple[str, ...] = ()) -> DataFrame:
    """(project, path, name, size_bytes) of files in any depth; the project is the first folder below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    path = F.url_decode(F.regexp_replace("path", r"^\w+:/*", "/"))
    out = files.select(path.alias("path"), F.col("length").alias("size_bytes"))
    below = F.substr("path", F.lit(len(base) + 2))
    out = out.select(F.split_part(below, F.lit("/"), F.lit(1)).alias("project"), "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size_bytes")
    return out.where(~F.col("project").isin(*skip)) if skip else out


def completed(spark: SparkSession, markers: DataFrame, logs: DataFrame, banner: str) -> DataFrame:
    """(project, done, status): a marker says so, else a banner in the log text does."""
    by_log = logs.groupBy("project").agg(F.max(F.contains("text", F.lit(banner))).alias("banner"))
    return markers.select("project", F.col("status").alias("m")).join(by_log, "project", "full").select("project", (F.col("m").isNotNull() | F.coalesce("banner", F.lit(False))).alias("done"), F.coalesce("m", F.when(F.col("banner"), "ok")).alias("status"))


# ---- workbooks -----------------------------------------------------------------------------------

CELLS = "file string, sheet string, r int, c int, value string"
UNREADABLE = "<unreadable>"  # sheet name of the row that stands for a workbook that cannot be read
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def workbook_cells(content: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the filled cells of a workbook, 0-based; one that cannot be read is one row
    (UNREADABLE, -1, -1, reason)."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sh in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = rels.get(sh.get(_REL), "").lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            if target not in names:
                continue
            for cell in ET.fromstring(z.read(target)).iter(f"{{{_NS['m']}}}c"):
                v, kind = cell.find("m:v", _NS), cell.get("t")
                text = shared[int(v.text)] if kind == "s" and v is not None else "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text if v is not None else None)
                if text not in (None, ""):
                    ref = cell.get("r", "A1")
                    out.append((sh.get("name"), int(re.sub(r"\D", "", ref)) - 1, _column(ref), text))
        return out
    except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError) as e:
        return [(UNREADABLE, -1, -1, f"{type(e).__name__}: {e}")]


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks below a path; ``where("sheet = '<unreadable>'")`` lists those that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *c) for p, content in zip(b["path"], b["content"], strict=True) for c in workbook_cells(content)]
            yield pd.DataFrame(rows, columns=["file", "sheet", "r", "c", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, CELLS)


def takeoff_from_cells(cells: DataFrame, prefer: tuple[str, ...] = ("TAKEOFF",)) -> DataFrame:
    """(file, product, tag, qty): the preferred sheet, header in its first ten rows, product filled down.

    Total rows neither give nor reset the product; rows without a number above zero are dropped, a bad
    quantity still advances the product.
    """
    cells = cells.where(F.col("sheet") != UNREADABLE)
    up = F.upper(S.strip(F.col("value")))
    heads = cells.where("r < 10").groupBy("file", "sheet", "r").agg(F.max(F.when(up == "PRODUCT", F.col("c"))).alias("pc"), F.max(F.when(up.isin("QTY", "COUNT"), F.col("c"))).alias("qc"), F.max(F.when(up == "TAG", F.col("c"))).alias("tc")).where("pc is not null and qc is not null")
    liked = F.greatest(*[F.contains(F.upper("sheet"), F.lit(p)) for p in prefer], F.lit(False))
    head = heads.groupBy("file").agg(F.min_by(F.struct("sheet", "r", "pc", "qc", "tc"), F.struct(~liked, F.col("sheet"), F.col("r"))).alias("h"))
    rows = cells.join(head, "file").where("sheet = h.sheet and r > h.r").groupBy("file", "r").agg(F.max(F.when(F.col("c") == F.col("h.pc"), S.strip(F.col("value")))).alias("p"), F.max(F.when(F.col("c") == F.col("h.qc"), S.strip(F.col("value")))).alias("q"), F.max(F.when(F.col("c") == F.col("h.tc"), S.strip(F.col("value")))).alias("tag"))
    total = F.coalesce(F.contains(F.upper("p"), F.lit("TOTAL")), F.lit(False))
    w = Window.partitionBy("file").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("product", F.last(F.when(~total & (F.col("p") != ""), F.col("p")), True).over(w)).where(~total)
    return filled.select("file", "product", F.coalesce("tag", F.lit("")).alias("tag"), F.col("q").try_cast("double").cast("bigint").alias("qty")).where("product is not null and qty > 0")


def tag_column(cells: DataFrame) -> DataFrame:
    """(file, tag): the distinct upper-case tags of the first sheet whose first row has a TAG column.

    Totals and single dots are no tags; a workbook without such a sheet gives nothing. The order of sheets is
    that of their names.
    """
    up = F.upper(S.strip(F.col("value")))
    heads = cells.where("r = 0").where(up == "TAG").groupBy("file", "sheet").agg(F.min("c").alias("tc")).groupBy("file").agg(F.min_by(F.struct("sheet", "tc"), "sheet").alias("h"))
    rows = cells.join(heads, "file").where("sheet = h.sheet and c = h.tc and r > 0").select("file", S.strip(F.col("value")).alias("v"))
    return rows.where("v <> '' and v <> '.'").where(~F.contains("v", F.lit("Total"))).select("file", F.upper("v").alias("tag")).distinct()


# ---- annotation objects ---------------------------------------------------------------------------


def count_annotations(objects: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """Counted annotations from raw object text: subject, tag, style, rectangle, packed column data.

    objects(page, raw): only objects with /PolygonCount or a /Subj outside the noise list count.
    """
    o = objects.where(F.contains("raw", F.lit("/PolygonCount")))
    rect = F.transform(F.split(F.trim(F.regexp_extract("raw", r"/Rect\s*\[([^\]]+)\]", 1)), r"\s+"), lambda v: v.try_cast("double"))
    first = F.split_part(F.coalesce(S.object_field(F.col("raw"), "Contents"), F.lit("")), F.lit("\n"), F.lit(1))
    out = o.select("page", S.object_field(F.col("raw"), "Subj").alias("subject"), F.coalesce(S.object_field(F.col("raw"), "Label"), F.nullif(F.trim(first), F.lit(""))).alias("tag"), S.object_field(F.col("raw"), "CountStyle").alias("count_style"), rect.alias("rect"), S.pdf_strings(F.regexp_extract("raw", r"/BSIColumnData\s*\[(.*?)\]", 1)).alias("columns"))
    return out.where(~F.coalesce("subject", F.lit("")).isin(*noise)) if noise else out


def column_data(annotations: DataFrame, slots: DataFrame) -> DataFrame:
    """Packed column data as a property map; slots(pos, name, deleted) names the positions."""
    e = annotations.select("page", "subject", "tag", F.posexplode("columns").alias("pos", "value")).where("value <> ''").join(slots.where("not deleted"), "pos")
    return e.groupBy("page", "subject", "tag").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))


def polygon_boxes(annotations: DataFrame) -> DataFrame:
    """Polygon annotations only, with centre and box."""
    return annotations.where("type = 'Polygon'").withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
