"""Writers: fixed-column CSV, JSON sidecars, JSON lines, partitioned tiles, reports.

Data is written by the executors; only small aggregated reports are formatted on the driver, and
their size is bounded by an explicit limit.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_ROWS = 10_000


def fixed_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """CSV with exactly these columns in this order; missing ones are empty, others are dropped."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode(mode).csv(path, header=True, escape='"')


def sidecars(detections: DataFrame) -> DataFrame:
    """(project, body): one JSON text per project with detections by 0-based page, in the base shape.

    Pages are gathered per page and then per project; a project's sidecar is one text by definition.
    """
    cols = ["cls", "tag", "tag_method", "untagged_reason", "conf", "x1", "y1", "x2", "y2"]
    page = detections.groupBy("project", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("det_id", F.struct(*cols).alias("d")))), lambda x: x["d"]).alias("dets"))
    g = page.groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page").cast("string").alias("p"), "dets")))).alias("pages"), F.sum(F.size("dets")).alias("n"), F.sum(F.size(F.filter("dets", lambda d: d["tag"].isNotNull()))).alias("tagged"))
    body = F.struct(F.col("project").alias("pdf"), F.lit(200).alias("dpi"), F.struct(F.col("n").alias("detections"), F.col("tagged")).alias("funnel"), F.col("pages"))
    return g.select("project", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, done: DataFrame, keys: list[str], path: str) -> None:
    """Append only rows whose key is not yet there."""
    df.join(done.select(*keys).distinct(), keys, "left_anti").write.mode("append").json(path)


def tile_labels(tiles: DataFrame, class_index: DataFrame) -> DataFrame:
    """(tile, label): one text per tile with a line ``cls cx cy w h`` per box; tiles(tile, cls, cx, cy, w, h)."""
    j = tiles.join(class_index, "cls")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("idx"), "cx", "cy", "w", "h")
    return j.groupBy("tile").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("label"))


def markdown(df: DataFrame, title: str) -> str:
    """A small report as a Markdown table; more than REPORT_ROWS rows are refused."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows; aggregate it first")
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join(show(v) for v in r) + " |" for r in rows) + "\n"


def grouped_dump(variables: DataFrame) -> DataFrame:
    """(page, schedule_name, text): the readable dump of variables(page, schedule_name, tag, props), one text per
    schedule of a page with a line per tag; a schedule's own rows are gathered, never more."""
    line = F.concat(F.lit("  "), F.col("tag"), F.lit(": "), F.array_join(F.transform("props", lambda p: F.concat(p["key"], F.lit("="), p["value"])), "; "))
    g = variables.where("tag is not null").select("page", "schedule_name", F.struct("tag", line.alias("line")).alias("l")).groupBy("page", "schedule_name").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return g.select("page", "schedule_name", F.array_join(F.concat(F.array(F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" - "), F.coalesce("schedule_name", F.lit("")))), F.transform("ls", lambda x: x["line"])), "\n").alias("text"))


def colour_index(cls: Column, n: int = 10) -> Column:
    """A colour of a class that is the same in every process."""
    return F.pmod(F.xxhash64(cls), F.lit(n))


HEADERS = ["PRODUCT", "BRAND", "MODEL", "QTY", "TAG", "NECK SIZE", "MODULE SIZE", "DUCT SIZE", "TYPE", "MOUNTING", "REMARK"]  # fixed values
_COLUMNS = ["product", "brand", "model", "qty", "tag", "neck_size", "module_size", "duct_size", "type", "mounting", "remark"]


def workbook_rows(takeoff: DataFrame) -> DataFrame:
    """Takeoff rows with class totals and the grand total, in sheet order (``part``, product, tag)."""
    detail = takeoff.select("project", "product", "tag", "qty", F.lit(0).alias("part"))
    total = takeoff.groupBy("project", "product").agg(F.sum("qty").alias("qty")).select("project", F.concat("product", F.lit(" Total")).alias("product"), F.lit("").alias("tag"), "qty", F.lit(1).alias("part"))
    grand = takeoff.groupBy("project").agg(F.sum("qty").alias("qty")).select("project", F.lit("GRAND TOTAL").alias("product"), F.lit("").alias("tag"), "qty", F.lit(2).alias("part"))
    return detail.unionByName(total).unionByName(grand)


def _cell(ref: str, v: object) -> str:
    if v is None or v == "":
        return ""
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook (Office Open XML) of plain rows, by the standard library alone."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, body: z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + body)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        put("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(_cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def takeoff_workbooks(takeoff: DataFrame, detail: DataFrame) -> DataFrame:
    """(project, content): one workbook per project with the grouped takeoff and the flat detection rows.

    Rows are those of ``takeoff.assemble`` and ``takeoff.detail_rows``. A workbook is one file by definition, so
    a project's rows meet in one task; a sheet of the format holds 1,048,576 rows, and more are refused.
    """
    order = ["project", "part", *_COLUMNS, "page", "det_id"]
    a = takeoff.select("project", F.lit(0).alias("part"), *_COLUMNS, F.lit(None).cast("int").alias("page"), F.lit(None).cast("bigint").alias("det_id"))
    b = detail.select("project", F.lit(1).alias("part"), *_COLUMNS, "page", F.col("det_id").cast("bigint").alias("det_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        project = pdf["project"].iloc[0]
        rows = pdf[pdf["part"] == 0].sort_values(["product", "tag"])
        flat = pdf[pdf["part"] == 1].sort_values(["page", "product", "tag", "det_id"])
        if max(len(rows), len(flat)) > 1_000_000:
            raise ValueError(f"more than 1,000,000 rows in the workbook of {project!r}; write them as a table")
        sheet: list[list] = [[f"HVAC Takeoff: {project}"], [], HEADERS]
        shown = None
        for r in rows[_COLUMNS].itertuples(index=False):
            sheet.append(["" if r.product == shown else r.product, r.brand, r.model, int(r.qty), *list(r)[4:]])
            shown = r.product
        for product, n in rows.groupby("product", sort=True)["qty"].sum().items():
            sheet.append([f"{product} Total", "", "", int(n)])
        sheet += [[], ["GRAND TOTAL", "", "", int(rows["qty"].sum())]]
        raw = [HEADERS, *([r.product, r.brand, r.model, 1, *list(r)[4:]] for r in flat[_COLUMNS].itertuples(index=False))]
        return pd.DataFrame({"project": [project], "content": [workbook_bytes({"Takeoff": sheet, "RawData": raw})]})

    return a.unionByName(b).select(*order).where("project is not null").groupBy("project").applyInPandas(run, "project string, content binary")
