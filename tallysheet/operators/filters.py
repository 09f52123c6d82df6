"""Page, token and cell filters, and small picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions import dims
from tallysheet.functions import strings as S
from tallysheet.operators.windows import blocked, running_sum


def chosen_projects(df: DataFrame, having: tuple[str, ...] = (), starting: str = "", limit: int | None = None, project: str = "project") -> DataFrame:
    """Rows of projects whose name contains any of the texts and begins with a prefix; with ``limit`` the first
    projects by name only (an explicit choice of the caller, none by default)."""
    if having:
        df = df.where(has_any(F.col(project), list(having)))
    if starting:
        df = df.where(F.col(project).startswith(starting))
    return df if limit is None else df.join(df.select(project).where(F.col(project).isNotNull()).distinct().orderBy(project).limit(limit), project, "left_semi")


def page_cap(df: DataFrame, by: list[str], page: str, first: int) -> DataFrame:
    """The first pages of each document by number (an explicit choice of the caller), from the page numbers of each."""
    kept = df.groupBy(*by).agg(F.array_max(F.slice(F.array_sort(F.collect_set(page)), 1, first)).alias("_last"))  # page numbers of one document
    return df.join(kept, by).where(F.col(page) <= F.col("_last")).drop("_last")


def has_any(text: Column, words: list[str]) -> Column:
    """Any of the words in the upper-case text; NULL texts have none."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.greatest(*[F.contains(up, F.lit(w.upper())) for w in words], F.lit(False))


def pages_with_fallback(pages: DataFrame, by: list[str], wanted: list[str], unwanted: list[str], text: str = "text") -> DataFrame:
    """Pages with a wanted and no unwanted word; of a group without any such page, all pages."""
    t = pages.withColumn("_hit", has_any(F.col(text), wanted) & ~has_any(F.col(text), unwanted))
    some = t.where("_hit").select(*by).distinct().withColumn("_some", F.lit(True))
    return t.join(some, by, "left").where("_hit or _some is null").drop("_hit", "_some")


def ocr_page_gate(tokens: DataFrame, by: list[str], words: list[str] | None = None, least: int = 2, text: str = "text") -> DataFrame:
    """Keys of pages with at least ``least`` schedule-looking tokens."""
    return tokens.groupBy(*by).agg(F.count_if(has_any(F.col(text), words or dims.SCHEDULE_PAGE_WORDS)).alias("_n")).where(F.col("_n") >= least).drop("_n")


def near_empty_pages(pages: DataFrame, by: list[str], page: str = "page", text: str = "text", least: int = 120, first: int = 8) -> DataFrame:
    """The first pages of each document whose text layer is nearly empty."""
    few = pages.where(F.length(S.strip(F.coalesce(text, F.lit("")))) < least)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(page))).where(F.col("_k") <= first).drop("_k")


def first_pages_text(pages: DataFrame, by: list[str], page: str = "page", text: str = "text", first: int = 3) -> DataFrame:
    """Text of the first pages of each document, joined by line breaks (at most ``first`` texts are gathered)."""
    t = pages.where((F.col(page) < first) & F.col(text).isNotNull())
    return t.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda s: s[text]), "\n").alias("text"))


def above_confidence(df: DataFrame, floor: float, conf: str = "conf") -> DataFrame:
    return df.where(F.col(conf) >= floor)


def without_prefixes(df: DataFrame, prefixes: list[str], tag: str = "tag") -> DataFrame:
    """Rows whose mark type is none of the given ones."""
    return df.where(~F.coalesce(F.upper(S.mark_type(F.col(tag))).isin(*prefixes), F.lit(False))) if prefixes else df


def title_lines(lines: DataFrame, by: list[str], pattern: str = r"(?i)\bSCHEDULE\b", ratio: float = 1.15) -> DataFrame:
    """Lines with a title word that are clearly higher than the (upper) median line of their page.

    lines(.., text, h). Heights are counted per distinct value, so a page's median needs no full sort.
    """
    n = lines.groupBy(*by, "h").agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("t"))
    w = Window.partitionBy(*by).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mid = n.withColumn("u", F.sum("n").over(w)).join(total, by).where("u > floor(t / 2)").groupBy(*by).agg(F.min("h").alias("mid"))
    return lines.join(mid, by).where(F.col("text").rlike(pattern) & (F.col("h") >= ratio * F.col("mid"))).drop("mid")


def nearest_title(tables: DataFrame, titles: DataFrame, by: list[str], band: float = 320.0) -> DataFrame:
    """Per table the nearest title above it within a band, the higher line first of equals.

    tables(.., table_id, y0), titles(.., text, y, h).
    """
    j = tables.select(*by, "table_id", "y0").join(titles.select(*by, "text", "y", "h"), by).where((F.col("y") <= F.col("y0")) & (F.col("y0") - F.col("y") <= band))
    return j.groupBy(*by, "table_id").agg(F.min_by("text", F.struct(F.col("y0") - F.col("y"), -F.col("h"), F.col("text"))).alias("title"))


def sized_cells(cells: DataFrame, w: tuple[float, float] = (12.0, 2000.0), h: tuple[float, float] = (8.0, 400.0)) -> DataFrame:
    """Ruled cells of plausible width and height."""
    return cells.where((F.col("x2") - F.col("x1")).between(*w) & (F.col("y2") - F.col("y1")).between(*h))


def centre_inside(boxes: DataFrame, width: float, height: float) -> DataFrame:
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return boxes.where((cx >= 0) & (cx < width) & (cy >= 0) & (cy < height))


def to_stage(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Files that are missing or of another size; both have name and size_bytes."""
    return wanted.join(there.select("name", "size_bytes").distinct(), ["name", "size_bytes"], "left_anti")


def extremes(scores: DataFrame, score: str, count: str, worst: int = 5, below: float = 0.5, least: int = 5) -> DataFrame:
    """The worst classes by a score, of which those below a bound with enough rows (the cut comes first)."""
    return scores.orderBy(score, "cls").limit(worst).where((F.col(score) < below) & (F.col(count) > least))


def most_common(df: DataFrame, value: str, first: int) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(first)


def running_index(df: DataFrame, by: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Position of a row in its key, from 0, counted over blocks so that a hot key is split."""
    cols = [F.col(o) for o in order]
    d = running_sum(blocked(df, by, cols), by, cols, F.lit(1), name)
    return d.withColumn(name, F.col(name) - 1).drop("_blk")


def labelled_to_raw(labelled: DataFrame, raw: DataFrame) -> DataFrame:
    """Per labelled file the raw file of its project with equal page count, else the first by name.

    labelled(project, file, pages), raw(project, raw_file, raw_pages).
    """
    j = labelled.join(raw, "project", "left")
    return j.groupBy("project", "file").agg(F.min_by("raw_file", F.struct(F.coalesce(F.col("pages") != F.col("raw_pages"), F.lit(True)), F.col("raw_file"))).alias("raw_file"))
