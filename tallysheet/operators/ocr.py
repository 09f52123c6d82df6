"""From OCR tokens to tags and tables: crop texts, word matching, grids, header choice, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.functions import maps
from tallysheet.functions import strings as S
from tallysheet.operators import windows as W
from tallysheet.operators.spatial import distance_join, nearest

NUMERIC_COLUMNS = ["CFM", "HP", "QTY", "NECK SIZE", "WEIGHT", "AMPS", "WATTS", "VOLTS"]
HEADER_WORDS = ["MARK", "TAG", "SYMBOL", "MANUFACTURER", "MODEL", "CFM", "HP", "NECK SIZE", "TYPE", "SERVICE", "REMARKS", "DESCRIPTION", "QTY", "MOUNTING", "SIZE"]


def crop_texts(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Tokens of a crop in x order as one text, with their mean confidence."""
    return tokens.groupBy(*by).agg(maps.ordered_text(F.collect_list(F.struct(F.col("cx").alias("o"), F.col("text").alias("text")))).alias("text"), F.round(F.avg("conf"), 6).alias("conf"))


def word_to_tag(words: DataFrame, tags: DataFrame, by: list[str]) -> DataFrame:
    """Words that name a tag: the whole folded word, else its first part that is a folded tag.

    words(.., word_id, text); tags(.., tag, ord). Of tags with one fold the last wins.
    """
    known = tags.withColumn("fold", S.alnum_fold(F.col("tag"))).groupBy(*by, "fold").agg(F.max_by("tag", "ord").alias("tag"))
    parts = words.select(*by, "word_id", F.concat(F.array(S.alnum_fold(F.col("text"))), F.filter(F.split(F.upper("text"), "[^A-Z0-9]+"), lambda p: p != "")).alias("p"))
    tried = parts.select(*by, "word_id", F.posexplode("p").alias("at", "fold")).where("fold <> ''").join(known, [*by, "fold"])
    return tried.groupBy(*by, "word_id").agg(F.min_by("tag", "at").alias("tag"))


def size_then_number(detections: DataFrame, words: DataFrame, by: list[str], reach: float = 350.0, near: float = 120.0) -> DataFrame:
    """Per detection the nearest NNxNN size, and the 2 to 4 digit number nearest to that size.

    detections(.., det_id, cx, cy); words(.., x, y, text).
    """
    w = words.select(*by, F.col("x").alias("rx"), F.col("y").alias("ry"), "text")
    sizes = w.withColumn("size", S.size_token(F.col("text"))).where("size is not null")
    first = nearest(distance_join(detections, sizes, by, reach), [*by, "det_id"], F.struct("size", "rx", "ry"), F.col("rx"), F.col("ry"))
    at = first.select(*by, "det_id", F.col("nearest.size").alias("size"), F.col("nearest.rx").alias("cx"), F.col("nearest.ry").alias("cy"))
    numbers = w.where(F.col("text").rlike(r"^\d{2,4}$"))
    second = nearest(distance_join(at, numbers, by, near), [*by, "det_id"], F.col("text"), F.col("rx"), F.col("ry")).select(*by, "det_id", F.col("nearest").alias("number"))
    return at.select(*by, "det_id", "size").join(second, [*by, "det_id"], "left")


def grid_cells(tokens: DataFrame, grids: DataFrame, by: list[str]) -> DataFrame:
    """Texts of the cells of ruled tables: tokens in half-open bands, joined by (x, text).

    grids(.., table_id, rows array, cols array): edges of bands; a page has few tables.
    """
    j = tokens.select(*by, "cx", "cy", "text").join(grids, by)
    c = j.select(*by, "table_id", maps.band_index(F.col("rows"), F.col("cy")).alias("r"), maps.band_index(F.col("cols"), F.col("cx")).alias("c"), "cx", "text").where("r is not null and c is not null")
    return c.groupBy(*by, "table_id", "r", "c").agg(maps.ordered_text(F.collect_list(F.struct(F.col("cx").alias("o"), F.col("text").alias("text")))).alias("value"))


def header_choice(cells: DataFrame, by: list[str], rows: int = 6, least: int = 2) -> DataFrame:
    """(.., header_r): of the first rows the one with most vocabulary words, the first of equals."""
    hit = S.header_snap(F.col("value"), HEADER_WORDS).isin(*HEADER_WORDS)
    n = cells.where(F.col("r") < rows).groupBy(*by, "r").agg(F.count_if(hit).alias("n")).where(F.col("n") >= least)
    return n.groupBy(*by).agg(F.max_by("r", F.struct(F.col("n"), -F.col("r"))).alias("header_r"))


def table_variables(cells: DataFrame, by: list[str]) -> DataFrame:
    """Tags of reconstructed tables with properties; digits are repaired in numeric columns only.

    One row per (page, tag): of repeated ones that with most properties, then the first.
    """
    key = [*by, "table_id"]
    head = header_choice(cells, key)
    c = cells.join(head, key)
    names = c.where("r = header_r").select(*key, "c", S.header_snap(F.col("value"), HEADER_WORDS).alias("name"))
    body = c.where("r > header_r").join(names, [*key, "c"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("COL_"), F.col("c").cast("string"))))
    body = body.withColumn("value", S.ocr_digits_if(F.col("value"), F.col("name").isin(*NUMERIC_COLUMNS)))
    body = body.groupBy(*key, "r", "name").agg(F.min_by("value", "c").alias("value"))  # of columns with one name the first stands
    mark = F.col("name").isin("MARK", "TAG", "SYMBOL")
    row = body.groupBy(*key, "r").agg(F.max(F.when(mark, F.col("value"))).alias("mark"), F.map_from_entries(F.array_sort(F.collect_list(F.when(~mark & (F.col("value") != ""), F.struct("name", "value"))))).alias("properties"), F.max(F.when(F.col("name").isin("DESCRIPTION", "TYPE", "SERVICE"), F.col("value"))).alias("description"))
    tags = row.select(*key, "r", F.explode(F.filter(F.transform(S.split_compound(F.col("mark")), lambda t: S.strict_tag(t)), lambda t: t.isNotNull())).alias("tag"), "properties", "description")
    out = tags.withColumn("cls", S.resolved_class(F.col("tag"), F.col("description")))
    return out.groupBy(*by, "tag").agg(F.max_by(F.struct("properties", "cls"), F.struct(F.size("properties"), -F.col("table_id"), -F.col("r"))).alias("v")).select(*by, "tag", "v.properties", "v.cls")


def columns_to_reread(cells: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """(by.., table_id, c): mark columns of which fewer than ``share`` of the rows below the header are filled,
    which are read again crop by crop. cells(by.., table_id, r, c, value)."""
    key = [*by, "table_id"]
    c = cells.join(header_choice(cells, key), key)
    marks = c.where("r = header_r").where(S.header_snap(F.col("value"), HEADER_WORDS).isin("MARK", "TAG", "SYMBOL")).select(*key, "c")
    rows = c.where("r > header_r").groupBy(*key).agg(F.count_distinct("r").alias("_rows"))
    full = c.where("r > header_r and trim(value) <> ''").groupBy(*key, "c").agg(F.count_distinct("r").alias("_full"))
    return marks.join(rows, key).join(full, [*key, "c"], "left").where(F.coalesce("_full", F.lit(0)) < F.col("_rows") * share).select(*key, "c")


def harvest_tags(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Distinct strict tags of OCR tokens with their class; row index -1 says: tag only."""
    t = tokens.select(*by, S.strict_tag(F.col("text")).alias("tag")).where("tag is not null").distinct()
    return t.withColumns({"cls": S.class_of_tag(F.col("tag")), "source_row_index": F.lit(-1)})


def label_bubbles(tokens: DataFrame, expected: DataFrame) -> DataFrame:
    """Auto-labels of crops: exact, then one-edit, then joined tokens; with a reason for every crop.

    tokens(img, pos, text, conf); expected(img, tag). Reasons: hit, no_text, no_match, no_tag.
    """
    grams = W.ngrams(tokens, ["img"], "pos", "text").withColumn("fold", S.alnum_fold(F.col("gram")))
    e = expected.withColumn("want", S.alnum_fold(F.col("tag")))
    j = e.join(grams, "img", "left")
    exact, near = F.col("fold") == F.col("want"), (F.length("want") >= 2) & (F.col("n") == 1) & S.near_equal(F.col("fold"), F.col("want"))
    how = F.when(exact & (F.col("n") == 1), 0).when(near, 1).when(exact, 2)
    g = j.groupBy("img", "tag").agg(F.min_by("gram", F.struct(F.coalesce(how, F.lit(9)), "pos", "n")).alias("text"), F.min(how).alias("how"), F.count("fold").alias("texts"))
    reason = F.when(F.col("tag").isNull() | (F.col("tag") == ""), "no_tag").when(F.col("texts") == 0, "no_text").when(F.col("how").isNull(), "no_match").otherwise("hit")
    return g.select("img", "tag", F.when(F.col("how").isNotNull(), F.col("text")).alias("text"), F.when(F.col("how") == 0, "exact").when(F.col("how") == 1, "fuzzy").when(F.col("how") == 2, "joined").alias("how"), reason.alias("reason"))
