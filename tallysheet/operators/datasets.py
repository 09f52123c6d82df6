"""Training sets for a detector: tiles with normalised boxes, kept empties, class order, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.functions import geometry as G
from tallysheet.functions.strings import class_alias
from tallysheet.session import cut


def tile_boxes(boxes: DataFrame, pages: DataFrame, tile: int = 640, overlap: int = 160, half: float | None = None) -> DataFrame:
    """(project, page, tx, ty, cls, cx, cy, w, h): boxes in every tile that holds their centre.

    pages(project, page, width, height); ``half`` replaces the box by a square of that half side.
    """
    b = boxes.join(pages, ["project", "page"]).withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})
    hold = lambda v, side: F.filter(G.tile_starts(F.col(side), tile, overlap), lambda s: (F.col(v) >= s) & (F.col(v) < s + tile))
    t = b.withColumn("tx", F.explode(hold("mx", "width"))).withColumn("ty", F.explode(hold("my", "height")))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2")) if half is None else (F.col("mx") - half, F.col("my") - half, F.col("mx") + half, F.col("my") + half)
    n = G.clip_normalise(x1, y1, x2, y2, F.col("tx"), F.col("ty"), tile)
    return t.select("project", "page", "tx", "ty", class_alias(F.col("cls")).alias("cls"), n.alias("n")).select("project", "page", "tx", "ty", "cls", "n.cx", "n.cy", "n.w", "n.h")


def all_tiles(pages: DataFrame, tile: int = 640, overlap: int = 160) -> DataFrame:
    return pages.withColumn("tx", F.explode(G.tile_starts(F.col("width"), tile, overlap))).withColumn("ty", F.explode(G.tile_starts(F.col("height"), tile, overlap))).select("project", "page", "tx", "ty")


def kept_empty_tiles(pages: DataFrame, boxed: DataFrame, one_in: int = 10, tile: int = 640, overlap: int = 160) -> DataFrame:
    """Of tiles without a box one in ``one_in``, by a hash of the tile (a sampling operator)."""
    empty = all_tiles(pages, tile, overlap).join(boxed.select("project", "page", "tx", "ty").distinct(), ["project", "page", "tx", "ty"], "left_anti")
    place = F.md5(F.concat_ws(":", "project", F.col("page").cast("string"), F.col("tx").cast("string"), F.col("ty").cast("string")))
    return empty.where(F.conv(F.substr(place, F.lit(1), F.lit(8)), 16, 10).cast("bigint") % one_in == 0)


def frequent_classes(boxes: DataFrame, least: int = 30) -> DataFrame:
    """Boxes of classes with enough examples; the class list is small and joined back."""
    keep = boxes.groupBy("cls").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cls")
    return boxes.join(keep, "cls", "left_semi")


def first_share(names: DataFrame, name: str, seed: int, share: float, least: int = 1, buckets: int = 1024, beside: int = 0) -> DataFrame:
    """The first ``share`` of distinct names (and ``beside`` others) in a seeded hash order, at least ``least``.

    Hash buckets in hash order are counted, whole buckets below the cut are taken and only the bucket of the
    cut is ranked, so no task sees more than a bucket.
    """
    p = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_h", F.md5(F.concat(F.col(name).cast("string"), F.lit(f":{seed}"))))
    p = cut(p.withColumn("_b", F.expr(f"cast(conv(substr(_h, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296")))
    counts = {r["_b"]: r["n"] for r in p.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # at most ``buckets`` rows
    left = max(least, int((sum(counts.values()) + beside) * share)) if counts else 0
    edge = 0
    while edge < buckets and left >= counts.get(edge, 0):
        left -= counts.get(edge, 0)
        edge += 1
    last = p.where(F.col("_b") == edge).orderBy("_h", name).limit(left)
    return p.where(F.col("_b") < edge).unionByName(last).select(name)


def holdout(projects: DataFrame, share: float = 0.1, seed: int = 42, always: tuple[str, ...] = ()) -> DataFrame:
    """(project, split): whole projects to validation by seeded hash, at least one; some always."""
    p = projects.select("project").distinct()
    fixed = F.col("project").isin(*always) if always else F.lit(False)
    val = first_share(p.where(~fixed), "project", seed, share, beside=p.where(fixed).count() if always else 0).withColumn("v", F.lit(True))
    return p.join(val, "project", "left").select("project", F.when(F.col("v") | F.col("project").isin(*(always or ("",))), "val").otherwise("train").alias("split"))


def crop_labels(crops: DataFrame, bubbles: DataFrame, split: DataFrame, side: float) -> DataFrame:
    """(img, project, split, label_id, cx, cy, w, h): crops joined with the bubble found in them.

    crops(img, project, x1, y1, x2, y2) is the symbol (label 0), bubbles(img, x1, y1, x2, y2) its tag (label 1, if
    any), split(project, split). Of repeated images the last by box stands; boxes are clipped to the crop, those
    without area go, and a crop without a symbol box gives nothing.
    """
    once = lambda df: df.where("img is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null").groupBy("img").agg(F.max(F.struct(*[c for c in df.columns if c != "img"])).alias("v")).select("img", "v.*")
    c = once(crops).withColumn("label_id", F.lit(0))
    b = once(bubbles.select("img", "x1", "y1", "x2", "y2")).join(c.select("img", "project"), "img").withColumn("label_id", F.lit(1))
    n = G.clip_normalise(*[F.col(k) for k in ("x1", "y1", "x2", "y2")], F.lit(0.0), F.lit(0.0), side)
    j = c.unionByName(b.select(*c.columns)).join(split, "project", "left").select("img", "project", "split", "label_id", n.alias("n"))
    return j.select("img", "project", "split", "label_id", "n.*").where("w > 0 and h > 0")
