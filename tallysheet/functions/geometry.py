"""Boxes, distances, rotations and tiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DPI = 200
PX_PER_PT = DPI / 72


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def within_box(x1: Column, y1: Column, x2: Column, y2: Column, d) -> Column:
    """Both coordinates closer than d."""
    return (F.abs(x1 - x2) < num(d)) & (F.abs(y1 - y2) < num(d))


def area(b: str) -> Column:
    return F.greatest(F.col(f"{b}x2") - F.col(f"{b}x1"), F.lit(0.0)) * F.greatest(F.col(f"{b}y2") - F.col(f"{b}y1"), F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes by column prefix; 0 where they do not overlap."""
    w = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    h = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return F.when((w > 0) & (h > 0), F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))).otherwise(F.lit(0.0))


def contained_share(inner: str, outer: str) -> Column:
    """Share of the inner box's area that lies in the outer one."""
    w = F.greatest(F.least(F.col(f"{inner}x2"), F.col(f"{outer}x2")) - F.greatest(F.col(f"{inner}x1"), F.col(f"{outer}x1")), F.lit(0.0))
    h = F.greatest(F.least(F.col(f"{inner}y2"), F.col(f"{outer}y2")) - F.greatest(F.col(f"{inner}y1"), F.col(f"{outer}y1")), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, area(inner)), F.lit(0.0))


def rotate_to_display(x: Column, y: Column, w: Column, h: Column, rotation: Column) -> Column:
    """struct(x, y) of a media-box point in display space; w and h are the media box's sides."""
    rx = F.when(rotation == 90, h - y).when(rotation == 180, w - x).when(rotation == 270, y).otherwise(x)
    ry = F.when(rotation == 90, x).when(rotation == 180, h - y).when(rotation == 270, w - x).otherwise(y)
    return F.struct(rx.alias("x"), ry.alias("y"))


def rotate_to_media(x: Column, y: Column, w: Column, h: Column, rotation: Column) -> Column:
    """The inverse of rotate_to_display."""
    mx = F.when(rotation == 90, y).when(rotation == 180, w - x).when(rotation == 270, w - y).otherwise(x)
    my = F.when(rotation == 90, h - x).when(rotation == 180, h - y).when(rotation == 270, x).otherwise(y)
    return F.struct(mx.alias("x"), my.alias("y"))


def px_to_pt(v: Column) -> Column:
    return v / F.lit(PX_PER_PT)


def pt_to_px(v: Column) -> Column:
    return v * F.lit(PX_PER_PT)


def percent_box(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Left, top, width and height of a box in percent of its image."""
    return F.struct((x1 / w * 100).alias("x"), (y1 / h * 100).alias("y"), ((x2 - x1) / w * 100).alias("width"), ((y2 - y1) / h * 100).alias("height"))


def from_percent(x: Column, y: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    return F.struct((x * w / 100).alias("x1"), (y * h / 100).alias("y1"), ((x + width) * w / 100).alias("x2"), ((y + height) * h / 100).alias("y2"))


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles along a side: every (tile - overlap), the last ones moved back to the edge, each once."""
    step = tile - overlap
    raw = F.sequence(F.lit(0), F.greatest(length.cast("int") - 1, F.lit(0)), F.lit(step))
    return F.array_distinct(F.transform(raw, lambda s: F.greatest(F.least(s, length.cast("int") - tile), F.lit(0))))


def share6(v: Column) -> Column:
    """A share to six places, halves upward (decimal rounding differs between engines at ties)."""
    return F.floor(v * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def clip_normalise(x1: Column, y1: Column, x2: Column, y2: Column, tx: Column, ty: Column, tile: int) -> Column:
    """Centre and size of a box in a tile, clipped to it and in shares of its side."""
    c = lambda v, t: F.least(F.greatest(v - t, F.lit(0.0)), F.lit(float(tile)))
    a, b, d, e = c(x1, tx), c(y1, ty), c(x2, tx), c(y2, ty)
    return F.struct(((a + d) / 2 / tile).alias("cx"), ((b + e) / 2 / tile).alias("cy"), ((d - a) / tile).alias("w"), ((e - b) / tile).alias("h"))


def match_confidence(score: Column) -> Column:
    """Confidence of a match by shared tokens."""
    return F.least(F.lit(0.5) + F.lit(0.15) * score, F.lit(0.95))


def distance_confidence(d: Column, most) -> Column:
    return F.lit(1.0) - F.least(d / num(most), F.lit(1.0))
