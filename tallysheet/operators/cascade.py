"""The tag cascade: each level sees only the detections that no earlier level has tagged.

Levels: direct (a class with exactly one tag), fingerprint (shared rare tokens near the detection,
one-to-one per page and class), bubble (nearest text that is a candidate tag, by distance less a bonus
for its length; may change the class), window (nearest word that matches a tag), none.

Inputs: detections(project, page, det_id, cls, cx, cy) in px; class_tags(project, cls, tag, ord);
words(project, page, x, y, text) and bubbles(project, page, bubble_id, x, y, text) in px;
index(project, tag, tok), the fingerprints. Empty inputs leave their level without effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.geometry import distance_confidence, match_confidence
from tallysheet.functions.strings import alnum_fold, value_fold
from tallysheet.operators.resolution import _edges, _tokens
from tallysheet.operators.spatial import DENSE, _salted, distance_join, greedy_match, window_join
from tallysheet.session import cut

PT = 200 / 72


def candidates(detections: DataFrame, class_tags: DataFrame) -> DataFrame:
    """(project, cls, candidate): per project the classes with tags that a detector class may stand for."""
    have = class_tags.select("project", F.col("cls").alias("candidate")).distinct()
    seen = detections.select("project", "cls").distinct()
    own = seen.select("project", "cls", F.col("cls").alias("candidate"), F.lit(0).alias("prio"))
    fixed = seen.join(F.broadcast(_edges(detections.sparkSession)).where("prio > 0"), "cls").select("project", "cls", "candidate", "prio")
    return own.unionByName(fixed).join(have, ["project", "candidate"]).groupBy("project", "cls", "candidate").agg(F.min("prio").alias("prio"))


def resolved(cands: DataFrame) -> DataFrame:
    """(project, cls, resolved): direct, else the one alias, else the only sibling."""
    sure = F.broadcast(_edges(cands.sparkSession).select("cls", "candidate", "sure").distinct())
    c = cands.join(sure, ["cls", "candidate"], "left").groupBy("project", "cls").agg(
        F.max(F.when(F.col("prio") == 0, F.col("candidate"))).alias("direct"),
        F.max(F.when((F.col("prio") == 1) & F.coalesce("sure", F.lit(True)), F.col("candidate"))).alias("alias"),
        F.max(F.when(F.col("prio") == 2, F.col("candidate"))).alias("sibling"),
        F.count_distinct(F.when(F.col("prio") == 2, F.col("candidate"))).alias("siblings"),
    )
    ambiguous = F.col("cls") == "AD-GRD"
    return c.select("project", "cls", F.coalesce("direct", F.when(~ambiguous, F.coalesce("alias", F.when(F.col("siblings") == 1, F.col("sibling"))))).alias("resolved")).where("resolved is not null")


def tag_cascade(detections: DataFrame, class_tags: DataFrame, words: DataFrame, bubbles: DataFrame, index: DataFrame, bubble_max: float = 350.0, window_max: float = 140.0, word_radius: float = 100.0) -> DataFrame:
    """det_id, cls, original_cls, tag, tag_method, tag_confidence, untagged_reason."""
    dets = cut(detections.select("project", "page", "det_id", "cls", "cx", "cy").distinct())
    tags = class_tags.groupBy("project", "cls", "tag").agg(F.min("ord").alias("ord"))
    cands = cut(candidates(dets, tags))
    res = resolved(cands)
    per_class = tags.groupBy("project", F.col("cls").alias("resolved")).agg(F.min("tag").alias("only"), F.max("tag").alias("other"))
    base = cut(dets.join(res, ["project", "cls"], "left").join(per_class, ["project", "resolved"], "left"))
    direct = base.where("only = other").select("det_id", F.col("cls").alias("new_cls"), F.col("only").alias("tag"), F.lit("direct").alias("tag_method"), F.lit(1.0).alias("tag_confidence"))
    # fingerprints: tokens near the detection shared with a tag's rare tokens
    open_ = base.where("resolved is not null and only <> other")
    index = cut(index.select("project", "tag", "tok"))
    # only tokens that are a fingerprint at all; the detections, fewer than the words, are the side that is spread over cells
    rare = index.select("project", "tok").distinct()
    toks = words.select("project", "page", F.col("x").alias("cx"), F.col("y").alias("cy"), F.explode(_tokens(value_fold(F.col("text")))).alias("tok")).join(rare, ["project", "tok"], "left_semi")
    spots = open_.select("project", "page", "det_id", "resolved", F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    near = distance_join(toks, spots, ["project", "page"], word_radius * PT).select("project", "page", "det_id", "resolved", "tok").distinct()
    filed = tags.select("project", F.col("cls").alias("resolved"), "tag", "ord")
    score = near.join(index, ["project", "tok"]).join(filed, ["project", "resolved", "tag"]).groupBy("project", "page", "resolved", "det_id", "tag", "ord").agg(F.count("*").alias("score"))
    edges = score.select("project", "page", "resolved", F.col("det_id").alias("l"), F.concat_ws("\u0001", "project", F.col("page").cast("string"), "resolved", "tag").alias("r"), "tag", "score", (-F.col("score")).alias("o"), F.col("det_id").alias("o1"), F.col("ord").alias("o2"))
    won = greedy_match(edges, "o", "o1", "o2", by=("project", "page", "resolved"))
    cls_of = base.select("det_id", "cls")
    finger = won.select(F.col("l").alias("det_id"), "tag", match_confidence(F.col("score")).alias("tag_confidence")).join(cls_of, "det_id").select("det_id", F.col("cls").alias("new_cls"), "tag", F.lit("fingerprint").alias("tag_method"), "tag_confidence")
    done = cut(direct.unionByName(finger))
    # bubbles: the text must be a folded candidate tag; the first class and tag of a fold win
    rest = base.join(done, "det_id", "left_anti")
    texts = bubbles.select("project", "page", "bubble_id", F.col("x").alias("rx"), F.col("y").alias("ry"), alnum_fold(F.col("text")).alias("fold")).where("fold <> ''")
    pool = cands.join(tags.select("project", F.col("cls").alias("candidate"), "tag", "ord"), ["project", "candidate"]).withColumn("fold", alnum_fold(F.col("tag"))).groupBy("project", "cls", "fold").agg(F.min(F.struct("prio", "candidate", "ord", "tag")).alias("b"))
    hit = distance_join(rest.select("project", "page", "det_id", "cls", "cx", "cy"), texts, ["project", "page"], bubble_max).join(pool, ["project", "cls", "fold"])
    bubble = hit.groupBy("det_id").agg(F.min_by(F.struct("b.candidate", "b.tag", "dist"), F.struct(F.col("dist") - 80 * F.length("fold"), F.col("bubble_id"))).alias("p"))
    bubble = bubble.select("det_id", F.col("p.candidate").alias("new_cls"), F.col("p.tag").alias("tag"), F.lit("bubble_detect").alias("tag_method"), distance_confidence(F.col("p.dist"), bubble_max).alias("tag_confidence"))
    done = cut(done.unionByName(bubble))
    # window: the nearest word that is a tag of the resolved class
    rest = base.where("only <> other").join(done, "det_id", "left_anti")
    folded = filed.withColumn("fold", alnum_fold(F.col("tag"))).groupBy("project", "resolved", "fold").agg(F.max_by("tag", "ord").alias("tag"))
    said = words.select("project", "page", F.col("x").alias("rx"), F.col("y").alias("ry"), alnum_fold(F.col("text")).alias("fold")).where("fold <> ''")
    look = distance_join(rest.select("project", "page", "det_id", "cls", "resolved", "cx", "cy"), said, ["project", "page"], window_max).join(folded, ["project", "resolved", "fold"])
    window = look.groupBy("det_id", "cls").agg(F.min_by("tag", F.struct("dist", "tag")).alias("tag"), F.min("dist").alias("dist")).select("det_id", F.col("cls").alias("new_cls"), "tag", F.lit("bubble_ocr").alias("tag_method"), distance_confidence(F.col("dist"), window_max).alias("tag_confidence"))
    done = done.unionByName(window)
    has = cands.select("project", "cls", F.lit(True).alias("has")).distinct()
    out = dets.join(done, "det_id", "left").join(has, ["project", "cls"], "left")
    return out.select("det_id", F.coalesce("new_cls", "cls").alias("cls"), F.col("cls").alias("original_cls"), "tag", F.coalesce("tag_method", F.lit("none")).alias("tag_method"), F.round(F.coalesce("tag_confidence", F.lit(0.0)), 6).alias("tag_confidence"), F.when(F.col("tag").isNull(), F.when(F.col("has"), "has_candidates_unmatched").otherwise("no_candidate_tags")).alias("untagged_reason"))


def split_bubble_pairs(bubbles: DataFrame, dx: float = 60.0, dy: float = 80.0, most: int = 4) -> DataFrame:
    """Texts of two close bubbles joined in both orders, for every ordered pair; originals are not included.

    A side must be all letters; texts are at most ``most`` long; coincident bubbles are no pair.
    """
    letters = F.col("text").rlike("^[A-Za-z]+$")
    b = bubbles.where(F.length("text") <= most).select("project", "page", "bubble_id", "x", "y", "text", letters.alias("letters"))
    # cells of several windows' size, so that few windows touch more than one; letters, the lesser part, are repeated
    w, h = 4 * dx, 4 * dy
    at = lambda c, side: F.floor(c / F.lit(side)).cast("bigint")
    on = ["project", "page", "_gx", "_gy"]
    left = b.select("project", "page", F.col("bubble_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("text").alias("ta"), F.col("letters").alias("la"), at(F.col("x"), w).alias("_gx"), at(F.col("y"), h).alias("_gy"))
    right = b.where("letters").select("project", "page", F.col("bubble_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("text").alias("tb"))
    right = right.withColumn("_gx", F.explode(F.sequence(at(F.col("bx") - dx, w), at(F.col("bx") + dx, w)))).withColumn("_gy", F.explode(F.sequence(at(F.col("by") - dy, h), at(F.col("by") + dy, h))))
    # a bound without counting the cells by themselves: those that share a hash are counted as one, the windows that
    # touch a cell start in it or in one of its eight neighbours
    n, few = left.groupBy(F.pmod(F.xxhash64(*on), F.lit(1 << 22))).agg(F.count("*").alias("n"), F.count_if("la").alias("few")).agg(F.max("n"), F.max("few")).first()
    if (n or 0) * 9 * (few or 0) > DENSE:
        left, right, on = _salted(left, right, on)
    near = (F.col("a") != F.col("b")) & (F.abs(F.col("ax") - F.col("bx")) <= dx) & (F.abs(F.col("ay") - F.col("by")) <= dy) & ((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    texts = [F.concat("ta", "tb"), F.concat("tb", "ta")]
    pair = lambda a, b: [F.struct(F.col(a).alias("a"), F.col(b).alias("b"), t.alias("text")) for t in texts]
    # the right side is all letters; where the left one is not, the pair comes up in this order only
    both = F.explode(F.when(F.col("la"), F.array(*pair("a", "b"))).otherwise(F.array(*pair("a", "b"), *pair("b", "a")))).alias("p")
    return left.join(right, on).where(near).select("project", "page", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), both).select("project", "page", "p.a", "p.b", "x", "y", "p.text")


def label_values(labels: DataFrame, values: DataFrame, by: list[str], cell: float = 128.0) -> DataFrame:
    """(by.., label_id, value_id, text, h): for every label the value above it (preferred) or to its right.

    labels(by.., label_id, cx, cy, w, h); values(by.., value_id, cx, cy, h, text). Display space: y grows
    downwards, so above means a smaller y. The windows grow with the label's size; above, the nearest and
    tallest text wins, to the right the nearest; ties go to the least value_id.
    """
    lh, lw = F.greatest("h", F.lit(6.0)), F.greatest("w", F.lit(30.0))
    lhs = labels.select(*by, "label_id", F.col("cx").alias("lx"), F.col("cy").alias("ly"), lh.alias("lh"), lw.alias("lw"))
    # one window holds both: above over the full width, to the right on the same line
    lhs = lhs.withColumns({"wx1": F.col("lx") - F.greatest(F.col("lw") * 3, F.lit(120.0)), "wx2": F.col("lx") + F.greatest(F.col("lw") * 4, F.lit(120.0)), "wy1": F.col("ly") - F.col("lh") * 6, "wy2": F.col("ly") + F.col("lh") * 0.6})
    j = window_join(lhs, values.select(*by, "value_id", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("h").alias("vh"), "text"), by, cell)
    dx, dy = F.col("px") - F.col("lx"), F.col("py") - F.col("ly")
    wide = F.greatest(F.col("lw") * 3, F.lit(120.0))
    above = (F.abs(dx) <= wide) & (dy > -F.col("lh") * 6) & (dy < -F.col("lh") * 0.2)
    right = (F.abs(dy) <= F.col("lh") * 0.6) & (dx > 0) & (dx < F.col("lw") * 4)
    j = j.withColumn("branch", F.when(above, 0).when(right, 1)).where("branch is not null")
    score = F.when(F.col("branch") == 0, F.abs(dy) - F.col("vh") * 2).otherwise(dx)
    best = j.groupBy(*by, "label_id").agg(F.min_by(F.struct("value_id", "text", F.col("vh").alias("h")), F.struct("branch", score.alias("score"), "value_id")).alias("b"))
    return best.select(*by, "label_id", "b.value_id", "b.text", "b.h")
