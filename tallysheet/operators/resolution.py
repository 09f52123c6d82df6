"""Resolution of classes to the classes that tags are filed under, and tag fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.functions import dims
from tallysheet.functions.strings import value_fold


def _edges(spark) -> DataFrame:
    """(cls, candidate, prio, sure): direct 0, alias 1, sibling 2; a few dozen fixed rows."""
    rows = []
    classes = {*dims.DETECTOR_ALIAS, *(c for f in dims.CLASS_FAMILIES for c in f)}
    rows += [(c, c, 0, True) for c in classes]
    rows += [(c, a, 1, len(v) == 1) for c, v in dims.DETECTOR_ALIAS.items() for a in v]
    rows += [(c, s, 2, True) for f in dims.CLASS_FAMILIES for c in f for s in f]
    return spark.createDataFrame(rows, "cls string, candidate string, prio int, sure boolean")


def class_expansion(with_tags: DataFrame) -> DataFrame:
    """(cls, candidate, prio, sure) for the candidates that have tags; ``with_tags(cls)`` is distinct."""
    own = with_tags.select("cls", F.col("cls").alias("candidate"), F.lit(0).alias("prio"), F.lit(True).alias("sure"))
    fixed = F.broadcast(_edges(with_tags.sparkSession)).where("prio > 0").join(with_tags.select(F.col("cls").alias("candidate")), "candidate").select("cls", "candidate", "prio", "sure")
    return own.unionByName(fixed).distinct()


def class_resolution(with_tags: DataFrame) -> DataFrame:
    """(cls, resolved) for every known class; NULL where no class or more than one would do."""
    spark = with_tags.sparkSession
    known = _edges(spark).select("cls").distinct().unionByName(with_tags.select("cls")).distinct()
    e = class_expansion(with_tags)
    ambiguous = [c for c, v in dims.DETECTOR_ALIAS.items() if len(v) > 1]
    g = e.groupBy("cls").agg(
        F.max(F.when(F.col("prio") == 0, F.col("candidate"))).alias("direct"),
        F.max(F.when((F.col("prio") == 1) & F.col("sure"), F.col("candidate"))).alias("alias"),
        F.max(F.when(F.col("prio") == 2, F.col("candidate"))).alias("sibling"),
        F.count_distinct(F.when(F.col("prio") == 2, F.col("candidate"))).alias("siblings"),
    )
    r = known.join(g, "cls", "left")
    return r.select("cls", F.when(F.col("direct").isNotNull(), F.col("direct")).when(F.col("cls").isin(ambiguous), F.lit(None).cast("string")).otherwise(F.coalesce("alias", F.when(F.col("siblings") == 1, F.col("sibling")))).alias("resolved"))


def only_tag_per_class(variables: DataFrame) -> DataFrame:
    """(project, cls, tag) of classes with exactly one tag in a project."""
    g = variables.where("project is not null and cls is not null and tag is not null").groupBy("project", "cls").agg(F.min("tag").alias("tag"), F.max("tag").alias("other"))
    return g.where("tag = other").drop("other")


def _tokens(text) -> F.col:
    return F.filter(F.split(text, r"[\s/,]+"), lambda t: (F.length(t) >= 2) & t.rlike("[0-9]"))


def fingerprint_index(tag_variables: DataFrame, most: int = 2) -> DataFrame:
    """(project, tag, tok): tokens with a digit that stand on at most ``most`` tags of a project.

    The document frequency is counted per token and joined back; tokens are the key, so no project is
    gathered in one place.
    """
    t = tag_variables.where("tag is not null and project is not null").select("project", "tag", F.explode(F.map_values("properties")).alias("v"))
    fp = t.select("project", "tag", F.explode(_tokens(value_fold(F.col("v")))).alias("tok")).distinct()
    rare = fp.groupBy("project", "tok").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("project", "tok")
    return fp.join(rare, ["project", "tok"]).select("project", "tag", "tok")


def fingerprint_scores(rows: DataFrame, key: str, text: str, index: DataFrame) -> DataFrame:
    """(key, tag, score): distinct shared tokens of a row's text and a tag of its project."""
    words = rows.select(key, "project", F.explode(_tokens(F.col(text))).alias("tok")).distinct()
    return words.join(index, ["project", "tok"]).groupBy(key, "tag").agg(F.count("*").alias("score"))
