"""Scores, rollups, confusion matrices, funnels and batch totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.maps import upper_median


def overlap_score(rows: DataFrame, project: list[str], key: list[str], side: str, qty: str) -> DataFrame:
    """Per project: totals of both sides, matched quantity (sum of the lesser per key), recall, precision.

    One aggregation by key with both sides as columns replaces the full outer join of two; a side
    without rows gives NULL scores, a zero denominator 0.
    """
    per = rows.where(F.col(qty).isNotNull()).groupBy(*project, *key).agg(F.sum(F.when(F.col(side) == "team", F.col(qty))).alias("team"), F.sum(F.when(F.col(side) == "ours", F.col(qty))).alias("ours"))
    out = per.groupBy(*project).agg(F.coalesce(F.sum("team"), F.lit(0)).alias("team_total"), F.coalesce(F.sum("ours"), F.lit(0)).alias("our_total"), F.sum(F.least(F.coalesce("team", F.lit(0)), F.coalesce("ours", F.lit(0)))).alias("matched"), F.count("team").alias("_t"), F.count("ours").alias("_o"))
    scored = (F.col("_t") > 0) & (F.col("_o") > 0)
    ratio = lambda d: F.when(scored, F.coalesce(F.try_divide(F.col("matched"), F.col(d)), F.lit(0.0)))
    return out.withColumns({"recall": F.round(ratio("team_total"), 6), "precision": F.round(ratio("our_total"), 6)}).drop("_t", "_o")


def takeoff_rollup(dets: DataFrame, project: list[str]) -> DataFrame:
    """Counts and pages by class and tag with class totals and a grand total, by one ROLLUP.

    The pages of a group are joined as text; level is 0 for rows, 1 for class totals, 3 for the total.
    """
    base = dets.withColumn("tag", F.coalesce(F.nullif("tag", F.lit("")), F.lit("(no-tag)")))
    pages = base.groupBy(*project, "cls", "tag", "page").agg(F.count("*").alias("n"))  # pages once: bounded by pages, not by rows
    p = [F.col(c) for c in project]
    sets = [[*p, F.col("cls"), F.col("tag")], [*p, F.col("cls")], p]
    return pages.groupingSets(sets, *p, "cls", "tag").agg(F.sum("n").alias("qty"), F.array_join(F.array_sort(F.collect_set(F.col("page") + 1)), ",").alias("pages"), F.grouping_id().alias("level"))


def summary_by_tag(dets: DataFrame) -> DataFrame:
    """Count and mean confidence by class and tag.

    Confidences are added as decimals, so a mean that ends in half a place is rounded upward whatever the order of
    the rows; sums of doubles fall on either side of it. A group with a value beyond decimals (NaN, 1,000 or more)
    has the mean of its doubles.
    """
    exact = F.col("conf").try_cast("decimal(18,15)")
    mean = F.when(F.count(exact) == F.count("conf"), F.round(F.avg(exact), 6).cast("double")).otherwise(F.round(F.avg("conf"), 6))
    return dets.groupBy("cls", F.coalesce(F.nullif("tag", F.lit("")), F.lit("(no-tag)")).alias("tag")).agg(F.count("*").alias("n"), mean.alias("mean_conf"))


def confusion_matrix(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Counts of predicted x actual with marginals and shares of both."""
    c = pairs.groupBy(F.col(predicted).alias("predicted"), F.col(actual).alias("actual")).agg(F.count("*").alias("n"))
    p = c.groupBy("predicted").agg(F.sum("n").alias("predicted_total"))
    a = c.groupBy("actual").agg(F.sum("n").alias("actual_total"))
    return c.join(p, "predicted").join(a, "actual").select("predicted", "actual", "n", "predicted_total", "actual_total", F.round(F.col("n") / F.col("actual_total"), 6).alias("share_of_actual"))


def class_scores(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Recall and precision per class that occurs as truth."""
    both = pairs.select(F.explode(F.array(F.struct(F.col(actual).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(actual) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    g = both.where("cls is not null").groupBy("cls").agg(F.sum("t").alias("truth"), F.sum("p").alias("predicted"), F.sum("hit").alias("hits"))
    return g.where("truth > 0").select("cls", "truth", "predicted", "hits", F.round(F.col("hits") / F.col("truth"), 6).alias("recall"), F.round(F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)), 6).alias("precision"))


def error_pairs(pairs: DataFrame, predicted: str, actual: str, least: int = 5) -> DataFrame:
    """Unordered pairs of classes that are taken for each other at least ``least`` times."""
    wrong = pairs.where(F.col(predicted) != F.col(actual))
    return wrong.groupBy(F.least(predicted, actual).alias("class_a"), F.greatest(predicted, actual).alias("class_b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def verdict(score: Column) -> Column:
    return F.when(score >= 0.8, "good").when(score >= 0.6, "fair").when(score >= 0.3, "weak").when(score.isNotNull(), "poor")


def score_summary(scores: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Scored rows, upper median, mean, maximum and threshold counts.

    The values of a group are counted per distinct value first, so what is gathered for the median is
    bounded by the distinct scores (rounded to six places), not by the rows.
    """
    v = scores.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("v")).agg(F.count("*").alias("n"))
    total = v.groupBy(*by).agg(F.sum("n").alias("scored"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.max("v").alias("best"), F.sum(F.when(F.col("v") >= 0.5, F.col("n")).otherwise(0)).alias("half_or_more"))
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = v.withColumn("upto", F.sum("n").over(w)).join(total, by)
    return upto.where("upto > floor(scored / 2)").groupBy(*by, "scored", "mean", "best", "half_or_more").agg(F.min("v").alias("upper_median"))


def diagnostics(dets: DataFrame, by: list[str]) -> DataFrame:
    """Tagged and untagged detections by reason, per class and in all."""
    tagged = F.col("tag").isNotNull() & (F.col("tag") != "")
    g = dets.rollup(*by).agg(F.count("*").alias("total"), F.count_if(tagged).alias("tagged"), F.count_if(~tagged & (F.col("untagged_reason") == "no_candidate_tags")).alias("no_candidate"), F.count_if(~tagged & (F.col("untagged_reason") == "has_candidates_unmatched")).alias("unmatched"), F.grouping_id().alias("level"))
    return g


def health_gate(batch: DataFrame) -> DataFrame:
    """Untagged detections without candidate by how many tags the schedules gave."""
    gate = F.when(F.col("sched_tags") == 0, "0").when(F.col("sched_tags") < 10, "1-9").when(F.col("sched_tags") >= 10, "10+")
    return batch.groupBy(gate.alias("schedule_health")).agg(F.count("*").alias("plans"), F.sum("untag_no_cand").alias("no_candidate"), F.sum("untag_unmatched").alias("unmatched"))


def class_survey(counts: DataFrame) -> DataFrame:
    """Total count and number of projects per class."""
    return counts.groupBy("class").agg(F.sum("count").alias("total_count"), F.count_distinct("project").alias("project_count"))


def group_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Upper median per group for groups of bounded size."""
    return df.groupBy(*by).agg(upper_median(F.collect_list(value)).alias("upper_median"))
