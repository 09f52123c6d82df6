import random

from pyspark.sql import functions as F

from tallysheet.operators import aggregates as A


def test_means_that_end_in_half_a_place_do_not_depend_on_the_order(spark):
    rng = random.Random(4)
    hundredths = [rng.randrange(100) for _ in range(32)]
    assert sum(hundredths) == 1259  # mean 0.3934375, which sums of doubles miss on either side
    for order in (hundredths, hundredths[::-1], sorted(hundredths)):
        df = spark.createDataFrame([(i, "FAN", "1", v / 100) for i, v in enumerate(order)], "i int, cls string, tag string, conf double").coalesce(1)
        assert A.summary_by_tag(df).collect() == [("FAN", "1", 32, 0.393438)]


def test_mean_of_odd_confidences(spark):
    nan, inf = float("nan"), float("inf")
    data = [("A", None, None), ("B", "", 0.5), ("B", None, None), ("C", "1", 5000.0), ("C", "1", 0.5), ("D", "1", inf), ("D", "1", 1.0), ("E", "1", nan), ("E", "1", 1.0)]
    got = {r["cls"]: tuple(r)[1:] for r in A.summary_by_tag(spark.createDataFrame(data, "cls string, tag string, conf double")).withColumn("mean_conf", F.col("mean_conf").cast("string")).collect()}
    assert got == {"A": ("(no-tag)", 1, None), "B": ("(no-tag)", 2, "0.5"), "C": ("1", 2, "2500.25"), "D": ("1", 2, "Infinity"), "E": ("1", 2, "NaN")}
