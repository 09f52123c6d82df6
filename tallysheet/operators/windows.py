"""Ordered procedures: fill-down, islands, runs, latest, n-grams, budgets.

A key may hold any share of all rows, so running state is not carried by one sorted pass per key: rows
are range-partitioned by key and order into blocks, each block is scanned on its own, and what a block
hands on (its sum, its last value, its last row) is carried over the few blocks of a key. Results are
those of a plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.session import cut


def blocked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows with ``_blk``: blocks of consecutive rows in (key, order), as many as the session shuffles into."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *[F.col(b) for b in by], *order).withColumn("_blk", F.spark_partition_id()))


def _carried(d: DataFrame, by: list[str], handed: Column, over, name: str) -> DataFrame:
    """d with ``name``: what the earlier blocks of a row's key hand on."""
    per = d.groupBy(*by, "_blk").agg(handed.alias("_v"))
    w = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    c = per.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_blk").alias("_b2"), over(F.col("_v")).over(w).alias(name))
    on = (d["_blk"] == c["_b2"]) & F.lit(True)
    for i, b in enumerate(by):
        on = on & d[b].eqNullSafe(c[f"_k{i}"])
    return d.join(c, on, "left").drop("_b2", *[f"_k{i}" for i in range(len(by))])


def running_sum(d: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of a value up to and with each row of a blocked frame; NULL before the first value."""
    w = Window.partitionBy("_blk", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = _carried(d.withColumn("_x", value), by, F.sum("_x"), F.sum, "_c")
    own = F.sum("_x").over(w)
    return d.withColumn(name, F.when(own.isNull() & F.col("_c").isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce("_c", F.lit(0)))).drop("_x", "_c")


def running_last(d: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last value that is not NULL up to and with each row of a blocked frame."""
    w = Window.partitionBy("_blk", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"_x": value, "_o": F.struct(*order)})
    d = _carried(d, by, F.max_by("_x", F.when(F.col("_x").isNotNull(), F.col("_o"))), lambda c: F.last(c, True), "_c")
    return d.withColumn(name, F.coalesce(F.last("_x", True).over(w), "_c")).drop("_x", "_o", "_c")


def previous(d: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Columns with the values of the row before, NULL at the first row of a key; a blocked frame."""
    w = Window.partitionBy("_blk", *by).orderBy(*order)
    d = d.withColumns({"_x": F.struct(*[c.alias(n) for n, c in values.items()]), "_o": F.struct(*order)})
    d = _carried(d, by, F.max_by("_x", "_o"), lambda c: F.last(c, True), "_c")
    return d.withColumn("_p", F.coalesce(F.lag("_x").over(w), "_c")).withColumns({n: F.col(f"_p.{n}") for n in values}).drop("_x", "_o", "_c", "_p")


def fill_down(df: DataFrame, by: list[str], order: str, value: Column, skip: Column, name: str = "filled") -> DataFrame:
    """The last non-blank value so far; rows to skip neither give nor reset it."""
    given = F.when((value.isNotNull()) & (F.trim(value) != "") & ~skip, value)
    return running_last(blocked(df, by, [F.col(order)]), by, [F.col(order)], given, name).drop("_blk")


def blank_repeats(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "shown") -> DataFrame:
    """A value only where it differs from the row before."""
    cols = [F.col(o) for o in order]
    d = previous(blocked(df, by, cols), by, cols, {"_prev": F.col(value), "_some": F.lit(True)})
    return d.withColumn(name, F.when(F.col("_some") & F.col("_prev").eqNullSafe(F.col(value)), F.lit("")).otherwise(F.col(value))).drop("_prev", "_some", "_blk")


def islands(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column], breaks: Column, name: str = "island") -> DataFrame:
    """Running number of the islands of a key; ``breaks`` says, from the row and ``values`` of the row before,
    whether a new one begins. The first row of a key always does."""
    d = previous(blocked(df, by, order), by, order, values)
    d = running_sum(d, by, order, F.coalesce(breaks, F.lit(True)).cast("int"), name)
    return d.drop("_blk", *values)


def line_islands(tokens: DataFrame, by: list[str], x: str, y: str, order: str, line_gap: float = 22.0, word_gap: float = 140.0) -> DataFrame:
    """Tokens in lines: sorted by rounded row and x, a line ends where y or x jumps."""
    keys = [F.bround(F.col(y) / F.lit(line_gap), 0), F.col(x), F.col(order)]
    jump = (F.abs(F.col(y) - F.col("_py")) > line_gap) | (F.col(x) - F.col("_px") > word_gap)
    return islands(tokens, by, keys, {"_px": F.col(x), "_py": F.col(y)}, jump, "line")


def edge_clusters(df: DataFrame, by: list[str], value: str, tolerance: int) -> DataFrame:
    """Edges chained while gaps stay within a tolerance; one integer mean per cluster.

    Equal edges are counted once before they are ordered.
    """
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    parts = islands(n, by, [F.col(value)], {"_pv": F.col(value)}, F.col(value) - F.col("_pv") > tolerance, "cluster")
    return parts.groupBy(*by, "cluster").agg(F.floor(F.sum(F.col(value) * F.col("n")) / F.sum("n")).cast("bigint").alias("edge"), F.sum("n").alias("members"))


def runs(df: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """Runs of consecutive positions with a true flag: first, last and centre ((first + last) div 2)."""
    on = islands(df.where(flag), by, [F.col(order)], {"_at": F.col(order)}, F.col(order) - F.col("_at") > 1, "_g")
    return on.groupBy(*by, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_g").withColumn("centre", F.floor((F.col("first") + F.col("last")) / 2).cast("bigint"))


def latest(df: DataFrame, by: list[str], at: str, order: str, valid: Column) -> DataFrame:
    """The latest valid row of each key, ties by ``order``; map-side combined, no window."""
    rest = [c for c in df.columns if c not in by]
    return df.where(valid).groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(at, order)).alias("_r")).select(*by, "_r.*")


def first_wins(df: DataFrame, by: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*by, "_r.*")


def last_wins(df: DataFrame, by: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*by, "_r.*")


def ngrams(tokens: DataFrame, by: list[str], order: str, text: str, most: int = 3) -> DataFrame:
    """Texts of 1 to ``most`` running tokens joined, each with its first position and length."""
    w = Window.partitionBy(*by).orderBy(order)
    wide = tokens.withColumns({f"_{k}": F.lead(text, k).over(w) for k in range(1, most)})
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.lit(True) if n == 1 else F.col(f"_{n - 1}").isNotNull(), F.concat(F.col(text), *[F.col(f"_{k}") for k in range(1, n)])).alias("gram")) for n in range(1, most + 1)])
    return wide.select(*by, order, F.explode(grams).alias("g")).select(*by, order, "g.n", "g.gram").where("gram is not null")


def budget_cut(df: DataFrame, by: list[str], order: list[str], cost: str, budget: float, name: str = "spent") -> DataFrame:
    """Rows in order while the running cost stays within a budget."""
    cols = [F.col(o) for o in order]
    return running_sum(blocked(df, by, cols), by, cols, F.col(cost), name).where(F.col(name) <= budget).drop("_blk")


def reserve(df: DataFrame, by: list[str], order: list[str], count: str, budget: float, each: float = 1.0, share: float = 0.5, name: str = "reserve") -> DataFrame:
    """What is to be kept back for the work found before: its count times a cost, at most a share of the budget."""
    cols = [F.col(o) for o in order]
    d = running_sum(blocked(df, by, cols), by, cols, F.col(count), "_upto")
    return d.withColumn(name, F.least((F.coalesce("_upto", F.lit(0)) - F.coalesce(count, F.lit(0))) * each, F.lit(share * budget))).drop("_upto", "_blk")
