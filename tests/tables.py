"""Table folders for robustness tests: empty tables, and tables with NULLs, repeats and clashing columns."""

from pyspark.sql import functions as F

NAMES = ("ls_boxes", "sample_per_project", "batch_results", "schedule_tables", "tag_variables", "detections", "documents", "eval_items", "sample_targets", "split_targets", "common_units", "makers", "pack_sizes")
FIXED = ("split_targets", "common_units", "pack_sizes")
CLASH = ("bucket", "signature", "label", "unit", "quantity", "kind", "job", "node", "component", "parent", "pre", "post", "position", "piece", "size", "container", "rank", "value", "cell", "start", "flag", "words", "key", "n", "e", "r", "a", "b")


def write(spark, src: str, out: str, how: str) -> str:
    for name in NAMES:
        t = spark.read.parquet(f"{src}/{name}.parquet")
        if how == "empty":
            t = t if name in FIXED else t.limit(0)
        else:
            few = t.limit(60)
            nulls = few.limit(5).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema])
            ids = few.limit(5).select(*[F.col(c) if i == 0 else F.lit(None).cast(t.schema[c].dataType).alias(c) for i, c in enumerate(t.columns)])
            t = t if name in FIXED else few.unionByName(few.limit(20)).unionByName(nulls).unionByName(ids)
            t = t.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in t.columns])
        t.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    return out
