"""All queries of the core library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallysheet.plans import box_queries, extra_queries, general, pipeline_queries, score_queries, text_queries

MODULES = (general, text_queries, box_queries, score_queries, pipeline_queries, extra_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        clash = out.keys() & m.QUERIES.keys()
        if clash:
            raise ValueError(f"queries named twice: {sorted(clash)}")
        out |= m.QUERIES
    return out


# Sums of integers, which the SQL engine returns in a wider type than a Spark bigint.
SUMS = {
    "class_alias_survey": ("total_count",),
    "confusion_matrix": ("predicted_total", "actual_total"),
    "overlap_score": ("team_total", "our_total", "matched"),
    "overlap_score_by_tag": ("team_total", "our_total", "matched"),
    "per_product_delta": ("team", "ours", "delta"),
    "quantity_sets": ("qty",),
    "health_gate": ("no_candidate", "unmatched"),
    "batch_totals": ("detections", "tagged"),
    "takeoff_rollup": ("qty",),
    "line_islands": ("line",),
    "edge_clusters": ("cluster",),
    "leaderboard": ("tagged", "detections"),
    "cross_version": ("before", "after"),
}


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLES
    for name, columns in SUMS.items():
        out[name] = f"SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in columns)}) FROM ({out[name]}) AS q"
    return out
