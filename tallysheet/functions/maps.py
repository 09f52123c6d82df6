"""Array, map and nested-value functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysheet.functions.strings import collapse


def prop_lookup(entries: Column, keywords: list[str]) -> Column:
    """Value of the first entry, in entry order, whose key contains any keyword; NULL if none.

    ``entries`` is array<struct<key,value>>: a map's own order is not promised.
    """
    hit = F.filter(entries, lambda e: F.greatest(*[F.upper(collapse(e["key"])).contains(k.upper()) for k in keywords], F.lit(False)))
    return F.get(hit, F.lit(0))["value"]


def sorted_entries(m: Column) -> Column:
    """Entries of a map in key order."""
    return F.array_sort(F.map_entries(m))


def row_to_props(header: Column, cells: Column, skip: Column) -> Column:
    """array<struct<key,value>> of a row: blank headers become COL_i, blank cells and skipped columns go,
    of equal keys the last value stands at the place of the first."""
    zipped = F.transform(F.arrays_zip(header.alias("h"), cells.alias("c")), lambda z, i: F.struct(F.when(F.coalesce(collapse(z["h"]), F.lit("")) == "", F.concat(F.lit("COL_"), (i + 1).cast("string"))).otherwise(collapse(z["h"])).alias("key"), collapse(z["c"]).alias("value"), i.alias("i")))
    kept = F.filter(zipped, lambda z: z["value"].isNotNull() & (z["value"] != "") & ~F.array_contains(skip, z["i"]))
    keys = F.array_distinct(F.transform(kept, lambda z: z["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(kept, lambda z: z["key"] == k), -1)["value"].alias("value")))


def band_index(edges: Column, value: Column) -> Column:
    """Index of the half-open band [edge i, edge i+1) a value falls into; NULL outside."""
    at = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.when((at >= 0) & (at < F.size(edges) - 1), at)


def ordered_text(items: Column, sep: str = " ") -> Column:
    """Texts of array<struct<order, text>> joined in order."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["text"]), sep)


def sentence_tokens(c: Column) -> Column:
    """Tokens of a value: split at blanks, slashes and commas, stripped of dots and brackets."""
    return F.filter(F.transform(F.split(c, r"[\s /,]+"), lambda t: F.regexp_replace(t, r"^[.()]+|[.()]+$", "")), lambda t: t != "")


def token_rows(df, text: str, keep: list[str], name: str = "tok"):
    """The tokens of sentence_tokens as rows: the generator comes first, so trimming runs in compiled code."""
    rows = df.select(*keep, F.explode(F.split(F.col(text), r"[\s\u00a0/,]+")).alias("_t"))
    return rows.select(*keep, F.regexp_replace("_t", r"^[.()]+|[.()]+$", "").alias(name)).where(F.col(name) != "")


def upper_median(values: Column) -> Column:
    """The value at place n // 2 of the sorted values (the upper of two middle ones)."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.get(F.array_sort(kept), F.floor(F.size(kept) / 2).cast("int"))
