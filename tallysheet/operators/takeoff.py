"""Takeoff assembly: counted rows with brand, model, sizes and remarks, and the flat detail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.maps import prop_lookup
from tallysheet.functions.strings import brand_model

GENERIC = ("AD-GRD",)


def detail_columns(props: Column) -> dict[str, Column]:
    """Brand, model, sizes, type, mounting and remark of a tag's properties (entries in order)."""
    get = lambda *k: F.coalesce(prop_lookup(props, list(k)), F.lit(""))
    both = get("MANUFACTURER & MODEL", "MAKE / MODEL", "MAKE/MODEL")
    split = brand_model(both)
    device, service = get("TYPE", "DESCRIPTION", "STYLE"), get("SERVICE", "DUTY", "APPLICATION")
    svc, dev = F.upper(service), F.upper(device)
    kind = F.when(F.contains(dev, F.lit("DIFF")), "DIFFUSER").when(F.contains(dev, F.lit("GRILLE")) | F.contains(dev, F.lit("REGISTER")), "GRILLE").otherwise(device)
    etype = (
        F.when(F.contains(svc, F.lit("SA")) | F.contains(svc, F.lit("SUPPLY")), F.trim(F.concat(F.lit("SUPPLY "), kind)))
        .when(svc.startswith("RA") | F.contains(svc, F.lit("RETURN")), F.trim(F.concat(F.lit("RETURN "), kind)))
        .when(F.contains(svc, F.lit("EXH")) | F.contains(svc, F.lit("EA")), F.trim(F.concat(F.lit("EXHAUST "), kind)))
        .otherwise(F.when(device != "", device).otherwise(service))
    )
    neck = get("NECK", "INLET")
    damper, material = get("DAMPER", "OBD"), get("MATERIAL")
    remark = F.concat_ws(", ", F.when(material != "", F.concat(F.lit("MATERIAL "), material)), F.when((damper != "") & ~F.upper(damper).isin("NO", "N", "NONE", "-"), F.concat(F.lit("DAMPER "), damper)))
    return {
        "brand": F.when(both != "", split["brand"]).otherwise(get("MANUFACTURER", "BRAND", "MAKE")),
        "model": F.when(both != "", split["model"]).otherwise(get("MODEL")),
        "neck_size": F.when(neck != "", neck).otherwise(get("SIZE")),
        "module_size": get("MODULE", "PANEL", "FACE SIZE", "OVERALL", "NOMINAL"),
        "duct_size": get("DUCT", "CONNECTION", "COLLAR"),
        "type": etype,
        "mounting": get("MOUNT", "CEILING TYPE"),
        "remark": remark,
    }


def product_of(cls: Column, tag_cls: Column) -> Column:
    """A generic class gives way to the specific class its tag is filed under."""
    return F.when(cls.isin(*GENERIC) & tag_cls.isNotNull() & ~tag_cls.isin(*GENERIC), tag_cls).otherwise(cls)


def assemble(tagged: DataFrame, details: DataFrame) -> DataFrame:
    """Rows per project, product and tag with count, pages and the tag's details, to be sorted by product and tag.

    tagged(project, page, cls, tag); details(project, tag, props, cls): the first occurrence of each tag.
    Classes become products before rows are counted, so a generic and a specific class of one tag are one
    row. A NULL or empty tag has no details; tags without details keep empty columns; an empty table gives nothing.
    """
    d = details.where("tag <> ''").select("project", "tag", "props", F.col("cls").alias("tag_cls"))
    j = tagged.select("project", "page", "cls", F.coalesce("tag", F.lit("")).alias("tag"))
    pages = j.groupBy("project", "cls", "tag", "page").agg(F.count("*").alias("n"))
    named = pages.join(d, ["project", "tag"], "left").withColumn("product", product_of(F.col("cls"), F.col("tag_cls")))
    g = named.groupBy("project", "product", "tag").agg(F.sum("n").alias("qty"), F.array_join(F.array_sort(F.collect_set(F.col("page") + 1)), ", ").alias("pages"), F.any_value("props").alias("props"))
    note = F.concat(F.lit("Pages: "), F.col("pages"))
    shown = {k: F.coalesce(v, F.lit("")) for k, v in detail_columns(F.col("props")).items()}
    shown["remark"] = F.when(shown["remark"] != "", F.concat(shown["remark"], F.lit(" | "), note)).otherwise(note)
    return g.select("project", "product", "tag", "qty", *[v.alias(k) for k, v in shown.items()])


def detail_rows(tagged: DataFrame, details: DataFrame) -> DataFrame:
    """The flat second sheet: one row per detection (det_id kept) with its product, quantity 1 and details."""
    d = details.where("tag <> ''").select("project", "tag", "props", F.col("cls").alias("tag_cls"))
    j = tagged.select("project", "page", "det_id", "cls", F.coalesce("tag", F.lit("")).alias("tag")).join(d, ["project", "tag"], "left")
    shown = {k: F.coalesce(v, F.lit("")) for k, v in detail_columns(F.col("props")).items()}
    return j.select("project", "page", "det_id", product_of(F.col("cls"), F.col("tag_cls")).alias("product"), "tag", F.lit(1).alias("qty"), *[v.alias(k) for k, v in shown.items()])
