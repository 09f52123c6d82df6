"""Quantities recorded in different units, brought to common units.

Method: every way of stating a unit is a *source*: (quantity, unit text). The same kind of equipment
(entity: the letters of its mark) links the sources of one quantity. The hub of a quantity are the
sources that state its common unit or nothing. Every other source is compared, kind by kind, with the
sources converted so far: the weighted median over the kinds of the log ratios of robust levels gives the
scale, for quantities with offsets the ratio of spreads and the distance of medians give scale and offset.
The estimate is snapped to a known conversion, and the source then serves to convert further ones, until
none is added, so conversions spread over the source graph.

A listed unit text is a prior: it is confirmed where the estimate allows it (``SNAP_TOLERANCE`` beyond the
estimate's own noise) and overruled where many linked rows contradict it and another conversion fits. A
listed text with fewer than ``MIN_LINKS`` linked rows keeps its meaning; an unlisted one with so few, or near
no known conversion, is left to the next statement.

``common_units`` names the quantities, their common units and their property names. A quantity without
known units has its common unit and thousands of it as known conversions; a common unit that is no known
unit of a known quantity is refused.

Everything but the small unit vocabulary runs as built-in column expressions.

Defined results: NULL properties, NULL or empty values, place-holders without a number and
properties of no known quantity give no row; an empty table gives an empty result; repeated rows
give repeated rows here (``p2_found`` is distinct); extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.session import cut, written

# Quantity -> unit -> (scale to the common unit, offset, spellings without blanks, dots, hyphens).
# common value = number * scale + offset
UNITS: dict[str, dict[str, tuple[float, float, tuple[str, ...]]]] = {
    "airflow": {
        "CFM": (1.0, 0.0, ("CFM", "CUFT/MIN", "CUFT/M", "FT3/MIN", "FT3/M", "CUBICFEETPERMINUTE", "CUFTPERMIN", "ACFM", "SCFM")),
        "L/S": (2.118880003, 0.0, ("L/S", "LPS", "L/SEC", "LITERS/SEC", "LITRES/SEC", "LITER/SEC", "LITERS/S", "LITRES/S", "LITERSPERSECOND")),
        "M3/H": (0.5885777786, 0.0, ("M3/H", "M3/HR", "CMH", "CUM/HR", "CUM/H", "M3H", "M3PERHOUR")),
        "M3/S": (2118.880003, 0.0, ("M3/S", "M3/SEC", "CMS", "CUM/S", "CUM/SEC")),
        "CFM X 1000": (1000.0, 0.0, ("CFMX1000", "X1000CFM", "KCFM", "THOUSANDCFM", "1000CFM", "CFM(X1000)", "CFMTHOUSANDS", "CFM/1000", "1000SCFM")),
        "M3/MIN": (35.31466672, 0.0, ("M3/MIN", "CMM", "CUM/MIN")),
    },
    "static pressure": {
        "IN WG": (1.0, 0.0, ("INWG", "INWC", "INH2O", "IWC", "IWG", '"WG', '"WC', '"H2O', '"', "INCHESWG", "INCHESWC", "INCHWG", "INCHWC", "INCHESOFWATER", "INCHESH2O", "INCHESWATER", "INCHESOFWATERGAUGE", "INCHESOFWATERCOLUMN", "INOFWATER", "INWATER", "''WG", "''WC", "IN", "INCH", "INCHES", "WG", "WC")),
        "PA": (0.00401463078662, 0.0, ("PA", "PASCAL", "PASCALS")),
        "KPA": (4.01463078662, 0.0, ("KPA", "KILOPASCAL", "KILOPASCALS")),
        "MM H2O": (0.0393700787, 0.0, ("MMH2O", "MMWC", "MMWG", "MMWATER", "MMOFWATER", "MMWATERCOLUMN")),
        "PSI": (27.679904, 0.0, ("PSI",)),
        "MBAR": (0.401463078662, 0.0, ("MBAR", "HPA")),
    },
    "motor power": {
        "HP": (1.0, 0.0, ("HP", "BHP", "HORSEPOWER")),
        "W": (0.00134102209, 0.0, ("W", "WATT", "WATTS")),
        "KW": (1.34102209, 0.0, ("KW", "KILOWATT", "KILOWATTS")),
    },
    "heat rate": {
        "MBH": (1.0, 0.0, ("MBH", "MBTUH", "MBTU/H", "MBTU/HR", "KBTUH", "KBTU/H", "KBTU/HR", "1000BTUH", "1000BTU/H", "1000BTU/HR", "BTUHX1000")),
        "BTUH": (0.001, 0.0, ("BTUH", "BTU/H", "BTU/HR", "BTU/HOUR", "BTUPERHOUR", "BTUHR")),
        "KW": (3.412141633, 0.0, ("KW", "KILOWATT", "KILOWATTS")),
        "W": (0.003412141633, 0.0, ("W", "WATT", "WATTS")),
        "TONS": (12.0, 0.0, ("TON", "TONS", "TR", "RT", "TONSR", "TONSREFRIGERATION", "TONSOFREFRIGERATION", "REFRIGERATIONTONS", "REFTONS")),
    },
    "weight": {
        "LB": (1.0, 0.0, ("LB", "LBS", "POUND", "POUNDS", "#", "LBM")),
        "KG": (2.20462262185, 0.0, ("KG", "KGS", "KILO", "KILOS", "KILOGRAM", "KILOGRAMS")),
        "SHORT TONS": (2000.0, 0.0, ("SHORTTON", "SHORTTONS", "SHTON", "SHTONS", "TON", "TONS", "USTON", "USTONS")),
        "T": (2204.62262185, 0.0, ("T", "TONNE", "TONNES", "METRICTON", "METRICTONS")),
    },
    "temperature": {
        "DEG F": (1.0, 0.0, ("F", "DEGF", "°F", "ºF", "DEGREESF", "FAHRENHEIT", "DEGREESFAHRENHEIT", "DEG", "°", "DEGREES")),
        "DEG C": (1.8, 32.0, ("C", "DEGC", "°C", "ºC", "DEGREESC", "CELSIUS", "DEGREESCELSIUS", "CENTIGRADE")),
        "K": (1.8, -459.67, ("K", "KELVIN", "DEGK")),
    },
    "water flow": {
        "GPM": (1.0, 0.0, ("GPM", "GAL/MIN", "GALLONS/MIN", "USGPM", "GALLONSPERMINUTE", "GAL/M")),
        "L/S": (15.850323141, 0.0, ("L/S", "LPS", "L/SEC", "LITERS/SEC", "LITRES/SEC", "LITERS/S")),
        "L/MIN": (0.26417205236, 0.0, ("L/MIN", "LPM", "LITERS/MIN", "LITRES/MIN")),
        "M3/H": (4.40286754, 0.0, ("M3/H", "M3/HR", "CMH", "CUM/HR", "CUM/H")),
    },
    "neck size": {
        "IN": (1.0, 0.0, ("IN", "INCH", "INCHES", '"', "''", '"Ø', '"DIA', "INØ", '"ROUND', "INDIA")),
        "MM": (0.0393700787, 0.0, ("MM", "MILLIMETERS", "MILLIMETRES", "MMØ")),
        "CM": (0.393700787, 0.0, ("CM", "CENTIMETERS", "CENTIMETRES")),
        "FT": (12.0, 0.0, ("FT", "FEET", "FOOT", "'")),
        "M": (39.3700787, 0.0, ("M", "METER", "METERS", "METRE", "METRES")),
    },
}
# Words by which a note or a schedule name speaks of a quantity.
NOTE_WORDS = {
    "airflow": r"AIR\s?FLOWS?|AIR\s?VOLUMES?|SUPPLY\s?AIR",
    "static pressure": r"(?:STATIC\s)?PRESSURES?(?:\sDROPS?)?|STATICS?|ESP",
    "motor power": r"MOTORS?(?:\s(?:POWERS?|SIZES?))?",
    "heat rate": r"CAPACIT(?:Y|IES)|HEATING|COOLING|HEAT\sRATES?",
    "weight": r"WEIGHTS?",
    "temperature": r"TEMPERATURES?|TEMPS?",
    "water flow": r"WATER\s?FLOWS?|HW\sFLOWS?|FLOW\sRATES?",
    "neck size": r"NECKS?(?:\sSIZES?)?|INLETS?(?:\sSIZES?)?",
}
MIN_LINKS = 8  # linked rows below which nothing is estimated
OVERRULE_LINKS = 64  # linked rows from which an estimate may overrule a listed text
SNAP_TOLERANCE = 0.30  # |log ratio| within which an estimate snaps to a known conversion
MAX_NAMES = 1000  # property names in common_units, a small configuration table


@dataclass(frozen=True)
class Vocabulary:
    """Known conversions to the common units, and the spellings that are listed for them.

    units: quantity -> unit -> (scale, offset); common: quantity -> unit; labels: quantity -> spelling -> unit;
    names: property name -> quantity.
    """

    units: dict[str, dict[str, tuple[float, float]]]
    common: dict[str, str]
    labels: dict[str, dict[str, str]]
    names: dict[str, str]

    def listed(self) -> list[str]:
        return [f"{q}\u0001{label}" for q, ls in self.labels.items() for label in ls]

    def note_words(self, quantity: str) -> str:
        own = [quantity, *(n for n, q in self.names.items() if q == quantity)]
        return NOTE_WORDS.get(quantity) or "|".join(re.escape(w.upper()).replace(r"\ ", r"\s") for w in own)


def plain_unit(text: str) -> str:
    """canonical_unit of a plain text."""
    t = text.translate(str.maketrans("³²₂ºμ–—−×”“’‘″′", "322°µ---X\"\"''\"'")).upper()
    return re.sub(r"[\s\u00a0._,;:\[\]()\-]+", "", t)


def vocabulary(common_units: DataFrame, listed: bool = True) -> Vocabulary:
    """The vocabulary of a configuration table; without ``listed`` only the common unit's own name is listed."""
    rows = common_units.where("quantity is not null and common_unit is not null").select("quantity", "common_unit", "prop_names").limit(MAX_NAMES + 1).collect()
    names = {n.upper(): r["quantity"] for r in rows for n in r["prop_names"] or [] if n}
    if len(rows) > MAX_NAMES or len(names) > MAX_NAMES:
        raise ValueError(f"common_units must stay a small configuration table (at most {MAX_NAMES} names)")
    units: dict[str, dict[str, tuple[float, float]]] = {}
    common: dict[str, str] = {}
    labels: dict[str, dict[str, str]] = {}
    for r in rows:
        q, told = r["quantity"], plain_unit(r["common_unit"])
        known = UNITS.get(q) or {r["common_unit"]: (1.0, 0.0, (told,)), f"{r['common_unit']} X 1000": (1000.0, 0.0, (f"{told}X1000", f"X1000{told}"))}
        hub = next((u for u, (_, _, spelt) in known.items() if told in spelt or told == plain_unit(u)), None)
        if hub is None:
            raise ValueError(f"common unit {r['common_unit']!r} of {q!r} is no known unit")
        scale0, offset0, _ = known[hub]
        units[q] = {u: (scale / scale0, (offset - offset0) / scale0) for u, (scale, offset, _) in known.items()}
        common[q] = hub
        labels[q] = {sp: u for u, (_, _, spelt) in known.items() for sp in spelt} if listed else {told: hub}
    return Vocabulary(units, common, labels, names)


def canonical_unit(text: Column) -> Column:
    """Unit text without case, blanks, dots, hyphens, underscores and brackets; powers as digits."""
    t = F.upper(F.translate(text, "³²₂ºμ–—−×”“’‘″′", "322°µ---X\"\"''\"'"))
    return F.regexp_replace(t, r"[\s\u00a0._,;:\[\]()\-]+", "")


def _number(text: Column) -> Column:
    """1,250 / 1 250 / 0,908 / 1-1/2 / 3/4 / 12.5 as double; NULL when it holds no number."""
    mixed = F.regexp_extract(text, r"^(\d+)[\s\u00a0-]+(\d+)/(\d+)$", 0) != ""
    plain = F.regexp_replace(text, r"[\s\u00a0]", "")
    frac = lambda s, a, b: F.try_divide(F.regexp_extract(s, r"(\d+)/(\d+)$", a).try_cast("double"), F.regexp_extract(s, r"(\d+)/(\d+)$", b).try_cast("double"))
    thousands = plain.rlike(r"^[-+]?[1-9]\d{0,2}(,\d{3})+(\.\d+)?$")
    return (
        F.when(text.rlike(r"^\d+(?:\.\d+)?$"), text.try_cast("double"))  # most are plain
        .when(mixed, F.regexp_extract(text, r"^(\d+)", 1).try_cast("double") + frac(text, 1, 2))
        .when(plain.rlike(r"^\d+/\d+$"), frac(plain, 1, 2))
        .when(thousands, F.regexp_replace(plain, ",", "").try_cast("double"))
        .otherwise(F.regexp_replace(plain, ",", ".").try_cast("double"))
    )


_NUM = r"[-+]?(?:\d+[\s\u00a0-]+\d+/\d+|\d+/\d+|\d{1,3}(?:[ \u00a0,]\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+)"
_VALUE = rf"^[\s\u00a0Øø~≈<>=±]*({_NUM})[\s\u00a0]*([^()]*?)[\s\u00a0]*(?:\((.*)\))?[\s\u00a0]*$"


STATEMENTS = "var_id bigint, prop_name string, quantity string, kind string, num double, value_label string, alt_label string, name_label string, note_label string"


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def unit_statements(tag_variables: DataFrame, v: Vocabulary) -> DataFrame:
    """One row per property of a known quantity that holds a number, with what is said of its unit.

    Notes are searched only where neither the value nor the property's name has a listed unit text.
    """
    if not v.names:
        return tag_variables.sparkSession.createDataFrame([], STATEMENTS)
    quantity_of = _lit_map(v.names)
    # the longest known name that the key begins with, whatever stands between its words
    by_length = sorted(v.names, key=len, reverse=True)
    begins = r"^[^A-Z]*+(?:" + "|".join("[^A-Z]+".join(map(re.escape, n.split())) for n in by_length) + r")(?![A-Z])"
    spelt_names = {n.upper(): re.sub("[^A-Z]+", " ", n.upper()).strip() for n in v.names}
    quantity_of = _lit_map({spelt_names[n]: q for n, q in v.names.items()})
    # one-row generators keep the optimizer from repeating the expressions below wherever they are used
    entries = F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.regexp_extract(F.upper(e["key"]), begins, 0).alias("lead")))
    kept = tag_variables.where("properties is not null").select("var_id", "tag", "schedule_name", F.inline(F.array(F.struct(entries.alias("entries")))))
    notes = F.concat_ws(" ; ", F.col("schedule_name"), F.array_join(F.transform(F.filter("entries", lambda e: (e["lead"] == "") & e["value"].isNotNull()), lambda e: e["value"]), " ; "))
    rows = kept.select("var_id", "tag", F.upper(notes).alias("notes"), F.explode(F.filter("entries", lambda e: (e["lead"] != "") & e["value"].rlike(r"\d"))).alias("e"))
    # number, unit text and bracketed text of a value by one expression; no match, no parts
    parts = F.split(F.regexp_replace("e.value", _VALUE, "$1\u0001$2\u0001$3"), "\u0001")
    base = F.trim(F.regexp_replace("e.lead", "[^A-Z]+", " "))
    tail = F.substr(F.upper("e.key"), F.length("e.lead") + 1)
    rows = rows.select("var_id", "tag", "notes", "e.key", F.inline(F.array(F.struct(parts.alias("p"), base.alias("base"), tail.alias("tail")))))
    rows = rows.where("size(p) = 3").withColumn("quantity", F.try_element_at(quantity_of, F.col("base")))
    listed = v.listed()
    is_listed = lambda label: F.concat("quantity", F.lit("\u0001"), label).isin(*listed)
    own = is_listed(F.col("base")) & (F.trim("tail") == "")  # the name is itself a unit (CFM, HP)
    value_label = canonical_unit(F.get("p", F.lit(1)))
    name_label = F.when(own, F.col("base")).otherwise(canonical_unit(F.col("tail")))
    once = lambda **cols: F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    rows = rows.select("*", once(num=_number(F.trim(F.get("p", F.lit(0)))))).where("num is not null")
    alt = F.when(F.get("p", F.lit(2)) == "", F.lit("")).otherwise(canonical_unit(F.regexp_replace(F.get("p", F.lit(2)), rf"^[\sØ]*{_NUM}", "")))
    rows = rows.select("*", once(value_label=value_label, alt_label=alt, name_label=name_label))
    note_unit = F.lit("")
    for q in v.common:
        said = F.regexp_extract("notes", rf"\b(?:{v.note_words(q)})\b\s*(?:ARE|IN|AS|GIVEN\s+AS|GIVEN\s+IN|ARE\s+IN|ARE\s+GIVEN\s+AS|:|=|-)?\s+([A-Z°\"'#][^;,()]*?)\s*(?:\bAND\b|[;,()]|$)", 1)
        note_unit = F.when(F.col("quantity") == q, said).otherwise(note_unit)
    silent = ~is_listed(F.col("value_label")) & ~is_listed(F.col("name_label"))
    rows = rows.select("*", once(said=F.when(silent, note_unit).otherwise(F.lit(""))))
    return rows.select(
        "var_id",
        F.col("key").alias("prop_name"),
        "quantity",
        F.coalesce(F.nullif(F.upper(F.regexp_extract("tag", r"([A-Za-z]+)\s*-", 1)), F.lit("")), F.lit("?")).alias("kind"),
        "num",
        "value_label",
        "alt_label",
        "name_label",
        F.when(F.col("said") == "", F.lit("")).otherwise(canonical_unit(F.col("said"))).alias("note_label"),
    )


SOURCES = "quantity string, label string, links bigint, est_scale double, est_offset double, misfit double, unit string, scale double, offset double, decided string"


def source_conversions(statements: DataFrame, v: Vocabulary) -> DataFrame:
    """(quantity, label) -> linked rows, estimated scale and offset, the conversion snapped to, and how it was
    decided: ``hub``, ``confirmed`` (the listed text and the estimate agree), ``overruled`` (the estimate
    contradicts the listed text), ``estimated`` (no listed text) or ``text`` (listed, too few links to judge).

    Levels are gathered per quantity, unit text and kind, so the sources of a kind meet in one reference of
    that kind and there are no pairs of sources. Rounds go on until no source is added.
    """
    spark = statements.sparkSession
    # the label that a row is read by: value, else name, else note, else none
    said = statements.select("quantity", "kind", "num", F.coalesce(F.nullif("value_label", F.lit("")), F.nullif("name_label", F.lit("")), F.nullif("note_label", F.lit("")), F.lit("")).alias("label"))
    quarters = F.percentile_approx("num", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000))
    levels = cut(said.where("num <> 0").groupBy("quantity", "kind", "label").agg(F.count("*").alias("n"), quarters.alias("q")))
    shifted = [q for q, us in v.units.items() if any(off for _, off in us.values())]  # quantities with offsets
    units = F.broadcast(spark.createDataFrame([(q, u, s, o) for q, us in v.units.items() for u, (s, o) in us.items()], "quantity string, unit string, scale double, offset double"))  # the fixed vocabulary
    texts = F.broadcast(spark.createDataFrame([(q, la, u, *v.units[q][u], u == v.common[q]) for q, ls in v.labels.items() for la, u in ls.items()], "quantity string, label string, text_unit string, text_scale double, text_offset double, is_hub boolean"))
    common = F.try_element_at(_lit_map(v.common), "quantity")
    hub = levels.select("quantity", "label").distinct().join(texts, ["quantity", "label"], "left").where("label = '' or is_hub")
    known = cut(hub.select("quantity", "label", F.lit(None).cast("bigint").alias("links"), F.lit(1.0).alias("est_scale"), F.lit(0.0).alias("est_offset"), F.lit(0.0).alias("misfit"), common.alias("unit"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit("hub").alias("decided")))
    log = lambda x: F.log(F.when(F.abs(x) > 0, F.abs(x)))

    def estimates(left: DataFrame, known: DataFrame) -> DataFrame:
        """Per source: links, log scale by levels, log scale by spreads, its own and the reference's median, noise."""
        at = levels.join(known.select("quantity", "label", "scale", "offset"), ["quantity", "label"])
        turned = F.transform("q", lambda x: x * F.col("scale") + F.col("offset"))
        ref = at.select("quantity", "kind", "n", F.posexplode(turned).alias("i", "x")).groupBy("quantity", "kind", "i").agg(F.percentile("x", 0.5, F.col("n")).alias("x"), F.sum("n").alias("ref_n"))
        ref = ref.groupBy("quantity", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("r"), F.max("ref_n").alias("ref_n"))  # three quartiles
        j = left.join(ref, ["quantity", "kind"])
        spread = lambda c: F.get(c, F.lit(2)) - F.get(c, F.lit(0))
        level = sum((log(F.get("r", F.lit(i))) - log(F.get("q", F.lit(i))) for i in range(3)), F.lit(0.0)) / 3
        both = F.least("n", "ref_n")
        wide = (log(F.get("r", F.lit(2))) - log(F.get("r", F.lit(0)))) / 1.35
        return j.groupBy("quantity", "label").agg(
            F.sum(both).alias("links"),
            F.percentile(level, 0.5, both).alias("by_level"),
            F.percentile(log(spread("r")) - log(spread("q")), 0.5, both).alias("by_spread"),
            F.percentile(F.get("q", F.lit(1)), 0.5, both).alias("mid"),
            F.percentile(F.get("r", F.lit(1)), 0.5, both).alias("ref_mid"),
            (F.percentile(wide, 0.5, both) / F.sqrt(F.sum(both))).alias("noise"),
        )

    while True:
        left = levels.join(known.select("quantity", "label"), ["quantity", "label"], "left_anti")
        est = estimates(left, known).where(F.col("links") >= MIN_LINKS)
        moved = F.col("quantity").isin(*shifted) if shifted else F.lit(False)
        est = est.withColumn("est_scale", F.exp(F.when(moved, F.col("by_spread")).otherwise(F.col("by_level")))).withColumn("est_offset", F.when(moved, F.col("ref_mid") - F.col("est_scale") * F.col("mid")).otherwise(F.lit(0.0)))
        # how far a known conversion is from the estimate
        far = F.when(moved, F.abs(log(F.col("ref_mid")) - log(F.col("mid") * F.col("scale") + F.col("offset"))) + F.abs(F.col("by_spread") - F.log("scale"))).otherwise(F.abs(F.col("by_level") - F.log("scale")))
        near = F.coalesce(far, F.lit(99.0))
        fits = est.join(units, "quantity").withColumn("far", near)
        best = fits.groupBy("quantity", "label", "links", "est_scale", "est_offset", "noise").agg(F.min_by(F.struct("unit", "scale", "offset"), F.struct("far", "unit")).alias("b"), F.min("far").alias("far"), F.map_from_entries(F.collect_list(F.struct("unit", "far"))).alias("all"))  # units of one quantity
        j = best.join(texts, ["quantity", "label"], "left").withColumn("text_far", F.try_element_at("all", F.col("text_unit")))
        # the tolerance grows with the estimate's own noise: few rows say little
        limit = F.lit(SNAP_TOLERANCE) + 2 * F.coalesce("noise", F.lit(0.0))
        contradicted = F.col("text_unit").isNotNull() & (F.col("text_far") > limit) & (F.col("far") <= SNAP_TOLERANCE) & (F.col("links") >= OVERRULE_LINKS)
        by_text = F.col("text_unit").isNotNull() & ~contradicted
        new = j.where(by_text | (F.col("far") <= limit)).select(
            "quantity", "label", "links", "est_scale", "est_offset",
            F.when(by_text, F.col("text_far")).otherwise(F.col("far")).alias("misfit"),
            *[F.when(by_text, F.col(f"text_{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("unit", "scale", "offset")],
            F.when(by_text, "confirmed").when(contradicted, "overruled").otherwise("estimated").alias("decided"),
        )
        new = cut(new)
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
    # listed texts that are too rare to judge, or stand only beside another statement, keep their meaning
    rest = texts.join(known.select("quantity", "label"), ["quantity", "label"], "left_anti")
    none = lambda t: F.lit(None).cast(t)
    return known.unionByName(rest.select("quantity", "label", none("bigint").alias("links"), none("double").alias("est_scale"), none("double").alias("est_offset"), none("double").alias("misfit"), F.col("text_unit").alias("unit"), F.col("text_scale").alias("scale"), F.col("text_offset").alias("offset"), F.lit("text").alias("decided")))


def harmonise_units(tag_variables: DataFrame, common_units: DataFrame, listed: bool = True) -> DataFrame:
    """Every quantity property as a number in its common unit.

    Columns: var_id, prop_name, quantity, number, unit (as recorded), stated_in, common_value,
    also_common (the value also states the common unit), foreign (recorded in another unit).
    The order of belief is value, property name, note or schedule name, common unit.
    """
    v = vocabulary(common_units, listed)
    # read by the estimate and by the result: parsed once, and both plans stay small
    st = written(unit_statements(tag_variables, v), "unit-statements")
    conv = cut(source_conversions(st, v))
    # the table of sources is tiny beside the rows; AQE broadcasts it after seeing its size
    side = lambda p: conv.where("label <> ''").select("quantity", F.col("label").alias(f"{p}_label"), F.col("unit").alias(f"{p}_unit"), F.col("scale").alias(f"{p}_scale"), F.col("offset").alias(f"{p}_offset"))
    common = F.try_element_at(_lit_map(v.common), "quantity") if v.common else F.lit(None).cast("string")
    alt = conv.where((F.col("label") != "") & (F.col("unit") == common)).select("quantity", F.col("label").alias("alt_label"), F.lit(True).alias("alt_common"))
    j = st.join(side("value"), ["quantity", "value_label"], "left").join(side("name"), ["quantity", "name_label"], "left").join(side("note"), ["quantity", "note_label"], "left").join(alt, ["quantity", "alt_label"], "left")
    by_value = F.col("value_unit").isNotNull()
    pick = lambda what, default: F.when(by_value, F.col(f"value_{what}")).otherwise(F.coalesce(f"name_{what}", f"note_{what}", default))
    unit, scale, offset = pick("unit", common), pick("scale", F.lit(1.0)), pick("offset", F.lit(0.0))
    stated = F.when(by_value, "value").when(F.col("name_unit").isNotNull(), "name").when(F.col("note_unit").isNotNull(), "note").otherwise("nowhere")
    also = F.coalesce("alt_common", F.lit(False))
    return j.select(
        "var_id",
        "prop_name",
        "quantity",
        F.col("num").alias("number"),
        unit.alias("unit"),
        stated.alias("stated_in"),
        (F.col("num") * scale + offset).alias("common_value"),
        also.alias("also_common"),
        ((unit != common) & ~also).alias("foreign"),
    )
