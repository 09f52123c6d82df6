"""Queries of the general data-preparation operators (problems 2 to 5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallysheet.operators import nested_flatten, packed_split, schema_drift
from tallysheet.operators import unit_harmonise as U
from tallysheet.operators.unit_harmonise import harmonise_units, source_conversions, unit_statements, vocabulary
from tallysheet.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Properties recorded in another unit or scale than their common unit."""
    return harmonise_units(table(spark, d, "tag_variables"), table(spark, d, "common_units")).where("foreign").select("var_id", "prop_name").distinct()


def p2_common_values(spark: SparkSession, d: str) -> DataFrame:
    """Every quantity property as a number in its common unit."""
    return harmonise_units(table(spark, d, "tag_variables"), table(spark, d, "common_units")).distinct()


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources (unit texts), their linked rows and the conversions they were snapped to."""
    v = vocabulary(table(spark, d, "common_units"))
    return source_conversions(written(unit_statements(table(spark, d, "tag_variables"), v), "unit-statements"), v)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each sidecar file against the base shape."""
    return schema_drift.drift_report(table(spark, d, "detections"))


def p3_detections(spark: SparkSession, d: str) -> DataFrame:
    """All detections of all files in the base shape."""
    return schema_drift.unified_detections(table(spark, d, "detections"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Positions of all detections and of their candidates."""
    return nested_flatten.detection_positions(table(spark, d, "detections"))


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes with interval labels and the labels of their parents."""
    return nested_flatten.node_table(table(spark, d, "detections"))


def _p4(kind: str) -> Query:
    return lambda spark, d: nested_flatten.flat_tables(table(spark, d, "detections"))[kind]


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return packed_split.split_packed(table(spark, d, "schedule_tables"), table(spark, d, "tag_variables"), table(spark, d, "makers"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the values of every cell that holds two or more."""
    return _p5(spark, d).select("source_table", "record_id", "row_index", "field_name", "value_index").distinct()


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """The values themselves with offset and error flag."""
    return _p5(spark, d).distinct()


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_common_values": p2_common_values,
    "p2_sources": p2_sources,
    "p3_found": p3_found,
    "p3_detections": p3_detections,
    "p4_found": p4_found,
    "p4_nodes": p4_nodes,
    "p4_files": _p4("files"),
    "p4_pages": _p4("pages"),
    "p4_detections": _p4("detections"),
    "p4_candidates": _p4("candidates"),
    "p4_members": _p4("members"),
    "p5_found": p5_found,
    "p5_values": p5_values,
}
# The detections of all bodies by position, as plain SQL: pages under either name, as object or array, with or
# without entries around their detections.
_OBJECTS = r"""f AS (SELECT DISTINCT file_id, body::JSON AS j FROM (SELECT file_id, CASE WHEN json_valid(body) THEN body END AS body FROM detections WHERE file_id IS NOT NULL AND body IS NOT NULL AND trim(body) <> '') WHERE body IS NOT NULL),
c AS (SELECT file_id, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j) = 'OBJECT' THEN coalesce(j->'pages', j->'sheets') END AS p FROM f),
m AS (SELECT file_id, json_type(p) AS kind, e.key AS k, e.value AS v FROM c, json_each(p) AS e WHERE json_type(p) IN ('OBJECT', 'ARRAY')),
n AS (SELECT file_id, k, v, kind, json_type(v) AS t, CASE WHEN kind = 'OBJECT' THEN try_cast(k AS INT) ELSE coalesce(try_cast(v->>'page' AS INT) - 1, try_cast(k AS INT)) END AS page FROM m),
d AS (
SELECT file_id, page, try_cast(e.key AS INT) AS pos, e.value AS x FROM n, json_each(v) AS e WHERE t = 'ARRAY'
UNION ALL SELECT file_id, page, try_cast(e.key AS INT), e.value FROM n, json_each(v->'detections') AS e WHERE t = 'OBJECT' AND json_type(v->'detections') = 'ARRAY'
UNION ALL SELECT file_id, page, try_cast(k AS INT), v FROM n WHERE t = 'OBJECT' AND kind = 'ARRAY' AND coalesce(json_type(v->'detections'), '') <> 'ARRAY'),
o AS (SELECT * FROM d WHERE json_type(x) = 'OBJECT')"""
# Names under which the test tables carry the base fields.
_CARRIED = {
    "cls": ("cls", "class", "label", "cls_name"),
    "tag": ("tag", "equip_tag", "mark"),
    "tag_method": ("tag_method", "method", "tag_source"),
    "untagged_reason": ("untagged_reason", "reason", "why_untagged"),
    "conf": ("conf", "confidence", "score"),
    "x1": ("x1", "xmin", "left"),
    "y1": ("y1", "ymin", "top"),
    "x2": ("x2", "xmax", "right"),
    "y2": ("y2", "ymax", "bottom"),
}


def _text_sql(name: str) -> str:
    v = f"x->'{name}'"
    return f"CASE json_type({v}) WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN {v}->>'name' WHEN 'ARRAY' THEN {v}->>0 ELSE x->>'{name}' END"


_FIELDS = ", ".join(f"coalesce({', '.join(_text_sql(n) if f in schema_drift.BASE['det'] and schema_drift.BASE['det'][f] == 'string' else f'try_cast(x->>{n!r} AS DOUBLE)' for n in names)}) AS {f}" for f, names in _CARRIED.items())
_UNIT_NAMES = ["SUPPLY AIR", "CFM", "AIRFLOW", "AIR FLOW", "VOLUME", "EXT STATIC", "ESP", "STATIC", "PRESSURE DROP", "MOTOR SIZE", "MOTOR", "BHP", "HP", "TOTAL COOLING", "MBH", "CAPACITY", "COOLING", "HEATING", "OPER WEIGHT", "UNIT WEIGHT", "WEIGHT", "EAT", "LAT", "EWT", "AMBIENT", "GPM", "WATER FLOW", "FLOW RATE", "HW FLOW", "NECK SIZE", "NECK", "INLET SIZE"]  # longer before shorter ones
_FROM, _TO = "³²₂ºμ–—−×”“’‘″′", "322°µ---X\"\"''\"'"


def _units_sql() -> str:
    """Foreign properties by what is said of their unit, as plain SQL over the fixed vocabulary."""
    q = lambda t: "'" + t.replace("'", "''").replace("\\u00a0", "\\x{00A0}") + "'"
    blank = q(r"[\s\x{00A0}._,;:\[\]()\-]+")
    canon = lambda c: f"regexp_replace(upper(translate({c}, {q(_FROM)}, {q(_TO)})), {blank}, '', 'g')"
    words = ", ".join(f"({q(quantity)}, {q(label)}, {q(unit)}, {str(unit == next(iter(units))).lower()})" for quantity, units in U.UNITS.items() for unit, (_, _, spelt) in units.items() for label in spelt)
    after = r"""\s*(?:ARE|IN|AS|GIVEN\s+AS|GIVEN\s+IN|ARE\s+IN|ARE\s+GIVEN\s+AS|:|=|-)?\s+([A-Z°"'#][^;,()]*?)\s*(?:\bAND\b|[;,()]|$)"""
    said = "CASE quantity " + " ".join(f"WHEN {q(n)} THEN regexp_extract(notes, {q(chr(92) + 'b(?:' + w + ')' + chr(92) + 'b' + after)}, 1)" for n, w in U.NOTE_WORDS.items()) + " END"
    lead = "regexp_extract(upper(e.key), '^[^A-Z]*(?:" + "|".join(n.replace(" ", "[^A-Z]+") for n in _UNIT_NAMES) + ")(?:[^A-Z]|$)')"
    part = lambda i: f"regexp_extract(value, {q(U._VALUE)}, {i})"
    number = q(r"^[\sØ]*(?:" + U._NUM + ")")
    has = lambda label, name: f"LEFT JOIN (SELECT DISTINCT quantity, label, unit FROM vocabulary) {name} ON {name}.quantity = r.quantity AND {name}.label = r.{label}"
    return f"""WITH vocabulary(quantity, label, unit, common) AS (VALUES {words}), names AS (SELECT quantity, upper(unnest(prop_names)) AS name FROM common_units),
t AS (SELECT DISTINCT var_id, tag, schedule_name, properties FROM tag_variables WHERE properties IS NOT NULL),
x AS (SELECT var_id, schedule_name, pos, e.key AS key, e.value AS value, {lead} AS led FROM (SELECT *, unnest(map_entries(properties)) AS e, generate_subscripts(map_entries(properties), 1) AS pos FROM t)),
b AS (SELECT *, trim(regexp_replace(led, '[^A-Z]+', ' ', 'g')) AS base FROM x),
o AS (SELECT var_id, schedule_name, upper(concat_ws(' ; ', schedule_name, string_agg(value, ' ; ' ORDER BY pos) FILTER (base = '' AND value IS NOT NULL))) AS notes FROM b GROUP BY var_id, schedule_name),
p AS (SELECT b.var_id, key, value, base, quantity, notes, regexp_replace(upper(key), '^[^A-Z]*' || replace(base, ' ', '[^A-Z]+'), '') AS tail FROM b JOIN names ON name = base JOIN o ON o.var_id = b.var_id AND o.schedule_name IS NOT DISTINCT FROM b.schedule_name WHERE regexp_matches(value, {q(U._VALUE)})),
r AS (SELECT DISTINCT p.var_id, key, p.quantity, {canon(part(2))} AS by_value, CASE WHEN trim(tail) = '' AND own.label IS NOT NULL THEN base ELSE {canon('tail')} END AS by_name, {canon(said.replace('CASE quantity', 'CASE p.quantity'))} AS by_note, {canon(f"regexp_replace({part(3)}, {number}, '')")} AS beside FROM p LEFT JOIN (SELECT DISTINCT quantity, label FROM vocabulary) own ON own.quantity = p.quantity AND own.label = base)
SELECT DISTINCT var_id, key AS prop_name FROM r {has('by_value', 'v')} {has('by_name', 'n')} {has('by_note', 'm')} {has('beside', 's')} JOIN (SELECT DISTINCT quantity, unit AS hub FROM vocabulary WHERE common) h ON h.quantity = r.quantity
WHERE coalesce(v.unit, n.unit, m.unit, hub) <> hub AND coalesce(s.unit, '') <> hub"""


_TOP_CARRIED = {"pdf": ("pdf", "pdf_path", "file"), "dpi": ("dpi", "resolution"), "funnel": ("funnel", "counts"), "tag_diagnostics": ("tag_diagnostics",), "pages": ("pages", "sheets")}


def _drift_sql() -> str:
    """Changes of each file by the names of the test tables, as plain SQL."""
    names = ", ".join(f"('{lv}', '{f}', '{n}', '{schema_drift.BASE[lv][f]}')" for lv, fs in (("top", _TOP_CARRIED), ("det", _CARRIED)) for f, ns in fs.items() for n in ns)
    return f"""WITH {_OBJECTS}, known(lv, f, k, typed) AS (VALUES {names}),
keys AS (SELECT DISTINCT file_id, 'top' AS lv, e.key AS k, json_type(e.value) AS t FROM f, json_each(j) AS e WHERE json_type(j) = 'OBJECT'
UNION SELECT DISTINCT file_id, 'det', e.key, json_type(e.value) FROM o, json_each(x) AS e),
told AS (SELECT file_id, lv, k, CASE WHEN t = 'VARCHAR' THEN 'string' WHEN t IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN 'number' ELSE lower(t) END AS t, known.f, typed FROM keys LEFT JOIN known USING (lv, k)),
files AS (SELECT file_id, 'top' AS lv FROM f UNION SELECT file_id, 'det' FROM o)
SELECT file_id, f AS field_name, 'renamed' AS change_kind FROM told WHERE f <> k
UNION SELECT file_id, f, 'retyped' FROM told WHERE f <> 'pages' AND t <> 'null' AND t <> typed
UNION SELECT file_id, 'pages', 'retyped' FROM c JOIN f USING (file_id) WHERE json_type(j) = 'OBJECT' AND json_type(p) <> 'NULL' AND (json_type(p) <> 'OBJECT' OR file_id IN (SELECT file_id FROM m WHERE kind = 'OBJECT' AND json_type(v) <> 'ARRAY'))
UNION SELECT file_id, b.f, 'removed' FROM files JOIN (SELECT DISTINCT lv, f FROM known) b USING (lv) WHERE NOT EXISTS (SELECT 1 FROM told WHERE told.file_id = files.file_id AND told.lv = files.lv AND told.f = b.f)
UNION SELECT file_id, k, 'added' FROM told WHERE f IS NULL
UNION SELECT DISTINCT file_id, e.key, 'added' FROM n, json_each(v) AS e WHERE t = 'OBJECT' AND json_type(v->'detections') = 'ARRAY'"""


ORACLES: dict[str, str] = {
    "p2_found": _units_sql(),
    "p3_found": _drift_sql(),
    "p3_detections": f"WITH {_OBJECTS} SELECT file_id, page AS page_index, pos AS det_index, {_FIELDS} FROM o",
    "p4_found": f"""WITH {_OBJECTS}
SELECT DISTINCT file_id, page AS page_index, pos AS det_index, -1 AS cand_index FROM o
UNION SELECT file_id, page, pos, try_cast(e.key AS INT) FROM o, json_each(x->'candidates') AS e WHERE json_type(x->'candidates') = 'ARRAY' AND json_type(e.value) <> 'NULL'""",
}
