"""Queries of the string, array and lookup operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions import dims, maps
from tallysheet.functions import strings as S
from tallysheet.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


W = r"[\s\x{00A0}]"
STRIP = lambda c: rf"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"
COLLAPSE = lambda c: rf"trim(regexp_replace({c}, '{W}+', ' ', 'g'))"
EDGES = lambda c: rf"regexp_replace({c}, '^[.,;:|/\-]+|[.,;:|/\-]+$', '', 'g')"
FRAGS = lambda c: rf"list_filter(list_transform(regexp_split_to_array({c}, '{W}+'), lambda f: {EDGES('f')}), lambda f: f <> '')"
STATUS = lambda c: STRIP(rf"regexp_replace({STRIP(c)}, '^\(\s*[ERNern]\s*\)\s*', '')")


def normal_tag_sql(source: str) -> str:
    """SQL text for rows (id, raw) of a subquery -> (id, raw, tag)."""
    return rf"""
WITH t AS ({source}),
f AS (SELECT id, raw, {FRAGS(STATUS('raw'))} AS fr FROM t),
j AS (SELECT id, raw, CASE WHEN len(fr) = 1 THEN fr[1] WHEN list_position(list_transform(fr, lambda x: regexp_matches(x, '^[A-Za-z]')), true) > 0
  THEN array_to_string(fr[list_position(list_transform(fr, lambda x: regexp_matches(x, '^[A-Za-z]')), true):list_position(list_transform(fr, lambda x: regexp_matches(x, '^[A-Za-z]')), true) + 1], '-') END AS s0 FROM f),
s AS (SELECT id, raw, regexp_replace(s0, '^[.,;:|/ \-]+|[.,;:|/ \-]+$', '', 'g') AS s FROM j)
SELECT id, raw, CASE WHEN regexp_matches(s, '^[A-Za-z]')
  AND (regexp_matches(replace(s, '-', ''), '^[A-Za-z][A-Za-z0-9]{{0,15}}$') OR (len(string_split(s, '-')) <= 3 AND len(list_filter(string_split(s, '-'), lambda p: NOT regexp_matches(p, '^[A-Za-z0-9]+$'))) = 0))
  AND length(s) BETWEEN 1 AND 20 AND NOT list_contains({dims.sql_list(dims.JUNK_TAGS)}, upper(s))
  AND NOT regexp_matches(s, '(?i)^R-?\d{{2,4}}[A-Z]?$') AND NOT regexp_matches(s, '^[A-Za-z]\d{{3}}$')
  AND NOT (NOT contains(s, '-') AND length(s) > 8 AND length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 4)
  AND NOT list_contains({dims.sql_list(dims.BANNED_PREFIXES)}, regexp_extract(upper(s), '^([A-Z]+)', 1))
  AND (regexp_matches(s, '[0-9]') OR length(s) <= 2 OR (regexp_matches(s, '^[A-Za-z]{{1,5}}-[A-Za-z]{{1,3}}$') AND list_contains({dims.sql_list(list(dims.TAG_PREFIX))}, upper(split_part(s, '-', 1)))))
  THEN upper(s) END AS tag FROM s"""


@query("normalize_tag", normal_tag_sql("SELECT DISTINCT var_id AS id, tag AS raw FROM tag_variables WHERE tag IS NOT NULL"))
def normalize_tag(spark: SparkSession, d: str) -> DataFrame:
    """STR-01 over every tag cell."""
    return table(spark, d, "tag_variables").where("tag is not null").select(F.col("var_id").alias("id"), F.col("tag").alias("raw")).distinct().withColumn("tag", S.normalize_tag(F.col("raw")))


_RANGE = r"^([A-Z]{1,4})-?(\d{1,9})\s*(?:THRU|THROUGH|TO|-|\x{2013}|\x{2014})\s*(?:([A-Z]{1,4})-?)?(\d{1,9})$"


@query(
    "expand_range",
    rf"""
WITH t AS (SELECT DISTINCT var_id, {COLLAPSE('upper(tag)')} AS s FROM tag_variables WHERE tag IS NOT NULL),
r AS (SELECT var_id, s, regexp_extract(s, '{_RANGE}', 1) AS p, regexp_extract(s, '{_RANGE}', 3) AS q, try_cast(regexp_extract(s, '{_RANGE}', 2) AS INT) AS a, try_cast(regexp_extract(s, '{_RANGE}', 4) AS INT) AS b FROM t WHERE regexp_matches(s, '{_RANGE}'))
SELECT var_id, p || '-' || unnest(generate_series(a, b)) AS mark FROM r WHERE (q = '' OR q = p) AND b >= a AND b - a <= 100""",
)
def expand_range(spark: SparkSession, d: str) -> DataFrame:
    """STR-03: every mark of a range cell."""
    return table(spark, d, "tag_variables").where("tag is not null").select("var_id", "tag").distinct().select("var_id", F.explode(S.expand_range(F.col("tag"))).alias("mark"))


@query(
    "split_compound",
    rf"""
WITH t AS (SELECT DISTINCT var_id, list_filter(list_transform(regexp_split_to_array({STRIP('tag')}, '[,;/&]'), lambda p: {STRIP('p')}), lambda p: p <> '') AS parts FROM tag_variables WHERE tag IS NOT NULL),
h AS (SELECT var_id, parts, regexp_extract({STATUS('upper(parts[1])')}, '^([A-Z]+)-\d+$', 1) AS p FROM t)
SELECT var_id, unnest(CASE WHEN p <> '' AND len(parts) > 1 AND len(list_filter(parts[2:], lambda x: NOT regexp_matches(x, '^\d+$'))) = 0 THEN list_concat(parts[1:1], list_transform(parts[2:], lambda x: p || '-' || x)) ELSE parts END) AS part FROM h""",
)
def split_compound(spark: SparkSession, d: str) -> DataFrame:
    """STR-02: compound cells and their short form."""
    return table(spark, d, "tag_variables").where("tag is not null").select("var_id", "tag").distinct().select("var_id", F.explode(S.split_compound(F.col("tag"))).alias("part"))


def expand_sql(cells: str) -> str:
    """SQL text for cells (var_id, tag) of a subquery -> (var_id, at, mark).

    Every raw tag of a cell by lines (w = 0) and by the first of several numbers, range and compound (w = 1),
    normalised; lines count where they hold any tag."""
    cell, both = STRIP("tag"), COLLAPSE("upper(tag)")
    numbers = r"list_filter(fr, lambda x: regexp_matches(x, '^\d{1,3}$'))"
    letters = "list_filter(fr, lambda x: regexp_matches(x, '^[A-Za-z]{1,5}$'))"
    part = lambda i: f"regexp_extract(up, '{_RANGE}', {i})"
    lo, hi = (f"try_cast({part(i)} AS INT)" for i in (2, 4))
    source = rf"""SELECT {{'v': var_id, 'c': tag, 'w': w, 'i': i}} AS id, raws[i] AS raw FROM (
SELECT var_id, tag, 0 AS w, ls AS raws FROM p WHERE contains(st, chr(10)) AND len(ls) > 1 AND len(list_filter(ls, lambda x: NOT regexp_matches(x, '^[A-Za-z]{{1,5}}-?\d|^[A-Za-z]{{2,5}}-[A-Za-z0-9]+$'))) = 0
UNION ALL SELECT var_id, tag, 1, CASE WHEN len(fr) >= 3 AND len({numbers}) >= 2 AND len({letters}) = 1 THEN list_transform({numbers}, lambda n: upper({letters}[1]) || '-' || n)
WHEN regexp_matches(up, '{_RANGE}') AND {part(3)} IN ('', {part(1)}) AND {hi} >= {lo} AND {hi} - {lo} <= 100 THEN list_transform(generate_series({lo}, {hi}), lambda n: {part(1)} || '-' || n)
WHEN pre <> '' AND len(parts) > 1 AND len(list_filter(parts[2:], lambda x: NOT regexp_matches(x, '^\d+$'))) = 0 THEN list_concat(parts[1:1], list_transform(parts[2:], lambda x: pre || '-' || x)) ELSE parts END FROM p), unnest(generate_series(1, len(raws))) AS g(i)"""
    return rf"""WITH c AS (SELECT DISTINCT var_id, tag, {cell} AS st, {both} AS up, {FRAGS(cell)} AS fr, list_filter(list_transform(string_split({cell}, chr(10)), lambda p: {STRIP('p')}), lambda p: p <> '') AS ls, list_filter(list_transform(regexp_split_to_array({cell}, '[,;/&]'), lambda p: {STRIP('p')}), lambda p: p <> '') AS parts FROM ({cells}) WHERE tag IS NOT NULL),
p AS (SELECT *, regexp_extract({STATUS('upper(parts[1])')}, '^([A-Z]+)-\d+$', 1) AS pre FROM c WHERE st <> ''),
n AS ({normal_tag_sql(source)}),
ok AS (SELECT id.v AS var_id, id.c AS cell, id.w AS w, id.i AS i, tag FROM n WHERE tag IS NOT NULL), best AS (SELECT var_id, cell, min(w) AS w FROM ok GROUP BY ALL)
SELECT var_id, (row_number() OVER (PARTITION BY var_id, cell ORDER BY i) - 1)::INT AS at, tag AS mark FROM ok JOIN best USING (var_id, cell, w)"""


@query("expand_tag_cell", expand_sql("SELECT var_id, tag FROM tag_variables"))
def expand_tag_cell(spark: SparkSession, d: str) -> DataFrame:
    """STR-05: all tags of every cell (lines, several numbers, range, compound)."""
    return table(spark, d, "tag_variables").where("tag is not null").select("var_id", "tag").distinct().select("var_id", F.posexplode(S.expand_tag_cell(F.col("tag"))).alias("at", "mark"))


@query(
    "class_alias_survey",
    rf"""
WITH c AS (SELECT DISTINCT project, {COLLAPSE('upper(class)')} AS k, class, count FROM sample_per_project WHERE class IS NOT NULL)
SELECT coalesce(v, c.k) AS class, sum(count) AS total_count, count(DISTINCT project) AS project_count FROM c LEFT JOIN (SELECT * FROM {dims.sql_values(dims.CLASS_ALIAS)}) a ON a.k = c.k GROUP BY 1""",
)
def class_alias_survey(spark: SparkSession, d: str) -> DataFrame:
    """STR-13/14 and AGG-11: counts per class after aliasing."""
    rows = table(spark, d, "sample_per_project").where("class is not null").select("project", "class", "count").distinct()
    return rows.groupBy(S.product_name(F.col("class")).alias("class")).agg(F.sum("count").alias("total_count"), F.count_distinct("project").alias("project_count"))


@query(
    "text_folds",
    rf"""
SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS alnum, {COLLAPSE("regexp_replace(upper(p_name), '[\"'']', '', 'g')")} AS folded, translate(upper(p_brand), 'OILSBZ', '011582') AS digits FROM part""",
)
def text_folds(spark: SparkSession, d: str) -> DataFrame:
    """STR-09/10/11: folds used as join keys."""
    return table(spark, d, "part").select("p_partkey", S.alnum_fold(F.col("p_name")).alias("alnum"), S.value_fold(F.col("p_name")).alias("folded"), S.ocr_digits(F.col("p_brand")).alias("digits"))


@query(
    "brand_model",
    rf"""
WITH t AS (SELECT DISTINCT var_id, {COLLAPSE("(properties['MANUFACTURER'] || ' ' || properties['MODEL'])")} AS s FROM tag_variables WHERE properties['MANUFACTURER'] IS NOT NULL AND properties['MODEL'] IS NOT NULL),
w AS (SELECT var_id, s, string_split(s, ' ') AS ws, list_position(list_transform(string_split(s, ' '), lambda x, i: i > 1 AND regexp_matches(x, '[0-9]')), true) AS pos, strpos(s, ' / ') AS sl FROM t)
SELECT var_id, CASE WHEN sl > 0 THEN trim(s[1:sl - 1]) WHEN pos > 0 THEN array_to_string(ws[1:pos - 1], ' ') ELSE s END AS brand, CASE WHEN sl > 0 THEN trim(s[sl + 3:]) WHEN pos > 0 THEN array_to_string(ws[pos:], ' ') ELSE '' END AS model FROM w""",
)
def brand_model(spark: SparkSession, d: str) -> DataFrame:
    """STR-15: brand and model of one text."""
    both = F.concat(F.try_element_at("properties", F.lit("MANUFACTURER")), F.lit(" "), F.try_element_at("properties", F.lit("MODEL")))
    t = table(spark, d, "tag_variables").select("var_id", both.alias("s")).where("s is not null").distinct()
    return t.withColumn("bm", S.brand_model(F.col("s"))).select("var_id", "bm.brand", "bm.model")


VOCABULARY = ["MARK", "TAG", "SYMBOL", "MANUFACTURER", "MODEL", "CFM", "HP", "ELECTRICAL", "NOTES", "REMARKS", "SERVES", "AREA SERVED", "MODULE SIZE", "NECK SIZE", "POWER SUPPLY", "UNIT NO"]


@query(
    "header_snap",
    rf"""
WITH h AS (SELECT DISTINCT unnest(header) AS head FROM schedule_tables),
k AS (SELECT head, {COLLAPSE("regexp_replace(upper(head), '[^A-Z ]', '', 'g')")} AS s FROM h WHERE head IS NOT NULL),
d AS (SELECT head, s, v, CASE WHEN abs(length(s) - length(v)) > 4 THEN 99 ELSE levenshtein(s, v) END AS d FROM k, (SELECT unnest({dims.sql_list(VOCABULARY)}) AS v)),
b AS (SELECT head, s, arg_min(v, {{'d': d, 'v': v}}) AS v, min(d) AS d FROM d GROUP BY head, s)
SELECT head, CASE WHEN s = '' THEN head WHEN d <= greatest(1, length(v) // 4) THEN v ELSE head END AS snapped FROM b""",
)
def header_snap(spark: SparkSession, d: str) -> DataFrame:
    """STR-22/23, JOIN-12: headers to the nearest vocabulary word."""
    return table(spark, d, "schedule_tables").select(F.explode("header").alias("head")).where("head is not null").distinct().withColumn("snapped", S.header_snap(F.col("head"), VOCABULARY))


@query(
    "prop_lookup",
    """
WITH t AS (SELECT DISTINCT var_id, list_sort(map_entries(properties)) AS e FROM tag_variables WHERE properties IS NOT NULL)
SELECT var_id, list_filter(e, lambda x: contains(upper(x.key), 'WEIGHT') OR contains(upper(x.key), 'NECK'))[1].value AS value FROM t""",
)
def prop_lookup(spark: SparkSession, d: str) -> DataFrame:
    """MAP-01: first property, in key order, whose name contains a keyword."""
    t = table(spark, d, "tag_variables").where("properties is not null").select("var_id", maps.sorted_entries(F.col("properties")).alias("e")).distinct()
    return t.select("var_id", maps.prop_lookup(F.col("e"), ["WEIGHT", "NECK"]).alias("value"))


@query(
    "row_to_props",
    rf"""
WITH t AS (SELECT DISTINCT table_id, header FROM schedule_tables WHERE header IS NOT NULL),
z AS (SELECT table_id, i, CASE WHEN coalesce({COLLAPSE('header[i]')}, '') = '' THEN 'COL_' || i ELSE {COLLAPSE('header[i]')} END AS key, {COLLAPSE('reverse(header[i])')} AS value FROM t, unnest(generate_series(1, len(header))) AS g(i)),
k AS (SELECT table_id, key, arg_max(value, i) AS value, min(i) AS i FROM z WHERE value IS NOT NULL AND value <> '' GROUP BY table_id, key)
SELECT table_id, key, value FROM k""",
)
def row_to_props(spark: SparkSession, d: str) -> DataFrame:
    """MAP-02: a row of cells to properties under its header; here the cells are the reversed headers."""
    t = table(spark, d, "schedule_tables").where("header is not null").select("table_id", "header").distinct()
    props = maps.row_to_props(F.col("header"), F.transform("header", lambda h: F.reverse(h)), F.array().cast("array<int>"))
    return t.select("table_id", F.explode(props).alias("p")).select("table_id", "p.key", "p.value")


_PREFIXES = dims.sql_list([*dims.TAG_PREFIX, "A", "B", "C", "D"])


@query(
    "tag_scan_in_text",
    rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(upper(text), '\b([A-Z]{{1,4}}-?\d+[A-Z]?(?:-[A-Z]+)?)\b', 1)) AS tag FROM documents WHERE text IS NOT NULL)
SELECT doc_id, tag, count(*) AS n FROM m WHERE list_contains({_PREFIXES}, regexp_extract(tag, '^([A-Z]+)', 1)) GROUP BY doc_id, tag""",
)
def tag_scan_in_text(spark: SparkSession, d: str) -> DataFrame:
    """STR-06: tags named in whole texts."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(S.tags_in_text(F.col("text"))).alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query(
    "inline_field",
    r"""
WITH f AS (SELECT doc_id, regexp_replace(regexp_extract(text, '(?i)\bTAKEOFF ROW\s+\d+\s*[:#]\s*([^\n]+)', 1), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS v FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(v, '^[\s:\-=]+|[\s:\-=]+$', '', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS value FROM f)
SELECT doc_id, value FROM c WHERE length(value) >= 2 AND NOT regexp_matches(value, '%s')""" % S.BAD_START,
)
def inline_field(spark: SparkSession, d: str) -> DataFrame:
    """STR-16/17/19: LABEL: value in running text, whole texts."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.inline_field(F.col("text"), [r"\bTAKEOFF ROW\s+\d+\s*[:#]\s*([^\n]+)"]).alias("value")).where("value is not null")


@query(
    "class_of_tag",
    f"""
WITH t AS (SELECT DISTINCT var_id, upper(tag) AS u FROM tag_variables WHERE tag IS NOT NULL), d AS (SELECT * FROM {dims.sql_values(dims.TAG_PREFIX)})
SELECT var_id, coalesce(a.v, b.v, c.v, e.v) AS class FROM t LEFT JOIN d a ON a.k = u[1:4] LEFT JOIN d b ON b.k = u[1:3] LEFT JOIN d c ON c.k = u[1:2] LEFT JOIN d e ON e.k = u[1:1]""",
)
def class_of_tag(spark: SparkSession, d: str) -> DataFrame:
    """STR-25: class by the longest known prefix."""
    return table(spark, d, "tag_variables").where("tag is not null").select("var_id", F.upper("tag").alias("u")).distinct().select("var_id", S.class_of_tag(F.col("u")).alias("class"))


@query(
    "mark_types",
    r"""
WITH t AS (SELECT DISTINCT var_id, tag FROM tag_variables WHERE tag IS NOT NULL)
SELECT CASE WHEN regexp_extract(tag, '^([A-Za-z]+)', 1) <> '' THEN regexp_extract(tag, '^([A-Za-z]+)', 1) ELSE split_part(tag, '-', 1) END AS mark_type, count(*) AS n FROM t GROUP BY 1""",
)
def mark_types(spark: SparkSession, d: str) -> DataFrame:
    """STR-07, AGG-21: histogram of mark types."""
    return table(spark, d, "tag_variables").where("tag is not null").select("var_id", "tag").distinct().groupBy(S.mark_type(F.col("tag")).alias("mark_type")).agg(F.count("*").alias("n"))


def service_sql(t: str) -> str:
    """SQL of the air-device class of a folded service text."""
    lay_in = f"(contains({t}, 'LAY-IN') OR contains({t}, 'T-BAR') OR contains({t}, 'TBAR') OR contains({t}, 'CEILING'))"
    surface = f"(contains({t}, 'SURFACE') OR contains({t}, 'EXPOSED'))"
    return f"""CASE WHEN {lay_in} AND contains({t}, 'SUPPLY') THEN 'AD-T-BAR SUPPLY' WHEN {lay_in} AND contains({t}, 'RETURN') THEN 'AD-T-BAR RETURN'
  WHEN {surface} AND (contains({t}, 'ROUND') OR (contains({t}, 'SUPPLY') AND NOT contains({t}, 'GRILLE'))) THEN 'AD-SURF SUPPLY' WHEN {surface} AND contains({t}, 'RETURN') THEN 'AD-SURF RETURN'
  WHEN contains({t}, 'LINEAR') AND contains({t}, 'SLOT') THEN 'AD-LINEAR SLOT DIFFUSER' WHEN contains({t}, 'LINEAR') AND contains({t}, 'PLENUM') THEN 'AD-LINEAR PLENUM'
  WHEN regexp_matches({t}, 'DIFFUSER|GRILLE|REGISTER|SUPPLY|RETURN|EXHAUST|PERFORATED|PLAQUE|FACE|LOUVERED|DROP|MOUNTED') THEN 'AD-GRD' END"""


@query("class_of_service", f"WITH c AS (SELECT DISTINCT cls, {COLLAPSE('upper(cls)')} AS t FROM ls_boxes WHERE cls IS NOT NULL) SELECT cls, {service_sql('t')} AS class FROM c")
def class_of_service(spark: SparkSession, d: str) -> DataFrame:
    """STR-26: air-device class from service text by ordered rules."""
    return table(spark, d, "ls_boxes").where("cls is not null").select("cls").distinct().withColumn("class", S.class_of_service(F.col("cls"), F.lit("")))


@query(
    "air_device_class",
    """
WITH c AS (SELECT DISTINCT t FROM (SELECT upper(trim(cls)) AS t FROM ls_boxes WHERE cls IS NOT NULL UNION ALL SELECT upper(schedule_name) FROM schedule_tables WHERE schedule_name IS NOT NULL)),
w AS (SELECT t, CASE WHEN contains(t, 'SURF') THEN 'AD-SURF ' ELSE 'AD-T-BAR ' END AS m, regexp_matches(t, 'DIFFUS|GRIL|REGIS|GRD|SUPPLY|RETURN|EXHAUST') OR trim(t) IN ('SA', 'RA', 'EA') AS device FROM c)
SELECT t AS description, CASE WHEN NOT device THEN NULL WHEN contains(t, 'RETURN') OR starts_with(t, 'RA') THEN m || 'RETURN' WHEN contains(t, 'EXH') OR starts_with(t, 'EA') THEN 'AD-GRD' WHEN contains(t, 'SUPPLY') OR contains(t, 'DIFFUS') OR starts_with(t, 'SA') THEN m || 'SUPPLY' ELSE 'AD-GRD' END AS class FROM w""",
)
def air_device_class(spark: SparkSession, d: str) -> DataFrame:
    """STR-28: class of an air device by its description."""
    texts = table(spark, d, "ls_boxes").where("cls is not null").select(F.upper(F.trim("cls")).alias("t")).unionByName(table(spark, d, "schedule_tables").where("schedule_name is not null").select(F.upper("schedule_name").alias("t")))
    return texts.distinct().select(F.col("t").alias("description"), S.air_device_class(F.col("t")).alias("class"))


@query(
    "page_filter_with_fallback",
    """
WITH t AS (SELECT doc_id, source, contains(upper(text), 'PLAN') AND NOT contains(upper(text), 'SCHEDULE') AS hit FROM documents WHERE text IS NOT NULL)
SELECT doc_id, source FROM t WHERE hit OR source NOT IN (SELECT source FROM t WHERE hit AND source IS NOT NULL)""",
)
def page_filter_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """FIL-02: pages with a wanted and no unwanted word; all pages of a group that has none.

    The fallback is a join with the few groups that have a hit, not a window over whole groups.
    """
    t = table(spark, d, "documents").where("text is not null and source is not null").select("doc_id", "source", (F.contains(F.upper("text"), F.lit("PLAN")) & ~F.contains(F.upper("text"), F.lit("SCHEDULE"))).alias("hit"))
    groups = t.where("hit").select("source").distinct().withColumn("some", F.lit(True))
    return t.join(groups, "source", "left").where("hit or some is null").select("doc_id", "source")


@query(
    "size_tokens",
    rf"""
WITH c AS (SELECT DISTINCT table_id, i, unnest(map_entries(r)) AS e FROM (SELECT table_id, unnest(rows) AS r, generate_subscripts(rows, 1) AS i FROM schedule_tables))
SELECT table_id, i - 1 AS row_index, e.key AS field, lower(regexp_replace(replace(e.value, '×', 'x'), '{W}+', '', 'g')) AS size FROM c WHERE regexp_matches(lower(regexp_replace(replace(e.value, '×', 'x'), '{W}+', '', 'g')), '^\d{{1,3}}x\d{{1,3}}$')""",
)
def size_tokens(spark: SparkSession, d: str) -> DataFrame:
    """STR-34: NNxNN sizes in schedule cells."""
    c = table(spark, d, "schedule_tables").select("table_id", F.posexplode("rows").alias("row_index", "r")).select("table_id", "row_index", F.explode("r").alias("field", "value"))
    return c.select("table_id", F.col("row_index").cast("bigint").alias("row_index"), "field", S.size_token(F.col("value")).alias("size")).where("size is not null").distinct()


@query(
    "sentence_tokens",
    r"""
WITH t AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\s\x{00A0}/,]+'), lambda x: regexp_replace(x, '^[.()]+|[.()]+$', '', 'g')), lambda x: x <> '')) AS tok FROM documents WHERE text IS NOT NULL)
SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY tok""",
)
def sentence_tokens(spark: SparkSession, d: str) -> DataFrame:
    """MAP-06: tokens of whole texts with counts; partial aggregation before the shuffle."""
    t = maps.token_rows(table(spark, d, "documents").where("text is not null"), "text", ["doc_id"])
    per = t.groupBy("doc_id", "tok").agg(F.count("*").alias("n"))
    return per.groupBy("tok").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(
    "json_props_flatten",
    """
SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events WHERE props IS NOT NULL) t, LATERAL (SELECT json_extract_string(props, '$."' || key || '"') AS value)""",
)
def json_props_flatten(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11/12: members of a JSON text as rows."""
    return table(spark, d, "events").where("props is not null").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
