"""Queries of the composite operators: schedules, legend, title block, cascade, takeoff."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions import dims
from tallysheet.functions import strings as S
from tallysheet.operators import cascade, schedules, schema_drift, takeoff
from tallysheet.operators.resolution import fingerprint_index
from tallysheet.plans import score_queries
from tallysheet.plans.box_queries import fold_sql
from tallysheet.plans.text_queries import COLLAPSE, STRIP, expand_sql, normal_tag_sql, service_sql
from tallysheet.session import cut, spread, table

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


def raw_tables(spark: SparkSession, d: str) -> DataFrame:
    """Schedule tables as raw cells: a title row, the header, the data rows."""
    t = table(spark, d, "schedule_tables").where("table_id is not null and header is not null").select("table_id", "project", "page", "schedule_name", "header", "rows")
    t = spread(t, "table_id").dropDuplicates(["table_id"])
    line = lambda r: F.transform("header", lambda h: F.try_element_at(r, h))
    cells = F.concat(F.array(F.array("schedule_name")), F.array(F.col("header")), F.transform(F.filter(F.coalesce("rows", F.array()), lambda r: r.isNotNull()), line))
    return t.select("project", (F.col("page") - 1).alias("page"), F.col("table_id").alias("table_ix"), cells.alias("cells"), F.col("schedule_name").alias("page_text"))


def _found_sql() -> str:
    """Accepted schedules by plain SQL; the raw tables of these queries begin with a one-cell title row, so none lies on its side."""
    some = lambda words, c: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    filled = "lambda r: len(list_filter(r, lambda c: c <> '')) > 0"
    word = f"(list_contains({dims.sql_list(dims.TAG_COLUMN_WORDS)}, c) OR ((contains(c, 'MARK') OR contains(c, 'TAG')) AND length(c) < 20))"
    place = lambda test: f"nullif(list_position(list_transform(up, lambda r: {test}), true), 0)"
    ctes = rf"""t AS (SELECT DISTINCT ON (table_id) table_id, project, page, schedule_name, header, rows FROM schedule_tables WHERE table_id IS NOT NULL AND header IS NOT NULL),
c AS (SELECT table_id, project, page - 1 AS page, upper(coalesce(schedule_name, '')) AS page_text, list_transform(list_concat([[schedule_name], header], list_transform(list_filter(coalesce(rows, []), lambda r: r IS NOT NULL), lambda r: list_transform(header, lambda h: r[h]))), lambda r: list_transform(r, lambda c: {STRIP("coalesce(c, '')")})) AS cells FROM t),
u AS (SELECT *, list_transform(cells, lambda r: list_transform(r, lambda c: upper(c))) AS up FROM c WHERE len(list_filter(cells, {filled})) > 0),
h AS (SELECT *, {place(f"len(list_filter(r, lambda c: {word})) > 0")} AS e, {place(f"len(list_filter(r, lambda c: {some(schedules.HEADER_PROPERTIES, 'c')} AND length(c) < 30)) >= 3")} AS p, {some(dims.SCHEDULE_PAGE_WORDS, 'page_text')} AS told FROM u),
k AS (SELECT *, coalesce(e, p) AS h, told OR (e IS NULL AND p IS NOT NULL) AS on_page FROM h),
l AS (SELECT *, coalesce(h, list_position(list_transform(cells, {filled}), true)) AS head_at, list_filter(list_transform(list_reverse(cells[1:coalesce(h, 1) - 1]), lambda r: array_to_string(list_filter(r, lambda c: c <> '')[1:3], ' ')), lambda x: x <> '') AS titles FROM k WHERE h IS NOT NULL OR on_page),
m AS (SELECT table_id, project, page, on_page, cells[head_at] AS head, list_filter(cells[head_at + 1:], {filled}) AS body, coalesce(list_filter(titles, lambda x: contains(upper(x), 'SCHEDULE') AND length(x) < 100)[1], list_filter(titles, lambda x: length(x) <= 80 AND length(x) - length(replace(x, ' ', '')) <= 10)[1], '') AS name FROM l),
a AS (SELECT *, list_filter(generate_series(0, len(head) - 1), lambda i: {some(dims.TAG_COLUMN_WORDS, 'upper(head[i + 1])')} AND length(head[i + 1]) < 25) AS marks, list_filter(list_transform(body, lambda r: r[1]), lambda v: v <> '')[1] AS first_ FROM m WHERE len(head) > 0 AND len(body) > 0 AND (on_page OR contains(upper(array_to_string(head, ' ')), 'SCHEDULE')) AND (NOT {some(dims.OTHER_TRADE_WORDS, 'upper(name)')} OR {some(schedules.TRADE_WORDS, 'upper(name)')})),
n AS ({normal_tag_sql("SELECT DISTINCT first_ AS id, first_ AS raw FROM a WHERE length(first_) <= 2")}),
found AS (SELECT project, page, table_id AS table_ix, name AS schedule_name, head, body, CASE WHEN len(marks) > 0 THEN marks WHEN regexp_matches(first_, '^[A-Za-z]{{1,4}}-?\d{{1,3}}[A-Za-z]?$') OR n.tag IS NOT NULL THEN [0] ELSE [] END AS marks FROM a LEFT JOIN n ON n.id = first_)"""
    return ctes


_VARIABLES = "SELECT f.project, f.page, table_ix, f.schedule_name, row_ix::INT AS row_ix, tag_ix, tag, cls, n_props FROM tg JOIN cs USING (table_ix, row_ix) JOIN found f USING (table_ix)"
_FIRST = "SELECT project, tag, v.c AS cls, v.p AS props FROM (SELECT f.project, tag, arg_min({'c': cls, 'p': coalesce(props, '')}, o) AS v FROM (SELECT f.project, tag, cls, props, {'p': f.page, 't': table_ix, 'r': row_ix, 'i': tag_ix} AS o FROM tg JOIN cs USING (table_ix, row_ix) JOIN found f USING (table_ix) WHERE f.project IS NOT NULL) f GROUP BY ALL)"


def _variables_sql(select: str) -> str:
    """A selection from the tags (tg), rows (cs) and tables (found) of the accepted schedules."""
    some = lambda words, c: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    desc = f"list_filter(generate_series(0, len(head) - 1), lambda i: {some(schedules.DESCRIPTION_COLUMNS, 'upper(head[i + 1])')} AND NOT {some(schedules.PART_COLUMNS, 'upper(head[i + 1])')} AND NOT list_contains(marks, i))"
    look = lambda *w: f"arg_min(value, i) FILTER ({some(w, 'upper(key)')})"
    known = dims.sql_list([*dims.TAG_PREFIX, "A", "B", "C", "D"])
    prefix = " ".join(f"LEFT JOIN (SELECT * FROM {dims.sql_values(dims.TAG_PREFIX)}) d{n} ON d{n}.k = upper(t0)[1:{n}]" for n in (4, 3, 2, 1))
    return rf"""WITH {_found_sql()},
rw AS (SELECT table_ix, i - 1 AS row_ix, head, marks, body[i] AS r FROM found, unnest(generate_series(1, len(body))) AS g(i)),
mk AS (SELECT var_id.t AS table_ix, var_id.r AS row_ix, 0 AS src, var_id.o AS o, x."at" AS a, mark FROM ({expand_sql("SELECT {'t': table_ix, 'r': row_ix, 'o': o} AS var_id, r[marks[o] + 1] AS tag FROM rw, unnest(generate_series(1, len(marks))) AS q(o)")}) x),
tx AS (SELECT table_ix, row_ix, upper(array_to_string(list_filter(list_transform({desc}, lambda i: r[i + 1]), lambda v: v <> ''), ' ')) AS text FROM rw),
tt AS (SELECT table_ix, row_ix, i, ts[i] AS raw FROM (SELECT table_ix, row_ix, list_filter(regexp_extract_all(text, '([A-Z]{{1,4}}-?\d+[A-Z]?(?:-[A-Z]+)?)', 1), lambda x: list_contains({known}, regexp_extract(x, '^([A-Z]+)', 1))) AS ts FROM tx), unnest(generate_series(1, len(ts))) AS g(i)),
tn AS ({normal_tag_sql("SELECT {'t': table_ix, 'r': row_ix, 'i': i} AS id, raw FROM tt")}),
al AS (SELECT * FROM mk UNION ALL SELECT id.t, id.r, 1, id.i, 0, tag FROM tn WHERE tag IS NOT NULL),
one AS (SELECT table_ix, row_ix, mark, min({{'s': src, 'o': o, 'a': a}}) AS f FROM al GROUP BY ALL),
tg AS (SELECT table_ix, row_ix, mark AS tag, (row_number() OVER (PARTITION BY table_ix, row_ix ORDER BY f) - 1)::INT AS tag_ix FROM one),
pr AS (SELECT table_ix, row_ix, i, CASE WHEN {COLLAPSE("coalesce(head[i], '')")} = '' THEN 'COL_' || i ELSE {COLLAPSE('head[i]')} END AS key, {COLLAPSE('r[i]')} AS value FROM rw, unnest(generate_series(1, greatest(len(head), len(r)))) AS g(i) WHERE NOT list_contains(marks, i - 1)),
pk AS (SELECT table_ix, row_ix, key, arg_max(value, i) AS value, min(i) AS i FROM pr WHERE value <> '' GROUP BY ALL),
ps AS (SELECT table_ix, row_ix, count(*)::INT AS n_props, string_agg(key || '=' || value, '; ' ORDER BY i) AS props, {look('SERVICE', 'TYPE', 'DESCRIPTION')} AS service, coalesce({look('MOUNTING', 'MOUNT')}, '') AS mounting FROM pk GROUP BY ALL),
cl AS (SELECT table_ix, row_ix, tag AS t0, n_props, props, service, {COLLAPSE("upper(concat_ws(' ', service, mounting))")} AS s FROM tg LEFT JOIN ps USING (table_ix, row_ix) WHERE tag_ix = 0),
cs AS (SELECT table_ix, row_ix, props, coalesce(n_props, 0) AS n_props, coalesce(CASE WHEN {STRIP("coalesce(service, '')")} <> '' THEN {service_sql('s')} END, d4.v, d3.v, d2.v, d1.v) AS cls FROM cl {prefix})
{select}"""


@query("schedule_tables_found", f"WITH {_found_sql()} SELECT project, page, table_ix, schedule_name, array_to_string(head, '|') AS header, len(body)::INT AS n_rows, array_to_string(marks, ',') AS mark_columns FROM found")
def schedule_tables_found(spark: SparkSession, d: str) -> DataFrame:
    """CMP-01, FIL-01/03..08, MAP-03/04, ORD-12: accepted tables with name, header and mark columns."""
    t = schedules.extract_schedules(raw_tables(spark, d))
    return t.select("project", "page", "table_ix", "schedule_name", F.array_join("header", "|").alias("header"), F.size("rows").alias("n_rows"), F.array_join(F.col("mark_columns").cast("array<string>"), ",").alias("mark_columns"))


@query("schedule_variables", _variables_sql(_VARIABLES))
def schedule_variables(spark: SparkSession, d: str) -> DataFrame:
    """CMP-01/02, STR-05/06/25/26, MAP-02: one row per tag and data row."""
    v = schedules.extract_variables(schedules.extract_schedules(raw_tables(spark, d)))
    return v.select("project", "page", "table_ix", "schedule_name", "row_ix", "tag_ix", "tag", "cls", F.size("props").alias("n_props"))


@query("mark_details", _variables_sql(_FIRST))
def mark_details(spark: SparkSession, d: str) -> DataFrame:
    """D8, WIN-06: properties of the first occurrence of every tag of a project."""
    shown = F.array_join(F.transform("props", lambda p: F.concat(p["key"], F.lit("="), p["value"])), "; ")
    return _details(spark, d).select("project", "tag", "cls", shown.alias("props"))


def _details(spark: SparkSession, d: str) -> DataFrame:
    v = schedules.extract_variables(schedules.extract_schedules(raw_tables(spark, d)))
    return v.where("project is not null").groupBy("project", "tag").agg(F.min_by(F.struct("props", "cls"), F.col("ord")).alias("f")).select("project", "tag", "f.props", "f.cls")


@query(
    "legend",
    r"""
WITH l AS (SELECT source AS project, doc_id AS page, i AS line_no, ls[i] AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), unnest(generate_series(1, len(ls))) AS g(i)),
m AS (SELECT *, regexp_extract(line, '^\s*([A-Z][A-Z0-9/&.]{0,13})\s*[-=:]\s*([A-Z][^\n]{3,})$', 1) AS abbr, trim(regexp_extract(line, '^\s*([A-Z][A-Z0-9/&.]{0,13})\s*[-=:]\s*([A-Z][^\n]{3,})$', 2)) AS description FROM l WHERE regexp_matches(line, '^\s*([A-Z][A-Z0-9/&.]{0,13})\s*[-=:]\s*([A-Z][^\n]{3,})$'))
SELECT project, abbr, arg_max(description, {'p': page, 'a': line_no}) AS description FROM m GROUP BY project, abbr""",
)
def legend(spark: SparkSession, d: str) -> DataFrame:
    """CMP-05, MAP-07: abbreviations of whole texts, the last statement wins."""
    docs = table(spark, d, "documents").where("source is not null and text is not null")
    lines = docs.select(F.col("source").alias("project"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    none = spark.createDataFrame([], "project string, page bigint, cells array<array<string>>")
    return schedules.legend(none, lines)


_CLEAN = lambda c: COLLAPSE(rf"regexp_replace({STRIP(c)}, '^[\s:\-=]+|[\s:\-=]+$', '', 'g')")
_Q = lambda rx: "'" + rx.replace("'", "''") + "'"


def _valid_sql(field: str, v: str) -> str:
    never = f" AND NOT regexp_matches({v}, {_Q(schedules.TITLE_NEVER[field])})" if field in schedules.TITLE_NEVER else ""
    return f"({v} <> '' AND length({v}) >= 2 AND NOT regexp_matches({v}, {_Q(S.BAD_START)}) AND regexp_matches({v}, {_Q(schedules.TITLE_SHAPE[field])}){never})"


def _title_sql() -> str:
    inner, outer = [], []
    for f, patterns in schedules.TITLE_INLINE.items():
        for i, rx in enumerate(patterns):
            inner.append(f"{_CLEAN(f'regexp_extract(text, {_Q("(?i)" + rx)}, 1)')} AS {f}_{i}")
        if f in schedules.TITLE_STACKED:
            below = f"list_filter(ls[i + 1:i + {schedules.BELOW}], lambda c: c <> '' AND length(c) < 80 AND length(c) >= 2 AND NOT regexp_matches(c, {_Q(S.BAD_START)}) AND NOT regexp_matches(c, {_Q(schedules.LABEL_LINE)}) AND NOT regexp_matches(c, {_Q(schedules.HEADING_LINE)}) AND {_valid_sql(f, _CLEAN('c'))})[1]"
            inner.append(f"{_CLEAN(f'list_filter(list_transform(ls, lambda ln, i: CASE WHEN regexp_matches(ln, {_Q(schedules.TITLE_STACKED[f])}) THEN {below} END), lambda v: v IS NOT NULL)[1]')} AS {f}_s")
        picks = [f"CASE WHEN {_valid_sql(f, f'{f}_{i}')} THEN {f}_{i} END" for i in range(len(patterns))] + ([f"{f}_s"] if f in schedules.TITLE_STACKED else []) + (["firm_l"] if f == "firm" else [])
        outer.append(f"coalesce({', '.join(picks)}) AS info_{f}")
    inner.append(f"list_filter(list_transform(regexp_extract_all(text, {_Q(schedules.FIRM_LINE)}, 1), lambda c: {_CLEAN('c')}), lambda v: length(v) >= 2 AND NOT regexp_matches(v, {_Q(S.BAD_START)}))[1] AS firm_l")
    outer.append(f"nullif({_CLEAN(f'regexp_extract(text, {_Q(S.ADDRESS)}, 1)')}, '') AS info_address")
    lines = f"list_transform(string_split(text, chr(10)), lambda l: {STRIP('l')})"
    return f"WITH l AS (SELECT doc_id, text, {lines} AS ls FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, text, {', '.join(inner)} FROM l) SELECT doc_id, {', '.join(outer)} FROM p"


@query("title_block", _title_sql())
def title_block(spark: SparkSession, d: str) -> DataFrame:
    """CMP-06, STR-16..21, JOIN-10: title-block fields of whole texts, inline or up to three lines below a label."""
    return schedules.title_block(table(spark, d, "documents").where("text is not null"), "doc_id")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Tag variables placed on pages by fixed arithmetic on their id, so that every row takes part."""
    v = table(spark, d, "tag_variables").where("project is not null and page is not null").select("var_id", "project", (F.col("page") - 1).alias("page"), "tag", F.col("inferred_yolo_class").alias("cls"), "properties")
    v = spread(v, "var_id").dropDuplicates(["var_id"])
    return cut(v.withColumns({"x": (F.col("var_id") * 37 % 2000).cast("double"), "y": (F.col("var_id") * 91 % 2000).cast("double")}))


_PLACED = "placed AS (SELECT DISTINCT var_id, project, page - 1 AS page, tag, inferred_yolo_class AS cls, (var_id * 37 % 2000)::DOUBLE AS x, (var_id * 91 % 2000)::DOUBLE AS y FROM tag_variables WHERE project IS NOT NULL AND page IS NOT NULL)"
ORACLE_INDEX = score_queries.ORACLES["fingerprint_index"]


def _cascade_sql() -> str:
    classes = {*dims.DETECTOR_ALIAS, *(c for f in dims.CLASS_FAMILIES for c in f)}
    rows = [(c, c, 0, True) for c in sorted(classes)] + [(c, a, 1, len(v) == 1) for c, v in dims.DETECTOR_ALIAS.items() for a in v] + [(c, x, 2, True) for f in dims.CLASS_FAMILIES for c in f for x in f]
    edges = ", ".join(f"('{c}', '{x}', {p}, {'true' if ok else 'false'})" for c, x, p, ok in rows)
    fold = lambda c: f"regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"
    dist = "sqrt((d.cx - w.x) * (d.cx - w.x) + (d.cy - w.y) * (d.cy - w.y))"
    near = lambda left, right: f"{left} d JOIN {right} w ON d.project = w.project AND d.page = w.page"
    tokens = f"list_filter(regexp_split_to_array({COLLAPSE(chr(39).join(['regexp_replace(upper(text), ', '[' + chr(34) + chr(39) * 2 + ']', ', ', '', ', ', 'g', ')']))}, '[\\s/,]+'), lambda t: length(t) >= 2 AND regexp_matches(t, '[0-9]'))"
    first = fold_sql("SELECT project, page, det_id AS l, resolved || chr(1) || tag AS r, score, ord FROM score", "-score, l, ord")
    return rf"""WITH {_PLACED}, props AS (SELECT var_id, any_value(properties) AS ps FROM tag_variables GROUP BY var_id),
dets AS (SELECT project, page, var_id AS det_id, cls, x + var_id % 29 AS cx, y + var_id % 31 AS cy FROM placed WHERE cls IS NOT NULL),
tags AS (SELECT project, cls, tag, min(var_id) AS ord FROM placed WHERE cls IS NOT NULL AND tag IS NOT NULL GROUP BY ALL),
words AS (SELECT project, page, x, y, text FROM (SELECT project, page, x, y, unnest(map_values(ps)) AS text FROM placed JOIN props USING (var_id)) WHERE text IS NOT NULL),
bubbles AS (SELECT project, page, var_id AS bubble_id, x, y, {fold('tag')} AS fold FROM placed WHERE tag IS NOT NULL),
edges(cls, cand, prio, sure) AS (VALUES {edges}), index_ AS ({ORACLE_INDEX}),
seen AS (SELECT DISTINCT project, cls FROM dets), have AS (SELECT DISTINCT project, cls AS cand FROM tags),
cands AS (SELECT project, cls, cand, min(prio) AS prio FROM (SELECT project, cls, cls AS cand, 0 AS prio FROM seen UNION ALL SELECT project, cls, cand, prio FROM seen JOIN edges USING (cls) WHERE prio > 0) JOIN have USING (project, cand) GROUP BY ALL),
picks AS (SELECT project, cls, max(cand) FILTER (prio = 0) AS a, max(cand) FILTER (prio = 1 AND coalesce(sure, true)) AS b, max(cand) FILTER (prio = 2) AS c, count(DISTINCT cand) FILTER (prio = 2) AS n FROM cands LEFT JOIN (SELECT DISTINCT cls, cand, sure FROM edges) USING (cls, cand) GROUP BY ALL),
res AS (SELECT project, cls, coalesce(a, CASE WHEN cls <> 'AD-GRD' THEN coalesce(b, CASE WHEN n = 1 THEN c END) END) AS resolved FROM picks),
per AS (SELECT project, cls AS resolved, min(tag) AS only_, max(tag) AS other FROM tags GROUP BY ALL),
base AS (SELECT d.*, r.resolved, only_, other FROM dets d LEFT JOIN res r USING (project, cls) LEFT JOIN per p ON p.project = d.project AND p.resolved = r.resolved),
direct AS (SELECT det_id, cls AS new_cls, only_ AS tag, 'direct' AS how, 1.0::DOUBLE AS conf FROM base WHERE only_ = other),
toks AS (SELECT DISTINCT project, page, x, y, unnest({tokens}) AS tok FROM words),
close AS (SELECT DISTINCT d.project, d.page, d.det_id, d.resolved, w.tok FROM {near('(SELECT * FROM base WHERE only_ <> other)', 'toks')} AND {dist} <= {100 * 200 / 72!r}),
score AS (SELECT c.project, c.page, c.resolved, det_id, i.tag, t.ord, count(*) AS score FROM close c JOIN index_ i ON i.project = c.project AND i.tok = c.tok JOIN tags t ON t.project = c.project AND t.cls = c.resolved AND t.tag = i.tag GROUP BY ALL),
won AS (SELECT m.l AS det_id, string_split(m.r, chr(1))[2] AS tag FROM ({first})),
finger AS (SELECT det_id, b.cls AS new_cls, w.tag, 'fingerprint' AS how, least(0.5::DOUBLE + 0.15::DOUBLE * score, 0.95::DOUBLE) AS conf FROM won w JOIN base b USING (det_id) JOIN score s USING (det_id, tag)),
done1 AS (SELECT * FROM direct UNION ALL SELECT * FROM finger),
pool AS (SELECT c.project, c.cls, {fold('tag')} AS fold, min({{'p': prio, 'c': cand, 'o': ord, 't': tag}}) AS b FROM cands c JOIN tags t ON t.project = c.project AND t.cls = c.cand GROUP BY ALL),
hits AS (SELECT d.det_id, w.bubble_id, {dist} AS dist, p.b, w.fold FROM {near('(SELECT * FROM base ANTI JOIN done1 USING (det_id))', 'bubbles')} AND {dist} <= 350 JOIN pool p ON p.project = d.project AND p.cls = d.cls AND p.fold = w.fold WHERE w.fold <> ''),
bubble AS (SELECT det_id, arg_min({{'c': b.c, 't': b.t, 'd': dist}}, {{'s': dist - 80 * length(fold), 'i': bubble_id}}) AS v FROM hits GROUP BY det_id),
done2 AS (SELECT * FROM done1 UNION ALL SELECT det_id, v.c, v.t, 'bubble_detect', 1 - least(v.d / 350, 1) FROM bubble),
folded AS (SELECT project, cls AS resolved, {fold('tag')} AS fold, arg_max(tag, ord) AS tag FROM tags GROUP BY ALL),
look AS (SELECT d.det_id, d.cls, f.tag, {dist} AS dist FROM {near('(SELECT * FROM base ANTI JOIN done2 USING (det_id) WHERE only_ <> other)', "(SELECT project, page, x, y, " + fold('text') + " AS fold FROM words)")} AND {dist} <= 140 JOIN folded f ON f.project = d.project AND f.resolved = d.resolved AND f.fold = w.fold WHERE w.fold <> ''),
done3 AS (SELECT * FROM done2 UNION ALL SELECT det_id, cls, arg_min(tag, {{'d': dist, 't': tag}}), 'bubble_ocr', 1 - least(min(dist) / 140, 1) FROM look GROUP BY det_id, cls)
SELECT d.det_id, coalesce(new_cls, d.cls) AS cls, d.cls AS original_cls, tag, coalesce(how, 'none') AS tag_method, round(coalesce(conf, 0), 6) AS tag_confidence, CASE WHEN tag IS NULL THEN CASE WHEN h.cls IS NOT NULL THEN 'has_candidates_unmatched' ELSE 'no_candidate_tags' END END AS untagged_reason
FROM dets d LEFT JOIN done3 USING (det_id) LEFT JOIN (SELECT DISTINCT project, cls FROM cands) h ON h.project = d.project AND h.cls = d.cls"""


@query("tag_cascade", _cascade_sql())
def tag_cascade(spark: SparkSession, d: str) -> DataFrame:
    """CMP-07/08, JOIN-01..08, AGG-12, 2.18: the whole cascade over placed variables."""
    v = _placed(spark, d)
    dets = v.where("cls is not null").select("project", "page", F.col("var_id").alias("det_id"), "cls", (F.col("x") + F.col("var_id") % 29).alias("cx"), (F.col("y") + F.col("var_id") % 31).alias("cy"))
    tags = v.where("cls is not null and tag is not null").select("project", "cls", "tag", F.col("var_id").alias("ord"))
    words = v.select("project", "page", "x", "y", F.explode(F.map_values("properties")).alias("text")).where("text is not null")
    bubbles = v.where("tag is not null").select("project", "page", F.col("var_id").alias("bubble_id"), "x", "y", F.col("tag").alias("text"))
    return cascade.tag_cascade(dets, tags, words, bubbles, fingerprint_index(table(spark, d, "tag_variables")))


@query(
    "bubble_pairs",
    rf"""
WITH {_PLACED}, h AS (SELECT var_id, project, page, x, y, list_filter(regexp_split_to_array(tag, '[\s-]+'), lambda t: t <> '') AS ts FROM placed WHERE tag IS NOT NULL),
b AS (SELECT project, page, var_id * 16 + i - 1 AS id, x + (i - 1) * 20 AS x, y, ts[i] AS text FROM h, unnest(generate_series(1, len(ts))) AS g(i) WHERE length(ts[i]) <= 4)
SELECT a.project, a.page, a.id AS a, b.id AS b, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, unnest([a.text || b.text, b.text || a.text]) AS text
FROM b a JOIN b ON a.project = b.project AND a.page = b.page AND a.id <> b.id AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 80 AND (a.x <> b.x OR a.y <> b.y) AND (regexp_matches(a.text, '^[A-Za-z]+$') OR regexp_matches(b.text, '^[A-Za-z]+$'))""",
)
def bubble_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-21, SET-04: split bubbles joined; texts are the letters and the numbers of marks."""
    # of the variables only what the marks need
    v = table(spark, d, "tag_variables").where("project is not null and page is not null and tag is not null").select("var_id", "project", (F.col("page") - 1).alias("page"), "tag", F.col("inferred_yolo_class").alias("cls")).distinct()
    v = v.withColumns({"x": (F.col("var_id") * 37 % 2000).cast("double"), "y": (F.col("var_id") * 91 % 2000).cast("double")})
    halves = v.select("project", "page", "var_id", "x", "y", F.posexplode(F.filter(F.split("tag", r"[\s-]+"), lambda t: t != "")).alias("at", "text"))
    b = halves.select("project", "page", (F.col("var_id") * 16 + F.col("at")).alias("bubble_id"), (F.col("x") + F.col("at") * 20).alias("x"), "y", "text")
    return cascade.split_bubble_pairs(b)


_LABELS = "labels AS (SELECT project, page, var_id AS label_id, x, y, greatest(6 + var_id % 7, 6)::DOUBLE AS lh, greatest(20 + var_id % 41, 30)::DOUBLE AS lw FROM placed WHERE cls IS NOT NULL), vals AS (SELECT project, page, var_id AS value_id, x + var_id % 57 AS px, y - var_id % 43 AS py, (5 + var_id % 11)::DOUBLE AS vh, tag AS text FROM placed WHERE tag IS NOT NULL)"


@query(
    "label_values",
    f"""
WITH {_PLACED}, {_LABELS}, j AS (SELECT l.*, v.value_id, v.text, v.vh, px - x AS dx, py - y AS dy FROM labels l JOIN vals v ON l.project = v.project AND l.page = v.page),
k AS (SELECT *, CASE WHEN abs(dx) <= greatest(lw * 3, 120) AND dy > -lh * 6 AND dy < -lh * 0.2 THEN 0 WHEN abs(dy) <= lh * 0.6 AND dx > 0 AND dx < lw * 4 THEN 1 END AS branch FROM j)
SELECT project, page, label_id, arg_min(text, {{'b': branch, 's': CASE WHEN branch = 0 THEN abs(dy) - vh * 2 ELSE dx END, 'v': value_id}}) AS text FROM k WHERE branch IS NOT NULL GROUP BY ALL""",
)
def label_values(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-09: values above or right of labels, by windows that grow with the label."""
    v = _placed(spark, d)
    labels = v.where("cls is not null").select("project", "page", F.col("var_id").alias("label_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), (20 + F.col("var_id") % 41).cast("double").alias("w"), (6 + F.col("var_id") % 7).cast("double").alias("h"))
    values = v.where("tag is not null").select("project", "page", F.col("var_id").alias("value_id"), (F.col("x") + F.col("var_id") % 57).alias("cx"), (F.col("y") - F.col("var_id") % 43).alias("cy"), (5 + F.col("var_id") % 11).cast("double").alias("h"), F.col("tag").alias("text"))
    return cascade.label_values(labels, values, ["project", "page"]).select("project", "page", "label_id", "text")


def _prop_sql(*words: str) -> str:
    """SQL of the first property, in key order, whose name contains a word."""
    hit = " OR ".join(f"contains(upper({COLLAPSE('x.key')}), '{w}')" for w in words)
    return f"coalesce(list_filter(es, lambda x: {hit})[1].value, '')"


_KIND = "CASE WHEN contains(upper(device), 'DIFF') THEN 'DIFFUSER' WHEN contains(upper(device), 'GRILLE') OR contains(upper(device), 'REGISTER') THEN 'GRILLE' ELSE device END"
_BOTH = rf"""b2 AS (SELECT *, {COLLAPSE("maker_model")} AS s FROM b1),
b3 AS (SELECT *, string_split(s, ' ') AS ws, list_position(list_transform(string_split(s, ' '), lambda w, i: i > 1 AND regexp_matches(w, '[0-9]')), true) AS pos, strpos(s, ' / ') AS sl FROM b2)"""
_DETAILS = rf"""own AS (SELECT DISTINCT var_id, project, page - 1 AS page, inferred_yolo_class AS cls, tag, properties FROM tag_variables WHERE project IS NOT NULL AND page IS NOT NULL AND inferred_yolo_class IS NOT NULL),
firsts AS (SELECT project, tag, arg_min(list_sort(map_entries(properties)), var_id) AS es, arg_min(cls, var_id) AS tag_cls FROM own WHERE tag <> '' GROUP BY ALL),
named AS (SELECT o.var_id, o.project, o.page, coalesce(o.tag, '') AS tag, f.es, CASE WHEN o.cls = 'AD-GRD' AND f.tag_cls IS NOT NULL AND f.tag_cls <> 'AD-GRD' THEN f.tag_cls ELSE o.cls END AS product FROM (SELECT DISTINCT var_id, project, page, cls, tag FROM own) o LEFT JOIN firsts f ON f.project = o.project AND f.tag = o.tag)"""
_COLUMNS = rf"""b1 AS (SELECT *, {_prop_sql('MANUFACTURER & MODEL', 'MAKE / MODEL', 'MAKE/MODEL')} AS maker_model, {_prop_sql('MANUFACTURER', 'BRAND', 'MAKE')} AS own_brand, {_prop_sql('MODEL')} AS own_model, {_prop_sql('NECK', 'INLET')} AS neck, {_prop_sql('SIZE')} AS any_size, {_prop_sql('MODULE', 'PANEL', 'FACE SIZE', 'OVERALL', 'NOMINAL')} AS module_size, {_prop_sql('DUCT', 'CONNECTION', 'COLLAR')} AS duct_size, {_prop_sql('TYPE', 'DESCRIPTION', 'STYLE')} AS device, {_prop_sql('SERVICE', 'DUTY', 'APPLICATION')} AS service, {_prop_sql('MOUNT', 'CEILING TYPE')} AS mounting, {_prop_sql('DAMPER', 'OBD')} AS damper, {_prop_sql('MATERIAL')} AS material FROM rows_),
{_BOTH},
shown AS (SELECT *, CASE WHEN maker_model = '' THEN own_brand WHEN sl > 0 THEN trim(s[1:sl - 1]) WHEN pos > 0 THEN array_to_string(ws[1:pos - 1], ' ') ELSE s END AS brand, CASE WHEN maker_model = '' THEN own_model WHEN sl > 0 THEN trim(s[sl + 3:]) WHEN pos > 0 THEN array_to_string(ws[pos:], ' ') ELSE '' END AS model,
CASE WHEN neck <> '' THEN neck ELSE any_size END AS neck_size, CASE WHEN contains(upper(service), 'SA') OR contains(upper(service), 'SUPPLY') THEN trim('SUPPLY ' || {_KIND}) WHEN starts_with(upper(service), 'RA') OR contains(upper(service), 'RETURN') THEN trim('RETURN ' || {_KIND}) WHEN contains(upper(service), 'EXH') OR contains(upper(service), 'EA') THEN trim('EXHAUST ' || {_KIND}) WHEN device <> '' THEN device ELSE service END AS type,
concat_ws(', ', CASE WHEN material <> '' THEN 'MATERIAL ' || material END, CASE WHEN damper <> '' AND upper(damper) NOT IN ('NO', 'N', 'NONE', '-') THEN 'DAMPER ' || damper END) AS bits FROM b3)"""


def _takeoff_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "tag_variables").where("project is not null and page is not null and inferred_yolo_class is not null")
    v = spread(v, "var_id")
    tagged = v.select(F.col("var_id").alias("det_id"), "project", (F.col("page") - 1).alias("page"), F.col("inferred_yolo_class").alias("cls"), "tag").distinct()
    first = v.where("tag is not null").groupBy("project", "tag").agg(F.min_by(F.struct(F.array_sort(F.map_entries("properties")).alias("props"), F.col("inferred_yolo_class").alias("cls")), "var_id").alias("f")).select("project", "tag", "f.props", "f.cls")
    return tagged, first


@query(
    "takeoff_rows",
    f"""WITH {_DETAILS}, rows_ AS (SELECT project, product, tag, count(*) AS qty, array_to_string(list_sort(list(DISTINCT page + 1)), ', ') AS pages, any_value(es) AS es FROM named GROUP BY ALL), {_COLUMNS}
SELECT project, product, tag, qty, brand, model, neck_size, module_size, duct_size, type, mounting, CASE WHEN bits <> '' THEN bits || ' | ' ELSE '' END || 'Pages: ' || pages AS remark FROM shown""",
)
def takeoff_rows(spark: SparkSession, d: str) -> DataFrame:
    """CMP-09, AGG-02, JOIN-23, STR-30: the takeoff with brand, model, sizes, type and remarks."""
    return takeoff.assemble(*_takeoff_inputs(spark, d))


@query(
    "takeoff_detail",
    f"""WITH {_DETAILS}, rows_ AS (SELECT * FROM named), {_COLUMNS}
SELECT project, page, var_id AS det_id, product, tag, 1 AS qty, brand, model, neck_size, module_size, duct_size, type, mounting, bits AS remark FROM shown""",
)
def takeoff_detail(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01, second sheet: one row per detection."""
    return takeoff.detail_rows(*_takeoff_inputs(spark, d))


@query(
    "class_to_tags",
    f"""
WITH v AS (SELECT var_id, project, tag, inferred_yolo_class AS cls, page FROM (SELECT DISTINCT var_id, project, tag, inferred_yolo_class, page FROM tag_variables) WHERE project IS NOT NULL AND tag IS NOT NULL AND page IS NOT NULL),
d AS (SELECT * FROM {dims.sql_values(dims.TAG_PREFIX)}), c AS (SELECT v.*, coalesce(v.cls, a.v, b.v, e.v, g.v) AS c FROM v LEFT JOIN d a ON a.k = upper(tag)[1:4] LEFT JOIN d b ON b.k = upper(tag)[1:3] LEFT JOIN d e ON e.k = upper(tag)[1:2] LEFT JOIN d g ON g.k = upper(tag)[1:1])
SELECT project, c AS cls, tag, arg_max(page, var_id) AS page, min(var_id) AS ord FROM c WHERE c IS NOT NULL GROUP BY ALL""",
)
def class_to_tags(spark: SparkSession, d: str) -> DataFrame:
    """D9, CMP-17: classes with their tags; the last occurrence counts, the first gives the order."""
    v = table(spark, d, "tag_variables").where("page is not null").select("var_id", "project", "tag", F.col("inferred_yolo_class").alias("cls"), F.col("page").alias("props"), F.col("var_id").alias("ord")).distinct()
    return schedules.class_to_tags(v).select("project", "cls", "tag", F.col("props").alias("page"), "ord")


@query("pipeline_takeoff")
def pipeline_takeoff(spark: SparkSession, d: str) -> DataFrame:
    """CMP-01/02/07/09/17, AGG-12: the whole chain on one another's output. Schedules give variables, variables
    the tags of classes, details and fingerprints; the sidecars' detections are tagged by the cascade from them,
    and the tagged detections become the takeoff."""
    variables = cut(schedules.extract_variables(schedules.extract_schedules(raw_tables(spark, d))).where("project is not null"))
    tags = schedules.class_to_tags(variables).groupBy("project", "cls", "tag").agg(F.min("ord").alias("ord"))
    ranked = tags.select("project", "cls", "tag", F.col("ord.table_ix").alias("ord"))
    index = fingerprint_index(variables.select("project", "tag", F.map_from_entries("props").alias("properties")))
    jobs = table(spark, d, "detections").where("file_id is not null and project is not null").select("file_id", "project").distinct()
    found = schema_drift.unified_detections(table(spark, d, "detections")).join(jobs, "file_id")
    dets = cut(found.select("project", F.col("page_index").alias("page"), F.xxhash64("file_id", "page_index", "det_index").alias("det_id"), "cls", "tag", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy")).where("cls is not null"))
    seen = dets.where("tag is not null").select("project", "page", F.col("det_id").alias("bubble_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("tag").alias("text"))
    tagged = cascade.tag_cascade(dets.drop("tag"), ranked, seen.select("project", "page", "x", "y", "text"), seen, index)
    details = variables.groupBy("project", "tag").agg(F.min_by(F.struct("props", "cls"), F.col("ord")).alias("f")).select("project", "tag", "f.props", "f.cls")
    return takeoff.assemble(tagged.join(dets.select("det_id", "project", "page"), "det_id"), details)


@query(
    "schedule_entry",
    """WITH v AS (SELECT DISTINCT project, tag, CASE WHEN source_row_index = -1 THEN 2 WHEN page % 4 = 0 THEN 0 ELSE 1 END AS rank FROM tag_variables WHERE project IS NOT NULL AND tag IS NOT NULL AND page IS NOT NULL),
f AS (SELECT project, tag, min(rank) AS rank FROM v GROUP BY ALL), n AS (SELECT project, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank <= 1) AS b FROM f GROUP BY project)
SELECT project, tag, ['text', 'ocr_table', 'ocr_tag'][rank + 1] AS source FROM f JOIN n USING (project) WHERE rank = 0 OR (rank = 1 AND a < 3) OR (rank = 2 AND a < 3 AND b < 3)""",
)
def schedule_entry(spark: SparkSession, d: str) -> DataFrame:
    """CMP-02: tags from text tables, else from reconstructed tables, else read anywhere; the sources are parts of the variables."""
    v = table(spark, d, "tag_variables").where("project is not null and tag is not null and page is not null").select("project", "tag", "page", "source_row_index").distinct()
    row = F.coalesce(F.col("source_row_index") != -1, F.lit(True))
    return schedules.with_fallback(v, v.where(row & (F.col("page") % 4 == 0)), v.where(row & (F.col("page") % 4 != 0)), v.where(~row))
