"""Schedule extraction from raw tables: orientation, header, mark columns, properties, variables.

A raw table is one row with its cells as array<array<string>>, so every step is a column expression
on that row; the only growth is one row per data row and then per tag. Nothing is shuffled.

Input columns: project, page (0-based), table_ix, cells, page_text (may be NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions import dims, maps
from tallysheet.functions import strings as S

# Words that tell rows and columns apart.
SIDE_PROPERTIES = ["MODEL", "MANUFACTURER", "CFM", "AIRFLOW", "SIZE", "CAPACITY", "SERVICE", "TYPE", "VOLTAGE", "WEIGHT"]
HEADER_PROPERTIES = ["TYPE", "MODEL", "SIZE", "CFM", "MANUFACTURER", "DESCRIPTION", "CAPACITY", "NECK", "SERVICE", "MAKE", "MOUNTING", "REMARK"]
DESCRIPTION_COLUMNS = ["DESCRIPTION", "TYPE", "MODEL", "SIZE", "CAPACITY", "SERVICE", "REMARK"]
PART_COLUMNS = ["MODEL", "PART", "REFRIGERANT", "SERIAL", "MANUFACTURER"]
TRADE_WORDS = ["HVAC", "AIR HANDL", "CONDENSING", "FAN COIL", "DIFFUSER", "GRILLE", "DAMPER", "VAV", "EXHAUST FAN", "TERMINAL", "ROOFTOP", "AIR CURTAIN", "LOUVER", "UNIT HEATER", "ELECTRIC HEATER", "CABINET HEATER", "DUCT HEATER"]


def _any(text: Column, words: list[str]) -> Column:
    return F.greatest(*[F.contains(text, F.lit(w)) for w in words], F.lit(False))


def _up(cell: Column) -> Column:
    return F.upper(S.strip(F.coalesce(cell, F.lit(""))))


def _bind(df: DataFrame, **cols: Column) -> DataFrame:
    """Columns evaluated once: a one-row generator keeps the optimizer from repeating their expressions
    in everything that is built on them."""
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _filled(row: Column) -> Column:
    return F.exists(row, lambda c: S.strip(F.coalesce(c, F.lit(""))) != "")


def is_horizontal(cells: Column) -> Column:
    """Properties down the first column: an exact mark word and at least two property cells."""
    col0 = F.transform(cells, lambda r: _up(F.get(r, F.lit(0))))
    mark = F.exists(col0, lambda c: c.isin("MARK", "TAG", "DESIGNATION", "SYMBOL"))
    props = F.size(F.filter(col0, lambda c: _any(c, SIDE_PROPERTIES) & (F.length(c) < 30)))
    return (F.size(cells) >= 3) & (F.size(F.get(cells, F.lit(0))) >= 3) & mark & (props >= 2)


def transpose(cells: Column) -> Column:
    """A ragged matrix turned; missing cells are NULL."""
    width = F.array_max(F.transform(cells, lambda r: F.size(r)))
    return F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda c: F.transform(cells, lambda r: F.get(r, c)))


def _first_row(cells: Column, test) -> Column:
    at = F.array_position(F.transform(cells, test), True)
    return F.when(at > 0, at.cast("int") - 1)


def header_row(cells: Column) -> tuple[Column, Column]:
    """(row with a mark word, first row with three property cells), 0-based, NULL where there is none."""
    word = lambda c: c.isin(*dims.TAG_COLUMN_WORDS) | ((F.contains(c, F.lit("MARK")) | F.contains(c, F.lit("TAG"))) & (F.length(c) < 20))
    explicit = _first_row(cells, lambda r: F.exists(r, lambda c: word(_up(c))))
    by_property = _first_row(cells, lambda r: F.size(F.filter(r, lambda c: _any(_up(c), HEADER_PROPERTIES) & (F.length(_up(c)) < 30))) >= 3)
    return explicit, by_property


def schedule_name(cells: Column, header: Column) -> Column:
    """Walking upward from the header: the nearest title with SCHEDULE, else the nearest short row."""
    above = F.reverse(F.slice(cells, F.lit(1), F.greatest(F.coalesce(header, F.lit(0)), F.lit(0))))
    titles = F.filter(F.transform(above, lambda r: F.array_join(F.slice(F.filter(F.transform(r, lambda c: S.strip(F.coalesce(c, F.lit("")))), lambda c: c != ""), 1, 3), " ")), lambda t: t != "")
    named = F.filter(titles, lambda t: F.contains(F.upper(t), F.lit("SCHEDULE")) & (F.length(t) < 100))
    short = F.filter(titles, lambda t: (F.length(t) <= 80) & (F.length(t) - F.length(F.replace(t, F.lit(" "))) <= 10))
    return F.coalesce(F.get(named, F.lit(0)), F.get(short, F.lit(0)), F.lit(""))


def extract_schedules(raw_tables: DataFrame) -> DataFrame:
    """Accepted schedule tables: project, page, table_ix, schedule_name, header, rows, mark_columns.

    Blank tables, tables without header on pages without schedule words, and schedules of other trades
    are dropped. NULL cells count as blank; an empty table gives nothing.
    """
    page_text = F.upper(F.coalesce("page_text", F.lit("")))
    t = raw_tables.where(F.col("cells").isNotNull()).where(F.exists("cells", _filled))
    t = _bind(t, cells=F.when(is_horizontal(F.col("cells")), transpose(F.col("cells"))).otherwise(F.col("cells")))
    explicit, by_property = header_row(F.col("cells"))
    t = _bind(t, _h=explicit, _p=by_property, _page=_any(page_text, dims.SCHEDULE_PAGE_WORDS))
    t = t.withColumns({"_page": F.col("_page") | (F.col("_h").isNull() & F.col("_p").isNotNull()), "_h": F.coalesce("_h", "_p")}).where(F.col("_h").isNotNull() | F.col("_page"))
    head_at = F.coalesce("_h", _first_row(F.col("cells"), _filled))
    text = lambda r: F.transform(r, lambda c: S.strip(F.coalesce(c, F.lit(""))))
    t = _bind(t, schedule_name=schedule_name(F.col("cells"), F.col("_h")), header=text(F.get("cells", head_at)), rows=F.transform(F.filter(F.slice("cells", head_at + 2, F.size("cells")), _filled), text))
    upper = F.transform("header", lambda h: F.upper(h))
    name = F.upper("schedule_name")
    t = t.where((F.size("header") > 0) & (F.size("rows") > 0)).where(F.col("_page") | F.contains(F.array_join(upper, " "), F.lit("SCHEDULE"))).where(~_any(name, dims.OTHER_TRADE_WORDS) | _any(name, TRADE_WORDS))
    index = F.sequence(F.lit(0), F.size("header") - 1)
    marks = F.filter(index, lambda i: _any(F.upper(F.get("header", i)), dims.TAG_COLUMN_WORDS) & (F.length(F.get("header", i)) < 25))
    first = F.get(F.filter(F.transform("rows", lambda r: F.get(r, F.lit(0))), lambda v: v != ""), F.lit(0))
    t = _bind(t, _marks=marks, _first=first)
    marks, first = F.col("_marks"), F.col("_first")
    shaped = first.rlike(r"^[A-Za-z]{1,4}-?\d{1,3}[A-Za-z]?$") | ((F.length(first) <= 2) & S.normalize_tag(first).isNotNull())
    marks = F.when(F.size(marks) > 0, marks).when(shaped, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return _bind(t, mark_columns=marks).select("project", "page", "table_ix", "schedule_name", "header", "rows", "mark_columns")


def extract_variables(schedules: DataFrame) -> DataFrame:
    """One row per tag of a data row, with the row's properties and inferred class.

    Tags come from the mark columns, then from description text; ``ord`` keeps table, row and tag order.
    """
    upper = F.transform("header", lambda h: F.upper(h))
    index = F.sequence(F.lit(0), F.size("header") - 1)
    desc = F.filter(index, lambda i: _any(F.get(upper, i), DESCRIPTION_COLUMNS) & ~_any(F.get(upper, i), PART_COLUMNS) & ~F.array_contains("mark_columns", i))
    r = _bind(schedules, desc=desc).select("*", F.posexplode("rows").alias("row_ix", "row"))
    by_mark = F.array_distinct(F.flatten(F.transform("mark_columns", lambda c: S.expand_tag_cell(F.get("row", c)))))
    text = F.array_join(F.filter(F.transform("desc", lambda c: F.get("row", c)), lambda v: v != ""), " ")
    by_text = F.filter(F.transform(S.tags_in_text(text), S.normalize_tag), lambda t: t.isNotNull())
    props = maps.row_to_props(F.col("header"), F.col("row"), F.col("mark_columns"))
    r = _bind(r, tags=F.array_distinct(F.concat(by_mark, by_text)), props=props).where(F.size("tags") > 0)
    service = maps.prop_lookup(F.col("props"), ["SERVICE", "TYPE", "DESCRIPTION"])
    mounting = maps.prop_lookup(F.col("props"), ["MOUNTING", "MOUNT"])
    r = _bind(r, cls=F.coalesce(S.class_of_service(service, F.coalesce(mounting, F.lit(""))), S.class_of_tag(F.get("tags", F.lit(0)))))
    return r.select("project", "page", "table_ix", "schedule_name", "row_ix", "props", "cls", F.posexplode("tags").alias("tag_ix", "tag")).withColumn("ord", F.struct("page", "table_ix", "row_ix", "tag_ix"))


def class_to_tags(variables: DataFrame) -> DataFrame:
    """(project, cls, tag, props, ord): per class its tags, properties of the last occurrence, order of the first.

    Tags without a class of their own take that of their prefix.
    """
    v = variables.withColumn("cls", F.coalesce("cls", S.class_of_tag(F.col("tag")))).where("project is not null and cls is not null and tag is not null")
    return v.groupBy("project", "cls", "tag").agg(F.max_by("props", "ord").alias("props"), F.min("ord").alias("ord"))


def with_fallback(projects: DataFrame, variables: DataFrame, ocr_tables: DataFrame, ocr_tags: DataFrame, least: int = 3) -> DataFrame:
    """(project, tag, source): the tags of every project, from text tables, or for want of them from OCR.

    A project with fewer than ``least`` tags of its own takes those of reconstructed tables besides, and if that
    is not enough the tags read anywhere. All inputs hold (project, tag); repeated and NULL tags count once and
    never; a tag keeps its first source.
    """
    once = lambda df, source, rank: df.where("project is not null and tag is not null").select("project", "tag", F.lit(source).alias("source"), F.lit(rank).alias("rank")).distinct()
    every = once(variables, "text", 0).unionByName(once(ocr_tables, "ocr_table", 1)).unionByName(once(ocr_tags, "ocr_tag", 2))
    first = every.groupBy("project", "tag").agg(F.min(F.struct("rank", "source")).alias("f")).select("project", "tag", "f.rank", "f.source")
    # tags per project up to each source: three counts, no window over a project's rows
    count = first.groupBy("project").agg(F.count_if(F.col("rank") == 0).alias("text"), F.count_if(F.col("rank") <= 1).alias("tables"))
    j = projects.select("project").where("project is not null").distinct().join(first, "project").join(count, "project")
    return j.where((F.col("rank") == 0) | ((F.col("rank") == 1) & (F.col("text") < least)) | ((F.col("rank") == 2) & (F.col("text") < least) & (F.col("tables") < least))).select("project", "tag", "source")


def legend(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """(project, abbr, description): two-cell rows and ABBR - text lines; on a page lines win, later pages win.

    ``tables``: project, page, cells; ``lines``: project, page, line_no, line.
    """
    cells = tables.select("project", "page", F.posexplode("cells").alias("at", "row")).withColumn("c", F.filter(F.transform("row", lambda c: S.collapse(F.coalesce(c, F.lit("")))), lambda c: c != "")).where("size(c) = 2")
    a = cells.select("project", "page", F.lit(0).alias("source"), "at", F.get("c", F.lit(0)).alias("abbr"), F.get("c", F.lit(1)).alias("description")).where("length(abbr) < 15 and length(description) > 3")
    rx = r"^\s*([A-Z][A-Z0-9/&.]{0,13})\s*[-=:]\s*([A-Z][^\n]{3,})$"
    b = lines.where(F.col("line").rlike(rx)).select("project", "page", F.lit(1).alias("source"), F.col("line_no").alias("at"), F.regexp_extract("line", rx, 1).alias("abbr"), F.trim(F.regexp_extract("line", rx, 2)).alias("description"))
    return a.unionByName(b).groupBy("project", "abbr").agg(F.max_by("description", F.struct("page", "source", "at")).alias("description"))


# Patterns of LABEL: value on one line, by field.
TITLE_INLINE = {
    "scale": [r"\bSCALE\s*[:=]\s*([0-9/\"'\-=\s.]{1,30}(?:'|\"|FT)[0-9'\-\"=\s.]{0,20})", r"\bSCALE\s*[:=]\s*(AS\s+NOTED|NTS|N\.T\.S\.|NONE)"],
    "date": [r"\bDATE\s*[:=]\s*([0-9]{1,2}[\-/.][0-9]{1,2}[\-/.][0-9]{2,4})", r"\b(?:ISSUE[D]?|PLOT)\s*DATE\s*[:=]\s*([0-9]{1,2}[\-/.][0-9]{1,2}[\-/.][0-9]{2,4})"],
    "sheet": [r"\bSHEET\s*(?:NO\.?|NUMBER)\s*[:=]\s*([A-Z]{1,3}[\-.]?[0-9]{1,4}(?:\.[0-9]+)?)", r"\bDRAWING\s*(?:NO\.?|NUMBER)\s*[:=]\s*([A-Z]{1,3}[\-.]?[0-9]{1,4})"],
    "project": [r"\bPROJECT\s*(?:NAME)?\s*[:=]\s*([^\n\r]{3,80})", r"\bJOB\s*(?:NAME|NO\.?)\s*[:=]\s*([^\n\r]{3,80})"],
    "engineer": [r"\bENGINEER\s*(?:OF\s*RECORD)?\s*[:=]\s*([^\n\r]{3,60})", r"\bDESIGNED\s*BY\s*[:=]\s*([^\n\r]{2,40})", r"\bDRAWN\s*BY\s*[:=]\s*([^\n\r]{2,40})"],
    "firm": [r"\b(?:MECHANICAL\s+ENGINEER|MEP\s+ENGINEER|CONSULTANT)\s*[:=]\s*([^\n\r]{3,80})"],
    "revision": [r"\bREV(?:ISION)?\s*(?:NO\.?)?\s*[:=]\s*([0-9A-Z]{1,4})\b"],
}
# Labels that stand on a line of their own, with the value below.
TITLE_STACKED = {
    "project": r"(?i)^(?:PROJECT\s*(?:NAME|TITLE)?|JOB\s*(?:NAME|TITLE)?)\s*:?$",
    "date": r"(?i)^(?:DATE|ISSUE(?:D)?\s*DATE)\s*:?$",
    "scale": r"(?i)^SCALE\s*:?$",
    "sheet": r"(?i)^(?:SHEET|DRAWING)\s*(?:NO\.?|NUMBER)?\s*:?$",
    "engineer": r"(?i)^(?:DRAWN|DESIGNED|CHECKED)\s*BY\s*:?$",
}
# Lines that are labels themselves, and lines in capitals that are headings.
LABEL_LINE = r"(?i)^(?:Project|Job|Sheet|Drawing|Date|Scale|Revision|Description|Drawn|Designed|Checked|By|No\.?|Number|Name|Title|Tel|Phone|Fax|Email)\s*(?:Name|Number|Title|By|No\.?|:)?\s*:?$"
HEADING_LINE = r"^[A-Z][A-Z\s]{2,30}:?$"
# What a field's value must look like, and what it must not.
TITLE_SHAPE = {
    "scale": r"(?i)[0-9/][\"']|NTS|N\.T\.S|AS\s+NOTED|NONE",
    "date": r"[0-9]{1,2}[\-/.][0-9]{1,2}[\-/.][0-9]{2,4}|[A-Z][a-z]+\s+\d{1,2}[,\s]+\d{4}",
    "sheet": r"^[A-Z]{1,3}[\-.]?[0-9]{1,4}(?:\.[0-9]+)?$",
    "revision": r"^[0-9]{1,3}$|^[A-Z]$",
    "project": r"^.{5,}$",
    "engineer": r"^.{2,40}$",
    "firm": r"^.{4,}$",
}
TITLE_NEVER = {"project": r"(?i)^(?:Project|Job|Sheet|Drawing|Date|Scale|Revision)\s*(?:Name|Number|Title|No\.?)?$", "engineer": r"\d{3,}"}
FIRM_LINE = r"(?m)^([A-Z][A-Z&.\-' ,]{2,60}\s+(?:ENGINEERING|ENGINEERS|CONSULTANTS?|ASSOCIATES|DESIGN(?:S)?|GROUP|ARCHITECTS?)(?:\s*,?\s*(?:INC|LLC|LLP|P\.?C\.?|PLLC)\.?)?)\s*$"
BELOW = 3  # lines below a label that may hold its value
# Texts of labels on a sheet, by field.
SPATIAL_LABELS = {
    "project": ["Project Name", "Job Name", "Job Title", "Project"],
    "project_no": ["Project Number", "Project No.", "Project No", "Job Number", "Job No.", "Job No"],
    "description": ["Description", "Sheet Title", "Drawing Title"],
    "sheet": ["Sheet Number", "Sheet No.", "Sheet No", "Drawing Number", "Drawing No."],
    "scale": ["Scale"],
    "date": ["Date", "Issue Date", "Plot Date"],
    "engineer": ["Drawn By", "Designed By", "Checked By", "Engineer"],
    "firm": ["Architect", "Mechanical Engineer", "MEP Engineer", "Consultant"],
}


def valid_field(field: str, v: Column) -> Column:
    """Whether a cleaned text can be the value of a title-block field."""
    ok = ~S.bad_value(v)
    if field in TITLE_SHAPE:
        ok = ok & v.rlike(TITLE_SHAPE[field])
    return ok & ~v.rlike(TITLE_NEVER[field]) if field in TITLE_NEVER else ok


def stacked_value(lines: Column, field: str) -> Column:
    """The value below a label line: per label the first of the next lines that passes, the first label with one."""
    fits = lambda c: (c != "") & (F.length(c) < 80) & ~S.bad_value(c) & ~c.rlike(LABEL_LINE) & ~c.rlike(HEADING_LINE) & valid_field(field, S.clean_value(c))
    below = lambda i: F.get(F.filter(F.slice(lines, i + 2, F.lit(BELOW)), fits), F.lit(0))
    found = F.transform(lines, lambda ln, i: F.when(ln.rlike(TITLE_STACKED[field]), below(i)))
    return S.clean_value(F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0)))


def title_block(pages: DataFrame, key: str = "project", text: str = "text") -> DataFrame:
    """Title-block fields of a document's text: inline labels, then lines below a label, firm and address.

    NULL and empty texts have no fields. A label without a valid value gives way to the next.
    """
    p = _bind(pages.select(key, text), _lines=F.transform(F.split(text, "\n"), S.strip))
    out = {}
    for f, patterns in TITLE_INLINE.items():
        inline = S.inline_field(F.col(text), patterns, lambda v, f=f: valid_field(f, v))
        out[f"info_{f}"] = F.coalesce(inline, stacked_value(F.col("_lines"), f)) if f in TITLE_STACKED else inline
    firms = F.transform(F.regexp_extract_all(text, F.lit(FIRM_LINE), 1), S.clean_value)
    out["info_firm"] = F.coalesce(out["info_firm"], F.get(F.filter(firms, lambda v: ~S.bad_value(v)), F.lit(0)))
    out["info_address"] = S.street_address(F.col(text))
    return p.select(key, *[c.alias(n) for n, c in out.items()])


def spatial_fields(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by.., field, value): labels of the first page paired with the value above or to the right of them.

    spans(by.., page, span_id, x0, y0, x1, y1, text) in display space. Of several values of a field that of
    the tallest text wins, then the label that comes first.
    """
    from tallysheet.operators.cascade import label_values

    known = F.create_map(*[F.lit(x) for f, names in SPATIAL_LABELS.items() for n in names for x in (n.lower(), f)])
    s = spans.where("page = 0").withColumn("_norm", F.lower(F.regexp_replace(S.strip(F.col("text")), ":+$", "")))
    s = s.withColumn("_field", F.try_element_at(known, F.col("_norm")))
    box = [((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h")]
    labels = s.where("_field is not null").select(*by, F.col("span_id").alias("label_id"), "_field", *box)
    values = s.where("_field is null").where(~F.col("text").rlike(r"^[\W_]*$")).select(*by, F.col("span_id").alias("value_id"), *box[:2], box[3], "text")
    pairs = label_values(labels, values, by).join(labels.select(*by, "label_id", "_field"), [*by, "label_id"])
    cleaned = pairs.withColumn("v", S.clean_value(F.col("text")))
    valid = F.lit(False)
    for f in SPATIAL_LABELS:
        valid = F.when(F.col("_field") == f, valid_field(f, F.col("v"))).otherwise(valid)
    ok = cleaned.where(valid)
    return ok.groupBy(*by, F.col("_field").alias("field")).agg(F.max_by("v", F.struct("h", -F.col("label_id"))).alias("value"))
