"""Several values packed in one field, split into one row per value with its position.

Method: a parsing expression grammar. A cell is tried against ordered alternatives (quoted value,
bracketed status, the kind's own values, bare text up to a delimiter); the first alternative that
matches wins and the parser backtracks where a quote is not closed, reading it as an ordinary
character and flagging the cell. Kinds of cell differ only in their value rule:

=========== ===============================================================================
mark        equipment marks; ranges (``AC-1 THRU AC-4``) and short forms (``AC-1, 2``) are
            expanded to every mark meant; a status letter in parentheses is no value
maker       a maker of the ``makers`` table is one value however many delimiters it holds
area        text between delimiters
note        note numbers; a leading word is no value
electrical  volts, phase and hertz
=========== ===============================================================================

Cells that cannot hold two values (no delimiter, word or digit group of the kind) are kept out of
Python by a JVM-side filter.

Defined results: NULL, empty and place-holder cells hold no value; stray delimiters hold none; a
repeated row repeats its values (``p5_found`` is distinct); very long cells are parsed whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names (upper case, single blanks) by kind of cell.
KINDS = {
    "mark": ("MARK", "TAG", "SYMBOL", "UNIT NO.", "UNIT NO"),
    "maker": ("MANUFACTURER", "MFR", "MFR.", "BASIS OF DESIGN"),
    "area": ("AREA SERVED", "SERVES"),
    "note": ("NOTES", "SCHEDULE NOTES"),
    "electrical": ("ELECTRICAL", "V/PH/HZ", "POWER SUPPLY"),
}
PLACEHOLDERS = {"", "-", "--", "N/A", "NA", "NONE", "TBD", "SEE PLAN", "*", "–", "—"}
MAX_RANGE = 1000  # a range of more values than this leaves Python as start and length
BLOCK = 10_000  # values of such a range that the JVM makes in one piece
MOST = 2**31 - 1  # value_index is an int: ranges beyond it are read as their ends and flagged
UNEXPANDED = "range not expanded"


class Long(str):
    """The first value of a long range, with what the rest is made of."""

    def __new__(cls, head: str, low: int, high: int, width: int, tail: str):
        new = super().__new__(cls, f"{head}{str(low).zfill(width)}{tail}")
        new.head, new.low, new.high, new.width, new.tail = head, low, high, width, tail
        return new

    @property
    def many(self) -> int:
        return self.high - self.low + 1

    @property
    def last(self) -> str:
        return f"{self.head}{str(self.high).zfill(self.width)}{self.tail}"


Value = tuple[str, int, str]  # text, offset in the cell, flag ('' or what was odd)

_WS = re.compile(r"[\s\u00a0]*")
_QUOTES = {'"': '"', "“": "”", "'": "'"}


class Grammar:
    """Cell <- Delim* (Value Delim*)* ; Value <- Quoted / Bracketed / Own / Bare."""

    delim = re.compile(r"[\s\u00a0]*(?:[,;/|&+\n]|\b(?:AND|OR)\b)[\s\u00a0]*", re.I)
    nothing = re.compile(r"(?:N/A|NONE|TBD|SEE PLAN|-{1,3}|[–—*])(?=\s*(?:[,;/|&+\n]|$))", re.I)
    quotes = '"“'

    def cell(self, s: str) -> list[Value]:
        out: list[Value] = []
        flag = ""
        at = 0
        while at < len(s):
            at = _WS.match(s, at).end()
            if at >= len(s):
                break
            d = self.delim.match(s, at)
            if d and d.end() > at:
                at = d.end()
                continue
            blank = self.nothing.match(s, at)
            if blank:  # a place-holder is no value, whatever delimiters it holds
                at = blank.end()
                continue
            got = self.quoted(s, at) or self.bracketed(s, at) or self.own(s, at, out) or self.bare(s, at)
            if got is None:  # nothing matches: skip a character, flag what follows
                at += 1
                flag = "skipped"
                continue
            values, end = got
            out += [(v, o, f or flag) for v, o, f in values if v.strip().upper() not in PLACEHOLDERS]
            flag = ""
            at = max(end, at + 1)
        return out

    def quoted(self, s: str, at: int) -> tuple[list[Value], int] | None:
        """A quoted value ends at a quote followed by a delimiter, blank or the end; a doubled quote is a character."""
        if s[at] not in self.quotes:
            return None
        close, j = _QUOTES[s[at]], at + 1
        while j < len(s):
            if s[j] == close:
                if s[j + 1 : j + 2] == close:
                    j += 2
                    continue
                after = _WS.match(s, j + 1).end()
                if after >= len(s) or after > j + 1 or self.delim.match(s, after) or s[after] in ",;/|&+\n-–":
                    text = s[at + 1 : j].replace(close * 2, close)
                    return [(text, at + 1, "")], j + 1
            j += 1
        return None  # not closed: backtrack, the quote is an ordinary character

    def bracketed(self, s: str, at: int) -> tuple[list[Value], int] | None:
        return None

    def own(self, s: str, at: int, before: list[Value]) -> tuple[list[Value], int] | None:
        return None

    def bare(self, s: str, at: int) -> tuple[list[Value], int] | None:
        j = at + 1 if s[at] in self.quotes else at
        end = len(s)
        k = j
        while k < len(s):
            d = self.delim.match(s, k)
            if d and d.end() > k:
                end = k
                break
            k += 1
        text = s[j:end].strip(" \t\r\n\u00a0")
        return ([(text, j, "open quote" if j > at else "")] if text else []), max(end, at + 1)


class Marks(Grammar):
    delim = re.compile(r"[\s\u00a0]*(?:[,;/|&+\n]|\b(?:AND|OR|THRU|THROUGH|TO)\b)[\s\u00a0]*", re.I)
    status = re.compile(r"\([\s\u00a0]*[A-Za-z]{1,3}[\s\u00a0]*\)[\s\u00a0]*")
    mark = re.compile(r"([A-Za-z]{1,6})[\s\u00a0]?[-–][\s\u00a0]?([A-Za-z]{0,2})(\d+)([A-Za-z]?)(?![A-Za-z0-9])")
    short = re.compile(r"([A-Za-z]{0,2})(\d+)([A-Za-z]?)(?![A-Za-z0-9])")
    through = re.compile(r"[\s\u00a0]*(?:\b(?:THRU|THROUGH|TO)\b|[-–—]|\.\.+)[\s\u00a0]*", re.I)

    def bracketed(self, s: str, at: int) -> tuple[list[Value], int] | None:
        m = self.status.match(s, at)
        return ([], m.end()) if m else None

    def own(self, s: str, at: int, before: list[Value]) -> tuple[list[Value], int] | None:
        m = self.mark.match(s, at)
        if m:
            first, end = m.groups(), m.end()
        else:  # short form: number alone, the letters are those of the mark before it
            prior = next((p for v, _, _ in reversed(before) if (p := self.mark.fullmatch(v.strip()))), None)
            m = self.short.match(s, at)
            if not (prior and m):
                return None
            first, end = (prior[1], m[1] or prior[2], m[2], m[3]), m.end()
        t = self.through.match(s, end)
        if t and t.end() > end:
            last = self.mark.match(s, t.end())
            if last:
                stop = last.groups()
            else:
                last = self.short.match(s, t.end())
                stop = (first[0], last[1] or first[1], last[2], last[3]) if last else None
            if last and stop:
                many = self.expand(first, stop, at)
                if many:
                    return many, last.end()
                return [(self.text(*first), at, UNEXPANDED)], end
        return [(self.text(*first), at, "")], end

    @staticmethod
    def text(letters: str, mid: str, number: str, suffix: str) -> str:
        return f"{letters.upper()}-{mid.upper()}{number}{suffix.upper()}"

    def expand(self, a: tuple, b: tuple, at: int) -> list[Value] | None:
        """Every mark from a to b, ends included; None when they do not form a range."""
        if a[0].upper() != b[0].upper() or a[1].upper() != b[1].upper():
            return None
        if a[2] == b[2] and len(a[3]) == 1 == len(b[3]) and a[3].upper() <= b[3].upper():
            return [(self.text(a[0], a[1], a[2], chr(c)), at, "") for c in range(ord(a[3].upper()), ord(b[3].upper()) + 1)]
        lo, hi = int(a[2]), int(b[2])
        if a[3].upper() != b[3].upper() or hi < lo:
            return None
        width = len(a[2]) if a[2].startswith("0") else 0
        if hi - lo >= MAX_RANGE:
            return [(Long(self.text(a[0], a[1], "", ""), lo, hi, width, a[3].upper()), at, "")] if hi < 10**18 else None
        return [(self.text(a[0], a[1], str(n).zfill(width), a[3]), at, "") for n in range(lo, hi + 1)]


class Makers(Grammar):
    delim = re.compile(r"[\s\u00a0]*(?:[,;/|&+\n]|\b(?:OR|AND)\b)[\s\u00a0]*", re.I)

    def __init__(self, makers: list[str]):
        names = sorted({m.strip() for m in makers if m and m.strip()}, key=len, reverse=True)
        self.known = re.compile("(?:" + "|".join(r"[\s\u00a0]+".join(map(re.escape, n.split())) for n in names) + r")(?![A-Za-z0-9])", re.I) if names else None

    def own(self, s: str, at: int, before: list[Value]) -> tuple[list[Value], int] | None:
        m = self.known.match(s, at) if self.known else None
        return ([(m[0], at, "")], m.end()) if m else None


class Areas(Grammar):
    delim = re.compile(r"[\s\u00a0]*(?:[,;/|&+\n]|\bAND\b)[\s\u00a0]*", re.I)


class Notes(Grammar):
    delim = re.compile(r"[\s\u00a0]*(?:[,;/|&+\n.:]|\bAND\b)[\s\u00a0]*", re.I)
    word = re.compile(r"(?:(?:SEE|REFER|TO|NOTES?|NO\.?|NOS\.?|#)[\s\u00a0:]*)+", re.I)
    number = re.compile(r"#?(\d+)([A-Za-z]?)(?![A-Za-z0-9])")
    through = Marks.through

    def bracketed(self, s: str, at: int) -> tuple[list[Value], int] | None:
        m = self.word.match(s, at)
        return ([], m.end()) if m and m.end() > at else None

    def own(self, s: str, at: int, before: list[Value]) -> tuple[list[Value], int] | None:
        m = self.number.match(s, at)
        if not m:
            return None
        t = self.through.match(s, m.end())
        last = self.number.match(s, t.end()) if t and t.end() > m.end() else None
        if last and int(m[1]) < int(last[1]) < int(m[1]) + MAX_RANGE:
            return [(str(n), at, "") for n in range(int(m[1]), int(last[1]) + 1)], last.end()
        if last and int(m[1]) < int(last[1]) < 10**18:
            return [(Long("", int(m[1]), int(last[1]), 0, ""), at, "")], last.end()
        return [(m[0], at, UNEXPANDED if last else "")], m.end()

    def bare(self, s: str, at: int) -> tuple[list[Value], int] | None:
        return [], at + 1


class Electrical(Grammar):
    delim = re.compile(r"[\s\u00a0]*[,;/|&+\n\-–—][\s\u00a0]*")
    number = re.compile(r"(\d+(?:\.\d+)?)[\s\u00a0]*(?:VOLTS?|VAC|V|PHASES?|PH|Ø|ø|HERTZ|HZ)?(?![A-Za-z])", re.I)

    def own(self, s: str, at: int, before: list[Value]) -> tuple[list[Value], int] | None:
        m = self.number.match(s, at)
        return ([(m[1], at, "")], m.end()) if m else None

    def bare(self, s: str, at: int) -> tuple[list[Value], int] | None:
        m = re.compile(r"[^\d]+").match(s, at)
        return [], m.end() if m else at + 1


def grammars(makers: list[str]) -> dict[str, Grammar]:
    return {"mark": Marks(), "maker": Makers(makers), "area": Areas(), "note": Notes(), "electrical": Electrical()}


def kind_of(name: Column) -> Column:
    n = F.upper(F.trim(F.regexp_replace(name, r"[\s\u00a0]+", " ")))
    out = F.lit(None).cast("string")
    for kind, names in KINDS.items():
        out = F.when(n.isin(*names), F.lit(kind)).otherwise(out)
    return out


def _maybe_several(kind: Column, cell: Column) -> Column:
    """False only for cells that surely hold fewer than two values."""
    words = r"(?i)[,;/|&+\n\"“]|\b(and|or|thru|through|to)\b|[-–—].*[-–—]|[\s\u00a0].*\d|\d.*[\s\u00a0]"
    return F.when(kind == "note", cell.rlike(r"\d[^\d]+\d")).when(kind == "electrical", cell.rlike(r"\d[^\d]+\d")).otherwise(cell.rlike(words))


CELLS = "source_table string, record_id bigint, row_index int, field_name string, kind string, cell string"
VALUES = "source_table string, record_id bigint, row_index int, field_name string, value_index int, value string, start int, flag string, n_values int"
_ARROW = pa.schema([("source_table", pa.string()), ("record_id", pa.int64()), ("row_index", pa.int32()), ("field_name", pa.string()), ("value_index", pa.int32()), ("value", pa.string()), ("start", pa.int32()), ("flag", pa.string()), ("n_values", pa.int32()), ("head", pa.string()), ("low", pa.int64()), ("many", pa.int64()), ("width", pa.int32()), ("tail", pa.string())])


def _counted(values: list[Value]) -> tuple[list[Value], int]:
    """The values and how many they stand for; ranges beyond an int are their two ends."""
    total = sum(v.many if isinstance(v, Long) else 1 for v, _, _ in values)
    if total <= MOST:
        return values, total
    ends = [x for v, o, f in values for x in ([(str(v), o, UNEXPANDED), (v.last, o, UNEXPANDED)] if isinstance(v, Long) else [(v, o, f)])]
    return ends, len(ends)


def schedule_cells(schedule_tables: DataFrame) -> DataFrame:
    """Cells of the splittable columns of schedule rows."""
    cells = schedule_tables.where("table_id is not null").select("table_id", F.posexplode("rows").alias("row_index", "r")).where("r is not null").select("table_id", "row_index", F.explode("r").alias("field_name", "cell"))
    return cells.withColumn("kind", kind_of(F.col("field_name"))).where("kind is not null and cell is not null").select(F.lit("schedule_tables").alias("source_table"), F.col("table_id").alias("record_id"), "row_index", "field_name", "kind", "cell")


def tag_cells(tag_variables: DataFrame) -> DataFrame:
    """The tag cells of tag variables."""
    return tag_variables.where("var_id is not null and tag is not null").select(F.lit("tag_variables").alias("source_table"), F.col("var_id").alias("record_id"), F.lit(0).alias("row_index"), F.lit("tag").alias("field_name"), F.lit("mark").alias("kind"), F.col("tag").alias("cell"))


def split_cells(cells: DataFrame, makers: list[str], least: int = 2) -> DataFrame:
    """One row per value of every cell that holds at least ``least`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = grammars(makers)
        for b in batches:
            cols: list[list] = [[] for _ in _ARROW]
            for table, rid, row, field, kind, cell in zip(*(c.to_pylist() for c in b.columns), strict=True):
                values, total = _counted(rules[kind].cell(cell))
                if total < least:
                    continue
                i = 0
                for v, start, flag in values:
                    rest = (v.head, v.low, v.many, v.width, v.tail) if isinstance(v, Long) else (None, None, 1, None, None)
                    for c, x in zip(cols, (table, rid, row, field, i, str(v), start, flag, total, *rest), strict=True):
                        c.append(x)
                    i += rest[2]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    if least >= 2:
        cells = cells.where(_maybe_several(F.col("kind"), F.col("cell")))
    rows = cells.mapInArrow(run, VALUES + ", head string, low bigint, many bigint, width int, tail string")
    # one pass: a single value is a range of one
    k = F.explode(F.expr(f"sequence(block * {BLOCK}, least(many - 1, block * {BLOCK} + {BLOCK - 1}))"))
    each = rows.withColumn("block", F.explode(F.expr(f"sequence(0L, (many - 1) div {BLOCK})"))).withColumn("k", k)
    number = (F.col("low") + F.col("k")).cast("string")
    padded = F.when(F.length(number) >= F.col("width"), number).otherwise(F.lpad(number, F.col("width"), F.lit("0")))
    value = F.when(F.col("many") == 1, F.col("value")).otherwise(F.concat("head", padded, "tail"))
    return each.withColumns({"value": value, "value_index": (F.col("value_index") + F.col("k")).cast("int")}).select(*_ARROW.names[:9])


def maker_names(makers: DataFrame) -> list[str]:
    """The makers as a list; a fixed small table, more than 10,000 are refused."""
    rows = makers.where("maker_name is not null").select("maker_name").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("makers must stay a small fixed table (at most 10,000 names)")
    return [r[0] for r in rows]


def split_packed(schedule_tables: DataFrame, tag_variables: DataFrame, makers: DataFrame) -> DataFrame:
    """Values of all cells that hold several, from schedules and tag variables."""
    return split_cells(schedule_cells(schedule_tables).unionByName(tag_cells(tag_variables)), maker_names(makers))
