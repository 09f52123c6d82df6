"""String functions as column expressions: tags, classes, text repair, labels.

Every function takes and returns columns; NULL in gives NULL out unless said otherwise. Python's
strip and ``\\s`` also take no-break spaces, hence the explicit character classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysheet.functions import dims

WS = r"[\s\u00a0]"
STATUS = r"(?i)^\(\s*[ERN]\s*\)\s*"
EDGE = ".-,;:|/"


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once; expressions are otherwise repeated where used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Blanks of any kind collapsed to one, outer ones removed."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def trim_chars(c: Column, chars: str = EDGE) -> Column:
    cls = "[" + "".join("\\" + x for x in chars) + "]"
    return F.regexp_replace(c, f"^{cls}+|{cls}+$", "")


def strip_status(c: Column) -> Column:
    """(E), (R) or (N) before a mark says existing, relocated or new and is no part of it."""
    return strip(F.regexp_replace(strip(c), STATUS, ""))


def fragments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"{WS}+"), lambda f: trim_chars(f)), lambda f: f != "")


def normalize_tag(raw: Column) -> Column:
    """The canonical tag of a cell, or NULL where it holds none.

    Existing-status prefixes go; of several fragments the first that begins with a letter and the one
    after it are joined; refrigerants, sheet numbers, model numbers, column leaks and junk are none.
    """
    def joined(frags: Column) -> Column:
        first = F.array_position(F.transform(frags, lambda f: f.rlike("^[A-Za-z]")), True)
        return F.when(F.size(frags) == 1, F.get(frags, F.lit(0))).when(first > 0, F.array_join(F.slice(frags, F.greatest(first, F.lit(1)).cast("int"), F.lit(2)), "-"))

    return let(trim_chars(let(fragments(strip_status(raw)), joined), EDGE + " "), _judged)


def _judged(s: Column) -> Column:
    """A cleaned-up text as a tag in upper case, or NULL where it is none."""
    bare = F.regexp_replace(s, "-", "")
    parts = F.split(s, "-")
    shaped = bare.rlike("^[A-Za-z][A-Za-z0-9]{0,15}$") | ((F.size(parts) <= 3) & F.forall(parts, lambda p: p.rlike("^[A-Za-z0-9]+$")))
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    model = ~s.contains("-") & (F.length(s) > 8) & (letters >= 4)
    digit = s.rlike("[0-9]")
    suffixed = s.rlike("^[A-Za-z]{1,5}-[A-Za-z]{1,3}$") & F.try_element_at(dims.literal_map(dims.TAG_PREFIX), F.upper(F.split_part(s, F.lit("-"), F.lit(1)))).isNotNull()
    ok = (
        s.rlike("^[A-Za-z]")
        & shaped
        & F.length(s).between(1, 20)
        & ~F.upper(s).isin(*dims.JUNK_TAGS)
        & ~s.rlike(r"(?i)^R-?\d{2,4}[A-Z]?$")
        & ~s.rlike(r"^[A-Za-z]\d{3}$")
        & ~model
        & ~F.regexp_extract(F.upper(s), "^([A-Z]+)", 1).isin(*dims.BANNED_PREFIXES)
        & (digit | (F.length(s) <= 2) | suffixed)
    )
    return F.when(ok, F.upper(s))


def split_compound(raw: Column) -> Column:
    """Parts between , ; / and &; ``AC-1,2`` names AC-1 and AC-2."""
    def named(parts: Column) -> Column:
        letters = F.regexp_extract(strip_status(F.upper(F.get(parts, F.lit(0)))), r"^([A-Z]+)-\d+$", 1)
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        short = (letters != "") & (F.size(parts) > 1) & F.forall(rest, lambda p: p.rlike(r"^\d+$"))
        return F.when(short, F.concat(F.slice(parts, 1, 1), F.transform(rest, lambda p: F.concat(letters, F.lit("-"), p)))).otherwise(parts)

    return let(F.filter(F.transform(F.split(strip(raw), "[,;/&]"), strip), lambda p: p != ""), named)


# Fixed value: the shape of a range of marks.
_RANGE = r"^([A-Z]{1,4})-?(\d{1,9})\s*(?:THRU|THROUGH|TO|-|\u2013|\u2014)\s*(?:([A-Z]{1,4})-?)?(\d{1,9})$"


def expand_range(raw: Column) -> Column:
    """CU-1 THRU CU-6 as its marks; NULL where the text is no range (or of more than 101 marks)."""
    def marks(s: Column) -> Column:
        a, b = F.regexp_extract(s, _RANGE, 2).try_cast("int"), F.regexp_extract(s, _RANGE, 4).try_cast("int")
        p, q = F.regexp_extract(s, _RANGE, 1), F.regexp_extract(s, _RANGE, 3)
        ok = s.rlike(_RANGE) & ((q == "") | (q == p)) & (b >= a) & (b - a <= 100)
        return F.when(ok, F.transform(F.sequence(F.coalesce(a, F.lit(0)), F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))), lambda n: F.concat(p, F.lit("-"), n.cast("string"))))

    return let(collapse(F.upper(raw)), marks)


def split_multi_number(raw: Column) -> Column:
    """24 VAV 27 names VAV-24 and VAV-27; NULL where it is nothing like it."""
    def marks(f: Column) -> Column:
        digits, letters = F.filter(f, lambda x: x.rlike(r"^\d{1,3}$")), F.filter(f, lambda x: x.rlike("^[A-Za-z]{1,5}$"))
        return F.when((F.size(f) >= 3) & (F.size(digits) >= 2) & (F.size(letters) == 1), F.transform(digits, lambda d: F.concat(F.upper(F.get(letters, F.lit(0))), F.lit("-"), d)))

    return let(fragments(strip(raw)), marks)


def _valid(tags: Column) -> Column:
    return F.filter(F.transform(tags, normalize_tag), lambda t: t.isNotNull())


def expand_tag_cell(raw: Column) -> Column:
    """All tags of a cell: lines, several numbers, range or compound, whichever applies first."""
    s = strip(raw)
    lines = F.filter(F.transform(F.split(s, "\n"), strip), lambda x: x != "")

    def choose(lines: Column) -> Column:
        whole = s.contains("\n") & (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(r"^[A-Za-z]{1,5}-?\d") | x.rlike("^[A-Za-z]{2,5}-[A-Za-z0-9]+$"))
        by_line = F.when(whole, F.nullif(_valid(lines), F.array().cast("array<string>")))
        multi = split_multi_number(raw)
        ranged = expand_range(raw)
        # the first alternative that applies gives the raw tags; they are normalised once
        return F.coalesce(by_line, _valid(F.coalesce(multi, ranged, split_compound(raw))))

    empty = F.array().cast("array<string>")
    return F.when(raw.isNull() | (s == ""), empty).otherwise(let(lines, choose))


def tags_in_text(text: Column, most_letters: int = 4) -> Column:
    """Tags named in running text whose letters are a known prefix or one of A to D."""
    found = F.regexp_extract_all(F.upper(text), F.lit(rf"\b([A-Z]{{1,{most_letters}}}-?\d+[A-Z]?(?:-[A-Z]+)?)\b"), 1)
    letters = lambda t: F.regexp_extract(t, "^([A-Z]+)", 1)
    return F.filter(found, lambda t: F.try_element_at(dims.literal_map(dims.TAG_PREFIX), letters(t)).isNotNull() | letters(t).isin("A", "B", "C", "D"))


def mark_type(tag: Column) -> Column:
    """The letters a mark begins with, else the text before its first hyphen."""
    lead = F.regexp_extract(tag, "^([A-Za-z]+)", 1)
    return F.when(lead != "", lead).otherwise(F.split_part(tag, F.lit("-"), F.lit(1)))


def alnum_fold(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def value_fold(c: Column) -> Column:
    return collapse(F.regexp_replace(F.upper(c), "[\"']", ""))


def ocr_digits(c: Column) -> Column:
    """Letters read for digits, unconditionally."""
    return F.translate(F.upper(c), "OILSBZ", "011582")


def ocr_digits_if(c: Column, numeric: Column) -> Column:
    return F.when(numeric, collapse(F.translate(F.upper(c), "OISBZ", "01582"))).otherwise(c)


def class_alias(c: Column) -> Column:
    """Blanks collapsed, then one lookup; names without an alias stand for themselves."""
    n = collapse(c)
    return F.coalesce(F.try_element_at(dims.literal_map(dims.CLASS_ALIAS), n), n)


def product_name(c: Column) -> Column:
    return class_alias(F.upper(c))


def brand_model(c: Column) -> Column:
    """struct(brand, model): at ' / ', else the model begins at the first later word with a digit."""
    s = collapse(c)
    words = F.split(s, " ")
    at = F.array_position(F.transform(words, lambda w, i: (i > 0) & w.rlike("[0-9]")), True)
    slash = F.instr(s, " / ")
    brand = F.when(slash > 0, F.trim(F.substring_index(s, " / ", 1))).when(at > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), " ")).otherwise(s)
    model = F.when(slash > 0, F.trim(F.substr(s, slash + F.lit(3)))).when(at > 0, F.array_join(F.slice(words, F.greatest(at, F.lit(1)).cast("int"), F.size(words)), " ")).otherwise(F.lit(""))
    return F.struct(brand.alias("brand"), model.alias("model"))


def clean_value(c: Column) -> Column:
    """A label's value without the marks around it."""
    return collapse(F.regexp_replace(strip(c), r"^[\s:\-=]+|[\s:\-=]+$", ""))


# Words that never begin a title-block value.
BAD_STARTS = ["ISSUE", "ISSUED", "NOT", r"TO\s+BE", "FOR", "APPROVED", "REVIEWED", "SEE", "DESCRIPTION", r"NO\.", "NOTE", "NOTES", "BY"]
BAD_START = rf"(?i)^(?:{'|'.join(BAD_STARTS)})\b"


def bad_value(c: Column) -> Column:
    """Texts that follow a label and are no value."""
    return (F.length(c) < 2) | c.rlike(BAD_START)


def inline_field(text: Column, patterns: list[str], valid=lambda v: ~bad_value(v)) -> Column:
    """LABEL: value by an ordered list of patterns (group 1 is the value, case does not matter); of each
    pattern the first place counts, and the first pattern with a valid value wins."""
    out = []
    for rx in patterns:
        v = clean_value(F.regexp_extract(text, f"(?i){rx}", 1))
        out.append(F.when((v != "") & valid(v), v))
    return F.coalesce(*out)


# Fixed value: the shape of a street address.
ADDRESS = r"\b([0-9]{2,5}\s+[A-Z][A-Za-z0-9.'\-]+(?:\s+[A-Z][A-Za-z0-9.'\-]+){1,5}\s+(?:ST|STREET|AVE|AVENUE|RD|ROAD|BLVD|DR|DRIVE|WAY|LN|LANE|CT|COURT|PL|PLACE|CIR|CIRCLE|CTR|CENTER|CENTRE)\.?)\b"


def street_address(text: Column) -> Column:
    return F.nullif(clean_value(F.regexp_extract(text, ADDRESS, 1)), F.lit(""))


def levenshtein_capped(a: Column, b: Column, gap: int = 4) -> Column:
    """Edit distance; 99 where the lengths differ by more than ``gap``."""
    return F.when(F.abs(F.length(a) - F.length(b)) > gap, F.lit(99)).otherwise(F.levenshtein(a, b))


def header_snap(c: Column, vocabulary: list[str]) -> Column:
    """A header brought to the nearest word of a vocabulary, if near enough; ties to the first in order."""
    key = collapse(F.regexp_replace(F.upper(c), "[^A-Z ]", ""))
    scored = F.transform(F.array(*[F.lit(v) for v in sorted(vocabulary)]), lambda v: F.struct(levenshtein_capped(key, v).alias("d"), v.alias("v")))
    best = F.array_min(scored)
    near = best["d"] <= F.greatest(F.lit(1), F.floor(F.length(best["v"]) / 4))
    return F.when(key == "", c).when(near, best["v"]).otherwise(c)


def near_equal(a: Column, b: Column) -> Column:
    """At most one edit, where a letter and the digit OCR takes it for count as equal (same length only)."""
    fold = lambda s: F.translate(s, "ILOQDSZBGT", "1100052867")  # noqa: E731  (fixed values: letters and their digits)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == y) | ((fold(x) == fold(y)) & (x.rlike("[0-9]") | y.rlike("[0-9]"))), 0).otherwise(1))
    diff = F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.length(a) == F.length(b), diff <= 1).otherwise((F.abs(F.length(a) - F.length(b)) == 1) & (F.levenshtein(a, b) <= 1))


def class_of_tag(tag: Column) -> Column:
    """Class by the longest known prefix of four to one characters."""
    m = dims.literal_map(dims.TAG_PREFIX)
    u = F.upper(tag)
    return F.coalesce(*[F.try_element_at(m, F.substring(u, 1, n)) for n in (4, 3, 2, 1)])


def strict_tag(raw: Column, bare: tuple[str, ...] = ("A", "B", "C", "D", "CD", "RG", "SG", "EG", "TG", "LD")) -> Column:
    """A normalised tag whose letters are a known prefix and that has a digit or is a bare device mark."""
    t = normalize_tag(raw)
    letters = F.regexp_extract(t, "^([A-Z]+)", 1)
    known = F.try_element_at(dims.literal_map(dims.TAG_PREFIX), letters).isNotNull() | letters.isin(*bare)
    return F.when(known & (t.rlike("[0-9]") | t.isin(*bare)), t)


def class_of_service(service: Column, mounting: Column) -> Column:
    """Air-device class from service and mounting text, by ordered keyword rules."""
    t = collapse(F.upper(F.concat_ws(" ", service, mounting)))
    has = lambda *w: F.greatest(*[t.contains(x) for x in w], F.lit(False))
    lay_in = has("LAY-IN", "T-BAR", "TBAR") | has("CEILING")
    surface = has("SURFACE", "EXPOSED")
    return (
        F.when(strip(service) == "", F.lit(None).cast("string"))
        .when(lay_in & has("SUPPLY"), "AD-T-BAR SUPPLY")
        .when(lay_in & has("RETURN"), "AD-T-BAR RETURN")
        .when(surface & (has("ROUND") | (has("SUPPLY") & ~has("GRILLE"))), "AD-SURF SUPPLY")
        .when(surface & has("RETURN"), "AD-SURF RETURN")
        .when(has("LINEAR") & has("SLOT"), "AD-LINEAR SLOT DIFFUSER")
        .when(has("LINEAR") & has("PLENUM"), "AD-LINEAR PLENUM")
        .when(has("DIFFUSER", "GRILLE", "REGISTER", "SUPPLY", "RETURN", "EXHAUST", "PERFORATED", "PLAQUE", "FACE", "LOUVERED", "DROP", "MOUNTED"), "AD-GRD")
    )


# Stems and short forms by which a description speaks of an air device.
AIR_STEMS = ["DIFFUS", "GRIL", "REGIS", "GRD", "SUPPLY", "RETURN", "EXHAUST"]
AIR_SHORT = ["SA", "RA", "EA"]


def air_device_class(description: Column) -> Column:
    """Class of an air device by its description, NULL where it speaks of none.

    The way the air goes decides (return before exhaust before supply), then whether it is surface mounted.
    """
    t = F.upper(F.coalesce(description, F.lit("")))
    has = lambda w: F.contains(t, F.lit(w))
    device = F.greatest(*[has(w) for w in AIR_STEMS], strip(t).isin(*AIR_SHORT))
    mounted = lambda way: F.concat(F.when(has("SURF"), F.lit("AD-SURF ")).otherwise(F.lit("AD-T-BAR ")), F.lit(way))
    way = F.when(has("RETURN") | t.startswith("RA"), mounted("RETURN")).when(has("EXH") | t.startswith("EA"), F.lit("AD-GRD")).when(has("SUPPLY") | has("DIFFUS") | t.startswith("SA"), mounted("SUPPLY")).otherwise(F.lit("AD-GRD"))
    return F.when(device, way)


def resolved_class(tag: Column, description: Column, mounting: Column | None = None) -> Column:
    """Class of an OCR row: an air device's description wins for tags of up to two signs, else the tag's
    prefix, then the service rules, then the air device's description."""
    mounting = F.lit("") if mounting is None else mounting
    air = air_device_class(description)
    return F.coalesce(F.when(F.length(tag) <= 2, air), class_of_tag(tag), class_of_service(description, F.coalesce(mounting, F.lit(""))), air)


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(strip(c), r"[^\w\-. ]", "_"), r"\s+", "_"), 1, 80)


def size_token(c: Column) -> Column:
    """NNxNN sizes in lower case, else NULL."""
    v = F.lower(F.regexp_replace(F.translate(c, "\u00d7", "x"), rf"{WS}+", ""))
    return F.when(v.rlike(r"^\d{1,3}x\d{1,3}$"), v)


def pdf_strings(c: Column) -> Column:
    """The strings of a PDF array such as [(a)(b\\)c)], escapes resolved."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\(((?:[^()\\]|\\.)*)\)"), 1), lambda s: F.regexp_replace(s, r"\\(.)", "$1"))


def object_field(c: Column, name: str) -> Column:
    """The text value of /Name(...) in a raw PDF object."""
    return F.nullif(F.regexp_replace(F.regexp_extract(c, rf"/{name}\s*\(((?:[^()\\]|\\.)*)\)", 1), r"\\(.)", "$1"), F.lit(""))


def label_config(classes: Column) -> Column:
    """The labelling configuration of a review tool for an array of class names."""
    return F.concat(F.lit("<View><Image name=\"image\" value=\"$image\"/><RectangleLabels name=\"label\" toName=\"image\">"), F.array_join(F.transform(classes, lambda c, i: F.concat(F.lit('<Label value="'), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('" background="hsl('), F.pmod(i * 47, F.lit(360)).cast("string"), F.lit(',70%,50%)"/>'))), ""), F.lit("</RectangleLabels></View>"))
