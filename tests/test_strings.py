import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallysheet.functions import dims
from tallysheet.functions import strings as S

def one(spark, col, values, schema="s string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.select("i", col.alias("x")).orderBy("i").select("x").collect()]


def written(rng, letters, number):
    """A mark as people write it, and how it must come out."""
    suffix = rng.choice(["", "", "B"])
    inner = rng.choice([f"{letters}-{number}{suffix}", f"{letters}{number}{suffix}", f"{letters}\n{number}{suffix}", f"{letters}  {number}{suffix}"])
    mark = f"{letters}{number}{suffix}" if inner == f"{letters}{number}{suffix}" else f"{letters}-{number}{suffix}"
    outer = rng.choice(["{}", " {} ", "{}.", ";{},", "(N) {}", "( r ) {}", "\u00a0{}\u00a0"]).format(inner)
    return (outer.lower() if rng.random() < 0.3 else outer), mark


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_marks_however_written(spark, seed):
    rng = random.Random(seed)
    # one letter and three digits is a sheet number, R and digits a refrigerant
    cases = [written(rng, p, rng.randint(1, 99)) for p in rng.sample(sorted(set(dims.TAG_PREFIX) - {"R"}), 25)]
    got = one(spark, S.normalize_tag(F.col("s")), [c for c, _ in cases])
    assert got == [m for _, m in cases]
    assert one(spark, S.normalize_tag(F.col("s")), got) == got  # a normal form stays


@pytest.mark.parametrize("junk", [None, "", "\n \t", "4711", "R-454B", "R-290", "H204", "S118", "QXVT7731LMNO", "DETAIL-4", "SHEET-2", "typ", "N.T.S.", "AHU", "J-Q", "A" * 21])
def test_what_is_no_mark(spark, junk):
    assert one(spark, S.normalize_tag(F.col("s")), [junk]) == [None]


def test_single_letters_and_bare_devices_are_marks(spark):
    assert one(spark, S.normalize_tag(F.col("s")), ["e", "D", "eg", "LD", "36\nFCU\n8"]) == ["E", "D", "EG", "LD", "FCU-8"]


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_ranges_and_short_forms_are_expanded(spark, seed):
    rng = random.Random(seed)
    cells, want = [], []
    for _ in range(20):
        p, lo, n = rng.choice(["UH", "EF", "RTU", "AHU"]), rng.randint(1, 60), rng.randint(1, 6)
        marks = [f"{p}-{lo + i}" for i in range(n + 1)]
        cells.append(rng.choice([f"{marks[0]} {rng.choice(['thru', 'THRU', 'to'])} {marks[-1]}", ", ".join(marks), "\n".join(marks), marks[0] + "".join(f",{lo + i}" for i in range(1, n + 1))]))
        want.append(marks)
    assert one(spark, S.expand_tag_cell(F.col("s")), cells) == want


def test_cells_without_marks_expand_to_nothing(spark):
    assert one(spark, S.expand_tag_cell(F.col("s")), ["", None, "UH-3 / R-32"]) == [[], [], ["UH-3"]]


def test_range_is_bounded(spark):
    assert one(spark, F.size(S.expand_range(F.col("s"))), ["CU-1 - CU-101", "CU-1 - CU-102"])[0] == 101
    assert one(spark, S.expand_range(F.col("s")), ["CU-1 - CU-102", "CU-1 TO EF-3"]) == [None, None]


def test_folds(spark):
    assert one(spark, S.alnum_fold(F.col("s")), ["ac-1 (b)", None]) == ["AC1B", None]
    assert one(spark, S.ocr_digits(F.col("s")), ["IOLSBZ"]) == ["101582"]
    assert one(spark, S.ocr_digits_if(F.col("s"), F.lit(False)), ["IO"]) == ["IO"]
    assert one(spark, S.value_fold(F.col("s")), ['12"  x\n 9\'']) == ["12 X 9"]


def test_brand_model(spark):
    got = one(spark, S.brand_model(F.col("s")), ["UNITED COOLAIR ABG-100", "ACME / X 5", "ACME", ""])
    assert [(r["brand"], r["model"]) for r in got] == [("UNITED COOLAIR", "ABG-100"), ("ACME", "X 5"), ("ACME", ""), ("", "")]


def test_header_snap(spark):
    v = ["MARK", "MODEL", "CFM", "MANUFACTURER"]
    assert one(spark, S.header_snap(F.col("s"), v), ["MARC", "MODELS", "MANUFACTURRER", "12", "ELEPHANT"]) == ["MARK", "MODEL", "MANUFACTURER", "12", "ELEPHANT"]


def test_near_equal(spark):
    df = spark.createDataFrame([("CU-1", "CU-1"), ("CU-I", "CU-1"), ("CU-I2", "CU-1Z"), ("CU-1", "CU-12"), ("AB", "CD"), ("IL", "LI"), ("EF-7", "EF-T"), ("DQ", "00")], "a string, b string")
    assert [r[0] for r in df.select(S.near_equal(F.col("a"), F.col("b"))).collect()] == [True, True, True, True, False, False, True, True]


def test_class_of_tag_prefers_longer(spark):
    assert one(spark, S.class_of_tag(F.col("s")), ["EUH-1", "E-1", "VAV-2", "ZZZ", None]) == ["HEATER", "AD-T-BAR RETURN", "VAV", None, None]


def test_inline_and_address(spark):
    t = "PROJECT NAME: Tower One\nSHEET NO: M-101\n123 North Main STREET"
    assert one(spark, S.inline_field(F.col("s"), [r"\bPROJECT\s*(?:NAME)?\s*[:=]\s*([^\n\r]{3,80})"]), [t, "", None]) == ["Tower One", None, None]
    assert one(spark, S.street_address(F.col("s")), [t])[0] == "123 North Main STREET"


def test_air_devices_by_description(spark):
    texts = ["Ceiling supply diffuser", "SURFACE MTD RETURN GRILLE", "exhaust register", "SA", "Sidewall gril", "RA LOUVERED FACE GRD", "SURF MOUNT SUPPLY", "PUMP", "", None]
    assert one(spark, S.air_device_class(F.col("s")), texts) == ["AD-T-BAR SUPPLY", "AD-SURF RETURN", "AD-GRD", "AD-T-BAR SUPPLY", "AD-GRD", "AD-T-BAR RETURN", "AD-SURF SUPPLY", None, None, None]
    df = spark.createDataFrame([("L", "EXHAUST GRILLE"), ("L-12", "EXHAUST GRILLE"), ("ZZ-1", "SUPPLY DIFFUSER"), ("B", "PUMP")], "t string, d string")
    assert [r[0] for r in df.select(S.resolved_class(F.col("t"), F.col("d"))).collect()] == ["AD-GRD", "LOUVER", "AD-GRD", None]


def test_pdf_strings_and_config(spark):
    assert one(spark, S.pdf_strings(F.col("s")), [r"[(a)(b\)c)()]"]) == [["a", "b)c", ""]]
    xml = spark.range(1).select(S.label_config(F.array(F.lit('A"&B'), F.lit("C")))).first()[0]
    assert 'value="A&quot;&amp;B"' in xml and "hsl(47," in xml


def reference_split(cell):
    """Brute force of compound cells."""
    parts = [p.strip() for p in re.split("[,;/&]", cell.strip()) if p.strip()]
    m = re.match(r"^([A-Z]+)-\d+$", re.sub(r"(?i)^\(\s*[ERN]\s*\)\s*", "", parts[0].upper()).strip()) if parts else None
    if m and len(parts) > 1 and all(re.fullmatch(r"\d+", p) for p in parts[1:]):
        return [parts[0]] + [f"{m[1]}-{p}" for p in parts[1:]]
    return parts


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_split_compound_against_brute_force(spark, seed):
    rng = random.Random(seed)
    cells = ["".join(rng.choice(["AC-1", "2", ",", "/", " ", "&", "EF-3", ";", "(E) CU-4", "x"]) for _ in range(rng.randint(1, 7))) for _ in range(40)]
    assert one(spark, S.split_compound(F.col("s")), cells) == [reference_split(c) for c in cells]
