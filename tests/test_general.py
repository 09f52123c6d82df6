import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallysheet.operators import nested_flatten, packed_split, schema_drift
from tallysheet.operators import unit_harmonise as U

from .conftest import rows

TV = "var_id bigint, project string, tag string, schedule_name string, page int, properties map<string,string>, inferred_yolo_class string, source_row_index int, loaded_at timestamp, quantity string, unit string"


def variables(spark, props, schedule=None, tag="CU-1"):
    return spark.createDataFrame([(i, "p", tag, schedule, 1, p, None, 0, None, "clash", "clash") for i, p in enumerate(props)], TV)


@pytest.fixture(scope="module")
def units(spark):
    rows_ = [("airflow", "CFM", ["CFM", "AIRFLOW", "SUPPLY AIR"]), ("static pressure", "IN WG", ["ESP"]), ("motor power", "HP", ["HP", "MOTOR"]), ("heat rate", "MBH", ["CAPACITY"]), ("weight", "LB", ["WEIGHT", "OPER WEIGHT"]), ("temperature", "DEG F", ["EAT"]), ("water flow", "GPM", ["FLOW RATE"]), ("neck size", "IN", ["NECK"])]
    return spark.createDataFrame(rows_, "quantity string, common_unit string, prop_names array<string>")


@pytest.mark.parametrize(
    ("name", "value", "other", "foreign", "common"),
    [
        ("AIRFLOW", "500 L/S", {}, True, 1059.44), ("AIRFLOW", "1,250 CFM (590 L/S)", {}, False, 1250.0), ("AIRFLOW", "590 L/S (1,250 CFM)", {}, False, 1250.16), ("AIRFLOW [M3/H]", "1 700", {}, True, 1000.58),
        ("AIRFLOW (L/S)", "1000 CFM", {}, False, 1000.0), ("SUPPLY AIR", "1.5", {"REMARKS": "ALL AIRFLOW ARE CFM X 1000 AND ALL WEIGHTS ARE KG"}, True, 1500.0), ("CFM", "900", {"NOTES": "AIRFLOW IN L/S"}, False, 900.0),
        ("OPER WEIGHT SHORT TONS", "0,908", {}, True, 1816.0), ("WEIGHT", "100", {"REMARK": "CURB STEEL PRICED PER TON"}, False, 100.0), ("WEIGHT", "100#", {}, False, 100.0), ("ESP", '2.7" W.G.', {}, False, 2.7), ("ESP", "0.5 kPa", {}, True, 2.007),
        ("MOTOR", "7-1/2 H.P.", {}, False, 7.5), ("MOTOR", "1 1/2", {}, False, 1.5), ("MOTOR w", "746", {}, True, 1.0004), ("EAT", "20°C", {}, True, 68.0), ("NECK", "Ø152 mm", {}, True, 5.984), ("NECK", "1.33'", {}, True, 15.96), ("NECK", '12"Ø', {}, False, 12.0),
        ("FLOW RATE", "3.2 m³/hr", {}, True, 14.089), ("CAPACITY", "12.5 TR", {}, True, 150.0), ("CAPACITY", "150 MBH", {"MODEL": "X294L/S"}, False, 150.0),
    ],
)
def test_units(spark, units, name, value, other, foreign, common):
    r = U.harmonise_units(variables(spark, [{name: value, **other}]), units).where(F.col("prop_name") == name).collect()
    assert len(r) == 1 and r[0]["foreign"] is foreign
    assert r[0]["common_value"] == pytest.approx(common, rel=2e-3)


def test_units_without_numbers(spark, units):
    props = [{"AIRFLOW": "SEE PLAN"}, {"AIRFLOW": ""}, {"AIRFLOW": None}, None, {}, {"COLOUR": "12"}]
    assert U.harmonise_units(variables(spark, props), units).count() == 0
    assert U.harmonise_units(variables(spark, [{"AIRFLOW": "1"}]).limit(0), units).count() == 0


def test_unlisted_unit_is_read_by_its_numbers(spark, units):
    rng = random.Random(1)
    air = [{"AIRFLOW": f"{rng.randint(500, 9000)} CFM"} for _ in range(200)] + [{"AIRFLOW": f"{rng.randint(500, 9000) / 2118.88:.3f} kubik/sek"} for _ in range(60)]
    got = U.harmonise_units(variables(spark, air), units).where("unit = 'M3/S'").count()
    assert got == 60
    # too few links to tell: left to the common unit
    assert U.harmonise_units(variables(spark, air[:203]), units).where("foreign").count() == 0


def test_conversions_are_propagated_between_sources(spark, units):
    rng = random.Random(2)
    row = lambda i, kind, v: (i, "p", f"{kind}-{i}", None, 1, {"AIRFLOW": v}, None, 0, None, "clash", "clash")
    air = [("CU", f"{rng.randint(500, 9000)} CFM") for _ in range(100)]
    air += [(k, f"{rng.randint(500, 9000) / 2118.88:.3f} kubik/sek") for k in ("CU", "AH") for _ in range(50)]
    air += [(k, f"{rng.randint(500, 9000) / 2.11888:.1f} ltr pro sek") for k in ("AH", "RT") for _ in range(50)]  # shares no kind with CFM
    air += [("RT", f"{rng.randint(500, 9000) / 0.58858:.0f} kubik/std") for _ in range(50)]  # nor with what does
    v = spark.createDataFrame([row(i, k, x) for i, (k, x) in enumerate(air)], TV)
    got = {r["unit"]: r["n"] for r in U.harmonise_units(v, units).groupBy("unit").agg(F.count("*").alias("n")).collect()}
    assert got == {"CFM": 100, "M3/S": 100, "L/S": 100, "M3/H": 50}


def test_a_contradicted_text_is_overruled(spark, units):
    rng = random.Random(3)
    air = [{"AIRFLOW": f"{rng.randint(500, 9000)} CFM"} for _ in range(300)] + [{"AIRFLOW": f"{rng.randint(500, 9000) / 2118.88:.3f} L/S"} for _ in range(100)] + [{"AIRFLOW": f"{rng.randint(500, 9000) / 2.11888:.1f} LPS"} for _ in range(100)]
    t = variables(spark, air)
    v = U.vocabulary(units)
    got = {r["label"]: (r["unit"], r["decided"]) for r in U.source_conversions(U.unit_statements(t, v), v).where("quantity = 'airflow' and decided <> 'text'").collect()}
    assert got["L/S"] == ("M3/S", "overruled") and got["LPS"] == ("L/S", "confirmed")
    # with few rows the text stands
    few = U.harmonise_units(variables(spark, air[:320]), units).where("unit = 'L/S'").count()
    assert few == 20


def test_offsets_are_estimated(spark, units):
    rng = random.Random(4)
    f = [rng.uniform(40, 170) for _ in range(900)]
    t = variables(spark, [{"EAT": f"{x:.1f} F"} for x in f[:500]] + [{"EAT": f"{(x - 32) / 1.8:.2f} grad"} for x in f[500:]])
    v = U.vocabulary(units)
    r = U.source_conversions(U.unit_statements(t, v), v).where("label = 'GRAD'").first()
    assert (r["unit"], r["decided"]) == ("DEG C", "estimated")
    assert r["est_scale"] == pytest.approx(1.8, rel=0.15) and r["est_offset"] == pytest.approx(32, abs=12)


def test_other_common_units_and_unknown_quantities(spark):
    c = spark.createDataFrame([("airflow", "L/S", ["AIRFLOW"]), ("sound", "DB", ["NOISE"]), (None, "X", ["Y"])], "quantity string, common_unit string, prop_names array<string>")
    t = variables(spark, [{"AIRFLOW": "1000 CFM"}, {"AIRFLOW": "500 l/s"}, {"NOISE": "41 dB"}, {"NOISE": "40"}, {"NOISE": "0.04 dB x 1000"}])
    got = {(r["quantity"], r["unit"], round(r["common_value"], 1), r["foreign"]) for r in U.harmonise_units(t, c).collect()}
    assert got == {("airflow", "CFM", 471.9, True), ("airflow", "L/S", 500.0, False), ("sound", "DB", 41.0, False), ("sound", "DB", 40.0, False), ("sound", "DB X 1000", 40.0, True)}
    with pytest.raises(ValueError, match="no known unit"):
        U.vocabulary(spark.createDataFrame([("airflow", "FURLONG", ["AIRFLOW"])], c.schema))


def test_estimates_alone_find_the_foreign_units(spark):
    """With no text listed but the common unit's own name, the linked rows must tell all conversions."""
    import os

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    t, c = spark.read.parquet(f"{d}/tag_variables.parquet"), spark.read.parquet(f"{d}/common_units.parquet")
    rows_ = lambda listed: {tuple(r) for r in U.harmonise_units(t, c, listed).where("foreign").select("var_id", "prop_name").collect()}
    by_text, by_rows = rows_(True), rows_(False)
    assert len(by_text & by_rows) >= 0.95 * len(by_text) and len(by_text & by_rows) >= 0.95 * len(by_rows)


def test_units_from_schedule_name(spark, units):
    v = variables(spark, [{"NECK": "300"}], "AIR DEVICE SCHEDULE (units: necks mm, airflow l/s)")
    assert U.harmonise_units(v, units).first()["unit"] == "MM"


DET = "file_id bigint, project string, station string, body string, written_at timestamp, field_name string, kind string"
BASE_DET = {"cls": "LOUVER", "tag": "L-1", "tag_method": "direct", "untagged_reason": None, "conf": 0.9, "x1": 100.5, "y1": 2.5, "x2": 300.5, "y2": 40.5}
BASE = {"pdf": "a/b.pdf", "dpi": 200, "funnel": {"schedule_tags": 1, "detections": 1, "tagged": 1}, "tag_diagnostics": None, "pages": {"0": [BASE_DET]}}


def files(spark, *bodies):
    return spark.createDataFrame([(i, "p", None, b if b is None or isinstance(b, str) else json.dumps(b), None, "clash", "clash") for i, b in enumerate(bodies)], DET)


def drift(spark, body):
    return {(r["field_name"], r["change_kind"]) for r in schema_drift.drift_report(files(spark, body)).collect()}


def test_no_drift(spark):
    assert drift(spark, BASE) == set()


def test_renamed_retyped_removed_added(spark):
    d = {**BASE_DET, "class": {"name": "LOUVER", "family": "L"}, "mark": ["L-1"], "confidence": "0.9", "tile": [1, 2]}
    for k in ("cls", "tag", "conf"):
        d.pop(k)
    b = {"pdf_path": "a/b.pdf", "dpi": "200", "counts": BASE["funnel"], "pages": [{"page": 1, "detections": [d]}], "model": "m"}
    assert drift(spark, b) == {("pdf", "renamed"), ("dpi", "retyped"), ("funnel", "renamed"), ("tag_diagnostics", "removed"), ("pages", "retyped"), ("page", "added"), ("detections", "added"), ("model", "added"), ("cls", "renamed"), ("cls", "retyped"), ("tag", "renamed"), ("tag", "retyped"), ("conf", "renamed"), ("conf", "retyped"), ("tile", "added")}


def test_look_alike_names_are_added(spark):
    d = {**BASE_DET, "tag_confidence": 0.5, "original_yolo_cls": "FAN"}
    assert drift(spark, {**BASE, "pages": {"0": [d]}}) == {("tag_confidence", "added"), ("original_yolo_cls", "added")}
    d.pop("conf")
    assert ("conf", "removed") in drift(spark, {**BASE, "pages": {"0": [d]}})


def test_array_body_and_empty_pages(spark):
    top = {(f, "removed") for f in BASE}
    assert drift(spark, []) == top
    assert drift(spark, [{**BASE_DET, "page": 3}, None]) == top | {("page", "added")}
    assert drift(spark, {**BASE, "pages": {}}) == set()


def test_invalid_bodies(spark):
    f = files(spark, None, "", "  ", '{"pdf": "x', "nonsense", BASE)
    assert schema_drift.drift_report(f).count() == 0
    assert schema_drift.unified_detections(f).count() == 1
    assert nested_flatten.detection_positions(f).count() == 1
    assert schema_drift.drift_report(files(spark, BASE).limit(0)).count() == 0


def test_unified_values(spark):
    d = {"label": {"name": "FAN", "family": "F"}, "equip_tag": ["EF-1"], "method": "direct", "reason": 2, "score": "0.5", "left": 1.5, "top": 2.5, "right": 30.5, "bottom": 40.5}
    r = schema_drift.unified_detections(files(spark, {**BASE, "pages": [{"page": 4, "detections": [None, d]}]})).first()
    assert (r["page_index"], r["det_index"], r["cls"], r["tag"], r["tag_method"], r["untagged_reason"], r["conf"], r["x1"], r["y2"]) == (3, 1, "FAN", "EF-1", "direct", "2", 0.5, 1.5, 40.5)


def test_nested_positions_and_parents(spark):
    c = [{"tag": "A-1", "score": 0.1}, {"tag": "A-2", "score": 0.2}]
    b = {**BASE, "pages": {"2": [None, {**BASE_DET, "candidates": c}, {**BASE_DET, "candidates": []}], "5": []}}
    f = files(spark, b, [[{**BASE_DET}], [{**BASE_DET, "candidates": None}]])
    assert rows(nested_flatten.detection_positions(f)) == sorted([(0, 2, 1, -1), (0, 2, 1, 0), (0, 2, 1, 1), (0, 2, 2, -1), (1, 0, 0, -1), (1, 1, 0, -1)], key=repr)
    t = nested_flatten.flat_tables(f)
    assert {k: v.count() for k, v in t.items() if k != "members"} == {"files": 2, "pages": 4, "detections": 4, "candidates": 2}
    for child, parent in (("pages", "files"), ("detections", "pages"), ("candidates", "detections")):
        j = t[child].alias("c").join(t[parent].alias("p"), (F.col("c.file_id") == F.col("p.file_id")) & (F.col("c.parent_pre") == F.col("p.pre")))
        assert j.where("c.pre > p.pre and c.post < p.post").count() == t[child].count()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_every_node_is_labelled_and_held_by_its_parent(seed):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else [None, rng.randrange(9), "x", True][kind]

    det = lambda: {**BASE_DET, "more": value(3), **({"candidates": [None, {"tag": "A-1", "odd": value(2)}, "B"]} if rng.random() < 0.5 else {})}
    pages = {str(i): [None if rng.random() < 0.2 else det() for _ in range(rng.randrange(4))] for i in range(rng.randrange(4))}
    j = {**BASE, "funnel": value(3), "pages": pages if rng.random() < 0.5 else [{"page": int(k) + 1, "note": value(2), "detections": v} for k, v in pages.items()]}
    nodes = nested_flatten.label_nodes(j, {})
    assert sorted([n[1] for n in nodes] + [n[2] for n in nodes]) == list(range(2 * len(nodes)))  # every tick is one end of one node
    by_pre = sorted(nodes, key=lambda n: n[1])
    for n in by_pre:
        around = [m for m in by_pre if m[1] < n[1] and n[2] < m[2]]
        assert n[3] == (around[-1][1] if around else None) and n[4] == len(around)
    kinds = {"page": "file", "detection": "page", "candidate": "detection"}
    at = {n[1]: n for n in nodes}
    assert all(at[n[3]][0] == kinds[n[0]] for n in nodes if n[0] in kinds)
    few = nested_flatten.label_nodes(j, {}, ("detection",))
    assert few == [n for n in nodes if n[0] == "detection"]


def test_members_make_the_record_whole(spark):
    f = files(spark, {**BASE, "pages": {"0": [{**BASE_DET, "tile": [1, {"a": None}], "candidates": [{"tag": "A-1", "why": "near"}]}]}})
    m = {(r["page_index"], r["det_index"], r["member"], r["json_type"], r["value"]) for r in nested_flatten.flat_tables(f)["members"].collect()}
    assert {(None, None, "schedule_tags", "number", "1"), (None, None, "tag_diagnostics", "null", None), (0, 0, "tile", "array", None), (0, 0, "a", "null", None), (0, 0, "why", "string", "near"), (0, 0, "conf", "number", "0.9")} <= m


def test_arrays_and_entries_are_told_by_shape(spark):
    two = {"page": 1, "detections": [BASE_DET], "more": [{**BASE_DET, "cls": "FAN"}]}
    four = {"page": 1, "sheet": "M1", "scale": "NTS", "found": [BASE_DET, {**BASE_DET, "cls": "FAN"}]}
    for pages in ([two], [four]):
        assert schema_drift.unified_detections(files(spark, {**BASE, "pages": pages})).count() == 2
    f = files(spark, {**BASE, "pages": [two, four]})
    assert schema_drift.unified_detections(f).count() == 4


def test_nested_members_beyond_the_twelfth_are_seen(spark):
    b = {k: v for k, v in BASE.items() if k != "funnel"} | {"trichter": {**{f"m{i}": i for i in range(20)}, "schedule_tags": 1}}
    assert drift(spark, b) == {("funnel", "renamed")}


NEW_NAMES = {"cls": "klasse", "tag": "bez", "tag_method": "herkunft", "untagged_reason": "grund", "conf": "certainty", "x1": "lft", "y1": "tp", "x2": "rgt", "y2": "btm"}


def test_renames_outside_any_list_are_found(spark):
    d = {**BASE_DET, "untagged_reason": "no_match"}
    for n in NEW_NAMES:
        assert drift(spark, {**BASE, "pages": {"0": [{NEW_NAMES.get(k, k) if k == n else k: v for k, v in d.items()}]}}) == {(n, "renamed")}, n
    boxes = {k: v for k, v in NEW_NAMES.items() if k in ("x1", "y1", "x2", "y2")}
    assert drift(spark, {**BASE, "pages": {"0": [{boxes.get(k, k): v for k, v in d.items()}]}}) == {(k, "renamed") for k in boxes}


def test_names_beside_a_base_field_elsewhere_are_fields_of_their_own(spark):
    lone = {k: v for k, v in BASE_DET.items() if k != "conf"} | {"sharpness": 0.4}
    beside = {**BASE, "pages": {"0": [{**BASE_DET, "sharpness": 0.4}]}}
    alone = {(r["file_id"], r["field_name"], r["change_kind"]) for r in schema_drift.drift_report(files(spark, {**BASE, "pages": {"0": [lone]}})).collect()}
    assert alone == {(0, "conf", "renamed")}
    told = {(r["file_id"], r["field_name"], r["change_kind"]) for r in schema_drift.drift_report(files(spark, {**BASE, "pages": {"0": [lone]}}, beside)).collect()}
    assert told == {(0, "conf", "removed"), (0, "sharpness", "added"), (1, "sharpness", "added")}


def test_repeated_files_count_once(spark):
    f = files(spark, BASE)
    assert nested_flatten.node_table(f.unionByName(f)).count() == nested_flatten.node_table(f).count()


MAKERS = ["BRISKO", "HALDEN & PIKE", "ORLO CO., LTD.", "KESSEL/MARR", "VASK AND SONS", "GALE; WYND"]


@pytest.mark.parametrize(
    ("kind", "cell", "values"),
    [
        ("mark", "AC-1", ["AC-1"]), ("mark", "AC-1, AC-2,", ["AC-1", "AC-2"]), ("mark", "(E) TF-16, 17, 21", ["TF-16", "TF-17", "TF-21"]), ("mark", "FCU-12 TO FCU-15 & FCU-20", ["FCU-12", "FCU-13", "FCU-14", "FCU-15", "FCU-20"]), ("mark", "SG-9-SG-11", ["SG-9", "SG-10", "SG-11"]),
        ("mark", "CD - 9", ["CD-9"]), ("mark", '"RG-5" AND "EF-20"', ["RG-5", "EF-20"]), ("mark", "N/A", []), ("mark", "-", []), ("mark", "R-410A", ["R-410A"]), ("mark", "ERV-5 thru 7", ["ERV-5", "ERV-6", "ERV-7"]), ("mark", "AHU-80 ,UH-89", ["AHU-80", "UH-89"]), ("mark", "CU-5A THRU CU-5C", ["CU-5A", "CU-5B", "CU-5C"]),
        ("mark", "CU-9 THRU CU-5", ["CU-9", "CU-5"]), ("mark", '"CU-1, CU-2', ["CU-1", "CU-2"]),
        ("maker", "HALDEN & PIKE", ["HALDEN & PIKE"]), ("maker", "ORLO CO., LTD., BRISKO", ["ORLO CO., LTD.", "BRISKO"]), ("maker", '"GALE; WYND" OR VASK AND SONS;', ["GALE; WYND", "VASK AND SONS"]), ("maker", "KESSEL/MARR / BRISKO", ["KESSEL/MARR", "BRISKO"]), ("maker", "UNKNOWN, BRISKO", ["UNKNOWN", "BRISKO"]),
        ("area", '"MEN, WOMEN TOILETS"', ["MEN, WOMEN TOILETS"]), ("area", 'CAFE + "MDF, IDF ROOM" /', ["CAFE", "MDF, IDF ROOM"]), ("area", "STAIR 1\nLOBBY", ["STAIR 1", "LOBBY"]), ("area", "BREAK ROOM", ["BREAK ROOM"]),
        ("note", "SEE NOTES: 1, 2 & 14", ["1", "2", "14"]), ("note", "NOTE 5", ["5"]), ("note", "1 2 3", ["1", "2", "3"]), ("note", "3/6/9", ["3", "6", "9"]), ("note", "", []),
        ("electrical", "208V/3PH/60HZ", ["208", "3", "60"]), ("electrical", "208-3-60", ["208", "3", "60"]), ("electrical", "120/1", ["120", "1"]), ("electrical", "460 VOLTS", ["460"]), ("electrical", "208V-3Ø-60Hz", ["208", "3", "60"]), ("electrical", "SEE PLAN", []),
    ],
)
def test_grammar(kind, cell, values):
    assert [v for v, _, _ in packed_split.grammars(MAKERS)[kind].cell(cell)] == values


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='AC-12,;/|&+\n "()OR', max_size=30))
def test_grammar_never_fails_and_reads_everything(cell):
    for g in packed_split.grammars(MAKERS).values():
        got = g.cell(cell)
        assert all(0 <= at <= len(cell) for _, at, _ in got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["CAFE", "LOBBY", "MEN, WOMEN", "A / B", "STAIR 1"]), min_size=2, max_size=5), st.sampled_from([", ", "; ", " / ", "\n", " + "]))
def test_quoted_areas_round_trip(values, sep):
    cell = sep.join(f'"{v}"' for v in values)
    assert [v for v, _, _ in packed_split.grammars(MAKERS)["area"].cell(cell)] == values


def test_split_packed_tables(spark):
    s = spark.createDataFrame([(1, [{"MARK": "CU-1, CU-2", "MODEL": "A/B"}, None, {"UNIT NO.": "EF-1 - EF-3", "NOTES": None}]), (2, None), (None, [{"MARK": "A-1, A-2"}])], "table_id bigint, rows array<map<string,string>>")
    v = spark.createDataFrame([(7, "AC-1 & 2"), (8, None), (9, "")], "var_id bigint, tag string")
    m = spark.createDataFrame([("BRISKO",), (None,)], "maker_name string")
    got = rows(packed_split.split_packed(s, v, m).select("source_table", "record_id", "row_index", "field_name", "value_index", "value"))
    want = [("schedule_tables", 1, 0, "MARK", 0, "CU-1"), ("schedule_tables", 1, 0, "MARK", 1, "CU-2"), ("schedule_tables", 1, 2, "UNIT NO.", 0, "EF-1"), ("schedule_tables", 1, 2, "UNIT NO.", 1, "EF-2"), ("schedule_tables", 1, 2, "UNIT NO.", 2, "EF-3"), ("tag_variables", 7, 0, "tag", 0, "AC-1"), ("tag_variables", 7, 0, "tag", 1, "AC-2")]
    assert got == sorted(want, key=repr)


def test_prefilter_loses_no_cell(spark):
    cells = ["CU-1, 2", "AC-1-AC-3", "1 2", "208-3", "A\nB", '"A" "B"', "AC-1 AC-2", "CAFE + BAR"]
    df = spark.createDataFrame([("t", i, 0, "f", k, c) for i, c in enumerate(cells) for k in ("mark", "area", "note", "electrical", "maker")], packed_split.CELLS)
    all_ = {(r["record_id"], r["value"]) for r in packed_split.split_cells(df, MAKERS, 1).where("n_values >= 2").collect()}
    assert {(r["record_id"], r["value"]) for r in packed_split.split_cells(df, MAKERS).collect()} == all_


def test_very_long_cell(spark):
    long = ", ".join(f"CU-{i}" for i in range(5000))
    df = spark.createDataFrame([("t", 1, 0, "f", "mark", long)], packed_split.CELLS)
    assert packed_split.split_cells(df, []).count() == 5000


@pytest.mark.parametrize("how", ["empty", "dirty"])
def test_queries_bear_empty_null_and_clashing_tables(spark, tmp_path_factory, how):
    import os

    from tallysheet.plans import general

    from . import tables

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    d = tables.write(spark, "/root/testdata/sf0.001", str(tmp_path_factory.mktemp(how)), how)
    for name, q in general.QUERIES.items():
        n = q(spark, d).count()
        assert n >= 0 and (how == "dirty" or n == 0 or name == "p2_sources"), name


def test_long_ranges_come_out_whole(spark):
    cells = [("mark", "VAV-1 THRU VAV-1200, AC-7"), ("note", "1-1500"), ("mark", "EF-0001A THRU EF-25000A"), ("mark", "AC-1 THRU AC-9999999999"), ("mark", "AC-1 THRU EF-2")]
    df = spark.createDataFrame([("t", i, 0, "f", k, c) for i, (k, c) in enumerate(cells)], packed_split.CELLS)
    got: dict = {}
    for r in packed_split.split_cells(df, []).orderBy("record_id", "value_index").collect():
        got.setdefault(r["record_id"], []).append((r["value_index"], r["value"], r["n_values"], r["flag"]))
    assert got[0] == [(i, f"VAV-{i + 1}", 1201, "") for i in range(1200)] + [(1200, "AC-7", 1201, "")]
    assert got[1] == [(i, str(i + 1), 1500, "") for i in range(1500)]
    assert got[2] == [(i, f"EF-{i + 1:04d}A", 25000, "") for i in range(25000)]
    assert got[3] == [(0, "AC-1", 2, packed_split.UNEXPANDED), (1, "AC-9999999999", 2, packed_split.UNEXPANDED)]
    assert [v[1:] for v in got[4]] == [("AC-1", 2, packed_split.UNEXPANDED), ("EF-2", 2, "")]
