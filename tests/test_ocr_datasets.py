import json

from pyspark.sql import functions as F

from tallysheet.operators import datasets, filters, ocr
from tallysheet.sources import rest

from .conftest import rows


def test_word_to_tag_prefers_whole_fold(spark):
    w = spark.createDataFrame([("p", 1, "CU-1"), ("p", 2, "EF-2/CU-1"), ("p", 3, "zz"), ("p", 4, "")], "project string, word_id int, text string")
    t = spark.createDataFrame([("p", "CU-1", 1), ("p", "CU1", 2), ("p", "EF", 3), ("q", "ZZ", 4)], "project string, tag string, ord int")
    assert rows(ocr.word_to_tag(w, t, ["project"])) == [("p", 1, "CU1"), ("p", 2, "EF")]


def test_crop_text_and_sizes(spark):
    t = spark.createDataFrame([("i", 2.0, "1", 0.5), ("i", 1.0, "CU", 1.0)], "img string, cx double, text string, conf double")
    assert rows(ocr.crop_texts(t, ["img"])) == [("i", "CU 1", 0.75)]
    d = spark.createDataFrame([("p", 1, 0.0, 0.0), ("p", 2, 5000.0, 0.0)], "project string, det_id int, cx double, cy double")
    w = spark.createDataFrame([("p", 30.0, 0.0, "24x24"), ("p", 60.0, 0.0, "10 X 10"), ("p", 40.0, 10.0, "250"), ("p", 30.0, 1.0, "7")], "project string, x double, y double, text string")
    assert rows(ocr.size_then_number(d, w, ["project"])) == [("p", 1, "24x24", "250")]


def test_table_from_tokens(spark):
    cells = [(0, 0, "TITLE"), (1, 0, "MARC"), (1, 1, "CFM"), (1, 2, "TYPE"), (2, 0, "EF-1, EF-2"), (2, 1, "1O0"), (2, 2, "CEILING EXHAUST"), (3, 0, "EF-1"), (3, 1, "5")]
    tok = spark.createDataFrame([("p", 0, c * 100.0 + 5, r * 20.0 + 5, v) for r, c, v in cells], "project string, page int, cx double, cy double, text string")
    grid = spark.createDataFrame([("p", 0, 7, [0.0, 20.0, 40.0, 60.0, 80.0], [0.0, 100.0, 200.0, 300.0])], "project string, page int, table_id int, rows array<double>, cols array<double>")
    got = {r["tag"]: r for r in ocr.table_variables(ocr.grid_cells(tok, grid, ["project", "page"]), ["project", "page"]).collect()}
    assert set(got) == {"EF-1", "EF-2"} and got["EF-1"]["properties"] == {"CFM": "100", "TYPE": "CEILING EXHAUST"} and got["EF-1"]["cls"] == "EXHAUST FAN"


def test_label_reasons(spark):
    tok = spark.createDataFrame([("a", 0, "CU-1", 1.0), ("b", 0, "CU-7", 1.0), ("b", 1, "x", 1.0), ("c", 0, "CU", 1.0), ("c", 1, "-12", 1.0), ("d", 0, "ZZZ", 1.0)], "img string, pos int, text string, conf double")
    exp = spark.createDataFrame([("a", "CU-1"), ("b", "CU-1"), ("c", "CU-12"), ("d", "CU-1"), ("e", "CU-1"), ("f", None)], "img string, tag string")
    got = {r["img"]: (r["how"], r["reason"]) for r in ocr.label_bubbles(tok, exp).collect()}
    assert got == {"a": ("exact", "hit"), "b": ("fuzzy", "hit"), "c": ("joined", "hit"), "d": (None, "no_match"), "e": (None, "no_text"), "f": (None, "no_tag")}


def test_filters(spark):
    p = spark.createDataFrame([("a", 0, "PLAN"), ("a", 1, "PLAN SCHEDULE"), ("b", 0, "x"), ("b", 1, None)], "project string, page int, text string")
    assert rows(filters.pages_with_fallback(p, ["project"], ["PLAN"], ["SCHEDULE"]).select("project", "page")) == [("a", 0), ("b", 0), ("b", 1)]
    assert rows(filters.near_empty_pages(p, ["project"], first=1).select("project", "page")) == [("a", 0), ("b", 0)]
    assert rows(filters.first_pages_text(p, ["project"])) == [("a", "PLAN\nPLAN SCHEDULE"), ("b", "x")]
    t = spark.createDataFrame([("p", 1, 100.0)], "project string, table_id int, y0 double")
    ti = spark.createDataFrame([("p", "far", 10.0, 9.0), ("p", "near", 90.0, 5.0), ("p", "below", 120.0, 5.0), ("p", "tall", 90.0, 8.0)], "project string, text string, y double, h double")
    assert rows(filters.nearest_title(t, ti, ["project"])) == [("p", 1, "tall")]


def test_tiles(spark):
    pages = spark.createDataFrame([("p", 0, 1000, 640)], "project string, page int, width int, height int")
    b = spark.createDataFrame([("p", 0, "FANS", 480.0, 100.0, 520.0, 140.0), ("p", 0, "X", 0.0, 0.0, 10.0, 10.0)], "project string, page int, cls string, x1 double, y1 double, x2 double, y2 double")
    got = rows(datasets.tile_boxes(b, pages).select("tx", "ty", "cls", F.round("cx", 3)))
    assert got == [(0, 0, "FAN", 0.781), (0, 0, "X", 0.008), (360, 0, "FAN", 0.219)]
    assert datasets.kept_empty_tiles(pages, datasets.tile_boxes(b.limit(0), pages), one_in=1).count() == 2
    assert datasets.frequent_classes(b, 2).count() == 0
    h = datasets.holdout(spark.createDataFrame([(f"p{i}",) for i in range(20)], "project string"), 0.1, always=("p3",))
    assert {r["project"] for r in h.where("split = 'val'").collect()} >= {"p3"} and h.where("split = 'val'").count() == 3


def test_paged_source(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"tasks": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "2.json").write_text(json.dumps({"tasks": [{"id": 3}]}))
    spark.dataSource.register(rest.PagedSource)
    df = spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{page}}.json").option("pages", "3").option("items", "tasks").load()
    assert rows(df.select("page", "position", F.get_json_object("item", "$.id").cast("int"))) == [(1, 0, 1), (1, 1, 2), (2, 0, 3)]
    assert rest.class_map("names:\n- FAN\n- VAV\n") == {0: "FAN", 1: "VAV"}


def test_first_share_is_the_hash_order(spark):
    import hashlib

    from tallysheet.operators import datasets

    names = [f"p{i}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in [*names, *names, None]], "project string")
    order = sorted(names, key=lambda n: (hashlib.md5(f"{n}:42".encode()).hexdigest(), n))
    for share, least in ((0.1, 1), (0.0, 1), (0.5, 1), (1.0, 1), (0.0, 7)):
        want = set(order[: max(least, int(300 * share))])
        assert {r[0] for r in datasets.first_share(df, "project", 42, share, least, buckets=16).collect()} == want
    assert datasets.first_share(df.limit(0), "project", 42, 0.1).count() == 0


def test_crops_with_and_without_bubbles(spark):
    from tallysheet.operators import datasets

    box = "x1 double, y1 double, x2 double, y2 double"
    crops = spark.createDataFrame([("a", "p", 0.0, 0.0, 32.0, 64.0), ("b", "q", -10.0, 0.0, 10.0, 10.0), ("c", "q", 5.0, 5.0, 5.0, 9.0), (None, "q", 1.0, 1.0, 2.0, 2.0)], f"img string, project string, {box}")
    bubbles = spark.createDataFrame([("a", 320.0, 320.0, 400.0, 400.0), ("b", 0.0, 0.0, 320.0, 320.0), ("z", 0.0, 0.0, 1.0, 1.0)], f"img string, {box}")
    split = spark.createDataFrame([("p", "train"), ("q", "val")], "project string, split string")
    got = sorted((r["img"], r["split"], r["label_id"], r["cx"], r["w"]) for r in datasets.crop_labels(crops, bubbles, split, 320.0).collect())
    assert got == [("a", "train", 0, 0.05, 0.1), ("b", "val", 0, 0.015625, 0.03125), ("b", "val", 1, 0.5, 1.0)]
