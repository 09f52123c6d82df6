import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysheet.sources import ports, readers, rest, sinks
from tallysheet.streaming import ingest

from .conftest import rows


def workbook(path, cells):
    """A minimal workbook with inline strings."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    body = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in row.items()) + "</row>" for r, row in cells.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Takeoff" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')


def test_workbook_takeoff(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {1: {"A": "HVAC"}, 3: {"A": "PRODUCT", "B": "QTY", "C": "TAG"}, 4: {"A": "FAN", "B": "2", "C": "EF-1"}, 5: {"B": "3.7", "C": "EF-2"}, 6: {"A": "FAN Total", "B": "5"}, 7: {"B": "n/a"}, 8: {"B": "-1"}, 9: {"B": "1"}})
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    cells = readers.workbooks(spark, str(tmp_path))
    assert [r[1:] for r in rows(readers.takeoff_from_cells(cells))] == [("FAN", "", 1), ("FAN", "EF-1", 2), ("FAN", "EF-2", 3)]
    bad = cells.where(F.col("sheet") == readers.UNREADABLE).collect()
    assert len(bad) == 1 and bad[0]["file"].endswith("broken.xlsx") and "BadZipFile" in bad[0]["value"]


def test_tag_column(spark):
    c = [("a", "S1", 0, 1, "Tag"), ("a", "S1", 1, 1, "ef-1 "), ("a", "S1", 2, 1, "EF-1"), ("a", "S1", 3, 1, "FAN Total"), ("a", "S1", 4, 1, "."), ("a", "S1", 5, 0, "X-1"), ("a", "S2", 0, 0, "TAG"), ("a", "S2", 1, 0, "AC-9"), ("b", "S1", 2, 0, "TAG"), ("b", "S1", 3, 0, "AC-1")]
    assert rows(readers.tag_column(spark.createDataFrame(c, readers.CELLS))) == [("a", "EF-1")]


def test_takeoff_workbook_round_trip(spark, tmp_path):
    from tallysheet.operators import takeoff

    tagged = spark.createDataFrame([("p", 0, 1, "AD-GRD", "CD-1"), ("p", 2, 2, "AD-T-BAR SUPPLY", "CD-1"), ("p", 0, 3, "FAN", "EF & <1>"), ("p", 1, 4, "FAN", None)], "project string, page int, det_id bigint, cls string, tag string")
    details = spark.createDataFrame([("p", "CD-1", [("MODEL", "X1"), ("NECK SIZE", "10")], "AD-T-BAR SUPPLY")], "project string, tag string, props array<struct<key:string,value:string>>, cls string")
    books = sinks.takeoff_workbooks(takeoff.assemble(tagged, details), takeoff.detail_rows(tagged, details)).collect()
    assert len(books) == 1
    cells = readers.workbook_cells(bytes(books[0]["content"]))
    grid = lambda sheet: {(r, c): v for s, r, c, v in cells if s == sheet}
    g = grid("Takeoff")
    assert g[0, 0] == "HVAC Takeoff: p" and [g[2, c] for c in range(11)] == sinks.HEADERS
    assert (g[3, 0], g[3, 2], g[3, 3], g[3, 4], g[3, 5]) == ("AD-T-BAR SUPPLY", "X1", "2", "CD-1", "10")
    assert (g[4, 0], g[4, 3], (5, 0) in g, g[5, 4]) == ("FAN", "1", False, "EF & <1>")
    assert (g[6, 0], g[6, 3], g[7, 0], g[7, 3], g[9, 0], g[9, 3]) == ("AD-T-BAR SUPPLY Total", "2", "FAN Total", "2", "GRAND TOTAL", "4")
    raw = grid("RawData")
    assert [raw[r, 0] for r in range(1, 5)] == ["AD-T-BAR SUPPLY", "FAN", "FAN", "AD-T-BAR SUPPLY"]
    # the reader takes what the writer gives
    df = spark.createDataFrame([("f", *c) for c in cells], readers.CELLS)
    assert ("f", "FAN", "EF & <1>", 1) in rows(readers.takeoff_from_cells(df))


class Service(BaseHTTPRequestHandler):
    tries: dict = {}
    posted: list = []

    def log_message(self, *a):
        pass

    def answer(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        path, _, query = self.path.partition("?")
        page = int(dict(x.split("=") for x in query.split("&")).get("page", 1))
        n = Service.tries[self.path] = Service.tries.get(self.path, 0) + 1
        if path == "/tasks":
            if self.headers.get("Authorization") != "Bearer yes":
                return self.answer(401, {})
            if n == 1 and page % 2:
                return self.answer([500, 429][page % 4 // 2], {})
            return self.answer(200, {"tasks": [{"id": (page - 1) * 10 + i} for i in range(10 if page < 5 else 3 if page == 5 else 0)]})
        if path == "/down":
            return self.answer(500, {})
        if path == "/api/projects/":
            return self.answer(200, {"results": [{"id": 7, "title": "x" * 50}] if page == 1 else []})
        return self.answer(404, {})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.posted.append(body)
        self.answer(200, {"access": "yes"} if self.path == "/token" else {"id": 8})


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rest_source_is_read_to_its_end_or_raises(spark, service):
    spark.dataSource.register(rest.PagedSource)
    read = lambda **o: spark.read.format("paged_json").options(pause="0.01", size="10", pages="3", **o).load()
    got = read(url=service + "/tasks?page={page}", items="tasks", refresh="r", refresh_url=service + "/token")
    assert sorted(json.loads(r["item"])["id"] for r in got.collect()) == list(range(43))
    assert read(url=service + "/none?page={page}", items="tasks").count() == 0
    for url in ("/down?page={page}", "/tasks?page={page}"):  # a failing service, and no token
        with pytest.raises(Exception, match="HTTP Error"):
            read(url=service + url, items="tasks", retries="1").count()


def test_projects_are_found_before_they_are_made(service):
    assert rest.find_or_create(service, "x" * 80, {}) == (7, False)
    assert rest.find_or_create(service, "new", {"label_config": "<View/>"}) == (8, True)
    assert Service.posted[-1] == {"title": "new", "label_config": "<View/>"}


def test_keyed_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "b.csv").write_text("status,project,tagged,extra\nok,a,3,x\n,b,,y\n")
    got = readers.keyed_csv(spark, str(tmp_path / "b.csv"), "project string, status string, tagged int, missing double")
    assert rows(got) == [("a", "ok", 3, None), ("b", None, None, None)]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "c.jsonl"), "a int")) == [(1,), (2,)]
    assert [r["line"] for r in readers.bad_json_lines(spark, str(tmp_path / "c.jsonl")).collect()] == ["not json"]


def test_reviewed_truth_keeps_empty_pages(spark, tmp_path):
    p = tmp_path / "job one"
    p.mkdir()
    (p / "t.json").write_text(json.dumps({"0": [], "2": [{"x1": 1, "y1": 2, "x2": 3, "y2": 4, "cls": "FAN"}]}))
    got = readers.reviewed_truth(spark, str(tmp_path / "*" / "t.json"))
    assert [(r["project"], r["page"], r["cls"]) for r in got.orderBy("page").collect()] == [("job one", 0, None), ("job one", 2, "FAN")]


def test_catalog_report_markers(spark, tmp_path):
    (tmp_path / "j1" / "x").mkdir(parents=True)
    (tmp_path / "j1" / "x" / "plan a.pdf").write_bytes(b"123")
    (tmp_path / "j1" / "s.txt").write_text("Accepted boxes: 12\nDeleted (x): 3\n")
    c = readers.folder_catalog(spark, str(tmp_path)).collect()
    assert [(r["project"], r["name"], r["size_bytes"]) for r in c] == [("j1", "plan a.pdf", 3)]
    r = readers.text_report(spark, str(tmp_path / "*" / "s.txt"), {"accepted": "Accepted", "deleted": "Deleted", "added": "Added"}).first()
    assert (r["project"], r["accepted"], r["deleted"], r["added"]) == ("j1", 12, 3, None)
    m = spark.createDataFrame([("a", "ok")], "project string, status string")
    lg = spark.createDataFrame([("b", "... DONE ..."), ("c", "half")], "project string, text string")
    assert rows(readers.completed(spark, m, lg, "DONE")) == [("a", True, "ok"), ("b", True, "ok"), ("c", False, None)]


def test_annotation_objects(spark):
    raw = r"/Subj (FAN) /Label (EF-1) /PolygonCount 1 /Rect [ 1 2 3 4 ] /BSIColumnData [(ACME)()(X\)1)] /CountStyle (Circle)"
    a = readers.count_annotations(spark.createDataFrame([(1, raw), (1, "/Subj (NOISE) /PolygonCount 2"), (2, "/Subj (LINE)")], "page int, raw string"), noise=("NOISE",))
    r = a.collect()
    assert len(r) == 1 and (r[0]["subject"], r[0]["tag"], r[0]["rect"], r[0]["columns"]) == ("FAN", "EF-1", [1.0, 2.0, 3.0, 4.0], ["ACME", "", "X)1"])
    slots = spark.createDataFrame([(0, "BRAND", False), (1, "GONE", True), (2, "MODEL", False)], "pos int, name string, deleted boolean")
    assert readers.column_data(a, slots).first()["properties"] == {"BRAND": "ACME", "MODEL": "X)1"}


def test_ports(spark):
    pages = spark.createDataFrame([("p", 0, "EF-1 ok\nsecond"), ("p", 1, None)], "project string, page int, text string")
    det = ports.through(pages, ports.BOXES, "fake", ports.FakeDetector)
    assert rows(det) == rows(det) and det.count() == 10
    assert sorted(r["text"] for r in ports.through(pages, ports.WORDS, "words", ports.FakeText).collect()) == ["EF-1", "ok", "second"]


def test_pixels():
    img = np.full((20, 20), 255, np.uint8)
    assert ports.blank(img)
    img[5:8] = 0
    assert not ports.blank(img) and ports.line_profile(img < 128, 1) == [6]
    assert 0 <= ports.otsu(img) < 255
    assert ports.centre_crop(img, 0, 0, 4).shape == (8, 8) and ports.centre_crop(img, 0, 0, 4)[0, 0] == 255
    assert ports.fit_scale(5200, 100) == 0.5 and ports.fit_scale(10, 10) == 1.0


def test_page_cache_is_first_in_first_out():
    calls = []
    c = ports.PageCache(lambda *k: calls.append(k) or np.zeros(1), size=2)
    for k in ("a", "b", "a", "c", "b", "a"):
        c.get(k, 0, 200)
    assert [k[0] for k in calls] == ["a", "b", "c", "a"]


def test_tiled_detector_and_crop_reader(spark):
    img = np.full((900, 1300), 255, np.uint8)
    img[100:140, 100:140] = img[850:890, 1250:1290] = 0
    page = spark.createDataFrame([("p", 0, 200, 1300, 900, bytearray(img.tobytes()))], ports.RASTERS)

    class Dark(ports.TiledDetector):
        def __init__(self):
            def detect(tiles):
                assert len(tiles) <= 2
                out = []
                for t in tiles:
                    y, x = np.nonzero(t < 128)
                    out.append([("FAN", 0.9, int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1), ("FAN", 0.1, 0, 0, 1, 1), ("X", 0.9, 0, 0, 1, 1)])
                return out

            super().__init__(detect, only=("FAN",), batch=2)

    got = {tuple(r)[2:] for r in ports.through(page, ports.BOXES, "dark", Dark).collect()}
    assert got == {("FAN", 0.9, 100.0, 100.0, 140.0, 140.0), ("FAN", 0.9, 1250.0, 850.0, 1290.0, 890.0)}

    class Share(ports.CropReader):
        def __init__(self):
            super().__init__(lambda crops: [(f"{(c == 0).mean():.2f}", 1.0) for c in crops], half=20, batch=16)

    at = page.crossJoin(spark.createDataFrame([(i, 120.0, 120.0) for i in range(20)], "det_id bigint, cx double, cy double"))
    r = ports.through(at, ports.CROP_TEXTS, "share", Share).collect()
    assert len(r) == 20 and {x["text"] for x in r} == {"1.00"}


def test_ruled_cells():
    img = np.zeros((60, 90), bool)
    for y in (5, 25, 45):
        img[y, 5:75] = True
    for x in (5, 30, 74):
        img[5:46, x] = True
    img[10:14, 10:20] = True  # text
    assert ports.ruled_cells(img, 15) == [(6, 6, 30, 25), (6, 26, 30, 45), (31, 6, 74, 25), (31, 26, 74, 45)]
    assert ports.ruled_cells(np.zeros((20, 20), bool), 5) == []
    img[5:46, 74] = False  # open to the border
    assert ports.ruled_cells(img, 15) == [(6, 6, 30, 25), (6, 26, 30, 45)]


def test_project_and_page_choices(spark):
    from tallysheet.operators import filters

    df = spark.createDataFrame([(p, i) for p in ("alpha one", "beta", "Alpha two", None) for i in (9, 3, 5)], "project string, page int")
    assert {r[0] for r in filters.chosen_projects(df, ("ALPHA",)).select("project").collect()} == {"alpha one", "Alpha two"}
    assert {r[0] for r in filters.chosen_projects(df, starting="b").select("project").collect()} == {"beta"}
    assert filters.chosen_projects(df).count() == 12 and filters.chosen_projects(df, limit=1).select("project").distinct().count() == 1
    assert {r[1] for r in filters.page_cap(df.dropna(), ["project"], "page", 2).collect()} == {3, 5}


def test_columns_to_reread(spark):
    from tallysheet.operators import ocr

    cells = [(t, r, c, v) for t, marks in ((1, ["A-1", "", ""]), (2, ["A-1", "A-2", ""])) for r, (m, n) in enumerate([("MARK", "CFM"), *[(m, "5") for m in marks]]) for c, v in enumerate((m, n))]
    df = spark.createDataFrame([("p", *x) for x in cells], "project string, table_id int, r int, c int, value string")
    assert rows(ocr.columns_to_reread(df, ["project"])) == [("p", 1, 0)]


def test_sinks(spark, tmp_path):
    det = spark.createDataFrame([("p", 0, 1, "FAN", "EF-1", "direct", None, 0.9, 0.0, 0.0, 1.0, 1.0), ("p", 3, 2, "FAN", None, "none", "no_candidate_tags", 0.8, 0.0, 0.0, 1.0, 1.0)], "project string, page int, det_id int, cls string, tag string, tag_method string, untagged_reason string, conf double, x1 double, y1 double, x2 double, y2 double")
    body = json.loads(sinks.sidecars(det).first()["body"])
    assert list(body["pages"]) == ["0", "3"] and body["pages"]["0"][0]["tag"] == "EF-1" and body["funnel"] == {"detections": 2, "tagged": 1}
    sinks.fixed_csv(det, str(tmp_path / "out"), ["tag", "missing", "cls"])
    assert rows(spark.read.csv(str(tmp_path / "out"), header=True)) == [("EF-1", None, "FAN"), (None, None, "FAN")]
    assert "| FAN |" in sinks.markdown(det.groupBy("cls").count(), "Counts")
    t = spark.createDataFrame([("p", "FAN", "EF-1", 2), ("p", "FAN", "EF-2", 3)], "project string, product string, tag string, qty int")
    assert ("p", "GRAND TOTAL", "", 5, 2) in rows(sinks.workbook_rows(t))
    idx = spark.createDataFrame([("FAN", 0)], "cls string, idx int")
    tiles = spark.createDataFrame([("t", "FAN", 0.5, 0.5, 0.1, 0.1)], "tile string, cls string, cx double, cy double, w double, h double")
    assert sinks.tile_labels(tiles, idx).first()["label"] == "0 0.500000 0.500000 0.100000 0.100000"
    many = spark.range(12_000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("cls"), F.col("id").cast("int").alias("idx"))
    boxes = many.select(F.lit("t").alias("tile"), "cls", *[F.lit(0.5).alias(c) for c in ("cx", "cy", "w", "h")])
    assert sinks.tile_labels(boxes, many).first()["label"].count("\n") == 11_999
    v = spark.createDataFrame([(1, "FANS", "EF-2", [("CFM", "9")]), (1, "FANS", "EF-1", [("CFM", "5"), ("HP", "1")])], "page int, schedule_name string, tag string, props array<struct<key:string,value:string>>")
    assert sinks.grouped_dump(v).first()["text"] == "Page 1 - FANS\n  EF-1: CFM=5; HP=1\n  EF-2: CFM=9"


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    (src / "a.json").write_text('{"k": "a", "n": 1}\n')
    s = lambda: ingest.file_stream(spark, str(src), "k string, n int")
    ingest.drain(s(), str(out), str(cp))
    (src / "b.json").write_text('{"k": "b", "n": 2}\n')
    ingest.drain(s(), str(out), str(cp))
    ingest.drain(s(), str(out), str(cp))
    assert rows(spark.read.parquet(str(out)).select("k", "n")) == [("a", 1), ("b", 2)]
    total = lambda d: d.agg(F.sum("n").alias("n"))
    report = lambda: ingest.rewrite_report(s(), total, total, str(tmp_path / "st"), str(tmp_path / "rep"), str(tmp_path / "cp2"))
    report()
    assert rows(ingest.latest_report(spark, str(tmp_path / "rep"))) == [(3,)]
    (src / "c.json").write_text('{"k": "c", "n": 4}\n')
    report()
    assert rows(ingest.latest_report(spark, str(tmp_path / "rep"))) == [(7,)]


def test_append_only_new(spark, tmp_path):
    done = spark.createDataFrame([(1,)], "k int")
    sinks.append_new(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), done, ["k"], str(tmp_path / "j"))
    assert rows(spark.read.json(str(tmp_path / "j")).select("k")) == [(2,)]


def test_windowed_totals_with_watermark(spark, tmp_path):
    import datetime as dt

    src = tmp_path / "ev"
    spark.createDataFrame([(dt.datetime(2026, 1, 1, 10, 5), "a", 1.0), (dt.datetime(2026, 1, 1, 10, 55), "a", 2.0), (dt.datetime(2026, 1, 1, 15, 0), "b", 3.0)], "ts timestamp, event_type string, value double").coalesce(1).write.json(str(src))
    s = ingest.file_stream(spark, str(src), "ts timestamp, event_type string, value double")
    q = ingest.running_totals(s).writeStream.format("memory").queryName("totals").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.table("totals").select("event_type", "n", "total"))
    assert ("a", 2, 3.0) in got and all(r[0] != "b" for r in got)


def test_written_stages_are_cleared(spark):
    import os

    from tallysheet import session

    session.clear_written(spark)
    session.written(spark.range(3), "stage")
    path = session._WRITTEN[0]
    assert os.path.isdir(path.removeprefix("file://"))
    session.clear_written(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not session._WRITTEN
