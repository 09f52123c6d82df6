import random
from contextlib import contextmanager

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallysheet.functions import geometry as G
from tallysheet.functions import maps
from tallysheet.operators import spatial
from tallysheet.operators.components import hook_and_shortcut

from .conftest import rows


@contextmanager
def small_groups(n):
    """Groups above n rows go through the rounds."""
    old, spatial.MAX_GROUP = spatial.MAX_GROUP, n
    try:
        yield
    finally:
        spatial.MAX_GROUP = old


def points(spark, pts, names):
    return spark.createDataFrame(pts, f"page int, {names[0]} int, {names[1]} double, {names[2]} double")


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 1000))
def test_distance_join(spark, seed):
    rng = random.Random(seed)
    a = [(rng.randint(0, 1), i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(40)]
    b = [(rng.randint(0, 1), i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(40)]
    got = rows(spatial.distance_join(points(spark, a, ("l", "cx", "cy")), points(spark, b, ("r", "rx", "ry")), ["page"], 20.0).select("l", "r"))
    want = sorted(((x[1], y[1]) for x in a for y in b if x[0] == y[0] and ((x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2) ** 0.5 <= 20), key=repr)
    assert got == want


def sequential_match(edges):
    used_l, used_r, out = set(), set(), []
    for o, a, b in sorted(edges):
        if a not in used_l and b not in used_r:
            used_l.add(a)
            used_r.add(b)
            out.append((a, b))
    return sorted(out, key=repr)


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 1000))
def test_greedy_match_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randint(0, 3), rng.randint(0, 9), rng.randint(0, 9)) for _ in range(40)})
    df = spark.createDataFrame(edges, "o int, l int, r int")
    assert rows(spatial.greedy_match(df, "o").select("l", "r")) == sequential_match(edges)
    assert rows(spatial.greedy_match(df.withColumn("k", F.lit(1)), "o", by=("k",)).select("l", "r")) == sequential_match(edges)
    if seed % 3 == 0:
        with small_groups(3):
            assert rows(spatial.greedy_match(df, "o").select("l", "r")) == sequential_match(edges)


def test_greedy_match_of_nothing(spark):
    assert spatial.greedy_match(spark.createDataFrame([], "o int, l int, r int"), "o").count() == 0


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 1000))
def test_keep_first_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    ids = list(range(20))
    rank = ids[:]
    rng.shuffle(rank)
    conf = list({tuple(sorted((rng.choice(ids), rng.choice(ids)))) for _ in range(30)})
    kept = set()
    for i in sorted(ids, key=lambda i: rank[i]):
        if not any((min(i, k), max(i, k)) in conf for k in kept if k != i):
            kept.add(i)
    nodes = spark.createDataFrame([(i, rank[i]) for i in ids], "id int, rank int")
    edges = spark.createDataFrame(conf, "a int, b int")
    assert {r["id"] for r in spatial.keep_first(nodes, edges).collect()} == kept
    if seed % 3 == 0:
        with small_groups(3):
            assert {r["id"] for r in spatial.keep_first(nodes, edges).collect()} == kept


@settings(max_examples=2, deadline=None)
@given(st.integers(0, 1000))
def test_suppression_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    pts = [(0, i, i, float(rng.randint(0, 60)), float(rng.randint(0, 60))) for i in range(60)]
    kept: list = []
    for _, i, _, x, y in pts:
        if not any(abs(x - a) < 12 and abs(y - b) < 12 for _, a, b in kept):
            kept.append((i, x, y))
    b = spark.createDataFrame([*pts, (None, 900, 900, 1.0, 1.0), (0, 901, 901, None, 1.0)], "page int, id int, rank int, cx double, cy double")
    want = sorted([i for i, _, _ in kept] + [900, 901])
    assert sorted(r["id"] for r in spatial.suppress_near(b, ["page"], 12.0).collect()) == want
    with small_groups(20):
        assert sorted(r["id"] for r in spatial.suppress_near(b, ["page"], 12.0).collect()) == want
    box = b.select("page", "id", "rank", F.col("cx").alias("x1"), F.col("cy").alias("y1"), (F.col("cx") + 20).alias("x2"), (F.col("cy") + 20).alias("y2"))
    over = [[]]
    for _, i, _, x, y in pts:
        inter = [(max(0, 20 - abs(x - a)) * max(0, 20 - abs(y - b))) for _, a, b in over[0]]
        if not any(k / (800 - k) > 0.3 for k in inter):
            over[0].append((i, x, y))
    want = sorted([i for i, _, _ in over[0]] + [900, 901])
    assert sorted(r["id"] for r in spatial.suppress_overlaps(box, ["page"], 0.3).collect()) == want
    if seed % 3 == 0:
        with small_groups(20):
            assert sorted(r["id"] for r in spatial.suppress_overlaps(box, ["page"], 0.3).collect()) == want


def test_long_chains_and_dense_cells_end_soon(spark):
    """100,000 boxes that each overlap the next by falling score, and 100,000 boxes in one cell."""
    import time

    n = 100_000
    began = time.time()
    chain = spark.range(n).select(F.lit(0).alias("page"), "id", F.col("id").alias("rank"), (F.col("id") * 40.0).alias("cx"), F.lit(1.0).alias("cy"))
    assert spatial.suppress_near(chain, ["page"], 50.0).count() == n // 2
    box = chain.select("page", "id", "rank", F.col("cx").alias("x1"), F.lit(0.0).alias("y1"), (F.col("cx") + 70).alias("x2"), F.lit(10.0).alias("y2"))
    assert spatial.suppress_overlaps(box, ["page"], 0.25).count() == n // 2
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert spatial.keep_first(spark.range(n + 1).select("id", F.col("id").alias("rank")), edges).count() == n // 2 + 1
    links = spark.range(n).select(F.col("id").alias("o"), F.expr("(id + 1) div 2").alias("l"), F.expr("id div 2").alias("r"))
    assert spatial.greedy_match(links, "o").count() == n // 2
    dense = spark.range(n).select(F.lit(0).alias("page"), "id", F.col("id").alias("rank"), (F.rand(1) * 49).alias("cx"), (F.rand(2) * 49).alias("cy"))
    assert spatial.suppress_near(dense, ["page"], 50.0).count() == 1
    with small_groups(1000):
        assert spatial.suppress_near(dense, ["page"], 50.0).count() == 1
    assert time.time() - began < 240


def test_dense_cells_are_split(spark):
    rng = random.Random(5)
    a = [(0, i, rng.uniform(0, 5), rng.uniform(0, 5)) for i in range(300)]
    b = [(0, i, rng.uniform(0, 5), rng.uniform(0, 5)) for i in range(300)]
    left, right = points(spark, a, ("l", "cx", "cy")), points(spark, b, ("r", "rx", "ry"))
    want = rows(spatial.distance_join(left, right, ["page"], 2.0).select("l", "r"))
    old, spatial.DENSE = spatial.DENSE, 50
    try:
        assert rows(spatial.distance_join(left, right, ["page"], 2.0).select("l", "r")) == want
    finally:
        spatial.DENSE = old


def test_windows_of_any_size(spark):
    rng = random.Random(6)
    w = [(0, i, x, y, x + rng.uniform(0, 300), y + rng.uniform(0, 9)) for i in range(40) for x, y in [(rng.uniform(-50, 50), rng.uniform(-50, 50))]]
    p = [(0, i, rng.uniform(-60, 350), rng.uniform(-60, 60)) for i in range(60)] + [(0, 99, None, 1.0)]
    got = rows(spatial.window_join(spark.createDataFrame(w, "page int, a int, wx1 double, wy1 double, wx2 double, wy2 double"), spark.createDataFrame(p, "page int, b int, px double, py double"), ["page"], 16.0).select("a", "b"))
    assert got == sorted(((a[1], b[1]) for a in w for b in p if b[2] is not None and a[2] <= b[2] <= a[4] and a[3] <= b[3] <= a[5]), key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (None, 3), (101, 100)]
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 100, 101, 200, None, 5]], "node int")
    got = {r["node"]: r["component"] for r in hook_and_shortcut(nodes, spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200}
    assert hook_and_shortcut(nodes, spark.createDataFrame([], "a int, b int")).where("node <> component").count() == 0


def test_iou_and_tiles(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0), (0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 20.0, 10.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "a_x1 double, a_y1 double, a_x2 double, a_y2 double, b_x1 double, b_y1 double, b_x2 double, b_y2 double")
    assert [round(r[0], 6) for r in df.select(G.iou("a_", "b_")).collect()] == [0.333333, 0.0, 0.0]
    assert spark.range(1).select(G.tile_starts(F.lit(1500), 640, 100)).first()[0] == [0, 540, 860]
    assert spark.range(1).select(G.tile_starts(F.lit(300), 640, 100)).first()[0] == [0]


def test_rotation_round_trip(spark):
    df = spark.createDataFrame([(10.0, 20.0, r) for r in (0, 90, 180, 270)], "x double, y double, r int")
    d = df.withColumn("p", G.rotate_to_display(F.col("x"), F.col("y"), F.lit(100.0), F.lit(100.0), F.col("r")))
    back = d.select(G.rotate_to_media(F.col("p.x"), F.col("p.y"), F.lit(100.0), F.lit(100.0), F.col("r")).alias("q")).collect()
    assert all((r["q"]["x"], r["q"]["y"]) == (10.0, 20.0) for r in back)


def test_maps(spark):
    e = F.array(F.struct(F.lit("MODULE\nSIZE").alias("key"), F.lit("24x24").alias("value")), F.struct(F.lit("NECK SIZE").alias("key"), F.lit("10").alias("value")))
    r = spark.range(1).select(maps.prop_lookup(e, ["SIZE"]).alias("a"), maps.prop_lookup(e, ["neck"]).alias("b"), maps.prop_lookup(e, ["ZZ"]).alias("c"), maps.upper_median(F.array(F.lit(1), F.lit(4), F.lit(2), F.lit(3))).alias("m"), maps.band_index(F.array(F.lit(0), F.lit(10), F.lit(20)), F.lit(10)).alias("i"), maps.band_index(F.array(F.lit(0), F.lit(10)), F.lit(10)).alias("o")).first()
    assert (r["a"], r["b"], r["c"], r["m"], r["i"], r["o"]) == ("24x24", "10", None, 3, 1, None)
    p = spark.range(1).select(maps.row_to_props(F.array(F.lit("A"), F.lit(""), F.lit("A"), F.lit("MARK")), F.array(F.lit("1"), F.lit("x"), F.lit("2"), F.lit("CU-1")), F.array(F.lit(3)))).first()[0]
    assert [(x["key"], x["value"]) for x in p] == [("A", "2"), ("COL_2", "x")]


def test_copies_make_no_pairs(spark):
    same = [(0, i, i, 5.0, 5.0) for i in range(3000)] + [(0, 5000, 5000, 30.0, 5.0), (0, 6000, 6000, 500.0, 5.0), (1, 7000, 7000, 5.0, 5.0)]
    b = spark.createDataFrame(same, "page int, id int, rank int, cx double, cy double")
    assert sorted(r["id"] for r in spatial.suppress_near(b, ["page"], 50.0).collect()) == [0, 6000, 7000]
    box = b.select("page", "id", "rank", F.col("cx").alias("x1"), F.col("cy").alias("y1"), (F.col("cx") + 40).alias("x2"), (F.col("cy") + 40).alias("y2"))
    assert sorted(r["id"] for r in spatial.suppress_overlaps(box, ["page"], 0.5).collect()) == [0, 5000, 6000, 7000]
    e = spatial.overlap_edges(box, ["page"])
    assert e.count() == 2999 + 1
    c = hook_and_shortcut(box.select(F.col("id").alias("node")), e)
    assert c.select("component").distinct().count() == 3


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 1000))
def test_first_fit_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    at = lambda: float(rng.choice([-1e15, *range(-60, 60, 3), rng.uniform(-60, 60)]))
    both = [(rng.choice([1, 2, None]), rng.randint(0, 40), at(), at(), rng.randint(0, 40), at(), at()) for _ in range(60)]
    lefts = [(1, rng.randint(0, 60), at(), at(), None, None, None) for _ in range(30)]
    odd = [(1, None, 0.0, 0.0, 3, None, 0.0), (1, 4, float("nan"), 0.0, 5, 0.0, float("inf")), (2, 61, 0.0, 0.0, 61, 20.0, 0.0), (2, 62, 0.0, 0.0, 62, 19.9999999996, 0.0)]
    data = [*both, *lefts, *odd, *both[:9]]
    edges = [(k, a, b) for k, a, cx, cy, *_ in data for p, *_, b, rx, ry in data if k and k == p and None not in (a, cx, cy, b, rx, ry) and round(((cx - rx) ** 2 + (cy - ry) ** 2) ** 0.5, 9) < 20]
    want = sorted((m for k in (1, 2) for m in sequential_match([(a, a, b) for p, a, b in edges if p == k])), key=repr)
    df = spark.createDataFrame(data, "page int, l bigint, cx double, cy double, r bigint, rx double, ry double")
    chunk, spatial.CHUNK = spatial.CHUNK, rng.choice([1, 7, spatial.CHUNK])
    try:
        assert rows(spatial.first_fit(df, ["page"], 20.0)) == want
        if seed % 3 == 0:
            with small_groups(3):
                assert rows(spatial.first_fit(df, ["page"], 20.0)) == want
    finally:
        spatial.CHUNK = chunk
    assert spatial.first_fit(df.limit(0), ["page"], 20.0).count() == 0


def test_first_fit_shuffles_rows_and_no_pairs(spark, tmp_path_factory):
    import re

    from tallysheet.plans import box_queries

    d, n = str(tmp_path_factory.mktemp("crowded")), 1500
    b = spark.range(n).select(F.col("id").alias("box_id"), F.lit("p").alias("project"), F.lit(0).alias("page"), *[(F.col("id") % 7 + k).cast("double").alias(c) for c, k in (("x1", 0), ("y1", 0), ("x2", 9), ("y2", 9))], F.lit("FAN").alias("cls"))
    b.write.parquet(f"{d}/ls_boxes.parquet")
    m = box_queries.first_fit_match(spark, d)
    assert m.where("det_id = truth_id").count() == n == m.count()  # each of 2.2 million pairs is near
    assert not re.search("Join", m._jdf.queryExecution().optimizedPlan().toString())


def test_position_recall_writes_no_pairs(spark, tmp_path_factory):
    from tallysheet.plans import box_queries

    d = str(tmp_path_factory.mktemp("recall"))
    data = [(i, p, 0, float(100 * i), 0.0, 100 * i + 9.0, 9.0, "VAV") for p, ids in (("p", range(1, 21)), ("q", range(21, 24))) for i in ids] + [(30, "q", 1, 0.0, 0.0, 0.0, 9.0, "VAV")]
    spark.createDataFrame([*data, *data[:5]], "box_id bigint, project string, page int, x1 double, y1 double, x2 double, y2 double, cls string").write.parquet(f"{d}/ls_boxes.parquet")
    r = box_queries.position_recall(spark, d)
    assert rows(r) == [("p", 20, 20, 18, 1.0, "good"), ("q", 3, 3, 3, 1.0, "good")]
    assert "LogicalRDD" not in r._jdf.queryExecution().optimizedPlan().toString()
