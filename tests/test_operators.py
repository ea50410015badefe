"""Small cases with known answers, and invariants."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.providers import BlockTokens, ThresholdMasks, embed, segment
from tessera.operators import adjacency, assign, contour, graph, grid, histogram, jobs, masks, sequence, validate, vectors
from tessera.plans.views import events_of
from tessera.sources import images, layout
from tessera.streaming import jobs as stream


def full(spark, n_rows, n_cols, drop=(), confidence=lambda i: 0.9):
    rows = [(0, r * n_cols + c, r, c, confidence(r * n_cols + c), 0) for r in range(n_rows) for c in range(n_cols) if (r, c) not in drop]
    return spark.createDataFrame(rows, "job_id long, piece_id long, row long, col long, confidence double, flat_side_count long")


def test_neighbours_of_small_grids(spark):
    assert grid.neighbour_pairs(full(spark, 2, 2)).count() == 4
    assert {r["n"] for r in grid.ends(grid.neighbour_pairs(full(spark, 2, 2))).groupBy("piece_id").agg(F.count("*").alias("n")).collect()} == {2}
    assert grid.neighbour_pairs(full(spark, 3, 1, drop={(1, 0)})).count() == 0


def test_classes_of_a_three_by_three(spark):
    m = full(spark, 3, 3)
    got = {r["piece_type"]: r["n"] for r in grid.classified(m, grid.shape(m)).groupBy("piece_type").agg(F.count("*").alias("n")).collect()}
    assert got == {"corner": 4, "edge": 4, "interior": 1}
    assert tuple(grid.shape(m.limit(0)).first()) == (1, 1)


def test_complement_ladder(spark):
    cases = [(True, True, 1.0), (True, False, 0.25), (None, True, 0.5)]
    for a, b, want in cases:
        df = spark.range(1).select(adjacency.complement(F.lit(a).cast("boolean"), F.lit(b).cast("boolean"), F.lit(16), F.lit(0.1), F.lit(1.0), F.lit(1.0)).alias("x"))
        assert df.first()["x"] == want


def test_flat_score_and_threshold(spark):
    assert spark.range(1).select(grid.flat_score(F.lit(2), F.lit(0)), grid.flat_score(F.lit(1), F.lit(1))).first() == (0.0, 1.0)
    s = assign.stats(full(spark, 1, 2, confidence=lambda i: 0.55).withColumn("flagged", F.col("confidence") < 0.55)).first()
    assert s["flagged_count"] == 0 and s["mean"] == pytest.approx(0.55)
    empty = assign.stats(full(spark, 1, 1).limit(0).withColumn("flagged", F.lit(False))).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0, 0, 0.0)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 6, (n, m)) / 5
    i, j = assign.solve(cost)
    assert len(set(i.tolist())) == len(set(j.tolist())) == min(n, m)
    best = min(sum(cost[r, c] for r, c in zip(rows, p)) for rows in itertools.combinations(range(n), min(n, m)) for p in itertools.permutations(range(m), min(n, m)))
    assert cost[i, j].sum() == pytest.approx(best)


def test_top_cosine_against_brute_force(spark):
    rng = np.random.default_rng(3)
    q, x = rng.standard_normal((30, 8)), rng.standard_normal((70, 8))
    x[5] = 0
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, cls array<double>")
    xs = spark.createDataFrame([(i // 10, i % 10, v.tolist()) for i, v in enumerate(x)], "row long, col long, cls array<double>")
    got = {}
    for r in vectors.top_cosine(qs, xs, 7, ["q"], ["row", "col"], block=16).orderBy("q", "rk").collect():
        got.setdefault(r["q"], []).append(r["row"] * 10 + r["col"])
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)).T
    assert got == {i: np.argsort(-np.round(cos[i], 12), kind="stable")[:7].tolist() for i in range(30)}


def test_orthogonal_and_equal_token_sets(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [2.0, 0.0])]
    t = spark.createDataFrame(rows, "id long, tok long, vec array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 0)], "a long, b long")
    got = vectors.max_sim(pairs, t.withColumnRenamed("id", "a"), t.withColumnRenamed("id", "b"), ["a"], ["b"])
    assert {(r["a"], r["b"]): r["fine"] for r in got.collect()} == {(0, 1): 0.0, (0, 2): 1.0, (0, 0): 1.0}


def test_breadth_first_with_a_hole_and_an_island(spark):
    m = full(spark, 3, 4, drop={(0, 2), (1, 2), (2, 2)})
    typed = grid.classified(m, grid.shape(m))
    rows = sequence.assembly_order(typed).orderBy("step_num").collect()
    assert [r["piece_id"] for r in rows[:3]] == [0, 4, 1] and len(rows) == 9
    assert [r["level"] for r in rows[-3:]] == [None] * 3 and {r["col"] for r in rows[-3:]} == {3}
    no_origin = grid.classified(full(spark, 2, 2, drop={(0, 0)}, confidence=lambda i: i / 10), grid.shape(m))
    assert sequence.assembly_order(no_origin).orderBy("step_num").first()["piece_id"] == 3


@settings(max_examples=15, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}


def test_look_up_table_takes_the_first_level_that_reaches_the_share(spark):
    s = spark.createDataFrame([("c", 0, 0.2), ("c", 1, 0.5), ("c", 2, 1.0)], "c string, v long, cdf double")
    t = spark.createDataFrame([("c", 0, 0.2), ("c", 1, 0.6), ("c", 2, 0.9)], "c string, v long, cdf double")
    got = histogram.lut(s, t, ["c"], 3).orderBy("i").collect()
    assert [(r["i"], r["j"]) for r in got] == [(0, 0), (1, 1), (2, 2)]


def test_square_contour(spark):
    pts = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])], "id long, idx long, x double, y double")
    p = contour.polygons(pts, "id").first()
    assert (p["area"], p["perimeter"]) == (4.0, 8.0)
    assert {round(r["angle_deg"], 6) for r in contour.corner_angles(pts, "id").collect()} == {90.0}
    assert contour.signed_curvature(pts.limit(2), "id").collect() == [(1, 0, 0.0)]
    near = contour.nearest_points(pts, contour.box_corners(pts, "id"), "id")
    assert sorted(r["n_points"] for r in contour.side_segments(pts, near, "id").collect()) == [2, 2, 2, 2]


def test_masks_split_only_with_two_valid_children(spark):
    m = spark.createDataFrame([(1, 100), (2, 100)], "mask_id long, area long")
    kids = spark.createDataFrame([(1, "a", 40), (1, "b", 50), (2, "a", 90), (2, "b", 1)], "parent_id long, child string, area long")
    got = {r["mask_id"]: r["refined"] for r in masks.split(m, kids, 10).collect()}
    assert got == {"1/a": True, "1/b": True, "2": False}


def test_first_failing_check_wins(spark):
    code = lambda size, fmt, ch, h, w: spark.range(1).select(validate.error_code(*[F.lit(x).cast(t) for x, t in zip((size, fmt, ch, h, w), ("long", "string", "int", "int", "int"))])).first()[0]
    assert [code(0, None, 1, 1, 1), code(validate.MAX_BYTES + 1, None, 3, 1, 1), code(9, None, 3, 99, 99), code(9, "png", 3, None, 9), code(9, "png", 1, 99, 99), code(9, "png", 3, 63, 99), code(9, "png", 3, 99, 16_001), code(9, "png", 3, 64, 16_000)] == ["empty", "too_large", "format", "decode", "channels", "too_small", "too_wide", None]


def test_kernels():
    square = np.array([(x, 0) for x in range(10)] + [(10, y) for y in range(10)] + [(x, 10) for x in range(10, 0, -1)] + [(0, y) for y in range(10, 0, -1)], float)
    assert kernels.solidity(square) == pytest.approx(1.0) and not kernels.has_deep_defect(square)
    assert kernels.corners(square).tolist() == [0, 10, 20, 30]
    notch = np.array([(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)], float)
    assert kernels.has_deep_defect(notch) and kernels.solidity(notch) < 0.8
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (kernels.rotated(image, 90) == np.rot90(image)).all() and (kernels.rotated(image, 0) == image).all()
    y, x = np.mgrid[0:20, 0:40]
    bell = ((y - 10) ** 2 + (x - 10) ** 2 < 64) | ((y - 10) ** 2 + (x - 29) ** 2 < 64) | ((abs(y - 10) < 2) & (x > 10) & (x < 29))
    label = kernels.watershed(bell)
    assert label.max() == 2 and label[10, 10] != label[10, 29] and (label > 0).tolist() == bell.tolist()
    assert kernels.watershed(np.ones((5, 5), bool)).max() == 1 and kernels.labelled(np.eye(3, dtype=bool)).max() == 1


def test_image_source_sink_and_provider(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 255, (8, 6, 3), np.uint8)
    (tmp_path / "a.ppm").write_bytes(images.encode_ppm(image))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "c.jpg").write_bytes(b"BM")
    files = images.read_files(spark, str(tmp_path))
    codes = {r["path"][-5:]: r["error_code"] for r in images.checked(files).collect()}
    assert codes == {"a.ppm": "format", "b.jpg": None, "c.jpg": "format"}
    rows = images.pixels(files).collect()
    assert len(rows) == image.size and all(image[r["y"], r["x"], r["c"]] == r["v"] for r in rows)
    got = embed(files.filter(F.col("path").endswith("ppm")), BlockTokens, images.decode_ppm)
    assert got.count() == 4 * 16 and got.select("rot").distinct().count() == 4
    full(spark, 2, 2).write.mode("overwrite").partitionBy("job_id").parquet(str(tmp_path / "jobs"))
    layout.write(full(spark, 1, 1).withColumn("job_id", F.lit(7)), str(tmp_path / "jobs"))
    assert layout.exists(spark, str(tmp_path / "jobs"), 7) and not layout.exists(spark, str(tmp_path / "jobs"), 8)
    assert layout.read(spark, str(tmp_path / "jobs"), 0).count() == 4
    layout.write_manifest(full(spark, 2, 2).select("piece_id", "row"), str(tmp_path / "m"))
    assert layout.read_manifest(spark, str(tmp_path / "m"), "piece_id long, row long").count() == 4


def test_stream_agrees_with_batch(spark, tmp_path):
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.latest(events_of(read)).writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = {}
    for r in spark.sql("SELECT * FROM latest").collect():
        if r["job_id"] not in last or r["updated_us"] >= last[r["job_id"]][-1]:
            last[r["job_id"]] = tuple(r)
    batch = jobs.latest(events_of(raw)).withColumn("updated_us", F.unix_micros(F.col("updated_at").cast("timestamp"))).drop("updated_at")
    want = {r["job_id"]: tuple(r) for r in batch.collect()}
    assert set(last) == set(want) and {k: v[1:3] for k, v in last.items()} == {k: v[1:3] for k, v in want.items()}


def test_windowed_streams_run_on_batches(spark):
    raw = events_of(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert stream.throughput(raw).agg(F.sum("n")).first()[0] == raw.count()
    gaps = jobs.expiry(raw).agg(F.sum("expiry_gaps"), F.count("*")).first()
    assert stream.lifetimes(raw).count() == gaps[0] + gaps[1]


def test_masks_uploads_tokens_and_models(spark, tmp_path):
    image = np.zeros((12, 12, 3), np.uint8)
    image[1:4, 1:4], image[6:11, 5:11] = 200, 250
    files = spark.createDataFrame([("a", images.encode_ppm(image)), ("b", None)], "path string, content binary")
    got = segment(files, ThresholdMasks, images.decode_ppm).groupBy("path", "mask_id").agg(F.count("*").alias("n"), F.max("confidence").alias("c")).orderBy("mask_id").collect()
    assert [tuple(r) for r in got] == [("a", 0, 9, 1.0), ("a", 1, 30, 1.0)]

    jpeg = b"\xff\xd8\xff" + b"x" * 40
    rows = [(1, "ok", "image/jpeg", jpeg), (1, "type", "text/plain", jpeg), (2, "bytes", "image/png", b"BM"), (2, "none", "image/png", None)]
    told = images.land(spark.createDataFrame(rows, "job_id long, name string, content_type string, content binary"), str(tmp_path / "up"))
    assert {r["name"]: r["http_code"] for r in told.collect()} == {"ok": 200, "type": 422, "bytes": 422, "none": 422}
    landed = spark.read.parquet(str(tmp_path / "up")).collect()
    assert [(r["job_id"], r["name"], bytes(r["content"])) for r in landed] == [(1, "ok", jpeg)]

    tokens = spark.createDataFrame([(j, p, t, [float(p), float(t)]) for j in (1, 2) for p in range(3) for t in range(2)], "job_id long, piece_id long, tok int, vec array<double>")
    layout.write_tokens(tokens, str(tmp_path / "tok"))
    back = layout.read(spark, str(tmp_path / "tok"))
    assert sorted(map(tuple, back.select(tokens.columns).collect())) == sorted(map(tuple, tokens.collect()))
    assert layout.cleanup(spark, str(tmp_path / "tok"), 1) and not layout.exists(spark, str(tmp_path / "tok"), 1) and layout.exists(spark, str(tmp_path / "tok"), 2)

    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 5)) * [5, 4, 3, 2, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    mean, axes = vectors.pca(df, "v", 8)
    vectors.save_pca(spark, mean, axes, str(tmp_path / "pca"))
    again = vectors.load_pca(spark, str(tmp_path / "pca"))
    assert np.allclose(again[0], mean) and np.allclose(again[1], axes) and axes.shape == (5, 5)
    assert vectors.load_pca(spark, str(tmp_path / "nothing")) is None
    got = np.array([r["reduced"] for r in vectors.project(df, "v", *again).orderBy("i").collect()])
    want = (x - x.mean(axis=0)) @ np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    assert np.allclose(np.abs(got), np.abs(want))
