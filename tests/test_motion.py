"""Features, motion, forests and streams on cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import cascade, features, forests, propagation
from pathloom.plans import q_motion
from pathloom.streaming import follow


def texture(dx=0.0, dy=0.0, size=96):
    ys, xs = np.mgrid[:size, :size].astype(float)
    xs, ys = xs - dx, ys - dy
    return 128 + 50 * np.sin(xs / 5) * np.cos(ys / 6) + 40 * np.sin((xs + 2 * ys) / 11)


def test_blur_keeps_constants_and_mass():
    assert np.allclose(features.blur(np.full((9, 4), 7.0), 3.0), 7)
    x = np.zeros((41, 41))
    x[20, 20] = 1
    assert features.blur(x, 1.0).sum() == pytest.approx(1)


def test_sobel_of_a_ramp():
    gx, gy = features.sobel(np.tile(np.arange(8.0), (6, 1)))
    assert np.allclose(gx[:, 1:-1], 8) and np.allclose(gy, 0)


def test_resize_of_a_plane_is_that_plane():
    ys, xs = np.mgrid[:10, :12].astype(float)
    got = features.resize(2 * xs + ys, 20, 24)
    assert np.allclose(got[4:-4, 4:-4], (2 * ((np.arange(24) + 0.5) / 2 - 0.5)[None, :] + ((np.arange(20) + 0.5) / 2 - 0.5)[:, None])[4:-4, 4:-4])


@pytest.mark.parametrize("dx,dy", [(0.0, 0.0), (1.0, -0.5), (3.0, 2.0)])
def test_dense_flow_of_a_shift(dx, dy):
    flow = features.dense_flow(texture(), texture(dx, dy))[20:-20, 20:-20]
    assert abs(np.median(flow[..., 0]) - dx) < 0.3 and abs(np.median(flow[..., 1]) - dy) < 0.3


def test_sparse_flow_of_a_shift():
    pts = np.array([[30.0, 30.0], [50.0, 60.0], [60.0, 40.0]])
    new, ok = propagation.sparse_flow(texture(), texture(2.5, -1.5), pts)
    assert ok.all() and np.allclose(new - pts, [2.5, -1.5], atol=0.15)
    flat, ok = propagation.sparse_flow(np.full((40, 40), 5.0), np.full((40, 40), 5.0), pts / 2)
    assert not ok.any() and np.allclose(flat, pts / 2)


def test_features_have_forty_eight_columns_and_no_flow_without_a_frame_before():
    g = texture(size=40).astype(np.uint8)
    f = features.region_features(g, None, (4, 30, 6, 28))
    assert f.shape == (26 * 22, 48) and np.isfinite(f).all()
    assert not f[:, [14, 15, 30, 31, 46, 47]].any()
    assert np.allclose(f[:, 0] + f[:, 1], 255)
    assert features.region_features(g, g, (0, 5, 0, 5)).shape == (25, 48)


def embeddings(spark, path, n, labels):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.uniform(-1, 1, 64)], i % labels) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_queries_take_all_frames_of_each_recording(spark, tmp_path):
    d = embeddings(spark, tmp_path, 24, 2)
    lines = q_motion.QUERIES["propagate_lines"][0](spark, d).groupBy("video_id", "layer_id").agg(F.count_distinct("frame_id").alias("n"), F.max("frame_id").alias("last"), F.count(F.lit(1)).alias("points")).collect()
    assert sorted(map(tuple, lines)) == [(v, k, 12, 11, 12 * 24) for v in "01" for k in ("body", "edge")]
    found = q_motion.QUERIES["features_48"][0](spark, d).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.min("n_features").alias("f")).collect()
    assert sorted(map(tuple, found)) == [((v << 32) + k, 1024, 48) for v in (0, 1) for k in range(12)]


def test_the_cascade_predicts_every_tile(spark, tmp_path):
    d = embeddings(spark, tmp_path, 64, 2)
    found = q_motion.QUERIES["cascade_field"][0](spark, d).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count("field").alias("f")).collect()
    assert sorted(map(tuple, found)) == [(i, 64, 64) for i in range(64)]


def test_a_small_region_gives_no_rows(spark):
    g = bytearray(texture(size=16).astype(np.uint8).tobytes())
    rows = [(1, 16, 16, g, None, 0, 3, 0, 10), (2, 16, 16, g, g, -5, 10, 2, 99)]
    df = spark.createDataFrame(rows, "region_id long, height int, width int, data binary, before binary, ymin int, ymax int, xmin int, xmax int")
    got = features.extract(df).groupBy("region_id").count().collect()
    assert [(r["region_id"], r["count"]) for r in got] == [(2, 10 * 14)]


def test_regions_worked_as_a_stack_have_the_features_of_single_ones(spark):
    """Regions of several sizes, with and without a frame before, some cut by the frame's border, in one batch of ninety."""
    rng = np.random.default_rng(8)
    boxes, rows, want = [(3, 35, 5, 37), (-4, 28, 0, 32), (0, 9, 30, 40), (20, 50, 10, 60)], [], {}
    for i in range(90):
        y0, y1, x0, x1 = boxes[i % 4]
        gray, before = (np.clip(texture(k, -k, 48) + rng.normal(size=(48, 48)) * 5, 0, 255).astype(np.uint8)[:, :44].copy() for k in (i % 7, i % 7 + 1))
        rows.append((i, 48, 44, bytearray(gray.tobytes()), None if i % 5 == 0 else bytearray(before.tobytes()), y0, y1, x0, x1))
        own = (max(0, y0), min(48, y1), max(0, x0), min(44, x1))
        ys, xs = np.mgrid[own[0] : own[1], own[2] : own[3]]
        f = features.region_features(gray, None if i % 5 == 0 else before, own)
        want |= {(i, int(x), int(y)): (int(gray[y, x]), z) for x, y, z in zip(xs.ravel(), ys.ravel(), f)}
    df = spark.createDataFrame(rows, "region_id long, height int, width int, data binary, before binary, ymin int, ymax int, xmin int, xmax int").coalesce(1)
    got = features.extract(df).collect()
    assert len(got) == len(want)
    for r in got:
        v, f = want.pop((r["region_id"], r["x"], r["y"]))
        assert r["v"] == v and np.allclose(r["features"], f, rtol=1e-5, atol=1e-5)


def test_regions_are_dealt_to_all_tasks_whatever_their_recording(spark, tmp_path):
    """Two recordings gave two tasks; every region still has its own frame and the one before."""
    d = embeddings(spark, tmp_path, 240, 2)
    found = q_motion.regions(spark, d).withColumn("task", F.spark_partition_id())
    counts = [r["count"] for r in found.groupBy("task").count().collect()]
    assert sum(counts) == 240 and max(counts) <= 240 / 5
    frames = {(int(r["video_id"]) << 32) + r["frame_id"]: bytes(r["data"]) for r in q_motion.recordings(spark, d).collect()}
    rows = found.collect()
    assert {r["region_id"] for r in rows} == set(frames)
    for r in rows:
        assert bytes(r["data"]) == frames[r["region_id"]]
        assert (r["before"] and bytes(r["before"])) == (frames[r["region_id"] - 1] if r["region_id"] % 2**32 else None)


def test_hundredths_are_the_rounded_floats(spark):
    rng = np.random.default_rng(2)
    values = [0.0, -0.0, 0.125, -0.125, 0.375, 2.675, -2.675, 0.005, -0.005, 0.004999, -1e-30, 1e-30, 254.995, 65535.125, -65535.375, 1.5e7]
    values += [float(v) for v in np.concatenate([rng.normal(size=4000) * 10.0 ** rng.integers(-4, 6, 4000), rng.integers(-40000, 40000, 4000) / 8]).astype(np.float32)]
    df = spark.createDataFrame([(v,) for v in values], "v float").select("v", q_motion.hundredths(F.col("v")).alias("got"), F.round(F.col("v").cast("double"), 2).alias("want"))
    assert df.where("got != want OR got IS NULL OR want IS NULL").count() == 0
    assert not any(math.copysign(1, r["got"]) < 0 for r in df.where("got = 0").collect())


def test_resampling_matches_the_rows_form(spark):
    from pathloom.operators.sequences import resample_open

    pts = np.array([[0, 0], [3, 0], [3, 4], [10, 4.0]])
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "frame_id long, node_id long, x double, y double")
    rows = resample_open(df, 9).orderBy("i").collect()
    assert np.allclose(propagation.resample(pts, 9), [(r["x"], r["y"]) for r in rows])


def test_search_matches_the_rows_form(spark):
    from pathloom.operators.shapes import search_line

    rng = np.random.default_rng(3)
    v = rng.integers(0, 256, (14, 20))
    p = rng.uniform(size=(14, 20))
    pts = np.array([[3.0, 5.0], [8.0, 6.0], [12.0, 8.0], [16.0, 5.0]])
    field = spark.createDataFrame([(0, x, y, float(p[y, x]), int(v[y, x])) for x in range(20) for y in range(14)], "frame_id long, x long, y long, p double, v int")
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "frame_id long, seq long, x double, y double")
    rows = search_line(df, field, "upper_left", 4).orderBy("seq").collect()
    assert np.allclose(propagation.search(pts, p, v.astype(float), 4, "upper_left"), [(r["x"], r["y"]) for r in rows], atol=1e-6)


def band(f, size=64):
    ys, xs = np.mgrid[:size, :size]
    return np.clip(190 + 20 * np.sin(xs / 2) * np.cos((ys - f) / 3) - 130 * np.exp(-((ys - 24 - f) ** 2) / 8), 0, 255).astype(np.uint8)


def frames(spark, n, bad=()):
    rows = [("v", f, 64, 64, None if f in bad else bytearray(band(f).tobytes())) for f in range(n)]
    return spark.createDataFrame(rows, "video_id string, frame_id int, height int, width int, data binary")


def test_a_line_follows_a_sinking_band(spark):
    seeds = spark.createDataFrame([("v", "edge", 0, "upper_left", [(2.0, 24.0), (60.0, 24.0)])], "video_id string, layer_id string, frame_id int, edge_mode string, pts array<struct<x:double,y:double>>")
    got = {r["frame_id"]: r for r in propagation.propagate(frames(spark, 8, bad=(5,)), seeds, 20, 6).collect()}
    assert set(got) == set(range(8)) and got[0]["status"] == "seed" and got[5]["status"] == "failed: unreadable frame"
    for f in (1, 4, 7):
        ys = [p["y"] for p in got[f]["strokes"][0]["pts"]]
        assert abs(np.median(ys) - (24 + f)) < 3, (f, np.median(ys))
    assert [p["y"] for p in got[5]["strokes"][0]["pts"]] == [p["y"] for p in got[4]["strokes"][0]["pts"]]
    s = propagation.run_status(propagation.propagate(frames(spark, 8, bad=(5,)), seeds, 20, 6)).first()
    assert (s["frames"], s["errors"], s["outcome"]) == (8, 1, "1 errors")


FITTED = propagation.Classifier(trees=6, more_trees=4, layers=2, depth=4)


def test_a_line_follows_a_band_in_fitted_fields(spark):
    kind = "video_id string, layer_id string, frame_id int, edge_mode string, pts array<struct<x:double,y:double>>"
    seeds = spark.createDataFrame([("v", "edge", 0, "upper_left", [(2.0, 24.0), (60.0, 24.0)])], kind)
    got = {r["frame_id"]: r for r in propagation.propagate(frames(spark, 12), seeds, 20, 6, how=FITTED).collect()}
    assert len(got) == 12 and not any(r["status"].startswith("failed") for r in got.values())
    off = [abs(np.median([p["y"] for p in got[f]["strokes"][0]["pts"]]) - (24 + f)) for f in range(12)]
    assert np.median(off) < 3.5 and max(off) < 13, off  # fields part the sides of a line 3 to 13 pixels off it, so single frames wander there


def test_a_ring_follows_a_disc_in_fitted_fields(spark):
    ground = features.blur(np.random.default_rng(6).normal(size=(80, 80)) * 60, 2.0) + 190
    ys, xs = np.mgrid[:80, :80]
    spots = 20 * np.cos(xs * 0.9) * np.cos(ys * 0.7)
    def disc(f):
        inside = (xs - 34 - f) ** 2 + (ys - 40) ** 2 <= 14**2
        return np.clip(np.where(inside, 70 + np.roll(spots, f, 1), ground), 0, 255).astype(np.uint8)
    rows = [("v", f, 80, 80, bytearray(disc(f).tobytes())) for f in range(8)]
    own = spark.createDataFrame(rows, "video_id string, frame_id int, height int, width int, data binary")
    ring = [(34 + 14 * math.cos(a), 40 + 14 * math.sin(a)) for a in np.arange(16) * np.pi / 8]
    seeds = spark.createDataFrame([("v", "ring", 0, "object", ring)], "video_id string, layer_id string, frame_id int, edge_mode string, pts array<struct<x:double,y:double>>")
    got = {r["frame_id"]: np.array([(p["x"], p["y"]) for p in r["strokes"][0]["pts"]]) for r in propagation.propagate(own, seeds, 24, 6, how=FITTED).collect()}
    for f in range(8):
        assert np.abs(got[f].mean(0) - [34 + f, 40]).max() < 4, (f, got[f].mean(0))


def test_a_resampler_is_used_at_every_step_and_a_failing_step_carries_on(spark):
    seen = []
    def again(points, n, closed):
        seen.append(closed)
        return propagation.resample(points, n, closed)
    f = propagation.Follower("upper_left", 12, 4, None, again)
    f.start(band(0).astype(float), np.array([(2.0, 24.0), (60.0, 24.0)]))
    f.batch([band(1).astype(float), band(2).astype(float)])
    assert len(seen) == 1 + 4 + 4 and not any(seen)
    lines, fields = propagation.Follower("upper_left", 12, 4, FITTED).one_way([band(0).astype(float), np.full((64, 64), np.nan)[:, :3]], f.points)
    assert np.allclose(lines[1], propagation.resample(lines[0], 12)) and not fields[1].any()


def test_forests_learn_and_labels_match_the_rows_form(spark):
    from pathloom.operators import forests, pixels, shapes

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 6))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.2 * rng.normal(size=900) > 0.3).astype(int)
    layers = forests.fit(x[:600], y[:600], 10, 6, 3, 5)
    p = forests.field(layers, x[600:])
    assert forests.auc(p, y[600:]) > 0.85 and 0 <= p.min() and p.max() == 1
    assert forests.fit(x, np.ones(900, int), 4) == []
    assert forests.auc(np.array([1, 2, 3, 3.0]), np.array([0, 1, 0, 1])) == 0.625
    extra = forests.grow(x, y, np.ones(900), 5, 4, 1, False, 1)
    assert ((extra.p1(x) > 0.5) == y).mean() > 0.7
    # labels of bands and of rings as in the operators on rows
    gray = rng.integers(0, 256, (40, 30))
    pts = np.array([[2.0, 18.0], [11.0, 21.0], [27.0, 15.0]])
    rows = [(0, i, float(a), float(b)) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame([(0, x, y, int(gray[y, x])) for x in range(30) for y in range(40)], "frame_id long, x long, y long, v int")
    line = pixels.column_line(shapes.raster_line(spark.createDataFrame(rows, "frame_id long, seq long, x double, y double"), 30, 40))
    want = np.full((40, 30), -1)
    for r in pixels.line_bands(df, line).collect():
        want[r["y"], r["x"]] = r["label"]
    assert (propagation.line_labels(pts, gray) == want).all()
    ring = np.array([[8.0, 10.0], [22.0, 12.0], [20.0, 30.0], [7.0, 28.0]])
    filled = propagation.inside(ring, 40, 30)
    mask = spark.createDataFrame([(0, x, y, 255 * int(filled[y, x])) for x in range(30) for y in range(40)], "frame_id long, x long, y long, v int")
    want = np.full((40, 30), -1)
    for r in shapes.boundary_bands(mask, 30, 40).collect():
        want[r["y"], r["x"]] = r["label"]
    assert (propagation.ring_labels(ring, gray) == want).all()


def test_runs_are_told_by_status_and_merge_into_guidelines(spark):
    line = lambda y: [("point", "upper_left", [(0.0, y)])]
    kind = "video_id string, layer_id string, frame_id int, status string, strokes array<struct<type:string,edge_mode:string,pts:array<struct<x:double,y:double>>>>"
    run = spark.createDataFrame([("v", "a", 0, "seed", line(1.0)), ("v", "a", 1, "ok", line(2.0)), ("v", "b", 0, "failed: x", line(3.0)), ("v", "b", 1, "ok", line(4.0))], kind)
    planned = spark.createDataFrame([("v", "a", 3), ("v", "b", 1), ("v", "c", 1)], "video_id string, layer_id string, last_planned int")
    got = {r["layer_id"]: (r["frames"], r["errors"], r["outcome"]) for r in propagation.run_status(run, planned).collect()}
    assert got == {"a": (2, 0, "stopped"), "b": (2, 1, "1 errors"), "c": (0, 0, "stopped")}
    old = spark.createDataFrame([("v", "a", 1, "", line(9.0)), ("v", "a", 5, "", line(8.0))], kind).drop("status")
    merged = {(r["layer_id"], r["frame_id"]): r["strokes"][0]["pts"][0]["y"] for r in propagation.merge_guidelines(old, run).collect()}
    assert merged == {("a", 0): 1.0, ("a", 1): 2.0, ("a", 5): 8.0, ("b", 0): 3.0, ("b", 1): 4.0}


def test_propagation_does_not_depend_on_the_partitioning(spark):
    seeds = spark.createDataFrame([("v", m, 0, m, [(10.0, 20.0), (40.0, 20.0), (40.0, 40.0), (10.0, 40.0)]) for m in ("object", "lower_right")], "video_id string, layer_id string, frame_id int, edge_mode string, pts array<struct<x:double,y:double>>")
    one = propagation.propagate(frames(spark, 6).coalesce(1), seeds, 16, 5).orderBy("layer_id", "frame_id").collect()
    four = propagation.propagate(frames(spark, 6).repartition(4), seeds, 16, 5).orderBy("layer_id", "frame_id").collect()
    assert one == four and len(one) == 12


def test_cascade_learns_and_gives_p_values(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in f], int(f[0] + 0.3 * rng.normal() > 0)) for i, f in enumerate(rng.normal(size=(600, 4)))]
    df = spark.createDataFrame(rows, "sample_id long, features array<double>, label int")
    layers = cascade.fit(df.where("sample_id < 450"), trees=8, more_trees=4, layers=2, depth=4, tau=0.5)
    assert 1 <= len(layers) <= 2 and len(layers[0].models) == 4
    out = cascade.predict(df.where("sample_id >= 450").withColumn("frame", F.lit(1)), layers, ["frame"], 0.5).join(df, "sample_id").collect()
    assert len(out) == 150 and all(0 <= r["p"] <= 1 and 0 <= r["field"] <= 1 for r in out)
    assert np.mean([r["p"] for r in out if r["label"]]) > np.mean([r["p"] for r in out if not r["label"]]) + 0.2
    assert cascade.fit_layer(df.where("label = 1"), 4) is None
    none = cascade.predict(df.withColumn("frame", F.lit(1)), [], ["frame"]).first()
    assert none["p"] is None


def test_stream_of_frames_is_followed_over_micro_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "video_id string, layer_id string, frame_id int, height int, width int, data binary, xs array<double>, ys array<double>"
    for k, part in enumerate(([0, 1, 2], [3, 2, 4])):
        rows = [("v", "edge", f, 64, 64, bytearray(band(f).tobytes()), [2.0, 60.0] if f == 0 else None, [24.0, 24.0] if f == 0 else None) for f in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = follow.follow(spark.readStream.schema(schema).parquet(src), 20, 6)
        out = str(tmp_path / "out")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).orderBy("frame_id", "status").collect()
    assert [(r["frame_id"], r["status"]) for r in got] == [(0, "seed"), (1, "ok"), (2, "late"), (2, "ok"), (3, "ok"), (4, "ok")]
    assert abs(np.median(got[-1]["ys"]) - 28) < 3


def test_a_run_calls_back_stops_between_batches_and_goes_on(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "video_id string, layer_id string, frame_id int, height int, width int, data binary, xs array<double>, ys array<double>"
    for part in ([0, 1], [2, 3], [4]):
        rows = [("v", "edge", f, 64, 64, bytearray(band(f).tobytes()), [2.0, 60.0] if f == 0 else None, [24.0, 24.0] if f == 0 else None) for f in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: follow.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 16, 5)
    seen, out, ck = [], str(tmp_path / "lines"), str(tmp_path / "ck")
    done = lambda k, lines: seen.append((k, sorted(r["frame_id"] for r in lines.collect())))
    assert follow.run(stream(), out, ck, done, lambda: len(seen) == 1) == "stopped"
    assert len(seen) == 1 and len(seen[0][1]) >= 1
    assert follow.run(stream(), out, ck, done) == "complete"
    assert sorted(f for _, own in seen for f in own) == [0, 1, 2, 3, 4]
    assert sorted(r["frame_id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_windows_over_positions(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, t, float(t)) for t in range(0, 3000, 100)], "track long, t long, Longitudinal double").write.parquet(src)
    df = spark.readStream.schema("track long, t long, Longitudinal double").parquet(src)
    q = follow.windowed_positions(df, F.timestamp_seconds("t")).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("win").orderBy("start").collect()
    assert [r["n"] for r in rows] == [6, 6, 6, 6, 6] and rows[0]["hi"] == 500.0


def test_forests_that_go_on_follow_a_band_at_less_cost(spark):
    """A fifth of the trees grown at each step; the trees of the step before keep their cuts and take new shares."""
    from pathloom.operators import forests

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 8)), rng.integers(0, 2, 300)
    first = forests.fit(x, y, 10, 5, 2, 4)
    then = forests.fit(x + 0.1, y, 10, 5, 2, 4, before=first, fresh=0.2)
    old, new = first[0].forests[2], then[0].forests[2]
    assert len(new.cut) == 10 and (new.cut[2:] == old.cut[:8]).all() and not (new.cut[:2] == old.cut[8:]).all() and (new.share[2:] != old.share[:8]).any()
    whole = forests.Forest(old.feature, old.cut, old.share)
    assert (whole.last(x).max(1) < old.share.shape[1]).all()
    kind = "video_id string, layer_id string, frame_id int, edge_mode string, pts array<struct<x:double,y:double>>"
    seeds = spark.createDataFrame([("v", "edge", 0, "upper_left", [(2.0, 24.0), (60.0, 24.0)])], kind)
    how = propagation.Classifier(trees=10, more_trees=5, layers=2, depth=4, fresh=0.2)
    got = {r["frame_id"]: r for r in propagation.propagate(frames(spark, 12), seeds, 20, 6, how=how).collect()}
    assert all(r["status"] in ("seed", "ok") for r in got.values())
    off = [abs(np.median([p["y"] for p in got[f]["strokes"][0]["pts"]]) - (24 + f)) for f in got]
    assert np.median(off) < 3.5 and max(off) < 13, off


def test_layers_seldom_share_a_task(spark, sf):
    from pyspark.sql import functions as F

    timeline = propagation.propagate(q_motion.recordings(spark, sf).where("frame_id < 2"), q_motion.seeds(spark, sf), 24, 6)
    tasks = timeline.select("video_id", "layer_id", F.spark_partition_id().alias("task")).distinct().groupBy("task").count()
    assert tasks.agg(F.sum("count"), F.max("count")).first()[0] == 20 and tasks.count() >= 17


def test_points_of_which_none_is_found_again_stay():
    """The next frame is another one altogether: every move is refuted on the way back, and their median would carry the line off."""
    rng = np.random.default_rng(3)
    line = np.stack([np.linspace(2, 61, 12).round(), np.full(12, 30.0)], 1)
    for _ in range(20):
        other = features.blur(rng.random((64, 64)) * 255, 6.0)
        moved, good = propagation.track(band(4).astype(float), 128 + (other - other.mean()) * 8, line)
        if not good.any():
            break
    assert not good.any() and (moved == line).all()


def test_windows_beyond_the_frame_tell_nothing_and_tips_stay_inside():
    """A band near the lower border, where most of each window lies outside, is still followed; points that are not finite stay."""
    line = np.stack([np.linspace(2, 61, 12), np.full(12, 24.0 + 34)], 1)
    moved, good = propagation.track(band(34).astype(float), band(33).astype(float), line)
    assert abs(np.median(moved[:, 1]) - 57) <= 1.5
    out = propagation.extend_tips(np.stack([np.linspace(0, 63, 9), np.linspace(50, 57, 9)], 1), 64, 64)
    assert (out >= 0).all() and (out <= 63).all()
    line[3] = np.nan
    to, ok = propagation.sparse_flow(band(0).astype(float), band(1).astype(float), line)
    assert np.isnan(to[3]).all() and not ok[3] and np.isfinite(np.delete(to, 3, 0)).all()


def test_correlation_by_a_product_equals_that_by_shifts():
    rng = np.random.default_rng(5)
    for shape in ((9, 13), (2, 30), (1, 4)):
        x = rng.normal(size=shape)
        for taps in (np.array([1.0, 2, 1]), rng.normal(size=15)):
            for axis in (0, 1):
                assert np.allclose(features.correlate(x, taps, axis), features._correlate(x, taps, axis))


def test_a_run_stops_between_batches_and_keeps_what_is_done(spark, tmp_path):
    """A stop that is asked for during the second batch ends the run after it; one asked for before lets only the seed through."""
    kind = "video_id string, layer_id string, frame_id int, edge_mode string, pts array<struct<x:double,y:double>>"
    seeds = spark.createDataFrame([("v", "edge", 0, "upper_left", [(2.0, 24.0), (60.0, 24.0)])], kind)
    flag = str(tmp_path / "stop")
    calls = []

    def again(points, n, closed):
        calls.append(1)
        if len(calls) == 20:  # the first batch takes 1 + 5 + 5 + 2 * 5 of them
            propagation.request_stop(flag)
        return propagation.resample(points, n, closed)

    whole = {r["frame_id"]: r["strokes"] for r in propagation.propagate(frames(spark, 18), seeds, 20, 6).collect()}
    out = spark.createDataFrame(propagation.propagate(frames(spark, 18), seeds, 20, 6, again=again, stop=flag).collect())
    done = {r["frame_id"]: r["strokes"] for r in out.collect()}
    assert sorted(done) == list(range(len(done))) and 6 <= len(done) < 18 and (len(done) - 1) % 5 == 0
    assert all(done[f] == whole[f] for f in done)
    plan = spark.createDataFrame([("v", "edge", 17)], "video_id string, layer_id string, last_planned int")
    assert propagation.run_status(out, plan).first()["outcome"] == "stopped"
    assert [r["status"] for r in propagation.propagate(frames(spark, 18), seeds, 20, 6, stop=f"file://{flag}").collect()] == ["seed"]


@pytest.mark.parametrize("shape", [(16, 16), (8, 8), (4, 4), (5, 20), (21, 9), (1, 1), (13, 2)])
def test_points_on_small_images_move_as_by_their_windows(shape):
    """Points within, on the border, beyond it and far off, with moves that stay near, leave the image or oscillate."""
    rng = np.random.default_rng(sum(shape))
    for k in range(6):
        one, two = (propagation.Level.of(rng.random(shape) * 200) for _ in range(2))
        if k > 2:
            two = propagation.Level.of(np.roll(one.wide[0, 22:-22, 22:-22], (k - 3, 1), (0, 1)))
        at = np.concatenate([rng.uniform(-3, max(shape) + 3, (20, 2)), rng.integers(0, max(shape), (8, 2)), rng.uniform(-40, 60, (6, 2)), [[0, 0], [shape[1] - 1, shape[0] - 1], [-11, 3], [shape[1] + 10, 0]]])
        move = rng.normal(0, [0.1, 3, 30][k % 3], at.shape)
        (found, solid), (moved, there) = propagation._whole_moves(one, two, at, move), propagation._window_moves(one, two, at, move)
        assert (solid == there).all()
        assert np.allclose(found, moved, rtol=1e-6, atol=1e-5)


def test_small_frames_need_no_windows(monkeypatch):
    """Tracking on a frame of 64 x 64 cuts no window of its own for a point; that was most of a step's time."""
    monkeypatch.setattr(propagation, "_window_moves", None)
    rng = np.random.default_rng(2)
    one, two = (np.frombuffer(q_motion.drawn(k, rng.uniform(-0.3, 0.3, 64).tolist()), np.uint8).reshape(64, 64).astype(float) for k in (8, 9))
    x = np.linspace(4, 58, 12)
    points = np.stack([x, 32 + 4 * np.sin(x / 9)], 1)
    moved, good = propagation.track(one, two, points)
    monkeypatch.undo()
    monkeypatch.setattr(propagation, "_whole_moves", propagation._window_moves)
    again, fine = propagation.track(one, two, points)
    assert good.any() and (moved == again).all() and (good == fine).all()


def test_trees_cut_the_same_rows_whatever_is_worked_at_a_time(monkeypatch):
    """A node takes the best of its tries, which are summed over runs of its rows: every node's share is that of its rows."""
    rng = np.random.default_rng(5)
    x, y, weight = rng.random((300, 9)), rng.random(300) < 0.4, rng.random(300) + 0.5
    trees = []
    for size in (1, 60_000):
        monkeypatch.setattr(forests, "TOGETHER", size)
        trees.append(forests.grow(x, y.astype(int), weight, 4, 4, 11, False, 3))
    assert all((getattr(trees[0], k) == getattr(trees[1], k)).all() for k in ("feature", "cut", "share"))
    for at, share in zip(trees[0].last(x), trees[0].share):
        node = np.zeros(300, int)
        for _ in range(4):
            k = [a.tolist() for a in (trees[0].feature, trees[0].cut)]
            tree = [s.tolist() for s in trees[0].share].index(share.tolist())
            node = 2 * node + 1 + np.array([v[k[0][tree][i]] > k[1][tree][i] for v, i in zip(x, node)])
        assert (node - 15 == at).all()
        assert np.allclose([weight[(at == m) & y].sum() / weight[at == m].sum() for m in np.unique(at)], share[np.unique(at)])


def test_nothing_is_remembered_after_a_batchs_last_step(monkeypatch):
    """Each direction of a batch of n frames keeps the first frame and n - 1 more; features after the last step served no fit."""
    kept, keep = [], propagation.Memory.keep
    monkeypatch.setattr(propagation.Memory, "keep", lambda self, *a: (kept.append(1), keep(self, *a)))
    own = propagation.Follower("upper_left", 12, 6, q_motion.FITTED)
    frames = [np.frombuffer(q_motion.drawn(k, [0.0] * 64), np.uint8).reshape(64, 64).astype(float) for k in range(4)]
    own.start(frames[0], np.array([(float(x), 24 + 4 * np.sin(x / 9)) for x in (2, 16, 30, 44, 61)]))
    own.batch(frames[1:])
    assert len(kept) == 6
