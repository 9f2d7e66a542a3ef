"""Analytic cases and edge cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.names import frame_number
from pathloom.operators import centerline, conformal, files, pixels, ranking, sequences, shapes, strokes, trajectory
from pathloom.schemas import require_columns


def line(spark, points, frame=0):
    return spark.createDataFrame([(frame, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "frame_id long, node_id long, x double, y double")


def mask(spark, rows):
    return spark.createDataFrame([(0, x, y, 255 if c == "#" else 0) for y, r in enumerate(rows) for x, c in enumerate(r)], "frame_id long, x long, y long, v int")


def lit(df):
    return {(r["x"], r["y"]) for r in df.where("v > 0").collect()}


# --- sequences ---


def test_l_shape_has_length_seven_and_unit_resampling(spark):
    l_shape = line(spark, [(0, 0), (3, 0), (3, 4)])
    assert sequences.arc_length(l_shape).agg(F.max("cum")).first()[0] == pytest.approx(7)
    got = [(r["x"], r["y"]) for r in sequences.resample_open(l_shape, 8).orderBy("i").collect()]
    assert np.allclose(got, [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (3, 3), (3, 4)])


def test_closed_square_gives_its_corners(spark):
    got = [(r["x"], r["y"]) for r in sequences.resample_closed(line(spark, [(0, 0), (1, 0), (1, 1), (0, 1)]), 4).orderBy("i").collect()]
    assert np.allclose(got, [(0, 0), (1, 0), (1, 1), (0, 1)])


def test_degenerate_lines(spark):
    one = sequences.resample_open(line(spark, [(5, 6)]), 3).collect()
    assert [(r["x"], r["y"]) for r in one] == [(0.0, 0.0)] * 3
    still = sequences.resample_open(line(spark, [(5, 6), (5, 6)]), 3).collect()
    assert [(r["x"], r["y"]) for r in still] == [(5.0, 6.0)] * 3
    assert sequences.resample_open(line(spark, []).where("false"), 3).count() == 0


def test_a_last_step_below_the_lengths_rounding_loses_no_point(spark):
    df = line(spark, [(0, 0), (110.25000000001064, 0), (110.25000000001064, 2.0**-47)])
    assert [r["i"] for r in sequences.resample_open(df, 20).orderBy("i").collect()] == list(range(20))


def test_resampling_sorts_a_lines_nodes_once(spark):
    plan = sequences.resample_open(line(spark, [(0, 0), (3, 0)]), 4)._jdf.queryExecution().executedPlan().toString()
    assert sum(s.lstrip(" :+-*(0123456789)").startswith("Sort [") for s in plan.split("== Initial Plan ==")[0].splitlines()) == 1


def test_boundary_bands_lay_no_runs_out_in_pixels(spark):
    plan = shapes.boundary_bands(mask(spark, ["....", ".##.", "...."]), 4, 3, 1, least=3)._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence(" not in plan


def test_smoothing_keeps_constants_and_short_histories(spark):
    flat = line(spark, [(i, 2.0) for i in range(12)])
    assert all(abs(r["y"] - 2) < 1e-12 for r in sequences.smooth(flat, ["y"], 1.2).collect())
    three = flat.union(line(spark, [(i, 9.0) for i in range(12)], 1)).union(line(spark, [(i, 4.0) for i in range(12)], 2))
    assert {r["y"] for r in sequences.smooth_frames(three, ["y"]).collect()} == {2.0, 9.0, 4.0}


def test_short_frames_pass_through_refinement(spark):
    four = [(0, 0), (1, 5), (2, -5), (3, 0)]
    got = sequences.refine(line(spark, four)).orderBy("node_id").collect()
    assert [(r["x"], r["y"]) for r in got] == four


def test_damping_bounds_the_distance_from_the_axis(spark):
    pts = [(i, 10.0 if i == 5 else 0.0) for i in range(11)]
    got = {r["node_id"]: r["y"] for r in sequences.damp(line(spark, pts)).collect()}
    axis = 10 / 11
    assert got[5] - axis == pytest.approx(3 * math.tanh((10 - axis) / 3), abs=1e-6)


# --- trajectories ---


def test_anchor_projects_on_a_segment_and_prefers_the_first_of_equals(spark):
    straight = line(spark, [(0, 0), (10, 0)])
    target = spark.createDataFrame([(0, 2.5, -1.0)], "frame_id long, tx double, ty double")
    a = trajectory.anchor(straight, target).first()
    assert (a["ax"], a["ay"], a["frac"]) == (2.5, 0.0, 0.25)
    tie = spark.createDataFrame([(0, 5.0, 3.0)], "frame_id long, tx double, ty double")
    assert trajectory.nearest_node(straight, tie).first()["node_id"] == 0


def test_trajectory_does_not_change_under_rotation(spark):
    rng = np.random.default_rng(1)
    c, s = math.cos(0.7), math.sin(0.7)
    turn = lambda p: (c * p[0] - s * p[1] + 3, s * p[0] + c * p[1] - 2)
    curves = [[(i * 2.0, 5 * math.sin(i / 3 + f)) for i in range(20)] for f in range(3)]
    marks = [[tuple(rng.uniform(5, 30, 2)) for _ in range(2)] for _ in range(3)]
    def run(move):
        nodes = None
        for f, pts in enumerate(curves):
            own = line(spark, [move(p) for p in pts], f)
            nodes = own if nodes is None else nodes.union(own)
        at = lambda k: spark.createDataFrame([(f, *map(float, move(m[k]))) for f, m in enumerate(marks)], "frame_id long, tx double, ty double")
        rows = trajectory.trajectory(nodes, at(0), at(1), 0, move((15.0, 4.0))).orderBy("Frame").collect()
        return np.array([(r["Longitudinal_From_Special"], abs(r["Transverse_Dist"])) for r in rows])
    assert np.allclose(run(lambda p: p), run(turn))


def test_peaks_of_flat_tops_and_monotone_series(spark):
    assert trajectory.prominent(np.array([0, 1, 1, 1, 0.0])) == [(2, 1.0)]
    assert trajectory.prominent(np.arange(5.0)) == []
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "track long, Frame long, Longitudinal double")
    r = trajectory.peaks(rows).first()
    assert r["first_peak"] is None and r["n_peaks"] == 0


def test_missing_calibration_frame_is_a_clear_error(spark):
    pts = line(spark, [(0, 0), (1, 0)])
    t = spark.createDataFrame([(0, 1.0, 1.0)], "frame_id long, tx double, ty double")
    with pytest.raises(ValueError, match="frame 9"):
        trajectory.trajectory(pts, t, t, 9, (0.0, 0.0))


# --- pixels and shapes ---


def test_lut_values(spark):
    df = spark.createDataFrame([(v,) for v in (90, 97, 110, 123, 200)], "v long")
    assert [r[0] for r in df.select(pixels.lut(F.col("v"), 97, 123)).collect()] == [0, 0, 127, 255, 255]
    assert df.select(pixels.lut(F.col("v"), 50, 50)).first()[0] == 0


def test_wall_boundaries_of_a_mask_pair(spark):
    rows = ["#" * 8 if y < 10 else "." * 8 for y in range(32)]
    other = ["#" * 8 if y >= 20 else "." * 8 for y in range(32)]
    upper = pixels.boundary(pixels.close_open(mask(spark, rows)), "upper")
    lower = pixels.boundary(pixels.close_open(mask(spark, other)), "lower")
    assert {r["y"] for r in upper.collect()} == {9} and {r["y"] for r in lower.collect()} == {20}
    assert pixels.boundary(mask(spark, ["...", "..."]), "upper").count() == 0
    e = pixels.extent(mask(spark, ["...", "..."])).first()
    assert (e["min_x"], e["max_x"]) == (0, 0)


def test_modes_on_masks(spark):
    empty = mask(spark, ["." * 12] * 12)
    square = line(spark, [(1, 1), (10, 1), (10, 10), (1, 10)]).withColumnRenamed("node_id", "seq")
    inside = {(x, y) for x in range(1, 11) for y in range(1, 11)}
    assert lit(shapes.apply_mode(empty, square, "object", 12, 12)) == inside
    assert lit(shapes.apply_mode(empty, square, "hole_crop", 12, 12)) == set()
    some = mask(spark, ["#" * 12 if y == 0 else "." * 12 for y in range(12)])
    assert lit(shapes.apply_mode(some, square, "hole_fill", 12, 12)) == inside | {(x, 0) for x in range(12)}


def test_an_empty_guide_leaves_the_mask(spark):
    some = mask(spark, ["#..", "..#", "###"])
    none = line(spark, [(0, 0)]).where("false").withColumnRenamed("node_id", "seq")
    assert lit(shapes.apply_mode(some, none, "upper_left", 3, 3)) == lit(some)


def test_clip_at_a_line_fills_from_the_boundary_to_it(spark):
    some = mask(spark, ["." * 6] * 6 + ["#" * 6] * 4)
    guide = line(spark, [(0, 3), (5, 3)]).withColumnRenamed("node_id", "seq")
    assert lit(shapes.apply_mode(some, guide, "upper_left", 6, 10)) == {(x, y) for x in range(6) for y in range(3, 10)}
    again = shapes.apply_mode(shapes.apply_mode(some, guide, "upper_left", 6, 10), guide, "upper_left", 6, 10)
    assert lit(again) == {(x, y) for x in range(6) for y in range(3, 10)}


def test_area_growth_reaches_its_target_and_keeps_to_likely_pixels(spark):
    some = mask(spark, ["." * 9] * 4 + ["....#...."] + ["." * 9] * 4)
    likely = spark.createDataFrame([(0, x, 4, 0.9) for x in range(9)], "frame_id long, x long, y long, p double")
    target = spark.createDataFrame([(0, 5)], "frame_id long, area long")
    got = lit(shapes.grow_area(some, likely, target, 9, 9, share=1.0))
    assert got == {(x, 4) for x in range(2, 7)}
    enough = spark.createDataFrame([(0, 1)], "frame_id long, area long")
    assert lit(shapes.grow_area(some, likely, enough, 9, 9)) == {(4, 4)}


def plain_growth(now, allowed, goal, width, height, rounds=25):
    """Growth by the plus shape, pixel by pixel over sets."""
    for _ in range(rounds):
        if not goal or len(now) >= 0.8 * goal:
            break
        fresh = {(x + a, y + b) for x, y in now for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + a < width and 0 <= y + b < height} - now
        if not fresh:
            break
        now = now | (fresh & allowed or fresh)
    return now


def test_area_growth_equals_growth_over_sets_in_one_exchange(spark):
    rng = np.random.default_rng(3)
    seeds, fields, goals, want = [], [], [], {}
    for f in range(40):
        w, h = 11, 8
        now = {(int(x), int(y)) for x, y in zip(rng.integers(0, w, f % 4), rng.integers(0, h, f % 4))}
        p = rng.random((h, w))
        seeds += [(f, x, y, 255 if (x, y) in now else None) for x in range(w) for y in range(h)]
        fields += [(f, x, y, float(p[y, x])) for x in range(w) for y in range(h)]
        goal = int(rng.integers(0, 90))
        goals += [(f, goal)] if f % 5 else []
        want[f] = plain_growth(now, {(x, y) for x in range(w) for y in range(h) if p[y, x] >= 0.4}, goal if f % 5 else 0, w, h)
    make = lambda rows, last: spark.createDataFrame(rows, f"frame_id long, {last}")
    out = shapes.grow_area(make(seeds, "x long, y long, v int"), make(fields, "x long, y long, p double"), make(goals, "area long"), 11, 8, least_p=0.4)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {}
    for r in out.collect():
        got.setdefault(r["frame_id"], set()).update([(r["x"], r["y"])] if r["v"] == 255 else [])
    assert got == want


@pytest.mark.parametrize("buckets,most", [(4096, 10**6), (2, 1), (3, 4)])
def test_lower_percentiles_of_groups_of_any_size(spark, buckets, most):
    """A key with most rows, ties, one value, nulls and extremes; many rounds with few buckets give the same."""
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.normal(size=900) * 10.0 ** rng.integers(-8, 9, 900)] + [("ties", float(v)) for v in rng.integers(0, 4, 60)]
    rows += [("one", 5.0), ("none", None), ("hot", None), ("far", -1.7e308), ("far", 1.7e308), ("far", 0.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.37, 1.0):
        got = {r["k"]: r["v"] for r in ranking.lower_percentiles(df, ["k"], "v", q, buckets, most).collect()}
        want = {}
        for key in {k for k, v in rows if v is not None}:
            own = sorted(v for k, v in rows if k == key and v is not None)
            want[key] = own[int(np.floor(q * (len(own) - 1)))]
        assert got == want


def test_centreline_of_straight_walls_and_of_a_narrow_mask(spark):
    wall = lambda n, y: spark.createDataFrame([(0, x, float(y)) for x in range(n)], "frame_id long, x long, y double")
    got = centerline.centerline(wall(64, 9), wall(64, 20), 100, width=64, height=32).orderBy("node_id").collect()
    assert len(got) == 100
    assert all(abs(r["y_pixel"] - 14.5) < 1e-3 for r in got)
    assert got[0]["x_pixel"] == 0 and got[-1]["x_pixel"] == 63
    assert centerline.centerline(wall(14, 9), wall(14, 20), 100).count() == 0


def test_search_along_normals_finds_a_bright_ridge(spark):
    field = spark.createDataFrame([(0, x, y, 0.9 if y == 7 else 0.0, 128) for x in range(20) for y in range(14)], "frame_id long, x long, y long, p double, v int")
    pts = line(spark, [(x, 5) for x in range(2, 18, 3)]).withColumnRenamed("node_id", "seq")
    assert {r["y"] for r in shapes.search_line(pts, field, "upper_left", 4).collect()} == {7.0}


# --- ranks and files ---


def test_global_index_numbers_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ranking.global_index(df, "k").collect()
    assert all(r["k"] == r["index"] for r in got) and len(got) == 1000
    assert ranking.global_index(df.where("false"), "k").count() == 0


def test_hashed_rank_is_a_rank_of_each_key(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id").union(spark.createDataFrame([(None, 1000), (None, 1001)], "g long, id long"))
    got = ranking.hashed_rank(df, ["g"], ["id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r["_rank"])
        assert r["_count"] == {0: 167, 1: 167, 2: 166, None: 2}[r["g"]]
    assert {g: sorted(v) for g, v in by.items()} == {0: list(range(1, 168)), 1: list(range(1, 168)), 2: list(range(1, 167)), None: [1, 2]}


def test_file_names(spark):
    df = spark.createDataFrame([("f_003.png",), ("12.png",), ("x.png",), (None,), ("9" * 30,)], "name string")
    assert [r[0] for r in df.select(frame_number(F.col("name"))).collect()] == [3, 12, None, None, None]
    two = spark.createDataFrame([("7.png",), ("f7.png",)], "name string")
    assert files.one_per_frame(two, "first").first()["name"] == "7.png" and files.one_per_frame(two, "last").first()["name"] == "f7.png"


def test_empty_ranges_and_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="empty"):
        files.frame_range(spark.range(3).withColumnRenamed("id", "frame_id"), 5, 5)
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(spark.range(1), ["Frame"])


def test_random_batches_cover_the_frames_in_order():
    plan = files.random_batches(list(range(50)), 4)
    assert [f for b in plan for f in b] == list(range(50)) and all(1 <= len(b) <= 5 for b in plan)
    assert plan == files.random_batches(list(range(50)), 4)


def test_smoothed_lines_stream_their_layers(spark):
    """A layer is never one frame of one task; lines of another size start anew, and a layer starts without the one before it."""
    rng = np.random.default_rng(3)
    lines = {(layer, f): rng.normal(0, 9, (5 if f % 6 else 4, 2)) for layer in (1, 2) for f in range(20)}
    rows = [(layer, f, k, float(x), float(y)) for (layer, f), own in lines.items() for k, (x, y) in enumerate(own)]
    got = sequences.ema(spark.createDataFrame(rows, "layer_id long, frame_id long, node_id long, x double, y double"))
    want, before = {}, None
    for (layer, f), now in lines.items():
        if f and len(before) == len(now):
            a = min(0.65, max(0.40, 0.55 - np.sqrt(((now - before) ** 2).sum(1)).mean() / 30.0))
            now = a * now + (1 - a) * before
        before = now
        want.update({(layer, f, k): pytest.approx(p) for k, p in enumerate(now.tolist())})
    assert {(r["layer_id"], r["frame_id"], r["node_id"]): [r["x"], r["y"]] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan


def test_versions_and_peaks_stream_their_keys(spark):
    """No key's rows are gathered into one array or frame, and a long history of undos folds as a plain loop does."""
    ops = [("edit", "undo", "redo", "edit", "undo", "undo")[(i * 7 + i // 5) % 6] for i in range(6000)]
    df = spark.createDataFrame([(1, i, op, i) for i, op in enumerate(ops)] + [(2, 0, "edit", 9)], "layer_id long, seq long, op string, version long")
    now, undo, redo = None, [], []
    for i, op in enumerate(ops):
        if op == "edit":
            undo, now, redo = [*undo, now], i, []
        elif op == "undo" and undo:
            redo, now, undo = [*redo, now], undo[-1], undo[:-1]
        elif op == "redo" and redo:
            undo, now, redo = [*undo, now], redo[-1], redo[:-1]
    got = strokes.versions(df)
    assert {tuple(r) for r in got.collect()} == {(1, now, len(undo), len(redo)), (2, 9, 1, 0)}
    high = trajectory.peaks(df.selectExpr("layer_id track", "seq Frame", "double(version % 9) Longitudinal"))
    assert high.where("track = 1").first()["n_peaks"] == 666
    for plan in (d._jdf.queryExecution().executedPlan().toString() for d in (got, high)):
        assert "MapInArrow" in plan and "collect_list" not in plan and "InPandas" not in plan


def test_a_scan_finds_the_peaks_of_the_whole_series():
    rng = np.random.default_rng(6)
    for k in range(1500):
        n = int(rng.integers(0, 40))
        v = [rng.integers(-3, 4, n) / 10, np.cumsum(rng.normal(0, 0.07, n)), np.round(np.cumsum(rng.normal(0, 0.1, n)), 1), np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 3, n))][k % 4]
        frames = np.cumsum(rng.integers(1, 3, n)).tolist()
        found = [p for p, _ in trajectory.prominent(v, 0.1)]
        high = [p for p in found if v[p] > 0] or found
        scan = trajectory.PeakScan(0.1)
        for f, x in zip(frames, v.tolist()):
            scan.add(f, x)
        assert scan.result() == (frames[high[0]] if high else None, frames[high[-1]] if high else None, len(found)), v


def test_versions_of_an_untouched_stack(spark):
    df = spark.createDataFrame([(1, 0, "undo", None), (1, 1, "redo", None), (2, 0, "edit", 5), (2, 1, "edit", 6), (2, 2, "undo", None), (2, 3, "edit", 7), (2, 4, "redo", None)], "layer_id long, seq long, op string, version long")
    got = {r["layer_id"]: (r["current"], r["undo_depth"], r["redo_depth"]) for r in strokes.versions(df).collect()}
    assert got == {1: (None, 0, 0), 2: (7, 2, 0)}


# --- conformal ---


def test_p_value_card(spark):
    cal = spark.createDataFrame([(0, 1, 1, s) for s in (0.1, 0.5, 0.5, 0.9)], "forest int, label int, y int, score double")
    test = spark.createDataFrame([(0, 7, 1, 0.5), (0, 8, 1, 1.0), (0, 9, 0, 0.5)], "forest int, sample_id long, y int, score double")
    got = {r["sample_id"]: r["p"] for r in conformal.p_values(test, cal, 0.5).collect()}
    assert got[7] == pytest.approx(0.4) and got[8] == pytest.approx(0.8) and got[9] == 0.0


def test_forest_weights_at_their_ends(spark):
    same = spark.createDataFrame([(f, 1, 0.3) for f in range(4)], "forest int, y int, u double")
    assert {r["weight"] for r in conformal.weights(same).collect()} == {0.25}
    none = spark.createDataFrame([(f, 1, 1.2) for f in range(4)], "forest int, y int, u double")
    assert {r["weight"] for r in conformal.weights(none).collect()} == {0.25}


def test_layer_filter_is_idle_at_the_default_and_active_below(spark):
    u = spark.createDataFrame([(f, 1, 0.1 * (f + 1)) for f in range(4)], "forest int, y int, u double")
    assert not any(r["filtered"] for r in conformal.normalised(u).collect())
    assert any(r["filtered"] for r in conformal.normalised(u, 0.5).collect())


def test_cdum_of_one_class_counts_one(spark):
    p = spark.createDataFrame([(0, 1, 1, 0.0, 0.5)], "forest int, sample_id long, label int, p0 double, p1 double")
    got = {r["y"]: r["u"] for r in conformal.cdum(p).collect()}
    assert got[1] == pytest.approx(0.9 * 0 + 0.1 * 1) and got[0] == pytest.approx(0.9 * 1 + 0.1 * 0)


def test_auc_needs_both_labels(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    assert conformal.auc(one).first()["auc"] == 0.5
    both = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, 0.9)], "label int, score double")
    assert conformal.auc(both).first()["auc"] == pytest.approx(0.75)


def test_a_snapshot_goes_on_the_undo_stack(spark):
    kind = "layer_id string, frame_id int, version long, undo array<bigint>, redo array<bigint>"
    rows = spark.createDataFrame([("a", 1, 10, [1, 2], [3]), ("a", 2, None, [4], [5]), ("a", 3, 30, None, None), ("b", 1, 11, [], [6])], kind)
    frames = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 9)], "layer_id string, frame_id int")
    got = {(r["layer_id"], r["frame_id"]): (r["version"], r["undo"], r["redo"]) for r in strokes.snapshot(rows, frames).collect()}
    assert got == {("a", 1): (10, [1, 2, 10], []), ("a", 2): (None, [4], [5]), ("a", 3): (30, [], []), ("b", 1): (11, [], [6])}


def test_discs_by_runs_equal_discs_of_pixels(spark):
    rng = np.random.default_rng(9)
    masks = (rng.random((3, 17, 23)) > 0.8).astype(int) * 255
    df = spark.createDataFrame([(f, x, y, int(masks[f, y, x])) for f in range(3) for y in range(17) for x in range(23)], "frame_id long, x long, y long, v int")
    ys, xs = np.mgrid[:17, :23]
    for radius in (0, 1, 3, 6):
        for f in range(3):
            fg, bg = np.argwhere(masks[f] > 0), np.argwhere(masks[f] == 0)
            near = lambda pts: ((ys[..., None] - pts[:, 0]) ** 2 + (xs[..., None] - pts[:, 1]) ** 2).min(-1) <= radius**2
            if f == 0:
                grown = {(r["frame_id"], r["x"], r["y"]) for r in pixels.dilate_disc(df, radius, 23, 17).collect()}
                eroded = {(r["frame_id"], r["x"], r["y"]) for r in pixels.erode_disc(df, radius, 23, 17).collect()}
            assert {(x, y) for g, x, y in grown if g == f} == {(x, y) for y, x in np.argwhere(near(fg)).tolist()}
            assert {(x, y) for g, x, y in eroded if g == f} == {(x, y) for y, x in np.argwhere((masks[f] > 0) & ~near(bg)).tolist()}
    spread = pixels.grown_runs(pixels.runs(df), {"near": (True, 6)}, 23, 17)
    assert spread.count() <= 3 * 17 * 3  # merged: a few runs a row, whatever the radius


def test_equal_names_are_spread_and_samples_do_not_depend_on_buckets(spark):
    df = spark.createDataFrame([("same", i % 3) for i in range(600)], "k string, v int").repartition(3)
    parts = ranking.global_index(df, "k").select(F.spark_partition_id().alias("p"), "index").collect()
    assert sorted(r["index"] for r in parts) == list(range(600)) and len({r["p"] for r in parts}) > 1
    one = {r["v"]: r["_rank"] for r in ranking.hashed_rank(spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("v")), ["g"], ["v"], 3, 4).collect()}
    two = {r["v"]: r["_rank"] for r in ranking.hashed_rank(spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("v")), ["g"], ["v"], 3, 64).collect()}
    assert one == two
