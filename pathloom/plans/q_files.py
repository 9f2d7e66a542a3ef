"""Queries on files, layers, strokes, versions and points of interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions.names import base_name, frame_number, is_image, stem
from pathloom.operators import files as X
from pathloom.operators import strokes as K
from pathloom.plans.adapters import files, table, track, with_
from pathloom.plans.q_sequences import r6, s6

FRAME = "TRY_CAST(nullif(regexp_extract({0}, '([0-9]+)', 1), '') AS BIGINT)"


def layers(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("layer"), F.col("user_id").alias("frame_id"))


def strokes(s, d):
    n = F.length("text")
    point = lambda k: F.struct((n % 97 + 3 * k).cast("double").alias("x"), (F.col("turn") * 5 + k).cast("double").alias("y"))
    return table(s, d, "conversations").select(F.col("conv_id").alias("layer_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.col("role")).alias("edge_mode"), F.array(*[point(k) for k in range(3)]).alias("pts"))


ST = "st AS (SELECT conv_id AS layer_id, turn AS seq, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS edge_mode, length(text) % 97 AS n, turn FROM conversations)"
PT = f"{ST}, pt AS (SELECT layer_id, seq, CAST(k AS BIGINT) AS place, (n + 3 * k)::DOUBLE AS x, (turn * 5 + k)::DOUBLE AS y, edge_mode FROM st, range(3) t(k))"


def events(s, d):
    op = F.when(F.col("turn") % 5 == 3, "undo").when(F.col("turn") % 5 == 4, "redo").otherwise("edit")
    return table(s, d, "conversations").select(F.col("conv_id").alias("layer_id"), F.col("turn").alias("seq"), op.alias("op"), F.length("text").alias("version"))


def poi_events(s, d):
    op = F.when(F.col("event_type") == "view", "undo").when((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0), "clear").otherwise("add")
    return table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), op.alias("op"))


def clicks(s, d):
    """A click for each customer, on the track of its number."""
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k.alias("track"), k.alias("click"), (k % 64 * 1.5).alias("cx"), (k % 50 * 2.0 - 30.0).alias("cy"))


def wanted(s, d):
    """The frame numbers of all upper masks."""
    return files(s, d, "u").select(frame_number(F.col("name")).alias("frame_id")).distinct()


FOLD = """WITH RECURSIVE e AS (SELECT conv_id AS layer_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE turn % 5 WHEN 3 THEN 'undo' WHEN 4 THEN 'redo' ELSE 'edit' END AS op, length(text)::BIGINT AS v FROM conversations),
f AS (SELECT DISTINCT layer_id, 0::BIGINT AS i, NULL::BIGINT AS now, []::BIGINT[] AS u, []::BIGINT[] AS r FROM e
  UNION ALL SELECT f.layer_id, e.i,
    CASE WHEN op = 'edit' THEN v WHEN op = 'undo' AND len(u) > 0 THEN u[-1] WHEN op = 'redo' AND len(r) > 0 THEN r[-1] ELSE now END,
    CASE WHEN op = 'edit' THEN list_append(u, now) WHEN op = 'undo' AND len(u) > 0 THEN u[:-2] WHEN op = 'redo' AND len(r) > 0 THEN list_append(u, now) ELSE u END,
    CASE WHEN op = 'edit' THEN []::BIGINT[] WHEN op = 'undo' AND len(u) > 0 THEN list_append(r, now) WHEN op = 'redo' AND len(r) > 0 THEN r[:-2] ELSE r END
  FROM f JOIN e ON e.layer_id = f.layer_id AND e.i = f.i + 1)
SELECT layer_id, arg_max_null(now, i) AS current, CAST(len(arg_max(u, i)) AS INT) AS undo_depth, CAST(len(arg_max(r, i)) AS INT) AS redo_depth FROM f GROUP BY layer_id"""
POI_FOLD = """WITH RECURSIVE e AS (SELECT user_id AS session, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_type = 'view' THEN 'undo' WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'clear' ELSE 'add' END AS op FROM events),
f AS (SELECT DISTINCT session, 0::BIGINT AS i, []::BIGINT[] AS a FROM e UNION ALL SELECT f.session, e.i, CASE op WHEN 'add' THEN list_append(a, seq) WHEN 'clear' THEN []::BIGINT[] ELSE CASE WHEN len(a) > 0 THEN a[:-2] ELSE a END END FROM f JOIN e ON e.session = f.session AND e.i = f.i + 1)
SELECT session, unnest(a) AS seq FROM (SELECT session, arg_max(a, i) AS a FROM f GROUP BY session)"""

QUERIES = {
    "frame_id_parse": (
        lambda s, d: files(s, d, "d").select("name", frame_number(F.col("name")).alias("frame_id"), stem(base_name(F.concat(F.lit("/data/masks/"), F.col("name")))).alias("stem"), is_image(F.col("name")).alias("image")),
        f"{with_('fd')} SELECT name, {FRAME.format('name')} AS frame_id, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_matches(lower(name), '\\.(png|jpg|jpeg|tif|tiff|bmp)$') AS image FROM fd",
    ),
    "mask_dedupe_first": (lambda s, d: X.one_per_frame(files(s, d, "d"), "first"), f"{with_('fd')} SELECT {FRAME.format('name')} AS frame_id, min(name) AS name FROM fd GROUP BY 1"),
    "mask_dedupe_last": (lambda s, d: X.one_per_frame(files(s, d, "d"), "last"), f"{with_('fd')} SELECT {FRAME.format('name')} AS frame_id, max(name) AS name FROM fd GROUP BY 1"),
    "mask_lookup": (
        lambda s, d: X.lookup(files(s, d, "l"), wanted(s, d)),
        f"{with_('fl', 'fu')}, f AS (SELECT {FRAME.format('name')} AS frame_id, min(name) AS name FROM fl GROUP BY 1) SELECT i AS frame_id, f.name FROM (SELECT DISTINCT {FRAME.format('name')} AS i FROM fu) LEFT JOIN f ON f.frame_id = i",
    ),
    "mask_lookup_either": (
        lambda s, d: X.lookup_either(files(s, d, "l"), files(s, d, "u"), wanted(s, d)),
        f"{with_('fl', 'fu')}, f AS (SELECT {FRAME.format('name')} AS frame_id, min(name) AS name FROM fl GROUP BY 1), g AS (SELECT {FRAME.format('name')} AS frame_id, min(name) AS name FROM fu GROUP BY 1) SELECT i AS frame_id, coalesce(f.name, g.name) AS name, f.name IS NOT NULL AS from_output FROM (SELECT DISTINCT {FRAME.format('name')} AS i FROM fu) LEFT JOIN f ON f.frame_id = i LEFT JOIN g ON g.frame_id = i",
    ),
    "mask_zip_join": (
        lambda s, d: X.pair_by_position(files(s, d, "u"), files(s, d, "l")),
        f"{with_('fu', 'fl')}, a AS (SELECT row_number() OVER (ORDER BY name) - 1 AS position, name AS upper FROM fu), b AS (SELECT row_number() OVER (ORDER BY name) - 1 AS position, name AS lower FROM fl) SELECT position, upper, lower, {FRAME.format('upper')} AS frame_id FROM a JOIN b USING (position)",
    ),
    "mask_key_join": (
        lambda s, d: X.pair_by_frame(files(s, d, "u"), files(s, d, "l")),
        f"{with_('fu', 'fl')}, a AS (SELECT {FRAME.format('name')} AS frame_id, max(name) AS upper FROM fu GROUP BY 1), b AS (SELECT {FRAME.format('name')} AS frame_id, max(name) AS lower FROM fl GROUP BY 1) SELECT frame_id, upper, lower FROM a JOIN b USING (frame_id)",
    ),
    "mask_mirror": (lambda s, d: X.missing_files(files(s, d, "u"), files(s, d, "u").where(frame_number(F.col("name")) % 3 == 0)), f"{with_('fu')} SELECT name FROM fu WHERE {FRAME.format('name')} % 3 <> 0"),
    "mask_blank": (
        lambda s, d: X.blank_frames(table(s, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("name")), 0, table(s, d, "orders").agg(F.max("o_orderkey")).first()[0] + 20),
        "SELECT i AS frame_id, i || '.png' AS name FROM range(0, (SELECT max(o_orderkey) FROM orders) + 21) t(i) WHERE i NOT IN (SELECT o_orderkey FROM orders)",
    ),
    "mask_common_frames": (
        lambda s, d: X.common_frames(layers(s, d)),
        "SELECT user_id AS frame_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)",
    ),
    "mask_timeline_range": (
        lambda s, d: X.timeline_range(layers(s, d)),
        "SELECT min(f) AS first_frame, max(f) AS last_frame FROM (SELECT user_id AS f FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events))",
    ),
    "frame_range": (
        lambda s, d: X.frame_range(table(s, d, "embeddings").select(F.col("vec_id").alias("frame_id"), "label"), -5, 100),
        "SELECT vec_id AS frame_id, label FROM embeddings WHERE vec_id < 100",
    ),
    "frame_valid": (lambda s, d: X.valid_frames(files(s, d, "u").withColumn("frame_id", frame_number(F.col("name"))), 50), f"{with_('fu')} SELECT name, {FRAME.format('name')} AS frame_id FROM fu WHERE {FRAME.format('name')} < 50"),
    "frame_plane": (
        lambda s, d: X.two_dimensional(table(s, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("channel"))).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")),
        "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1",
    ),
    "batch_plan": (
        lambda s, d: X.fixed_batches(table(s, d, "events").select(F.col("user_id").alias("layer_id"), F.col("event_id").alias("frame_id")), 5),
        "WITH b AS (SELECT user_id AS layer_id, event_id AS frame_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS batch_id FROM events), m AS (SELECT layer_id, batch_id + 1 AS batch_id, max(frame_id) AS anchor FROM b GROUP BY layer_id, batch_id) SELECT layer_id, batch_id, frame_id, anchor FROM b LEFT JOIN m USING (layer_id, batch_id)",
    ),
    "pair_prev_frame": (
        lambda s, d: X.previous_frame(table(s, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("frame_id")), F.lit(-1).cast("long")),
        "SELECT user_id AS batch_id, event_id AS frame_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS previous FROM events",
    ),
    "work_plan": (
        lambda s, d: X.work_plan(table(s, d, "nation").select(F.col("n_nationkey").alias("frame_id")), table(s, d, "region").select(F.col("r_name").alias("layer"))),
        "SELECT n_nationkey AS frame_id, r_name AS layer FROM nation, region",
    ),
    "stroke_mode": (
        lambda s, d: K.layer_mode(strokes(s, d)),
        f"WITH {ST} SELECT layer_id, coalesce(arg_max(edge_mode, seq) FILTER (WHERE edge_mode <> ''), 'object') AS mode FROM st GROUP BY layer_id",
    ),
    "stroke_points": (lambda s, d: K.flat_points(strokes(s, d)).withColumn("place", F.col("place").cast("long")), f"WITH {PT} SELECT layer_id, seq, place, x, y FROM pt"),
    "stroke_enough": (
        lambda s, d: strokes(s, d).groupBy("layer_id").agg(F.count(F.lit(1)).alias("n")).select("layer_id", K.enough_points(F.col("n"), F.lit("upper_left")).alias("line"), K.enough_points(F.col("n"), F.lit("object")).alias("polygon")),
        f"WITH {ST} SELECT layer_id, count(*) >= 2 AS line, count(*) >= 3 AS polygon FROM st GROUP BY layer_id",
    ),
    "stroke_erase": (
        lambda s, d: K.flat_points(K.erase(strokes(s, d), 30.0, 10.0, 12.0)).select("layer_id", "seq", "x", "y"),
        f"WITH {PT} SELECT layer_id, seq, x, y FROM pt WHERE (x - 30) * (x - 30) + (y - 10) * (y - 10) > 144",
    ),
    "stroke_hit": (
        lambda s, d: K.hit(strokes(s, d), 30.0, 10.0, 8.0),
        f"WITH {PT} SELECT layer_id, min((seq, place))[1] AS seq, min((seq, place))[2] AS place FROM pt WHERE (x - 30) * (x - 30) + (y - 10) * (y - 10) <= 128 GROUP BY layer_id",
    ),
    "layer_colour": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", F.get(K.colour_of(F.col("n_nationkey")), F.lit(0)).alias("red"), F.get(K.colour_of(F.col("n_nationkey")), F.lit(2)).alias("blue")),
        "SELECT n_nationkey, CAST([0, 30, 255, 220, 0, 255][n_nationkey % 6 + 1] AS INT) AS red, CAST([80, 255, 0, 220, 230, 40][n_nationkey % 6 + 1] AS INT) AS blue FROM nation",
    ),
    "undo_redo": (lambda s, d: K.versions(events(s, d)), FOLD),
    "guideline_paste": (
        lambda s, d: K.last_guideline(table(s, d, "events").select(F.col("user_id").alias("layer_id"), F.col("event_id").alias("frame_id"), F.when(F.col("event_type") == "click", F.col("value")).alias("strokes"))).select("layer_id", "frame_id", "pasted"),
        "SELECT user_id AS layer_id, event_id AS frame_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS pasted FROM events",
    ),
    "poi_summary": (lambda s, d: K.summary(track(s, d)), f"{with_('tr')} SELECT min(\"Frame\") AS first_frame, max(\"Frame\") AS last_frame, count(*) AS n, count(DISTINCT track) AS n_tracks FROM tr"),
    "poi_tracks": (lambda s, d: track(s, d).select("track").distinct(), f"{with_('tr')} SELECT DISTINCT track FROM tr"),
    "poi_filter": (lambda s, d: K.in_range(track(s, d), 3, 10, 30), f"{with_('tr')} SELECT * FROM tr WHERE track = 3 AND \"Frame\" BETWEEN 10 AND 30"),
    "poi_nearest": (
        lambda s, d: r6(K.nearest_points(track(s, d), clicks(s, d)), "d2").select("track", "click", "d2", "Frame"),
        f"""{with_('tr')}, g AS (SELECT track, greatest(max("Frame") - min("Frame"), 1e-9) AS rx, greatest(max("Longitudinal") - min("Longitudinal"), 1e-9) AS ry FROM tr GROUP BY track),
c AS (SELECT c_custkey AS track, c_custkey AS click, c_custkey % 64 * 1.5::DOUBLE AS cx, c_custkey % 50 * 2.0::DOUBLE - 30 AS cy FROM customer),
q AS (SELECT track, click, "Frame" AS f, (("Frame" - cx) / rx) * (("Frame" - cx) / rx) + (("Longitudinal" - cy) / ry) * (("Longitudinal" - cy) / ry) AS d2 FROM tr JOIN g USING (track) JOIN c USING (track))
SELECT track, click, {s6('min(d2)', 'd2')}, arg_min(f, (d2, f)) AS "Frame" FROM q GROUP BY track, click""",
    ),
    "poi_fold_undo": (lambda s, d: K.session(poi_events(s, d)).select("session", "seq"), POI_FOLD),
    "poi_collect": (
        lambda s, d: K.collected((track(s, d).where("track % 2 = 0"), "a.csv"), (track(s, d).where("track % 2 <> 0"), "b.csv"), (track(s, d).where("track % 2 = 0"), "a.csv")).dropDuplicates(),
        f"{with_('tr')} SELECT *, CASE WHEN track % 2 = 0 THEN 'a.csv' ELSE 'b.csv' END AS source_file FROM tr",
    ),
    "inversion_map": (
        lambda s, d: K.inversion(table(s, d, "region").select(F.col("r_name").alias("path")), table(s, d, "region").where("r_regionkey = 2").select(F.col("r_name").alias("path"), F.lit(False).alias("invert"))),
        "SELECT r_name AS path, r_regionkey <> 2 AS invert FROM region",
    ),
    "frame_union": (
        lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("x")).union(table(s, d, "supplier").select("s_nationkey")).distinct(),
        "SELECT c_nationkey AS x FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "frame_intersect": (
        lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("x")).intersect(table(s, d, "supplier").select("s_suppkey")),
        "SELECT c_custkey AS x FROM customer INTERSECT SELECT s_suppkey FROM supplier",
    ),
}
