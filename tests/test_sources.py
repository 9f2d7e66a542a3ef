"""Image codecs, folders, stacks and tables by round trips."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.sources import hdf5, images, nd2, tables, video


def sample(dtype, shape=(7, 5)):
    return np.random.default_rng(1).integers(0, np.iinfo(dtype).max, shape).astype(dtype)


@pytest.mark.parametrize("dtype,shape", [(np.uint8, (7, 5)), (np.uint16, (7, 5)), (np.uint8, (4, 6, 3)), (np.uint8, (1, 1))])
def test_png_round_trip(dtype, shape):
    x = sample(dtype, shape)
    assert (images.read_png(images.write_png(x)) == x).all()


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_row_filters(kind):
    x = sample(np.uint8, (6, 9, 3))
    flat = x.reshape(6, -1).astype(int)
    rows = []
    for y in range(6):
        out = []
        for i in range(flat.shape[1]):
            a = flat[y, i - 3] if i >= 3 else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - 3] if y and i >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((flat[y, i] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append(bytes([kind]) + bytes(out))
    data = images.write_png(x)
    body = images._MAGIC + data[8:33] + images._chunk(b"IDAT", zlib.compress(b"".join(rows))) + images._chunk(b"IEND", b"")
    assert (images.read_png(body) == x).all()


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_tiff_round_trip(dtype):
    pages = [sample(dtype), sample(dtype) // 2]
    got = list(images.read_tiff(images.write_tiff(pages)))
    assert len(got) == 2 and all((a == b).all() for a, b in zip(got, pages))
    with pytest.raises(ValueError):
        images.decode(b"neither")


def test_image_folder_scan(spark, tmp_path):
    a, b, c = (sample(np.uint8) // k for k in (1, 2, 3))
    for name, x in (("7.png", a), ("f7.png", b), ("12.PNG", c)):
        (tmp_path / name).write_bytes(images.write_png(x))
    (tmp_path / "x.png").write_bytes(images.write_png(a))
    (tmp_path / "notes.txt").write_text("9")
    (tmp_path / "3.tif").write_bytes(images.write_tiff([sample(np.uint16)]))
    frames = {r["frame_id"]: r.asDict() for r in video.read_video(spark, str(tmp_path)).collect()}
    assert set(frames) == {3, 7, 12}
    assert (video.as_array(frames[7]) == b).all() and frames[3]["dtype"] == "uint16"
    first = video.folder_frames(spark, str(tmp_path), policy="first").where("frame_id = 7").first().asDict()
    assert (video.as_array(first) == a).all()


def test_stack_pixels_and_packing(spark, tmp_path):
    pages = [sample(np.uint8), sample(np.uint8)[::-1]]
    path = str(tmp_path / "s.tif")
    open(path, "wb").write(images.write_tiff(pages))
    frames = video.read_video(spark, path)
    pix = video.pixels_of(frames)
    assert {(r["frame_id"], r["x"], r["y"]): r["v"] for r in pix.collect()} == {(k, x, y): int(p[y, x]) for k, p in enumerate(pages) for y in range(7) for x in range(5)}
    assert video.pixels_of(frames, (1, 3, 2, 4)).count() == 8
    assert video.colour_pixels_of(frames).columns == ["frame_id", "x", "y", "r", "g", "b"]
    back = {r["frame_id"]: r.asDict() for r in video.packed(pix, 5, 7).collect()}
    assert all((video.as_array(back[k]) == p).all() for k, p in enumerate(pages))
    tables.write_video(frames, str(tmp_path / "v.parquet"))
    again = spark.read.parquet(str(tmp_path / "v.parquet"))
    assert video.frame_at(again, 1).count() == 1
    plan = video.frame_at(again, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(frame_id), EqualTo(frame_id,1)]" in plan


def test_packing_of_large_frames_fills_gaps_and_ignores_what_lies_outside(spark):
    px = spark.range(512 * 512).selectExpr("3 as frame_id", "cast(id % 512 as int) as x", "cast(id div 512 as int) as y", "cast((id * 7) % 256 as int) as v")
    px = px.where("x % 5 <> 0").union(spark.createDataFrame([(3, -1, 0, 9), (3, 512, 0, 9), (9, 0, 0, 200)], "frame_id int, x int, y int, v int"))
    got = {r["frame_id"]: video.as_array(r.asDict()) for r in video.packed(px, 512, 512).collect()}
    want = (np.arange(512 * 512) * 7 % 256).astype(np.uint8).reshape(512, 512)
    want[:, ::5] = 0
    assert (got[3] == want).all() and got[9][0, 0] == 200 and got[9].sum() == 200


def lv(value, name):
    """A binary variant of a dict, a number or a text."""
    head = lambda kind: bytes([kind, len(name) + 1]) + (name + "\0").encode("utf-16-le")
    if isinstance(value, dict):
        items = b"".join(lv(v, k) for k, v in value.items())
        return head(11) + struct.pack("<IQ", len(value), len(head(11)) + 12 + len(items)) + items + bytes(8 * len(value))
    if isinstance(value, str):
        return head(8) + (value + "\0").encode("utf-16-le")
    return head(6) + struct.pack("<d", value) if isinstance(value, float) else head(3) + struct.pack("<I", value)


def built_nd2(path, images, loops, compression=2, pad=0):
    """``images``: sequences of (height, width, components); ``loops``: counts, the outermost first."""
    out, places = open(path, "wb"), []

    def chunk(name, data):
        places.append((name, out.tell(), len(data)))
        out.write(struct.pack("<IIQ", nd2.CHUNK, len(name) + 5, len(data)) + name + bytes(5) + data)

    chunk(b"ND2 FILE SIGNATURE CHUNK NAME01!", b"Ver3.0")
    h, w, parts = images[0].shape
    bits = 8 * images[0].itemsize
    chunk(b"ImageAttributesLV!", lv({"uiWidth": w, "uiWidthBytes": w * parts * bits // 8 + pad, "uiHeight": h, "uiComp": parts, "uiBpcInMemory": bits, "uiSequenceCount": len(images), "note": "text", "dScale": 0.5, "eCompression": compression}, "SLxImageAttributes"))
    level = {}
    for kind, n in reversed(list(zip((1, 4, 2), loops))):
        level = {"eType": kind, "uLoopPars": {"uiCount": n, "dStep": 1.5}, **({"ppNextLevelEx": {"i0000000000": level}} if level else {})}
    if level:
        chunk(b"ImageMetadataLV!", lv(level, "SLxExperiment"))
    for k, image in enumerate(images):
        rows = np.concatenate([image.reshape(h, -1).view(np.uint8), np.full((h, pad), 9, np.uint8)], 1).tobytes()
        chunk(b"ImageDataSeq|%d!" % k, struct.pack("<d", k / 9) + (zlib.compress(rows) if compression == 0 else rows))
    at = out.tell()
    data = b"".join(n + struct.pack("<QQ", a, s) for n, a, s in places) + nd2.MAP + struct.pack("<QQ", 0, 0)
    out.write(struct.pack("<IIQ", nd2.CHUNK, 32, len(data)) + b"ND2 FILEMAP SIGNATURE NAME 0001!" + data + nd2.MAP + struct.pack("<Q", at))
    out.close()


@pytest.mark.parametrize("dtype,loops,compression,pad,parts", [("uint16", (6,), 2, 4, 1), ("uint16", (3, 2), 0, 0, 3), ("uint8", (), 2, 1, 2), ("uint8", (2, 3, 1), 2, 0, 1)])
def test_nd2_frames_are_planned_by_range(spark, tmp_path, dtype, loops, compression, pad, parts):
    """The first component and plane of each frame; only the frames asked for are planned."""
    rng, path = np.random.default_rng(2), str(tmp_path / "rec.nd2")
    images = [rng.integers(0, 255, (5, 6, parts)).astype(dtype) for _ in range(6)]
    built_nd2(path, images, loops, compression, pad)
    n = loops[0] if loops else 6
    want = [images[k * (6 // n)][:, :, 0] for k in range(n)]
    got = {r["frame_id"]: (r["video_id"], video.as_array(r.asDict())) for r in nd2.read_nd2(spark, path).collect()}
    assert sorted(got) == list(range(n)) and all(v == "rec" and (a == want[k]).all() for k, (v, a) in got.items())
    assert [r["frame_id"] for r in video.nd2_frames(spark, path, start=1, end=2).collect()] == [1]
    assert [len(p.places) for p in nd2.Scan({"path": path, "start": "1", "end": "99", "framesPerTask": "2"}).partitions()] == [2] * ((n - 1) // 2) + [1] * ((n - 1) % 2)
    assert video.read_video(spark, path).count() == n


def test_nd2_errors_are_clear(spark, tmp_path):
    path = str(tmp_path / "a.nd2")
    built_nd2(path, [np.zeros((2, 2, 1), np.uint8)], (1,), compression=1)
    with pytest.raises(Exception, match="lossy"):
        nd2.read_nd2(spark, path).count()
    built_nd2(path, [np.zeros((2, 2, 1), np.uint8)], (1,))
    with pytest.raises(Exception, match="empty frame range"):
        nd2.read_nd2(spark, path, start=4, end=3).count()
    open(path, "wb").write(bytes(100))
    with pytest.raises(Exception, match="not an ND2 file"):
        nd2.read_nd2(spark, path).count()


def test_hdf5_round_trip_by_recording(spark, tmp_path):
    """Frames of several recordings, written by tasks and read back byte for byte, whole, by ranges and by pushed filters."""
    rng = np.random.default_rng(4)
    rows = [(v, k + 10, 6, 9, kind, bytearray(rng.integers(0, 200, (6, 9)).astype(kind).tobytes())) for v, n, kind in (("a", 150, "uint8"), ("b", 3, "uint16"), ("c", 1, "int32")) for k in range(n)]
    df = spark.createDataFrame(rows, "video_id string, frame_id int, height int, width int, dtype string, data binary").repartition(5)
    hdf5.write_hdf5(df, str(tmp_path), key="frames")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.h5", "b.h5", "c.h5"]
    want = {(r[0], r[1] - 10): (r[2], r[3], r[4], bytes(r[5])) for r in rows}
    seen = lambda d: {(r["video_id"], r["frame_id"]): (r["height"], r["width"], r["dtype"], bytes(r["data"])) for r in d.collect()}
    got = hdf5.read_hdf5(spark, ",".join(str(tmp_path / n) for n in ("a.h5", "b.h5", "c.h5")))
    assert seen(got) == want and got.rdd.getNumPartitions() == 5
    assert seen(hdf5.read_hdf5(spark, f"file://{tmp_path}/a.h5", "frames", start=60, end=70)) == {k: v for k, v in want.items() if k[0] == "a" and 60 <= k[1] < 70}
    assert video.read_video(spark, str(tmp_path / "b.h5")).count() == 3
    assert hdf5.read_hdf5(spark, str(tmp_path / "a.h5"), start=9, end=9).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = hdf5.read_hdf5(spark, str(tmp_path / "a.h5")).where("frame_id >= 5 and frame_id < 8 and video_id = 'a'")
        assert {k[1] for k in seen(pushed)} == {5, 6, 7} and pushed.rdd.getNumPartitions() == 1
        assert hdf5.read_hdf5(spark, str(tmp_path / "a.h5")).where("frame_id = 149").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="no dataset"):
        hdf5.read_hdf5(spark, str(tmp_path / "a.h5"), "other").count()
    ragged = spark.createDataFrame([("d", 0, 1, 2, "uint8", bytearray(2)), ("d", 1, 2, 1, "uint8", bytearray(2))], df.schema)
    with pytest.raises(Exception, match="differ in size"):
        hdf5.write_hdf5(ragged, str(tmp_path))
    assert not (tmp_path / "d.h5").exists()


def test_hdf5_index_of_many_chunks(tmp_path):
    """Three levels of the chunk index; a range reads its own part of it only."""
    path = str(tmp_path / "m.h5")
    out = hdf5.Writer(open(path, "wb"), "x" * 40, "uint16", 1, 2, 1)
    for k in range(5000):
        out.append(zlib.compress(np.array([k, 2 * k % 65536], np.uint16).tobytes(), 1))
    out.close()
    out.f.close()
    with hdf5.opened(path) as f:
        file = hdf5.Reader(f)
        d = file.dataset("x" * 40)
        assert d.shape == (5000, 1, 2) and list(file.names()) == ["x" * 40]
        assert [c[0][0] for c in file.chunks(d, 4090, 4100)] == list(range(4090, 4100))
        assert [int(a[0, 0]) for a in file.frames(d, 0, 5000)] == list(range(5000))


def built(path, layout, dtype=b"\x10\x00\x00\x00\x02\x00\x00\x00\x00\x00\x10\x00", shape=(5, 5, 7), filters=None):
    """A file whose layout message is made by ``layout(put)``; it has two datasets and a header that goes on elsewhere."""
    out = hdf5.Writer(open(path, "wb"), "frames", "uint16", *shape[1:], 1)
    more = [(hdf5.FILTERS, filters)] if filters else []
    space = struct.pack("<BBB5x3Q", 1, 3, 0, *shape)
    rest = out.put(b"".join(struct.pack("<HHB3x", k, len(x) + -len(x) % 8, 0) + x + bytes(-len(x) % 8) for k, x in [(hdf5.LAYOUT, layout(out.put)), *more]))
    size = out.f.tell() - rest
    dataset = out.header([(hdf5.SPACE, space), (hdf5.TYPE, dtype), (hdf5.CONTINUED, struct.pack("<QQ", rest, size))])
    out.f.seek(dataset + 2)
    out.f.write(struct.pack("<H", 4 + len(more)))
    out.f.seek(0, 2)
    heap = out.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, 24, 1, out.put(bytes(8) + b"frames\0\0" + b"other\0\0\0")))
    leaf = out.put(struct.pack("<4sBxHQQ24xQQ24x", b"SNOD", 1, 2, 8, dataset, 16, dataset).ljust(328, b"\0"))
    tree = out.put(struct.pack("<4sBBHQQQQQ", b"TREE", 0, 0, 1, hdf5.UNDEFINED, hdf5.UNDEFINED, 0, leaf, 16).ljust(544, b"\0"))
    root = out.header([(hdf5.TABLE, struct.pack("<QQ", tree, heap))])
    out.f.seek(0)
    out.f.write(hdf5.SIGNATURE + struct.pack("<8BHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, hdf5.UNDEFINED, 0, hdf5.UNDEFINED) + struct.pack("<QQ24x", 0, root))
    out.f.close()


def test_hdf5_in_one_piece_and_in_tiles_with_filters(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 60000, (5, 5, 7)).astype("<u2")
    one, tiled = str(tmp_path / "one.h5"), str(tmp_path / "tiled.h5")
    built(one, lambda put: struct.pack("<BBQQ", 3, 1, put(image.tobytes()), image.nbytes))

    def tiles(put):
        """Chunks of (2, 3, 4), shuffled, deflated and with a checksum; one is stored as it is, one is missing."""
        entries = []
        for f in range(0, 5, 2):
            for y in range(0, 5, 3):
                for x in range(0, 7, 4):
                    own = np.zeros((2, 3, 4), "<u2")
                    part = image[f : f + 2, y : y + 3, x : x + 4]
                    own[: part.shape[0], : part.shape[1], : part.shape[2]] = part
                    if (f, y, x) == (2, 3, 4):
                        continue
                    plain = (f, y, x) == (0, 0, 4)
                    data = own.tobytes() if plain else zlib.compress(own.view(np.uint8).reshape(-1, 2).T.tobytes()) + b"sum4"
                    entries.append(struct.pack("<II4QQ", len(data), 7 if plain else 0, f, y, x, 0, put(data)))
        node = struct.pack("<4sBBHQQ", b"TREE", 1, 0, len(entries), hdf5.UNDEFINED, hdf5.UNDEFINED) + b"".join(entries) + struct.pack("<II4Q", 0, 0, 6, 0, 0, 0)
        return struct.pack("<BBBQ4I", 3, 2, 4, put(node), 2, 3, 4, 2)

    filters = struct.pack("<BB6x", 1, 3) + struct.pack("<HHHHI4x", 2, 0, 1, 1, 2) + struct.pack("<HHHH8sI4x", 1, 8, 1, 1, b"deflate\0", 4) + struct.pack("<HHHH", 3, 0, 0, 0)
    built(tiled, tiles, filters=filters)
    gap = image.copy()
    gap[2:4, 3:, 4:] = 0
    for path, want in ((one, image), (tiled, gap)):
        for key in (None, "frames", "other"):
            got = {r["frame_id"]: video.as_array(r.asDict()) for r in hdf5.read_hdf5(spark, path, key).collect()}
            assert sorted(got) == list(range(5)) and all((got[k] == want[k]).all() for k in got)
        assert [r["frame_id"] for r in hdf5.read_hdf5(spark, path, start=1, end=4).orderBy("frame_id").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="not an HDF5 file"):
        (tmp_path / "no.h5").write_bytes(bytes(200))
        hdf5.read_hdf5(spark, str(tmp_path / "no.h5")).count()


def test_masks_are_written_in_the_layer_colour_and_read_back(spark, tmp_path):
    mask = (sample(np.uint8) > 128).astype(np.uint8) * 255
    df = spark.createDataFrame([("v", "upper", 4, 7, 5, bytearray(mask.tobytes()))], "video_id string, layer_id string, frame_id int, height int, width int, data binary")
    tables.write_files(tables.encoded_masks(df, (10, 200, 30)), str(tmp_path / "out"))
    got = video.colour_pixels_of(video.folder_frames(spark, str(tmp_path / "out")))
    from pathloom.operators.pixels import decode_colour

    back = {(r["x"], r["y"]): r["v"] for r in decode_colour(got, (10, 200, 30)).collect()}
    assert back == {(x, y): int(mask[y, x]) for y in range(7) for x in range(5)}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Special_Node_Y,Transverse_Dist,note,Frame,Longitudinal_From_Special,Special_Node_X,id\n4,1.5,n,7,22.0,3,5\n4,,n,8,1,3,5\n4,1.5,n,x,1,3,5\n")
    (tmp_path / "b.csv").write_text("Frame,Longitudinal_From_Special,Transverse_Dist,Special_Node_X,Special_Node_Y\n1,2,3,4,5\n")
    rows = tables.read_trajectories(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "a.csv")]).orderBy("Frame").collect()
    assert [(r["Frame"], r["Longitudinal_From_Special"], r["Transverse_Dist"], r["Special_Node_X"], r["Special_Node_Y"], r["note"], r["Trajectory_ID"], r["source_file"]) for r in rows] == [(1, 2.0, 3.0, 4.0, 5.0, None, 0, "b.csv"), (7, 22.0, 1.5, 3.0, 4.0, "n", 0, "a.csv")]
    assert tables.read_trajectories(spark, [str(tmp_path / "a.csv")], "id").first()["Trajectory_ID"] == 5
    with pytest.raises(ValueError, match="'id'"):
        tables.read_trajectories(spark, [str(tmp_path / "b.csv")], "id")
    with pytest.raises(ValueError, match="frame_id.*available"):
        tables.read_skeleton(spark, str(tmp_path / "b.csv"))
    (tmp_path / "s.csv").write_text("y_pixel,x_pixel,node_id,frame_id\n1,2,3,4\n")
    assert tuple(tables.read_skeleton(spark, str(tmp_path / "s.csv")).first()) == (4, 3, 2.0, 1.0, None)


def test_tables_round_trip(spark, tmp_path):
    sk = spark.createDataFrame([(f, n, n * 1.234567, -0.5 + f, 1.23456789) for f in (1, 0) for n in (1, 0, 2)], "frame_id int, node_id int, x_pixel double, y_pixel double, node_spacing double")
    tables.write_skeleton(sk, str(tmp_path / "sk"), 100, 100)
    got = tables.read_skeleton(spark, str(tmp_path / "sk")).orderBy("frame_id", "node_id").collect()
    assert len(got) == 6 and got[1]["x_pixel"] == 1.2346 and got[0]["y_pixel"] == 0.0 and got[0]["node_spacing"] == 1.234568
    arrays = tables.skeleton_arrays(tables.read_skeleton(spark, str(tmp_path / "sk"))).where("frame_id = 1").first()["points"]
    assert [p["x"] for p in arrays] == [0.0, 1.2346, 2.4691]
    tr = spark.createDataFrame([(2, 1.5, -2.5, 3.0, 4.0), (1, 0.5, 0.25, 3.0, 4.0)], "Frame int, Longitudinal_From_Special double, Transverse_Dist double, Special_Node_X double, Special_Node_Y double")
    tables.write_trajectory(tr, str(tmp_path / "tr"))
    two = tables.read_trajectories(spark, [str(tmp_path / "tr"), str(tmp_path / "tr")])
    assert [tuple(r)[:5] for r in two.orderBy("Frame").collect()] == sorted(map(tuple, tr.collect()))
    assert tables.preview(two)["rows"] == 2 and all(r["source_file"].endswith(".csv") for r in two.collect())
    tables.write_poi(tr.withColumn("note", F.lit("n")), str(tmp_path / "poi"))
    assert spark.read.csv(str(tmp_path / "poi"), header=True).columns[-1] == "note"
