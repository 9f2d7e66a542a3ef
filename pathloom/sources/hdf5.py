"""HDF5 recordings as a Spark data source: datasets of (frames, height, width), chunked and compressed or in one piece.

Written after the public file format specification; the forms that writers use by default are covered: superblock 0, groups with symbol tables, version 1
object headers, chunks in a version 1 B-tree, deflate, shuffle and checksum filters. Reading is planned from a dataset's header alone:
a partition is a range of frames of one file, and its task descends only into the part of the chunk index that holds the range. Writing compresses frames in
parallel; a file has one writer, so a recording's frames then go through one task, which appends their bytes as they come and
the index behind them. Files appear under their names when the job commits.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from pathloom.schemas import FRAMES

# fixed values of the format
SIGNATURE, UNDEFINED = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
SPACE, TYPE, FILL, LAYOUT, FILTERS, CONTINUED, TABLE = 0x1, 0x3, 0x5, 0x8, 0xB, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
GROUP_ENTRIES, LEAF_ENTRIES, CHUNK_ENTRIES = 32, 8, 64
#: Frames of a partition, and bytes of frames that a task hands on at a time.
FRAMES_PER_TASK, BATCH_BYTES = 64, 16 << 20


def opened(path: str) -> pa.NativeFile:
    """A file of any file system that pyarrow knows, or of a mounted folder, for reads at any place."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(name)


@dataclass
class Dataset:
    """What a dataset's header says; ``index`` is the chunk index's address, or that of the data where it lies in one piece."""

    shape: tuple[int, ...]
    dtype: str
    chunk: tuple[int, ...] | None
    index: int
    filters: tuple[int, ...]


class Reader:
    """Datasets of one file."""

    def __init__(self, f: pa.NativeFile):
        self.f = f
        head = self.at(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        if head[8] != 0 or head[13] != 8 or head[14] != 8:
            raise ValueError(f"HDF5 superblock {head[8]} is not supported; rewrite the file with the earliest format")
        self.root = struct.unpack_from("<Q", head, 64)[0]

    def at(self, place: int, size: int) -> bytes:
        self.f.seek(place)
        return self.f.read(size)

    def messages(self, place: int) -> dict[int, bytes]:
        """The messages of a version 1 object header, by kind."""
        version, _, n, _, size = struct.unpack("<BBHII", self.at(place, 12))
        if version != 1:
            raise ValueError("only version 1 object headers are supported; rewrite the file with the earliest format")
        out, blocks = {}, [(place + 16, size)]
        while blocks:
            block, pos = self.at(*blocks.pop(0)), 0
            while pos + 8 <= len(block) and n:
                kind, size = struct.unpack_from("<HH", block, pos)
                data, pos, n = block[pos + 8 : pos + 8 + size], pos + 8 + size, n - 1
                if kind == CONTINUED:
                    blocks.append(struct.unpack_from("<QQ", data))
                else:
                    out.setdefault(kind, data)
        return out

    def names(self) -> dict[str, int]:
        """Names in the root group and their headers' addresses, in the file's order (that of names)."""
        tree, heap = struct.unpack_from("<QQ", self.messages(self.root)[TABLE])
        data = struct.unpack_from("<Q", self.at(heap, 32), 24)[0]
        out = {}
        for leaf in self.group_leaves(tree):
            n = struct.unpack_from("<H", self.at(leaf, 8), 6)[0]
            entries = self.at(leaf + 8, 40 * n)
            for k in range(n):
                name, header = struct.unpack_from("<QQ", entries, 40 * k)
                out[self.at(data + name, 1024).split(b"\0")[0].decode()] = header
        return out

    def group_leaves(self, place: int) -> Iterator[int]:
        level, n = struct.unpack_from("<xBH", self.at(place + 4, 4))
        keys = struct.unpack(f"<{2 * n + 1}Q", self.at(place + 24, 8 * (2 * n + 1)))
        for child in keys[1::2]:
            if level:
                yield from self.group_leaves(child)
            else:
                yield child

    def dataset(self, key: str | None) -> Dataset:
        """The dataset of a name in the root group; the first one without a name."""
        names = self.names()
        if not names or key not in (None, *names):
            raise ValueError(f"no dataset {key!r}; the file has {sorted(names)}")
        m = self.messages(names[key] if key is not None else next(iter(names.values())))
        if SPACE not in m or LAYOUT not in m:
            raise ValueError(f"{key!r} is not a dataset")
        rank = m[SPACE][1]
        shape = struct.unpack_from(f"<{rank}Q", m[SPACE], 8 if m[SPACE][0] == 1 else 4)
        kind, flags, size = m[TYPE][0] & 15, m[TYPE][1], struct.unpack_from("<I", m[TYPE], 4)[0]
        if kind not in (0, 1):
            raise ValueError("only integers and floats are supported")
        dtype = (">" if flags & 1 else "<") + ("f" if kind else "i" if flags & 8 else "u") + str(size)
        layout = m[LAYOUT]
        if layout[0] != 3 or layout[1] not in (1, 2):
            raise ValueError("only contiguous and B-tree chunked layouts are supported; rewrite the file with the earliest format")
        if layout[1] == 1:
            return Dataset(shape, dtype, None, struct.unpack_from("<Q", layout, 2)[0], ())
        chunk = struct.unpack_from(f"<{layout[2] - 1}I", layout, 11)
        return Dataset(shape, dtype, chunk, struct.unpack_from("<Q", layout, 3)[0], tuple(self.filter_ids(m.get(FILTERS))))

    @staticmethod
    def filter_ids(data: bytes | None) -> Iterator[int]:
        pos = 0 if data is None else 8 if data[0] == 1 else 2
        for _ in range(data[1] if data else 0):
            kind = struct.unpack_from("<H", data, pos)[0]
            named = data[0] == 1 or kind >= 256
            name = struct.unpack_from("<H", data, pos + 2)[0] if named else 0
            values = struct.unpack_from("<H", data, pos + (6 if named else 4))[0]
            pos += (8 if named else 6) + name + 4 * values + (4 * (values % 2) if data[0] == 1 else 0)
            if kind not in (DEFLATE, SHUFFLE, CHECKSUM):
                raise ValueError(f"HDF5 filter {kind} is not supported")
            yield kind

    def chunks(self, d: Dataset, start: int, end: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, address, stored bytes, filters left out) of the chunks with frames of start..end - 1, in order."""
        if d.index == UNDEFINED:
            return
        rank = len(d.shape)
        key = 8 + 8 * (rank + 1)

        def walk(place: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
            level, n = struct.unpack_from("<xBH", self.at(place + 4, 4))
            node = self.at(place + 24, (key + 8) * n + key)
            firsts = [struct.unpack_from("<Q", node, (key + 8) * k + 8)[0] for k in range(n + 1)]
            for k in range(n):
                size, mask, *offset = struct.unpack_from(f"<II{rank}Q", node, (key + 8) * k)
                child = struct.unpack_from("<Q", node, (key + 8) * k + key)[0]
                if level and firsts[k] < end and firsts[k + 1] + d.chunk[0] > start:
                    yield from walk(child)
                elif not level and offset[0] < end and offset[0] + d.chunk[0] > start:
                    yield tuple(offset), child, size, mask

        yield from walk(d.index)

    def frames(self, d: Dataset, start: int, end: int) -> Iterator[np.ndarray]:
        """Frames start..end - 1, in order; what no chunk holds is 0."""
        kind = np.dtype(d.dtype)
        if d.chunk is None:
            size = int(np.prod(d.shape[1:])) * kind.itemsize
            for k in range(start, end):
                yield np.frombuffer(self.at(d.index + k * size, size), kind).reshape(d.shape[1:]) if d.index != UNDEFINED else np.zeros(d.shape[1:], kind)
            return
        held, first = np.zeros((d.chunk[0], *d.shape[1:]), kind), start - start % d.chunk[0]
        for offset, place, size, mask in self.chunks(d, start, end):
            while first < offset[0]:
                yield from (f for k, f in enumerate(held, first) if start <= k < end)
                held, first = np.zeros_like(held), first + d.chunk[0]
            part = np.frombuffer(unpacked(self.at(place, size), d.filters, mask, kind.itemsize), kind).reshape(d.chunk)
            where = tuple(slice(o, min(o + c, s)) for o, c, s in zip(offset[1:], d.chunk[1:], d.shape[1:]))
            held[(slice(None), *where)] = part[(slice(None), *(slice(0, w.stop - w.start) for w in where))]
        while first < end:
            yield from (f for k, f in enumerate(held, first) if start <= k < end)
            held, first = np.zeros_like(held), first + d.chunk[0]


def unpacked(data: bytes, filters: tuple[int, ...], mask: int, size: int) -> bytes:
    for k in reversed(range(len(filters))):
        if mask >> k & 1:
            continue
        if filters[k] == CHECKSUM:
            data = data[:-4]
        elif filters[k] == DEFLATE:
            data = zlib.decompress(data)
        else:  # shuffle: all first bytes, then all second ones, and so on
            n = len(data) // size
            data = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]
    return data


class Writer:
    """One file with one dataset, chunked by frame; bytes are appended, the index and the headers follow them."""

    def __init__(self, f, name: str, dtype: str, height: int, width: int, level: int):
        self.f, self.name, self.dtype, self.shape, self.level = f, name, np.dtype(dtype), (height, width), level
        self.index: list[tuple[int, int]] = []  # address and size of each frame's chunk
        f.write(bytes(96))

    def append(self, packed: bytes) -> None:
        self.index.append((self.f.tell(), len(packed)))
        self.f.write(packed)

    def put(self, data: bytes) -> int:
        self.f.write(bytes(-self.f.tell() % 8))
        place = self.f.tell()
        self.f.write(data)
        return place

    def tree(self) -> int:
        """The chunk index, level by level from its leaves."""
        if not self.index:
            return UNDEFINED
        key = lambda size, frame: struct.pack("<II4Q", size, 0, frame, 0, 0, 0)
        row, level, end = [(k, size, place) for k, (place, size) in enumerate(self.index)], 0, len(self.index)
        while True:
            groups, above = [row[k : k + CHUNK_ENTRIES] for k in range(0, len(row), CHUNK_ENTRIES)], []
            full = 24 + 48 * CHUNK_ENTRIES + 40
            self.f.write(bytes(-self.f.tell() % 8))
            base = self.f.tell()
            for g, own in enumerate(groups):
                beside = [base + (g + s) * full if 0 <= g + s < len(groups) else UNDEFINED for s in (-1, 1)]
                after = groups[g + 1][0][0] if g + 1 < len(groups) else end
                node = struct.pack("<4sBBHQQ", b"TREE", 1, level, len(own), *beside) + b"".join(key(size, frame) + struct.pack("<Q", place) for frame, size, place in own) + key(0, after)
                above.append((own[0][0], own[0][1], base + g * full))
                self.f.write(node.ljust(full, b"\0"))
            if len(above) == 1:
                return above[0][2]
            row, level = above, level + 1

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(data) + -len(data) % 8, 0) + data + bytes(-len(data) % 8) for kind, data in messages)
        return self.put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def close(self) -> None:
        n, (h, w), size = len(self.index), self.shape, self.dtype.itemsize
        space = struct.pack("<BBB5x3Q", 1, 3, 0, n, h, w)
        signed = 8 if self.dtype.kind == "i" else 0
        type_ = struct.pack("<B3BIHH", 0x10, signed, 0, 0, size, 0, 8 * size)
        layout = struct.pack("<BBBQ4I", 3, 2, 4, self.tree(), 1, h, w, size)
        filters = struct.pack("<BB6xHHHH8sI4x", 1, 1, DEFLATE, 8, 1, 1, b"deflate\0", self.level)
        dataset = self.header([(SPACE, space), (TYPE, type_), (FILL, struct.pack("<BBBBI", 2, 3, 2, 1, 0)), (LAYOUT, layout), (FILTERS, filters)])
        name = bytes(8) + self.name.encode() + b"\0"
        name += bytes(-len(name) % 8)
        text = self.put(name)
        heap = self.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(name), 1, text))
        leaf = self.put(struct.pack("<4sBxHQQ24x", b"SNOD", 1, 1, 8, dataset).ljust(8 + 40 * LEAF_ENTRIES, b"\0"))
        tree = self.put(struct.pack("<4sBBHQQQQQ", b"TREE", 0, 0, 1, UNDEFINED, UNDEFINED, 0, leaf, 8).ljust(24 + 16 * GROUP_ENTRIES + 8, b"\0"))
        root = self.header([(TABLE, struct.pack("<QQ", tree, heap))])
        end = self.f.tell()
        self.f.seek(0)
        self.f.write(SIGNATURE + struct.pack("<8BHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, LEAF_ENTRIES // 2, GROUP_ENTRIES // 2, 0, 0, UNDEFINED, end, UNDEFINED) + struct.pack("<QQI4xQQ", 0, root, 1, tree, heap))


# --- Spark ---


@dataclass
class Frames(D.InputPartition):
    path: str
    video_id: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__(None)


class Scan(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.key, self.video = options["path"].split(","), options.get("key"), options.get("video_id")
        self.start, self.end = int(options.get("start") or 0), int(options["end"]) if options.get("end") else None
        self.step = int(options.get("framesPerTask") or FRAMES_PER_TASK)

    def partitions(self) -> list[Frames]:
        """Ranges of frames, from the datasets' headers; a range begins with a chunk."""
        out = []
        for path in self.paths:
            with opened(path) as f:
                d = Reader(f).dataset(self.key)
            video = self.video or os.path.basename(path).rpartition(".")[0]
            a, b = max(0, self.start), d.shape[0] if self.end is None else min(self.end, d.shape[0])
            deep = d.chunk[0] if d.chunk else 1
            step = -(-self.step // deep) * deep
            cuts = sorted({a, b, *range(-(-a // step) * step, b, step)}) if a < b else []
            out += [Frames(path, video, x, y) for x, y in zip(cuts, cuts[1:])]
        return out

    def read(self, partition: Frames | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty range has no partitions
            return
        with opened(partition.path) as f:
            file = Reader(f)
            d, held, size = file.dataset(self.key), [], 0
            for k, image in enumerate(file.frames(d, partition.start, partition.end), partition.start):
                image = image.astype(image.dtype.newbyteorder("="), copy=False)
                while image.ndim > 2:  # the first plane of further axes
                    image = image[0]
                held.append((partition.video_id, k, *image.shape, image.dtype.name, image.tobytes()))
                size += image.nbytes
                if size >= BATCH_BYTES:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)


class PushedScan(Scan):
    """A scan that takes comparisons of frame_id over from Spark."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            low, high = 0, None
            if getattr(f, "attribute", None) == ("frame_id",) and isinstance(getattr(f, "value", None), int):
                low = f.value + isinstance(f, D.GreaterThan) if isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual, D.EqualTo)) else 0
                high = f.value + (not isinstance(f, D.LessThan)) if isinstance(f, (D.LessThan, D.LessThanOrEqual, D.EqualTo)) else None
            if (low, high) == (0, None):
                yield f
            else:
                self.start, self.end = max(self.start, low), high if self.end is None else self.end if high is None else min(self.end, high)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = {"video_id": pa.string(), "frame_id": pa.int32(), "height": pa.int32(), "width": pa.int32(), "dtype": pa.string(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds.values())], list(kinds))


@dataclass
class Written(D.WriterCommitMessage):
    files: list[tuple[str, str]]


class Sink(D.DataSourceArrowWriter):
    """Rows (video_id, frame_id, height, width, dtype, packed), by recording in order of frames, to a file for each recording."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.key, self.level = options["path"], options.get("key", "video"), int(options.get("level", 4))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        files, now, shape, out = [], None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                out.f.close()

        for batch in iterator:
            for k in range(batch.num_rows):
                video, _, *own, packed = (c[k].as_py() for c in batch.columns)
                if video != now:
                    close()
                    now, shape = video, own
                    part = os.path.join(self.folder, f".{video}.{TaskContext.get().taskAttemptId()}")
                    files.append((part, os.path.join(self.folder, f"{video}.h5")))
                    out = Writer(open(part, "wb"), self.key, own[2], own[0], own[1], self.level)  # noqa: SIM115
                elif own != shape:
                    raise ValueError(f"frames of {video} differ in size or type: {shape}, {own}")
                out.append(packed)
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for part, name in m.files if m else []:
                os.replace(part, name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for part, _ in m.files if m else []:
                if os.path.exists(part):
                    os.remove(part)


class Hdf5(D.DataSource):
    """``spark.read.format("hdf5")``; options path (several by commas), key, video_id, start, end, framesPerTask, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> Scan:
        return (PushedScan if self.options.get("pushdown") == "true" else Scan)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Sink:
        return Sink(dict(self.options))


def read_hdf5(spark: SparkSession, path: str, key: str | None = None, video_id: str | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """The frames start..end - 1 of HDF5 files (several by commas): of the named dataset, or the first. A recording's id is its file's name without ``video_id``.

    The path is one that all machines reach. With ``spark.sql.python.filterPushdown.enabled`` comparisons of frame_id are planned, too.
    """
    spark.dataSource.register(Hdf5)
    options = {"path": path, "key": key, "video_id": video_id, "start": str(start), "end": None if end is None else str(end), "pushdown": str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()}
    return spark.read.format("hdf5").options(**{k: v for k, v in options.items() if v is not None}).load()


def write_hdf5(frames: DataFrame, folder: str, key: str = "video", level: int = 4) -> None:
    """Each recording of gray ``frames`` as ``<video_id>.h5`` in ``folder``, mounted on all machines: a dataset of its frames in order, one chunk each.

    Frames of a recording must be alike in size and type; where numbers are missing, the others move up. An existing file of the name is replaced.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                part = b.slice(at, 16)
                packed = [zlib.compress(d.as_py(), level) for d in part.column(5)]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(packed, pa.binary())], [*part.schema.names[:5], "packed"])

    frames.sparkSession.dataSource.register(Hdf5)
    packed = frames.select("video_id", F.col("frame_id").cast("int"), F.col("height").cast("int"), F.col("width").cast("int"), "dtype", "data").mapInArrow(pack, FRAMES.replace("data binary", "packed binary"))
    dealt = packed.repartition("video_id").sortWithinPartitions("video_id", "frame_id")
    dealt.write.format("hdf5").options(path=folder, key=key, level=str(level)).mode("append").save()
