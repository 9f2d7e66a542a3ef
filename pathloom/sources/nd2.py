"""ND2 recordings as a Spark data source: the chunk map at a file's end is read once, and only the frames asked for are planned.

The layout is that of version 3 files: chunks of name and data, a map of their places, and attributes and loops as nested binary variants. A frame is an index of the
outermost loop; of further loops and of the components the first is taken. Sequences may be plain or deflated; lossy ones are refused.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from pathloom.schemas import FRAMES
from pathloom.sources.hdf5 import BATCH_BYTES, FRAMES_PER_TASK, _rows, opened

# fixed values of the format
CHUNK, MAP = 0x0ABECEDA, b"ND2 CHUNK MAP SIGNATURE 0000001!"
NUMBERS = {1: "<?", 2: "<i", 3: "<I", 4: "<q", 5: "<Q", 6: "<d", 7: "<Q"}
TEXT, BYTES, LEVEL, PACKED = 8, 9, 11, 76
DEFLATED, LOSSY = 0, 1


def variant(data: bytes, count: int = 1 << 30) -> dict:
    """The named values of a binary variant; levels are dicts."""
    out, at = {}, 0
    while at + 2 <= len(data) and count:
        kind, size, begin = data[at], data[at + 1], at
        if kind == PACKED:
            return out | variant(zlib.decompress(data[at + 12 :]))
        name = data[at + 2 : at + 2 + 2 * size].decode("utf-16-le").rstrip("\0")
        at, count = at + 2 + 2 * size, count - 1
        if kind in NUMBERS:
            out[name] = struct.unpack_from(NUMBERS[kind], data, at)[0]
            at += struct.calcsize(NUMBERS[kind])
        elif kind == TEXT:
            end = at
            while data[end : end + 2] not in (b"\0\0", b""):
                end += 2
            out[name], at = data[at:end].decode("utf-16-le"), end + 2
        elif kind == BYTES:
            n = struct.unpack_from("<Q", data, at)[0]
            out[name], at = data[at + 8 : at + 8 + n], at + 8 + n
        elif kind == LEVEL:
            items, length = struct.unpack_from("<IQ", data, at)
            out[name], at = variant(data[at + 12 : begin + length], items), begin + length + 8 * items
        else:
            break
    return out


class Recording:
    """The chunks, attributes and loops of one file."""

    def __init__(self, f: pa.NativeFile):
        self.f = f
        size = f.size()
        if size < 56 or struct.unpack("<I", self.at(0, 4))[0] != CHUNK or self.at(size - 40, 32) != MAP:
            raise ValueError("not an ND2 file of version 3")
        data, at, self.places = self.chunk(struct.unpack("<Q", self.at(size - 8, 8))[0]), 0, {}
        while (end := data.find(b"!", at) + 1) and data[at:end] != MAP:
            self.places[data[at:end]] = struct.unpack_from("<Q", data, end)[0]
            at = end + 16
        own = next(iter(variant(self.chunk(self.places[b"ImageAttributesLV!"])).values()))
        self.height, self.width, self.parts, self.bits = own["uiHeight"], own["uiWidth"], own.get("uiComp", 1), own.get("uiBpcInMemory", 16)
        self.stride, self.compression = own.get("uiWidthBytes") or self.width * self.parts * self.bits // 8, own.get("eCompression", 2)
        if self.compression == LOSSY:
            raise ValueError("lossy ND2 sequences are not supported")
        self.loops = self.counts(own.get("uiSequenceCount", 1))

    def at(self, place: int, size: int) -> bytes:
        self.f.seek(place)
        return self.f.read(size)

    def chunk(self, place: int) -> bytes:
        magic, name, size = struct.unpack("<IIQ", self.at(place, 16))
        if magic != CHUNK:
            raise ValueError("the chunk map names a place without a chunk")
        return self.at(place + 16 + name, size)

    def counts(self, sequences: int) -> list[int]:
        """The number of steps of each loop, the outermost first; one loop over all sequences where none is described."""
        out, place = [], self.places.get(b"ImageMetadataLV!")
        level = next(iter(variant(self.chunk(place)).values()), {}) if place is not None else {}
        while level:
            pars = level.get("uLoopPars") or {}
            n = pars.get("uiCount") or next((v["uiCount"] for v in pars.values() if isinstance(v, dict) and v.get("uiCount")), None)
            out += [n] if n else []
            level = next(iter((level.get("ppNextLevelEx") or {}).values()), {})
        return out if out and int(np.prod(out)) == sequences else [sequences]

    def places_of(self, start: int, end: int) -> list[int]:
        """Where the sequences of frames start..end - 1 lie."""
        inner = int(np.prod(self.loops[1:], dtype=np.int64))
        return [self.places[b"ImageDataSeq|%d!" % (k * inner)] for k in range(start, end)]

    def image(self, place: int) -> np.ndarray:
        """The first component of a sequence."""
        data = self.chunk(place)[8:]  # behind its time stamp
        data = zlib.decompress(data) if self.compression == DEFLATED else data
        rows = np.frombuffer(data, np.uint8, self.height * self.stride).reshape(self.height, self.stride)
        pixels = rows[:, : self.width * self.parts * self.bits // 8].copy().view(f"<u{self.bits // 8}")
        return np.ascontiguousarray(pixels.reshape(self.height, self.width, self.parts)[:, :, 0])


@dataclass
class Places(D.InputPartition):
    path: str
    video_id: str
    start: int
    places: list[int]

    def __post_init__(self):
        super().__init__(None)


class Scan(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.video = options["path"].split(","), options.get("video_id")
        self.start, self.end = int(options.get("start") or 0), int(options["end"]) if options.get("end") else None
        self.step = int(options.get("framesPerTask") or FRAMES_PER_TASK)

    def partitions(self) -> list[Places]:
        out = []
        for path in self.paths:
            with opened(path) as f:
                own = Recording(f)
                a, b = max(0, self.start), own.loops[0] if self.end is None else min(self.end, own.loops[0])
                if b <= a:
                    raise ValueError(f"empty frame range {a}..{b}")
                video = self.video or os.path.basename(path).rpartition(".")[0]
                out += [Places(path, video, k, own.places_of(k, min(k + self.step, b))) for k in range(a, b, self.step)]
        return out

    def read(self, partition: Places) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            own, held, size = Recording(f), [], 0
            for k, place in enumerate(partition.places, partition.start):
                image = own.image(place)
                held.append((partition.video_id, k, *image.shape, image.dtype.name, image.tobytes()))
                size += image.nbytes
                if size >= BATCH_BYTES:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)


class Nd2(D.DataSource):
    """``spark.read.format("nd2")``; options path (several by commas), video_id, start, end, framesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "nd2"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> Scan:
        return Scan(dict(self.options))


def read_nd2(spark: SparkSession, path: str, video_id: str | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """The frames start..end - 1 of ND2 recordings (several by commas), first component and plane; ValueError where the range is empty. A recording's id is
    its file's name without ``video_id``; the path is one that all machines reach."""
    spark.dataSource.register(Nd2)
    options = {"path": path, "video_id": video_id, "start": str(start), "end": None if end is None else str(end)}
    return spark.read.format("nd2").options(**{k: v for k, v in options.items() if v is not None}).load()
