"""Audio media columns: texts' bytes as 8-bit samples, and features of them.

A payload is stored losslessly as a RIFF file of unsigned 8-bit samples. Features: polyphase resampling, overlapped
log-mel filterbanks in tensors of one fixed shape with their time spans, and segments by hysteresis on the frames' energy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import map_rows, table

RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, BANDS = 256, 128, 16
#: Frames of one tensor, and the frames by which tensors overlap.
TENSOR, OVERLAP = 64, 16
#: Energy, in units of a text's own mean level, at which a segment begins, and under which it ends.
HIGH, LOW = 1.15, 0.95
_ALIGN = 64
#: Steps of a log-mel value of 1.
MEL_STEPS = 16_384


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes, filled with zeros up to a positive multiple of 64; and how many they were."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(_ALIGN, -(-len(raw) // _ALIGN) * _ALIGN) - len(raw))


def store(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF WAVE file of one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def stored_samples(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of such a file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=4)
def _phases(up: int, down: int, half: int = 8) -> tuple[np.ndarray, int]:
    """A windowed-sinc low-pass filter of the lower of both rates, cut into ``up`` phases; and its delay."""
    n = 2 * half * max(up, down) + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(up, down)) * np.kaiser(n, 6.0) / max(up, down) * up
    width = -(-n // up)
    return np.pad(h, (0, width * up - n)).reshape(width, up).T.astype(np.float32), n // 2


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: only the outputs that are kept are computed, each from one phase of the filter."""
    phases, delay = _phases(up, down)
    width = phases.shape[1]
    n = -(-len(x) * up // down)
    at = np.arange(n) * down + delay
    padded = np.pad(x, (width, width + delay))
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, np.float32)
    for p in range(up):
        own = np.flatnonzero(at % up == p)
        if len(own):
            first, step = at[own[0]] // up + 1, down if up == 1 else None
            rows = windows[first : first + step * len(own) : step][: len(own)] if step else windows[at[own] // up + 1]
            out[own] = rows @ phases[p][::-1]
    return out


@lru_cache(maxsize=4)
def _mel(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, of the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up, down = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)
#: Frames of one step, so that long inputs need bounded memory.
_BLOCK = 4096


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values and mean energy of overlapped frames; the input is filled up with zeros to whole frames."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, max(0, (n - 1) * HOP + FRAME - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    out, energy = np.empty((n, BANDS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, _BLOCK):
        own = frames[a : a + _BLOCK]
        spectrum = np.fft.rfft(own * _HANN, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[a : a + _BLOCK] = np.log(power @ _mel(rate) + 1e-6)
        energy[a : a + _BLOCK] = np.einsum("ij,ij->i", own, own) / FRAME
    return out, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Runs of frames that begin at ``high`` times the mean energy and last until it falls under ``low`` times it."""
    mean = float(energy.mean()) or 1.0
    state = np.where(energy >= high * mean, 1, np.where(energy < low * mean, -1, 0))
    at = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate([[False], (at >= 0) & (state[at] == 1), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def features(media: bytes) -> dict:
    """Tensors (count, TENSOR, BANDS) of log-mel frames with the span of each in seconds, and segments in seconds.

    Values are rounded to 1 / MEL_STEPS, so that they don't depend on a machine's order of sums. The last tensor is filled with the
    log-mel value of silence.
    """
    rate, raw = stored_samples(media)
    x = resample((np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128)
    rate = rate * UP // DOWN
    mel, energy = log_mel(x, rate)
    mel = np.rint(mel * MEL_STEPS) / np.float32(MEL_STEPS)
    step = TENSOR - OVERLAP
    starts = np.arange(0, max(1, len(mel) - OVERLAP), step)
    full = np.pad(mel, ((0, int(starts[-1]) + TENSOR - len(mel)), (0, 0)), constant_values=np.rint(np.log(1e-6) * MEL_STEPS) / MEL_STEPS) if starts[-1] + TENSOR > len(mel) else mel
    tensors = np.lib.stride_tricks.sliding_window_view(full, TENSOR, axis=0)[starts].transpose(0, 2, 1)
    second = HOP / rate
    return {
        "tensors": np.ascontiguousarray(tensors),
        "spans": [(float(s * second), float(min(s + TENSOR, len(mel)) * second)) for s in starts],
        "segments": [(a * second, b * second) for a, b in segments(energy)],
        "mel": mel, "energy": energy,
    }


TENSOR_TYPE = pa.fixed_shape_tensor(pa.float32(), (TENSOR, BANDS))


def tensor_column(found: dict) -> bytes:
    """The tensors and their spans as an Arrow stream with a column of the fixed-shape tensor type."""
    t = found["tensors"]
    flat = pa.FixedSizeListArray.from_arrays(pa.array(t.reshape(-1), pa.float32()), TENSOR * BANDS)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR_TYPE, flat), pa.array([a for a, _ in found["spans"]]), pa.array([b for _, b in found["spans"]])], ["log_mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(column: bytes) -> pa.Table:
    return pa.ipc.open_stream(column).read_all()


def summary(found: dict) -> str:
    """Counts, quantised mean and spread of each band, and the segments' share and first bounds, in one line."""
    mel, energy, seg = found["mel"], found["energy"], found["segments"]
    show = lambda v: ".".join(str(int(x)) for x in np.rint(v * 8))
    length = sum(b - a for a, b in seg)
    return f"frames={len(mel)};tensors={len(found['tensors'])};mean={show(mel.mean(0, dtype=np.float64))};sd={show(mel.std(0, dtype=np.float64))};level={int(np.rint(energy.mean(dtype=np.float64) * 1e4))};segments={len(seg)};voiced_ms={int(np.rint(length * 1000))};first_ms={int(np.rint(seg[0][0] * 1000)) if seg else -1}"


SCHEMA = "doc_id long, media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, log_mel binary, segments array<struct<start_s:double,end_s:double>>"


def audio(docs: DataFrame, keep: bool = True, tensors_too: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> the stored media of each row, what is read back from it, and its features.

    With ``keep`` the stored form is a column, else null; with ``tensors_too`` the tensors with their spans are (an Arrow stream, see ``read_tensors``),
    else they are not built and null. A null text counts as empty: 64 zero bytes. Equal texts give equal values. Repeated rows are
    kept, a null doc_id is passed through, an empty table gives an empty result, other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, raw = payload(text)
            media = store(raw)
            back = stored_samples(media)[1]
            found = features(media)
            tensors = tensor_column(found) if tensors_too else None
            rows.append((doc, media if keep else None, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), summary(found) + f";mel_crc32={zlib.crc32(np.rint(found['mel'] * MEL_STEPS).astype('<i4').tobytes())}", tensors, [{"start_s": a, "end_s": b} for a, b in found["segments"]]))
            if len(rows) == 64:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio(table(spark, sf_dir, "documents"), keep=False).drop("media")
