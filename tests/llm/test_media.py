"""Audio columns: lossless payloads, resampling, filterbanks and segments against plain forms."""

import hashlib
import zlib

import numpy as np
import pytest

from pathloom.llm import media
from pathloom.llm.common import table


def test_payloads_read_back_from_the_stored_form(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = media.audio(table(spark, sf, "documents")).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert media.stored_samples(bytes(r["media"]))[1] == want
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-64:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        t = media.read_tensors(bytes(r["log_mel"]))
        assert t.column("log_mel").type.shape == [media.TENSOR, media.BANDS] and all(a < b for a, b in zip(t.column("start_s").to_pylist(), t.column("end_s").to_pylist()))


@pytest.mark.parametrize("up,down", [(1, 2), (2, 3), (3, 1), (1, 1)])
def test_polyphase_equals_zero_stuffing_and_filtering(up, down):
    x = np.random.default_rng(1).normal(size=500).astype(np.float32)
    phases, delay = media._phases(up, down)
    h = phases.T.reshape(-1)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, h)[delay:][: -(-len(x) * up // down) * down : down]
    got = media.resample(x, up, down)
    assert len(got) == -(-len(x) * up // down)
    assert np.allclose(got, np.pad(full, (0, len(got) - len(full))), atol=1e-4)


def test_a_tone_falls_in_its_band():
    rate = 8000
    t = np.arange(rate) / rate
    means = [media.log_mel(np.sin(2 * np.pi * f * t).astype(np.float32), rate)[0].mean(0).argmax() for f in (200, 800, 2000, 3500)]
    assert means == sorted(means) and len(set(means)) == 4


@pytest.mark.parametrize("n", [0, 1, 255, 256, 1000])
def test_log_mel_equals_sums_frame_by_frame(n):
    """Each frame's spectrum by its own sums of sines, each band by its own triangle."""
    x, rate = np.random.default_rng(n).normal(size=n).astype(np.float32), 8000
    got, energy = media.log_mel(x, rate)
    frames = max(1, -(-max(0, n - media.FRAME) // media.HOP) + 1)
    padded = np.concatenate([x, np.zeros(frames * media.HOP + media.FRAME)]).astype(float)
    k = np.arange(media.FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * k / media.FRAME)
    to_mel, of_mel = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [of_mel(to_mel(rate / 2) * b / (media.BANDS + 1)) for b in range(media.BANDS + 2)]
    assert got.shape == (frames, media.BANDS)
    for i in range(frames):
        own = padded[i * media.HOP : i * media.HOP + media.FRAME]
        assert energy[i] == pytest.approx((own**2).mean(), rel=1e-5, abs=1e-12)
        power = [abs((own * hann * np.exp(-2j * np.pi * b * k / media.FRAME)).sum()) ** 2 for b in range(media.FRAME // 2 + 1)]
        for b in range(media.BANDS):
            low, mid, high = edges[b : b + 3]
            total = sum(p * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))) for f, p in ((j * rate / media.FRAME, p) for j, p in enumerate(power)))
            assert got[i, b] == pytest.approx(np.log(total + 1e-6), abs=2e-3)


def test_the_query_returns_tensors_with_spans_and_segments(spark, sf):
    rows = media.op8(spark, sf).limit(20).collect()
    for r in rows:
        t = media.read_tensors(bytes(r["log_mel"]))
        assert t.column("log_mel").type == media.TENSOR_TYPE and t.num_rows >= 1
        assert t.column("start_s")[0].as_py() == 0 and all(s["start_s"] < s["end_s"] for s in r["segments"])
        values = np.array(t.column("log_mel").combine_chunks().storage.flatten()) * media.MEL_STEPS
        assert np.allclose(values, np.rint(values), atol=0.05)


def test_segments_equal_a_plain_state_machine():
    e = np.random.default_rng(2).gamma(2, 1, 400)
    mean, on, want, at = e.mean(), False, [], 0
    for i, v in enumerate([*e, -1]):
        if not on and v >= media.HIGH * mean:
            on, at = True, i
        elif on and v < media.LOW * mean:
            on = False
            want.append((at, i))
    assert media.segments(e) == want


def test_equal_texts_have_equal_features(spark):
    docs = spark.createDataFrame([(1, "abc def"), (2, "abc def"), (3, "abc deg")], "doc_id long, text string")
    f = {r["doc_id"]: r["feature"] for r in media.audio(docs, keep=False).collect()}
    assert f[1] == f[2] != f[3]


def test_files_that_are_not_audio_are_refused():
    with pytest.raises(ValueError):
        media.stored_samples(b"not a file at all")
