"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad, judged by its own features and its neighbours'; forward-backward marginals, weighted by the
lines' lengths, add up to the document's quality. Labels exist for documents only: a first pass gives every line its
document's label, later passes give the lines of bad documents the labels that the model finds for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bytescan import Scan, U, mix, shingle_hashes
from pathloom.llm.common import chunks, is_held_out, labelled_sample, map_rows, map_texts, table

#: Bound on the labelled rows a model is fitted on.
SAMPLE = 6000
THRESHOLD = 0.5


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _END = _mask(b"#*$%&<>~^=_{}\\"), _mask(bytes(range(65, 91))), _mask(b"0123456789"), _mask(b".!?:;")
_LETTER = _mask(bytes([*range(65, 91), *range(97, 123), *range(0x80, 0x100)]))
_OWN, _NEAR = 13, (2, 3, 4, 6, 7, 8, 9)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, length and text's index of each line, blank lines left out."""
    scan = Scan(texts)
    start, end, of = scan.lines()
    first, last = np.searchsorted(scan.word_start, start), np.searchsorted(scan.word_start, end)
    full = last > first
    start, end, of, first, last = (x[full] for x in (start, end, of, first, last))
    data, n = scan.data, last - first
    run = lambda mask: (lambda s: s[end] - s[start])(np.concatenate([[0], np.cumsum(mask)]))
    words = scan.words()
    over = lambda mask: (lambda s: s[np.minimum(last, len(s) - 1)] - s[np.minimum(first, len(s) - 1)])(np.concatenate([[0], np.cumsum(mask)]))
    same = np.zeros(len(words), bool)
    if len(words):
        same[1:] = (words[1:] == words[:-1]) & (scan.word_doc[1:] == scan.word_doc[:-1])
    window = shingle_hashes(words, 3)
    window = mix(window ^ mix(scan.word_doc[: len(window)].astype(U)))
    order = np.argsort(window)
    twin = window[order][1:] == window[order][:-1]
    again = np.zeros(len(words), bool)
    again[order[1:][twin]] = again[order[:-1][twin]] = True
    line = mix(scan.hashes(start, end) ^ mix(of.astype(U)))
    _, where, count = np.unique(line, return_inverse=True, return_counts=True)
    letters = run(_LETTER[data])
    x = np.zeros((len(start), _OWN), np.float32)
    size = end - start
    x[:, 0] = 1
    x[:, 1] = np.log1p(n) / 5
    x[:, 2] = np.minimum(run(_SYMBOL[data]) / n, 3)
    x[:, 3] = np.minimum(run(data == ord("|")) / n, 1)
    x[:, 4] = run(_UPPER[data]) / np.maximum(letters, 1)
    x[:, 5] = run(_DIGIT[data]) / size
    x[:, 6] = np.minimum(run(data == ord("!")) / n, 2)
    x[:, 7] = over(same) / n
    x[:, 8] = over(again) / n
    x[:, 9] = count[where] > 1
    x[:, 10] = _END[data[scan.word_end[last - 1] - 1]] if len(last) else 0
    x[:, 11] = np.minimum((scan.word_end - scan.word_start).cumsum()[last - 1] - np.concatenate([[0], (scan.word_end - scan.word_start).cumsum()])[first], 10**6) / n / 10 if len(last) else 0
    x[:, 12] = n <= 3
    near = x[:, _NEAR]
    before, after = np.zeros_like(near), np.zeros_like(near)
    inside = (of[1:] == of[:-1])[:, None] if len(of) else np.zeros((0, 1), bool)
    before[1:], after[:-1] = near[:-1] * inside, near[1:] * inside
    ends = np.ones((len(of), 2), np.float32)
    ends[1:, :1] -= inside
    ends[:-1, 1:] -= inside
    return np.concatenate([x, before, after, ends], 1), size, of


class Chain:
    """weights of the features for the good state, scores of steps between states and of the first line's state."""

    def __init__(self):
        self.w = np.zeros(_OWN + 2 * len(_NEAR) + 2)
        self.step, self.start = np.zeros((2, 2)), np.zeros(2)
        self.scale, self.shift = 6.0, -3.0  # of the document's quality to its log-odds

    def marginals(self, x: np.ndarray, of: np.ndarray, weight: np.ndarray | None = None):
        """P(good) of each line; lines are in order, texts one after another. With weights, the weighted expected counts too."""
        n = len(of)
        u = np.zeros((n, 2))
        u[:, 1] = np.clip(x @ self.w, -40, 40)
        if not n:
            return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if weight is not None else np.zeros(0)
        head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        size = np.diff(np.append(head, n))
        order = np.argsort(-size, kind="stable")
        head, size = head[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts with a t-th line
        a, b = np.empty((n, 2)), np.zeros((n, 2))
        two = lambda v: np.logaddexp(v[..., 0], v[..., 1])
        a[head] = self.start + u[head]
        for t in range(1, size[0]):
            at = head[: live[t]] + t
            a[at] = two(a[at - 1][:, None, :] + self.step.T) + u[at]
        for t in range(size[0] - 2, -1, -1):
            at = head[: live[t + 1]] + t
            b[at] = two((u[at + 1] + b[at + 1])[:, None, :] + self.step)
        z = two(a + b)
        good = np.exp(a[:, 1] + b[:, 1] - z)
        if weight is None:
            return good
        step = np.zeros((2, 2))
        at = np.setdiff1d(np.arange(n), head)
        for i in (0, 1):
            for j in (0, 1):
                step[i, j] = (weight[at] * np.exp(a[at - 1, i] + self.step[i, j] + u[at, j] + b[at, j] - z[at])).sum()
        return good, step, np.array([(weight[head] * (1 - good[head])).sum(), (weight[head] * good[head]).sum()])

    def quality(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted share of good lines; 0 for texts without a word."""
        parts = [line_features(texts[a:b]) for a, b in chunks(texts)]
        shift = [a for a, _ in chunks(texts)]
        if not parts:
            return np.zeros(0)
        x, size, of = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + s for p, s in zip(parts, shift)])
        good = self.marginals(x, of)
        total = np.bincount(of, weights=size, minlength=len(texts))
        return np.bincount(of, weights=size * good, minlength=len(texts)) / np.maximum(total, 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.quality(texts) + self.shift, -30, 30)))


def fit(sample: list[tuple[str, int]], rounds: int = 3, steps: int = 150) -> Chain:
    """Conditional likelihood by Adam, line labels renewed between rounds. A sample without both labels leaves all weights zero."""
    net, texts, label = Chain(), [t for t, _ in sample], np.array([v for _, v in sample])
    if len(set(label.tolist())) < 2:
        net.scale, net.shift = 0.0, 3.0 if len(label) and label[0] == 1 else -3.0
        return net
    parts = [(a, line_features(texts[a:b])) for a, b in chunks(texts)]
    x, of = np.concatenate([p[0] for _, p in parts]).astype(np.float64), np.concatenate([p[2] + a for a, p in parts])
    y = label[of].astype(float)
    share = label.mean()
    lines = np.bincount(of, minlength=len(texts))[of]
    weight = np.where(label[of] == 1, 0.5 / share, 0.5 / (1 - share)) / np.sqrt(lines)  # both kinds of documents count alike, long ones not by every line
    head = np.concatenate([[True], of[1:] != of[:-1]])
    for k in range(rounds):
        m, v = ([np.zeros_like(p) for p in (net.w, net.step, net.start)] for _ in range(2))
        gold_step = np.zeros((2, 2))
        np.add.at(gold_step, (y[:-1][~head[1:]].astype(int), y[1:][~head[1:]].astype(int)), weight[1:][~head[1:]])
        gold_start = np.array([(weight * (y == v))[head].sum() for v in (0, 1)])
        for t in range(1, steps + 1):
            good, step, start = net.marginals(x, of, weight)
            g = [x.T @ (weight * (good - y)) / weight.sum() + 1e-4 * net.w, (step - gold_step) / weight.sum() + 1e-4 * net.step, (start - gold_start) / weight.sum() + 1e-4 * net.start]
            for i, (p, gi) in enumerate(zip((net.w, net.step, net.start), g)):
                m[i] += 0.1 * (gi - m[i])
                v[i] += 0.01 * (gi * gi - v[i])
                p -= 0.1 * (1 - 0.9 * t / steps) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
        if k < rounds - 1:
            good = net.marginals(x, of)
            worst = np.full(len(texts), 2.0)
            np.minimum.at(worst, of, good)
            y = np.where(label[of] == 1, 1.0, ((good > 0.5) & (good > worst[of])).astype(float))
    q = net.quality(texts)
    a, b = 6.0, -3.0
    for _ in range(50):  # Newton steps of the one-feature logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * q + b, -30, 30)))
        r, s = label - p, p * (1 - p) + 1e-6
        h = np.array([[(s * q * q).sum() + 1e-2, (s * q).sum()], [(s * q).sum(), s.sum() + 1e-2]])
        da, db = np.linalg.solve(h, [(r * q).sum() - 1e-2 * a, r.sum() - 1e-2 * b])
        a, b = a + float(np.clip(da, -5, 5)), b + float(np.clip(db, -5, 5))
    net.scale, net.shift = a, b
    return net


def score(docs: DataFrame, net: Chain) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, score)``, one row for each input row.

    Only the text is looked at. Null, empty and blank texts have no good line: their quality is 0. Other columns are
    ignored; repeated rows get equal scores; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: a few dozen weights

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(shared.value.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def keep_good(docs: DataFrame, net: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns. Null and empty texts are scored like texts without lines;
    ids aren't read; repeated rows stay or go alike; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return map_texts(docs, lambda texts: (None, [bool(s >= threshold) for s in shared.value.scores(texts)]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", SAMPLE))
    return score(docs, net).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
