"""Convolutional text classifier for toxicity: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of two rows of one hashed table: of the word and of its first bytes. The network
is trained in numpy on a bounded sample of labelled rows; thresholds are calibrated by language, which is told from the
text's own function words, and folded into the score so that 0.7 is every language's threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bytescan import Scan, U
from pathloom.llm.common import chunks, is_held_out, labelled_sample, map_rows, table

#: Bound on the labelled rows a model is fitted on.
SAMPLE = 12_000
THRESHOLD = 0.7
_BITS, _DIM, _WIDTHS, _FILTERS, _STEM = 17, 12, (1, 2, 3), 12, 6

#: Function words that tell a text's language.
FUNCTION_WORDS = {
    "en": "the of and to is that it for on was be with as by this are",
    "de": "der die und das von mit ist im sich auf für nicht ein eine den zu",
    "fr": "le les des et une que qui dans pour sur pas du elle avec au par",
    "es": "el los las y que se del por con una para como su lo al no",
}

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = False


def lower_latin(scan_data: np.ndarray) -> np.ndarray:
    """Lower case of the two-byte capitals from À to Þ."""
    out = scan_data.copy()
    at = np.flatnonzero(scan_data[:-1] == 0xC3) + 1
    own = out[at]
    out[at] = np.where((own >= 0x80) & (own <= 0x9E) & (own != 0x97), own + 0x20, own)
    return out


class Words:
    """Hashed ids of a batch's words: of the word and of its stem, and each word's text."""

    def __init__(self, texts: list[str | None]):
        scan = Scan(texts, lower=True, space=_NOT_WORD)
        scan.data = lower_latin(scan.data)
        a, b = scan.word_start, scan.word_end
        self.whole = (scan.words() >> U(64 - _BITS)).astype(np.int64)
        self.stem = (scan.hashes(a, np.minimum(b, a + _STEM)) * U(0x9E3779B97F4A7C15) >> U(64 - _BITS)).astype(np.int64)
        self.of, self.docs = scan.word_doc, len(scan)

    def split(self) -> list[tuple[np.ndarray, np.ndarray]]:
        at = np.searchsorted(self.of, np.arange(self.docs + 1))
        return [(self.whole[a:b].astype(np.int32), self.stem[a:b].astype(np.int32)) for a, b in zip(at[:-1], at[1:])]

    @classmethod
    def joined(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Words:
        out = cls.__new__(cls)
        out.whole, out.stem = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        out.of, out.docs = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]), len(parts)
        return out


def _language_table() -> np.ndarray:
    out = np.zeros((1 << _BITS, len(FUNCTION_WORDS)), np.float32)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        out[Words([words]).whole, k] += 1
    return out


def languages(words: Words, known: np.ndarray) -> np.ndarray:
    """Index of the language of each text, by its function words; the first where there are none."""
    votes = np.stack([np.bincount(words.of, weights=known[words.whole, k], minlength=words.docs) for k in range(known.shape[1])], 1)
    return votes.argmax(1)


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (1 << _BITS, _DIM)).astype(np.float32)
        self.filters = [rng.normal(0, (2 / (w * _DIM)) ** 0.5, (w, _DIM, _FILTERS)).astype(np.float32) for w in _WIDTHS]
        self.bias = np.zeros(len(_WIDTHS) * _FILTERS, np.float32)
        self.top = rng.normal(0, 0.3, len(_WIDTHS) * _FILTERS).astype(np.float32)
        self.top_bias = np.float32(-2)
        self.shift = np.zeros(len(FUNCTION_WORDS))
        self.known = _language_table()

    def maps(self, x: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        """Each width's responses at each word; windows stop at the end of a text."""
        out = []
        for w, f in zip(_WIDTHS, self.filters):
            y = x @ f[0]
            for k in range(1, w):
                inside = (of[k:] == of[:-k])[:, None]
                y[:-k] += (x[k:] @ f[k]) * inside
            out.append(y)
        return out

    def pooled(self, words: Words, where: bool = False):
        """Max over each text's words, at least 0, by filter; with ``where``, also the word that holds it (or -1)."""
        x = self.table[words.whole] + self.table[words.stem]
        first = np.flatnonzero(np.concatenate([[True], words.of[1:] != words.of[:-1]])) if len(words.of) else np.zeros(0, int)
        out = np.zeros((words.docs, len(self.bias)), np.float32)
        at = np.full(out.shape, -1)
        if len(first):
            y = np.concatenate(self.maps(x, words.of), 1) + self.bias
            top = np.maximum.reduceat(y, first, axis=0)
            own = words.of[first]
            out[own] = np.maximum(top, 0)
            if where:
                last = np.append(first[1:], len(y))
                for k, (a, b, d) in enumerate(zip(first.tolist(), last.tolist(), own.tolist())):
                    at[d] = np.where(top[k] > 0, a + y[a:b].argmax(0), -1)
        return (out, at, x) if where else out

    def raw(self, words: Words) -> np.ndarray:
        return self.pooled(words) @ self.top + self.top_bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = Words(texts)
        z = np.clip(self.raw(words) + self.shift[languages(words, self.known)], -30, 30)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


class _Step:
    """AdaGrad on dense arrays or on rows of one."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.sum = value, rate, np.full(value.shape, 1e-6, np.float32)

    def apply(self, grad: np.ndarray, rows=None) -> None:
        if rows is None:
            self.sum += grad * grad
            self.value -= self.rate * grad / np.sqrt(self.sum)
        else:
            self.sum[rows] += grad * grad
            self.value[rows] -= self.rate * grad / np.sqrt(self.sum[rows])


def fit(sample: list[tuple[str, int]], epochs: int = 8, batch: int = 32, seed: int = 7) -> Net:
    """Trains on four fifths of the sample; each language's threshold is set on the other fifth.

    A sample without both labels gives a network whose scores are all near the share of label 1.
    """
    net, rng = Net(seed), np.random.default_rng(seed)
    texts, y = [t for t, _ in sample], np.array([v for _, v in sample], np.float32)
    if len(set(y.tolist())) < 2:
        net.top[:] = 0
        net.top_bias = np.float32(4 if len(y) and y[0] == 1 else -4)
        return net
    part = np.arange(len(y)) % 5
    train, held = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    weight = np.where(y == 1, 0.5 / max(y[train].mean(), 0.02), 0.5 / max(1 - y[train].mean(), 0.02)).astype(np.float32)
    table_, filters = _Step(net.table, 0.08), [_Step(f, 0.03) for f in net.filters]
    bias, top = _Step(net.bias, 0.03), _Step(net.top, 0.05)
    steps = max(epochs, -(-1500 // max(1, len(train) // batch)))  # small samples are passed more often
    scanned = [part for a, b in chunks(texts) for part in Words(texts[a:b]).split()]
    for epoch in range(min(steps, 40)):
        order = rng.permutation(train)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            words = Words.joined([scanned[i] for i in rows])
            pooled, where, x = net.pooled(words, where=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.top + net.top_bias, -30, 30)))
            dz = (p - y[rows]) * weight[rows] / len(rows)
            dpool = dz[:, None] * net.top[None, :] * (where >= 0)
            top.apply(pooled.T @ dz + 1e-4 * net.top)
            net.top_bias -= np.float32(0.05 * dz.sum())
            bias.apply(dpool.sum(0))
            d, c = np.nonzero(where >= 0)
            pos, g = where[d, c], dpool[d, c]
            dx_rows, dx = [], []
            for k, w in enumerate(_WIDTHS):
                mine = (c // _FILTERS) == k
                pk, gk, fk, of = pos[mine], g[mine], c[mine] % _FILTERS, words.of
                grad = np.zeros_like(net.filters[k])
                for j in range(w):
                    ok = pk + j < len(of)
                    ok[ok] = of[pk[ok] + j] == of[pk[ok]]
                    pj = pk[ok] + j
                    np.add.at(grad[j].T, fk[ok], x[pj] * gk[ok][:, None])
                    dx_rows.append(pj)
                    dx.append(net.filters[k][j][:, fk[ok]].T * gk[ok][:, None])
                filters[k].apply(grad)
            pj, dx = np.concatenate(dx_rows), np.concatenate(dx)
            both = np.concatenate([words.whole[pj], words.stem[pj]])
            rows_, inverse = np.unique(both, return_inverse=True)
            total = np.zeros((len(rows_), _DIM), np.float32)
            np.add.at(total, inverse, np.concatenate([dx, dx]))
            table_.apply(total, rows_)
    calibrate(net, [texts[i] for i in held], y[held])
    return net


def calibrate(net: Net, texts: list[str], y: np.ndarray) -> None:
    """Each language's shift, so that its best threshold on held-back rows becomes THRESHOLD.

    The threshold is the middle of the widest run of thresholds with the fewest errors; a language with few
    rows of either label takes the threshold of all rows together.
    """
    z, lang = [], []
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        z.append(net.raw(words))
        lang.append(languages(words, net.known))
    z, lang = np.concatenate(z), np.concatenate(lang)
    goal = np.log(THRESHOLD / (1 - THRESHOLD))

    def best(own: np.ndarray) -> float:
        order = np.argsort(z[own])
        s, t = z[own][order], y[own][order]
        errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
        edge = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
        gap = np.concatenate([[0], np.diff(s), [0]])
        least = np.flatnonzero(errors == errors.min())
        return float(edge[least[gap[least].argmax()]])

    overall = best(np.arange(len(y))) if 0 < y.sum() < len(y) else 0.0
    for k in range(len(net.shift)):
        own = np.flatnonzero(lang == k)
        enough = min(y[own].sum(), (1 - y[own]).sum()) >= 20
        net.shift[k] = goal - (best(own) if enough else overall)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, score)``, one row for each input row.

    Only the text is looked at. Null, empty and wordless texts get the score of a text in which no filter responds.
    Other columns are ignored; repeated rows get equal scores; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # fixed size: the hashed table and the filters

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for a, b in chunks(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(shared.value.scores(texts[a:b]))], ["doc_id", "score"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", SAMPLE))
    return score(docs, net).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
