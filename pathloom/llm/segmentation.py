"""N-best segmentation into the pieces of a SentencePiece vocabulary, and decoding.

The forward Viterbi score of each position is the exact cost of the best way to it, so a search from the end back
to the start that orders partial segmentations by own score plus that score (A*) pops whole segmentations best first.

No piece of a vocabulary joins letters and other characters, but for the space mark at its start (checked on loading; where
one does, a text is one unit). A text's lattice so falls into independent units; the best of each are kept in a bounded
cache, and a search over their gaps gives the text's own N best.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import map_rows, table

N_BEST = 4
MARK = "▁"
#: Characters of the longest unit whose segmentations are kept.
LONGEST = 64
#: Units: space marks and then a run of letters or of other characters; single digits and line feeds; marks alone.
UNITS = re.compile("▁*[A-Za-z\xc0-\u1fff\u2c00-\U0010ffff]+|▁*[!-/:-@\\[-`{-~\x00-\x09\x0b-\x20\x7f-\xbf\u2000-\u2580\u2582-\u2bff]+|▁*[0-9]|\n|▁+")
_INFINITE = float("inf")

#: A segmentation: score and ids.
Best = list[tuple[float, tuple[int, ...]]]


class Pieces:
    """A vocabulary: scores, byte fallback, and the units of its lattice. A character that no piece holds is spelt in
    bytes, each at 10 below the lowest score."""

    def __init__(self, path: str, most: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[int, float]] = {}
        self.bytes: list[int] = [0] * 256
        self.text: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.text.append(bytes([value]))
            else:
                self.text.append(b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace(MARK, " ").encode())
                if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                    self.score[piece] = (i, sp.get_score(i))
        self.byte_score = min(s for _, s in self.score.values() if s > -1e8) - 10
        self.tree: dict[str, list] = {}  # character -> [next characters, (ids, score) of the piece that ends here or None]
        for piece, (i, s) in self.score.items():
            below = self.tree
            for c in piece:
                node = below.setdefault(c, [{}, None])
                below = node[0]
            node[1] = ((i,), s)
        self.units = UNITS if all(UNITS.fullmatch(p) for p in self.score) else re.compile(".+", re.DOTALL)
        self.known: dict[str, tuple[float, float, bytes]] = {}
        self.old: dict[str, tuple[float, float, bytes]] = {}  # what was known before; units in use return from it
        self.lists: dict[tuple[str, int], Best] = {}
        self.most = most

    def ways(self, unit: str) -> list[list[tuple[int, tuple[tuple[int, ...], float]]]]:
        """For each end position, the (start, (ids, score)) of the pieces that end there."""
        out: list[list[tuple[int, tuple[tuple[int, ...], float]]]] = [[] for _ in range(len(unit) + 1)]
        i = 0
        for c in unit:
            node, j = self.tree.get(c), i + 1
            if node is None or node[1] is None:
                raw = c.encode("utf-8", "surrogatepass")
                out[j].append((i, (tuple([self.bytes[b] for b in raw]), self.byte_score * len(raw))))
            else:
                out[j].append((i, node[1]))
            if node is not None:
                for d in unit[j:]:
                    node = node[0].get(d)
                    if node is None:
                        break
                    j += 1
                    if node[1] is not None:
                        out[j].append((i, node[1]))
            i += 1
        return out

    @staticmethod
    def forward(ways: list) -> list[float]:
        """The Viterbi score of each position."""
        out = [0.0]
        for own in ways[1:]:
            out.append(max([out[i] + p[1] for i, p in own]) if len(own) > 1 else out[own[0][0]] + own[0][1][1])
        return out

    def n_best(self, unit: str, n: int) -> Best:
        """The n best segmentations of a unit, best first: A* from the end, with the forward scores as heuristics."""
        ways = self.ways(unit)
        forward = self.forward(ways)
        found: Best = []
        push, pop, serial = heapq.heappush, heapq.heappop, 0
        heap: list = [(-forward[-1], 0, len(unit), 0.0, None)]
        while heap and len(found) < n:
            _, _, at, own, tail = pop(heap)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                found.append((own, tuple(ids)))
                continue
            for i, (piece, s) in reversed(ways[at]):
                serial -= 1  # of equals, the last pushed goes first
                push(heap, (-(forward[i] + own + s), serial, i, own + s, (piece, tail)))
        return found

    def several(self, unit: str, n: int) -> Best:
        """``n_best``, kept: the units in which texts differ first are few."""
        out = self.lists.get((unit, n))
        if out is None:
            out = self.n_best(unit, n)
            if len(unit) <= LONGEST:
                if len(self.lists) >= self.most // 4:
                    self.lists.clear()
                self.lists[unit, n] = out
        return out

    def best(self, unit: str) -> tuple[float, float, bytes]:
        """Score of the best, gap to the second best, and the best's ids as 32-bit values."""
        out = self.known.get(unit) or self.old.get(unit)
        if out is None:
            two = self.n_best(unit, 2)
            out = (two[0][0], two[0][0] - two[1][0] if len(two) > 1 else _INFINITE, array("I", two[0][1]).tobytes())
        if len(unit) <= LONGEST:
            if len(self.known) >= self.most:
                self.known, self.old = {}, self.known
            self.known[unit] = out
        return out

    def split(self, text: str) -> list[str]:
        """The units of a text without a space mark of its own; its spaces become marks, and one is set before it."""
        return self.units.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The n best segmentations (score, ids as 32-bit values) of a whole text; one empty one of an empty text."""
        parts = str(text or "").split(MARK)
        units: list[str | None] = list(self.split(parts[0]))
        for more in parts[1:]:  # a space mark in the text itself: spelt in bytes
            units += [None] + (self.units.findall(more.replace(" ", MARK)) if more else [])
        if len(parts) > 1 and not parts[0]:
            units = [MARK] + units
        spelt = (3 * self.byte_score, _INFINITE, array("I", [self.bytes[b] for b in MARK.encode()]).tobytes())
        entries = [spelt if u is None else self.known.get(u) or self.best(u) for u in units]
        total = sum([e[0] for e in entries])
        ids = [e[2] for e in entries]
        out = [(total, b"".join(ids))]
        if n == 1:
            return out
        # the n best differ from the best in the n - 1 units with the least gaps at most
        gaps = [e[1] for e in entries]
        least = sorted(gaps)[: n - 1]
        loose = sorted([k for k, g in enumerate(gaps) if g <= least[-1]], key=gaps.__getitem__)[: n - 1] if least else []
        loose = [k for k in loose if gaps[k] < _INFINITE]
        lists = [self.several(units[k] or "", n) for k in loose]
        heap = [(0.0, (0,) * len(lists))]
        seen = {heap[0][1]}
        while heap and len(out) < n:
            gap, pick = heapq.heappop(heap)
            if any(pick):
                own = list(ids)
                for k, own_list, p in zip(loose, lists, pick):
                    own[k] = array("I", own_list[p][1]).tobytes()
                out.append((total - gap, b"".join(own)))
            for d in range(len(lists)):
                step = pick[:d] + (pick[d] + 1,) + pick[d + 1 :]
                if step[d] < len(lists[d]) and step not in seen:
                    seen.add(step)
                    heapq.heappush(heap, (sum(x[0][0] - x[p][0] for x, p in zip(lists, step)), step))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation."""
        out = b"".join([self.text[i] for i in array("I", ids)]).decode("utf-8", "surrogatepass")
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


SCHEMA = "doc_id long, n_pieces long, best_score double, nbest_scores string, ids_sha256 string, nbest_sha256 string, decoded_ok boolean"


def segment(docs: DataFrame, vocabulary: str, n: int = N_BEST) -> DataFrame:
    """``docs(doc_id, text)`` -> figures of each whole text's ``n`` best segmentations, and whether the best decodes to the text.

    ids_sha256 is of the best's ids as little-endian 32-bit values, nbest_sha256 of all segmentations' ids, each followed
    by four bytes 255. Equal scores stand in the search's own order. A null text counts as empty: no pieces, score 0, one
    segmentation. Repeated rows get equal results, a null doc_id is passed through, an empty table gives an empty
    result, other columns are ignored. ``segment_ids`` returns the ids themselves.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, rows = pieces(vocabulary), []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            best = model.encode(text, n)
            whole = hashlib.sha256(b"".join(ids + b"\xff\xff\xff\xff" for _, ids in best)).hexdigest()
            rows.append((doc, len(best[0][1]) // 4, best[0][0], ",".join(f"{s:g}" if abs(s) < 1e5 else f"{s:.0f}" for s, _ in best), hashlib.sha256(best[0][1]).hexdigest(), whole, model.decode(best[0][1]) == (text or "")))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def segment_ids(docs: DataFrame, vocabulary: str, n: int = N_BEST) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, nbest array<struct<score, ids>>)``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        found = [[{"score": s, "ids": array("I", ids).tolist()} for s, ids in model.encode(t, n)] for t in batch.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, kind)], ["doc_id", "nbest"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, nbest array<struct<score:double,ids:array<int>>>")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(table(spark, sf_dir, "documents"), default_vocabulary())
