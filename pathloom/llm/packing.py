"""Packing of tokenised documents into sequences of bounded length, by bin completion branch-and-bound.

Pieces are dealt by a hash of their row into groups of about GROUP rows, whatever their lengths or ids, so no group is
hot and each is packed by itself with bounded memory. A group whose search reaches its lower bound costs at most one
sequence more than packing all pieces at once would.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import map_rows, shared_table, table
from pathloom.llm.tokens import text_ids, word_ids

CAPACITY = 2048
GROUP, GROUPS_PER_TASK = 8192, 64
#: Steps of the search in one group, as a multiple of its rows: the one bound on the effort (None: search to the end).
EFFORT = 60
#: What a descent's choice of pieces by pairs, and the comparison with one listed filling, count as.
PAIR_STEPS, COVER_STEPS = 8, 0.3
#: Fillings that are listed and put in order of waste at a time.
SLICE = 24


class Stock:
    """How many pieces of each length are left."""

    def __init__(self, lengths: np.ndarray):
        kinds, counts = np.unique(lengths, return_counts=True)
        self.kinds: list[int] = kinds.tolist()
        self.left: dict[int, int] = dict(zip(self.kinds, counts.tolist()))

    def take(self, x: int) -> None:
        self.left[x] -= 1
        if not self.left[x]:
            del self.kinds[bisect_right(self.kinds, x) - 1]

    def put(self, x: int) -> None:
        if not self.left[x]:
            self.kinds.insert(bisect_right(self.kinds, x), x)
        self.left[x] += 1


class Meter:
    """Steps that a search may still take; None: as many as it needs."""

    def __init__(self, steps: int | None):
        self.left = float("inf") if steps is None else steps

    def step(self, n: float = 1) -> bool:
        self.left -= n
        return self.left >= 0


def covers(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether filling ``a`` dominates ``b``: the pieces of b fit into places of the sizes of a's pieces, largest first."""
    room = list(a)
    for x in b:
        fit = min((r for r in room if r >= x), default=None)
        if fit is None:
            return False
        room.remove(fit)
        room.append(fit - x)
    return True


def fillings(stock: Stock, room: int, waste: int, meter: Meter) -> Iterator[tuple[int, tuple[int, ...]]]:
    """All maximal fillings of ``room`` from the stock that leave at most ``waste``: (left over, pieces), large pieces first.

    Nothing that still fits may be left in the stock, so a kind that is passed over bounds what may be left over, and a branch whose
    smaller pieces all together leave more ends. Depth is the number of distinct lengths in a bin.
    """
    kinds, left = stock.kinds, stock.left
    below = [0]
    for x in kinds[: bisect_right(kinds, room)]:
        below.append(below[-1] + x * left[x])

    def go(room: int, upto: int, most: int, own: tuple[int, ...]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Fillings by kinds of index under ``upto``, leaving ``most`` at most."""
        at = min(upto, bisect_right(kinds, room))
        if room - below[at] > most or not meter.step():
            return
        if not at:
            yield room, own
            return
        for i in range(at - 1, -1, -1):
            x = kinds[i]
            for n in range(min(left[x], room // x), 0, -1):
                # copies that stay behind may not fit any more
                yield from go(room - n * x, i, min(most, x - 1) if n < left[x] else most, own + (x,) * n)
            most = min(most, x - 1)  # all of this kind stay behind
            if room - below[i] > most or meter.left < 0:
                return

    return go(room, len(below) - 1, min(waste, room), ())


def undominated(stock: Stock, room: int, waste: int, meter: Meter) -> Iterator[tuple[int, ...]]:
    """The fillings, SLICE by SLICE, of each slice those with the least waste first, without those that one of the last ones
    dominates (only of these: a dominated filling that stays costs work, not the best result)."""
    found, listed = fillings(stock, room, waste, meter), deque(maxlen=4 * SLICE)
    while own := list(islice(found, SLICE)):
        for _, f in sorted(own, key=lambda f: (f[0], len(f[1]), f[1])):
            meter.step(COVER_STEPS * len(listed))
            if not any(covers(g, f) for g in listed):
                listed.append(f)
                yield f
    return


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over lengths: the first incumbent."""
    open_: list[tuple[int, int]] = []  # (room, bin), sorted
    bins: list[list[int]] = []
    for x in np.sort(lengths)[::-1].tolist():
        at = bisect_right(open_, (x, -1))
        if at < len(open_):
            room, b = open_.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(x)
        if room > x:
            open_.insert(bisect_right(open_, (room - x, b)), (room - x, b))
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound L2."""
    x = np.sort(lengths)
    total = np.concatenate([[0], np.cumsum(x)])
    best = -(-int(total[-1]) // capacity)
    for k in np.unique(x[x <= capacity // 2]).tolist() or [0]:
        big, half, small = np.searchsorted(x, capacity - k, "right"), np.searchsorted(x, capacity // 2, "right"), np.searchsorted(x, k)
        room = (big - half) * capacity - (total[big] - total[half])
        best = max(best, len(x) - half + max(0, -(-int(total[half] - total[small] - room) // capacity)))
    return int(best)


def least_waste(kinds: np.ndarray, left: np.ndarray, room: int, meter: Meter, most: int = 3) -> tuple[int, tuple[int, ...]]:
    """Up to ``most`` (three) pieces that fill ``room`` best, as (left over, pieces): the fewest of those, large ones first. The third is tried at 12 kinds only."""
    meter.step(PAIR_STEPS)
    n = int(np.searchsorted(kinds, room, "right"))
    best = (room - int(kinds[n - 1]), (int(kinds[n - 1]),))
    if most == 1 or not best[0]:
        return best
    other = np.searchsorted(kinds, room - kinds[:n], "right") - 1
    other = np.where((other == np.arange(n)) & (left[:n] < 2), other - 1, other)
    waste = np.where(other >= 0, room - kinds[:n] - kinds[other], room)
    i = n - 1 - int(waste[::-1].argmin())
    if waste[i] < best[0]:
        best = (int(waste[i]), (int(kinds[i]), int(kinds[other[i]])))
    for i in np.unique(np.linspace(0, n - 1, 12).astype(int))[::-1].tolist() if most > 2 and best[0] else []:
        x, some = int(kinds[i]), left - (np.arange(len(left)) == i) > 0
        if some.any() and kinds[some][0] <= room - x:
            waste_, own = least_waste(kinds[some], (left - (np.arange(len(left)) == i))[some], room - x, meter, 2)
            best = min(best, (waste_, (x, *own)), key=lambda f: f[0])
    return best


def descend(lengths: np.ndarray, capacity: int, above: int, meter: Meter) -> list[list[int]] | None:
    """One branch followed to its end: around a piece longer than ``above`` the filling of fewest pieces, around a shorter one that of least
    waste. None where the steps run out."""
    kinds, left = np.unique(lengths, return_counts=True)
    bins = []
    while len(kinds):
        if not meter.step():
            return None
        own, room = [int(kinds[-1])], capacity - int(kinds[-1])
        left[-1] -= 1
        kinds, left = kinds[left > 0], left[left > 0]
        while len(kinds) and kinds[0] <= room:
            room, more = least_waste(kinds, left, room, meter, 1 if own[0] > above else 3)
            np.subtract.at(left, np.searchsorted(kinds, more), 1)
            kinds, left = kinds[left > 0], left[left > 0]
            own += more
        bins.append(own)
    return bins


def turning_lengths(lengths: np.ndarray, capacity: int) -> list[int]:
    """Where descents turn from few pieces to least waste: for each k up to 8 the longest piece of the largest set of small pieces that fill
    bins by k of them on average, then the capacity."""
    x = np.sort(lengths)
    mean = np.cumsum(x) / np.arange(1, len(x) + 1)
    ends = [int(np.searchsorted(mean, capacity / k, "right")) for k in range(2, 9)]
    return list(dict.fromkeys([int(x[n - 1]) for n in ends if 0 < n < len(x)] + [capacity]))


def complete(lengths: np.ndarray, capacity: int = CAPACITY, effort: int | None = EFFORT) -> list[list[int]]:
    """Bins of lengths: depth-first branch-and-bound over fillings around the largest piece left.

    The first incumbent is that of best fit; a few branches are followed to their ends first, as they give better ones where sizes
    are such that pieces of middle length should be paired and small ones kept for fuller bins. A branch ends when its waste exceeds what
    one bin less than the incumbent's allows. The search stops at the lower bound, when no branch is left (the incumbent is then a best
    one), or after ``effort`` steps per piece (None: never).
    """
    best = best_fit(lengths, capacity)
    bound, total = least_bins(lengths, capacity), int(lengths.sum())
    stock, meter = Stock(lengths), Meter(None if effort is None else effort * len(lengths) + 10_000)
    ahead, turned, at = turning_lengths(lengths, capacity), 0, 0
    while ahead and len(best) > bound and meter.left > 0:
        above = ahead.pop(0)
        own = descend(lengths, capacity, above, meter)
        if own and len(own) < len(best):
            best, turned, at = own, 0, above
        if not ahead and at and turned < 4:  # a little to both sides of the best turn
            off, turned = max(1, at >> 8) << turned // 2, turned + 1
            ahead.append(at + off if turned % 2 else at - off)
    path: list[tuple[int, Iterator[tuple[int, ...]], tuple[int, ...] | None]] = []  # largest piece, its fillings, the one in use
    waste = 0
    while len(best) > bound:
        spare = (len(best) - 1) * capacity - total - waste
        if stock.kinds and spare >= 0:
            largest = stock.kinds[-1]
            stock.take(largest)
            path.append((largest, undominated(stock, capacity - largest, spare, meter), None))
        elif not stock.kinds and len(path) < len(best):
            best = [[x, *own] for x, _, own in path]
        while path:  # the next filling of the deepest bin that has one
            largest, options, now = path.pop()
            if now is not None:
                waste -= capacity - largest - sum(now)
                for x in now:
                    stock.put(x)
            pick = next(options, None) if meter.left >= 0 else None
            if pick is not None:
                for x in pick:
                    stock.take(x)
                waste += capacity - largest - sum(pick)
                path.append((largest, options, pick))
                break
            stock.put(largest)
        else:
            break
    return best


def pack_group(pdf: pd.DataFrame, capacity: int = CAPACITY, effort: int | None = EFFORT) -> pd.DataFrame:
    """Adds ``bin`` and ``offset`` to the rows of one group."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    length = pdf["length"].to_numpy(np.int64)
    waiting: dict[int, list[int]] = {}
    for i in range(len(length) - 1, -1, -1):
        waiting.setdefault(int(length[i]), []).append(i)
    bin_, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for b, own in enumerate(complete(length, capacity, effort)):
        at = 0
        for x in own:
            i = waiting[x].pop()
            bin_[i], offset[i] = b, at
            at += x
    return pdf.assign(bin=bin_, offset=offset)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each piece of at most ``capacity`` ids, with the crc32 of its ids.

    A null or empty text is the end id alone. Only texts of more than ``capacity`` ids are cut.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, rows = word_ids(vocabulary), []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = text_ids(text, words) + end
            step = 4 * capacity
            rows += [(doc, k, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group: int = GROUP, effort: int | None = EFFORT) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Every row of the input is packed: repeated rows and rows with a null doc_id as well; an empty table gives an
    empty result. Other columns are ignored. A task takes whole groups one by one; their number follows the session's
    shuffle partitions, and on large inputs GROUPS_PER_TASK, not the bytes, as the search and not the reading takes the time.
    """
    cut, _ = shared_table(pieces(docs, vocabulary, capacity=capacity), "pieces")
    groups = max(1, -(-cut.count() // group))
    tasks = min(groups, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS_PER_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column("own_group").to_numpy()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(edges, edges[1:]):
                if held and a < b and held[0].column("own_group")[0].as_py() != own[a]:
                    yield from packed(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from packed(held)

    def packed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        pdf = pack_group(pa.Table.from_batches(held).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), capacity, effort)
        return pa.Table.from_pandas(pdf, held[0].schema.append(pa.field("bin", pa.int64())).append(pa.field("offset", pa.int64())), preserve_index=False).to_batches()

    dealt = cut.withColumn("own_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    dealt = dealt.repartitionById(tasks, (F.col("own_group") % tasks).cast("int")).sortWithinPartitions("own_group")
    placed = dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, own_group long, bin long, offset long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own_group") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
