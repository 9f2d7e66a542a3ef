"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network reads overlapping windows; the scores of characters that several windows hold are averaged with weights
that fall towards a window's ends, and one Viterbi search over each run of windows decides globally. A span of any kind must
hold a digit, an @ or a written-out at-sign (``plausible``), so only windows with one of them, and those that overlap these, are
run. Long runs are decoded in pieces whose max-plus products are chained, so the result is that of one search over the
whole run, and memory is bounded by READY characters and not by the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import map_rows, map_texts, table, texts_of

#: Kinds in the order of listing; the fixed patterns cover the first four.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Texts from which the training windows' surroundings are cut, at most.
SAMPLE = 300
#: Characters of each of them that are used.
SAMPLE_CHARS = 4000
WINDOW, STRIDE = 96, 64
#: Characters of a piece that is decoded by itself, and characters whose emissions are held before they are decoded.
PIECE, READY = 1024, 100_000

_DIGIT, _PART = re.compile("[0-9]"), re.compile("[0-9]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
TRIGGER = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from the @ signs on: a local part can't hold one."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        floor = max(at + 1, domain.end() if domain else 0)
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within a kind; failing matches go."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# --- the tagger ---

_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_PAD, _LETTER, _OTHER, _CHARS = 0, 1, 2, 131


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(code < 128, code + 3, np.where(code < 0x250, _LETTER, _OTHER)).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    def __init__(self, dim: int = 12, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, (1 / s[0]) ** 0.5, s).astype(np.float32)
        self.hidden = hidden
        self.p = {"chars": rng.normal(0, 0.5, (_CHARS, dim)).astype(np.float32), "out": draw(2 * hidden, _TAGS), "out_b": np.zeros(_TAGS, np.float32), "step": np.zeros((_TAGS, _TAGS), np.float32), "start": np.zeros(_TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"{d}_x": draw(dim, 4 * hidden), f"{d}_h": draw(hidden, 4 * hidden), f"{d}_b": np.zeros(4 * hidden, np.float32)}
            self.p[f"{d}_b"][hidden : 2 * hidden] = 1
        self.forbid = np.zeros((_TAGS, _TAGS), np.float32)
        for to in range(2, _TAGS, 2):  # inside follows begin or inside of its kind only
            self.forbid[:, to] = -1e4
            self.forbid[[to - 1, to], to] = 0

    def run(self, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; ids: (length, batch)."""
        p, h_ = self.p, self.hidden
        gates = (p["chars"] @ p[f"{d}_x"] + p[f"{d}_b"])[ids]
        h, c = (np.zeros((ids.shape[1], h_), np.float32) for _ in range(2))
        out = np.empty((*ids.shape, h_), np.float32)
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            z = gates[t] + h @ p[f"{d}_h"]
            s, g = _sigmoid(z[:, : 3 * h_]), np.tanh(z[:, 3 * h_ :])
            before, hb = c, h
            c = s[:, h_ : 2 * h_] * c + s[:, :h_] * g
            tc = np.tanh(c)
            h = s[:, 2 * h_ :] * tc
            out[t] = h
            if keep is not None:
                keep.append((t, s, g, before, hb, tc))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(ids, "f"), self.run(ids, "b")], 2)
        return both @ self.p["out"] + self.p["out_b"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the CRF and its gradients, by forward-backward over the tags."""
        p, n, (length, batch) = self.p, self.hidden, ids.shape
        keep: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run(ids, d, keep[d]) for d in "fb"], 2)
        e = states @ p["out"] + p["out_b"]
        step = p["step"] + self.forbid
        lse = lambda x, axis: (m := x.max(axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = p["start"] + e[0]
        for t in range(1, length):
            alpha[t] = lse(alpha[t - 1][:, :, None] + step, 1) + e[t]
        for t in range(length - 2, -1, -1):
            beta[t] = lse(step + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        own = np.arange(batch)
        gold = p["start"][tags[0]] + e[0, own, tags[0]]
        for t in range(1, length):
            gold = gold + step[tags[t - 1], tags[t]] + e[t, own, tags[t]]
        de = np.exp(alpha + beta - z[:, None])
        dstep = np.zeros_like(step)
        for t in range(1, length):
            dstep += np.exp(alpha[t - 1][:, :, None] + step + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(dstep, (tags[t - 1], tags[t]), -1)
        one = np.eye(_TAGS, dtype=np.float32)[tags]
        de = (de - one) / batch
        g = {"step": dstep / batch, "start": de[0].sum(0), "out": states.reshape(-1, 2 * n).T @ de.reshape(-1, _TAGS), "out_b": de.sum((0, 1))}
        dstates = de @ p["out"].T
        g["chars"] = np.zeros_like(p["chars"])
        for k, d in enumerate("fb"):
            dh, dc = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
            dz_all, dwh = np.empty((length, batch, 4 * n), np.float32), np.zeros_like(p[f"{d}_h"])
            for t, s, gg, before, hb, tc in reversed(keep[d]):
                dh = dh + dstates[t, :, k * n : (k + 1) * n]
                i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                dz_all[t] = dz
                dwh += hb.T @ dz
                dh, dc = dz @ p[f"{d}_h"].T, dc * f
            flat = np.zeros((_CHARS, 4 * n), np.float32)
            np.add.at(flat, ids.ravel(), dz_all.reshape(-1, 4 * n))
            g[f"{d}_h"], g[f"{d}_b"], g[f"{d}_x"] = dwh, flat.sum(0), p["chars"].T @ flat
            g["chars"] += flat @ p[f"{d}_x"].T
        return float((z - gold).mean()), g

    def transfers(self, pieces: list[np.ndarray]) -> np.ndarray:
        """The best score from each tag before a piece (the last row: from a run's start) to each tag at its end."""
        step, out = self.steps()[:-1], np.empty((len(pieces), _TAGS + 1, _TAGS), np.float32)
        for own, e, size in _side_by_side(pieces, most=200_000):
            score = np.broadcast_to(self.steps(), (len(own), _TAGS + 1, _TAGS)) + e[0][:, None]
            for t in range(1, len(e)):
                now = (score[:, :, :, None] + step).max(2) + e[t][:, None]
                score = np.where((t < size)[:, None, None], now, score)
            out[own] = score
        return out

    def steps(self) -> np.ndarray:
        """Scores of the steps between tags; the last row is the step into a run's first tag."""
        return np.concatenate([self.p["step"] + self.forbid, [self.p["start"] + self.forbid[0]]])

    def viterbi(self, pieces: list[np.ndarray], before: list[int] | None = None, last: list[int] | None = None) -> list[np.ndarray]:
        """The best tags of each piece, coming from the tag ``before`` (default: a run's start) and ending at ``last`` (-1: at any)."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(pieces)
        step, before, last = self.steps(), np.array(before or [_TAGS] * len(pieces)), np.array(last or [-1] * len(pieces))
        for own, e, size in _side_by_side(pieces, most=400_000):
            back = np.zeros(e.shape, np.int8)
            score = step[before[own]] + e[0]
            for t in range(1, len(e)):
                way = score[:, :, None] + step[:-1]
                back[t] = way.argmax(1)
                score = np.where((t < size)[:, None], np.take_along_axis(way, back[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t], score)
            tag = np.where(last[own] < 0, score.argmax(1), last[own])
            tags, rows = np.zeros(e.shape[:2], np.int8), np.arange(len(own))
            for t in range(len(e) - 1, -1, -1):
                tags[t] = tag
                tag = np.where((t < size) & (t > 0), back[t, rows, tag], tag)
            for k, i in enumerate(own.tolist()):
                out[i] = tags[: len(pieces[i]), k]
        return out

    def decode(self, runs: list[Run]) -> list[np.ndarray]:
        """The best tags of each run, as far as they are certain; an open run keeps the rest of its emissions.

        Runs are cut into pieces of at most PIECE characters. All pieces' transfers are found side by side, a chain over them
        gives the tags at their ends, and then all pieces are decoded side by side. In an open run, what comes after the last
        piece's end on which the ways to all tags agree is kept for the next call.
        """
        cut = [[r.e[a : a + PIECE] for a in range(0, len(r.e), PIECE)] for r in runs]
        long = [i for i, r in enumerate(runs) if r.open or r.entry is not None or len(cut[i]) > 1]
        moved = iter(self.transfers([e for i in long for e in cut[i]]))
        ends: list[list[int]] = [[-1] for _ in runs]
        froms = [[_TAGS] for _ in runs]
        for i in long:
            r = runs[i]
            score = np.append(np.full(_TAGS, -np.inf), 0.0) if r.entry is None else r.entry
            backs, scores = [], [score]
            for m in [next(moved) for _ in cut[i]]:
                way = scores[-1][:, None] + m
                backs.append(way.argmax(0))
                top = way.max(0)
                scores.append(np.append(top - top.max(), -np.inf))
            tag = np.arange(_TAGS) if r.open else np.array([scores[-1].argmax()])
            at = []  # the tags at the pieces' ends, on the ways to each tag at the last one's
            for back in reversed(backs):
                at.append(tag)
                tag = back[tag]
            at.append(tag)
            at = at[::-1]
            sure = [k for k, tags in enumerate(at) if (tags == tags[0]).all()]
            n = sure[-1] if sure else 0
            ends[i], froms[i] = [int(t[0]) for t in at[1 : n + 1]], [int(t[0]) for t in at[:n]]
            if r.open:
                r.e, r.entry = r.e[n * PIECE :], scores[n]
                cut[i] = cut[i][:n]
        tags = iter(self.viterbi([e for c in cut for e in c], [t for f in froms for t in f], [t for f in ends for t in f]))
        return [np.concatenate([*(next(tags) for _ in c), np.zeros(0, np.int8)]) for c in cut]

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """The network's spans of each text. Windows stream through; besides the texts and their tags, at most READY characters'
        emissions are held, and those of the one run whose end isn't reached, as far as its tags are open."""
        found: list[list[Span]] = [[] for _ in texts]
        weight = (0.02 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) / WINDOW).astype(np.float32)
        done: list[Run] = []
        now: Run | None = None

        def settle(runs: list[Run]) -> None:
            for r, tags in zip(runs, self.decode(runs)):
                r.tags.append(tags)
                if not r.open:
                    for kind, a, b in tagged(np.concatenate(r.tags)):
                        if plausible(kind, texts[r.text][r.start + a : r.start + b]):
                            found[r.text].append((kind, r.start + a, r.start + b))

        for part in batched(windows(texts), 512):
            ids = np.zeros((WINDOW, len(part)), np.int32)
            for k, (d, s) in enumerate(part):
                own = char_ids(texts[d][s : s + WINDOW])
                ids[: len(own), k] = own
            e = self.emissions(ids)
            for k, (d, s) in enumerate(part):
                n = min(WINDOW, len(texts[d]) - s)
                if now is None or now.text != d or s >= now.reach:
                    if now is not None:
                        now.close()
                        done.append(now)
                    now = Run(d, s)
                now.add(s, e[:n, k] * weight[:n, None], weight[:n])
            if sum(len(r.e) for r in done) + now.ready() > READY:
                now.flush()
                settle([*done, now])
                done = []
        if now is not None:
            now.close()
            settle([*done, now])
        return found


class Run:
    """Emissions of a stretch of overlapping windows, summed with weights. What no later window reaches is averaged into ``e``."""

    def __init__(self, text: int, start: int):
        self.text, self.start, self.reach, self.open = text, start, start, True
        self.e, self.entry, self.tags = np.zeros((0, _TAGS), np.float32), None, []
        self.sums: list[np.ndarray] = []  # averaged, not yet in e
        self.tail, self.weight = np.zeros((0, _TAGS), np.float32), np.zeros(0, np.float32)

    def add(self, at: int, e: np.ndarray, weight: np.ndarray) -> None:
        """A window that starts at ``at``, not before any that was added."""
        fixed = at - (self.reach - len(self.tail))
        if fixed:
            self.sums.append(self.tail[:fixed] / self.weight[:fixed, None])
        total, own = np.zeros_like(e), np.zeros_like(weight)  # never shorter than what is held: both end at the text's end at most
        held = len(self.tail) - fixed
        total[:held], own[:held] = self.tail[fixed:], self.weight[fixed:]
        total += e
        own += weight
        self.tail, self.weight, self.reach = total, own, at + len(own)

    def ready(self) -> int:
        return len(self.e) + sum(map(len, self.sums))

    def flush(self) -> None:
        self.e, self.sums = np.concatenate([self.e, *self.sums]), []

    def close(self) -> None:
        self.sums.append(self.tail / self.weight[:, None])
        self.flush()
        self.open = False


def windows(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(text, start) of each window that overlaps one with a trigger, in order."""
    for d, text in enumerate(texts):
        last, most = -1, max(len(text) - 1, 0) // STRIDE
        for m in TRIGGER.finditer(text):
            for w in range(max(last + 1, (m.start() - WINDOW) // STRIDE, 0), min(m.end() // STRIDE + 1, most) + 1):
                yield d, w * STRIDE
                last = w


def tagged(tags: np.ndarray) -> Iterator[Span]:
    """(kind, start, end) of each span that begins in a row of tags."""
    begins = np.flatnonzero((tags > 0) & (tags % 2 == 1))
    follows = np.append((tags[1:] > 0) & (tags[1:] % 2 == 0), False)  # an inside tag can only go on with the span before it
    stops = np.flatnonzero(~follows)
    for a, b in zip(begins.tolist(), stops[np.searchsorted(stops, begins)].tolist()):
        yield int(tags[a]) // 2, a, b + 1


def _side_by_side(pieces: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of like length, padded: (their places, emissions by character and piece, lengths); at most ``most`` tags' scores each."""
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    while order:
        n = 1
        while n < len(order) and n < 4096 and len(pieces[order[n]]) * (n + 1) * _TAGS <= most:
            n += 1
        own, order = order[:n], order[n:]
        e = np.zeros((len(pieces[own[-1]]), n, _TAGS), np.float32)
        for k, i in enumerate(own):
            e[: len(pieces[i]), k] = pieces[i]
        yield np.array(own), e, np.array([len(pieces[i]) for i in own])


def plausible(kind: int, piece: str) -> bool:
    """What a span of each kind must hold, whatever the network says."""
    digits = "".join(_DIGIT.findall(piece))
    if kind == 0:
        return len(piece) >= 6 and ("@" in piece or "at" in piece) and bool(TRIGGER.search(piece))
    if kind == 1:
        parts = piece.split(".")
        return len(parts) == 4 and all(_PART.fullmatch(p) and int(p[:4]) <= 255 for p in parts) or piece.count(":") >= 4 and len(digits) >= 4
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 7 <= len(digits) <= 15
    return len(digits) >= 2 and len(piece) >= 10


# --- training windows ---


def _entity(rng: np.random.Generator, kind: int) -> tuple[str, str, str]:
    """Text before, the entity, and text after it."""
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))
    if kind == 0:
        name = pick(word(2, 9), word(2, 9).capitalize(), word(1, 7) + pick(".", "_", "-", "+") + word(2, 8), word(2, 7) + "." + num(2), word(2, 6) + num(2))
        host, end = pick(word(3, 9), word(3, 7) + num(1), word(2, 6) + "-" + word(2, 6)), pick("com", "org", "net", "de", "fr", "es", "co.uk", "example.com")
        return pick(("", f"{name}@{host}.{end}", ""), ("", f"{name}@{host}.{end}", ""), ("", f"{name} {pick('(at)', '[at]')} {host} {pick('(dot)', '[dot]')} {end}", ""), ("<", f"{name}@{host}.{end}", ">"), ("mailto:", f"{name}@{host}.{end}", ""))
    if kind == 1:
        v4 = ".".join(str(x) for x in rng.integers(0, 256, 4))
        v6 = ":".join(f"{x:x}" for x in rng.integers(4096, 65536, 8))
        return "", pick(v4, v4, v4, v6), pick("", "", ":8080")
    if kind == 2:
        n = num(pick(16, 16, 16, 15, 19))
        sep = pick("", "", " ", "-", ".")
        return "", sep.join(n[i : i + 4] for i in range(0, len(n), 4)) if sep else n, ""
    if kind == 3:
        a, b, c = num(3), num(3), num(4)
        return "", pick(f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(2)} {c} {num(4)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)}{num(9)}", f"+{num(2)} ({num(1)}){num(2)} {num(6)}", f"00{num(2)} {num(3)} {num(7)}"), ""
    key = pick("token", "api_key", "secret", "password", "apikey", "auth_token", "access_key", "Token", "key")
    hexed = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, pick(24, 32, 32, 36, 40)))
    mixed = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"[i] for i in rng.integers(0, 64, rng.integers(16, 40)))
    quote = pick('"', '"', "'", "")
    return f"{key}{pick(' = ', '=', ': ', ' ')}{quote}", pick(hexed, hexed, mixed), quote


def _decoy(rng: np.random.Generator) -> str:
    """What holds digits or @ and is no personal data."""
    pick = lambda *x: x[rng.integers(len(x))]
    n = lambda a, b: int(rng.integers(a, b))
    return pick(f"Version {n(1, 9)}.{n(0, 9)}", f"version {n(1, 4)}.", f"{n(1900, 2030)}", f"{n(1, 29)}.{n(1, 13)}.{n(1990, 2030)}", f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}", f"{n(0, 100)}%", f"{n(1, 999)},{n(100, 999)}", f"{n(0, 99)}.{n(0, 99)}", f"CC BY-NC {n(1, 5)}.0", f"({n(1, 30)})", f"[{n(1, 200)}]", f"{n(1, 24)}:{n(10, 60)}", f"@{n(1, 9)}", "@ home", f"${n(1, 5000)}", f"{n(1, 9)}th", f"v{n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"# {n(1, 50)}", f"{n(1, 10**7)}")


def training_windows(surroundings: list[str], count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows with labelled spans: entities and decoys set into pieces of prose. Returns ids and tags, (length, count)."""
    rng = np.random.default_rng(seed)
    prose = [t for t in surroundings if t and len(t) > 40] or ["the words of a plain text that go on and on, as in any text. And so on, to its end. "]
    ids, tags = np.zeros((WINDOW, count), np.int32), np.zeros((WINDOW, count), np.int64)
    for k in range(count):
        text, tag = "", []
        while len(text) < 2 * WINDOW:
            source = prose[rng.integers(len(prose))]
            at = int(rng.integers(0, max(1, len(source) - 60)))
            plain = re.sub("[0-9@=]", "e", source[at : at + int(rng.integers(5, 60))])
            if rng.random() < 0.6:
                kind = int(rng.integers(len(KINDS)))
                before, what, after = _entity(rng, kind)
                own = [2 * kind + 1] + [2 * kind + 2] * (len(what) - 1)
            else:
                before, what, after = "", _decoy(rng), ""
                own = [0] * len(what)
            before = (" " if rng.random() < 0.95 else str(rng.choice(list(",;:\n(")))) + before
            after += str(rng.choice([" ", " ", " ", ". ", ", ", "\n", "*** ", "&&& "]))
            text += plain + before + what + after
            tag += [0] * (len(plain) + len(before)) + own + [0] * len(after)
        s = int(rng.integers(0, len(text) - WINDOW))
        n = WINDOW if rng.random() < 0.9 else int(rng.integers(10, WINDOW))  # the end of a text
        ids[:n, k], tags[:n, k] = char_ids(text[s : s + n]), tag[s : s + n]
    return ids, tags


def fit(surroundings: list[str], windows: int = 3200, epochs: int = 7, batch: int = 64, seed: int = 5) -> Tagger:
    """A tagger trained by Adam on ``windows`` labelled windows."""
    ids, tags = training_windows(surroundings, windows)
    net, rng = Tagger(), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    t = 0
    steps = epochs * -(-windows // batch)
    for _ in range(epochs):
        order = rng.permutation(windows)
        for a in range(0, windows, batch):
            rows = order[a : a + batch]
            _, g = net.gradients(ids[:, rows], tags[:, rows])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            t += 1
            rate = 0.012 * min(1, t / 20) * (1 - 0.95 * t / steps)
            for k, x in g.items():
                x = x * np.float32(min(1, 5 / (norm + 1e-9)))
                first[k] += 0.1 * (x - first[k])
                second[k] += 0.01 * (x * x - second[k])
                net.p[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


# --- Spark ---


def join_spans(base: list[Span], more: list[Span]) -> list[Span]:
    """All base spans, and the network's spans that touch none of them, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    out = list(base)
    for kind, a, b in more:
        at = bisect_left(starts, b)
        if not at or reach[at - 1] <= a:
            out.append((kind, a, b))
    return sorted(out)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the kind of the first span there."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def surroundings(docs: DataFrame, bound: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[str]:
    """Pieces of at most ``bound`` texts, picked by a hash of their ids; the prose that training windows are cut from.

    Of each text, ``chars`` characters in a row from a place given by the hash are taken, or all of a shorter one. Ids are picked
    first, so a task sends the driver ids only; then the picked texts are read. Only training sees these pieces.
    """
    picked = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    place = (F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1).cast("int")
    return [r["text"] for r in texts_of(docs, picked).select("doc_id", F.substr("text", place, F.lit(chars)).alias("text")).orderBy("doc_id").collect()]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def all_spans(given: list[str | None], net: Tagger | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """The base spans of each text, and all its spans (without a tagger: the same). A null text has none."""
    texts = [t or "" for t in given]
    base = [base_spans(t) for t in texts]
    if net is None:
        return base, base
    some = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
    both = list(base)
    for i, more in zip(some, net.spans([texts[i] for i in some])):
        both[i] = join_spans(base[i], more)
    return base, both


def redact_all(docs: DataFrame, net: Tagger) -> DataFrame:
    """All rows and columns, each span of ``text`` replaced by its kind. Null and empty texts stay; ids aren't read; repeated
    rows get equal texts; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(given: list[str | None]) -> tuple[list[str | None], None]:
        _, both = all_spans(given, shared.value)
        return [None if t is None else redact(t, own) for t, own in zip(given, both)], None

    return map_texts(docs, run)


def find(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """``docs(doc_id, text)`` -> counts and digest of the base spans, all spans, and the redacted text, row by row.

    Spans are kind:start:end in code points, end exclusive, over the whole text. Counts are of base spans. A null text
    counts as empty: no spans, the digest of an empty listing, and a null redacted text. Repeated rows get
    equal results; a null doc_id is passed through; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: a few thousand weights

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        given = batch.column(1).to_pylist()
        base, both = all_spans(given, shared.value)
        show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        columns = [batch.column(0).cast(pa.int64())]
        columns += [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in range(4)]
        columns += [pa.array([hashlib.sha256(show(own).encode()).hexdigest() for own in base]), pa.array([show(own) for own in both])]
        columns += [pa.array([None if t is None else redact(t, own) for t, own in zip(given, both)], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(surroundings(docs))).drop("redacted")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op1`` that SQL can say, those of the fixed patterns; the tagger isn't run for them."""
    return find(table(spark, sf_dir, "documents"), None).drop("spans", "redacted")


def _base_sql() -> str:
    """Each pattern's matches and the gaps between them give the places; failing matches are left out."""
    digits = "regexp_replace(p.m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 1 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr({digits}, length({digits}) - i, 1) AS INT) + 1] ELSE CAST(substr({digits}, length({digits}) - i, 1) AS INT) END)) % 10 = 0"
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(p.m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
    ]
    views = ", ".join(f"""{k}_m AS (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM t),
{k}_p AS (SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': length(coalesce(array_to_string(g[1:i], ''), '')) + CASE WHEN i > 1 THEN length(array_to_string(m[1:i - 1], '')) ELSE 0 END, 'm': m[i]}})) AS p FROM {k}_m WHERE len(m) > 0),
{k}_s AS (SELECT doc_id, count(*) AS n, string_agg('{k}:' || p.s || ':' || (p.s + length(p.m)), ',' ORDER BY p.s) AS shown FROM {k}_p WHERE {ok} GROUP BY doc_id)""" for k, p, ok in rules)
    joins = " ".join(f"LEFT JOIN {k}_s USING (doc_id)" for k, _, _ in rules)
    counts = ", ".join(f"coalesce({k}_s.n, 0) AS n_{k}" for k, _, _ in rules)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {views}
SELECT doc_id, {counts}, sha256(concat_ws(',', {", ".join(f"{k}_s.shown" for k, _, _ in rules)})) AS base_sha256 FROM t {joins}"""


BASE_SQL = _base_sql()
