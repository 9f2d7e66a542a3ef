"""URL filters by a bit-parallel wildcard automaton.

Rules are globs over the canonical URL: lower-cased host and then the path, with HOST_END between them, which neither holds. A
glob with HOST_END sees it, and no star or ? runs over it; other globs pass it by. All globs' positions are packed into multiword
Shift-And masks, one bit a position; each byte of a URL moves every glob at once. A batch of URLs is advanced
together, position by position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import map_rows, table

_U = np.uint64
#: Where the host ends in the canonical URL; hosts and paths stop before it.
HOST_END = "#"


@dataclass(frozen=True)
class Rule:
    """A glob (* any run, ? any one byte) over the canonical URL, what it decides, and its rank: the highest fitting rank wins."""

    glob: str
    verdict: str
    rank: int
    name: str | None = None


def host_rule(text: str, verdict: str) -> list[Rule]:
    """``host/path``: the host and all its subdomains, where the path starts with the rule's. A longer text outranks a shorter one."""
    host, slash, path = text.partition("/")
    return [Rule(f"{own}{HOST_END}{slash}{path}*", verdict, 1_000_000 + len(text), text) for own in (host, "*." + host)]


#: The listed hosts.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Globs for URLs that no listed host covers.
GLOBS = ["*cheap-pills*", "*spam-farm*", "*casino*", "*payday-loan*", "*free-download*", "*adult-??deo*", "*/wp-login*"]


def default_rules() -> list[Rule]:
    return [r for text, verdict in HOST_RULES for r in host_rule(text, verdict)] + [Rule(g, "block", k + 1) for k, g in enumerate(GLOBS)]


class Automaton:
    """Bit i of a rule stands for 'the first i symbols of the glob are read'; stars keep their bit and pass it on."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        symbols: list[tuple[int | None, bool]] = []  # of each bit: byte to reach it (None: any), and whether a star holds it
        start, final, blind = [], [], []  # blind: bits of rules that pass the host's end by
        for rule in rules:
            start.append(len(symbols))
            symbols.append((-1, False))
            for c in rule.glob.encode():
                if c == ord("*"):
                    symbols[-1] = (symbols[-1][0], True)
                else:
                    symbols.append((None if c == ord("?") else c, False))
            final.append(len(symbols) - 1)
            blind += range(start[-1], len(symbols)) if HOST_END not in rule.glob else ()
        self.words = (len(symbols) + 63) // 64
        self.step = np.zeros((256, self.words), _U)
        self.start = np.zeros(self.words, _U)
        self.stay = np.zeros((256, self.words), _U)
        for i, (byte, star) in enumerate(symbols):
            w, bit = i // 64, _U(1 << (i % 64))
            if byte is None:
                self.step[:, w] |= bit
            elif byte >= 0:
                self.step[byte, w] |= bit
            if star:
                self.stay[:, w] |= bit
        end = ord(HOST_END)
        self.step[end], self.stay[end] = 0, 0
        for i, (byte, _) in enumerate(symbols):
            if byte == end:
                self.step[end, i // 64] |= _U(1 << (i % 64))
        for i in blind:
            self.stay[end, i // 64] |= _U(1 << (i % 64))
        for i in start:
            self.start[i // 64] |= _U(1 << (i % 64))
        self.final = [(i // 64, _U(1 << (i % 64))) for i in final]

    def accept(self, urls: list[str]) -> np.ndarray:
        """Which rules fit each URL as a whole: booleans, URLs by rules."""
        raw = [u.encode("utf-8", "surrogatepass") for u in urls]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        data, at = np.frombuffer(b"".join(raw) or b"\0", dtype=np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1]
        live = np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), side="right")
        state = np.tile(self.start, (len(raw), 1))
        for t, n in enumerate(live.tolist()):
            own = order[:n]
            now = state[own]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            byte = data[at[own] + t]
            state[own] = (moved & self.step[byte]) | (now & self.stay[byte])
        return np.stack([(state[:, w] & bit) != 0 for w, bit in self.final], 1) if self.final else np.zeros((len(raw), 0), bool)

    def best(self, urls: list[str]) -> np.ndarray:
        """Index of the fitting rule of the highest rank, the first of equals; -1 where none fits."""
        rank = np.array([r.rank for r in self.rules], dtype=np.int64)
        fits = np.where(self.accept(urls), rank, -1)
        return np.where(fits.max(1, initial=-1) >= 0, fits.argmax(1), -1) if len(self.rules) else np.full(len(urls), -1)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or other urls."""
    rest = F.substr(url, F.locate("://", url) + 3)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(url.contains("://"), host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def filter_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages(page_id, url)`` -> ``(page_id, host, path, rule, verdict)``, one row for each input row.

    A null url, or one without ``://``, has an empty host and path and meets the rules as the empty string. ``rule`` is the
    name of the deciding rule, null for unnamed ones and where none fits; the verdict is then the glob's, or allow. Repeated
    rows get equal results, a null page_id is passed through, an empty table gives an empty result, other columns are ignored.
    """
    automaton = Automaton(rules)
    shared = pages.sparkSession.sparkContext.broadcast(automaton)  # grows with the rules only

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a = shared.value
        best = a.best([h + HOST_END + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])
        own = [a.rules[i] if i >= 0 else None for i in best.tolist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.name if r else None for r in own], pa.string()), pa.array([r.verdict if r else "allow" for r in own], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    split = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return map_rows(split, run, "page_id long, host string, path string, rule string, verdict string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), default_rules())


def _like(glob: str) -> str:
    return glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), rules(rule, rhost, rpath, decides) AS (
  VALUES {", ".join(f"('{t}', '{t[: t.index('/')]}', '{t[t.index('/') :]}', '{v}')" for t, v in HOST_RULES)}
), hit AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(decides, length(rule)) AS decides
  FROM s LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(decides, CASE WHEN {" OR ".join(f"host || path LIKE '{_like(g)}' ESCAPE '{chr(92)}'" for g in GLOBS)} THEN 'block' ELSE 'allow' END) AS verdict FROM hit
"""
