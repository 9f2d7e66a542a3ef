"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much goes as a whole.

Lines wrapped at a fixed width are judged with the paragraph that they belong to. A line with a few words of a listed phrase is boilerplate where it also
recurs over the corpus, between different lines each time, so that copies of a document don't make its lines boilerplate.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bytescan import LOWER, Scan, U, mix, shingle_hashes
from pathloom.llm.common import chunks, map_rows, map_texts, table

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document is rejected when failing lines hold at least this share of its word characters.
MAX_LOST = 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_CONTINUED = np.zeros(256, bool)
_CONTINUED[0x80:0xC0] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')]")] = True

#: Phrases of licence, cookie and policy lines, lower-case. Fixed values.
BOILERPLATE = [
    "all rights reserved", "licensed under", "licenced under", "public license", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "we use cookies", "powered by", "lorem ipsum", "enable javascript", "javascript is disabled", "copyright (c)", "copyright \u00a9", "spdx-license",
    "alle rechte vorbehalten", "lizenziert unter", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "wir verwenden cookies", "impressum",
    "tous droits réservés", "sous licence", "politique de confidentialité", "conditions d'utilisation", "nous utilisons des cookies", "mentions légales",
    "todos los derechos reservados", "bajo licencia", "política de privacidad", "términos de uso", "condiciones de uso", "utilizamos cookies", "aviso legal",
]
#: A line is boilerplate when words of these phrases are at least one in so many of its words: anywhere, in a line that starts with one, and
#: in a line that recurs between RECURS different pairs of lines, or more, one for each so many documents.
SHARE, LEADING_SHARE, RECURRING_SHARE, RECURS, RECURS_IN = 3, 4, 12, 10, 50_000
#: Bits of the table of recurring lines, which every task gets.
LINE_BITS = 1 << 23
#: Entries of menus, lower-case; a line of nothing else is navigation. Fixed values.
NAVIGATION = [
    "home", "menu", "login", "log in", "sign in", "sign up", "subscribe", "share this", "read more", "next page", "previous page", "skip to content", "back to top",
    "startseite", "menü", "anmelden", "registrieren", "abonnieren", "weiterlesen", "nächste seite", "vorherige seite", "zum inhalt springen", "nach oben",
    "accueil", "connexion", "se connecter", "s'inscrire", "s'abonner", "lire la suite", "page suivante", "page précédente", "aller au contenu", "haut de page",
    "inicio", "menú", "iniciar sesión", "registrarse", "suscribirse", "leer más", "página siguiente", "página anterior", "saltar al contenido", "volver arriba",
]
_PHRASES = [(x.encode(), len(x.split()), x[-1].isalpha()) for x in BOILERPLATE]
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(0x80, 0x100)]] = True
_GAP = rb"(?:[\t-\r .:>|/*-]|\xc2[\xb7\xbb])"
_ENTRY = b"(?:" + b"|".join(re.escape(x.encode()) for x in sorted(NAVIGATION, key=len, reverse=True)) + b")"
MENU = re.compile(_GAP + b"*" + _ENTRY + b"(?:" + _GAP + b"+" + _ENTRY + b")*" + _GAP + b"*")


def counts(scan: Scan) -> dict[str, np.ndarray]:
    """The documents' figures: words, characters in words, symbols, repeated lines and words in repeated windows."""
    docs = len(scan)
    total = lambda mask: np.add.reduceat(np.concatenate([mask, [0]]).astype(np.int64), np.stack([scan.doc_start, scan.doc_end], 1).ravel())[::2] * (scan.doc_end > scan.doc_start)
    per_doc = lambda who, keep=None: np.bincount(who if keep is None else who[keep], minlength=docs).astype(np.int64)
    start, end, of = scan.lines()
    words_in = np.searchsorted(scan.word_start, end) - np.searchsorted(scan.word_start, start)
    line = mix(scan.hashes(start, end) ^ mix(of.astype(U)))
    full = np.flatnonzero(words_in > 0)
    _, first = np.unique(line[full], return_index=True)
    again = np.ones(len(full), bool)
    again[first] = False

    words = scan.words()
    window = shingle_hashes(words, 3)
    n = len(window)
    inside = scan.word_doc[:n] == scan.word_doc[2 : n + 2]
    window, at = mix(window[inside] ^ mix(scan.word_doc[:n][inside].astype(U))), np.flatnonzero(inside)
    order = np.argsort(window)
    twin = window[order][1:] == window[order][:-1]
    repeated = np.zeros(len(words), bool)
    hit = np.zeros(len(order), bool)
    hit[1:] |= twin
    hit[:-1] |= twin
    for k in range(3):
        repeated[at[order[hit]] + k] = True
    return {
        "n_words": per_doc(scan.word_doc),
        "word_chars": total(~scan.gap & ~_CONTINUED[scan.data]),
        "n_symbols": total(_SYMBOLS[scan.data]),
        "n_dup_lines": per_doc(of[full], again),
        "n_repeat_words": per_doc(scan.word_doc, repeated),
        "_repeated": repeated,
    }


def phrase_words(scan: Scan, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the words of listed phrases in it, whole words only, and whether it starts with one."""
    known, leads = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    for phrase, words_in, bound in _PHRASES:
        at = raw.find(phrase)
        while at >= 0:
            after = at + len(phrase)
            if not (at and _IN_WORD[raw[at - 1]]) and not (bound and _IN_WORD[raw[after]]):  # a line feed ends every text
                i = np.searchsorted(end, at)
                known[i] += words_in
                leads[i] |= scan.gap[start[i] : at].all()
            at = raw.find(phrase, after)
    return known, leads


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line.strip(b"\x20\t\r\v\f"), digest_size=8).digest(), "little")


def recurring_lines(docs: DataFrame) -> np.ndarray:
    """A bit table of the hashes of lines that hold a few words of listed phrases and stand between many different pairs of lines.

    Only such lines are counted, so the shuffle is small; what is sent to every task is LINE_BITS bits, whatever the input.
    """

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, out = batch.column(0).to_pylist(), []
        for lo, hi in chunks(texts):
            scan = Scan(texts[lo:hi])
            start, end, of = scan.lines()
            n = np.searchsorted(scan.word_start, end) - np.searchsorted(scan.word_start, start)
            raw, shown = LOWER[scan.data].tobytes(), scan.data.tobytes()
            known, _ = phrase_words(scan, raw, start, end)
            for i in np.flatnonzero((known > 0) & (known * RECURRING_SHARE >= n)).tolist():
                around = [shown[start[k] : end[k]] if 0 <= k < len(of) and of[k] == of[i] else b"" for k in (i - 1, i + 1)]
                out.append((line_hash(shown[start[i] : end[i]]), line_hash(around[0] + b"\n" + around[1])))
        yield pa.RecordBatch.from_arrays([pa.array(np.array([o[k] for o in out], U).view(np.int64)) for k in (0, 1)], ["line", "around"])

    found = map_rows(docs.select(F.col("text").cast("string")), find, "line long, around long").distinct()
    least = F.greatest(F.lit(RECURS), F.ceil(F.lit(docs.count()) / RECURS_IN))
    often = found.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    place = F.pmod("line", F.lit(LINE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    rows = often.select(F.shiftright(place, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(LINE_BITS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def recurs(table_: np.ndarray | None, line: bytes) -> bool:
    if table_ is None:
        return False
    place = line_hash(line) % LINE_BITS
    return bool(int(table_[place >> 6]) >> (place & 63) & 1)


def wrapped_lines(scan: Scan, start: np.ndarray, end: np.ndarray, of: np.ndarray, ends_well: np.ndarray) -> np.ndarray:
    """Lines that go on in the next one: neither could have taken its first word within the longest line of their block (lines without a
    blank one between), and the last line that they go on to ends a sentence."""
    a, b = np.searchsorted(scan.word_start, start), np.searchsorted(scan.word_start, end)
    n, m = b - a, len(start)
    size = (lambda s: s[end] - s[start])(np.concatenate([[0], np.cumsum(~_CONTINUED[scan.data])]))
    first = np.zeros(m, np.int64)
    at = a[n > 0]
    first[n > 0] = scan.word_end[at] - scan.word_start[at]
    goes_on = np.zeros(m, bool)
    goes_on[:-1] = (n[:-1] > 0) & (n[1:] > 0) & (of[:-1] == of[1:])
    block = np.cumsum(np.concatenate([[True], ~goes_on[:-1]])) - 1
    longest = np.maximum.reduceat(size, np.flatnonzero(np.concatenate([[True], ~goes_on[:-1]]))) if m else size
    goes_on[:-1] &= size[:-1] + 1 + first[1:] > longest[block[:-1]]
    last = np.flatnonzero(~goes_on)  # of each paragraph
    return goes_on & ends_well[last[np.searchsorted(last, np.arange(m))]]


def failing_lines(scan: Scan, figures: dict[str, np.ndarray], recurring: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Lines that fail a rule, with each line's bounds and text: (start, end, text's index, which fail by rule). Lines without a word don't fail.

    The rules are those listed below; letter case counts for A-Z only. An ending beyond ASCII passes the punctuation rule.
    """
    start, end, of = scan.lines()
    data, sums = scan.data, lambda mask: np.concatenate([[0], np.cumsum(mask)])
    inside = lambda mask: (lambda s: s[end] - s[start])(sums(mask))
    letters, upper, symbols, pipes = (inside(m) for m in (_LETTER[data], _UPPER[data], _SYMBOLS[data], data == ord("|")))
    a, b = np.searchsorted(scan.word_start, start), np.searchsorted(scan.word_start, end)
    n = b - a
    some = n > 0
    last = np.zeros(len(start), np.uint8)
    last[some] = data[scan.word_end[b[some] - 1] - 1]
    ends_well = _END[last] | (last >= 0x80)
    repeated = (lambda s: s[b] - s[a])(sums(figures["_repeated"]))
    words = scan.words()
    same = sums(words[1:] == words[:-1])  # a blank last line starts behind the last word
    echo = same[np.minimum(np.maximum(b - 1, a), len(same) - 1)] - same[np.minimum(a, len(same) - 1)]
    raw, shown = LOWER[data].tobytes(), data.tobytes()
    known, leads = phrase_words(scan, raw, start, end)
    boilerplate = some & ((known * SHARE >= n) | (leads & (known * LEADING_SHARE >= n)))
    for i in np.flatnonzero(some & ~boilerplate & (known * RECURRING_SHARE >= n)).tolist():
        boilerplate[i] = recurs(recurring, shown[start[i] : end[i]])
    failed = {
        "symbols": some & (symbols * 10 > n * 5),  # more than one for two words
        "navigation": some & (pipes * 4 > n) & (pipes > 1),  # a list cut up by bars, or a menu
        "shouting": (upper * 2 > letters) & (n > 3),
        "echo": some & (echo * 2 > n),  # one word again and again
        "repetition": (repeated * 2 > n) & (n > 3),  # windows that the text repeats
        "punctuation": (n >= 8) & ~ends_well & ~wrapped_lines(scan, start, end, of, ends_well),  # eight words or more that end no sentence
        "boilerplate": boilerplate,
    }
    for i in np.flatnonzero(some & ~np.logical_or.reduce(list(failed.values()))).tolist():
        failed["navigation"][i] = MENU.fullmatch(raw, start[i], end[i]) is not None
    return start, end, of, failed


def clean_texts(texts: list[str | None], max_lost: float = MAX_LOST, recurring: np.ndarray | None = None) -> Iterator[tuple[int, int, dict[str, np.ndarray], list[str | None]]]:
    """Chunks of the texts as (from, to, figures, texts without their failing lines). ``lost`` is the share of word characters in failing lines,
    ``lost_to`` that by each rule."""
    for lo, hi in chunks(texts):
        scan = Scan(texts[lo:hi])
        f = counts(scan)
        start, end, of, by_rule = failing_lines(scan, f, recurring)
        failed = np.logical_or.reduce(list(by_rule.values()))
        chars = (lambda s: s[end] - s[start])(np.concatenate([[0], np.cumsum(~scan.gap & ~_CONTINUED[scan.data])]))
        share = lambda lines: np.bincount(of, weights=chars * lines, minlength=len(scan)) / np.maximum(f["word_chars"], 1)
        f["lost"], f["lost_to"] = share(failed), {rule: share(lines) for rule, lines in by_rule.items()}
        f["base"] = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
        f["kept"] = ~f["base"] & (f["lost"] < max_lost)
        raw, cleaned = scan.data.tobytes(), list(texts[lo:hi])
        for d in np.unique(of[failed]).tolist():
            i, j = np.searchsorted(of, [d, d + 1])
            cleaned[d] = b"\n".join(raw[start[k] : end[k]] for k in range(i, j) if not failed[k]).decode("utf-8", "replace")
        yield lo, hi, f, cleaned


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The rows that are kept, all their columns, ``text`` without its failing lines. Null and empty texts are rejected; ids aren't
    read; repeated rows stay or go alike; an empty table gives an empty result."""

    recurring = docs.sparkSession.sparkContext.broadcast(recurring_lines(docs))  # LINE_BITS bits

    def run(texts: list[str | None]) -> tuple[list[str | None], list[bool]]:
        parts = list(clean_texts(texts, max_lost, recurring.value))
        return [t for p in parts for t in p[3]], [bool(k) for p in parts for k in p[2]["kept"]]

    return map_texts(docs, run)


def judge(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each input row with its figures, the base rule's and the method's verdict.

    A null, empty or blank text has no words and fails the base rule. Repeated rows get equal results; a null doc_id is
    passed through; an empty table gives an empty result; other columns are ignored. ``lost_share`` is the share of
    word characters in failing lines, ``lost_to`` that by rule, ``cleaned`` the text without them (null for a null text).
    """
    recurring = docs.sparkSession.sparkContext.broadcast(recurring_lines(docs))  # LINE_BITS bits

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for lo, hi, f, cleaned in clean_texts(texts, max_lost, recurring.value):
            columns = [batch.column(0).slice(lo, hi - lo).cast(pa.int64())]
            columns += [pa.array(f[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns += [pa.array(f["base"]), pa.array(f["kept"]), pa.array(f["lost"])]
            shares = np.stack([f["lost_to"][r] for r in RULES], 1)
            columns += [pa.MapArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * len(RULES), pa.array(RULES * (hi - lo)), pa.array(shares.ravel())), pa.array(cleaned, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_share double, lost_to map<string,double>, cleaned string"
RULES = ["symbols", "navigation", "shouting", "echo", "repetition", "punctuation", "boilerplate"]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("lost_share", "lost_to", "cleaned")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op2`` that SQL can say: all but the method's verdict."""
    return op2(spark, sf_dir).drop("kept")


BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
i AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS pos, words FROM w WHERE len(words) > 2),
k AS (SELECT doc_id, pos, words[pos] || ' ' || words[pos + 1] || ' ' || words[pos + 2] AS win FROM i),
r AS (SELECT doc_id, pos FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
p AS (SELECT doc_id, count(DISTINCT pos + o) AS n_repeat_words FROM r, range(3) s(o) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN d USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
"""
