"""Small tables that every operator must take, and plain restatements to test against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, own_group string, mark string, score string, _id string"


def odd_documents(spark, more=()):
    """Null, empty, blank and very long texts, repeated rows, a null id, and columns with names that operators use themselves."""
    texts = [None, "", "   \t\n ", "word", "\n\n", "x" * 300_000, "lorem ipsum dolor " * 20_000, "same text here", "same text here", "naïve café — ünïcode \U0001f600 text", "a\u2028b\u00a0c \x1c d", "<|endoftext|> <|im_start|>", "line one\r\nline two\r\n", "0123456789 4111, " * 4000, "a@b.co " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "same text here"), (None, "an id that is null"), (None, None), *more]
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "w", "g", "m", "s", "d") for i, t in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard_components(docs, n, percent):
    """{id: (set size, smallest reachable id)} by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}
