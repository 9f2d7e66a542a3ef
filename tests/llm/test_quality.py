"""Quality rules against plain counts, and the line model against enumeration, held-out labels and leaked ones."""

import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from helpers import words

from pathloom.llm import quality_crf, quality_rules
from pathloom.llm.bytescan import Scan
from pathloom.llm.common import labelled_sample, table


def plain_counts(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": len(rep)}


def test_counts_equal_plain_ones(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r for r in quality_rules.op2(spark, sf).collect()}
    for d in docs.collect():
        p, r = plain_counts(d["text"]), got[d["doc_id"]]
        assert {k: r[k] for k in p} == p
        assert r["base_failed"] == (p["n_words"] < 50 or 100 * p["n_repeat_words"] > 50 * p["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_base_columns_equal_their_sql(same_as_sql):
    same_as_sql(quality_rules.base, quality_rules.BASE_SQL)


def test_good_documents_are_kept(spark, sf):
    rows = quality_rules.op2(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("quality = 1 and not base_failed")
    assert rows.count() > 10 and rows.where("not kept").count() == 0


def test_failing_lines_go_and_too_much_loss_rejects():
    rng = random.Random(1)
    body = "\n".join(" ".join(f"word{rng.randrange(10**6)}" for _ in range(12)).capitalize() + "." for _ in range(8))
    text = body + "\nAll rights reserved.\nHome | About | Contact | Login | Sign up\nBUY NOW CHEAP PILLS TODAY ONLY"
    (_, _, f, cleaned), = quality_rules.clean_texts([text])
    assert f["kept"][0] and cleaned[0] == body
    junk = "\n".join("### | ### | $$$ | %%% | &&& |" for _ in range(40)) + "\n" + body
    (_, _, f, _), = quality_rules.clean_texts([junk])
    assert not f["kept"][0]


def plain_clean(text):
    """The text without its failing lines, and the share of word characters in these, line by line and word by word."""
    text = text or ""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    places, repeated, at = {}, set(), 0
    every = words(text)
    for i in range(len(every) - 2):
        places.setdefault(tuple(every[i : i + 3]), []).append(i)
    for own in places.values():
        if len(own) > 1:
            repeated |= {i + k for i in own for k in range(3)}
    kept, lost, lines = [], 0, text.split("\n")
    for k, (line, low) in enumerate(zip(lines, lower.split("\n"))):
        w = words(line)
        n, raw = len(w), line.encode()
        mine = range(at, at + n)
        at += n
        failed = n > 0 and (
            10 * sum(c in "#*$%&|<>" for c in line) > 5 * n
            or (line.count("|") > 1 and 4 * line.count("|") > n)
            or (n > 3 and 2 * sum(65 <= b <= 90 for b in raw) > sum(chr(b).isascii() and chr(b).isalpha() or b >= 128 for b in raw))
            or 2 * sum(x == y for x, y in zip(w, w[1:])) > n
            or (n > 3 and 2 * sum(i in repeated for i in mine) > n)
            or (n >= 8 and not ends_well(line) and not goes_on_well(lines, k))
            or is_boilerplate(low, n)
            or is_menu(low)
        )
        if failed:
            lost += sum(map(len, w))
        else:
            kept.append(line)
    return "\n".join(kept), lost / max(1, sum(map(len, every)))


def ends_well(line):
    end = words(line)[-1][-1]
    return not end.isascii() or end in ".!?:;\"')]"


def goes_on_well(lines, k):
    """Whether a line is wrapped, and what it goes on to ends a sentence."""
    low = high = k
    while low and words(lines[low - 1]):
        low -= 1
    while high + 1 < len(lines) and words(lines[high + 1]):
        high += 1
    wide, last = max(map(len, lines[low : high + 1])), k
    while last < high and len(lines[last]) + 1 + len(words(lines[last + 1])[0]) > wide:
        last += 1
    return last > k and ends_well(lines[last])


def is_boilerplate(low, n):
    letter = "[0-9a-z\x80-\U0010ffff]"
    hits = [(m.start(), x) for x in quality_rules.BOILERPLATE for m in re.finditer(f"(?<!{letter}){re.escape(x)}" + (f"(?!{letter})" if x[-1].isalpha() else ""), low)]
    known, leads = sum(len(x.split()) for _, x in hits), any(not words(low[:at]) for at, _ in hits)
    return 3 * known >= n or (leads and 4 * known >= n)


def is_menu(line):
    """Whether a line falls into menu entries with gaps between, tried from the left entry by entry."""
    gaps = "\t\n\x0b\x0c\r .:>|/*-\xb7\xbb"
    line = line.strip(gaps)
    ends = {0}
    for a in range(len(line)):
        if a in ends:
            for x in quality_rules.NAVIGATION:
                if line.startswith(x, a):
                    b = a + len(x)
                    if b == len(line):
                        return True
                    c = b
                    while c < len(line) and line[c] in gaps:
                        c += 1
                        ends.add(c)
    return False


def rule_texts():
    rng = random.Random(12)
    vocabulary = ["word", "other", "Ünder", "x", "SHOUT", "LOUD", "end.", "so,", "#", "|", "***", "Home", "menü", "log", "in", "Login", "página", "siguiente", "nächste", "Seite", "»", "·"] + [f"w{i}" for i in range(60)]
    phrases = [*quality_rules.BOILERPLATE, *quality_rules.NAVIGATION, "ALL RIGHTS RESERVED", "home | menu | log in", "- Accueil » Connexion", "same words again and again", "…", ""]
    for _ in range(400):
        lines = []
        for _ in range(rng.randrange(1, 12)):
            n = rng.choice([0, 1, 3, 7, 8, 12, 24, 30, 40])
            line = [rng.choice(phrases) if rng.random() < 0.06 else rng.choice(vocabulary if rng.random() < 0.4 else vocabulary[22:]) for _ in range(n)]
            if rng.random() < 0.2:
                line = [rng.choice(phrases)]
            lines.append(" ".join(line) + rng.choice(["", ".", "!", "…", " ", "\r"]))
        yield "\n".join(lines + rng.choice([[], lines[:1]]))


def test_verdicts_equal_plain_rules(spark, sf):
    """Each rule restated: on made-up lines, and on all documents through the query."""
    texts = [*rule_texts(), "", None, "\n \n", "x"]
    got = [(c, bool(f["kept"][i]), f["lost"][i]) for _, _, f, cleaned in quality_rules.clean_texts(texts) for i, c in enumerate(cleaned)]
    menus = 0
    for t, (cleaned, kept, lost) in zip(texts, got):
        want, share = plain_clean(t)
        assert (cleaned or "") == want and lost == pytest.approx(share), t
        p = plain_counts(t)
        assert kept == (p["n_words"] >= 50 and 2 * p["n_repeat_words"] <= p["n_words"] and share < 0.5)
        menus += any(is_menu(x.lower()) for x in (t or "").split("\n"))
    assert menus > 20 and 20 < sum(k for _, k, _ in got) < len(got) - 20
    rows = {r["doc_id"]: r["kept"] for r in quality_rules.op2(spark, sf).collect()}
    for d in table(spark, sf, "documents").collect():
        p = plain_counts(d["text"])
        assert rows[d["doc_id"]] == (p["n_words"] >= 50 and 2 * p["n_repeat_words"] <= p["n_words"] and plain_clean(d["text"])[1] < 0.5)


def test_lines_without_a_sentence_s_end_and_long_boilerplate():
    body = "\n".join(" ".join(f"word{i}{j}" for i in range(12)) + "." for j in range(9))
    short = "All rights reserved by the author of it and heirs."
    longer = "All rights reserved " + " ".join(f"to{i}" for i in range(60)) + "."
    text = "\n".join([body, "eight words or more that end no sentence at all", "short heading", short, longer, "Startseite » Anmelden » Menü", "Inicio · Iniciar sesión", "日本語 の 行 は 句読点 なし で 続く"])
    (_, _, _, cleaned), = quality_rules.clean_texts([text])
    assert cleaned[0] == "\n".join([body, "short heading", longer, "日本語 の 行 は 句読点 なし で 続く"])


FERRY = "The old ferry that crosses the lake every morning is powered by a diesel engine built in Sweden."


def prose_paragraphs(rng, n):
    return [" ".join(f"word{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 90))).capitalize() + "." for _ in range(n)]


def test_a_phrase_in_ordinary_prose_and_parts_of_words_are_no_boilerplate():
    lines = [FERRY, "Powered by the wind alone the boat crossed the whole bay.", "Das Impressum steht auf der letzten Seite des Buches.", "They call it the unlicensed underground of the old town.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."]
    (_, _, f, cleaned), = quality_rules.clean_texts(["\n".join(lines)])
    assert cleaned[0] == "\n".join(lines[:4]) and f["lost_to"]["boilerplate"][0] == f["lost"][0] > 0


@pytest.mark.parametrize("width", [60, 72, 100])
def test_wrapped_prose_is_kept(width):
    paragraphs = prose_paragraphs(random.Random(width), 4)
    text = "\n\n".join(textwrap.fill(p, width) for p in paragraphs)
    (_, _, f, cleaned), = quality_rules.clean_texts([text])
    assert f["kept"][0] and cleaned[0] == text
    (_, _, f, _), = quality_rules.clean_texts(["\n".join(p.rstrip(".") for p in paragraphs)])  # not wrapped, and no sentence ends
    assert f["lost"][0] == 1 and f["lost_to"]["punctuation"][0] == 1


def test_lines_that_recur_between_different_lines_are_boilerplate(spark):
    """A line with a few words of a phrase goes where it stands between many different lines; one in copies of one text, or in one text, stays."""
    rng = random.Random(8)
    often = "Copies of this page are licensed under terms that the owners of this site have set out elsewhere."
    docs = ["\n".join([*prose_paragraphs(rng, 2), often, *prose_paragraphs(rng, 2)]) for _ in range(12)]
    docs += ["\n".join([*prose_paragraphs(rng, 2), FERRY, *prose_paragraphs(rng, 2)])] * 30
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(df.repartition(5)).collect()}
    assert all(often not in got[i]["cleaned"] and got[i]["lost_to"]["boilerplate"] > 0 for i in range(12))
    assert all(FERRY in got[i]["cleaned"] and got[i]["lost_share"] == 0 for i in range(12, 42))
    assert all(r["kept"] for r in got.values())
    assert not quality_rules.recurring_lines(df.limit(0)).any()


def test_good_documents_lose_little_to_each_rule(spark):
    """What the rules take from documents labelled good and bad, by rule: the README's figures."""
    sf = "/root/testdata/sf0.01"
    rows = quality_rules.judge(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where("not base_failed and quality is not null").collect()
    good = [r for r in rows if r["quality"] == 1]
    for rule in quality_rules.RULES:
        assert sum(r["lost_to"][rule] for r in good) / len(good) < 0.03, rule
    assert sum(r["kept"] for r in good) / len(good) > 0.99


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    net = quality_crf.Chain()
    net.w = rng.normal(size=net.w.shape)
    net.step, net.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    x, of = rng.normal(size=(5, len(net.w))) / 4, np.array([0, 0, 0, 0, 1])
    got = net.marginals(x, of)
    u = np.clip(x @ net.w, -40, 40)
    total, good = 0.0, np.zeros(4)
    for y in itertools.product((0, 1), repeat=4):
        p = np.exp(net.start[y[0]] + sum(u[t] * y[t] for t in range(4)) + sum(net.step[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    assert np.allclose(got[:4], good / total)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality_crf.op7(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_fold_and_labels_that_are_held_out_are_not_used(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    used = labelled_sample(docs, labels, "quality", 10_000)
    texts = {r["text"]: r["doc_id"] for r in docs.collect()}
    ids = {texts[t] for t, _ in used}
    twins = {r["text"] for r in docs.groupBy("text").count().where("count > 1").collect()}
    assert all(zlib.crc32(str(texts[t]).encode()) % 3 != 1 for t, _ in used if t not in twins) and ids
    assert len(labelled_sample(docs, labels, "quality", 5)) <= 5


def test_one_label_gives_a_constant_score():
    net = quality_crf.fit([("some text. Here it is.", 1)] * 3)
    assert net.scores(["anything", None, ""]) == pytest.approx([1 / (1 + np.exp(-3))] * 3)


def test_words_of_a_scan_are_plain_words():
    texts = ["a b\tc\n d", "", None, "é\x0bü\u00a0x", "  "]
    scan = Scan(texts)
    assert np.bincount(scan.word_doc, minlength=5).tolist() == [len(words(t)) for t in texts]
