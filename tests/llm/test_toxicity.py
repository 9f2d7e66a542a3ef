"""The convolutional network: pooling and gradients against plain loops, held-out labels, calibration."""

import numpy as np

from pathloom.llm import toxicity
from pathloom.llm.common import table


def test_pooling_equals_a_plain_loop():
    net = toxicity.Net()
    texts = ["one two three four", "", "Über ALLE maße", None, "x"]
    w = toxicity.Words(texts)
    got = net.pooled(w)
    for d in range(len(texts)):
        at = np.flatnonzero(w.of == d)
        x = net.table[w.whole[at]] + net.table[w.stem[at]]
        want = np.zeros(len(net.bias))
        for k, width in enumerate(toxicity._WIDTHS):
            own = slice(k * toxicity._FILTERS, (k + 1) * toxicity._FILTERS)
            for i in range(len(at)):
                y = sum(x[i + j] @ net.filters[k][j] for j in range(width) if i + j < len(at)) + net.bias[own]
                want[own] = np.maximum(want[own], y)
        assert np.allclose(got[d], want, atol=1e-5)


def test_a_planted_word_is_learned_and_clean_texts_stay():
    rng = np.random.default_rng(1)
    plain = lambda: " ".join(f"w{i}" for i in rng.integers(0, 300, 40)).replace("w", "wort")
    sample = [(plain() + (" scoundrel " if k % 4 == 0 else " ") + plain(), int(k % 4 == 0)) for k in range(800)]
    net = toxicity.fit(sample)
    test = [(plain() + (" Scoundrel! " if k % 2 else " ") + plain(), k % 2) for k in range(200)]
    got = net.scores([t for t, _ in test]) >= toxicity.THRESHOLD
    assert np.mean(got == np.array([y for _, y in test], bool)) > 0.97


def test_languages_by_function_words():
    w = toxicity.Words(["the cat of the house and that", "der Hund und die Katze mit", "le chat et la souris dans", "el perro y los gatos con", ""])
    assert toxicity.languages(w, toxicity._language_table()).tolist() == [0, 1, 2, 3, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op4(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    hit = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    false = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert hit > 0.85 and false < 0.02


def test_one_label_scores_are_constant():
    s = toxicity.fit([("a b c", 0)] * 5).scores(["x", None, "a b"])
    assert np.ptp(s) < 1e-9 and s[0] < 0.5
