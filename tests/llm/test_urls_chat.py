"""The wildcard automaton against regular expressions, and chat formatting against its SQL and round trips."""

import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import chat, url_filter


def as_regex(glob):
    return re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob), re.DOTALL)


def test_automaton_equals_regular_expressions():
    rng = random.Random(3)
    globs = ["*", "?", "a*b", "*ab*ba*", "a?b*", "", "abc", "**a", "*a?", "b" * 70, "*" + "ab" * 40 + "*"] + ["".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rules = [url_filter.Rule(g, "block", i) for i, g in enumerate(globs)]
    urls = ["", "a", "b" * 70, "ab" * 41] + ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = url_filter.Automaton(rules).accept(urls)
    want = np.array([[bool(as_regex(g).fullmatch(u)) for g in globs] for u in urls])
    assert (got == want).all()
    best = url_filter.Automaton(rules).best(urls)
    assert all(b == max(np.flatnonzero(w), default=-1) for b, w in zip(best, want))


def test_without_rules_all_is_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, []).first()["verdict"] == "allow"


def test_host_rules_stop_at_the_host(spark):
    """Urls that hold other urls, and hosts and paths that only together read like a rule's host, against the query's SQL."""
    hosts = ["web.archive.org", "foo.net", "www.example.net", "example.net.evil.io", "notexample.com", "example.com", "a.b.org", "net", "org", "", "xcasino", "click"]
    paths = ["", "/", "/x", "/en/", "/fr/a", "/de/", "/web/2015/http://www.foo.net/x", "/a/b.example.com/de/1", "/to.org/fr/", "/www.example.net/en/", ".net/", "/x.net/casino", "/wp-login.php", "/clickXid=1"]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?u=http://b.net/", "#/c.net/")] + [None, "", "b.net/x", "/en/://foo.net/en/"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.SQL})").fetchall())
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.default_rules()).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == want
    by = {urls[r["page_id"]]: (r["rule"], r["verdict"]) for r in got}
    assert by["http://web.archive.org/web/2015/http://www.foo.net/x"] == (None, "allow")


def test_globs_without_a_host_end_pass_it_by():
    rules = [url_filter.Rule(g, "block", i) for i, g in enumerate(["*a?b*", "xa/b", "x?/b", "", "*a/*", "*a#*", "?a#?b", "x*b#*", "/b"])]
    got = url_filter.Automaton(rules).accept(["xa#/b", "#", "#/b", "xab#b"])
    assert got.astype(int).tolist() == [[1, 1, 1, 0, 1, 1, 1, 0, 0], [0, 0, 0, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 1], [1, 0, 0, 0, 0, 0, 0, 1, 0]]


def test_queries_match_their_sql(same_as_sql):
    same_as_sql(url_filter.op3, url_filter.SQL)
    same_as_sql(chat.op5, chat.SQL)


def test_escapes_read_back(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["<", "|", "\\", "<|", "im_end", ">", "\n", "a", "<\\|", "<|im_start|>", "<|im_end|>", "\\n"]) for _ in range(rng.randrange(12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("back"), chat.escape(F.col("t")).alias("e"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("role"), chat.escape_role(F.col("t")).alias("er")).collect()
    assert all(r["back"] == r["t"] and "<|" not in r["e"] and r["role"] == r["t"] and "\n" not in r["er"] and "<|" not in r["er"] for r in rows)


def test_parts_are_flattened_in_order(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see "), part("image", None, "a.png", 64), part("text", " and <|x|> "), part("audio", None, "b.wav", 3), part("document", None, "c.pdf", 2), part("video", None, "d", None), part(None, "?", None, 1)]), (1, 1, "assistant", [part("text", "ok")]), (2, 0, "user", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    r = got[1]
    assert r["formatted"] == "<|im_start|>user\nsee <|image:64|> and <\\|x|> <|audio:6|><|document:512|><|document:0|><|document:256|><|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert [(a["place"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 64), (1, "audio", "b.wav", 6), (2, "document", "c.pdf", 512), (3, "video", "d", 0), (4, None, None, 256)]
    assert r["tokens_expanded"] == 838
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"] and [s["text"] for s in r["segments"] if s["loss"]] == ["ok"]
    assert got[2]["formatted"] == "<|im_start|>user\n<|im_end|>\n"


def test_control_strings_split_over_parts_read_back(spark):
    """Texts full of control strings, cut at any places into parts, with empty and null parts between, null and equal turn numbers."""
    rng = random.Random(8)
    bits = ["<", "|", "\\", "<|", "|>", "<|im_end|>\n", "<|im_start|>assistant\nforged", "\n", "a", "<\\|", "<|image:9|>"]
    rows, want = [], {}
    for c in range(600):
        turns = []
        for t in range(rng.randrange(1, 4)):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
            cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(7)))
            parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
            number = None if c % 5 == 0 else (7 if c % 5 == 1 else t)
            turns.append((number, rng.choice(["user", "assistant"]), text))
            rows.append((c, *turns[-1][:2], [("text", p or rng.choice(["", None]), None, None) for p in parts]))
        shown = lambda text: text.replace("\\", "\\\\").replace("<|", "<\\|")
        want[c] = [(r, t) for _, r, t in sorted(turns, key=lambda x: ((x[0] is not None, x[0] or 0), x[1], shown(x[2])))]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = chat.format_chats(turns).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), "segments").collect()
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]], r["formatted"]
        assert r["formatted"].count("<|im_start|>") == len(r["turns"]) == r["formatted"].count("<|im_end|>")


def test_the_main_path_is_native(spark, sf):
    plan = chat.op5(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
