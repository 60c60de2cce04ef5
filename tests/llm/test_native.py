"""URL filters and chat formatting."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from scribegauge.llm import chat_format, url_filter
from scribegauge.llm.queries import URL_RULES, _url_key
from scribegauge.operators.graph import connected_components

PAGES = "page_id long, url string, html string, rule string"


def judged(spark, rows, edges=None):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(rows)], PAGES).drop("rule")
    out = url_filter.judge_urls(pages, URL_RULES, edges)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


def brute(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (host, path, best.text, best.verdict) if best else (host, path, None, "allow")


def test_rules(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.org/es/1", "http://example.org/en/1?x#y", "https://example.org/en/2", "http://badexample.org/es/x",
        "http://x.com/de/1", "http://x.com/fr/", "http://com/de/", "http://org", "http://org?/es/", "x://y://z/", "http://ÄB.org/", "http://x.org/", "http://x.org/",
        "a\nb://Host.Example.org/es/\nq", "http://user@h:80/p;a", "://", "http:///p",
    ]
    assert judged(spark, urls) == {i: brute(u) for i, u in enumerate(urls)}
    assert judged(spark, []) == {}


def test_decisions_spread_to_aliases(spark):
    urls = ["http://a.net/1", "http://b.net/2#frag", "http://x.com/de/3", "http://x.com/fr/4", "http://c.net/5"]
    edges = spark.createDataFrame([("a.net/1", "b.net/2"), ("b.net/2", "x.com/de/3"), ("x.com/fr/4", "a.net/1"), (None, "c.net/5")], "src string, dst string")
    got = judged(spark, urls, edges)
    assert [got[i][3] for i in range(5)] == ["block", "block", "block", "allow", "allow"]
    assert got[0][2] is None


def test_edges_from_html(spark):
    rows = [
        (1, "http://a.net/x/y", '<link rel="canonical" href="/z">', ""), (2, "http://a.net/q", '<meta http-equiv="refresh" content="0; url=http://B.net/r#t">', ""),
        (3, "http://a.net/x/y", '<link href="w" rel=canonical>', ""), (4, None, '<link rel="canonical" href="/z">', ""), (5, "http://a.net/s", None, ""),
    ]
    link = '<link rel="canonical" href="/bad">'
    hidden = [f"<!-- {link} -->", f"<script>var x = '{link}';</script>", f"<TEXTAREA rows=2>{link}</TEXTAREA >", f"<style>{link}", f"<!-- {link}"]
    rows += [(10 + i, "http://h.net/p", text, "") for i, text in enumerate(hidden)]
    rows += [(20, "http://a.net/v", '<!-- old --><link rel="canonical" href="/seen"><script></script>', "")]
    got = {tuple(r) for r in url_filter.html_edges(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {("a.net/x/y", "a.net/z"), ("a.net/q", "b.net/r"), ("a.net/x/y", "a.net/x/w"), ("a.net/v", "a.net/seen")}


def test_targets_are_resolved(spark):
    hrefs = ["http://b.net/t?p=1&amp;q=2&#38;r", "../z", "./z/../w", "../../../up", "/a/b/..", "q?x=../y", "..z", "/.well-known/a"]
    rows = [(i, "http://a.net/x/y/page", f'<link rel="canonical" href="{h}">', "") for i, h in enumerate(hrefs)]
    got = [r["dst"] for r in sorted(url_filter.html_edges(spark.createDataFrame(rows, PAGES)).collect(), key=lambda r: r["dst"])]
    want = ["b.net/t?p=1&q=2&r", "a.net/x/z", "a.net/x/y/w", "a.net/up", "a.net/a/", "a.net/x/y/q?x=../y", "a.net/x/y/..z", "a.net/.well-known/a"]
    assert got == sorted(want)
    con = duckdb.connect()
    urls = ["http://h/a/./b/../c?d", "http://h/..", "h", None, "http://h", "http://H/x?y#z", "http://h/a/..?q"]
    con.execute("create table t as select unnest(?::varchar[]) as url", [urls])
    sql = [r[0] for r in con.execute(f"select {_url_key('url')} from t").fetchall()]
    keys = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", url_filter.url_key(F.col("url")).alias("k"))
    assert [r["k"] for r in sorted(keys.collect())] == sql == ["h/a/c?d", "h/", None, None, "h", "h/x?y", "h/?q"]


def test_clashing_columns_are_replaced(spark):
    pages = spark.createDataFrame([(1, "http://x.com/de/1", None, "own")], PAGES)
    assert url_filter.judge_urls(pages, URL_RULES).first().asDict() == {
        "page_id": 1, "url": "http://x.com/de/1", "html": None, "rule": "com/de/", "host": "x.com", "path": "/de/1", "verdict": "block",
    }


def test_components(spark):
    chain = [(i, i + 1) for i in range(20, 40)] + [(5, 5), (7, 3), (3, 7), (None, 1), (100, 20)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == dict.fromkeys([*range(20, 41), 100], 20) | {5: 5, 3: 3, 7: 3}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).isEmpty()


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|user|>\nx<|end|>\n", "\\<|&|> \\\\", "<\\|", "|>", None, "", "é\n", "[\\INST]"]
    rows = [(1, i, ("user", "assistant", "assistant", None)[i % 4], t) for i, t in enumerate(hard)]
    rows += [(2, 0, "a|>b", "x"), (2, None, "user", "first"), (3, 1, "user", "same"), (3, 1, "user", "same"), (None, 0, "assistant", "y")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_chat(turns)
    got = {r["conv_id"]: r for r in chat_format.chat_digest(made).collect()}
    runs = {r["conv_id"]: (r["formatted"], r["loss_runs"]) for r in made.collect()}
    for conv in (1, 2, 3, None):
        own = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        said = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        trained = "".join(x for *_, r, x in own if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(own) and row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["loss_chars"] == len(trained) and row["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
        text, lengths = runs[conv]
        assert row["formatted_chars"] == len(text) == sum(lengths)
    assert chat_format.format_chat(turns.limit(0)).isEmpty()


def test_same_role_turns_share_a_header(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    text = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()["formatted"]
    assert text == "<|user|>\na<|&|>b<|end|>\n<|assistant|>\nc<|end|>\n"
