from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vigil.llm.chat_format import preferences, reply_preferences
from vigil.llm.sharding import shards
from vigil.llm.url_filters import judged, page_links

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def python_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_shards_hold_every_row_once(spark, edge_docs, no_docs):
    docs = edge_docs.withColumn("record", F.lit(1)).withColumn("place", F.lit("p"))
    out = shards(docs, 7, bucket_bytes=20_000)
    assert python_free(out) and set(docs.columns) < set(out.columns)
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.record, r.place) for r in rows) == Counter((r.doc_id, r.text, r.record, r.place) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[i]) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert len({r.bucket for r in rows}) > 3
    few = shards(edge_docs.where("doc_id < 4"), 7).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert shards(no_docs, 7).count() == 0
    with pytest.raises(ValueError):
        shards(docs.withColumn("slot", F.lit(1)), 7)


def test_shards_mix_the_order(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    rows = shards(docs, 4, bucket_bytes=10_000).collect()
    first = sorted(r.doc_id for r in rows if r.shard == 0)
    assert len(first) == 1000 and 1700 < sum(first) / 1000 < 2300
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(b == a + 1 for a, b in zip(order, order[1:])) < 40


def page(canonical=None, refresh=None):
    head = f'<LINK href="{canonical}" Rel="canonical">' if canonical else ""
    head += f"<meta http-equiv='refresh' content='0; URL={refresh}'>" if refresh else ""
    return f"<html><head>{head}</head><body>x</body></html>"


def test_urls_and_aliases(spark):
    rows = [
        (1, "http://a.example.com/en/1?q=1#f", page()), (2, "https://WWW.Example.com/en/2", page()), (3, "http://x.org/1", page()),
        (4, "http://x.org/2", page(canonical="http://sub.example.com/en/9")),  # not a page itself, but blocked
        (5, "https://x.org/3#part", page(refresh="/2")), (6, "http://x.org/4", page(canonical="//x.org/3")),
        (7, "http://www.example.com/en/7", page(canonical="http://x.org/4")),  # explicit allow among blocked aliases
        (8, "http://shop.net/es/a", page()), (9, "http://shop.net/fr", page()), (10, None, None), (11, "no scheme", page()),
        (12, "http://example.com", page()), (13, "http://y.org/1", page(canonical="http://y.org/2")), (13, "http://y.org/1", page()),
        (None, "x://notcom/", None), (14, "http://a.com/en/x://b", page(refresh="relative.html"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("suffix", F.lit(1))
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, decision string")
    out = judged(pages, rules, page_links(pages))
    assert python_free(out)
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "a.example.com", "/en/1", "example.com/en/", "block"), (2, "www.example.com", "/en/2", "www.example.com/en/", "allow"),
        (3, "x.org", "/1", None, "allow"), (4, "x.org", "/2", None, "block"), (5, "x.org", "/3", None, "block"),
        (6, "x.org", "/4", None, "block"), (7, "www.example.com", "/en/7", "www.example.com/en/", "allow"),
        (8, "shop.net", "/es/a", "net/es/", "block"), (9, "shop.net", "/fr", None, "allow"), (10, "", "", None, "allow"),
        (11, "", "", None, "allow"), (12, "example.com", "", None, "allow"), (13, "y.org", "/1", None, "allow"),
        (13, "y.org", "/1", None, "allow"), (None, "notcom", "/", None, "allow"), (14, "a.com", "/en/x://b", "com/", "allow")], key=repr)
    assert judged(pages.limit(0), rules, page_links(pages.limit(0))).count() == 0


def test_all_valid_links_are_edges(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [  # url, html, the nodes that it leads to
        ("http://x.org/p?page=1", link("?page=2&amp;ref=x"), ["x.org/p?page=2&ref=x"]),
        ("http://x.org/p", link("/q?a=1&#38;b=2&#x26;c=3&#X00026;d"), ["x.org/q?a=1&b=2&c=3&d"]),
        ("http://x.org/p", link("/q?a=1&amp;amp;b&copy=2&lang=3&ampx&eacute;&#233;&#128512;&#55296;&#99999999999;&amp"),
         ["x.org/q?a=1&amp;b&copy=2&lang=3&ampx\u00e9\u00e9\U0001f600\ufffd\ufffd&"]),
        ("http://x.org/a/b.html?q", link("page2.html"), ["x.org/a/page2.html"]),
        ("http://x.org/a/b/c", link("../d/./e?x=../y"), ["x.org/a/d/e?x=../y"]),
        ("http://x.org/a/b/c", link("../../../.."), ["x.org/"]), ("http://x.org/a/b/c", link("."), ["x.org/a/b/"]),
        ("http://x.org", link("p?u=http://y.org/1"), ["x.org/p?u=http://y.org/1"]),
        ("http://x.org/p?q=1", link("#part"), []), ("http://x.org/p", link("mailto:a@y.org"), []), ("http://x.org/p", link(""), []),
        ("http://x.org/1", '<link rel="nofollow canonical" href="/2">', ["x.org/2"]),
        ("http://x.org/1", "<link\nhref=/2/ rel=CANONICAL><link rel='canonical' href=' /3 '>", ["x.org/2/", "x.org/3"]),
        ("http://x.org/1", '<link rel="alternate" href="/fr"><link title="a > b href=/4" rel=canonical href="/2">', ["x.org/2"]),
        ("http://x.org/1", '<link data-rel="canonical" rel="next" href="/2">canonical', []),
        ("http://x.org/1", '<base href="/d/"><link rel="canonical" href="2">', ["x.org/d/2"]),
        ("http://x.org/a/1", '<meta http-equiv="Refresh" content="0; url=&quot;2?a&amp;b&quot;">', ["x.org/a/2?a&b"]),
        ("http://x.org/a/1", '<meta content="5;//y.org/1" http-equiv=refresh><meta http-equiv=refresh content=0;URL=?p=1>', ["y.org/1", "x.org/a/1?p=1"]),
        ("http://x.org/1", '<meta http-equiv="refresh" content="30">', []), (None, link("/2"), []), ("http://x.org/1", None, [])]
    own = lambda text, i: text and text.replace("x.org", f"x{i}.org")
    frame = spark.createDataFrame([(own(url, i), own(html, i)) for i, (url, html, _) in enumerate(rows)], "url string, html string")
    got = defaultdict(set)
    for r in page_links(frame.coalesce(1)).collect():
        got[r.a.split("/")[0]].add(r.b)
    for i, (_, html, nodes) in enumerate(rows):
        assert got[f"x{i}.org"] == {own(b, i) for b in nodes}, html
    assert set(got) <= {f"x{i}.org" for i in range(len(rows))}
    table = [(1, "http://x.org/p?page=1", link("?page=2&amp;ref=x")), (2, "http://x.org/p?page=2&ref=x", link("../../fin.html")),
             (3, "http://x.org/fin.html", '<link rel="nofollow canonical" href="http://example.com/en/1">')]
    pages = spark.createDataFrame(table, "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, decision string")
    out = judged(pages, rules, page_links(pages))
    assert python_free(out) and [r.verdict for r in out.collect()] == ["block"] * 3


def test_preferences(spark):
    a, u, s = "assistant", "user", "system"
    turns = [
        (1, 0, s, "Be kind."), (1, 1, u, "Hi"), (1, 2, a, "Hello"), (1, 3, u, "More"), (1, 4, a, "Good"),
        (2, 5, s, "Be kind."), (2, 6, u, "Hi"), (2, 7, a, "Hello"), (2, 8, u, "More"), (2, 9, a, "Bad é"),
        (3, 0, u, "Hi"), (4, 0, u, "Hi"), (4, 1, a, None), (4, 1, a, None), (None, 0, u, "x"), (6, None, None, ""), (7, 0, u, "Ho")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    pairs = spark.createDataFrame([(1, 2, "p"), (3, 4, "q"), (4, 4, "r"), (6, 99, "s"), (7, 3, "t")], "chosen_id long, rejected_id long, k string")
    out = preferences(frame, pairs)
    assert python_free(out)
    got = {r.k: r for r in out.collect()}
    part = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    p = got["p"]
    assert p.n_common == 4 and p.prompt == part(s, "Be kind.") + part(u, "Hi") + part(a, "Hello") + part(u, "More")
    assert p.chosen_text == part(a, "Good") and p.rejected_text == part(a, "Bad é")
    assert [p.rejected_text[m.start : m.end] for m in p.rejected_mask] == ["Bad é<|end|>\n"]
    q = got["q"]
    assert q.n_common == 1 and q.chosen_text == "" and q.chosen_mask == [] and q.rejected_text == part(a, "") * 2
    assert [q.rejected_text[m.start : m.end] for m in q.rejected_mask] == ["<|end|>\n"] * 2
    assert got["r"].n_common == 3 and got["r"].chosen_text == got["r"].rejected_text == ""
    assert got["s"].n_common == 0 and got["s"].chosen_text == part("", "") and got["s"].rejected_text == ""
    assert got["t"].n_common == 0 and got["t"].prompt == ""
    assert preferences(frame.limit(0), pairs.limit(0)).count() == 0


def test_swapped_replies(spark):
    a, u = "assistant", "user"
    turns = [
        (1, 0, u, "Hi"), (1, 1, a, "Hello"), (1, 2, u, "More"), (1, 3, a, "Good"), (1, 4, u, "Bye"), (2, 0, u, "Ho"), (2, 1, a, "Well"),
        (3, 0, u, "no reply"), (5, 0, a, None), (5, 0, a, None), (7, 0, u, "x"), (7, 1, a, "alone"), (8, 0, u, "y"), (8, 1, a, "alone"), (None, 0, a, "z")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("reply_id", F.lit(0))
    out = reply_preferences(frame)
    assert python_free(out)
    got = {r.conv_id: r for r in out.collect()}
    part = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert set(got) == {1, 2, 3, 5, 7, 8}
    assert {k: (r.reply_id, r.n_common) for k, r in got.items()} == {1: (2, 3), 2: (1, 1), 3: (None, 1), 5: (None, 1), 7: (8, 2), 8: (7, 2)}
    assert got[1].prompt == part(u, "Hi") + part(a, "Hello") + part(u, "More")
    assert got[1].chosen_text == part(a, "Good") + part(u, "Bye") and got[1].rejected_text == part(a, "Well") + part(u, "Bye")
    assert [got[1].rejected_text[m.start : m.end] for m in got[1].rejected_mask] == ["Well<|end|>\n"]
    assert got[7].chosen_text == got[7].rejected_text == "" and got[3].prompt == part(u, "no reply")
    assert reply_preferences(frame.limit(0)).count() == 0


def test_columns_of_pairs_that_are_named_like_results_are_replaced(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi")], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(1, 1, "own", "kept", "of")], "chosen_id long, rejected_id long, prompt string, turns string, of_chosen string")
    row = preferences(frame, pairs).collect()[0]
    assert row.prompt.startswith("<|user|>") and row.turns == "kept" and row.of_chosen == "of"
