from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vigil.llm.line_dedup import drop_shared_lines
from vigil.llm.quality_rules import QualityRules, keep_good, judged, measured

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    twice = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(twice))


def test_counts_equal_brute_force(edge_docs):
    rows = measured(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == counts(r.text), r.doc_id


def test_base_rules_and_verdicts(edge_docs):
    rows = judged(edge_docs, QualityRules(min_rows=10)).collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept in (True, False) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[i] for i in range(100, 160)) and not kept[61] and not kept[7] and not kept[8]


def test_fences_follow_the_group(spark):
    prose = " ".join(f"wort{i}" for i in range(80))
    tables = " ".join(f"| z{i}" for i in range(80))
    rows = [(i, prose + f" e{i}", "en", "web") for i in range(30)] + [(100 + i, tables + f" e{i}", "en", "tables") for i in range(30)]
    rows += [(500, tables + " x", "en", "web"), (501, tables, "en", "tables")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in judged(docs, QualityRules(min_rows=20)).collect()}
    assert not kept[500] and kept[501] and all(kept[i] for i in range(30))


def test_filter_keeps_columns_and_refuses_clashes(edge_docs, no_docs):
    assert keep_good(edge_docs).columns == edge_docs.columns
    assert keep_good(no_docs).count() == 0
    extra = edge_docs.withColumn("measure", F.lit(1)).withColumn("cell", F.lit("c"))
    assert keep_good(extra).columns == extra.columns
    with pytest.raises(ValueError):
        keep_good(edge_docs.withColumn("n_words", F.lit(1)))


def cleaned(rows, least=5, chars=40):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (doc is not None and len(holders[key(x)]) >= least and max(holders[key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    extra = edge_docs.withColumn("key", F.lit("k")).withColumn("last", F.lit(3))
    done = drop_shared_lines(extra)
    assert done.columns == [*extra.columns, "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in done.collect()]
    assert sorted(got, key=repr) == cleaned(rows)
    assert any(n for _, _, n, _ in got)
    assert {r.doc_id for r in done.where("text is null").collect()} == {None, 1}
    assert drop_shared_lines(no_docs).count() == 0
