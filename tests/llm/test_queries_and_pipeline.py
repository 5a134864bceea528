"""The registered corpus queries and the pipeline over small tables with every edge case."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")
public_tokenizers = pytest.importorskip("public_tokenizers")
from test_jaccard_join import brute  # noqa: E402
from test_quality_and_lines import cleaned  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from compare import plain, rows_of  # noqa: E402
from vigil.llm import sql  # noqa: E402
from vigil.llm.catalog import ORACLES, QUERIES  # noqa: E402
from vigil.llm.language_id import fit  # noqa: E402
from vigil.llm.quality_rules import QualityRules  # noqa: E402

TABLES = ("documents", "pages", "conversations", "embeddings")
PAGES = [
    (1, "http://a.example.com/en/1#x", "<html></html>"), (2, None, None), (3, "https://x.org/1", '<link rel="canonical" href="http://example.com/en/2">'),
    (3, "https://x.org/1", '<link rel="canonical" href="http://example.com/en/2">'), (4, "http://x.org/2", "<meta http-equiv=refresh content='1;url=/1'>"),
    (None, "x.org", ""), (5, "http://www.example.com/en/", ""), (6, "http://b.net/fr/?q", "")]
TURNS = [
    (0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (2, 0, None, None), (2, 0, None, None),
    (5, 3, "assistant", "late"), (5, 1, "system", ""), (None, 0, "user", "x"), (6, 0, "user", "same"), (7, 9, "user", "same")]
VECTORS = [(i, [float(i % 7), 1.0, float(i % 3)], i) for i in range(120)] + [(150, None, 0), (200, [0.0, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0)]


@pytest.fixture(scope="module")
def folders(spark, edge_docs, tmp_path_factory):
    """A folder of tables with edge cases, and one of the same tables without rows."""
    top = tmp_path_factory.mktemp("tables")
    frames = {
        "documents": edge_docs,
        "pages": spark.createDataFrame(PAGES, "page_id long, url string, html string"),
        "conversations": spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"),
        "embeddings": spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int"),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{top}/full/{name}.parquet")
        frame.limit(0).coalesce(1).write.parquet(f"{top}/none/{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_edge_cases(spark, folders, name):
    got = QUERIES[name](spark, f"{folders}/full")
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{folders}/full/{t}.parquet/*.parquet'")
        result = con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert rows_of(got.columns, rows) == rows_of(names, result.fetchall())
    assert QUERIES[name](spark, f"{folders}/none").count() == 0


def test_pipeline_stages_against_brute_force(spark, folders, tmp_path):
    docs = spark.read.parquet(f"{folders}/full/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    inputs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, f"{folders}/full")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    outputs = [*inputs[1:], docs]
    table = lambda df: Counter(tuple(plain(v) for v in r) for r in df.collect())

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folders}/full/documents.parquet/*.parquet'")
    kept = con.execute(f"select doc_id, kept, count(*) from ({sql.op1(QualityRules())}) group by all").fetchall()
    want = Counter()
    for doc, keep, n in kept:
        want[doc] += n if keep else 0
    assert Counter(r.doc_id for r in outputs[0].collect()) == +want

    model = fit(inputs[1])
    assert outputs[0].count() > 50 and outputs[1].count() > 50
    scored = [(r, model.probabilities([r.text])[0]) for r in inputs[1].collect()]
    assert table(outputs[1]) == Counter(tuple(r) for r, p in scored if p.any() and p.max() >= model.least_score)

    before = [(r.doc_id, r.text) for r in inputs[2].collect()]
    after = [(r.doc_id, r.text) for r in outputs[2].collect()]
    assert sum(t.count("\n") + 1 for _, t in before) - sum(t.count("\n") + 1 for _, t in after if t) >= sum(x[2] for x in cleaned(before)) - len(after)
    assert all(r.n_chars == len(r.text) for r in outputs[2].collect()) and len(before) == len(after)

    groups = brute(after)
    stay = {doc for doc, _, group in groups if doc == group}
    assert {r.doc_id for r in outputs[3].collect()} == {*stay, *(d for d, _ in after if d is None)}

    tokens = Counter()
    for r in inputs[4].collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        tokens[(r.doc_id, len(ids))] += len(ids)
    pieces = Counter()
    for r in docs.collect():
        pieces[(r.doc_id, r.doc_tokens)] += r.length
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.offset + r.length <= 2048
    assert pieces == tokens


def test_run_gives_the_last_stage(spark, folders):
    rows = corpus_pipeline.run(spark, f"{folders}/full")
    assert rows.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns)
    assert corpus_pipeline.run(spark, f"{folders}/none").count() == 0


def test_sketch_cells_are_exact_for_small_and_ordered_for_large(spark):
    from vigil.llm.quality_rules import cell, cell_start

    rows = spark.range(1, 100_000, 7).select(F.col("id").alias("v"), F.expr(cell("id")).alias("c"))
    rows = rows.withColumn("s", F.expr(cell_start("c"))).orderBy("v").collect()
    assert all(r.s == r.v for r in rows if r.v < 64)
    assert all(r.s <= r.v < r.s * 33 / 32 + 1 for r in rows)
    assert all(a.c <= b.c for a, b in zip(rows, rows[1:]))
