from __future__ import annotations

import os
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import language_id
from vigil.llm.language_id import LanguageModel, Training, calibrate, fit, identify, keep_identified, softmax, train, training_rows
from vigil.llm.neighbours import Graph, nearest
from vigil.llm.words import PLACE, mix

SF = "/root/testdata/sf0.01"
SMALL = Training(docs_per_language=150, epochs=6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify(docs, fit(docs)).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.accepted for r in held]) >= 0.97


def test_edges_of_language_id(spark, edge_docs, no_docs):
    model = fit(edge_docs, SMALL)
    assert set(model.languages) <= {"en", "de", "fr"}
    docs = edge_docs.withColumn("known", F.lit(1))
    rows = identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in model.languages) == letters and (r.score > 0) == letters and (letters or not r.accepted)
        assert letters or r.lang_pred == "und"
    assert keep_identified(edge_docs, SMALL).columns == edge_docs.columns
    unlearned = fit(no_docs, SMALL)
    assert unlearned.languages == [] and {r.lang_pred for r in identify(edge_docs, unlearned).collect()} == {"und"}
    assert identify(no_docs, model).count() == 0
    with pytest.raises(ValueError):
        identify(docs.withColumn("score", F.lit(1)), model)


def test_training_is_repeatable():
    rng = random.Random(1)
    sample = [(" ".join(rng.choices(["the", "and", "of", "thing"], k=30)), "en", i % 4 == 0) for i in range(60)]
    sample += [(" ".join(rng.choices(["der", "und", "von", "ding"], k=30)), "de", i % 4 == 0) for i in range(60)]
    a, b = train(sample, SMALL), train(sample, SMALL)
    p = a.probabilities(["the thing of the", "von der und", None, "12 3"])
    assert (p == b.probabilities(["the thing of the", "von der und", None, "12 3"])).all()
    assert a.languages[p[0].argmax()] == "en" and a.languages[p[1].argmax()] == "de" and not p[2:].any()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_a_language_that_was_not_learned_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null")
    model = fit(docs.where("lang != 'es'"))
    accepted = {r.lang: r.share for r in identify(docs, model).groupBy("lang").agg(F.avg(F.col("accepted").cast("int")).alias("share")).collect()}
    assert "es" not in model.languages and accepted["es"] < 0.5
    assert all(share >= 0.95 for lang, share in accepted.items() if lang != "es")
    junk = [" ".join("".join(random.Random(f"{i} {k}").choices("qxzjkwvy", k=7)) for k in range(60)) for i in range(50)]
    assert (model.probabilities(junk).max(1) < model.least_score).all()


def test_the_least_score_rejects_few_right_rows_but_unsure_ones():
    rng = np.random.default_rng(4)
    labels = np.arange(400) % 4
    shares = 0.25 * rng.uniform(0, 0.6, 400)[:, None] * np.ones(4)
    shares[np.arange(400), labels] += 1 - shares.sum(1)
    model = LanguageModel(list("abcd"), np.eye(4, dtype=np.float32), np.eye(4), np.zeros(4), Training())
    calibrate(model, [(np.arange(4), share) for share in shares], labels)
    score = softmax(shares / model.temperature)
    assert 0 < (score.max(1) < model.least_score).sum() <= 4 or model.least_score == score.max(1).min()
    assert softmax(np.array([[0.27, 0.25, 0.24, 0.24]]) / model.temperature).max() < model.least_score


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(i, "der und von ding " * (3 if i % 2 else 4), "de") for i in range(80)]
    rows += [(100 + i, "the and of thing " * 40, "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    options = Training(docs_per_language=60, epochs=3, max_chars=100)
    assert fit(docs, options).languages == ["de", "en"]
    assert max(len(text) for text, _, _ in training_rows(docs, F.lit(True), options)) == 100


def exact(rows, k, wanted):
    own = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    own = list({(i, v.tobytes()): (i, v) for i, v in own}.values())
    out = {}
    for q, a in own:
        if wanted(q):
            near = [(-float(a @ b) / np.sqrt((a @ a) * (b @ b)), i) for i, b in own if i != q and len(a) == len(b)]
            out[q] = sorted(near)[:k]
    return out


def compared(spark, rows, k, options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 10 == 0, k, options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], k, lambda q: q % 10 == 0)
    hit = total = 0
    for q, near in want.items():
        mine = got.get(q, [])
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert all(abs(s) <= 1 + 1e-12 for _, _, s in mine)
        hit += sum(s >= -near[-1][0] - 1e-9 for _, _, s in mine)
        total += len(near)
    return hit / max(1, total), got, want


def test_recall_over_shards(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + 0.5 * rng.normal(size=24)).tolist()) for i in range(1500)]
    recall, _, want = compared(spark, rows, 5, Graph(shard=400, block=40))
    assert recall >= 0.95 and len(want) == 150


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 300)]  # a hot group of copies
    rows += [(1000, None), (1010, []), (1020, [0.0, 0.0, 0.0]), (1030, [float("nan"), 1.0, 0.0]), (1040, [None, 1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(2000 + i, [0.0, 1.0, float(i)]) for i in range(20)] + [(3000, [1.0, 2.0]), (3010, [2.0, 1.0]), (2000, [0.0, 1.0, 0.0])]
    recall, got, want = compared(spark, rows, 5, Graph())
    assert recall == 1.0 and set(got) == set(want)
    assert [v for _, v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for _, v, _ in got[10]] == [0, 1, 2, 3, 4]
    assert [v for _, v, _ in got[3000]] == [3010]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(empty, F.col("vec_id") % 10 == 0).count() == 0


def plain_probabilities(model, text):
    """The average over all subwords, one after another."""
    o = model.options
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    total, n = np.zeros(model.embedding.shape[1]), 0
    for run in runs:
        word = f"<{run}>"
        for size in range(o.shortest, o.longest + 1):
            for i in range(len(word) - size + 1):
                code = np.zeros(1, np.uint64)
                for j, c in enumerate(word[i : i + size]):
                    code += np.uint64(ord(c)) * PLACE[j + 1]
                total += model.embedding[int(mix(code + np.uint64(size))[0] % np.uint64(o.buckets))]
                n += 1
    if not n:
        return np.zeros(len(model.languages))
    logits = (total / n @ model.layer + model.bias) / model.temperature
    return softmax(logits[None, :])[0]


def made_model(languages):
    rng = np.random.default_rng(languages)
    o = Training()
    return LanguageModel([f"l{i:03d}" for i in range(languages)], rng.normal(size=(o.buckets, o.size)).astype(np.float32),
                         rng.normal(size=(o.size, languages)), rng.normal(size=languages), o)


def test_scores_are_plain_sums_over_subwords(monkeypatch):
    model = made_model(7)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcéßжñ") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 30))) for _ in range(25)]
    texts += [None, "", "12 ½ ² Ⅷ ①", "x" * 300 + " y", "ÄÖÜ, don't_stop4me", "½abc²def"]
    want = np.array([plain_probabilities(model, t) for t in texts])
    assert np.allclose(model.probabilities(texts), want, atol=1e-9)
    monkeypatch.setattr(language_id, "TOGETHER", 40)
    monkeypatch.setattr(language_id, "HASHED", 16)
    monkeypatch.setattr(language_id, "REMEMBERED", 30)
    assert np.allclose(made_model(7).probabilities(texts), want, atol=1e-9)


def test_numerals_are_no_letters():
    model = made_model(3)
    assert not model.probabilities(["½", "²³", "Ⅷ ⅷ", "①", "٣", "_", "5"]).any()
    assert (model.probabilities(["Ω", "語", "ª", "ǅ"]).sum(1) > 0.99).all()


@pytest.mark.parametrize(("languages", "text"), [(100, "word"), (4, "long"), (4, "run")])
def test_memory_of_long_texts_and_many_languages(languages, text):
    """Peak of what Python and numpy hold: the text a few times, and 100 MB."""
    rng = random.Random(1)
    if text == "run":
        whole = "x" * 10_000_000
    else:
        whole = " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(20_000 if text == "word" else 1_250_000))
    model = made_model(languages)
    tracemalloc.start()
    try:
        assert model.probabilities([whole]).sum() == pytest.approx(1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6 + 8 * len(whole)


def test_all_languages_are_learned_from_a_bounded_sample(spark):
    rows = [(i, f"w{i % 250}x " * 20, f"l{i % 250:03d}") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    options = Training(docs_per_language=3, sample_chars=250 * 250, epochs=1)
    sample = training_rows(docs, F.lit(True), options)
    assert len({lang for _, lang, _ in sample}) == 250 and sum(len(t) for t, _, _ in sample) <= 250 * 250


def test_ties_below_the_best(spark):
    rows = [(0, [1.0, 0.0]), (1, [4.0, 0.0])] + [(i, [2.0 ** (i % 7), 2.0 ** (i % 7)]) for i in range(40, 20, -1)]
    recall, got, want = compared(spark, rows, 5, Graph())
    assert [v for _, v, _ in got[0]] == [1, 21, 22, 23, 24]
