from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from vigil.llm.bpe import (  # noqa: E402
    REMEMBERED, Encoder, Lexicon, compile_lexicon, decode, encode, frequent_words, ship_lexicon, token_digests, vocabulary)
from vigil.llm.packing import Packing, hilbert_keys, pack  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "it's we'll DON'T", "Σίσυφος ΟΔΟΣ", "a\x1cb\x1f c", "<|endoftext|>", "x<|startoftext|>y", "1½²₂ Ⅷ", "e\u0301 가", "_a_b__",
    "日本語", "\U0001f600\u200d", "\x00", "<|endoftext", "a" * 700, "th" * 300, "\u0660\u0661", "ǅ ŉ ﬁ", "\u2028x\u00a0y", "ꟋꟌ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_decoding_equal_the_library(library, rng):
    texts = ODD + ["".join(rng.choices(ODD, k=4)) for _ in range(200)] + [" ".join(rng.choices(ODD, k=4)) for _ in range(200)] + [None, "", " \n"]
    words = vocabulary(PATH)
    for text, ids in zip(texts, Encoder(words, None).encode(texts)):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == expected, text
        assert decode(expected, words) == library.decode(expected, skip_special_tokens=False)


def test_lexicon_finds_its_words_only(tmp_path):
    words = vocabulary(PATH)
    own = sorted({w.encode() for w in "a an and ant band sand the then there their été ß walking talking stalking".split()})
    file = tmp_path / "lexicon"
    file.write_bytes(compile_lexicon(own, words.merge(own)))
    lexicon = Lexicon(str(file))
    others = [b"", b"b", b"andy", b"walkin", b"zzz", "ét".encode()]
    assert lexicon.find(own) == words.merge(own) and lexicon.find(others) == [None] * len(others)
    assert len(lexicon.final) < 1 + sum(map(len, own)) * 0.7  # suffixes are shared
    empty = tmp_path / "empty"
    empty.write_bytes(compile_lexicon([], []))
    assert Lexicon(str(empty)).find([b"a"]) == [None]


def test_encoding_a_table(spark, edge_docs, no_docs, library):
    lexicon = ship_lexicon(spark, frequent_words(edge_docs, PATH, 300), PATH)
    docs = edge_docs.withColumn("piece", F.lit(1))
    rows = encode(docs, PATH, lexicon)
    assert rows.columns == [*docs.columns, "ids"]
    kind = vocabulary(PATH).kind
    for r in rows.collect():
        assert np.frombuffer(r.ids, kind).tolist() == library.encode(r.text or "", add_special_tokens=False).ids
    assert token_digests(rows, PATH).count() == docs.count()
    nothing = ship_lexicon(spark, frequent_words(no_docs, PATH, 300), PATH)
    assert encode(no_docs, PATH, nothing).count() == 0
    with pytest.raises(ValueError):
        encode(docs.withColumn("ids", F.lit(1)), PATH, lexicon)


def test_digests_of_texts_need_one_worker(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text")
    lexicon = ship_lexicon(spark, frequent_words(docs, PATH, 50), PATH)
    whole = token_digests(docs, PATH, lexicon)
    parts = token_digests(encode(docs, PATH, lexicon).select("doc_id", "ids"), PATH)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))
    # one step over texts, where two would keep two workers for a task
    assert token_digests(docs, PATH, lexicon)._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1


def test_hilbert_curve_visits_neighbours():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing_is_whole_and_gapless(edge_docs, no_docs, library):
    options = Packing(length=64)
    pieces = pack(edge_docs, PATH, options).collect()
    sequences, by_ids = defaultdict(list), defaultdict(int)
    for p in pieces:
        assert p.length == len(p.ids) // 4 and 0 < p.length <= 64
        sequences[p.sequence_id].append((p.offset, p.length))
        by_ids[(p.doc_id, p.start, p.length, p.doc_tokens, zlib.crc32(p.ids))] += 1
    assert sorted(sequences) == list(range(len(sequences)))
    for name, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or name == len(sequences) - 1
    total = 0
    for r in edge_docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        own = [k for k in by_ids if k[0] == r.doc_id and k[3] == len(ids)]
        assert all(zlib.crc32(ids[k[1] : k[1] + k[2]].tobytes()) == k[4] for k in own) or r.doc_id in (None, 14)
    assert total == sum(p.length for p in pieces)
    assert pack(no_docs, PATH, options).count() == 0


def test_what_a_worker_keeps_of_a_vocabulary():
    """Both memories hold one string for a piece that is its stretch, and no second model lies beside the tables."""
    words = vocabulary(PATH)
    stretches = ["plain", "Größe", "größe", "x1", "日本語", "a_b"]
    pieces = words.all_pieces(stretches)
    assert pieces == [words.pieces(x) for x in stretches]
    assert pieces[0][0] is stretches[0] and pieces[2][0] is stretches[2]
    assert not any(isinstance(x, Tokenizer) for x in vars(words).values())


def test_memory_of_packing_beside_other_stages(spark, edge_docs, monkeypatch):
    """A bound on what is remembered holds and changes no ids; the pipeline's packing sets one far below the default."""
    import corpus_pipeline

    words = vocabulary(PATH)
    small, plain = Encoder(words, None, 500), Encoder(words, None)
    for at in range(0, 2000, 20):
        texts = [f"word{i} x{i * i} größe" for i in range(at, at + 20)]
        assert [x.tolist() for x in small.encode(texts)] == [x.tolist() for x in plain.encode(texts)]
    for memory in (small.pieces, small.stretches):
        assert sum(len(x) + 8 for x in [*memory.known, *memory.older]) <= 4 * 500
    used = {}
    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, path, **bounds: used.update(bounds) or pack(docs, path, **bounds))
    assert corpus_pipeline.packing(spark, edge_docs, "").count() > 0
    assert used["at_once"] <= 1 << 20 and used["remembered"] <= REMEMBERED // 4
