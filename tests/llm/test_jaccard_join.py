from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.llm.components import components
from vigil.llm.jaccard_join import Block, Join, keep_one, near_groups
from vigil.llm.words import Words, windows


def sets_of(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(doc, sets_of(text)) for doc, text in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets[:i]):
            if s and t and a is not None and b is not None and 100 * len(s & t) >= 75 * len(s | t):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i)) if doc is not None else None) for i, (doc, s) in enumerate(sets)), key=repr)


def check(docs, options):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_groups(docs, options).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_equal_brute_force(edge_docs, no_docs):
    check(edge_docs, Join())
    assert near_groups(no_docs).count() == 0


def test_shingles_of_one_set_with_one_number(spark):
    """Two shingles of a set that are cut to one number must not cost the set its links (exactly 75 percent here)."""
    names = [f"w{i}" for i in range(1_200_000)]
    hashes = windows(Words(pa.array([" ".join(names)]), lower=True).hashes(), 5)
    order = np.argsort(hashes)
    number = hashes[order] >> np.uint64(28)  # 4 bits of cells and 32 bits in a small corpus
    same = np.flatnonzero(number[1:] == number[:-1])
    rows = []
    for i, at in enumerate(same[:4].tolist()):
        a, b = int(order[at]), int(order[at + 1])
        both = names[a : a + 5] + names[b : b + 5]
        rows += [(10 * i, " ".join(both)), (10 * i + 1, " ".join([*both, f"x{i}", f"y{i}"])), (10 * i + 5, " ".join(both[:5] + [f"z{i}"] * 5))]
    assert len(rows) >= 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, Join())
    assert {r.doc_id: r.component_id for r in near_groups(docs).collect()}[11] == 10


def test_large_regions_in_chunks(spark):
    """Chains of near copies, more than a leaf, with frequent shingles, so that all rounds have work."""
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(5000)}"
    rows, doc = [], 0
    for _ in range(4):
        words = [word() for _ in range(60)]
        for _ in range(45):
            rows.append((doc, " ".join(words)))
            doc += 1
            words[rng.randrange(len(words))] = word()
    passage = " ".join(word() for _ in range(30))
    for _ in range(60):
        rows.append((doc, passage + " " + " ".join(word() for _ in range(rng.randrange(4, 12)))))
        doc += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    check(docs, Join(leaf=16, crowd=3, pivots=3))
    check(docs, Join(leaf=64, small=10, part=0.3))
    check(docs, Join(small=30, flush=500, crowd=2))


@pytest.mark.parametrize("seed", range(4))
def test_block_join_is_exact(seed):
    rng = np.random.default_rng(seed)
    centres = [rng.choice(4000, 80, replace=False) for _ in range(6)]
    sets = []
    for i in range(150):
        own = centres[i % 6].copy()
        own[rng.choice(80, rng.integers(0, 25), replace=False)] = rng.integers(10_000, 90_000)
        sets.append(np.unique(own[: rng.integers(50, 81)]).astype(np.uint64))
    block = Block(sets, list(range(len(sets))), Join(pivots=4))
    everyone = np.arange(len(sets))
    block.join(everyone, everyone)
    root = {}
    up = list(range(len(sets)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    for i in range(len(sets)):
        assert root.setdefault(find(i), block.root[i]) == block.root[i]
    assert len(set(root.values())) == len(root)


def test_one_document_of_each_group_stays(edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    stay = {doc for doc, _, group in brute(rows) if doc is not None and doc == group}
    kept = keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == stay and ids.count(None) == 2
    assert ids.count(14) == 1 or len({t for d, t in rows if d == 14}) == 2


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (1, text("a")), (2, text("a") + " end"), (2, text("b")),  # 2 loses its copy of 1 only
        (3, text("c")), (3, text("c") + " end"), (3, text("d")), (3, text("d")),  # two near texts of one id are one
        (4, text("c")), (5, text("e")), (5, text("e").upper()), (5, None), (5, ""), (None, text("a")), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest_of", F.lit("x"))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    near = [x for x in got if x[0] == 3 and x[1].startswith("c")]
    assert len(near) == 1 and near[0] in rows
    same = [x for x in got if x[0] == 5 and x[1]]
    assert same == [(5, text("e").upper())]
    want = [(1, text("a")), (2, text("b")), *near, (3, text("d")), *same, (5, None), (5, ""), (None, text("a")), (None, text("a"))]
    assert got == sorted(want, key=repr)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, i) for i in range(501, 700)] + [(900, 900), (None, 3), (901, 902), (902, 901)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got)
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 500 for i in range(500, 700))
    assert got[901] == got[902] == 901 and 900 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
