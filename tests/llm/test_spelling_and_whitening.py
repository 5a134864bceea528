"""Spelling variants against brute force, and whitening against a plain eigendecomposition."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vigil.llm import spelling
from vigil.llm.spelling import Variants, stretches, variants
from vigil.llm.whitening import eigenvectors, polar, whitened


def brute_words(docs, options):
    total = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % options.cut_every == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= options.letters and n >= options.occurrences}


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, options):
    words = brute_words(docs, options)
    near = {w: [x for x in words if edits(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= options.ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def some_docs(seed, count, letters="abÀé"):
    rng = random.Random(seed)
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(count)]
    rows = []
    for i in range(60):
        picked = [rng.choice(made[: 1 + rng.randrange(len(made))]) for _ in range(rng.randint(0, 80))]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in picked)))
    chain = [(100 + i, "qqqqqq " * 6 + "qqqqqr " * 40 + "qqqqrr " * 260) for i in range(2)]
    return [*rows, *chain, (None, "aaaaaa, aaaaaa"), (7, None), (8, ""), *rows[:2]]


@pytest.mark.parametrize(("seed", "part"), [(1, 4096), (2, 3)])
def test_variants_against_brute_force(spark, seed, part):
    options = Variants(part=part, cut_every=5)
    docs = some_docs(seed, 150)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string")
    got = [tuple(r) for r in variants(frame, options).collect()]
    want = brute(docs, options)
    assert any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])
    assert len(got) == len(want) and set(got) == want


def test_near_in_blocks_in_small_tiles(monkeypatch):
    words = sorted({"".join(p) for p in itertools.product("abc", repeat=3)}, key=lambda w: (len(w), w))
    words = [f"zzz{w}" for w in words] + [f"zzz{w}d" for w in words]
    n = len(words)
    args = (np.full(n, 6), np.zeros(n, int), np.zeros(n, bool), np.ones(n, bool), words)
    whole = spelling.near_in_blocks(*args)
    monkeypatch.setattr(spelling, "TILE", 4)
    monkeypatch.setattr(spelling, "LETTERS_AT_ONCE", 50)
    tiled = spelling.near_in_blocks(*args)
    pairs = lambda x: {(words[i], words[j]) for i, j in zip(*x)}
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if edits(a, b) and len(a) == 6}
    assert pairs(whole) == pairs(tiled) == want and len(whole[0]) == len(want)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 20)
    text = "abc " * 30 + "x" * 100 + " end." + "y" * 50
    assert "".join(stretches(text)) == text
    assert [w for s in stretches(text) for w in re.findall("[a-z]+", s)] == re.findall("[a-z]+", text)


def test_no_words(spark, no_docs):
    assert variants(no_docs).count() == 0
    assert variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0


def spectra():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    few = rng.normal(size=(24, 5))
    return {
        "random": (q * rng.uniform(1, 9, 24)) @ q.T, "wide": (q * np.logspace(9, -3, 24)) @ q.T, "few": few @ few.T,
        "equal": np.eye(24) * 3, "two": (q * np.repeat([5.0, 2.0], 12)) @ q.T, "close": (q * (1 + np.arange(24) * 1e-9)) @ q.T,
        "diagonal": np.diag(np.arange(24.0)), "zero": np.zeros((24, 24)), "one": np.array([[4.0]]),
    }


@pytest.mark.parametrize("name", spectra())
def test_divide_and_conquer_gives_eigenvectors(name):
    a = spectra()[name]
    a = (a + a.T) / 2
    values, vectors = eigenvectors(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    size = max(np.abs(want).max(), 1e-30)
    assert np.abs(values - want).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size


def test_polar_factor_is_the_sign():
    a = spectra()["random"] - 5 * np.eye(24)
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    assert np.abs(polar(a) - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, size string")


def test_whitening_against_plain_numpy(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 20)) @ rng.normal(size=(20, 20))
    base[150:] = base[:50]  # equal vectors count once in the fit
    rows = [(i, [float(x) for x in v], "n", "s") for i, v in enumerate(base)]
    odd = [(500, None, "", ""), (501, [None] * 20, "", ""), (502, [float("nan")] * 20, "", ""), (503, [float("inf")] * 20, "", ""),
           (504, [], "", ""), (505, [1.0, 2.0], "", ""), (None, rows[0][1], "", "")]
    got = whitened(frame_of(spark, rows + odd).repartition(7)).toPandas()
    x = np.floor(64 * base.astype(np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    want = ((x - sums / n) @ vectors) / np.sqrt(values)
    assert len(got) == 201 * 16 and got.vec_id.isna().sum() == 16 and set(got.n) == {n}
    kept = got.dropna().sort_values(["vec_id", "component"])
    mine = kept.whitened.to_numpy().reshape(200, 16)
    assert np.abs(mine * np.sign((mine * want).sum(0)) - want).max() < 1e-10
    assert kept.deviation.to_numpy().reshape(200, 16)[:, 0].tolist() == ((n * x - sums) ** 2).sum(1).tolist()
    assert np.allclose(kept.explained[:16], values / np.trace(v), rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_whitening_without_variance_and_overflow(spark):
    assert whitened(frame_of(spark, [])).count() == 0
    assert whitened(frame_of(spark, [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")])).count() == 0
    line = whitened(frame_of(spark, [(i, [float(i), 2.0 * i, 5.0], "", "") for i in range(9)]))
    assert {r.component for r in line.collect()} == {1}
    with pytest.raises(OverflowError):
        whitened(frame_of(spark, [(1, [1e9, 2.0], "", ""), (2, [-1e9, 2.0], "", "")]))
