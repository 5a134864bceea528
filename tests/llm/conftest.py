from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rng():
    return random.Random(20)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with nulls, empty and long texts, ties, copies and repeated rows; and brute-force helpers' input."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    line = "This Line Is Shared By Many Documents, and is long enough."

    def prose(n):
        words = [rng.choice(vocabulary) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))

    base = prose(160)
    near = [base.replace(f" w{i} ", " changed ", 1) + f" tail{i}" for i in range(12)]
    rows = [
        (None, "a row without an id " * 20, "en", "s0", 1), (None, None, None, None, None), (1, None, "en", "s0", 0),
        (2, "", "en", "s0", 0), (3, " \n\t \n", None, "s1", 5), (4, "one two", "en", None, 7), (5, "One\tTWO", "en", "s1", 7),
        (6, "ein zwei drei vier fünf sechs sieben", "de", "s1", 9), (7, "word " * 30_000, "en", "s0", 0),
        (8, "x" * 50_000, "en", "s0", 0), (9, "12 345 !!", "en", "s0", 0), (10, "été ß Ünï İ 語 \U0001f600 <|endoftext|> y", "fr", "s2", 0),
        (11, base, "en", "s0", 0), (12, base, "en", "s0", 0), (13, base.upper(), "en", "s2", 0),
        (14, line + "\n" + prose(60), "en", "s0", 0), (14, line + "\n" + prose(60), "en", "s0", 0)]
    rows += [(20 + i, text, "en", "s0", 0) for i, text in enumerate(near)]
    rows += [(40 + i, f"  {line.upper() if i % 2 else line}\t\n{prose(80)}\n{line}", "en", f"s{i % 3}", 0) for i in range(9)]
    rows += [(60, base, "en", "s0", 0), (60, base, "en", "s0", 0), (61, "#%& " * 90, "en", "s0", 0)]
    rows += [(100 + i, prose(70 + i), "en", f"s{i % 3}", 0) for i in range(0, 60, 2)]
    rows += [(100 + i, prose(70 + i).replace("w", "über"), "de", f"s{i % 3}", 0) for i in range(1, 60, 2)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
