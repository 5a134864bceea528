"""Spelling variants: words one edit apart, found with blocked Gram matrices of letter counts.

Two words one edit apart have letter counts at a squared distance of at most two (2 for a replaced letter, 1 for an
inserted one), and the squared distances of all pairs of a block are one matrix product.  Words meet in blocks of two
adjacent lengths, m and m + 1: an edit leaves the first m // 2 letters or the last m - m // 2 as they are, so words of
such a block share that half.  A task takes many small blocks into one product and cuts large ones into tiles; the pairs
that the distance leaves are compared letter by letter.  A block beyond `part` words is dealt to several tasks, each of
which holds a share of the rows of the product and all its columns.

Edge cases: a null text has no words, an empty one neither; a row without an id takes part with an empty id; repeated rows
count each; ties between forms go to the word smallest by code points; an empty table has no words.  Only doc_id and text
are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import stored, text_slices


@dataclass(frozen=True)
class Variants:
    """Least letters and occurrences of a word, how much more frequent its form is, and in how many runs one letter is cut."""

    letters: int = 6
    occurrences: int = 5
    ratio: int = 5
    #: One of so many (document, run) pairs loses a letter, chosen by checksum.
    cut_every: int = 199
    #: Words of a block that one task takes as rows.
    part: int = 4096


#: Rows of a product, and letters compared at a time.
TILE, LETTERS_AT_ONCE = 256, 1 << 22
#: Distinct words that a task sums up before it hands them on, and characters of a text that it reads at a time.
HELD, STRETCH = 200_000, 1 << 20
#: a to z, then U+00C0 to U+00FF.
ALPHABET = 26 + 64


def stretches(text: str) -> Iterator[str]:
    """A long text in parts that end where no letter is; a run of letters is never cut."""
    at = 0
    gap = re.compile("[^A-Za-zÀ-ÿ]")
    while len(text) - at > STRETCH:
        stop = gap.search(text, at + STRETCH)
        if stop is None:
            break
        yield text[at : stop.start()]
        at = stop.start()
    yield text[at:] if at else text


def counted_words(docs: DataFrame, options: Variants) -> DataFrame:
    """(word, n): lower-cased (A-Z) runs of letters after the cuts; words of too few letters are left off."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % options.letters)

    def of_text(name: int | None, text: str, total: Counter) -> None:
        seed = zlib.crc32(f"{'' if name is None else name}:".encode())
        for part in stretches(text):
            # lower() of bytes leaves all but A-Z as they are
            for word, n in Counter(runs.findall(part.encode().lower().decode())).items():
                h = zlib.crc32(word.encode(), seed)
                if h % options.cut_every == 0:
                    cut = h % len(word)
                    word = word[:cut] + word[cut + 1 :]
                    if len(word) < options.letters:
                        continue
                total[word] += n

    def gather(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for part in text_slices(batch, "text"):
                for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if text:
                        of_text(name, text, total)
                if len(total) > HELD:
                    yield gather(total)
                    total = Counter()
        yield gather(total)

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def blocks(words: DataFrame, options: Variants) -> DataFrame:
    """(m, key, part, row, word, n): every word in the blocks where it may meet one that is one edit apart.

    `row` says that the word is a row of the product in this part; it is a column in all parts of its block.
    """
    size = F.length("word")
    places = []
    for m in (size, size - 1):
        head = F.floor(m / 2).cast("int")
        places.append(F.struct(m.alias("m"), F.concat(F.lit("<"), F.substring("word", F.lit(1), head)).alias("key")))
        places.append(F.struct(m.alias("m"), F.concat(F.lit(">"), F.substring("word", -(m - head), m - head)).alias("key")))
    placed = words.select("word", "n", F.explode(F.array(*places)).alias("at")).select("at.*", "word", "n")
    placed = placed.where(F.col("m") >= options.letters)
    # a block without a word of its shorter length, or with one word, has no pairs
    sizes = placed.groupBy("m", "key").agg(
        F.count("*").alias("words"), F.sum((F.length("word") == F.col("m")).cast("long")).alias("short"))
    sizes = sizes.where("words > 1 and short > 0").select("m", "key", F.ceil(F.col("words") / options.part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    return placed.join(sizes, ["m", "key"]).select(
        "m", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), own.alias("own"), "word", "n",
    ).select("m", "key", "part", (F.col("own") == F.col("part")).alias("row"), "word", "n")


def letter_counts(words: list[str]) -> np.ndarray:
    """How often each letter of the alphabet stands in each word."""
    sizes = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = np.where(points < 128, points - ord("a"), points - 0xC0 + 26)
    at = np.repeat(np.arange(len(words)), sizes) * ALPHABET + letter
    return np.bincount(at, minlength=len(words) * ALPHABET).reshape(len(words), ALPHABET).astype(np.float32)


def shared_ends(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many first and how many last letters the words of each pair share."""
    width = max(map(len, a + b))

    def first(x: list[str], y: list[str]) -> np.ndarray:
        differ = (np.array(x, f"U{width}").view(np.uint32) != np.array(y, f"U{width}").view(np.uint32)).reshape(len(x), width)
        return np.where(differ.any(1), differ.argmax(1), width)

    return first(a, b), first([w[::-1] for w in a], [w[::-1] for w in b])


def one_edit(m: np.ndarray, tail: np.ndarray, a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs of a word of m letters and another of m or m + 1 are one edit apart.

    Pairs of a block of last halves that share the first half too were met in the block of that half.
    """
    keep = np.zeros(len(a), bool)
    at = 0
    while at < len(a):
        stop = min(len(a), at + max(1, LETTERS_AT_ONCE // (int(m[at:].max()) + 1)))
        head, end = shared_ends(a[at:stop], b[at:stop])
        need = np.array([len(y) - 1 for y in b[at:stop]])
        keep[at:stop] = (head + end >= need) & ~(tail[at:stop] & (head >= m[at:stop] // 2))
        at = stop
    return keep


def near_in_blocks(m: np.ndarray, block: np.ndarray, tail: np.ndarray, row: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs one edit apart in whole blocks, which lie one after another, shorter words first, in order."""
    counts = letter_counts(words)
    square = (counts**2).sum(1)
    short = row & (np.array([len(w) for w in words]) == m)
    last = np.searchsorted(block, block, "right")
    left, right = [], []
    rows = np.flatnonzero(short)
    for at in range(0, len(rows), TILE):
        r = rows[at : at + TILE]
        for begin in range(int(r[0]), int(last[r[-1]]), 16 * TILE):
            c = slice(begin, min(begin + 16 * TILE, int(last[r[-1]])))
            away = square[r][:, None] + square[c][None, :] - 2 * counts[r] @ counts[c].T
            place = np.arange(c.start, c.stop)
            i, j = np.nonzero((away <= 2) & (place[None, :] > r[:, None]) & (place[None, :] < last[r][:, None]))
            left.append(r[i])
            right.append(place[j])
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    a, b = np.concatenate(left), np.concatenate(right)
    keep = one_edit(m[a], tail[a], [words[i] for i in a], [words[i] for i in b])
    return a[keep], b[keep]


def near_pairs(words: DataFrame, options: Variants) -> DataFrame:
    """(word, near, near_n) in both directions, each pair of words one edit apart once."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        names = rows.column("word").to_pylist()
        m = rows.column("m").to_numpy()
        keys = rows.column("key").to_pylist()
        part = rows.column("part").to_numpy()
        n = rows.column("n").to_numpy()
        new = [True] + [m[i] != m[i - 1] or part[i] != part[i - 1] or keys[i] != keys[i - 1] for i in range(1, len(names))]
        tail = np.array([k[0] == ">" for k in keys])
        a, b = near_in_blocks(m, np.cumsum(new), tail, rows.column("row").to_numpy(), names)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in a], pa.string()), pa.array(n[a]), pa.array([names[i] for i in b], pa.string()), pa.array(n[b])],
            ["a", "a_n", "b", "b_n"])

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, more]) if held is not None else more
            # up to the last place where a block ends: the rest may go on in the next batch
            end = held.num_rows - 1
            final = [held.column(x)[end].as_py() for x in ("m", "key", "part")]
            same = np.ones(held.num_rows, bool)
            for name, value in zip(("m", "key", "part"), final):
                same &= pc.equal(held.column(name), value).to_numpy()
            cut = int(same.argmax())
            if cut:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield solve(held)

    placed = blocks(words, options)
    dealt = placed.repartition("m", "key", "part").sortWithinPartitions("m", "key", "part", F.length("word"), "word")
    pairs = dealt.mapInArrow(run, "a string, a_n long, b string, b_n long")
    return pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) of each word end; every round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        joined = now.join(ahead, now["root"] == ahead["at"], "left")
        if joined.where("further is not null").limit(1).isEmpty():
            return now
        now = stored(joined.select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, options: Variants = Variants()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every frequent word of docs (columns doc_id, text)."""
    words = stored(counted_words(docs, options).where(F.col("n") >= options.occurrences), "words")
    nearest = near_pairs(words, options).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    enough = -F.col("best.less") >= options.ratio * F.col("n")
    formed = stored(words.join(nearest, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
