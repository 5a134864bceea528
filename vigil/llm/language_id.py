"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its subwords (letter n-grams of every word with its borders, hashed to
buckets); one linear layer and a softmax give the languages.  Training takes a bounded sample of labelled rows on
the driver (`docs_per_language`, texts of at most `max_chars`); a part of the sample is held back to calibrate
the softmax temperature and the score below which a prediction is rejected.  All languages of the labelled rows are
learned; `sample_chars` bounds the characters of the sample, shared out evenly.  The embeddings and the layer go to
the workers.  Whole texts are scored in stretches, and a worker hashes each distinct run of letters once; what it holds
grows neither with the length of a text nor with subwords times languages.

Edge cases: a text that is null or has no letter gets language `und`, score 0 and is rejected; without any labelled
row the model knows no language and answers `und` for all; rows with a null language are never learned from;
repeated rows are scored alike; an empty table gives no rows.  Other columns are left as they are; the columns
added here must not exist before (ValueError).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.shared import checked_broadcast, let_go, stored, text_slices
from vigil.llm.words import PLACE, mix

UNKNOWN = "und"
ADDED = ("lang_pred", "score", "accepted")
LETTERS = re.compile(r"[^\W\d_]+")
#: Runs of letters that a worker remembers before it forgets all of them.
REMEMBERED = 300_000
#: Characters that are looked at together: of texts, and of new runs of letters.
TOGETHER, HASHED = 1 << 18, 1 << 15


@dataclass(frozen=True)
class Training:
    """Bounds and rates of the training."""

    docs_per_language: int = 400
    sample_chars: int = 32_000_000
    max_chars: int = 20_000
    buckets: int = 1 << 15
    size: int = 16
    shortest: int = 1
    longest: int = 4
    epochs: int = 10
    batch: int = 16
    rate: float = 2.0
    embedding_rate: float = 60.0
    seed: int = 3
    target_error: float = 0.02
    lost: float = 0.01


@dataclass
class LanguageModel:
    languages: list[str]
    embedding: np.ndarray  # buckets x size
    layer: np.ndarray  # size x languages
    bias: np.ndarray
    options: Training
    temperature: float = 1.0
    least_score: float = 0.0
    #: Rows of `vectors` by run of letters: what a worker remembers; not sent to others.
    known: dict[str, int] = field(default_factory=dict, repr=False)
    vectors: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "vectors": None}

    def remember(self, runs: set[str]) -> None:
        """Sum the embeddings of the subwords of new runs of letters; the last column is the number of subwords."""
        new = list(runs - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(runs)
        stop = len(self.known) + len(new)
        if self.vectors is None or stop > len(self.vectors):
            grown = np.zeros((max(stop, 2 * len(self.known), 1024), self.embedding.shape[1] + 1))
            if self.known:
                grown[: len(self.known)] = self.vectors[: len(self.known)]
            self.vectors = grown
        own = self.vectors[len(self.known) : stop]
        own[:] = 0
        for part in pieces_of(new, self.options):
            ids, row = subwords(*part, self.options)
            if len(ids):
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                own[row[first], :-1] += np.add.reduceat(self.embedding[ids], first, dtype=float)
                own[row[first], -1] += np.diff(np.append(first, len(row)))
        self.known.update(zip(new, range(len(self.known), stop)))

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probabilities of the languages; a row of zeros if a text has no letter."""
        total = np.zeros((len(texts), self.embedding.shape[1] + 1))
        for places, parts in together(texts):
            runs = [letter_runs(part) for part in parts]
            flat = list(chain.from_iterable(runs))
            if flat:
                self.remember(set(flat))
                at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
                full = np.array([len(w) for w in runs])
                some = np.flatnonzero(full)
                sums = np.add.reduceat(self.vectors[at], (np.cumsum(full) - full)[some])
                np.add.at(total, np.array(places)[some], sums)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(total[:, -1])
        if len(some) and self.languages:
            out[some] = softmax((total[some, :-1] / total[some, -1:] @ self.layer + self.bias) / self.temperature)
        return out


def stretches(text: str) -> Iterator[str]:
    """A long text in parts that end before a character that is no letter; a run of letters is never cut."""
    at, gap = 0, re.compile(r"[\W\d_]")
    while len(text) - at > TOGETHER:
        stop = gap.search(text, at + TOGETHER)
        if stop is None:
            break
        yield text[at : stop.start()]
        at = stop.start()
    yield text[at:] if at else text


def together(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Stretches of texts with the places of their texts, some `TOGETHER` characters at a time."""
    places, parts, size = [], [], 0
    for place, text in enumerate(texts):
        for part in stretches(text or ""):
            places.append(place)
            parts.append(part)
            size += len(part)
            if size > TOGETHER:
                yield places, parts
                places, parts, size = [], [], 0
    if parts:
        yield places, parts


def pieces_of(runs: list[str], options: Training) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Runs of letters with their borders, in groups of bounded size: strings, how many places of each begin a subword, and
    the place of its run in the list.  A long run comes in parts that overlap by the longest subword."""
    parts, starts, rows, size = [], [], [], 0
    for row, run in enumerate(runs):
        whole = f"<{run}>"
        for at in range(0, len(whole), HASHED):
            parts.append(whole[at : at + HASHED + options.longest - 1])
            starts.append(min(HASHED, len(whole) - at))
            rows.append(row)
            size += len(parts[-1])
            if size > HASHED:
                yield parts, starts, rows
                parts, starts, rows, size = [], [], [], 0
    if parts:
        yield parts, starts, rows


def letter_runs(text: str) -> list[str]:
    """Maximal runs of Unicode letters, in lower case."""
    runs = LETTERS.findall(text.lower())
    # numerals such as fractions and Roman numbers are word characters, but no letters
    odd = {} if text.isascii() else {
        run: "".join(c if c.isalpha() else " " for c in run).split() for run in set(runs) if not run.isalpha()}
    return list(chain.from_iterable(odd.get(run, (run,)) for run in runs)) if odd else runs


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def subwords(parts: list[str], starts: list[int], rows: list[int], options: Training) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter n-grams that begin at the first `starts` places of each part, and its row, in order."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(part) for part in parts], np.int64)
    row = np.repeat(np.array(rows, np.int64), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # characters up to the end of the part
    own = np.repeat(length - np.array(starts, np.int64), length)
    found, of = [], []
    total = np.zeros(len(codes), np.uint64)
    for n in range(1, options.longest + 1):
        total[: len(codes) - n + 1] += codes[n - 1 :] * PLACE[n]
        if n >= options.shortest:
            inside = (left >= n) & (left > own)
            found.append((mix(total[inside] + np.uint64(n)) % np.uint64(options.buckets)).astype(np.int64))
            of.append(row[inside])
    ids, row = np.concatenate(found), np.concatenate(of)
    order = np.argsort(row, kind="stable")
    return ids[order], row[order]


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def training_rows(docs: DataFrame, allowed: Column, options: Training) -> list[tuple[str, str, bool]]:
    """(text, lang, held back for calibration) of a bounded sample of the allowed rows, the same in every run.

    Every language has its share of `sample_chars`, and its rows are taken in the order of a hash.
    """
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    short = F.length("text") <= options.max_chars
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("count"), F.count_if(short).alias("short")), "languages")
    languages = counts.count()
    if not languages:
        return []
    order = F.xxhash64(F.lit(options.seed), F.col("doc_id"))
    share = F.pmod(order, F.lit(1_000_000)) / 1_000_000
    # a language of long texts only is learned from their beginnings
    has_short = F.col("short") > 0
    part = (1.3 * options.docs_per_language + 20) / F.when(has_short, F.col("short")).otherwise(F.col("count"))
    wanted = checked_broadcast(counts.select("lang", has_short.alias("has_short"), part.alias("part")), languages)
    picked = rows.join(wanted, "lang").where((share < F.col("part")) & (short | ~F.col("has_short"))).select(
        F.substring("text", 1, options.max_chars).alias("text"), "lang", (fold() == 0).alias("back"), order.alias("at"))
    by_language = Window.partitionBy("lang").orderBy("at", "text")
    chars = F.sum(F.length("text")).over(by_language.rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.withColumn("rank", F.row_number().over(by_language)).withColumn("chars", F.coalesce(chars, F.lit(0)))
    picked = picked.where((F.col("rank") <= 2 * options.docs_per_language) & (
        (F.col("rank") == 1) | (F.col("chars") + F.length("text") <= options.sample_chars // languages)))
    return [(r["text"], r["lang"], bool(r["back"])) for r in picked.orderBy("at", "text").collect()]


def bags(texts: list[str], options: Training) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their shares."""
    out = []
    for text in texts:
        counts = np.zeros(options.buckets)
        for part in pieces_of(letter_runs(text), options):
            counts += np.bincount(subwords(*part, options)[0], minlength=options.buckets)
        at = np.flatnonzero(counts)
        out.append((at, counts[at] / max(1, counts.sum())))
    return out


def train(sample: list[tuple[str, str, bool]], options: Training = Training()) -> LanguageModel:
    """Stochastic gradient descent over the sample, then calibration on the rows held back."""
    languages = sorted({lang for _, lang, _ in sample})
    width = len(languages)
    rng = np.random.default_rng(options.seed)
    embedding = rng.normal(0, 0.1, (options.buckets, options.size))
    layer, bias = np.zeros((options.size, width)), np.zeros(width)
    labels = np.array([languages.index(lang) for _, lang, _ in sample], int)
    data = bags([text for text, _, _ in sample], options)
    full = np.array([len(at) > 0 for at, _ in data], bool)
    back = np.array([b for _, _, b in sample], bool)
    own = np.flatnonzero(full & ~back) if (full & ~back).any() else np.flatnonzero(full)
    weight = 1 / np.maximum(1, np.bincount(labels[own], minlength=width)) if width else np.zeros(0)
    weight = weight * len(own) / max(1, width)
    steps = options.epochs * max(1, -(-len(own) // options.batch))
    step = 0
    for _ in range(options.epochs):
        for part in np.array_split(rng.permutation(own), max(1, -(-len(own) // options.batch))):
            if not len(part):
                continue
            rate = options.rate * (1 - step / steps)
            step += 1
            at = np.concatenate([data[i][0] for i in part])
            share = np.concatenate([data[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(data[i][0]) for i in part])
            edges = np.concatenate(([0], np.cumsum([len(data[i][0]) for i in part])[:-1]))
            hidden = np.add.reduceat(embedding[at] * share[:, None], edges)
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(part)), labels[part]] -= 1
            error *= weight[labels[part]][:, None] / len(part)
            down = error @ layer.T
            layer -= rate * hidden.T @ error
            bias -= 0.1 * rate * error.sum(0)
            np.add.at(embedding, at, -rate * options.embedding_rate * share[:, None] * down[row])
    model = LanguageModel(languages, embedding.astype(np.float32), layer, bias, options)
    held = np.flatnonzero(full & back) if (full & back).any() else own
    if len(held):
        calibrate(model, [data[i] for i in held], labels[held])
    return model


def calibrate(model: LanguageModel, data: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
    """The temperature of least log loss, and the least score at which the accepted rows err seldom enough."""
    logits = np.array([share @ model.embedding[at] for at, share in data]) @ model.layer + model.bias
    rows = np.arange(len(labels))
    loss = [(-np.log(softmax(logits / t)[rows, labels] + 1e-12).mean(), t) for t in np.geomspace(0.02, 5, 60)]
    model.temperature = float(min(loss)[1])
    p = softmax(logits / model.temperature)
    right, score = p.argmax(1) == labels, p.max(1)
    floor = 1.5 / max(2, len(model.languages))
    order = np.argsort(-score)
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= model.options.target_error)
    lowest = score[order][fine[-1]] if len(fine) else 1.0
    # even if all rows err seldom enough, a text must score as the least sure of the right rows do
    sure = np.quantile(score[right], model.options.lost, method="lower") if right.any() else 1.0
    model.least_score = float(max(floor, lowest, sure))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with `lang_pred`, `score` (0 to 1) and `accepted` (never null)."""
    if clash := {c.lower() for c in docs.columns} & {*ADDED}:
        raise ValueError(f"the input has columns of these names already: {sorted(clash)}")
    schema = T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("accepted", T.BooleanType())])

    def add(batches):
        let_go()
        for batch in batches:
            for part in text_slices(batch, "text"):
                p = model.probabilities(part.column("text").to_pylist())
                score = p.max(1) if p.shape[1] else np.zeros(len(p))
                best = p.argmax(1) if p.shape[1] else np.zeros(len(p), int)
                names = [model.languages[k] if s > 0 else UNKNOWN for k, s in zip(best.tolist(), score.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()),
                     pa.array((score > 0) & (score >= model.least_score), pa.bool_())],
                    [*part.schema.names, *ADDED])

    return docs.mapInArrow(add, schema)


def fit(docs: DataFrame, options: Training = Training()) -> LanguageModel:
    """A model of the labelled rows whose fold is not 2 (those are for testing); fold 0 calibrates."""
    return train(training_rows(docs, fold() != 2, options), options)


def keep_identified(docs: DataFrame, options: Training = Training()) -> DataFrame:
    """The documents whose language is told with enough certainty, with their own columns."""
    return identify(docs, fit(docs, options)).where("accepted").select(*docs.columns)
