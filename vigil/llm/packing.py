"""Pack documents into token sequences, neighbours along a space-filling curve next to each other.

Every document becomes its ids and an end id, and a hashed vector of its ids, which a fixed random projection takes
to a few dimensions.  The Hilbert key of the cell there orders the documents (a range sort; ties go by the place of
the row, so that a third of all rows with one key still spreads over many ranges).  Running sums within the ranges
and the ranges' totals give each document its place in one long stream, which is cut every `length` tokens: no
sequence but the very last has room left.  Only (place, key, size) rows are sorted; the ids join the result once.

Edge cases: a null or empty text is the end id alone; rows that repeat a doc_id, and rows without one, are documents
like any other; a document longer than a sequence runs through several; an empty table gives no pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.llm.bpe import AT_ONCE, REMEMBERED, encoder, vocabulary
from vigil.llm.shared import let_go, stored, text_slices


@dataclass(frozen=True)
class Packing:
    """Sequence length, end id, and the curve: hashed features, dimensions and bits of each."""

    length: int = 2048
    end: int = 1
    features: int = 512
    dimensions: int = 3
    bits: int = 10
    seed: int = 11


#: Bytes of texts that are encoded at a time where packing is all that a worker does: more of them share their words.
ALONE_AT_ONCE = 12 << 20
#: Bytes of texts and characters of what is remembered where executors are full of former stages: less memory for more CPU.
BESIDE_AT_ONCE, BESIDE_REMEMBERED = 1 << 20, 1_000_000
#: Vectors that are held at a time.
ROWS = 512

PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of cell coordinates (rows x dimensions)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    step = 1 << (bits - 1)
    while step > 1:  # undo the rotations of each level, from the coarsest on
        low = step - 1
        for i in range(n):
            high = (x[i] & step) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        flip ^= np.where((x[n - 1] & step) > 0, step - 1, 0)
        step >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curve:
    """Hashed vectors of ids, projected to cells and keys."""

    def __init__(self, tokens: int, options: Packing):
        rng = np.random.default_rng(options.seed)
        self.slot = rng.integers(0, options.features, tokens)
        self.sign = rng.choice([-1.0, 1.0], tokens)
        self.axes = rng.normal(size=(options.features, options.dimensions))
        self.options = options

    def keys(self, ids: list[np.ndarray]) -> np.ndarray:
        """The keys of arrays of ids, some at a time: a vector takes more memory than a short text."""
        parts = [self._keys(ids[at : at + ROWS]) for at in range(0, len(ids), ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _keys(self, ids: list[np.ndarray]) -> np.ndarray:
        o = self.options
        vectors = np.zeros((len(ids), o.features))
        for row, own in enumerate(ids):
            if len(own):
                vectors[row] = np.bincount(self.slot[own], self.sign[own], o.features)
        size = np.sqrt((vectors**2).sum(1, keepdims=True))
        spread = 1 / (1 + np.exp(-1.702 * (vectors @ self.axes) / np.maximum(size, 1e-12)))
        cells = np.minimum((spread * (1 << o.bits)).astype(np.int64), (1 << o.bits) - 1)
        return hilbert_keys(cells, o.bits)


def tokenised(
    docs: DataFrame, path: str, options: Packing, lexicon: str | None = None, at_once: int = AT_ONCE, remembered: int = REMEMBERED
) -> DataFrame:
    """(doc_id, key, n, ids) of every row; ids without the end id, packed in the vocabulary's width."""

    def run(batches):
        own = encoder(path, lexicon, remembered)
        curve = Curve(len(own.words.tokens), options)
        for batch in batches:
            for part in text_slices(batch, "text", at_once):
                ids = own.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(curve.keys(ids), pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "key", "n", "ids"])

    schema = T.StructType([docs.schema["doc_id"]]).add("key", "long").add("n", "long").add("ids", "binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def stream_places(rows: DataFrame, options: Packing) -> DataFrame:
    """(place, at): where each row's tokens begin in the stream along the curve; stored."""

    def sums(batches):
        let_go()
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.asarray(batch.column("n")) + 1
            ends = total + np.cumsum(size)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), pa.array(np.full(len(size), part), pa.int32()), pa.array(ends - size, pa.int64()),
                 pa.array(size, pa.int64())], ["place", "part", "local", "size"])

    ranged = rows.select("place", "key", "n").repartitionByRange("key", "place").sortWithinPartitions("key", "place")
    local = stored(ranged.mapInArrow(sums, "place long, part int, local long, size long"), "stream")
    # one row for each range: a running sum over as many rows as there were tasks
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("part").agg(F.sum("size").alias("size"))
    before = totals.select(
        F.col("part").alias("before_part"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    placed = local.join(F.broadcast(before), F.col("part") == F.col("before_part"))
    return placed.select(F.col("place").alias("at_place"), (F.col("local") + F.col("before")).alias("at"))


def pack(
    docs: DataFrame, path: str, options: Packing = Packing(), lexicon: str | None = None, at_once: int = AT_ONCE,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """The pieces of all documents (columns doc_id, text): doc_id and the columns of PIECE.

    `at_once` bounds the bytes of texts that a worker holds at a time, `remembered` the characters of what it remembers of
    former ones; the pieces don't depend on them.
    `ids` are little-endian unsigned 32-bit integers; pieces of one sequence fill it without gaps by `offset`.
    """
    rows = stored(
        tokenised(docs, path, options, lexicon, at_once, remembered).withColumn("place", F.monotonically_increasing_id()), "tokens")
    kind = vocabulary(path).kind
    length = options.length

    def cut(batches):
        let_go()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, packed, at in zip(
                    batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("at").to_pylist()):
                ids = np.append(np.frombuffer(packed, kind).astype("<u4"), np.uint32(options.end)).astype("<u4")
                start = 0
                while start < len(ids):
                    size = min(len(ids) - start, length - (at + start) % length)
                    for column, value in zip(out, (
                            doc, start, size, len(ids), (at + start) // length, (at + start) % length,
                            ids[start : start + size].tobytes())):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(out, arrow)], [f.name for f in arrow])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(PIECE).fields])
    arrow = list(to_arrow_schema(schema))
    places = stored(stream_places(rows, options), "places")
    # both sides grow with the corpus: a shuffle join at any size
    joined = rows.select("doc_id", "ids", "place").hint("merge").join(
        places, F.col("place") == F.col("at_place")).select("doc_id", "ids", "at")
    return joined.mapInArrow(cut, schema)
