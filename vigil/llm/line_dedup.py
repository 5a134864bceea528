"""Lines that many documents share are kept in one document only.

Lines are normalised to keys (ASCII white space stripped at both ends, A-Z in lower case), exploded as 128-bit
hashes, counted by distinct documents, and the lines of keys over the threshold are dropped from all documents
but the one of the largest doc_id.  What is left is put together in its old order.  Only hashes are shuffled for
the counts; a key that is in every document is one row a document there, and is summed by (key, document) first.

Edge cases: a null or empty text is one empty line, and a null text stays null; all lines of a document whose
lines are all dropped leave an empty text; a row without a doc_id is not counted and keeps all its lines; rows that
repeat a doc_id are one document to the counts, and each is cleaned by itself; an empty table gives no rows.  Other
columns are left as they are; the columns added here must not exist before (ValueError).
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.shared import let_go, scratch, stored, text_slices

ADDED = ("n_lines", "n_dropped")
SEED = 9


def keys_of(text: str) -> list[bytes]:
    """The key of every line, as bytes (whose strip and lower treat ASCII only)."""
    return [line.strip().lower() for line in text.encode().split(b"\n")]


def is_long(key: bytes, min_chars: int) -> bool:
    """Whether a key has so many code points."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key, SEED)


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key): one row for each document and long key in it."""

    def explode(batches):
        let_go()
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, keys = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if text and doc is not None:
                        own = {digest(k) for k in set(keys_of(text)) if is_long(k, min_chars)}
                        keys.extend(own)
                        ids.extend([doc] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(explode, "doc_id long, key binary")


def shared_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(drop_doc, drop_keys): for each document the keys of the lines that it loses; stored."""
    pairs = stored(document_keys(docs, min_chars), "line-keys")
    common = stored(
        pairs.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("n") >= min_docs).select("key", "last"), "common-lines")
    lost = pairs.join(common, "key").where(F.col("doc_id") != F.col("last"))
    return stored(
        lost.groupBy(F.col("doc_id").alias("drop_doc")).agg(F.collect_set("key").alias("drop_keys")), "dropped-lines", keep=True)


def drop_shared_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """docs with shared lines gone from `text`, and `n_lines` (before) and `n_dropped`."""
    if clash := {c.lower() for c in docs.columns} & {*ADDED, "drop_doc", "drop_keys"}:
        raise ValueError(f"the input has columns of these names already: {sorted(clash)}")
    with scratch(docs.sparkSession):
        drops = shared_lines(docs, min_docs, min_chars)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ADDED)])

    def assemble(batches):
        let_go()
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts, counts, dropped = [], [], []
                for text, drop in zip(part.column("text").to_pylist(), part.column("drop_keys").to_pylist()):
                    whole = text or ""
                    n = lost = 0
                    if drop:
                        gone, lines = set(drop), whole.split("\n")
                        n = len(lines)
                        kept = [
                            line for line, key in zip(lines, keys_of(whole))
                            if not (is_long(key, min_chars) and digest(key) in gone)]
                        lost = n - len(kept)
                        text = "\n".join(kept)
                    else:
                        n = whole.count("\n") + 1
                    texts.append(text)
                    counts.append(n)
                    dropped.append(lost)
                new = {"text": pa.array(texts, part.schema.field("text").type)}
                yield pa.RecordBatch.from_arrays(
                    [*(new.get(c, part.column(c)) for c in names), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                    [*names, *ADDED])

    # both sides grow with the corpus: a shuffle join at any size, whose hot ids adaptive execution splits
    joined = docs.hint("merge").join(drops, F.col("doc_id").cast("long") == F.col("drop_doc"), "left").drop("drop_doc")
    return joined.mapInArrow(assemble, schema)
