"""Items of JSON documents cut out by splits: no task reads a whole document.

A document is read in chunks that end at a closing brace, so any split of it can be read on its own.  What a split does to
the reader's state (inside a string or not, how deep) is known for both states it may begin in; one row for each split
then tells, from the first split of a file to the last, the state that holds, the array that is open and how many of
its items lie before.  With that, every split hands out the items that lie in it.  Items cut by the end of a split are put
together again, and so is what is left of a document without its items, which tells whether it is well formed.

A document that lies in one split needs none of that: `cut_whole` hands out its items in the pass that reads it.

Items are those of a top-level array, or of the arrays below wrapper keys of a top-level object.  A stretch without a
closing brace is one chunk: an array of plain numbers is read by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.session import cut_lineage

OPENERS, CLOSERS, COMMA, QUOTE, BACKSLASH = b"[{", b"]}", ord(","), ord('"'), ord("\\")
STEP = np.zeros(256, np.int8)
STEP[list(OPENERS)], STEP[list(CLOSERS)] = 1, -1
MARKED = STEP != 0
MARKED[COMMA] = True
#: Keys of the pieces that are no items of a wrapper key: items of a top-level array, and the rest of the document.
ROOT, REST = -1, -2
KEY_BEFORE = re.compile(rb'"([a-z_]{1,40})"\s*:\s*$')
LOOK_BACK = 128
PACKED = r"\.(gz|bz2|zst|zstd|snappy|lz4|deflate|xz)$"
#: Level of documents that have no items.
NO_ITEMS = 1 << 30


def read_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, size, chunk): the bytes between closing braces, in order within a split."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("chunk"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, bool, bool]]:
    """(columns of a split, bytes, first, last) for the stretches of each split that come in one batch.

    The brace that ended a chunk comes with the next chunk of its split, or with the last stretch, which is empty.
    """
    place = None
    for batch in batches:
        names = [n for n in batch.schema.names if n != "chunk"]
        columns = [batch.column(n).to_pylist() for n in names]
        chunks = batch.column("chunk").to_pylist()
        at = 0
        while at < len(chunks):
            here = tuple(c[at] for c in columns)
            stop = at + 1
            while stop < len(chunks) and columns[1][stop] == here[1] and columns[0][stop] == here[0]:
                stop += 1
            first = here != place
            if first and place is not None:
                yield place, b"}", False, True
            place = here
            yield here, (b"" if first else b"}") + b"}".join(chunks[at:stop]), first, False
            at = stop
    if place is not None:
        yield place, b"}", False, True


def pieces_of(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A long stretch in parts, none of which ends within an escape."""
    at = 0
    while len(data) - at > size:
        stop = at + size
        while stop < len(data) and data[stop - 1] == BACKSLASH:
            stop += 1
        yield data[at:stop]
        at = stop
    yield data[at:] if at else data


def outside_strings(data: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """Which bytes lie outside of strings, and whether the end lies in one."""
    if not len(data):
        return np.zeros(0, bool), inside
    quotes = np.flatnonzero(data == QUOTE)
    plain = np.where(data == BACKSLASH, -1, np.arange(len(data)))
    last_plain = np.maximum.accumulate(plain)
    before = np.where(quotes > 0, quotes - 1 - last_plain[quotes - 1], 0)
    marks = np.zeros(len(data), np.int8)
    marks[quotes[before % 2 == 0]] = 1
    parity = (inside + np.cumsum(marks)) % 2
    return parity == 0, int(parity[-1])


def split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: the state behind it and the change of depth, if it begins outside or within a string."""
    out: dict[str, list] = {n: [] for n in ("file", "block", "after0", "after1", "deeper0", "deeper1")}
    inside, depth = 0, [0, 0]
    for (file, block, closed), data, first, last in runs(batches):
        if first:
            inside, depth = 0, [0, 0]
        for part in pieces_of(data) if not last or closed else ():
            raw = np.frombuffer(part, np.uint8)
            outside, inside = outside_strings(raw, inside)
            step = STEP[raw]
            depth = [depth[0] + int(step[outside].sum()), depth[1] + int(step[~outside].sum())]
        if last:
            for name, value in zip(out, (file, block, inside, 1 - inside, *depth)):
                out[name].append(value)
    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
        ("file", pa.string()), ("block", pa.int64()), *[(n, pa.int64()) for n in ("after0", "after1", "deeper0", "deeper1")]]))


@dataclass
class Cutter:
    """Where a split is: depth, open array (its key, or None) and items before; and the pieces that are cut."""

    level: int
    wrappers: list[bytes]
    inside: int
    depth: int
    key: int | None
    item: int
    opened: bool = False
    tail: bytes = b""
    held: list[bytes] = field(default_factory=list)
    rest: list[bytes] = field(default_factory=list)
    whole: bool = False
    done: list[tuple[int, int, bytes, bool]] = field(default_factory=list)

    def feed(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        outside, self.inside = outside_strings(raw, self.inside)
        places = np.flatnonzero(MARKED[raw] & outside)
        step = STEP[raw[places]]
        depth = self.depth + np.cumsum(step)
        if len(depth):
            self.depth = int(depth[-1])
        event = ((step > 0) & (depth == self.level)) | ((step < 0) & (depth == self.level - 1)) | ((step == 0) & (depth == self.level))
        at = 0
        for place, turn in zip(places[event].tolist(), step[event].tolist()):
            if turn > 0:
                self.rest.append(data[at : place + 1])
                self.key, self.item, self.opened = self.key_of(data, place), 0, True
                self.whole, at = True, place + 1
            elif self.key is not None:
                self.held.append(data[at:place])
                self.hand_out()
                if turn == 0:
                    self.item += 1
                    self.whole, at = True, place + 1
                else:
                    self.key, at = None, place
        (self.rest if self.key is None else self.held).append(data[at:])
        self.tail = (self.tail + data)[-LOOK_BACK:]

    def key_of(self, data: bytes, place: int) -> int | None:
        if data[place] != ord("["):
            return None
        if self.level == 1:
            return ROOT
        found = KEY_BEFORE.search((self.tail + data[max(0, place - LOOK_BACK) : place])[-LOOK_BACK:])
        return self.wrappers.index(found[1]) if found and found[1] in self.wrappers else None

    def hand_out(self) -> None:
        self.done.append((self.key, self.item, b"".join(self.held), self.whole))
        self.held = []

    def finish(self) -> None:
        """The piece that goes on in the next split, and the rest of the document in this one."""
        if self.key is not None:
            self.whole = False
            self.hand_out()
        self.done.append((REST, 0, b"".join(self.rest), False))


def cutters(batches: Iterator[pa.RecordBatch], wrappers: tuple[str, ...]) -> Iterator[tuple[tuple, Cutter, bool]]:
    """A cutter fed with the stretches of its split, each time there is something new."""
    names = [w.encode() for w in wrappers]
    cutter = None
    for place, data, first, last in runs(batches):
        if first:
            _, _, closed, level, inside, depth, key, item = place
            cutter = Cutter(level, names, inside, depth, key, item)
        for part in pieces_of(data) if not last or closed else ():
            cutter.feed(part)
        if last:
            cutter.finish()
        yield place, cutter, last


#: Items of a whole document.
ITEMS = T.ArrayType(T.StructType().add("key", "integer").add("item", "long").add("piece", "binary"))
#: Bytes of documents whose items are handed on at a time.
AT_ONCE = 4 << 20


def text_slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `size` bytes; a longer one is a run of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def cut_whole(documents: DataFrame, content: str, level: str, wrappers: tuple[str, ...]) -> DataFrame:
    """Replace the bytes of whole, well-formed documents (column `content`; null: none) by `items`: those of the top-level array
    or of the first wrapper key that has one, else the document itself (key REST).

    The level of a row is that of `cut_items`.
    """
    names = [w.encode() for w in wrappers]
    schema = T.StructType([f for f in documents.schema.fields if f.name != content]).add("items", ITEMS)
    arrow = to_arrow_schema(schema)
    of_items = arrow.field("items").type.value_type

    def items_of(data: bytes, level: int) -> list[tuple[int, int, bytes]]:
        cutter = Cutter(level, names, 0, 0, None, 0)
        for part in pieces_of(data):
            cutter.feed(part)
        cutter.finish()
        chosen = min((d[0] for d in cutter.done if d[0] != REST), default=REST)
        return [d[:3] for d in cutter.done if d[0] == chosen] if chosen != REST else [(REST, 0, data)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = batch.column(level).to_pylist()
            for rows in text_slices(batch, content, AT_ONCE):
                first, levels = levels[: rows.num_rows], levels[rows.num_rows :]
                cut = [None if data is None else items_of(data, at) for data, at in zip(rows.column(content).to_pylist(), first)]
                flat = [item for items in cut if items is not None for item in items]
                ends = np.cumsum([0 if items is None else len(items) for items in cut])
                offsets = pa.array([0, *ends.tolist()], pa.int32(), mask=np.array([x is None for x in cut] + [False]))
                values = pa.StructArray.from_arrays(
                    [pa.array([x[i] for x in flat], f.type) for i, f in enumerate(of_items)], fields=list(of_items))
                columns = [rows.column(f.name) if f.name != "items" else pa.ListArray.from_arrays(offsets, values) for f in arrow]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return documents.mapInArrow(run, schema)


def _before(splits: DataFrame) -> DataFrame:
    """Add to one row for each split the state and depth that it begins with."""
    order = W.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    # after a split the state is that before it, or its opposite
    flips = F.coalesce(F.sum("after0").over(earlier), F.lit(0))
    known = splits.withColumn("inside", (flips % 2).cast("int")).withColumn(
        "deeper", F.when(F.col("inside") == 1, F.col("deeper1")).otherwise(F.col("deeper0")))
    return known.withColumn("depth", F.coalesce(F.sum("deeper").over(earlier), F.lit(0)))


def cut_items(spark: SparkSession, path: str | list[str], files: DataFrame, wrappers: tuple[str, ...]) -> DataFrame:
    """(file, key, item, text, is_utf8): items of the documents, and what is left of each (key REST).

    files: file, is_utf8, level (1 for documents that begin with a bracket, 2 with a brace; others have no items).
    """
    chunks = read_chunks(spark, path)
    # the last chunk of a file may end without a brace; the size of a compressed file doesn't tell, its first character does
    sizes = chunks.groupBy("file").agg(
        (F.sum(F.octet_length("chunk")) + F.count("*") <= F.first("size")).alias("fits"), F.max("block").alias("last_block"))
    known = cut_lineage(files.join(sizes, "file"))
    fits = F.when(F.lower("file").rlike(PACKED), F.col("level") == 2).otherwise(F.col("fits"))
    closed = fits | (F.col("block") < F.col("last_block"))
    dealt = chunks.join(F.broadcast(known), "file").withColumn("closed", closed)
    effects = "file string, block long, after0 long, after1 long, deeper0 long, deeper1 long"
    splits = dealt.select("file", "block", "closed", "chunk").mapInArrow(split_effects, effects)
    begins = cut_lineage(_before(splits).select("file", "block", "inside", F.col("depth").cast("int").alias("depth")))
    levels = F.broadcast(known.select("file", "level"))

    def placed(extra: DataFrame) -> DataFrame:
        return dealt.join(F.broadcast(extra), ["file", "block"]).select(
            "file", "block", "closed", "level", "inside", "depth", "key", "item", "chunk")

    def openings(batches):
        """The array that is open behind each split, and the items counted: from its opening, or from the split's begin."""
        out: dict[str, list] = {n: [] for n in ("file", "block", "opened", "key", "items")}
        for place, cutter, last in cutters(batches, wrappers):
            for kept in (cutter.done, cutter.rest, cutter.held):
                kept.clear()
            if last:
                for name, value in zip(out, (place[0], place[1], cutter.opened, cutter.key, cutter.item)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("opened", pa.bool_()), ("key", pa.int32()), ("items", pa.int64())]))

    # within the level an array is open, which one is not known yet: any will do to count
    opened = F.when(F.col("depth") >= F.col("level"), F.lit(ROOT)).cast("int")
    guess = begins.join(levels, "file").withColumn("key", opened).withColumn("item", F.lit(0).cast("long")).drop("level")
    counted = placed(guess).mapInArrow(openings, "file string, block long, opened boolean, key int, items long")
    order = W.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    chained = counted.withColumn("arrays", F.sum(F.col("opened").cast("int")).over(order))
    of_array = W.partitionBy("file", "arrays").orderBy("block")
    chained = chained.withColumn("total", F.sum("items").over(of_array))
    state = F.struct("key", "total", "opened")
    past = chained.withColumn("past", F.lag(state).over(order)).withColumn(
        "opener", F.last(F.when(F.col("opened"), F.struct("key")), True).over(earlier))
    open_now = F.col("past.key").isNotNull() & F.col("opener.key").isNotNull()
    resolved = past.select(
        "file", "block", F.when(open_now, F.col("opener.key")).alias("key"), F.when(open_now, F.col("past.total")).otherwise(0).alias("item"))
    starts = cut_lineage(begins.join(resolved, ["file", "block"]).select("file", "block", "inside", "depth", "key", "item"))

    def pieces(batches):
        names = ("file", "block", "key", "item", "piece", "whole")
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("key", pa.int32()), ("item", pa.int64()),
                            ("piece", pa.binary()), ("whole", pa.bool_())])
        for place, cutter, _ in cutters(batches, wrappers):
            if cutter.done:
                rows = [(place[0], place[1], *d) for d in cutter.done]
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schema)
                cutter.done.clear()

    cut = placed(starts).mapInArrow(pieces, "file string, block long, key int, item long, piece binary, whole boolean")
    cut = cut.join(F.broadcast(known.select("file", "is_utf8")), "file").select(
        "file", "is_utf8", "block", "key", "item", "whole", text_of(F.col("piece")).alias("text"))
    whole = cut.where("whole").select("file", "is_utf8", "key", "item", "text")
    parts = cut.where("not whole").groupBy("file", "is_utf8", "key", "item").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    return whole.unionByName(parts.select("file", "is_utf8", "key", "item", F.array_join(F.col("p.text"), "").alias("text")))


def text_of(piece: Column) -> Column:
    return F.when(F.col("is_utf8"), piece.cast("string")).otherwise(F.decode(piece, "ISO-8859-1"))
