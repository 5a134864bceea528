"""Readers for submitted files: delimited text, JSON documents and JSON lines, many files at once.

Every reader returns parsed rows: file, row_index (1-based data row in the file), data
(map<string,string>), is_corrupted, corruption_reason, raw_text.

A first pass finds the format of each file; then every file is opened once more, by the reader of its format.
JSON documents that lie in one split are cut into their items in that first pass, so that many small files are opened once.
Row numbers need no sort and no shuffle of the text: within a file split, lines keep their order, so
a row's number is its position in the split plus the rows of the earlier splits of that file.  Quoted cells over
several lines are followed in every split from both states it may begin in; one row a split then decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.scalars import c
from vigil.schema import EVENT_COLUMNS, of_type
from vigil.session import cut_lineage, stored
from vigil.sources.formats import DELIMITERS, detect_delimiter, detect_format
from vigil.sources.json_items import NO_ITEMS, PACKED, REST, ROOT, cut_items, cut_whole
from vigil.sources.sinks import EVENTS
from vigil.sources.snapshots import read_table

PARSED_COLUMNS = ("file", "row_index", "data", "is_corrupted", "corruption_reason", "raw_text")
# Fixed values.
NULL_WORDS = ("", "null", "none", "n/a", "\\n")
WRAPPER_KEYS = (
    "records", "data", "events", "items", "alerts", "cases",
    "investigations", "escalations", "assets", "incidents", "coverage", "activities",
)
JSON_MAP = "map<string,string>"
#: Files that are read together; what is known of them is broadcast to the splits of their lines.
FILES_AT_ONCE = 50_000
#: Bytes up to which a file that lies in one split is read as one row.
SMALL_FILE = 1 << 20
#: Splits up to which their row offsets are broadcast.
BROADCAST_SPLITS = 200_000


def clean_value(value: Column | str) -> Column:
    """Trimmed text; null words become NULL."""
    text = F.trim(c(value))
    return F.when(~F.lower(text).isin(*NULL_WORDS), text)


def is_small(spark: SparkSession) -> Column:
    """Plain files of at most SMALL_FILE bytes and one split, by their listing (columns path, length)."""
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return (F.col("length") <= min(SMALL_FILE, split)) & ~F.lower("path").rlike(PACKED)


def small_heads(found: DataFrame, kind: Column) -> DataFrame:
    """`file_heads` of whole files (columns path, length, content), each from its own row, with their format and content.

    `kind` is the format, an expression of the first line; open cells are looked for in delimited files only.
    """
    mark = F.substring("content", 1, 3) == F.unhex(F.lit("EFBBBF"))  # the reader of lines drops it too
    document = F.when(mark, F.substring("content", F.lit(4), F.octet_length("content"))).otherwise(F.col("content"))
    bare = lambda x: F.regexp_replace(x, "^\ufeff", "")
    opens = lambda d: F.exists("lines", lambda x: opens_cell(x, d))
    whole = found.select(F.col("_metadata.file_path").alias("file"), document.alias("document")).withColumn(
        "text", F.col("document").cast("string"))
    lines = whole.withColumn("lines", F.filter(F.split("text", "\r\n|\n|\r", -1), lambda x: F.trim(bare(x)) != ""))
    headed = lines.where(F.size("lines") > 0).withColumn("head", F.transform(F.slice("lines", 1, 5), bare)).withColumn(
        "first_line", F.col("head")[0]).withColumn("format", kind)
    return headed.select(
        "file", "head", F.is_valid_utf8("text").alias("is_utf8"), F.size("lines").cast("bigint").alias("n_lines"),
        F.when(F.col("format") == "csv", F.array(*[opens(d) for d in DELIMITERS])).alias("opens"), "document", "first_line", "format")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines with their file, split and order inside the split."""
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").alias("line"),
        )
        .where(F.trim(F.regexp_replace("line", "^﻿", "")) != "")
        .withColumn("seq", F.monotonically_increasing_id())
    )


def file_heads(lines: DataFrame, head: int = 5) -> DataFrame:
    """One row per file: head lines, first line, whether all text is valid UTF-8."""
    first = W.partitionBy("file").orderBy("block", "seq")
    top = (
        lines.withColumn("rank", F.row_number().over(first))  # cut before the shuffle
        .where(F.col("rank") <= head)
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("h"))
        .select("file", F.transform("h", lambda x: F.regexp_replace(x["line"], "^﻿", "")).alias("head"))
    )
    # expressed over all lines: one invalid line makes the file ISO-8859-1
    valid = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("line")).alias("is_utf8"), F.count("*").alias("n_lines"),
        # whether a quoted cell goes on in the next line, for each delimiter that the file may have
        F.array(*[F.bool_or(opens_cell(F.col("line"), d)) for d in DELIMITERS]).alias("opens"),
    )
    return top.join(valid, "file").withColumn("first_line", F.col("head")[0])


def decoded_bytes(data: Column | str, is_utf8: Column | str) -> Column:
    return F.when(c(is_utf8), c(data).cast("string")).otherwise(F.decode(c(data), "ISO-8859-1"))


def decoded(line: Column | str, is_utf8: Column | str) -> Column:
    text = F.when(c(is_utf8), c(line)).otherwise(F.decode(c(line).cast("binary"), "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def _quoted(delimiter: str) -> str:
    return "\\" + delimiter if delimiter == "|" else delimiter


def _by_delimiter(delimiter: Column, of: Callable[[str], Column]) -> Column:
    """`of` for the delimiter of the row; patterns have to be constants."""
    out = F.when(delimiter == DELIMITERS[0], of(DELIMITERS[0]))
    for d in DELIMITERS[1:]:
        out = out.when(delimiter == d, of(d))
    return out


def split_cells(line: Column, delimiter: Column) -> Column:
    """Cells of a delimited record; quoted cells may hold the delimiter, doubled quotes and line breaks.

    A quote opens a cell only as its first character; text after the closing quote belongs to the cell as it is.
    """

    def value(x: Column) -> Column:
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        plain = F.endswith(x, F.lit('"')) & (F.length(x) > 1) & ~F.contains(F.replace(inner, F.lit('""')), F.lit('"'))
        part = lambda i: F.regexp_extract(x, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$', i)
        odd = F.concat(F.replace(part(1), F.lit('""'), F.lit('"')), part(2))
        return F.when(F.startswith(x, F.lit('"')), F.when(plain, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(odd)).otherwise(x)

    def cells(d: str) -> Column:
        q = _quoted(d)
        # each match starts at a delimiter, so none is empty; no group repeats per character
        pattern = rf'{q}("[^"]*+(?:""[^"]*+)*+(?:"[^{q}]*+)?|[^{q}]*+)'
        return F.transform(F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(pattern), 1), value)

    return _by_delimiter(delimiter, cells)


OPEN = r'"[^"]*+(?:""[^"]*+)*+$'


def _cells_before(d: str) -> str:
    """Whole cells, each with the delimiter behind it."""
    q = _quoted(d)
    return rf'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^{q}]*+|[^"{q}][^{q}]*+|){q})*+'


def opens_cell(line: Column, d: str) -> Column:
    """A line that begins outside of quotes ends within a quoted cell."""
    return F.contains(line, F.lit('"')) & line.rlike(rf"^{_cells_before(d)}{OPEN}")


def stays_open(line: Column, d: str) -> Column:
    """A line that begins within a quoted cell ends within one: the same or a later one."""
    q = _quoted(d)
    closed = rf'^[^"]*+(?:""[^"]*+)*+"[^{q}]*+{q}{_cells_before(d)}{OPEN}'
    return ~F.contains(line, F.lit('"')) | line.rlike(r'^[^"]*+(?:""[^"]*+)*+$') | line.rlike(closed)


def _numbered(kept: DataFrame) -> DataFrame:
    """Add `position`, the 1-based position of a row among the rows of its file (columns file, block, seq)."""
    per_block = kept.groupBy("file", "block").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut_lineage(
        per_block.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"))
    if offsets.count() <= BROADCAST_SPLITS:  # a row for each split
        offsets = F.broadcast(offsets)
    return kept.join(offsets, ["file", "block"]).withColumn(
        "position", F.col("offset") + F.col("seq") - F.col("first_seq") + 1
    ).drop("offset", "first_seq")


def _file_groups(files: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """Paths of files, at most FILES_AT_ONCE together, with the rows of `files` (stored) that describe them."""
    names = sorted(r.file for r in files.select("file").collect())
    groups = [names[i : i + FILES_AT_ONCE] for i in range(0, len(names), FILES_AT_ONCE)]
    if len(groups) == 1:
        return [([unquote(n) for n in names], files)]
    return [([unquote(n) for n in g], files.where(F.col("file").between(g[0], g[-1]))) for g in groups]


def _unioned(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """Parsed rows of all parts; none at all without parts."""
    schema = f"file string, row_index bigint, data {JSON_MAP}, is_corrupted boolean, corruption_reason string, raw_text string"
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_headers(heads: DataFrame, delimiter: str | None = None) -> DataFrame:
    """Delimiter and header cells of delimited files, and whether their cells run over lines."""
    found = F.lit(delimiter) if delimiter else detect_delimiter(F.col("head"))
    described = heads.withColumn("delimiter", found)

    def first_record(d: str) -> Column:
        """The first of the head lines, and those after it as long as a cell is open."""
        grown = F.aggregate(
            "head", F.lit(None).cast("string"),
            lambda text, line: F.when(text.isNull(), line).when(opens_cell(text, d), F.concat(text, F.lit("\n"), line)).otherwise(text))
        return F.when(F.col("opens")[DELIMITERS.index(d)], grown).otherwise(F.col("first_line"))

    described = described.withColumn("first", _by_delimiter(F.col("delimiter"), first_record))
    return described.select(
        "file", "is_utf8", "delimiter",
        F.transform(split_cells(F.col("first"), F.col("delimiter")), lambda h: F.trim(h)).alias("header"),
        _by_delimiter(F.col("delimiter"), lambda d: F.col("opens")[DELIMITERS.index(d)]).alias("over_lines"),
    )


def has_content(cells: Column | str) -> Column:
    return F.exists(cells, lambda x: F.trim(x) != "")


def delimited_rows(numbered: DataFrame) -> DataFrame:
    """Parsed rows of (file, header, delimiter, cells, position), whose first row is the header.

    Rows whose cell count differs from the header's are flagged, keep what fits and hold the rest under `__extra__`.
    """
    numbered = numbered.where(F.col("position") > 1)
    width, got = F.size("header"), F.size("cells")
    values = F.transform("cells", clean_value)
    padded = F.transform(
        F.sequence(F.lit(0), width - 1), lambda i: F.get(values, i)
    )
    data = F.map_from_arrays(F.col("header"), padded)
    extra = F.create_map(F.lit("__extra__"), F.to_json(F.slice(values, width + 1, F.greatest(got - width, F.lit(0)))))
    return numbered.select(
        "file",
        (F.col("position") - 1).cast("bigint").alias("row_index"),
        F.when(got > width, F.map_concat(data, extra)).otherwise(data).alias("data"),
        (got != width).alias("is_corrupted"),
        F.when(got != width, F.format_string("Column count mismatch: expected %s, got %s", width, got)).alias("corruption_reason"),
        F.expr("array_join(cells, delimiter)").alias("raw_text"),
    )


def parse_delimited(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rows of delimited files (as of `with_headers`, stored), one a line."""
    parts = []
    for paths, known in _file_groups(files):
        # a narrow join, after which the rows of a split still are in order; then they are numbered
        rows = (
            read_lines(spark, paths).drop("seq").join(F.broadcast(known), "file")
            .withColumn("cells", split_cells(decoded("line", "is_utf8"), F.col("delimiter")))
            .where(has_content("cells"))
            .withColumn("seq", F.monotonically_increasing_id())
        )
        parts.append(delimited_rows(_numbered(rows)))
    return _unioned(spark, parts)


def _line_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to the lines of each split what holds before them if the split begins outside or within a quoted cell.

    A line maps the state before it (0 outside, 1 within) to the one after it: `opens` gives it for 0, `stays` for 1.
    Lines for which both agree fix the state, lines that keep or swap it are counted from there on.
    """
    place, state, count = None, [0, 1], [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block = batch.column("file"), batch.column("block")
        new = np.ones(n, bool)
        new[1:] = pc.or_(
            pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1))
        ).to_numpy(zero_copy_only=False)
        opens = batch.column("opens").to_numpy(zero_copy_only=False).astype(np.int8)
        stays = batch.column("stays").to_numpy(zero_copy_only=False).astype(np.int8)
        blank = batch.column("blank").to_numpy(zero_copy_only=False)
        within = np.zeros((2, n), np.int8)
        record = np.zeros((2, n), np.int64)
        starts = np.flatnonzero(new).tolist()
        for a, b in zip(starts, [*starts[1:], n]):
            here = (file[a].as_py(), block[a].as_py())
            if here != place:
                place, state, count = here, [0, 1], [0, 0]
            o, s = opens[a:b], stays[a:b]
            swaps = np.cumsum((o == 1) & (s == 0))
            fixed = np.maximum.accumulate(np.where(o == s, np.arange(b - a), -1))
            for k in (0, 1):
                after = np.where(fixed >= 0, o[fixed] ^ ((swaps - swaps[fixed]) & 1), state[k] ^ (swaps & 1))
                before = np.concatenate(([state[k]], after[:-1]))
                begun = count[k] + np.cumsum((before == 0) & ~(blank[a:b] & (after == 0)))
                within[k, a:b], record[k, a:b] = before, begun
                state[k], count[k] = int(after[-1]), int(begun[-1])
        yield pa.RecordBatch.from_arrays(
            [file, block, batch.column("text"), batch.column("seq"), batch.column("opens"), batch.column("stays"), batch.column("blank"),
             pa.array(within[0] == 1), pa.array(within[1] == 1), pa.array(record[0]), pa.array(record[1])],
            ["file", "block", "text", "seq", "opens", "stays", "blank", "within0", "within1", "record0", "record1"])


LINE_STATES = (
    "file string, block long, text string, seq long, opens boolean, stays boolean, blank boolean, "
    "within0 boolean, within1 boolean, record0 long, record1 long")


def _placed_lines(lines: DataFrame) -> DataFrame:
    """(file, seq, text, record, within, ends_within, blank) of lines (file, block, text, delimiter) in their order in splits.

    Every split is read on its own for both states it may begin in.  One row for each split then tells, from the first
    split of a file to the last, which of them holds and how many records lie before.
    """
    d = F.col("delimiter")
    text = F.col("text")
    bare = _by_delimiter(d, lambda x: text.rlike(rf'^[\s"{_quoted(x)}]*+$'))
    marked = lines.select(
        "file", "block", "text", F.monotonically_increasing_id().alias("seq"), _by_delimiter(d, lambda x: opens_cell(text, x)).alias("opens"),
        _by_delimiter(d, lambda x: stays_open(text, x)).alias("stays"), (bare & ~has_content(split_cells(text, d))).alias("blank"))
    states = marked.mapInArrow(_line_states, LINE_STATES)

    def ends(k: int) -> Column:
        return F.when(F.col(f"within{k}"), F.col("stays")).otherwise(F.col("opens"))

    last = F.max_by(F.struct(
        ends(0).cast("int").alias("out0"), ends(1).cast("int").alias("out1"), F.col("record0"), F.col("record1")), "seq")
    splits = states.groupBy("file", "block").agg(last.alias("s")).select("file", "block", "s.*")
    order = W.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    # out0 = out1 fixes the state behind a split; out0 > out1 swaps it
    swaps = F.sum(F.when(F.col("out0") > F.col("out1"), 1).otherwise(0)).over(order)
    splits = splits.withColumn("swaps", swaps).withColumn(
        "fix", F.when(F.col("out0") == F.col("out1"), F.struct("block", "out0", "swaps")))
    past = splits.withColumn("fixed", F.max("fix").over(earlier)).withColumn("swapped", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    begin = F.coalesce(F.col("fixed.out0"), F.lit(0)).bitwiseXOR(
        ((F.col("swapped") - F.coalesce(F.col("fixed.swaps"), F.lit(0))) % 2).cast("int"))
    known = past.withColumn("begin", begin).withColumn(
        "own", F.when(F.col("begin") == 1, F.col("record1")).otherwise(F.col("record0")))
    offsets = cut_lineage(known.select("file", "block", "begin", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset")))
    if offsets.count() <= BROADCAST_SPLITS:  # a row for each split
        offsets = F.broadcast(offsets)
    at1 = F.col("begin") == 1
    within = F.when(at1, F.col("within1")).otherwise(F.col("within0"))
    return states.join(offsets, ["file", "block"]).select(
        "file", "block", "seq", "text", within.alias("within"),
        F.when(within, F.col("stays")).otherwise(F.col("opens")).alias("ends_within"), "blank",
        (F.col("offset") + F.when(at1, F.col("record1")).otherwise(F.col("record0"))).alias("record"))


def parse_multiline(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rows of delimited files whose quoted cells run over lines, each split read by a task of its own.

    Only the lines of records that have several are brought together, also those of a record that lies in two splits.
    A cell that is never closed runs to the end of its file.  A record of several lines with nothing but white space is
    left off, but counts in the row numbers.
    """
    parts = []
    for paths, known in _file_groups(files):
        known = F.broadcast(known)
        lines = spark.read.text(paths).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
        lines = lines.join(known, "file").select("file", "block", "delimiter", decoded("line", "is_utf8").alias("text"))
        placed = _placed_lines(lines)
        single = placed.where("not within and not ends_within and not blank").select("file", "record", "text")
        several = placed.where("within or ends_within").groupBy("file", "record").agg(
            F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("lines")
        ).select("file", "record", F.array_join(F.col("lines.text"), "\n").alias("text"))
        rows = single.unionByName(several).join(known, "file").withColumn("cells", split_cells(F.col("text"), F.col("delimiter")))
        parts.append(delimited_rows(rows.where(has_content("cells")).withColumnRenamed("record", "position")))
    return _unioned(spark, parts)


def _is_object(text: Column) -> Column:
    """Exactly one complete JSON object: wrapping it makes a one-element array."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    kind = F.schema_of_variant(wrapped)
    single = F.variant_get(wrapped, "$[1]", "variant").isNull()
    return wrapped.isNotNull() & single & F.startswith(kind, F.lit("ARRAY<OBJECT"))


def _is_value(text: Column) -> Column:
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return wrapped.isNotNull() & F.variant_get(wrapped, "$[1]", "variant").isNull()


def object_map(text: Column) -> Column:
    """Members of a JSON object as text; nested values stay JSON text."""
    return F.from_json(text, JSON_MAP)


def parse_json_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One object per line of files (file, is_utf8; stored); other values and broken lines are flagged and kept."""
    return _unioned(spark, [
        json_rows(_numbered(
            read_lines(spark, paths).join(F.broadcast(known), "file").withColumn("text", F.trim(decoded("line", "is_utf8")))))
        for paths, known in _file_groups(files)])


def json_rows(numbered: DataFrame) -> DataFrame:
    is_object, is_value = _is_object(F.col("text")), _is_value(F.col("text"))
    return numbered.select(
        "file",
        F.col("position").alias("row_index"),
        F.when(is_object, object_map(F.col("text")))
        .when(is_value, F.create_map(F.lit("raw_value"), F.col("text")))
        .otherwise(F.create_map(F.lit("corrupted_line"), F.col("text"))).alias("data"),
        (~is_object).alias("is_corrupted"),
        F.when(is_object, F.lit(None))
        .when(is_value, "NDJSON row is not a JSON object")
        .otherwise("Invalid JSON line syntax").alias("corruption_reason"),
        F.col("text").alias("raw_text"),
    )


def document_level(first_line: Column | str) -> Column:
    first = F.substring(F.trim(c(first_line)), 1, 1)
    return F.when(first == "[", 1).when(first == "{", 2).otherwise(NO_ITEMS)


def _bare(text: Column) -> Column:
    """White space that isn't JSON's stays: it makes an item unsound, as it does a document."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def document_rows(items: DataFrame) -> DataFrame:
    """Parsed rows of items (file, key, item, text) of the chosen key."""
    items = items.where("text != ''")
    rows = items.withColumn("v", F.try_parse_json("text"))
    written = F.to_json("v")
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    reason = F.when(F.col("key") == ROOT, "Array item is not a JSON object").otherwise("Wrapped item is not a JSON object")
    return rows.select(
        "file",
        F.when(F.col("key") == REST, 1).otherwise(F.col("item") + 1).cast("bigint").alias("row_index"),
        F.when(is_object, object_map(written)).otherwise(F.create_map(F.lit("raw_value"), written)).alias("data"),
        (~is_object).alias("is_corrupted"),
        F.when(~is_object, reason).alias("corruption_reason"),
        written.alias("raw_text"),
    )


def judged_documents(heads: DataFrame) -> DataFrame:
    """Replace `document` of heads by `broken`, and by `items` (key, item, piece) of those that are well formed.

    Only JSON documents have either, and they have no head any more.
    """
    is_document = F.coalesce((F.col("format") == "json") & (F.col("layout") == "document"), F.lit(False))
    text = _bare(F.regexp_replace(decoded_bytes("document", "is_utf8"), "^\ufeff", ""))
    checked = heads.withColumns({"level": document_level("first_line"), "is_document": is_document}).withColumn(
        "text", F.when(F.col("is_document"), text)).withColumn("broken", F.when(F.col("is_document"), ~_is_value(F.col("text"))))
    levelled = checked.withColumns({
        "document": F.when(~F.col("broken"), F.col("document")),
        **{n: F.when(~F.col("is_document"), F.col(n)) for n in ("head", "first_line")}})
    return cut_whole(levelled.drop("is_document", "text"), "document", "level", WRAPPER_KEYS).drop("level")


def parse_json_documents(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON arrays, wrapper objects and single objects (files: file, is_utf8, first_line; stored), and the files
    that are no well-formed documents, which have no rows here.

    A document is well formed if all its items are, and what is left of it without them.
    """
    level = document_level("first_line").alias("level")
    parts, broken = [], files.select("file", "is_utf8").limit(0)
    for paths, known in _file_groups(files):
        cut = cut_items(spark, paths, known.select("file", "is_utf8", level), WRAPPER_KEYS)
        cut = cut.withColumn("text", _bare(F.when(F.col("key") == REST, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))))
        item = (F.col("key") != REST)
        empty = item & (F.col("text") == "")
        unsound = ~empty & ~_is_value(F.col("text"))
        arrays = cut.groupBy("file", "is_utf8", "key").agg(
            F.count("*").alias("n"), F.count_if(empty).alias("empty"), F.bool_or(unsound).alias("unsound"))
        per_file = cut_lineage(arrays.groupBy("file", "is_utf8").agg(
            F.min(F.when(F.col("key") != REST, F.col("key"))).alias("chosen"),
            F.bool_or(F.col("unsound") | ((F.col("empty") > 0) & (F.col("n") > 1))).alias("broken")))
        broken = broken.unionByName(per_file.where("broken").select("file", "is_utf8"))
        sound = F.broadcast(per_file.where("not broken").select("file", F.coalesce("chosen", F.lit(REST)).alias("key")))
        parts.append(document_rows(cut.join(sound, ["file", "key"])))
    return _unioned(spark, parts), broken


def json_layout(heads: DataFrame) -> DataFrame:
    """lines or document per JSON file: a complete object on the first of several lines means lines."""
    several = F.col("n_lines") > 1
    return heads.withColumn(
        "layout", F.when(several & _is_value(F.trim("first_line")), "lines").otherwise("document")
    )


def read_submissions(
    spark: SparkSession, path: str | list[str], format: str = "auto", delimiter: str | None = None
) -> DataFrame:
    """Parsed rows of all files under `path`, each read by its own format.

    `format`: auto, csv or json.  JSON documents that do not parse as a whole fall back to lines.
    """
    if format not in ("auto", "csv", "json"):
        raise ValueError(f"unknown format {format!r}")
    kind = detect_format("first_line") if format == "auto" else F.lit(format)
    found = spark.read.format("binaryFile").load(path)
    small = is_small(spark)
    # the content column is not read here, so no large file is opened
    large = cut_lineage(found.where(~small).select(F.col("_metadata.file_path").alias("file")))
    whole = stored(judged_documents(json_layout(small_heads(found.where(small), kind))), "small-files")
    heads = [whole.drop("items")]
    for paths, _ in _file_groups(large):
        described = json_layout(file_heads(read_lines(spark, paths)).withColumn("format", kind))
        heads.append(cut_lineage(described.withColumn("broken", F.lit(None).cast("boolean"))))
    heads = reduce(DataFrame.unionByName, heads)
    parts = []
    if format in ("auto", "csv"):
        files = heads.where(F.col("format") == "csv")
        described = cut_lineage(with_headers(files, delimiter))
        for over_lines, parse in ((False, parse_delimited), (True, parse_multiline)):
            parts.append(parse(spark, described.where(F.col("over_lines") == over_lines).drop("over_lines")))
    if format in ("auto", "json"):
        files = heads.where(F.col("format") == "json")
        by_line = files.where((F.col("layout") == "lines") | F.col("broken")).select("file", "is_utf8")
        items = whole.where(F.size("items") > 0).select("file", "is_utf8", F.inline("items"))
        parts.append(document_rows(items.select("file", "key", "item", _bare(decoded_bytes("piece", "is_utf8")).alias("text"))))
        by_splits = cut_lineage(files.where((F.col("layout") == "document") & F.col("broken").isNull()).select("file", "is_utf8", "first_line"))
        documents, broken = parse_json_documents(spark, by_splits)
        parts.append(documents)
        by_line = cut_lineage(by_line.unionByName(broken))
        parts.append(parse_json_lines(spark, by_line))
    out = _unioned(spark, parts)
    return out.select(*PARSED_COLUMNS)


def read_events(
    spark: SparkSession, path: str, entity_id: str | None = None, dataset_types: tuple[str, ...] = (), ordered: bool = False
) -> DataFrame:
    """Stored canonical events of the committed runs; entity and dataset types prune partitions. Ordering by time is optional,
    because no operator needs it."""
    schema = ", ".join(f"{n} {t}" for n, t in {**EVENT_COLUMNS, "created_at": "timestamp"}.items())
    events = read_table(spark, path, EVENTS, schema)
    if entity_id is not None:
        events = events.where(F.col("entity_id") == entity_id)
    if dataset_types:
        events = of_type(events, *dataset_types)
    return events.orderBy("event_timestamp", "raw_row_index", "event_id") if ordered else events


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """sha256 and size of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256_hash")
    )


# Period and dataset of a file laid out as {entity}/{period}/{json|csv}/{dataset}.{ext}
TREE_PATTERN = r"([^/]+)/([^/]+)/(json|csv)/([^/]+)\.(?:json|csv)$"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file, entity_dir, period, kind, dataset_type) of a directory tree, from its listing alone.

    A period's CSV files are left out where it has JSON files.
    """
    names = ("entity_dir", "period", "kind", "dataset_type")
    # the content column is not read, so no file is opened
    files = spark.read.format("binaryFile").load(f"{root}/*/*/*/*").select(F.col("_metadata.file_path").alias("file"))
    # names are percent-encoded there, but for a plus sign
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    located = files.select("file", *[F.regexp_extract(path, TREE_PATTERN, i + 1).alias(n) for i, n in enumerate(names)])
    has_json = F.max((F.col("kind") == "json").cast("int")).over(W.partitionBy("entity_dir", "period"))
    return located.where(F.col("kind") != "").withColumn("has_json", has_json).where(
        (F.col("kind") == "json") | (F.col("has_json") == 0)).drop("has_json")


def read_tree(spark: SparkSession, root: str, wanted: Column | None = None) -> DataFrame:
    """Parsed rows of a directory tree with entity_dir, period, kind and dataset_type of their file.

    `wanted` chooses files by these columns; the others are never opened.
    """
    listed = list_tree(spark, root)
    located = cut_lineage(listed if wanted is None else listed.where(wanted))
    parts = [
        read_submissions(spark, paths).join(F.broadcast(known), "file") for paths, known in _file_groups(located) if paths]
    if not parts:
        return _unioned(spark, []).join(located, "file")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def match_entities(directories: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity of each directory name: by code, then by name slug, else an id derived from the name.

    "The name contains the code" is an equi join on the substrings of the directory name.
    """
    slug = F.lower(F.replace("name", F.lit(" "), F.lit("_")))
    known = entities.select("entity_id", F.lit(0).alias("how"), F.col("entity_code").alias("part")).unionByName(
        entities.select("entity_id", F.lit(1).alias("how"), slug.alias("part"))
    ).where(F.col("part") != "")
    size = F.length("entity_dir")

    def substrings(text: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(1), size),
                lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(text, i, n)),
            )
        )

    names = directories.select("entity_dir").distinct()
    spelled = names.select("entity_dir", F.lit(0).alias("how"), F.explode(F.array_distinct(substrings(F.col("entity_dir")))).alias("part")).unionByName(
        names.select("entity_dir", F.lit(1).alias("how"), F.explode(F.array_distinct(substrings(F.lower("entity_dir")))).alias("part"))
    )
    matched = spelled.join(known, ["how", "part"]).select("entity_dir", "how", "entity_id")
    hits = names.join(matched, "entity_dir", "left")
    rank = F.struct("how", "entity_id")
    namespace = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))  # the DNS namespace of RFC 4122
    digest = F.sha1(F.concat(namespace, F.encode("entity_dir", "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)
    derived = F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 19, 2)), F.substring(digest, 21, 12),
    )
    return hits.groupBy("entity_dir").agg(
        F.min_by("entity_id", F.when(F.col("entity_id").isNotNull(), rank)).alias("matched")
    ).select("entity_dir", F.coalesce("matched", derived).alias("entity_id"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Planted anomalies from JSON or CSV; evidence ids as a JSON list or separated by `;`."""
    rows = read_submissions(spark, path)
    evidence = F.col("data")["evidence_ids"]
    as_list = F.from_json(evidence, "array<string>")
    parts = F.filter(F.transform(F.split(evidence, ";"), lambda x: F.trim(x)), lambda x: x != "")
    code = F.coalesce(F.col("data")["check_id"], F.col("data")["rule_code"])
    return rows.select(
        F.concat_ws("#", "file", "row_index").alias("truth_id"),
        F.col("row_index").alias("truth_order"),
        code.alias("code"),
        F.col("data")["entity_id"].alias("entity_id"),
        F.coalesce(as_list, parts, F.array().cast("array<string>")).alias("evidence_ids"),
        "data",
    )
