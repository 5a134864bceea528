"""Quality rules with thresholds that follow the corpus.

Four whole-number measures of every text are summarised by mergeable quantile sketches, one for each
(lang, source), and each measure gets its lower and upper fence from the sketch of its own group.  The sketch
is a histogram over a fixed grid with 32 steps an octave (relative error at most 1/32): merging adds counts, so
that it doesn't depend on order, partitions or retries, a hot group is summed before the shuffle, and its size
is bounded by the grid.  A group of fewer than `min_rows` texts takes the merged sketch of its language, and a
language of fewer takes that of all texts.

Nulls, edge cases: a null or empty text has no words, fails the base rules and enters no sketch; a null lang or
source is a group like any other; repeated rows count as often as they occur; an empty table gives no rows.
Other columns of the input are left as they are; the columns added here must not exist before (ValueError).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.shared import checked_broadcast, let_go, stored, text_slices
from vigil.llm.words import Words, text_bytes, windows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
GROUP = ("lang", "source")
QUANTILES = ("q25", "q75", "top")
#: The one high quantile that is read from a sketch, of 1000.
TOP = 999


@dataclass(frozen=True)
class Measure:
    """A whole-number measure and its fences, both from the sketch of the group.

    Either `spread` interquartile ranges, and `least` units at least, beyond the quartiles (below too with `low`); or, for a
    measure that most texts have none of, with `top`, the end of the
    sketch's cell in which TOP of 1000 texts are reached.
    """

    name: str
    expression: str
    spread: int = 0
    least: int = 0
    low: bool = False
    top: bool = False


MEASURES = (
    Measure("word_length", "100 * word_chars div nullif(n_words, 0)", spread=6, least=50, low=True),
    Measure("symbol_share", "10000 * n_symbols div nullif(word_chars, 0)", spread=6, least=100),
    Measure("dup_line_share", "10000 * n_dup_lines div nullif(n_lines, 0)", top=True),
    Measure("repeat_share", "10000 * n_repeat_words div nullif(n_words, 0)", top=True),
)


@dataclass(frozen=True)
class QualityRules:
    """Measures with their fences; least rows of a group with a sketch of its own; the base rules."""

    measures: tuple[Measure, ...] = MEASURES
    min_rows: int = 200
    min_words: int = 50
    max_repeat_percent: int = 50


SYMBOL_BYTE = np.zeros(256, bool)
SYMBOL_BYTE[list(SYMBOLS)] = True


def count_text(column: pa.Array) -> list[pa.Array]:
    """COUNTS of every text of a batch."""
    words = Words(column, lower=False)
    triples = windows(words.hashes(), 3)
    inner = ~words.space
    chars = words.totals(inner & ((words.data & 0xC0) != 0x80))
    symbols = words.totals(SYMBOL_BYTE[words.data])
    n = len(column)
    lines, dup, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw, offsets = text_bytes(column)
    data = raw.tobytes()
    for i in range(n):
        full = [x for x in data[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
        a, b = words.first[i], words.first[i + 1]
        if b - a > 3:
            own = triples[a : b - 2]
            order = np.argsort(own)
            ranked = own[order]
            same = ranked[1:] == ranked[:-1]
            if same.any():
                places = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
                covered = np.zeros(b - a, bool)
                for k in range(3):
                    covered[places + k] = True
                repeat[i] = covered.sum()
    return [pa.array(x, pa.int64()) for x in (np.diff(words.first), chars, symbols, lines, dup, repeat)]


def measured(docs: DataFrame) -> DataFrame:
    """docs with the COUNTS of their texts."""
    if clash := {c.lower() for c in docs.columns} & {*COUNTS, "base_failed", "kept"}:
        raise ValueError(f"the input has columns of these names already: {sorted(clash)}")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def add(batches):
        let_go()
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, *count_text(part.column("text"))], [*part.schema.names, *COUNTS])

    return docs.mapInArrow(add, schema)


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def cell(value: str) -> str:
    """The grid cell of a whole number of at least 0: exact below 64, then 32 cells an octave."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return f"({shift}) * 32 + shiftright({value}, cast({shift} as int))"


def cell_start(cell_column: str) -> str:
    """The smallest whole number of a grid cell."""
    shift = f"greatest({cell_column} div 32 - 1, 0)"
    return f"shiftleft({cell_column} - ({shift}) * 32, cast({shift} as int))"


def sketches(counted: DataFrame, rules: QualityRules) -> DataFrame:
    """(lang, source, measure, cell, n) of the texts that pass the base rules."""
    cells = F.array(*(
        F.struct(F.lit(m.name).alias("measure"), F.expr(cell(f"({m.expression})")).alias("cell")) for m in rules.measures))
    return (
        counted.where(~base_failed(rules)).select(*GROUP, F.explode(cells).alias("at"))
        .groupBy(*GROUP, "at.measure", "at.cell").agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """Rows, quartiles, and the fences `top` of each group and measure, of sketches merged to the columns `by`."""
    merged = sketch.groupBy(*by, "measure", "cell").agg(F.sum("n").alias("n"))
    own = F.array_sort(F.collect_list(F.struct("cell", "n")))  # bounded by the grid
    grouped = merged.groupBy(*by, "measure").agg(own.alias("cells"), F.sum("n").alias("rows"))

    def at(share: str) -> str:
        """The cell in which so many of 1000 rows are reached."""
        return (
            "aggregate(cells, named_struct('seen', 0L, 'cell', cast(null as bigint)), (s, c) -> named_struct("
            f"'seen', s.seen + c.n, 'cell', coalesce(s.cell, if(1000 * (s.seen + c.n) >= {share} * rows, cast(c.cell as bigint), null))"
            ")).cell")

    return grouped.select(
        *by, "measure", "rows", F.expr(cell_start(f"({at('250')})")).alias("q25"), F.expr(cell_start(f"({at('750')})")).alias("q75"),
        F.expr(f"{cell_start(f'({at(str(TOP))} + 1)')} - 1").alias("top"))


def thresholds(counted: DataFrame, rules: QualityRules) -> DataFrame:
    """One row for each (lang, source) with the fences `low_<measure>` and `high_<measure>`; stored."""
    sketch = stored(sketches(counted, rules), "sketches")
    own = quantiles(sketch, *GROUP)
    levels = [own]
    for prefix, by in (("l_", ("lang",)), ("a_", ())):
        merged = quantiles(sketch, *by)
        levels.append(merged.select(
            *(F.col(c).alias(f"{prefix}{c}") for c in (*by, "measure", "rows", *QUANTILES))))
    joined = (
        own.join(levels[1], (F.col("measure") == F.col("l_measure")) & F.col("lang").eqNullSafe(F.col("l_lang")))
        .join(levels[2], F.col("measure") == F.col("a_measure"))
    )

    def chosen(name: str) -> Column:
        return (
            F.when(F.col("rows") >= rules.min_rows, F.col(name))
            .when(F.col("l_rows") >= rules.min_rows, F.col(f"l_{name}")).otherwise(F.col(f"a_{name}")))

    joined = joined.select(*GROUP, "measure", *(chosen(q).alias(q) for q in QUANTILES))
    fences = []
    for m in rules.measures:
        reach = F.greatest(F.lit(m.spread) * (F.col("q75") - F.col("q25")), F.lit(m.least))
        mine = F.col("measure") == m.name
        fences.append(F.max(F.when(mine, F.col("top") if m.top else F.col("q75") + reach)).alias(f"high_{m.name}"))
        if m.low:
            fences.append(F.max(F.when(mine, F.col("q25") - reach)).alias(f"low_{m.name}"))
    return stored(joined.groupBy(*GROUP).agg(*fences), "fences")


def judged(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with COUNTS, the fences of their group, `base_failed` and `kept` (both never null).

    Two passes over the texts: the first fills the sketches, the second joins the fences and decides.
    """
    counted = measured(docs)
    narrow = measured(docs.select(*GROUP, "text")).select(*GROUP, *COUNTS)
    fences = thresholds(narrow, rules)
    named = fences.withColumnsRenamed({c: f"fence_{c}" for c in GROUP})
    joined = counted.join(
        checked_broadcast(named),
        F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source")), "left",
    ).drop("fence_lang", "fence_source")
    inside = F.lit(True)
    for m in rules.measures:
        value = F.expr(f"({m.expression})")
        inside = inside & (value <= F.col(f"high_{m.name}"))
        if m.low:
            inside = inside & (value >= F.col(f"low_{m.name}"))
    failed = base_failed(rules)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(False)))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs, rules).where("kept").select(*docs.columns)
