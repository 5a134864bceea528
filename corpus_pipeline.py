"""The corpus pipeline: each stage is one operator of vigil.llm over what the stage before has kept.

The columns of `documents` pass through all stages but the last, which returns packed pieces.  Stages read a
table and write a table in the shared folder, so that a lost executor costs a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.catalog import tokenizer_path
from vigil.llm.jaccard_join import keep_one
from vigil.llm.language_id import keep_identified
from vigil.llm.line_dedup import drop_shared_lines
from vigil.llm.packing import BESIDE_AT_ONCE, BESIDE_REMEMBERED, pack
from vigil.llm.quality_rules import keep_good
from vigil.llm.shared import ship_package, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fences of their language and source."""
    ship_package(spark)
    return keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells with enough certainty; it learns from what the stage is given."""
    ship_package(spark)
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that another document keeps; `n_chars` follows the text."""
    ship_package(spark)
    cleaned = drop_shared_lines(docs).drop("n_lines", "n_dropped")
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    ship_package(spark)
    pieces = pack(docs, tokenizer_path(), at_once=BESIDE_AT_ONCE, remembered=BESIDE_REMEMBERED)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("packing", packing),
]

#: SQL can neither train the language model of the second stage nor encode the texts of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
