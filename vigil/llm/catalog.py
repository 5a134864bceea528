"""The registered queries of the corpus operators and, where SQL can express them, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import sql
from vigil.llm.bpe import frequent_words, ship_lexicon, token_digests
from vigil.llm.chat_format import reply_preferences
from vigil.llm.jaccard_join import near_groups
from vigil.llm.language_id import fit, fold, identify
from vigil.llm.line_dedup import drop_shared_lines
from vigil.llm.neighbours import nearest
from vigil.llm.packing import ALONE_AT_ONCE, pack
from vigil.llm.private_data import Disclosure, listed, sanitised
from vigil.llm.quality_rules import QualityRules, judged
from vigil.llm.sharding import shards, text_size
from vigil.llm.shared import ship_package, table
from vigil.llm.spelling import variants
from vigil.llm.url_filters import judged as judged_urls
from vigil.llm.url_filters import page_links
from vigil.llm.whitening import whitened

SHARDS = 40
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
LEXICON_WORDS = 32_768
DOCUMENT = ("doc_id", "text", "lang", "source")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents", *DOCUMENT), QualityRules())
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        "doc_id", text_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    rows = identify(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, decision string")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return judged_urls(pages.select("page_id", "url"), url_rules(spark), page_links(pages)).drop("url")


def tokenizer_path() -> str:
    """The vocabulary file, which every machine of the cluster has at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = tokenizer_path()
    lexicon = ship_lexicon(spark, frequent_words(docs, path, LEXICON_WORDS), path)
    return token_digests(docs, path, lexicon)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation beside the same one with another's last reply."""
    rows = reply_preferences(table(spark, sf_dir, "conversations"))

    def ranges(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["start"], s["end"])), " ")

    return rows.select(
        "conv_id", "reply_id", F.col("n_common").cast("long").alias("n_common"),
        F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen_text", 256).alias("chosen_sha256"),
        F.sha2("rejected_text", 256).alias("rejected_sha256"), ranges("chosen_mask").alias("chosen_mask"),
        ranges("rejected_mask").alias("rejected_mask"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), at_once=ALONE_AT_ONCE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents", "doc_id", "text")).drop("digest")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_shared_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitised(table(spark, sf_dir, "documents", "doc_id", "text"), Disclosure())
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
        F.sha2("clean_text", 256).alias("clean_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 16)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package's source at hand on every worker."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: shipped(q) for q in (
        op1_quality_rules,
        op2_sharding,
        op3_language_id,
        op4_url_filters,
        op5_bpe,
        op6_chat_format,
        op7_packing,
        op8_jaccard_join,
        op9_line_dedup,
        op10_neighbours,
        op11_private_data,
        op12_spelling_variants,
        op13_embedding_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": sql.op1(QualityRules()),
    "op4_url_filters": sql.op4(URL_RULES),
    "op6_chat_format": sql.OP6,
    "op9_line_dedup": sql.OP9,
    "op11_private_data": sql.op11(Disclosure()),
    "op12_spelling_variants": sql.OP12,
}
