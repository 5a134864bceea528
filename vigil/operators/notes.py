"""Copied investigation notes: TF-IDF cosine and Jaccard similarity within an entity.

Notes with the same bag of words form one group and are compared once.  Groups meet through a prefix
of their terms, rarest first, two blocks of groups in a task: what two groups share in both prefixes
bounds their cosine and Jaccard similarity, so no pair is lost, and only pairs whose bound reaches a
threshold are compared term by term.  Every result stays whole: a group row names its size
and number of distinct-case pairs, `members` lists its notes, and an edge between two groups stands
for all their member pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import first_of, stable_id, text_of
from vigil.functions.text import tokens
from vigil.operators.note_blocks import (
    COUNTED, COUNTS, MISSED, PAIR, POSTING, PREFIX, SIMILAR, SLACK, TERMS, Known, compare_pairs, count_terms, meet_blocks, missed_terms,
    ordered_counts, pack_prefixes,
)
from vigil.schema import of_type
from vigil.session import scratch, settled, spread, stored

CANDIDATE_FACTOR = 0.7  # pairs below 0.7 of the cosine threshold are never reported
#: Postings of a block, whose groups meet those of another one in a task: 12 bytes each.
BLOCK_POSTINGS = 2_000_000
#: Groups of a label that are compared in one task.
LABEL_GROUPS = 1_000
#: Rows of groups that are compared, up to which they choose the vectors by a broadcast.
BROADCAST_GROUPS = 500_000
#: Terms of an entity whose counts are broadcast, some 20 bytes each; the others are joined by term.
FREQUENT_TERMS = 1_000_000
#: Postings of the groups that get the counts of their other terms in one task.
PART_POSTINGS = 1_000_000
#: Shares of the groups whose terms move one after the other, and the postings from which they do.
SLICES, SLICED_POSTINGS = 4, 4_000_000
#: Bytes of postings that move at a time when blocks meet, or as many as there are at all.
ROUND_BYTES = 64_000_000


def note_corpus(events: DataFrame, min_tokens: int = 10) -> DataFrame:
    """Notes long enough to compare, with their bag-of-words signature."""
    rows = spread(
        of_type(events, "investigation_records").select(
            "entity_id", "event_id",
            first_of("case_id", "raw_ref_id", F.lit("Case")).alias("case_key"),
            text_of(first_of("analyst_id", "user_id"), "Unknown").alias("analyst"),
            F.coalesce("asset_id", F.lit("")).alias("asset"),
            first_of("investigation_notes", "conclusion", "action_taken").alias("text"),
        ).where(F.col("text").isNotNull())
    )
    words = tokens("text")
    return (
        rows.select(
            "entity_id", "event_id", "case_key", "analyst", "asset",
            # reading the partition id keeps the length test from being pushed below this
            # projection, where it would split every text a second time
            F.when(F.spark_partition_id() >= 0, words).alias("tokens"),
        )
        .where(F.size("tokens") >= min_tokens)
        .withColumn("bag", F.sha2(F.array_join(F.sort_array("tokens"), " "), 256))
    )


def with_text(corpus: DataFrame) -> DataFrame:
    """The notes with their sorted words as one text, which is stored and moved in a third of the bytes; no word has a blank."""
    return corpus.withColumn("text", F.array_join(F.sort_array("tokens"), " ")).drop("tokens")


def note_groups(corpus: DataFrame) -> DataFrame:
    """Distinct bags of words per entity with their representative note."""
    rep = F.min_by(F.struct("event_id", "case_key", "analyst", "asset"), F.col("event_id"))
    grouped = (corpus if "text" in corpus.columns else with_text(corpus)).groupBy("entity_id", "bag").agg(
        F.count("*").alias("size"), rep.alias("rep"), F.first("text").alias("text")
    )
    return grouped.select("entity_id", "bag", "size", "rep", "text", F.split("text", " ").alias("tokens"))


def term_vectors(groups: DataFrame) -> DataFrame:
    """One row per group: gid, entity_id, bag, size and `v`, its unit TF-IDF vector (df, term, w), rarest term first."""
    return unit_vectors(term_counts(groups))


def unit_vectors(counts: DataFrame) -> DataFrame:
    """The vectors of `term_counts`: tf is the raw count and idf = ln((1 + N) / (1 + df)) + 1, with N and df counting notes."""
    weigh = lambda t: F.named_struct(
        F.lit("df"), t["df"], F.lit("term"), t["term"],
        F.lit("w"), t["tf"] * (F.ln((1.0 + F.col("docs")) / (1.0 + t["df"])) + 1.0))
    # each step is a generator's, so that the next doesn't work it out again for each term
    weighed = counts.withColumn("v", F.explode(F.array(F.transform("counts", weigh)))).drop("counts", "docs")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))
    return weighed.withColumn("norm", F.explode(F.array(norm))).withColumn("v", F.transform("v", lambda t: F.named_struct(
        F.lit("df"), t["df"], F.lit("term"), t["term"], F.lit("w"), t["w"] / F.col("norm")))).drop("norm")


def term_counts(groups: DataFrame, least: tuple[float, float] | None = None) -> DataFrame:
    """One row per group, stored: gid, entity_id, bag, size, docs and `counts`, its terms (df, term, tf), rarest first.

    With the least cosine and Jaccard similarity of a pair, they have n, core and the packed postings of their prefix too.

    Frequent terms are looked up in a bounded broadcast; the postings of the others alone are dealt by term, and what is found
    goes back to their group.  The groups come in slices, so that those of one slice only are moving.  Weights are not stored:
    they are twice the rest.
    """
    with scratch(groups.sparkSession):
        counted = groups.select("entity_id", "bag", "size", "text").mapInArrow(count_terms, TERMS)
        notes = settled(counted.select(
            "*", F.monotonically_increasing_id().alias("gid"), F.pmod(F.xxhash64("bag"), F.lit(SLICES)).cast("int").alias("slice"),
        ), "note-terms", by="slice")
        posted = lambda rows: rows.select("gid", "entity_id", "size", F.explode("terms").alias("t")).select(
            "gid", "entity_id", "size", "t.term", "t.tf")
        # a term of one group only has that group's size as its df
        shared = settled(posted(notes).groupBy("entity_id", "term").agg(
            F.sum("size").alias("df"), F.count("*").alias("groups")).where("groups > 1"), "note-df")
        docs = settled(notes.groupBy("entity_id").agg(F.sum("size").alias("docs"), F.sum(F.size("terms")).alias("postings")), "note-docs")
        step = F.floor(F.log2("groups") * 8)
        lowest, total = 0, 0
        for row in shared.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
            total += row["n"]
            if total > FREQUENT_TERMS:
                lowest = row["step"] + 1
                break
        frequent = groups.sparkSession.sparkContext.broadcast(
            Known.of(shared.where(step >= lowest).select("entity_id", "term", "df").toArrow()))
        known = lambda: frequent.value
        rare = shared.where(step < lowest).select("entity_id", "term", "df")

        def with_df(rows: DataFrame) -> DataFrame:
            part = F.pmod(F.xxhash64("gid"), F.lit(parts)).alias("part")
            missed = rows.select("gid", "entity_id", "terms").mapInArrow(missed_terms(known), MISSED)
            found = missed.join(rare, ["entity_id", "term"]).select("gid", "at", "df", part)
            dealt = rows.join(docs.drop("postings"), "entity_id").select("entity_id", "gid", "bag", "size", "docs", "terms", part)
            return dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(
                ordered_counts(known, least), COUNTED if least else COUNTS)

        postings = docs.agg(F.sum("postings")).first()[0] or 0
        slices = [notes] if postings <= SLICED_POSTINGS else [notes.where(F.col("slice") == i) for i in range(SLICES)]
        parts = max(1, -(-postings // (PART_POSTINGS * len(slices))))
        counts = settled(map(with_df, slices), "note-counts", keep=True)
        frequent.destroy()
        return counts


def term_weights(groups: DataFrame) -> DataFrame:
    """The unit vectors in long form."""
    return term_vectors(groups).select("entity_id", "bag", F.explode("v").alias("t")).select("entity_id", "bag", "t.term", "t.df", "t.w")


def prefixes(vectors: DataFrame, cosine: float, jaccard: float) -> DataFrame:
    """One row per group with the packed postings of its prefix (see `note_blocks`)."""
    listed = vectors.select(
        "gid", "entity_id", "size", F.transform("v", lambda t: F.hash(t["term"])).alias("keys"),
        F.col("v.df").alias("df"), F.col("v.w").alias("w"))
    return listed.mapInArrow(pack_prefixes(cosine, jaccard), PREFIX)


def in_blocks(packed: DataFrame) -> DataFrame:
    """The rows of `prefixes` with the block of their entity: groups of like length, and like share of heavy terms, come together.

    A block has BLOCK_POSTINGS at most, give or take what chance does where many groups are alike.
    """
    like = packed.select(
        "*", F.octet_length("postings").alias("bytes"),
        F.floor(F.log2(F.col("n") / F.greatest("core", F.lit(1))) * 2).alias("kind"), F.floor(F.log2("n") * 8).alias("length"))
    entity = Window.partitionBy("entity_id")
    before = F.sum("bytes").over(entity.orderBy("kind", "length")) - F.col("bytes")
    bins = like.groupBy("entity_id", "kind", "length").agg(F.sum("bytes").alias("bytes")).select(
        "entity_id", "kind", "length", before.alias("before"), F.col("bytes").alias("own"), F.sum("bytes").over(entity).alias("whole"))
    blocks = F.ceil(F.col("whole") / (BLOCK_POSTINGS * POSTING.itemsize))
    place = (F.col("before") + F.col("own") * (F.pmod(F.xxhash64("gid"), F.lit(1 << 20)) / (1 << 20))) / F.col("whole")
    return like.join(bins, ["entity_id", "kind", "length"]).select(
        "gid", "entity_id", "n", "core", "postings", F.least(F.floor(place * blocks), blocks - 1).alias("block"))


def block_pairs(rows: DataFrame, jaccard: float) -> DataFrame:
    """(entity_id, one, two, bytes): the pairs of blocks that can hold a pair of groups, by what `note_blocks` asks of each pair."""
    blocks = rows.groupBy("entity_id", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("core").alias("core"), F.sum(F.octet_length("postings")).alias("bytes"))
    a, b = blocks.alias("a"), blocks.alias("b")
    heavy = (F.col("a.most") >= F.col("b.core")) & (F.col("b.most") >= F.col("a.core"))
    near = (F.col("b.most") >= jaccard * F.col("a.least") - SLACK) & (F.col("a.most") >= jaccard * F.col("b.least") - SLACK)
    return a.join(b, (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.block") <= F.col("b.block")) & (heavy | near)).select(
        "a.entity_id", F.col("a.block").alias("one"), F.col("b.block").alias("two"),
        (F.col("a.bytes") + F.when(F.col("a.block") < F.col("b.block"), F.col("b.bytes")).otherwise(0)).alias("bytes"))


def candidate_pairs(vectors: DataFrame, cosine: float, jaccard: float) -> DataFrame:
    """(a, b), stored: numbers of groups, among them all that reach a threshold (see `meeting_pairs`)."""
    return meeting_pairs(settled(prefixes(vectors, cosine, jaccard), "note-prefixes"), cosine, jaccard)


def meeting_pairs(packed: DataFrame, cosine: float, jaccard: float) -> DataFrame:
    """(a, b), stored, from the rows of `prefixes`.

    In the order of (df, term), let a pair's zone be its common terms at which the product of both `rest` is at least s^2, with
    s below the cosine's threshold.  The terms behind the zone give less than s, so those within must give the difference.
    The same holds for Jaccard, where m terms have to be common: behind the zone of the terms at which both have
    a share of m left, fewer than that are common.  A key that stands for two terms only adds to a sum.

    The groups of an entity are dealt to blocks, and each pair of blocks that can hold a pair meets in one task: a row moves
    once for each of them.  These moves grow with the square of an entity, so that they are made in rounds, each of no more bytes
    than the rows have themselves; nothing else that grows with the pairs moves but the candidates.
    """
    with scratch(packed.sparkSession):
        rows = settled(in_blocks(packed), "note-blocks")
        meeting = settled(block_pairs(rows, jaccard), "note-meetings")
        own = rows.agg(F.sum(F.octet_length("postings"))).first()[0] or 0
        found = meeting.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).first()
        rounds = max(1, -(-(found["bytes"] or 0) // max(own, ROUND_BYTES)))

        def met(at: int) -> DataFrame:
            now = meeting.where(F.pmod(F.xxhash64("entity_id", "one", "two"), F.lit(rounds)) == at).select("entity_id", "one", "two")
            moves = now.select("*", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
            if found["n"] // rounds <= BROADCAST_GROUPS:
                moves = F.broadcast(moves)
            return rows.join(moves, ["entity_id", "block"]).select(
                "entity_id", "one", "two", "block", "gid", "n", "core", "postings",
            ).groupBy("entity_id", "one", "two").applyInArrow(meet_blocks(cosine, jaccard), PAIR)

        return settled(map(met, range(rounds)), "note-pairs", keep=True)


def similar_groups(
    groups: DataFrame, cosine: float = 0.85, jaccard: float = 0.80
) -> DataFrame:
    """Pairs of different bags with cosine >= 0.85 or Jaccard >= 0.80 (and cosine above the floor)."""
    counts = term_counts(groups, (cosine, jaccard))
    packed = counts.select("gid", "entity_id", "n", "core", "postings").where(F.octet_length("postings") > 0)
    candidates = meeting_pairs(packed, cosine, jaccard)
    rows, pairs = dealt_pairs(counts, candidates)
    together = rows.groupBy("label", "x", "y").cogroup(pairs.groupBy("label", "x", "y"))
    return together.applyInArrow(compare_pairs(cosine, jaccard, cosine * CANDIDATE_FACTOR), SIMILAR)


def dealt_pairs(counts: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, pairs), both with the task (label, x, y) in which they are compared.

    A pair goes to the smallest number next to its first group, so that the pairs of near copies come together and the vector
    of a group moves once for them all, not once for each pair.  Labels of many groups are dealt to pairs of blocks.
    """
    near = candidates.union(candidates.select("b", "a")).groupBy("a").agg(F.min("b").alias("near"))
    labelled = settled(candidates.join(near, "a").select("a", "b", F.least("a", "near").alias("label")), "note-labels")
    members = labelled.select("label", F.explode(F.array("a", "b")).alias("gid")).distinct()
    blocks = members.groupBy("label").agg(F.ceil(F.count("*") / LABEL_GROUPS).alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), "blocks")
    pairs = settled(labelled.join(blocks, "label").select("label", block("a").alias("x"), block("b").alias("y"), "a", "b"), "note-tasks")
    wanted = settled(pairs.select("label", "x", "y", F.explode(F.array("a", "b")).alias("gid")).distinct(), "note-wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_GROUPS else wanted
    rows = counts.join(few, "gid").select("label", "x", "y", "gid", "entity_id", "bag", "docs", *(
        F.col(f"counts.{c}").alias("terms" if c == "term" else c) for c in ("term", "df", "tf")))
    return rows, pairs


def note_members(corpus: DataFrame) -> DataFrame:
    """Long form of the groups: every note with its bag.

    With the pairs of `similar_groups`, and each bag with itself, it gives all pairs of similar notes: those of
    different cases, and those without a case.
    """
    return corpus.select("entity_id", "bag", "event_id", "case_key", "analyst", "asset")


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def clone_groups(corpus: DataFrame) -> DataFrame:
    """Groups of identical bags with the number of note pairs from different cases."""
    per_case = corpus.groupBy("entity_id", "bag", "case_key").agg(F.count("*").alias("n"))
    same_case = F.when(F.col("case_key") != "Case", _pairs(F.col("n"))).otherwise(0.0)
    return (
        per_case.groupBy("entity_id", "bag")
        .agg(F.sum("n").alias("size"), F.count("*").alias("cases"), F.sum(same_case).alias("same"))
        .select("entity_id", "bag", "size", "cases", (_pairs(F.col("size")) - F.col("same")).cast("bigint").alias("pair_count"))
        .where(F.col("pair_count") > 0)
    )


def similar_group_edges(corpus: DataFrame, cosine: float = 0.85, jaccard: float = 0.80) -> DataFrame:
    """One row per pair of similar groups: scores, representatives, pairs of notes it stands for.

    `corpus` is read several times and should be stored.
    """
    groups = note_groups(corpus)
    with scratch(corpus.sparkSession):
        pairs = settled(similar_groups(groups, cosine, jaccard), "similar-notes", keep=True)  # read twice below
    info = groups.select("entity_id", "bag", "size", "rep")
    ia = info.select("entity_id", F.col("bag").alias("bag_a"), F.col("size").alias("size_a"), F.col("rep").alias("rep_a"))
    ib = info.select("entity_id", F.col("bag").alias("bag_b"), F.col("size").alias("size_b"), F.col("rep").alias("rep_b"))
    per_case = corpus.where(F.col("case_key") != "Case").groupBy("entity_id", "bag", "case_key").agg(
        F.count("*").alias("n")
    )
    ca = per_case.select("entity_id", F.col("bag").alias("bag_a"), "case_key", F.col("n").alias("na"))
    cb = per_case.select("entity_id", F.col("bag").alias("bag_b"), "case_key", F.col("n").alias("nb"))
    same = (
        pairs.select("entity_id", "bag_a", "bag_b")
        .join(ca, ["entity_id", "bag_a"])
        .join(cb, ["entity_id", "bag_b", "case_key"])
        .groupBy("entity_id", "bag_a", "bag_b")
        .agg(F.sum(F.col("na") * F.col("nb")).alias("same"))
    )
    return (
        pairs.join(ia, ["entity_id", "bag_a"])
        .join(ib, ["entity_id", "bag_b"])
        .join(same, ["entity_id", "bag_a", "bag_b"], "left")
        .withColumn(
            "pair_count", (F.col("size_a") * F.col("size_b") - F.coalesce("same", F.lit(0))).cast("bigint")
        )
        .where(F.col("pair_count") > 0)
        .drop("same")
    )


def _edge(df: DataFrame, a: str, b: str, cosine, jaccard, shared, pairs) -> DataFrame:
    cos, jac = F.round(cosine, 4), F.round(jaccard, 4)
    return df.select(
        stable_id(F.lit("TFIDF_NOTE_SIMILARITY"), "entity_id", f"{a}.event_id", f"{b}.event_id").alias("correlation_id"),
        "entity_id",
        F.lit("TFIDF_NOTE_SIMILARITY").alias("correlation_type"),
        F.col(f"{a}.event_id").alias("primary_event_id"),
        F.col(f"{b}.event_id").alias("correlated_event_id"),
        first_of(f"{a}.asset", f"{b}.asset").alias("asset_id"),
        F.round(F.greatest(cosine, jaccard), 4).alias("similarity_score"),
        F.create_map(
            F.lit("cosine_similarity"), cos.cast("string"),
            F.lit("jaccard_similarity"), jac.cast("string"),
            F.lit("case_id_a"), F.col(f"{a}.case_key"),
            F.lit("case_id_b"), F.col(f"{b}.case_key"),
            F.lit("analyst_a"), F.col(f"{a}.analyst"),
            F.lit("analyst_b"), F.col(f"{b}.analyst"),
            F.lit("shared_tokens"), F.array_join(shared, " "),
            F.lit("pair_count"), pairs.cast("string"),
        ).alias("shared_attributes"),
        F.format_string(
            "Investigation note boilerplate clone detected between Case %s and Case %s "
            "(TF-IDF Cosine=%.2f, Jaccard=%.2f). Indicates copy-paste rubber-stamp triage.",
            F.col(f"{a}.case_key"), F.col(f"{b}.case_key"), cosine, jaccard,
        ).alias("rationale"),
    )


def note_edges(events: DataFrame, cosine: float = 0.85, jaccard: float = 0.80, min_tokens: int = 10) -> DataFrame:
    """Correlation edges: representative to each copy of a different case, and group to group.

    Copies of the representative's own case are no pair with it, but are with copies of other cases: `note_members`
    holds them all.
    """
    corpus = settled(with_text(note_corpus(events, min_tokens)), "notes")  # splitting the texts is the costly part
    groups = note_groups(corpus)
    member = F.struct("event_id", "case_key", "analyst", "asset").alias("copy")
    copies = (
        corpus.select("entity_id", "bag", member, "text")
        .join(groups.select("entity_id", "bag", "rep"), ["entity_id", "bag"])
        .where(
            (F.col("copy.event_id") != F.col("rep.event_id"))
            & ((F.col("copy.case_key") != F.col("rep.case_key")) | (F.col("rep.case_key") == "Case"))
        )
    )
    one = F.lit(1.0)
    shared = F.slice(F.array_distinct(F.split("text", " ")), 1, 15)
    stars = _edge(copies, "rep", "copy", one, one, shared, F.lit(1))
    between = similar_group_edges(corpus, cosine, jaccard)
    return stars.unionByName(
        _edge(between, "rep_a", "rep_b", F.col("cosine"), F.col("jaccard"), F.col("shared_tokens"), F.col("pair_count"))
    )
