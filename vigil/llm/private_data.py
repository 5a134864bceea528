"""Personal data: patterns find the protected values, and corpus co-occurrence the terms that give them away.

Base spans are the matches of four patterns (email, ip, card, phone), checked by rules.  Each value is a protected
entity, and so is its group (domain, network, issuer, area).  The words within `reach` characters of a value, and not
beyond the next match of its pattern, are its neighbourhood.  Over the whole corpus, a term's disclosure of an entity is its pointwise mutual information with that
neighbourhood over the entity's information content,

    (ln P(near entity | term) - ln P(near entity)) / -ln P(near entity),

1 for a term that stands nowhere else.  In texts that hold the entity, a term of which the disclosure is at least
`remove` is taken out everywhere, one of at least `generalise` is replaced by its kind of word.  A pair of term and entity
counts from `texts` different texts on, since one text is no evidence; copies of a text add to counts, not to evidence.

Texts are worked on once for each different text.  Those without a base span are clean: nothing in them is protected, and
nothing is shuffled for them.  Places are code points.

Edge cases: a null text is empty; a row without an id is judged like any other; repeated rows give a row each; spans of
different kinds may overlap in the list, and are one replacement in the cleaned text, of the first one's kind; equal
disclosures of several entities are one span.  The columns of docs stay, but those named like a result
(`RESULTS`) are replaced.  An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.shared import checked_broadcast, stored

#: Kinds of base spans in their order, then the method's.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalised", "removed")
RESULTS = ("n_email", "n_ip", "n_card", "n_phone", "base", "spans", "clean_text")

LOCAL = "[A-Za-z0-9._%+-]"
#: The patterns begin only where a run of their characters does (or a match ended), which finds the same matches, each
#: place read a bounded number of times.  A card's pattern takes the maximal chains of 12 to 19 digits.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]+"
#: Characters of a block in which a text is put together again.
BLOCK = 4096

SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"


@dataclass(frozen=True)
class Disclosure:
    """Reach of a neighbourhood in characters, least texts of a pair, and the two thresholds."""

    reach: int = 100
    texts: int = 2
    generalise: float = 0.75
    remove: float = 0.95


def pattern(kind: str) -> Column:
    return F.lit(PATTERNS[kind])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def entities(kind: str, value: Column) -> Column:
    """The protected value and its group, in one form of writing."""
    if kind == "email":
        own = F.lower(value)
        group = F.element_at(F.split(own, "@"), -1)
    elif kind == "ip":
        own = value
        group = F.substring_index(value, ".", 2)
    else:
        own = digits(value)
        group = F.substring(own, F.lit(1), F.lit(6) if kind == "card" else F.length(own) - 7)
    return F.array(F.concat(F.lit(f"{kind} "), own), F.concat(F.lit(f"{kind} group "), group))


def key_of(text: Column) -> Column:
    """A digest of a text in which a pattern matches, else null."""
    signs = {"email": "@", "ip": ".", "phone": "+"}
    some = [F.contains(text, F.lit(signs[k])) & text.rlike(PATTERNS[k]) if k in signs else text.rlike(PATTERNS[k]) for k in KINDS]
    return F.when(reduce(lambda a, b: a | b, some), F.sha2(text, 256))


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def matches(texts: DataFrame) -> DataFrame:
    """(key, copies, kind, start, end, entity, before, after): base spans of texts with the strings around them; stored.

    A match lies behind all strings between matches and all matches before it; both come in order.
    """
    found = []
    for rank, kind in enumerate(KINDS):
        gaps = F.split("text", PATTERNS[kind], -1)
        parts = texts.where(F.col("text").rlike(PATTERNS[kind])).select(
            "key", "copies", F.regexp_extract_all("text", pattern(kind), F.lit(0)).alias("value"), gaps.alias("before"))
        rows = parts.select("key", "copies", F.posexplode(F.arrays_zip(
            "value", "before", F.slice("before", F.lit(2), F.size("value")).alias("after"))).alias("i", "m")).where("m.value is not null")
        found.append(rows.select(
            "key", "copies", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "i", "m.value", F.length("m.before").alias("skip"),
            reach_of(F.col("m.before"), left=True).alias("before"), reach_of(F.col("m.after"), left=False).alias("after"),
            valid(kind, F.col("m.value")).alias("valid"), entities(kind, F.col("m.value")).alias("entities")))
    rows = reduce(DataFrame.unionByName, found)
    so_far = Window.partitionBy("key", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("skip").cast("long") + F.length("value")).over(so_far)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return stored(placed.where("valid").drop("valid", "i", "skip", "value"), "base-spans")


#: Characters kept around a match: a neighbourhood and one more, which tells whether a word was cut.
KEPT = 400


def reach_of(gap: Column, left: bool) -> Column:
    return F.when(F.length(gap) <= KEPT, gap).otherwise(
        F.right(gap, F.lit(KEPT)) if left else F.left(gap, F.lit(KEPT)))


def words_in(part: Column) -> Column:
    """Words of a short string with their places in it."""
    words, gaps = F.regexp_extract_all(part, F.lit(WORD), F.lit(0)), F.split(part, WORD, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,at:int>>").alias("words"))
    return F.aggregate(
        F.arrays_zip(words.alias("w"), gaps.alias("g")), start,
        lambda a, x: F.when(x["w"].isNull(), a).otherwise(F.struct(
            (a["at"] + F.length(x["g"]) + F.length(x["w"])).alias("at"),
            F.concat(a["words"], F.array(F.struct(x["w"].alias("word"), (a["at"] + F.length(x["g"])).alias("at")))).alias("words"))),
        lambda a: a["words"])


def neighbourhoods(spans: DataFrame, options: Disclosure) -> DataFrame:
    """(key, copies, entity, term, start, end): words near a value that lie in no base span, each place once; stored."""
    if options.reach >= KEPT:
        raise ValueError(f"reach has to be below {KEPT}")
    reach = F.lit(options.reach)
    left, right = F.right("before", reach), F.left("after", reach)
    sides = spans.select(
        "key", "copies", "entities", "start", "end", "before", "after", left.alias("left"), right.alias("right"),
        F.length("before").alias("n_before"), F.length("after").alias("n_after"))
    l_words = sides.select(
        "key", "copies", "entities", F.explode(words_in(F.col("left"))).alias("w"), (F.col("start") - F.length("left")).alias("origin"),
        (F.col("n_before") > reach).alias("cut_head"), F.lit(False).alias("cut_tail"))
    r_words = sides.select(
        "key", "copies", "entities", F.explode(words_in(F.col("right"))).alias("w"), F.col("end").alias("origin"),
        F.lit(False).alias("cut_head"), (F.col("n_after") > reach).alias("cut_tail"))
    begin = F.col("w.at")
    whole = ~(F.col("cut_head") & (begin == 0)) & ~(F.col("cut_tail") & (begin + F.length("w.word") == reach))
    near = l_words.union(r_words).where(whole).select(
        "key", "copies", F.explode("entities").alias("entity"), F.lower("w.word").alias("term"), (F.col("origin") + begin).alias("start"),
        (F.col("origin") + begin + F.length("w.word")).alias("end"))
    return stored(outside(near.dropDuplicates(["key", "entity", "start"]), spans), "neighbourhoods")


def outside(words: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of words (key, start, end, ...) that no span (key, start, end) of the same text touches."""
    marks = spans.select("key", "start", "end").withColumn("is_span", F.lit(True)).unionByName(
        words.withColumn("is_span", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("key").orderBy("start", F.desc("is_span"))
    past = F.max(F.when(F.col("is_span"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # all places of a later start lie behind; the least of them is the next span
    coming = F.min(F.when(F.col("is_span"), F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = (F.coalesce(past, F.lit(0)) <= F.col("start")) & (coming.isNull() | (coming >= F.col("end")))
    return marks.withColumn("free", free).where("free and not is_span").drop("is_span", "free")


def word_counts(docs: DataFrame) -> DataFrame:
    """(term, n) over all documents; stored."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    return stored(words.groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("n")), "word-counts")


def revealing(near: DataFrame, counts: DataFrame, options: Disclosure) -> DataFrame:
    """(entity, term, disclosure) of the pairs that reach a threshold; stored."""
    per_text = near.groupBy("entity", "term", "key").agg(F.sum("copies").alias("n"))
    pairs = per_text.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("texts"))
    # a row for each entity; the pairs of a frequent group stay where they are unless there are very many entities
    around = checked_broadcast(stored(near.groupBy("entity").agg(F.sum("copies").alias("around")), "around"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = pairs.where(F.col("texts") >= options.texts).join(around, "entity").join(counts, "term").crossJoin(F.broadcast(total))
    information = -F.log(F.col("around") / F.col("total"))
    disclosure = 1 + F.log(F.least(F.lit(1.0), F.col("together") / F.col("n"))) / information
    rows = rows.select("entity", "term", F.when(information > 0, disclosure).alias("disclosure"))
    return stored(rows.where(F.col("disclosure") >= options.generalise), "revealing")


def term_spans(texts: DataFrame, spans: DataFrame, near: DataFrame, revealed: DataFrame, options: Disclosure) -> DataFrame:
    """(key, start, end, kind, word): all places of a term in the texts that hold an entity it reveals."""
    told = stored(near.join(revealed, ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure")), "told")
    parts = texts.join(told.select("key").distinct(), "key", "left_semi").select(
        "key", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word"), F.split("text", WORD, -1).alias("gap"))
    rows = parts.select("key", F.posexplode(F.arrays_zip("word", "gap")).alias("i", "w")).select(
        "key", "i", "w.word", F.length("w.gap").alias("skip")).where("word is not null")
    so_far = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("skip").cast("long") + F.length("word")).over(so_far))
    rows = rows.select("key", "word", (F.col("end") - F.length("word")).alias("start"), "end", F.lower("word").alias("term"))
    rows = outside(rows.join(told, ["key", "term"]), spans)
    kind = F.when(F.col("disclosure") >= options.remove, F.lit("removed")).otherwise(F.lit("generalised"))
    return rows.select("key", "start", "end", kind.alias("kind"), "word")


def replacement(kind: Column, word: Column) -> Column:
    """What stands for a span in the cleaned text; a removed term leaves nothing."""
    general = F.when(word.rlike(r"^\p{N}+$"), "[number]").when(word.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    return F.when(kind == "removed", F.lit("")).when(kind == "generalised", general).otherwise(F.concat(F.lit("["), kind, F.lit("]")))


def cleaned(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, clean_text): texts with their spans (key, start, end, rank, put) replaced, put together block by block."""
    order = Window.partitionBy("key").orderBy("start", "rank")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("before", F.coalesce(before, F.lit(0)))
    joined = F.col("before") > F.col("start")  # overlaps: a part of the replacement that is there
    cut = cut.select(
        "key", F.greatest("start", "before").alias("start"), "end", F.when(joined, F.lit("")).otherwise(F.col("put")).alias("put"), "rank",
    ).where(F.col("end") > F.col("start"))
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)
    local = cut.select("key", "start", "end", "put", first.alias("first"), F.explode(F.sequence(first, last)).alias("block")).select(
        "key", "block", F.struct(
            F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0)).cast("int").alias("start"),
            F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK)).cast("int").alias("end"),
            F.when(F.col("block") == F.col("first"), F.col("put")).otherwise(F.lit("")).alias("put")).alias("span"))
    edits = local.groupBy("key", "block").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    blocks = texts.join(spans.select("key").distinct(), "key", "left_semi").select(
        "key", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block", "part"))
    both = blocks.select("key", F.col("block").cast("long").alias("block"), "part").join(edits, ["key", "block"], "left")
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    kept = F.zip_with(
        F.slice(ends, F.lit(1), F.size("spans")), F.col("spans"),
        lambda at, s: F.concat(F.substring(F.col("part"), at + 1, s["start"] - at), s["put"]))
    tail = F.substring(F.col("part"), F.element_at(ends, -1) + 1, F.length("part"))
    done = F.when(F.col("spans").isNull(), F.col("part")).otherwise(F.concat(F.array_join(kept, ""), tail))
    ready = both.select("key", F.struct("block", done.alias("part")).alias("p"))
    return ready.groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        "key", F.array_join(F.col("p.part"), "").alias("clean_text"))


def in_order(rows: Column) -> Column:
    return F.array_sort(F.collect_list(rows))


def sanitised(docs: DataFrame, options: Disclosure = Disclosure()) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base and spans (arrays of start, rank, kind, end) and clean_text."""
    keyed = docs.select(F.struct(*[c for c in docs.columns if c not in RESULTS]).alias("doc"), text_of(docs).alias("text"))
    keyed = keyed.withColumn("key", key_of(F.col("text")))
    texts = stored(
        keyed.where("key is not null").groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "private-texts")
    base = matches(texts)
    near = neighbourhoods(base, options)
    revealed = revealing(near, word_counts(docs), options)
    own = base.select("key", "start", "end", "rank", "kind", F.lit("").alias("word"))
    ranks = F.when(F.col("kind") == "generalised", len(KINDS)).otherwise(len(KINDS) + 1)
    more = term_spans(texts, base, near, revealed, options).withColumn("rank", ranks)
    every = stored(own.unionByName(more).withColumn("put", replacement(F.col("kind"), F.col("word"))), "spans")
    span = F.struct("start", "rank", "kind", "end")
    counts = [F.count(F.when(F.col("kind") == k, True)).alias(f"n_{k}") for k in KINDS]
    lists = every.groupBy("key").agg(*counts, in_order(F.when(F.col("rank") < len(KINDS), span)).alias("base"), in_order(span).alias("spans"))
    done = stored(lists.join(cleaned(texts, every), "key"), "sanitised")
    held = keyed.where("key is not null").join(done, "key", "left")
    none = F.array().cast(SPAN)
    with_key = held.select(
        "doc.*", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.coalesce("base", none).alias("base"),
        F.coalesce("spans", none).alias("spans"), F.coalesce("clean_text", "text").alias("clean_text"))
    without = keyed.where("key is null").select(
        "doc.*", *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS], none.alias("base"), none.alias("spans"), F.col("text").alias("clean_text"))
    return with_key.unionByName(without)


def listed(spans: str) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
