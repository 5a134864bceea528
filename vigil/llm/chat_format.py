"""Preference data: what two conversations share is rendered once, and what follows as two masked completions.

The longest common prefix of turns (equal role and text) of the chosen and the rejected conversation becomes the prompt.
The turns after it are the two completions; their masks are the ranges of characters that assistant turns cover
(text and end mark, without the header), which are what a model would be trained on.  DataFrame functions only.

Turns are ordered by turn, role, text, nulls first.  Edge cases: a null role or text is rendered as empty, and null
equals null; repeated rows are turns of their own; rows without a conv_id belong to no conversation; a conversation
that is missing is one without turns, so that nothing is shared and its completion is empty; equal conversations give
empty completions; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULTS = ("n_common", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Template:
    """What stands before the role, between role and text, and after the text."""

    before: str = "<|"
    between: str = "|>\n"
    after: str = "<|end|>\n"
    trained: str = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one ordered array for each conversation."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))


def common_turns(chosen: str, rejected: str) -> Column:
    """How many turns two arrays have in common from the start."""
    return F.expr(
        f"if(size({chosen}) = 0 or size({rejected}) = 0, 0, aggregate(sequence(1, least(size({chosen}), size({rejected}))), 0,"
        f" (k, i) -> if(k = i - 1 and element_at({chosen}, i).role <=> element_at({rejected}, i).role"
        f" and element_at({chosen}, i).text <=> element_at({rejected}, i).text, i, k)))")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def header(template: Template, turn: str) -> str:
    return f"concat({quoted(template.before)}, coalesce({turn}.role, ''), {quoted(template.between)})"


def rendered(turns: str, template: Template) -> Column:
    body = f"concat({header(template, 't')}, coalesce(t.text, ''), {quoted(template.after)})"
    return F.expr(f"array_join(transform({turns}, t -> {body}), '')")


def spans(turns: str, template: Template) -> Column:
    """[start, end) of the trained characters within the rendered turns."""
    head, tail = f"length({header(template, 't')})", f"(length(coalesce(t.text, '')) + {len(template.after)})"
    kind = "array<struct<start:int,end:int>>"
    step = (
        f"named_struct('at', s.at + {head} + {tail}, 'spans', if(t.role <=> {quoted(template.trained)},"
        f" concat(s.spans, array(named_struct('start', s.at + {head}, 'end', s.at + {head} + {tail}))), s.spans))")
    return F.expr(f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as {kind})), (s, t) -> {step}, s -> s.spans)")


def compared(pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows with the results for two arrays of turns (columns `chosen_turns` and `rejected_turns` of the row `pair`)."""
    rows = pairs.withColumn("n_common", common_turns("chosen_turns", "rejected_turns"))
    rows = rows.withColumn("shared_turns", F.expr("slice(chosen_turns, 1, n_common)"))
    for side in ("chosen", "rejected"):
        rows = rows.withColumn(f"{side}_turns", F.expr(f"slice({side}_turns, n_common + 1, size({side}_turns))"))
    return rows.select(
        "pair.*", "n_common", rendered("shared_turns", template).alias("prompt"),
        *(c for side in ("chosen", "rejected") for c in (
            rendered(f"{side}_turns", template).alias(f"{side}_text"), spans(f"{side}_turns", template).alias(f"{side}_mask"))))


def preferences(turns: DataFrame, pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """pairs (chosen_id, rejected_id, others) with n_common, prompt, and text and mask of both completions."""
    whole = conversations(turns)
    rows = pairs.select(F.struct(*[c for c in pairs.columns if c not in RESULTS]).alias("pair"))
    for side in ("chosen", "rejected"):
        own = whole.select(F.col("conv_id").alias(f"of_{side}"), F.col("turns").alias(f"{side}_turns"))
        rows = rows.join(own, F.col(f"pair.{side}_id") == F.col(f"of_{side}"), "left").drop(f"of_{side}")
        rows = rows.withColumn(f"{side}_turns", F.coalesce(f"{side}_turns", F.expr(f"cast(array() as {TURNS})")))
    return compared(rows, template)


def reply_preferences(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Every conversation (chosen) beside the same turns with another conversation's last reply (rejected).

    The last turn of the trained role takes the text of the last such turn of conversation conv_id + 1, if there is none, of
    conv_id - 1, else an empty text; `reply_id` is the conversation it is from.  A conversation without such a turn is
    beside itself.  Columns: conv_id, reply_id and those of `preferences`.
    """
    last = f"array_max(transform(turns, (t, i) -> if(t.role <=> {quoted(template.trained)}, i, -1)))"
    whole = conversations(turns).withColumn("last", F.expr(last))
    replies = whole.where("last >= 0").select("conv_id", F.expr("coalesce(turns[last].text, '')").alias("text"))
    rows = whole
    for name, step in (("after", 1), ("before", -1)):
        given = replies.select((F.col("conv_id") - step).alias(f"to_{name}"), F.col("text").alias(f"text_{name}"))
        rows = rows.join(given, F.col("conv_id") == F.col(f"to_{name}"), "left")
    reply = F.when(F.col("last") < 0, None).when(F.col("text_after").isNotNull(), F.col("conv_id") + 1).when(
        F.col("text_before").isNotNull(), F.col("conv_id") - 1)
    swapped = F.expr(
        "transform(turns, (t, i) -> if(i = last, named_struct('turn', t.turn, 'role', t.role, 'text',"
        " coalesce(text_after, text_before, '')), t))")
    return compared(rows.select(
        F.struct("conv_id", reply.alias("reply_id")).alias("pair"), F.col("turns").alias("chosen_turns"),
        swapped.alias("rejected_turns")), template)
