"""Preference formatting: a shared prompt and two masked completions. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import join_spread

#: The assistant's turns are what a model is trained on.
TRAINED_ROLE = "assistant"
TURN_END = "<|end|>\n"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row for each conversation, its turns ordered by number, then role, then text, nulls first.

    Rows with a null conv_id belong to no conversation and are left out; repeated rows stay, each a turn. A
    conversation is one training example, so it must fit in a row; no row holds more than one conversation.
    """
    known = turns.filter(F.col("conv_id").isNotNull())
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    return known.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def opening_groups(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen_id, n): conversations that open with the same role and text, under the least of their ids.

    Minima and counts are combined before each shuffle, so one opening may be shared by a third of all conversations.
    """
    known = turns.filter(F.col("conv_id").isNotNull())
    first = known.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("first"))
    marked = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    opening = F.sha2(F.concat_ws("\x00", marked(F.col("first.role")), marked(F.col("first.text"))), 256)
    keyed = first.select("conv_id", opening.alias("opening"))
    groups = keyed.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n"))
    # the count decides where rows are dealt, and stays as a column
    return join_spread(keyed, groups.withColumn("rows", F.col("n")), "opening", "rows").select("conv_id", "chosen_id", "n")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit(TURN_END))


def _completion(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Runs of the completion in order, as code points:trained, with trained 1 for the assistant's turns and else 0."""
    part = lambda t: F.concat(F.length(_rendered(t)).cast("string"), F.lit(":"), F.when(t["role"] == TRAINED_ROLE, "1").otherwise("0"))
    return F.array_join(F.transform(turns, part), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns have the same role and text in both arrays; turn numbers are not compared."""
    pairs = F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), F.least(F.size(a), F.size(b)))
    same = F.transform(pairs, lambda p: p["a"]["role"].eqNullSafe(p["b"]["role"]) & p["a"]["text"].eqNullSafe(p["b"]["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("bigint")


def reply_start(turns: Column) -> Column:
    """Turns before the last assistant turn, or all where there is none."""
    back = F.array_position(F.reverse(F.transform(turns, lambda t: F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False)))), F.lit(True))
    return F.when(back == 0, F.size(turns)).otherwise(F.size(turns) - back).cast("bigint")


def render(pairs: DataFrame) -> DataFrame:
    """Format rows (chosen_id, rejected_id, chosen, rejected), the last two arrays of turns, rejected null for none.

    The longest common turn prefix becomes the prompt; without a rejected conversation it ends before the last
    assistant turn. Each completion holds the turns that follow, with the mask of _mask. Null roles and texts are
    rendered as empty; equal conversations get empty completions.
    """
    cut = F.when(F.col("rejected").isNull(), reply_start(F.col("chosen"))).otherwise(common_prefix(F.col("chosen"), F.col("rejected")))
    rows = pairs.withColumn("n_common", cut)
    rest = lambda c: F.slice(F.col(c), (F.col("n_common") + 1).cast("int"), F.size(c))
    return rows.select(
        "chosen_id",
        "rejected_id",
        "n_common",
        _completion(F.slice(F.col("chosen"), F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
        _completion(rest("chosen")).alias("chosen"),
        _mask(rest("chosen")).alias("chosen_mask"),
        F.when(F.col("rejected").isNotNull(), _completion(rest("rejected"))).alias("rejected"),
        F.when(F.col("rejected").isNotNull(), _mask(rest("rejected"))).alias("rejected_mask"),
    )


def preference_format(turns: DataFrame) -> DataFrame:
    """Pair conversations by their opening turn and format every one.

    Of those that open alike, the one with the least conv_id is chosen and each other one is rejected against it; a
    conversation that opens like no other is formatted alone, with rejected_id null. So each conversation appears, and
    an empty table gives no rows. Texts are shuffled once by conversation; only members of a group meet their chosen
    conversation, and a large group is dealt over tasks for that. Other columns are not read.
    """
    narrow = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = conversations_of(narrow).join(opening_groups(narrow), "conv_id")
    alone = whole.filter(F.col("n") == 1).select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast(whole.schema["conv_id"].dataType).alias("rejected_id"), F.col("turns").alias("chosen"), F.lit(None).cast(whole.schema["turns"].dataType).alias("rejected"))
    grouped = whole.filter(F.col("n") > 1)
    heads = grouped.filter(F.col("conv_id") == F.col("chosen_id")).select("chosen_id", F.col("turns").alias("chosen"), "n")
    others = grouped.filter(F.col("conv_id") != F.col("chosen_id")).select("chosen_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    paired = join_spread(others, heads, "chosen_id", "n").select("chosen_id", "rejected_id", "chosen", "rejected")
    return render(alone.unionByName(paired))


ORACLE = r"""
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
o AS (SELECT conv_id, t, min(conv_id) OVER (PARTITION BY t[1].role, t[1].text) AS head, count(*) OVER (PARTITION BY t[1].role, t[1].text) AS n FROM c),
p AS (SELECT a.conv_id AS chosen_id, NULL::BIGINT AS rejected_id, a.t AS ct, NULL AS rt FROM o a WHERE n = 1
      UNION ALL SELECT h.conv_id, b.conv_id, h.t, b.t FROM o b JOIN o h ON h.conv_id = b.head WHERE b.n > 1 AND b.conv_id <> b.head),
q AS (SELECT *, CASE WHEN rt IS NULL
          THEN coalesce(list_max(list_filter(range(1, len(ct) + 1), lambda i: ct[i].role = 'assistant')) - 1, len(ct))
          ELSE coalesce(list_min(list_filter(range(1, least(len(ct), len(rt)) + 1),
               lambda i: ct[i].role IS DISTINCT FROM rt[i].role OR ct[i].text IS DISTINCT FROM rt[i].text)) - 1, least(len(ct), len(rt))) END AS n_common FROM p),
r AS (SELECT chosen_id, rejected_id, n_common,
        list_transform(ct, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS cs,
        list_transform(ct, lambda x: CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END) AS cm,
        list_transform(rt, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)) AS rs,
        list_transform(rt, lambda x: CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END) AS rm FROM q)
SELECT chosen_id, rejected_id, n_common::BIGINT AS n_common,
  coalesce(array_to_string(cs[1:n_common], ''), '') AS prompt,
  coalesce(array_to_string(cs[n_common + 1:], ''), '') AS chosen,
  coalesce(array_to_string(list_transform(range(n_common + 1, len(cs) + 1), lambda i: length(cs[i])::VARCHAR || ':' || cm[i]), ','), '') AS chosen_mask,
  CASE WHEN rs IS NOT NULL THEN coalesce(array_to_string(rs[n_common + 1:], ''), '') END AS rejected,
  CASE WHEN rs IS NOT NULL THEN coalesce(array_to_string(list_transform(range(n_common + 1, len(rs) + 1), lambda i: length(rs[i])::VARCHAR || ':' || rm[i]), ','), '') END AS rejected_mask
FROM r
"""
