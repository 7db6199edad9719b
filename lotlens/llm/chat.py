"""Preference pairs as text: the longest common prefix of turns once as prompt, and two completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role: string, text: string>"


def conversations(turns: DataFrame, key: str | Column = "conv_id") -> DataFrame:
    """(conv_id, turns): each conversation's turns as an array of (role, text), in order of turn.

    Rows without conversation or turn number are left out. Equal numbers are ordered by role, then text, and exact
    repeats of a row count once. Null roles and texts become empty. One conversation is one row.
    """
    key = F.col(key) if isinstance(key, str) else key
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(key.alias("conv_id"), turn.alias("t")).where("conv_id is not null and t.turn is not null")
    ordered = F.array_distinct(F.array_sort(F.collect_set("t")))  # a set: repeats go before the exchange
    return rows.groupBy("conv_id").agg(ordered.alias("ordered")).select("conv_id", F.transform("ordered", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    """One turn as text: a head line with the role, the text, an end mark."""
    return F.concat(head(turn), turn.text, F.lit("<|end|>\n"))


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn.role, F.lit("|>\n"))


def _completion(turns: Column, learned: str) -> Column:
    """Text of the turns, and the spans (character positions, end exclusive) that a loss covers."""
    start = F.struct(F.lit("").alias("text"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def add(done: Column, turn: Column) -> Column:
        at = F.length(done.text) + F.length(head(turn))
        span = F.array(F.struct(at.alias("start"), (at + F.length(turn.text) + F.length(F.lit("<|end|>"))).alias("end")))
        return F.struct(F.concat(done.text, rendered(turn)).alias("text"), F.when(turn.role == learned, F.concat(done.spans, span)).otherwise(done.spans).alias("spans"))
    return F.aggregate(turns, start, add)


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", learned: str = "assistant") -> DataFrame:
    """The other columns of pairs, and prompt_turns, prompt, chosen_text, chosen_spans, rejected_text, rejected_spans, tie.

    `chosen` and `rejected` are arrays of (role, text). The prompt is the rendering of the longest prefix of turns, equal
    in role and text, that both begin with; the completions render what follows it. A span covers the text and end mark
    of a turn of role `learned`; all else is masked. If both are equal, or one has nothing after the prefix, its
    completion is empty; `tie` marks equal ones. Null arrays count as empty, null roles and texts too.
    """
    clean = {c: F.transform(F.coalesce(F.col(c), F.expr(f"cast(array() as array<{TURN}>)")),
                            lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.text, F.lit("")).alias("text"))) for c in (chosen, rejected)}
    kept = [c for c in pairs.columns if c not in (chosen, rejected)]
    both = pairs.select(*kept, F.struct(clean[chosen].alias("c"), clean[rejected].alias("r")).alias("_pair"))
    c, r = F.col("_pair.c"), F.col("_pair.r")
    shorter = F.least(F.size(c), F.size(r))
    differs = F.filter(F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.get(c, i) != F.get(r, i))
    at = F.coalesce(F.get(differs, F.lit(0)), shorter)
    parts = both.withColumn("_at", at).withColumn("_done", F.struct(
        F.aggregate(F.slice(c, F.lit(1), F.col("_at")), F.lit(""), lambda a, t: F.concat(a, rendered(t))).alias("prompt"),
        _completion(F.slice(c, F.col("_at") + 1, F.size(c)), learned).alias("c"), _completion(F.slice(r, F.col("_at") + 1, F.size(r)), learned).alias("r")))
    return parts.select(*kept, F.col("_at").alias("prompt_turns"), F.col("_done.prompt").alias("prompt"), F.col("_done.c.text").alias("chosen_text"),
                        F.col("_done.c.spans").alias("chosen_spans"), F.col("_done.r.text").alias("rejected_text"), F.col("_done.r.spans").alias("rejected_spans"),
                        (c == r).alias("tie"))


def mismatched_replies(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, chosen, rejected): each conversation up to its last reply, against the same with its neighbour's last reply.

    Neighbours are the two conversations of ids 2n and 2n + 1, so the pairing needs one shuffle by id and no group grows
    with the data. Conversations without a reply have no row; without a neighbour's reply, rejected ends before the reply.
    """
    last = F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), F.lit(-1), lambda a, i: F.when(F.get("turns", i).role == learned, i).otherwise(a))
    one = conversations(turns).withColumn("last", last)
    both = one.groupBy(F.floor(F.col("conv_id") / 2).alias("_pair")).agg(F.collect_list(F.struct("conv_id", "turns", "last")).alias("_both"))
    own, other = F.col("_own"), F.get(F.filter("_both", lambda x: x.conv_id != F.col("_own.conv_id")), F.lit(0))
    reply = F.when(other.last >= 0, F.array(F.get(other.turns, other.last))).otherwise(F.expr(f"cast(array() as array<{TURN}>)"))
    return (both.select("_both", F.explode("_both").alias("_own")).where("_own.last >= 0")
            .select(own.conv_id.alias("conv_id"), F.slice(own.turns, F.lit(1), own.last + 1).alias("chosen"),
                    F.concat(F.slice(own.turns, F.lit(1), own.last), reply).alias("rejected")))
