"""Chat histories compiled to a context budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import tokens
from quarrylight.functions.text import strip


def is_empty(content: Column) -> Column:
    return content.isNull() | (strip(content) == "")


def render(parts: Column) -> Column:
    """The text of message parts: array<struct<type, text>>."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")


def tail(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, ...) without system ones, with in_tail: the run that must stay at the end.

    A run of tool messages and the message before it; or a run of assistant and thinking messages; or the last message.
    """
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    last = F.first("role").over(upto)
    family = lambda c: F.when(c == "tool", "tool").when(c.isin("assistant", "thinking"), "answer").otherwise("single")
    rows = messages.filter("role <> 'system'").withColumn("_last", family(last)).withColumn("_kind", family(F.col("role"))).withColumn("_i", F.row_number().over(back))
    rows = rows.withColumn("_broken", F.sum((F.col("_kind") != F.col("_last")).cast("int")).over(upto))
    own = (F.col("_broken") == 0) & ((F.col("_last") != "single") | (F.col("_i") == 1))
    caller = (F.col("_last") == "tool") & (F.col("_broken") == 1) & (F.lag("_broken").over(back) == 0)
    return rows.withColumn("in_tail", own | F.coalesce(caller, F.lit(False))).drop("_last", "_kind", "_i", "_broken")


def dangling_tools(messages: DataFrame) -> DataFrame:
    """(conv_id, turn) of tool messages in the tail whose id no call of the tail's first message bears.

    messages has tool_call_id and call_ids (array of the ids a message calls).
    """
    kept = tail(messages).filter("in_tail")
    calls = kept.filter("role <> 'tool'").groupBy("conv_id").agg(F.flatten(F.collect_list("call_ids")).alias("_calls"))
    return kept.filter("role = 'tool'").join(calls, "conv_id", "left").filter(~F.coalesce(F.array_contains("_calls", F.col("tool_call_id")), F.lit(False))).select("conv_id", "turn")


def compile_history(messages: DataFrame, context: int | None, max_tokens: int, tool_tokens: int = 0, counter: tokens.Counter = tokens.count, strict: bool = True) -> DataFrame:
    """Kept messages: conv_id, turn, role, did_prune, context_percentage; the budget must hold system, tail and tools.

    messages: conv_id, turn, role, content. The first system message stays, other system and all empty messages go. The
    oldest messages go until the rest fits, and tool messages that then lead go with them. If system, tail and tools
    alone are over a given context the query fails, or, if not strict, keeps just these.
    """
    length = context if context is not None else tokens.DEFAULT_LENGTH
    available = length - int(min(tokens.BUFFER_MOST, length * tokens.BUFFER_SHARE)) - min(tokens.LEAST_RESPONSE, max_tokens)
    cost = tokens.message(F.col("role"), F.col("content"), counter=counter)
    system = messages.filter("role = 'system'").groupBy("conv_id").agg(F.min_by(F.struct("turn", "content"), "turn").alias("_s"))
    system = system.select("conv_id", F.col("_s.turn").alias("_system_turn"), tokens.message(F.lit("system"), F.col("_s.content"), counter=counter).alias("_system"))
    rows = tail(messages.filter((F.col("role") == "system") | ~is_empty(F.col("content")))).withColumn("tokens", cost)
    whole = Window.partitionBy("conv_id")
    rows = rows.join(system, "conv_id", "left").fillna(0, ["_system"])
    rows = rows.withColumn("_tail", F.sum(F.when(F.col("in_tail"), F.col("tokens")).otherwise(0)).over(whole))
    rows = rows.withColumn("_room", available - tool_tokens - F.col("_system") - F.col("_tail"))
    if context is not None and strict:
        rows = rows.withColumn("_room", F.when(F.col("_room") < 0, F.raise_error(F.lit("Not enough context available to include the system message, last user message, and tools.")).cast("long")).otherwise(F.col("_room")))
    newest = whole.orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_left", F.sum(F.when(F.col("in_tail"), 0).otherwise(F.col("tokens"))).over(newest))
    fits = F.col("in_tail") | (F.col("_left") <= F.col("_room"))
    # tool messages that lead what is left of a pruned history answer calls that are gone
    pruned = F.max((~fits).cast("int")).over(whole) == 1
    rows = rows.withColumn("_fits", fits).withColumn("did_prune", pruned)
    oldest = whole.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.sum((F.col("_fits") & ~F.col("in_tail") & (F.col("role") != "tool")).cast("int")).over(oldest) == 0
    rows = rows.withColumn("_kept", F.col("_fits") & (F.col("in_tail") | ~(F.col("did_prune") & (F.col("role") == "tool") & lead)))
    used = F.sum(F.when(F.col("_kept"), F.col("tokens")).otherwise(0)).over(whole) + F.col("_system") + tool_tokens
    rows = rows.withColumn("context_percentage", used / F.lit(float(available)))
    kept = rows.filter("_kept").select("conv_id", "turn", "role", "did_prune", "context_percentage")
    head = rows.filter("_system_turn IS NOT NULL").select("conv_id", F.col("_system_turn").alias("turn"), F.lit("system").alias("role"), "did_prune", "context_percentage").distinct()
    return kept.union(head)
