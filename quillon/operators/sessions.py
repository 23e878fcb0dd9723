"""Conversations, runs, budgets and audits as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trim_context(messages: DataFrame, max_chars: int, max_messages: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", overhead: int = 16) -> DataFrame:
    """The newest whole exchanges of each conversation within a budget of characters (plus overhead a message) and messages.

    An exchange begins with a user message; what stands before the first one is an exchange too. The newest one always stays. From
    there on, an exchange that does not fit is skipped and older ones are still tried. If the newest alone has too many messages, its
    latest user and assistant messages stay (only the user's where one is allowed); if too many characters, texts are cut where the budget ends.
    """
    order = [turn, role, text]
    mine = W.partitionBy(conv)
    up_to = mine.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sized = messages.withColumn("exchange", F.count_if(F.col(role) == "user").over(up_to)).withColumn("cost", F.char_length(F.coalesce(text, F.lit(""))) + overhead)
    totals = sized.groupBy(conv, "exchange").agg(F.sum("cost").alias("cost"), F.count("*").alias("messages"))
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct("exchange", "cost", "messages"))))

    def add(acc, x):
        fits = (F.size(acc["kept"]) == 0) | ((acc["chars"] + x["cost"] <= max_chars) & (acc["messages"] + x["messages"] <= max_messages))
        more = F.struct((acc["chars"] + x["cost"]).alias("chars"), (acc["messages"] + x["messages"]).alias("messages"), F.concat(acc["kept"], F.array(x["exchange"])).alias("kept"))
        return F.when(fits, more).otherwise(acc)

    none = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("messages"), F.array().cast("array<bigint>").alias("kept"))
    kept = totals.groupBy(conv).agg(F.aggregate(newest_first, none, add)["kept"].alias("kept"))
    rows = sized.join(kept.withColumnRenamed(conv, "__conv"), F.col(conv).eqNullSafe(F.col("__conv"))).filter(F.array_contains("kept", F.col("exchange")))
    rows = rows.withColumns({"place": F.row_number().over(mine.orderBy(*order)), "many": F.count("*").over(mine)})
    last = lambda who, otherwise: F.coalesce(F.max(F.when(F.col(role) == who, F.col("place"))).over(mine), otherwise)
    rows = rows.withColumns({"asked": last("user", F.lit(1)), "answered": last("assistant", F.col("many").cast("int"))})
    chosen = (F.col("place") == F.col("asked")) | ((F.col("place") == F.col("answered")) & F.lit(max_messages > 1))
    rows = rows.filter((F.col("many") <= max_messages) | chosen)
    # The question stands first where only two are left.
    rows = rows.withColumn("place", F.when((F.col("many") > max_messages) & (F.col("place") == F.col("asked")), 0).otherwise(F.col("place")))
    before = F.sum("cost").over(mine.orderBy("place").rowsBetween(W.unboundedPreceding, 0)) - F.col("cost")
    room = F.greatest(max_chars - before - overhead, F.lit(0)).cast("int")
    rows = rows.withColumns({"room": room, "all": F.sum("cost").over(mine)}).withColumn(text, F.when((F.col("all") > max_chars) & F.col(text).isNotNull(), F.substr(text, F.lit(1), F.col("room"))).otherwise(F.col(text)))
    return rows.select(*messages.columns)


def newest(df: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(F.desc(order)).offset(offset).limit(limit)


def visible_audits(audits: DataFrame, user_id: int, role: str, user: str = "user_id") -> DataFrame:
    """An admin sees all rows, anyone else their own."""
    return audits if role == "admin" else audits.filter(F.col(user) == user_id)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and the new ones whose keys are not there yet; of new rows with equal keys one stays."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys))


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key: a run's state is folded from its start and finish events."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def within_budget(events: DataFrame, run: str, kind: str, order: str, limits: dict[str, int]) -> DataFrame:
    """Adds `allowed`: whether the event is among the first so many of its kind in its run."""
    limit = F.coalesce(*[F.when(F.col(kind) == k, F.lit(n)) for k, n in limits.items()], F.lit(0))
    return events.withColumn("allowed", F.row_number().over(W.partitionBy(run, kind).orderBy(order)) <= limit)


def phase_timing(samples: DataFrame, phase: str, millis: str, order: str) -> DataFrame:
    """phase, count, total, last, longest."""
    return samples.groupBy(phase).agg(F.count("*").alias("count"), F.round(F.sum(millis), 2).alias("total"), F.max_by(millis, order).alias("last"), F.max(millis).alias("longest"))


def keep_newest(memories: DataFrame, order: str, max_items: int) -> DataFrame:
    """First in, first out: the newest max_items rows."""
    return memories.orderBy(F.desc(order)).limit(max_items)


def pack_context(snippets: DataFrame, group: str, order: str, tokens: str, budget: float, used: float = 0.0) -> DataFrame:
    """Snippets of each group, in order, each taken if the total with it stays under the budget; one that does not fit is skipped.

    `used` tokens are spent before. Adds running: the total up to the snippet.
    """
    rest = [c for c in snippets.columns if c != group]
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), F.struct(*rest).alias("row"))))

    def add(acc, x):
        total = acc["total"] + x["row"][tokens]
        return F.when(total < budget, F.struct(total.alias("total"), F.concat(acc["kept"], F.array(F.struct(x["row"].alias("row"), total.alias("running")))).alias("kept"))).otherwise(acc)

    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in snippets.select(*rest).schema)
    none = F.struct(F.lit(float(used)).alias("total"), F.array().cast(f"array<struct<row: struct<{kind}>, running: double>>").alias("kept"))
    kept = snippets.groupBy(group).agg(F.aggregate(listed, none, add)["kept"].alias("kept"))
    return kept.select(group, F.explode("kept").alias("k")).select(group, "k.row.*", "k.running").select(*snippets.columns, "running")


def clear_memories(memories: DataFrame, tool: str | None = None, before: str | None = None, text: bool = False) -> DataFrame:
    """What is left after forgetting memories of a tool, before a time, or both; with neither all are forgotten.

    A memory without a time counts as old. Text memories (`text`) have no tool: they stay whenever one is named.
    """
    gone = F.lit(True)
    if tool is not None:
        gone = F.lit(False) if text else F.col("tool_name").eqNullSafe(F.lit(tool))
    if before is not None:
        gone = gone & (F.col("created_at").isNull() | (F.col("created_at") < F.lit(before).cast("timestamp")))
    return memories.filter(~gone)


def memory_stats(memories: DataFrame, tool: str, question: str, success: str) -> DataFrame:
    """total, tools, questions, success_rate, most_used (ties to the smaller name) in one row."""
    used = memories.groupBy(tool).agg(F.count("*").alias("n")).agg(F.min_by(tool, F.struct(-F.col("n"), F.col(tool))).alias("most_used"))
    return memories.agg(F.count("*").alias("total"), F.countDistinct(tool).alias("tools"), F.countDistinct(question).alias("questions"), F.round(F.avg(F.col(success).cast("int")), 6).alias("success_rate")).crossJoin(used)  # one row each
