"""Working memory of conversations: what earlier turns have settled, folded over a batch with windows or over a stream with state.

Both ways take turns in order and follow the same rules. A turn's metrics replace the remembered ones, unless it only asks for general
knowledge, advice or help, or is refused; one that names none goes by those that are remembered. A period or a comparison stays until another is
named; a question that needs clarification is pending, with what it lacks, until the next turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.catalog import Catalog
from quillon.operators.metrics import METRICS
from quillon.plans.routing import needs_baseline, needs_period, route

#: Reasons that settle nothing about metrics, and those that leave no question pending.
GENERAL = ("general_business", "general_definition", "help", "unauthorized", "unsupported", "empty")
CLOSED = ("answerable", "followup_new_scope", "definition", "help", "followup", "general_definition", "general_business", "unauthorized", "unsupported", "empty")
LONGEST, MOST = 4000, 16
_MEMORY = "metric_ids array<string>, time_range struct<start string, end string>, comparison string, pending_question string, pending_missing string"


def features(questions: DataFrame, catalog: Catalog, question: str = "question") -> DataFrame:
    """What the fold needs of each turn, found without its past: own metrics, range and comparison, metrics that its dimensions exclude, and reasons.

    `reasons` has one for each thing that the past may know: 1 for a period, 2 for a comparison, 4 for metrics, in sum.
    """
    known = F.lit("known")
    said = F.trim(F.coalesce(question, F.lit("")))
    spans = F.struct(F.col("range.start").cast("string").alias("start"), F.col("range.end").cast("string").alias("end"))
    excluded = [F.when(F.size(F.array_except("dimensions", F.array(*[F.lit(d) for d in (*m.dimensions, *m.through_items)]))) > 0, F.lit(i)) for i, m in METRICS.items()]
    own = {
        "own_metrics": F.slice(F.array_distinct("metric_ids"), 1, MOST), "own_range": F.when(F.col("range").isNotNull(), spans), "own_comparison": F.col("baseline"), "excluded": F.array_compact(F.array(*excluded)),
        "__period": needs_period(said, F.col("range")), "__baseline": needs_baseline(said),
    }
    routed = ["metric_ids", "dimensions", "grain", "baseline", "range", "reason", "state", "intent", "plan_type", "warnings"]
    alone = route(questions, catalog, question, period=known, comparison=known).withColumns({**own, "__alone": F.col("reason")}).drop(*routed)
    # A name that no metric has stands for metrics that fit every dimension.
    both = route(alone, catalog, question, period=known, comparison=known, remembered=F.array(F.lit(""))).withColumn("__with", F.col("reason")).drop(*routed)

    def reason(n: int) -> Column:
        base = F.col("__with" if n & 4 else "__alone")
        lacks = lambda bit, c: F.lit(not n & bit) & (base == "answerable") & F.col(c)
        return F.when(lacks(1, "__period"), "missing_time").when(lacks(2, "__baseline"), "missing_comparison").otherwise(base)

    return both.withColumn("reasons", F.array(*[reason(n) for n in range(8)])).drop("__period", "__baseline", "__alone", "__with")


#: Reasons that stand behind the check of dimensions.
_AFTER_DIMENSIONS = ("missing_time", "missing_comparison", "answerable")


def replay(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", question: str = "question") -> DataFrame:
    """Memory after every turn of a batch of `features`: metric_ids, time_range, comparison, pending_question, pending_missing, and the turn's reason."""
    so_far = W.partitionBy(conv).orderBy(turn, question).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(conv).orderBy(turn, question).rowsBetween(W.unboundedPreceding, -1)
    newest = lambda c, over: F.last(c, ignorenulls=True).over(over)
    # What the past knows does not change whether a turn's own metrics count.
    named = F.when(~F.get("reasons", F.lit(0)).isin(*GENERAL) & (F.size("own_metrics") > 0), F.col("own_metrics"))
    known = turns.withColumns({"__period": newest("own_range", before).isNotNull().cast("int"), "__comparison": newest("own_comparison", before).isNotNull().cast("int"), "__metrics": F.coalesce(newest(named, before), F.array().cast("array<string>"))})
    reason = F.get("reasons", F.col("__period") + 2 * F.col("__comparison") + 4 * (F.size("__metrics") > 0).cast("int"))
    clash = (F.size("own_metrics") == 0) & F.arrays_overlap("__metrics", "excluded") & reason.isin(*_AFTER_DIMENSIONS)
    folded = known.withColumns({
        "reason": F.when(clash, "dimension_policy").otherwise(reason),
        "metric_ids": F.coalesce(newest(named, so_far), F.array().cast("array<string>")),
        "time_range": newest("own_range", so_far),
        "comparison": newest("own_comparison", so_far),
    })
    open_ = ~F.col("reason").isin(*CLOSED)
    pending = {"pending_question": F.when(open_, F.left(F.trim(F.coalesce(question, F.lit(""))), F.lit(LONGEST))), "pending_missing": F.when(open_, F.col("reason"))}
    return folded.withColumns(pending).drop("__period", "__comparison", "__metrics")


class Fold(StatefulProcessor):
    """The same fold over a stream: one memory a conversation, forgotten after `idle` without a turn."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "metrics string, start string, end string, comparison string, last_turn long")
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        named, start, end, comparison, last = self.memory.get() if self.memory.exists() else (None, None, None, None, None)
        metrics, period = named.split(",") if named else [], (start, end) if start else None
        turns = pd.concat(list(rows))
        out, newest = [], int(turns["at_ms"].max())
        # Turns of one micro-batch are taken in order; one that comes after a later turn was taken is told apart by `late`.
        for r in turns.sort_values(["turn", "question"], kind="stable").itertuples(index=False):
            late = last is not None and r.turn < last
            reason = r.reasons[(period is not None) + 2 * (comparison is not None) + 4 * (len(metrics) > 0)]
            if not len(r.own_metrics) and reason in _AFTER_DIMENSIONS and set(metrics) & set(r.excluded):
                reason = "dimension_policy"
            if r.reasons[0] not in GENERAL and len(r.own_metrics):
                metrics = list(r.own_metrics)
            if r.own_range is not None:
                period = (r.own_range["start"], r.own_range["end"]) if isinstance(r.own_range, dict) else tuple(r.own_range)
            comparison = r.own_comparison if r.own_comparison is not None else comparison
            pending = reason not in CLOSED
            last = r.turn if last is None else max(last, r.turn)
            asked = (r.question.strip()[:LONGEST], reason) if pending else (None, None)
            out.append((key[0], r.turn, reason, metrics, None if period is None else {"start": period[0], "end": period[1]}, comparison, *asked, bool(late)))
        self.memory.update((",".join(metrics), *(period or (None, None)), comparison, last))
        if self.alarm.exists():
            newest = max(newest, self.alarm.get()[0] - self.idle_ms)
            self.handle.deleteTimer(self.alarm.get()[0])
        self.handle.registerTimer(newest + self.idle_ms)
        self.alarm.update((newest + self.idle_ms,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "reason", "metric_ids", "time_range", "comparison", "pending_question", "pending_missing", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memory.clear()
        self.alarm.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def follow(turns: DataFrame, idle: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """Memory after every turn of a stream of `features` (conv_id long, turn long, question, at timestamp): the columns of `replay`, and `late`.

    A memory is forgotten once the watermark is `idle` seconds past its last turn. The session needs the RocksDB state store. Conversations
    are dealt by id; turns of null id are one conversation.
    """
    slim = turns.select("conv_id", "turn", "at", F.unix_millis("at").alias("at_ms"), F.coalesce("question", F.lit("")).alias("question"), "reasons", "own_metrics", "own_range", "own_comparison", "excluded")
    return slim.withWatermark("at", late).groupBy("conv_id").transformWithStateInPandas(
        Fold(int(idle * 1000)), outputStructType=f"conv_id long, turn long, reason string, {_MEMORY}, late boolean", outputMode="Append", timeMode="EventTime"
    )
