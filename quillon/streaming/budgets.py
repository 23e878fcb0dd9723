"""Budgets of runs over a stream: the first so many events of each kind are allowed, counted in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Counters(StatefulProcessor):
    """One counter for each kind of a run."""

    def __init__(self, limits: dict[str, int]) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        allowed = []
        for kind in events["kind"]:
            n = self.seen.getValue((kind,))[0] if self.seen.containsKey((kind,)) else 0
            allowed.append(n < self.limits.get(kind, 0))
            # Beyond the limit nothing changes any more.
            if allowed[-1]:
                self.seen.updateValue((kind,), (n + 1,))
        yield pd.DataFrame({"run": [key[0]] * len(events), "kind": events["kind"], "at": events["at"], "allowed": allowed})

    def close(self) -> None:
        pass


def within_budget(events: DataFrame, run: str, kind: str, order: str, limits: dict[str, int]) -> DataFrame:
    """run, kind, at (the order column), allowed: as `sessions.within_budget` gives for a batch, if events of a run come in order.

    Kinds without a limit are never allowed; a null kind is one of them. The session needs the RocksDB state store; a run's
    state is one number a kind and stays.
    """
    rows = events.select(F.col(run).cast("long").alias("run"), F.coalesce(F.col(kind), F.lit("")).alias("kind"), F.col(order).cast("long").alias("at"))
    return rows.groupBy("run").transformWithStateInPandas(Counters(limits), outputStructType="run long, kind string, at long, allowed boolean", outputMode="Append", timeMode="None")
