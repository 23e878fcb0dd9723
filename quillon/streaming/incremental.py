"""Metrics that follow a stream: every micro-batch leaves one table of partial sums under its own number.

A batch that is replayed writes its folder again, or is passed over if it was compacted, so totals count every batch once. Totals are
sums over partials; `compact` folds finished batches into one table by a snapshot commit that also names the last batch it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.snapshots import Snapshots


@dataclass(frozen=True)
class Incremental:
    """rows, total, first and last time of a stream of events by `keys`."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("event_type",)
    value: str = "value"
    time: str = "ts"

    @property
    def _base(self) -> Snapshots:
        return Snapshots(self.spark, f"{self.path}/base")

    def _folded(self) -> int:
        """The last batch that the base holds."""
        return self._base.manifest().get("through", -1)

    def partial(self, rows: DataFrame) -> DataFrame:
        amount = F.col(self.value).cast("decimal(28,6)")
        return rows.groupBy(*self.keys).agg(F.count("*").alias("rows"), F.sum(amount).alias("total"), F.min(self.time).alias("first"), F.max(self.time).alias("last"))

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in one micro-batch; taking it in again changes nothing."""
        if number > self._folded():
            self.partial(batch).write.mode("overwrite").parquet(f"{self.path}/partials/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in all available input."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _partials(self) -> DataFrame | None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/partials")
        if not folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
            return None
        return self.spark.read.parquet(f"{self.path}/partials").filter(F.col("batch") > self._folded())

    def _all(self) -> DataFrame | None:
        parts = [p for p in (self._base.read("sums") if "sums" in self._base.tables() else None, self._partials()) if p is not None]
        columns = [*self.keys, "rows", "total", "first", "last"]
        parts = [p.select(*columns) for p in parts]
        return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else None

    def totals(self) -> DataFrame | None:
        """keys, rows, total, first, last over all batches; None before the first."""
        found = self._all()
        return None if found is None else found.groupBy(*self.keys).agg(F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,6)").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"))

    def compact(self) -> int:
        """Fold all batches so far into the base; returns the last of them. Partials that the base holds are not read any more."""
        parts = self._partials()
        last = parts.agg(F.max("batch")).first()[0] if parts is not None else None
        if last is not None:
            self._base.commit({"sums": self.totals()}, note={"through": int(last)})
        return self._folded()
