"""Runs and their audits as two streams: every run with the audits that follow it within a time, or with none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_audits(runs: DataFrame, audits: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """run_id, user_id, run_at, audit_id, audit_at, audit_value: a left outer join by user and time.

    runs: run_id, user_id, run_at. audits: audit_id, user_id, audit_at, audit_value. An audit belongs to every run of its user up to
    `within` before it. Both sides have a watermark, so state is kept for `within` and `late` only, and a run without audits appears
    once no audit of its time can come any more. Runs of null users have no audits. On a batch the same plan is the plain join.
    """
    r = runs.select("run_id", "user_id", "run_at").withWatermark("run_at", late)
    a = audits.select("audit_id", F.col("user_id").alias("audit_user"), "audit_at", "audit_value").withWatermark("audit_at", late)
    near = (F.col("user_id") == F.col("audit_user")) & (F.col("audit_at") >= F.col("run_at")) & (F.col("audit_at") <= F.col("run_at") + F.expr(f"INTERVAL {within}"))
    return r.join(a, near, "left_outer").drop("audit_user")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, over all batches that the query still reports."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
