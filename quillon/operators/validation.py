"""Validation of a result against its contract, in one aggregate over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.quality import multiplicity


@dataclass(frozen=True)
class Contract:
    required: tuple[str, ...]
    metrics: tuple[str, ...] = ()
    time: str | None = None
    start: str | None = None
    end: str | None = None
    max_rows: int = 1000
    limit_applied: bool = False
    grain: tuple[str, ...] = ()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Verdict:
    state: str  # valid, needs_clarification or refuse
    reason: str
    rows: int = 0
    truncated: bool = False
    first: str | None = None
    last: str | None = None


def _key(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _actual(df: DataFrame, name: str, contract: Contract) -> str | None:
    wanted = {_key(n) for n in (name, *contract.aliases.get(name, ()))}
    return next((c for c in df.columns if _key(c) in wanted), None)


def validate(df: DataFrame, contract: Contract) -> Verdict:
    """Checks in order: missing column, multiplied rows, empty, metric all null, metric not finite, truncated, time missing, time out
    of range. The end day is included. A result as long as max_rows, or one that a limit was put on, counts as truncated."""
    names = {n: _actual(df, n, contract) for n in (*contract.required, *contract.metrics, *([contract.time] if contract.time else []))}
    missing = [n for n in (*contract.required, *contract.metrics) if names[n] is None]
    if missing:
        return Verdict("refuse", f"missing_column:{missing[0]}")
    if contract.grain and multiplicity(df, [names.get(g) or g for g in contract.grain]) > 1:
        return Verdict("refuse", "join_multiplied_rows")
    metrics = [names[m] for m in contract.metrics]
    aggs = [F.count("*").alias("n")]
    for i, m in enumerate(metrics):
        x = F.col(m).cast("double")
        aggs += [F.count(m).alias(f"c{i}"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias(f"f{i}")]
    time = names.get(contract.time) if contract.time else None
    if time:
        ts = F.col(time).try_cast("timestamp") if not isinstance(df.schema[time].dataType, T.NumericType) else F.lit(None).cast("timestamp")
        aggs += [F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count_if(F.col(time).isNotNull() & ts.isNull()).alias("unread")]
    r = df.agg(*aggs).first()
    if not r["n"]:
        return Verdict("needs_clarification", "empty")
    for i, m in enumerate(contract.metrics):
        if not r[f"c{i}"]:
            return Verdict("refuse", f"all_null:{m}", r["n"])
    for i, m in enumerate(contract.metrics):
        if r[f"f{i}"]:
            return Verdict("refuse", f"not_finite:{m}", r["n"])
    if r["n"] >= contract.max_rows or contract.limit_applied:
        return Verdict("needs_clarification", "truncated", r["n"], True)
    if not contract.time:
        return Verdict("valid", "ok", r["n"])
    if not time or r["unread"] or r["lo"] is None:
        return Verdict("needs_clarification", "time_unreadable", r["n"])
    lo, hi = str(r["lo"]), str(r["hi"])
    if (contract.start and lo < contract.start) or (contract.end and hi[:10] > contract.end):
        return Verdict("refuse", "time_out_of_range", r["n"], first=lo, last=hi)
    return Verdict("valid", "ok", r["n"], first=lo, last=hi)


def summary_rows(df: DataFrame, columns: tuple[str, ...] = (), rows: int = 8) -> DataFrame:
    """Contract columns (else the first eight) of a few rows, as one JSON value each."""
    chosen = [c for c in columns if c in df.columns] or df.columns[:8]
    return df.select(*chosen).limit(rows).select(F.to_json(F.struct(*chosen)).alias("row"))
