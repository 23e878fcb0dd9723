"""Governed metrics compiled to DataFrame plans.

A metric is a sum, or a quotient of two sums, over the rows of its fact that its filter lets through. A request for metrics,
dimensions, a time grain and a range becomes one plan: metrics of one fact share one scan and one aggregate. Items are summed by
order before they meet orders, and rows by foreign key before they meet dimension tables (eager aggregation), so no join can
multiply rows of another fact and every join sees sums only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.tables import Star

GRAINS = ("day", "week", "month", "quarter", "year")
EXCLUDED_STATUS = ("P",)


class NeedsClarification(ValueError):
    """The request has more than one meaning, or none that keeps the metric's grain."""


@dataclass(frozen=True)
class Metric:
    metric_id: str
    fact: str
    time: str
    label: str
    #: Dimensions that the fact reaches without multiplying its rows.
    dimensions: tuple[str, ...]
    #: What is summed over the fact's rows, and by what the sum is divided.
    numerator: Callable[[], Column]
    denominator: Callable[[], Column] | None = None
    filter: Callable[[], Column] | None = None
    #: Dimensions reached through items, where an order counts once for each of their values.
    through_items: tuple[str, ...] = ()
    #: The value is an amount of items, of which an order with none has no share.
    needs_items: bool = False
    #: By how many units of the sum one unit of the metric is.
    unit: float = 1.0
    draft: bool = False

    @property
    def effective_only(self) -> bool:
        return self.filter is _effective


def _effective() -> Column:
    return ~F.col("order_status").isin(*EXCLUDED_STATUS)


def _delivered() -> Column:
    return F.col("delivered_at") >= F.col("ordered_at")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")).cast("decimal(20,0)")


_ORDER_DIMS = ("customer_state", "customer_region", "segment", "order_status")
_ITEM_DIMS = ("category", "brand", "seller_state")
_DAY = 86_400_000_000.0
#: The numbers of an `orders` row: itself, and its items' price and number (and delivered_at, their last shipment).
METRICS = {
    m.metric_id: m
    for m in (
        Metric("gmv", "orders", "ordered_at", "Gross merchandise value", (*_ORDER_DIMS, *_ITEM_DIMS), lambda: F.col("price"), filter=_effective, needs_items=True),
        Metric("paid_order_count", "orders", "ordered_at", "Effective orders", _ORDER_DIMS, lambda: F.lit(1), filter=_effective, through_items=_ITEM_DIMS),
        Metric("average_delivery_days", "orders", "ordered_at", "Average days to delivery", _ORDER_DIMS, lambda: _micros("delivered_at") - _micros("ordered_at"), lambda: F.lit(1), _delivered, unit=_DAY),
        Metric("positive_review_rate", "reviews", "", "Share of positive reviews", ("lang", "source"), lambda: (F.col("quality") >= 1).cast("int"), lambda: F.lit(1)),
        Metric("item_count", "orders", "ordered_at", "Order items", (*_ORDER_DIMS, *_ITEM_DIMS), lambda: F.col("items"), needs_items=True, draft=True),
        Metric("average_order_value", "orders", "ordered_at", "Value per order", _ORDER_DIMS, lambda: F.col("price"), lambda: F.lit(1), _effective, needs_items=True, draft=True),
        Metric("on_time_delivery_rate", "orders", "ordered_at", "Share delivered in 60 days", _ORDER_DIMS, lambda: (F.col("delivered_at") <= F.col("ordered_at") + F.expr("INTERVAL 60 DAYS")).cast("int"), lambda: F.lit(1), _delivered, draft=True),
        Metric("average_review_score", "reviews", "", "Average review score", ("lang", "source"), lambda: F.col("quality"), lambda: F.lit(1), draft=True),
    )
}
#: Dimension -> the foreign key by which rows are summed before they meet its table.
_KEY_OF = {"customer_state": "customer_id", "customer_region": "customer_id", "segment": "customer_id", "category": "product_id", "brand": "product_id", "seller_state": "seller_id"}
_TABLE_OF = {"customer_id": Star.customers, "product_id": Star.products, "seller_id": Star.sellers}


def _with_dimensions(star: Star, fact: DataFrame, dims: list[str]) -> DataFrame:
    """Left joins to the dimension tables that the requested columns need; each has one row a key."""
    for key in dict.fromkeys(_KEY_OF[d] for d in dims if d in _KEY_OF):
        fact = fact.join(_TABLE_OF[key](star).select(key, *[d for d in dims if _KEY_OF.get(d) == key]), key, "left")
    return fact


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _range(df: DataFrame, time: str, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col(time) < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return df


def _rows(star: Star, wanted: list[Metric], dims: tuple[str, ...], grain: str | None, start: str | None, end: str | None) -> tuple[DataFrame, list[str]]:
    """The fact's rows at the finest grain that the metrics need, with the dimensions that are still missing.

    Without item dimensions a row is an order. With them it is an order and one value of them, if a metric counts orders; otherwise
    rows stay sums by foreign key.
    """
    if wanted[0].fact == "reviews":
        return star.reviews(), []
    item_dims = [d for d in dims if d in _ITEM_DIMS]
    keys = list(dict.fromkeys(_KEY_OF[d] for d in item_dims))
    items = None
    if keys or any(m.needs_items or m.filter is _delivered for m in wanted):
        items = star.lines().groupBy("order_id", *keys).agg(F.sum("price").alias("price"), F.count(F.lit(1)).alias("items"), F.max("shipped_at").alias("delivered_at"))
    orders = _range(star.orders(), "ordered_at", start, end)
    # An order without items counts as an order, but has no amounts and no delivery.
    everyone = any(not m.needs_items and m.filter is not _delivered for m in wanted) and not keys
    rows = orders if items is None else orders.join(items, "order_id", "left" if everyone else "inner")
    order_dims = [d for d in dims if d not in item_dims]
    if any(m.through_items and keys for m in wanted):
        rows = _with_dimensions(star, rows, item_dims)
        own = ["order_id", *item_dims, "ordered_at", "order_status", "customer_id"]
        return rows.groupBy(*own).agg(*_sums(["price", "items"])), order_dims
    return rows, [*item_dims, *order_dims]


def _one_fact(star: Star, wanted: list[Metric], dims: tuple[str, ...], grain: str | None, start: str | None, end: str | None) -> DataFrame:
    """All metrics of one fact by dims and period, from one scan of each table. A metric is null where no row passes its filter."""
    rows, missing = _rows(star, wanted, dims, grain, start, end)
    period = [F.date_trunc(grain, F.col(wanted[0].time)).cast("date").alias("period")] if grain else []
    here = lambda m: (m.filter() if m.filter else F.lit(True)) & (F.col("items").isNotNull() if m.needs_items else F.lit(True))
    parts = {}
    for m in wanted:
        parts[f"__n_{m.metric_id}"] = F.when(here(m), 1).otherwise(0).cast("long")
        parts[f"__num_{m.metric_id}"] = F.when(here(m), m.numerator())
        if m.denominator:
            parts[f"__den_{m.metric_id}"] = F.when(here(m), m.denominator()).cast("long")
    keys = list(dict.fromkeys(_KEY_OF.get(d, d) if d in missing else d for d in dims))
    summed = rows.select(*keys, *period, *[c.alias(n) for n, c in parts.items()]).groupBy(*keys, *(["period"] if grain else [])).agg(*_sums(list(parts)))
    of_tables = [d for d in missing if d in _KEY_OF]
    if of_tables:
        summed = _with_dimensions(star, summed, of_tables).groupBy(*dims, *(["period"] if grain else [])).agg(*_sums(list(parts)))

    def value(m: Metric) -> Column:
        num = F.col(f"__num_{m.metric_id}")
        if m.denominator:
            return F.round(F.try_divide(num.cast("double"), F.col(f"__den_{m.metric_id}").cast("double")) / m.unit, 6)
        # A count over no rows is 0 in all, and nothing in a group.
        return num.cast("double") if m.metric_id == "gmv" else num if dims or grain else F.coalesce(num, F.lit(0)).cast("long")

    out = summed.select(*dims, *(["period"] if grain else []), *[value(m).alias(m.metric_id) for m in wanted], F.greatest(F.lit(0), *[F.col(f"__n_{m.metric_id}") for m in wanted]).alias("__n"))
    return (out.filter("__n > 0") if dims or grain else out).drop("__n")


def _check(m: Metric, dims: tuple[str, ...], grain: str | None) -> None:
    extra = [d for d in dims if d not in m.dimensions and d not in m.through_items]
    if extra:
        raise NeedsClarification(f"{m.metric_id} has no single meaning by {', '.join(extra)}")
    if grain is not None and (grain not in GRAINS or not m.time):
        raise NeedsClarification(f"{m.metric_id} has no periods of {grain}")


def measure(star: Star, metric_id: str, dims: tuple[str, ...] = (), grain: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """One metric by dimensions and period: columns dims, period (if a grain is given), metric_id. The end day is included."""
    return query(star, [metric_id], dims, grain, start, end)


def query(star: Star, metric_ids: list[str], dims: tuple[str, ...] = (), grain: str | None = None, start: str | None = None, end: str | None = None, top: int | None = None) -> DataFrame:
    """Several metrics in one result: one row of totals without keys, else a row for each key that any of them has. `top` orders by the
    first metric, then by the keys, so that ties are cut the same way each time."""
    by_fact: dict[str, list[Metric]] = {}
    for i in metric_ids:
        _check(METRICS[i], dims, grain)
        by_fact.setdefault(METRICS[i].fact, []).append(METRICS[i])
    parts = [_one_fact(star, wanted, dims, grain, start, end) for wanted in by_fact.values()]
    keys = [*dims, *(["period"] if grain else [])]
    if not keys:
        out = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    else:
        out = reduce(lambda a, b: _full_join(a, b, keys), parts)
    if top is not None:
        out = out.orderBy(F.desc_nulls_last(metric_ids[0]), *[F.asc_nulls_last(k) for k in keys]).limit(top)
    return out.select(*keys, *metric_ids)


def _full_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    cond = reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    values = [a[c] for c in a.columns if c not in keys] + [b[c] for c in b.columns if c not in keys]
    return a.join(b, cond, "full").select(*[F.coalesce(a[k], b[k]).alias(k) for k in keys], *values)


_STEP = {"day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH", "quarter": "3 MONTHS", "year": "1 YEAR"}


def on_spine(measured: DataFrame, grain: str, dims: tuple[str, ...] = ()) -> DataFrame:
    """Every period from the first to the last of all rows for every combination of dims, with nulls where nothing was measured.

    The calendar is a sequence; its rows number the combinations times the periods, as a result without holes would.
    """
    ends = measured.agg(F.min("period").alias("first"), F.max("period").alias("last"))  # one row
    groups = measured.select(*dims).distinct().crossJoin(F.broadcast(ends)) if dims else ends
    spine = groups.select(*dims, F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {_STEP[grain]}"))).alias("period"))
    keys = [*dims, "period"]
    s, m = spine.alias("s"), measured.alias("m")
    cond = reduce(lambda x, y: x & y, [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys])
    return s.join(m, cond, "left").select(*[f"s.{k}" for k in keys], *[f"m.{c}" for c in measured.columns if c not in keys])


def compare_periods(star: Star, metric_id: str, grain: str, baseline: str, dims: tuple[str, ...] = (), calendar: bool = False) -> DataFrame:
    """A metric next to its value in the previous period or in the same period a year before; change is null without a baseline.

    The metric is measured once; a window over its periods reaches back by time, not by rows, so a hole is no baseline. With
    `calendar` holes have rows of their own. A year of weeks is 52 of them.
    """
    if baseline not in ("previous_period", "year_over_year"):
        raise NeedsClarification(f"unknown baseline {baseline}")
    measured = measure(star, metric_id, dims, grain)
    back = _STEP[grain] if baseline == "previous_period" else "364 DAYS" if grain == "week" else "1 YEAR"
    groups = f"PARTITION BY {', '.join(dims)} " if dims else ""
    then = F.expr(f"max({metric_id}) OVER ({groups}ORDER BY period RANGE BETWEEN INTERVAL {back} PRECEDING AND INTERVAL {back} PRECEDING)")
    both = (on_spine(measured, grain, dims) if calendar else measured).withColumn("baseline", then)
    return both.select(*dims, "period", metric_id, "baseline", F.round(F.try_divide(F.col(metric_id) - F.col("baseline"), F.col("baseline")), 6).alias("change"))
