"""Rollup lattice: daily partial sums and exact distinct sets, from which every coarser period and dimension follows.

The facts are read once. A row of the cells holds, for a day, a value of every dimension and a block of 32,768 order numbers, the
additive sums and a bitmap of the orders. Sums add up; bitmaps are united with `bitmap_or_agg`, so distinct counts stay exact in weeks,
months, quarters and years and over any subset of the dimensions. Orders are numbered by day and region first: a block of numbers
belongs to few cells, so the bitmaps are dense whatever the order keys look like. Customers come back on any day, and a bitmap would
hold few of them, so they stay rows of day, dimensions and customer; they are counted by customer, in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.metrics import EXCLUDED_STATUS, GRAINS, NeedsClarification
from quillon.sources.stored import new_path
from quillon.sources.tables import Star

DIMENSIONS = ("customer_region", "category")
#: Measure -> how it follows from the united parts of one cell.
MEASURES = {
    "gmv": lambda: F.sum("gmv").cast("double"),
    "item_count": lambda: F.sum("items"),
    "order_count": lambda: F.sum("orders"),
    "customer_count": lambda: F.sum("customers"),
    "average_order_value": lambda: F.round(F.try_divide(F.sum("gmv").cast("double"), F.sum("orders")), 6),
}
#: Customer rows that one task counts, and item rows of all months in one piece of each.
COUNTED, PIECE = 500_000, 50_000_000


def _numbered(orders: DataFrame, path: str) -> DataFrame:
    """Orders with a number that follows day and region, stored, since numbers must not change between reads."""
    order = ["day", "customer_region", "order_id"]
    near = orders.withColumn("day", F.to_date("ordered_at")).repartitionByRange(*order).sortWithinPartitions(*order)
    near.select("*", F.monotonically_increasing_id().alias("number")).write.mode("overwrite").parquet(path)
    return orders.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Rollup:
    """A stored lattice."""

    spark: SparkSession
    path: str
    dimensions: tuple[str, ...] = DIMENSIONS

    @property
    def cells(self) -> DataFrame:
        """The partial table: month (its folders), day, dimensions, block, gmv, items, bits (of order numbers)."""
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def parts(self) -> DataFrame:
        """Items summed by order and dimensions: month (its folders), day, dimensions, number, customer_id, gmv, items."""
        return self.spark.read.parquet(f"{self.path}/parts")

    def _united(self, place: Callable[[DataFrame], DataFrame], keys: list[str], measures: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
        """Measures by keys, which `place` adds to rows of cells and parts. Bitmaps are united by key and block, then their counts add up."""
        blocks = place(_between(self.cells, start, end)).groupBy(*keys, "block").agg(F.sum("gmv").alias("gmv"), F.sum("items").alias("items"), F.bitmap_or_agg("bits").alias("bits"))
        found = blocks.select(*keys, "gmv", "items", F.bitmap_count("bits").alias("orders"), F.lit(None).cast("long").alias("customers"))
        if "customer_count" in measures:
            rows = _between(self.parts, start, end).select("day", *self.dimensions, "customer_id")
            # All rows of a customer are in one task, which then counts without another shuffle.
            dealt = rows.repartition(max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // COUNTED)), "customer_id")
            each = place(dealt).groupBy(*keys, "customer_id").agg(F.count("customer_id").alias("n"))
            counted = each.groupBy(*keys).agg(F.count_if(F.col("n") > 0).alias("customers"))
            found = found.unionByName(counted, allowMissingColumns=True)
        return found.groupBy(*keys).agg(*[MEASURES[m]().alias(m) for m in measures])

    def query(self, measures: list[str], dims: tuple[str, ...] = (), grain: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Measures by dims and period, like `metrics.query` over items. Facts are not read; a range reads the months that it touches."""
        if unknown := [d for d in dims if d not in self.dimensions]:
            raise NeedsClarification(f"the lattice has no {', '.join(unknown)}")
        if grain is not None and grain not in GRAINS:
            raise NeedsClarification(f"no periods of {grain}")
        keys = [*dims, *(["period"] if grain else [])]
        return self._united(lambda rows: rows.withColumn("period", F.date_trunc(grain or "year", "day").cast("date")), keys, measures, start, end)

    def grains(self, measures: list[str], dims: tuple[str, ...] = (), grains: tuple[str, ...] = GRAINS) -> DataFrame:
        """All grains at once: grain, period, dims, measures, from one read of the cells."""
        at = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), F.date_trunc(g, "day").cast("date").alias("period")) for g in grains]))
        return self._united(lambda rows: rows.select("*", at.alias("at")).select("*", "at.grain", "at.period"), ["grain", "period", *dims], measures)

    def cube(self, measures: list[str], dims: tuple[str, ...], start: str | None = None, end: str | None = None) -> DataFrame:
        """Every subset of dims, with null for 'all', and `level`, the number of dimensions that are summed over."""
        subsets = [[d for i, d in enumerate(dims) if mask >> i & 1] for mask in range(1 << len(dims))]
        of = F.explode(F.array(*[F.struct(F.lit(len(dims) - len(s)).alias("level"), F.lit(n).alias("subset"), *[(F.col(d) if d in s else F.lit(None).cast("string")).alias(f"{d}_at") for d in dims]) for n, s in enumerate(subsets)]))

        def place(rows: DataFrame) -> DataFrame:
            return rows.select("*", of.alias("at")).select(*[c for c in rows.columns if c not in dims], "at.level", "at.subset", *[F.col(f"at.{d}_at").alias(d) for d in dims])

        return self._united(place, ["level", "subset", *dims], measures, start, end).drop("subset")


def _between(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        rows = rows.filter((F.col("month") >= start[:7]) & (F.col("day") >= F.lit(start).cast("date")))
    if end:
        rows = rows.filter((F.col("month") <= end[:7]) & (F.col("day") <= F.lit(end).cast("date")))
    return rows


def build(star: Star, path: str | None = None, since: str | None = None) -> Rollup:
    """Write (or, from the day `since` on, renew) the lattice of effective orders' items. Facts are scanned once.

    Renewing replaces whole months: those from the month of `since` on. Numbers given before are not used again.
    """
    spark = star.spark
    path = path or new_path(spark, "rollup")
    orders = star.orders().filter(~F.col("order_status").isin(*EXCLUDED_STATUS))
    first = 0
    if since:
        orders = orders.filter(F.col("ordered_at") >= F.lit(since[:7] + "-01").cast("timestamp"))
        last = spark.read.parquet(f"{path}/cells").agg(F.max("block")).first()[0]
        first = ((last or 0) + 1) << 15
    orders = orders.join(star.customers().select("customer_id", "customer_region"), "customer_id", "left").select("order_id", "customer_id", "customer_region", "ordered_at")
    numbered = _numbered(orders, f"{path}/numbers").withColumn("number", F.col("number") + first)
    # Items are summed by order and product before they meet either.
    lines = star.lines().groupBy("order_id", "product_id").agg(F.sum("price").alias("gmv"), F.count(F.lit(1)).alias("items"))
    rows = lines.join(numbered, "order_id").join(star.products(), "product_id", "left")
    pieces = 1 + star.lines().count() // PIECE
    rows = rows.withColumn("month", F.date_format("day", "yyyy-MM")).withColumn("piece", F.pmod(F.xxhash64("day"), F.lit(pieces)))
    # Days stay whole from here on.
    by_order = rows.repartition("month", "piece").groupBy("month", "piece", "day", "number", "customer_id", *DIMENSIONS).agg(F.sum("gmv").alias("gmv"), F.sum("items").alias("items"))

    def store(table: DataFrame, name: str) -> None:
        out = table.write.partitionBy("month").option("compression", "zstd").mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic" if since else "static").parquet(f"{path}/{name}")

    store(by_order.drop("piece"), "parts")
    lattice = Rollup(spark, path)
    renewed = lattice.parts.filter(F.col("month") >= since[:7]) if since else lattice.parts
    keys = [*DIMENSIONS, F.bitmap_bucket_number("number").alias("block")]
    cells = renewed.groupBy("month", "day", *keys).agg(F.sum("gmv").alias("gmv"), F.sum("items").alias("items"), F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    store(cells.repartition("month"), "cells")
    return lattice
