from pyspark.sql import functions as F

from quillon.operators import rollup
from quillon.sources.tables import Star


def test_customers_far_apart_make_no_bitmaps(spark, sf, monkeypatch):
    """One cell for a day's orders, however its customers are numbered; customers are counted in parts."""
    monkeypatch.setattr(rollup, "COUNTED", 50)

    class Sparse(Star):
        def orders(self):
            return spark.range(300).select("id", (F.col("id") % 200 * 2**20).alias("customer_id"), F.lit("F").alias("order_status"), F.lit("1998-04-01").cast("timestamp").alias("ordered_at")).withColumnRenamed("id", "order_id")

        def lines(self):
            return spark.range(600).select((F.col("id") % 300).alias("order_id"), F.lit(1).cast("long").alias("product_id"), F.lit(2).cast("decimal(14,2)").alias("price"))

        def customers(self):
            return spark.createDataFrame([], "customer_id long, customer_state string, customer_region string, segment string")

    lattice = rollup.build(Sparse(spark, sf))
    assert lattice.cells.count() <= 2
    got = lattice.query(["gmv", "item_count", "order_count", "customer_count"], (), "month").collect()
    assert [tuple(r)[1:] for r in got] == [(1200.0, 600, 300, 200)]
    assert {r.customer_count for r in lattice.grains(["customer_count"]).collect()} == {200}
