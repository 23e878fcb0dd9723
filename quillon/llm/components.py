"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links(u, v) of longs -> (node, root): the smallest node that each linked node reaches.

    Alternating large-star and small-star rounds on distributed tables. Each round is written to the shared folder,
    and the driver sees only its row count and a checksum. Self-links, repeats and null ends are ignored.
    """
    edges = materialize(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(small_low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "links")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        discard(edges)
        edges = after
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
