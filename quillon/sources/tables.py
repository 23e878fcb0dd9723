"""Scans and the star schema over the test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Category names shown to users; types that are not listed show their raw name.
CATEGORY_NAMES = {"ECONOMY": "budget", "STANDARD": "standard", "PROMO": "promotion", "MEDIUM": "mid_range"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Raw release file: header, quoted values over several lines, doubled quotes; every value a string unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """Any DBMS with a JDBC driver on the class path. One trailing semicolon is dropped; with bounds the scan is parallel."""
    query = query.rstrip().removesuffix(";")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column and bounds:
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    else:
        reader = reader.option("query", query)
    return reader.load()


@dataclass(frozen=True)
class Star:
    """Facts and dimensions under their semantic names, as lazy frames."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def orders(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_orderdate").alias("ordered_at"))

    def lines(self) -> DataFrame:
        """Order items alone."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_extendedprice").cast("decimal(14,2)").alias("price"), F.col("l_shipdate").alias("shipped_at"))

    def items(self) -> DataFrame:
        """Order items with their order's columns: one row per item."""
        return self.lines().join(self.orders(), "order_id")

    def deliveries(self) -> DataFrame:
        """Orders with the time of their last shipment; orders without items, or shipped before they were placed, are left out."""
        last = self.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_shipdate").alias("delivered_at"))
        return self.orders().join(last, "order_id").filter("delivered_at >= ordered_at")

    def reviews(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "lang", "source")
        return self.table("labels").filter("quality BETWEEN 0 AND 1").join(docs, "doc_id", "left")

    def customers(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state"), F.col("r_name").alias("customer_region"), F.col("c_mktsegment").alias("segment"))

    def sellers(self) -> DataFrame:
        return self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"))

    def products(self) -> DataFrame:
        """Products with a category: translated name, else the raw type, else 'uncategorized'."""
        names = self.spark.createDataFrame(list(CATEGORY_NAMES.items()), "p_type string, translated string")
        return self.table("part").join(F.broadcast(names), "p_type", "left").select(F.col("p_partkey").alias("product_id"), F.coalesce("translated", "p_type", F.lit("uncategorized")).alias("category"), F.col("p_brand").alias("brand"))
