"""Stored inverted index for match ranking: typed postings in folders by a hash of the term, searched for many queries at once.

A search reads the folders of its terms only, and of a collection only its own rows. Scores are those of `similarity.text_match`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.stored import new_path

BUCKETS = 64
#: Terms that are handed on at once.
FLUSH = 200_000


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class MatchIndex:
    """postings: bucket (folder), term, collection, doc_id, tf, len; sizes: collection, n, avg_len; frequencies: bucket, term, collection, df."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def postings(self, asked: DataFrame) -> DataFrame:
        """Postings in the folders of the asked terms; there are at most `buckets` of them to name."""
        touched = sorted(r[0] for r in asked.select("bucket").distinct().collect())
        return self.table("postings").filter(F.col("bucket").isin(touched))

    def search(self, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, doc_id, score (6 places), rank of the k best documents. queries: query_id, text, and collection if they ask one only.

        A null collection asks all of them: then frequencies and lengths are those of all documents. Repeated words of a query count once.
        Ties go by doc_id. A query without a known word has no rows.
        """
        of = F.col("collection") if "collection" in queries.columns else F.lit(None).cast("string")
        asked = queries.select("query_id", of.alias("wanted"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).withColumn("bucket", _bucket("term", self.buckets))
        hits = asked.join(self.postings(asked), ["bucket", "term"]).filter(F.col("wanted").isNull() | (F.col("wanted") == F.col("collection")))
        # Sizes have a row a collection and one for all; frequencies likewise for every term.
        sizes = F.broadcast(self.table("sizes"))
        scoped = hits.join(sizes, hits["wanted"].eqNullSafe(sizes["of"])).drop("of")
        df = self.table("frequencies").filter(F.col("bucket").isin(sorted(r[0] for r in asked.select("bucket").distinct().collect())))
        known = scoped.join(df.withColumnRenamed("term", "t").withColumnRenamed("bucket", "at"), (F.col("bucket") == F.col("at")) & (F.col("term") == F.col("t")) & F.col("wanted").eqNullSafe(F.col("of")))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
        scored = known.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def build(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", collection: str | None = None, buckets: int = BUCKETS) -> MatchIndex:
    """Index whole texts. Ids are unique; null texts are empty and count as documents; a null collection is found by searches of all only."""
    spark = docs.sparkSession
    path = path or new_path(spark, "match")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.col(collection).cast("string") if collection else F.lit("")).alias("collection"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's terms are counted where it is read: only its distinct terms go on."""
        for b in batches:
            at, words, tf, sizes = [], [], [], []
            for i, t in enumerate(b.column(2)):
                # Bytes split at the white space of `terms`.
                n = Counter(t.as_py().encode().split())
                at += [i] * len(n)
                words += n
                tf += n.values()
                sizes += [n.total()] * len(n)
                if len(at) > FLUSH or i == b.num_rows - 1:
                    places = pa.array(at, pa.int64())
                    found = pa.array(words, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(places), b.column(1).take(places), pa.array(sizes, pa.int32()), found, pa.array(tf, pa.int32())], names=["doc_id", "collection", "len", "term", "tf"])
                    at, words, tf, sizes = [], [], [], []

    counted = rows.mapInArrow(count, f"doc_id {kind}, collection string, len int, term string, tf int")
    placed = counted.withColumn("bucket", _bucket("term", buckets))
    # A frequent term is spread over files of its folder; runs of documents keep files sorted by term.
    placed.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{path}/postings")
    index = MatchIndex(spark, path, buckets)
    both = lambda c: F.explode(F.array_distinct(F.array(F.col(c), F.lit(None).cast("string")))).alias("of")
    rows.select(F.size(terms(F.col("text"))).alias("len"), both("collection")).groupBy("of").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).write.parquet(f"{path}/sizes")
    index.table("postings").select("bucket", "term", both("collection")).groupBy("bucket", "term", "of").agg(F.count("*").alias("df")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/frequencies")
    return index
