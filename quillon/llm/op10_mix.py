"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents, repeated up to `max_repeats` times. A copy's virtual time is the
source's cumulative words up to the middle of that copy, divided by the source's target (half a document before
the finish time, so that truncation rounds to the nearest document). All copies are range-sorted by virtual time
and cut where the words before it reach the budget. Running totals never gather a source in one task: ranges of
the (uniform) shuffle key and of virtual time are summed first, in two levels, then each range is ordered alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import WORD, materialize, table

CYCLE = (5, 2, 1)
REPEATS = 3
#: Ranges of virtual time for one target's worth of words, and ranges that are summed together first.
RANGES, SPAN = 256, 1_024


def targets(sizes: DataFrame, max_repeats: int = REPEATS) -> DataFrame:
    """sizes: key, source_size, weight, one row per source. Adds target: the budget (all sizes) shared by weight,
    no target above max_repeats times its source's size, the excess shared again by weight."""
    total = W.partitionBy()
    level = W.partitionBy().orderBy("ratio", "key")
    s = sizes.withColumn("cap", max_repeats * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = (
        s.withColumn("budget", F.sum("source_size").over(total))
        .withColumn("capped", F.sum("cap").over(level.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weights", F.sum("weight").over(level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("rank", F.row_number().over(level))
        .withColumn("each", (F.col("budget") - F.col("capped")).cast("double") / F.col("weights").cast("double"))
    )
    s = s.withColumn("level", F.min_by(F.when(F.col("each") <= F.col("ratio"), F.col("each")), F.when(F.col("each") <= F.col("ratio"), F.col("rank"))).over(total))
    return s.select("key", "source_size", "budget", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, max_repeats: int = REPEATS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Copies that the mix takes and those it leaves, ordered by virtual time when sorted by (virtual_time, shuffle_key, epoch).

    Columns: doc_id, source, size, source_size, target, shuffle_key, n (tells repeated rows apart), epoch, virtual_time, taken.
    Sources in code point order, null last, get the weights of `cycle` in turn. A null or empty text has size
    0 and one row with epoch null and taken false. Repeated rows are documents of their own. Documents with equal
    shuffle keys (same id and text) are interchangeable. An empty table gives no rows; other columns are ignored.
    """
    slim = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("c"), F.col(source))).alias("key"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))).alias("shuffle_key"),
        ),
        "mix",
    )
    by_source = slim.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    index = F.row_number().over(W.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (index % len(cycle) + 1).cast("int"))
    goals = targets(by_source.withColumn("weight", weight).select("key", "source_size", "weight"), max_repeats)
    # Hex digits of the shuffle key that name a range, so that ranges hold about 50,000 documents at any size.
    docs_n = slim.count()
    digits = 2
    while docs_n / 16**digits > 50_000:
        digits += 1
    keyed = slim.withColumn("range", F.substring("shuffle_key", 1, digits))
    offsets = keyed.groupBy("key", "range").agg(F.sum("size").alias("in_range"))
    before = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    # Goals travel with the ranges, so that documents are dealt by source and range, never by source alone.
    offsets = offsets.select("key", "range", (F.sum("in_range").over(before) - F.col("in_range")).alias("offset")).join(goals, "key")
    inside = W.partitionBy("key", "range").orderBy("shuffle_key", "doc_id")
    queue = (
        keyed.join(offsets, ["key", "range"])
        .withColumn("cum", F.col("offset") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("n", F.row_number().over(inside))
    )
    copies = queue.withColumn("epoch", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(max_repeats - 1))))).withColumn(
        "virtual_time", ((F.col("epoch") * F.col("source_size") + F.col("cum")).cast("double") - F.col("size") / 2.0) / F.col("target")
    )
    # Global range sort by virtual time: ranges in order, each ordered alone, totals of earlier ranges added.
    copies = copies.withColumn("slot", F.floor(F.col("virtual_time") * RANGES * max(1, 16 ** (digits - 2))))
    slots = copies.filter("epoch IS NOT NULL").groupBy("slot").agg(F.sum("size").alias("in_slot"))
    # Words before each slot: before its span of slots, and before it in its span. Only the spans' sums are ordered in one task.
    slots = slots.withColumn("span", F.floor(F.col("slot") / SPAN))
    spans = slots.groupBy("span").agg(F.sum("in_slot").alias("in_span"))
    spans = spans.select("span", (F.sum("in_span").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, 0)) - F.col("in_span")).alias("earlier"))
    in_span = F.sum("in_slot").over(W.partitionBy("span").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("in_slot")
    slots = slots.withColumn("served", in_span).join(spans, "span").select("slot", (F.col("served") + F.col("earlier")).alias("served"))
    order = W.partitionBy("slot").orderBy("virtual_time", "shuffle_key", "n", "epoch").rowsBetween(W.unboundedPreceding, 0)
    served = F.col("served") + F.sum("size").over(order)
    some = copies.filter("epoch IS NOT NULL").join(slots, "slot").withColumn("taken", served.cast("double") - F.col("size") / 2.0 <= F.col("budget").cast("double"))
    none = copies.filter("epoch IS NULL").withColumn("taken", F.lit(False))
    out = ["doc_id", "source", "key", "size", "source_size", "target", "shuffle_key", "n", "epoch", "virtual_time", "taken"]
    return some.select(out).unionByName(none.select(out))


def per_document(copies: DataFrame) -> DataFrame:
    """One row per document of `mix`: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    return (
        copies.groupBy("key", "shuffle_key", "n")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")], F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of `documents` with the words that the mix takes of it."""
    return per_document(mix(table(spark, sf_dir, "documents"))).drop("source")


def mix_sql(documents: str, columns: str) -> str:
    """The same in one statement; `columns` are taken from q, which has a row per document of `documents`."""
    return f"""
WITH s AS (
  SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 'c' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS shuffle_key
  FROM {documents}
), a AS (
  SELECT key, CAST(sum(size) AS DOUBLE) AS source_size,
         CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s GROUP BY key
), b AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio, sum(source_size) OVER () AS budget FROM a
), c AS (
  SELECT *, row_number() OVER w AS rank,
         (budget - (sum(cap) OVER (w ROWS UNBOUNDED PRECEDING) - cap))
         / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS each
  FROM b WINDOW w AS (ORDER BY ratio, key)
), g AS (
  SELECT key, source_size, budget, least(cap, weight * (SELECT min_by(each, rank) FROM c WHERE each <= ratio)) AS target FROM c
), q AS (
  SELECT s.*, source_size, budget, target, row_number() OVER w AS n,
         CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum
  FROM s JOIN g USING (key) WINDOW w AS (PARTITION BY key ORDER BY shuffle_key, doc_id)
), v AS (
  SELECT key, shuffle_key, n, size, budget, epoch, (epoch * source_size + cum - size / 2.0) / target AS virtual_time
  FROM q, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0
), o AS (
  SELECT *, sum(size) OVER (ORDER BY virtual_time, shuffle_key, n, epoch ROWS UNBOUNDED PRECEDING) - size / 2.0 <= budget AS taken FROM v
), k AS (
  SELECT key, shuffle_key, n, sum(size) AS words, count(*) AS copies FROM o WHERE taken GROUP BY ALL
)
SELECT {columns} FROM q LEFT JOIN k USING (key, shuffle_key, n)
"""


ORACLE = mix_sql("documents", "doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken")
