"""The Katz backoff model as tables: fitted once, stored by context, and read by any number of scorings of other texts.

Unigrams (word, n, p), bigrams (context, word, n, p) and contexts (context, size, alpha) are Parquet tables partitioned by a hash of the
context (of the word for unigrams). A token is evaluated from the longest history down: the bigram's own probability where it was seen,
else the context's backoff weight times the word's probability, else the mass of unknown words. All of it is DataFrame joins and sums.
`op2_katz.score` gives the same numbers for the corpus that it learns from, by exchanges between blocks instead of rows of text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, ascii_lower, materialize
from quillon.llm.op2_katz import CUTOFF, good_turing

#: Neither can be a word: the context of a first token, and the token that ends every text.
START, END = " ", ""
BUCKETS = 64


@dataclass
class Model:
    unigrams: DataFrame
    bigrams: DataFrame
    contexts: DataFrame
    #: Tokens learned from, distinct ones, and the probability of a word that was never seen.
    tokens: int
    words: int
    unknown: float


def tokens(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, and the end."""
    return F.concat(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), F.array(F.lit(END)))


def pairs(t: Column) -> Column:
    """array<struct<context, word>>, one for each token."""
    return F.zip_with(F.concat(F.array(F.lit(START)), F.slice(t, F.lit(1), F.size(t) - 1)), t, lambda v, w: F.struct(v.alias("context"), w.alias("word")))


def _discounted(n: Column, d) -> Column:
    return n * F.element_at(F.array(*[F.lit(float(x)) for x in d]), (F.least(n, F.lit(CUTOFF + 1)) + 1).cast("int"))


def _counts_of_counts(df: DataFrame) -> list[int]:
    found = dict(df.filter(F.col("n") <= CUTOFF + 1).groupBy("n").count().collect())
    return [found.get(r, 0) for r in range(CUTOFF + 2)]


def _stored(df: DataFrame, key: str, name: str) -> DataFrame:
    """Written by the hash of its key, so that a lookup of some keys reads some folders."""
    return materialize(df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), name, partition_by="bucket")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts, discounts and backoff weights of all texts. A null or empty text is its end token alone. An empty table gives empty tables."""
    seen = docs.select(F.explode(pairs(tokens(F.col(text)))).alias("p")).groupBy("p.context", "p.word").agg(F.count("*").alias("n"))
    seen = materialize(seen, "bigram-counts")
    single = materialize(seen.groupBy("word").agg(F.sum("n").alias("n")), "unigram-counts")
    total = single.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    N, d1, d2 = total["n"] or 0, good_turing(_counts_of_counts(single)), good_turing(_counts_of_counts(seen))
    unigrams = _stored(single.withColumn("p", _discounted(F.col("n"), d1) / max(N, 1)), "word", "katz-words")
    sizes = seen.groupBy("context").agg(F.sum("n").alias("size"))
    bigrams = _stored(seen.join(sizes, "context").select("context", "word", "n", (_discounted(F.col("n"), d2) / F.col("size")).alias("p")), "context", "katz-pairs")
    both = bigrams.select("context", "word", "p", F.col("n").alias("times")).join(unigrams.select("word", F.col("p").alias("alone")), "word")
    left = both.groupBy("context").agg(F.sum("times").alias("size"), ((1 - F.sum("p")) / (1 - F.sum("alone"))).alias("alpha"))
    mass = unigrams.agg(F.sum("p")).first()[0]
    return Model(unigrams, bigrams, _stored(left, "context", "katz-contexts"), N, total["words"], 1 - mass if N else 1.0)


def score_texts(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, score (log10 probability of the text): one row per input row, also for texts that the model never saw.

    Texts are told apart by id and hash, so repeated rows are scored once and come back as often as they are there. Null ids are ids.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("of"), F.col(text).alias("said"))
    each = rows.dropDuplicates(["doc_id", "of"]).select("doc_id", "of", F.explode(pairs(tokens(F.col("said")))).alias("p")).groupBy("doc_id", "of", "p.context", "p.word").agg(F.count("*").alias("times"))
    told = each.join(model.bigrams.select("context", "word", F.col("p").alias("p2")), ["context", "word"], "left").join(model.contexts.select("context", "alpha"), "context", "left").join(model.unigrams.select("word", F.col("p").alias("p1")), "word", "left")
    p = F.coalesce("p2", F.coalesce("alpha", F.lit(1.0)) * F.coalesce("p1", F.lit(model.unknown)))
    sums = told.groupBy(F.col("doc_id").alias("d"), F.col("of").alias("o")).agg(F.sum("times").alias("n_tokens"), F.sum(F.when(F.col("p1").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.col("times") * F.log10(p)).alias("score"))
    return rows.join(sums, rows["doc_id"].eqNullSafe(sums["d"]) & rows["of"].eqNullSafe(sums["o"])).select("doc_id", "n_tokens", "n_known", "score")
