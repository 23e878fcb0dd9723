"""Removal of repeated word windows, found through difference-cover anchors.

Only 8-word anchors that start at places 0, 1, 3 or 9 modulo 13 of their document are hashed and counted: for any two
places there is a shift below 13 that brings both to such places, so two equal 20-word windows share an aligned anchor
inside. Around repeated anchors the match is extended to whole windows, which are compared by the words themselves: by
a 128-bit BLAKE2b digest of the window's text, so no hash of hashes decides what is removed. Documents are taken in
blocks by a hash of their rows; a block sends each distinct anchor and window once, as a row, however often it occurs, so
the rows of a key are at most the blocks. Spark counts, joins, ranks and brings the rows back to the blocks. The texts
themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import partitions, table
from quillon.llm.words import Hashes, bounded, windows

WINDOW = 20
#: A perfect difference cover: every shift modulo 13 is a difference of two of its places.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text in a block, about; there are at least as many blocks as shuffle partitions.
BLOCK_BYTES = 12_000_000
_COVER = np.isin(np.arange(PERIOD), COVER)


def _words(part: pa.Table, text: str) -> Iterator[list[bytes]]:
    return ((t.as_py() or "").encode().split() for t in part.column(text))


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a document's anchors."""
    h = windows(hashes, ANCHOR)
    at = np.flatnonzero(_COVER[np.arange(len(h)) % PERIOD])
    return at, h[at]


def near_anchors(words: int, hit: np.ndarray) -> np.ndarray:
    """Places of the windows that contain an anchor at one of the places `hit`: they start up to 12 places before it."""
    n = words - WINDOW + 1
    if n <= 0 or not len(hit):
        return np.empty(0, np.int64)
    near = np.zeros(words + 1, np.int32)
    np.add.at(near, np.maximum(hit - (PERIOD - 1), 0), 1)
    np.add.at(near, hit + 1, -1)
    return np.flatnonzero(np.cumsum(near)[:n] > 0)


def digests(words: list[bytes], at: np.ndarray) -> bytes:
    """Digest of the text of each window, 16 bytes each."""
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    return b"".join(blake2b(text[b:e], digest_size=16).digest() for b, e in zip(begins[at].tolist(), ends[at + WINDOW - 1].tolist(), strict=True))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalize: bool = True) -> DataFrame:
    """Every column of docs, with `text` replaced by the words that are kept, joined by one space, and n_words, n_removed.

    A word goes if a window of 20 words that covers it has the same words as one that starts earlier: in a smaller
    doc_id, or earlier in the same document. Windows are judged on the input. Ids may be of any type with an order. Rows with equal
    ids are ordered by a hash of id and text, null ids come last. A null or empty text, or one under 20 words, loses
    nothing; a null text stays null. Other texts come back with single spaces; without `normalize`, texts that lose nothing come
    back as they were. Existing columns n_words and n_removed are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_words", "n_removed")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    long = T.LongType()
    many = max(partitions(docs.sparkSession), -(-size // BLOCK_BYTES))
    # Anchors only tell where to look: so many bits that chance repeats are below one in a hundred.
    mask = np.uint64(2 ** min(64, size.bit_length() + 6) - 1)
    blocks = docs.withColumn("__block", F.pmod(F.xxhash64(doc_id, text), F.lit(many))).repartition("__block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct anchors of a block, and how often each occurs (2: twice or more)."""
        memo = Hashes()
        for part in bounded(batches, text):
            block = part.column("__block").to_numpy()
            found = [anchors(memo.of(w))[1] for w in _words(part, text)]
            owner, found = np.repeat(block, list(map(len, found))), np.concatenate(found)
            for own in np.unique(owner):
                key, n = np.unique(found[owner == own] & mask, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), own)), pa.array(key.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["__block", "anchor", "n"])

    # Dealt by anchor once, for the count and for the way back: both read the same columns, so that Spark sees one exchange.
    entries = T.StructType().add("__block", long, False).add("anchor", long, False).add("n", T.ByteType(), False)
    asked = blocks.mapInArrow(ask, entries).repartition("anchor")
    known = asked.groupBy(F.col("anchor").alias("shared")).agg(F.sum("n").alias("total"), F.max("__block").alias("last")).filter("total > 1")
    flags = asked.join(known.hint("shuffle_hash"), F.expr("anchor = shared AND n <= total AND __block <= last")).select("__block", "anchor")

    def ordered(part: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        return part.take(pa.compute.sort_indices(part, sort_keys=[(doc_id, "ascending"), (text, "ascending")], null_placement="at_end"))

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        """The distinct windows of a block at their earliest places, counted in words of the block. Of repeats within the block, runs of such places."""
        left = ordered(left)
        repeated = np.unique(right.column("anchor").to_numpy().view(np.uint64))
        memo, ids, places, keys, at = Hashes(), [], [], bytearray(), 0
        for k, words in enumerate(_words(left, text) if len(repeated) else ()):
            place, h = anchors(memo.of(words))
            h &= mask
            hit = np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)
            near = near_anchors(len(words), place[repeated[hit] == h])
            if len(near):
                ids.append(np.full(len(near), k, np.int32))
                places.append((near + at).astype(np.int32))
                keys += digests(words, near)
            at += len(words)
        ids, places = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (ids, places))
        block = left.column("__block").slice(0, 1).to_pylist()
        key = np.frombuffer(keys, np.int64).reshape(-1, 2).copy()
        order = np.lexsort((key[:, 1], key[:, 0]))
        mark = np.zeros(len(key), bool)
        mark[order[1:]] = (key[order[1:]] == key[order[:-1]]).all(1)
        again = places[mark]
        begin = np.flatnonzero(np.diff(again, prepend=-2) != 1)
        run = np.diff(np.append(begin, len(again)))
        # A run has a key of its own.
        home = block[0] if block else 0
        own = np.stack([again[begin].astype(np.int64), np.full(len(begin), home)], 1)
        ids, places = np.concatenate((ids[~mark], ids[mark][begin])), np.concatenate((places[~mark], again[begin]))
        key, run = np.concatenate((key[~mark], own)), np.concatenate((np.zeros((~mark).sum(), np.int32), run.astype(np.int32)))
        return pa.table([pa.array(np.full(len(places), home)), left.column(doc_id).take(pa.array(ids)), pa.array(places), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(run)], names=["__block", "__id", "at", "k0", "k1", "run"])

    windows_of = T.StructType().add("__block", long).add("__id", docs.schema[doc_id].dataType).add("at", T.IntegerType()).add("k0", long).add("k1", long).add("run", T.IntegerType())
    found = blocks.groupBy("__block").cogroup(flags.groupBy("__block")).applyInArrow(extend, windows_of)
    rank = F.row_number().over(W.partitionBy("k0", "k1").orderBy(F.col("__id").asc_nulls_last(), "__block", "at"))
    later = found.withColumn("rank", rank).filter("run > 0 OR rank > 1").select("__block", "at", F.greatest("run", F.lit(1)).alias("run"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = ordered(left)
        edge = np.concatenate(([0], np.cumsum([len(w) for w in _words(left, text)], dtype=np.int64)))
        cover = np.zeros(edge[-1] + 1, np.int32)
        at, run = right.column("at").to_numpy(), right.column("run").to_numpy()
        np.add.at(cover, at, 1)
        np.add.at(cover, at + run - 1 + WINDOW, -1)
        gone = np.cumsum(cover)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[edge[1:]] - total[edge[:-1]]
        texts = []
        for i, t in enumerate(left.column(text)):
            t = t.as_py()
            if t is not None and (normalize or removed[i]):
                words = t.encode().split()
                if removed[i]:
                    words = [words[k] for k in np.flatnonzero(~gone[edge[i] : edge[i + 1]]).tolist()]
                t = b" ".join(words).decode()
            texts.append(t)
        out = left.drop_columns(["__block"]).set_column(column, text, pa.array(texts, pa.string()))
        return out.append_column("n_words", pa.array(np.diff(edge), pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    column = docs.columns.index(text)
    kept = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema), T.StructField("n_words", long), T.StructField("n_removed", long)])
    return blocks.groupBy("__block").cogroup(later.groupBy("__block")).applyInArrow(finish, kept)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of `documents`: its words, how many repeat an earlier window, and the hash of the others."""
    kept = repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), k AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS seq FROM w
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS r FROM k WHERE i + {WINDOW - 1} <= n
), g AS (
  SELECT DISTINCT doc_id, i + j AS i, true AS gone FROM f, (SELECT unnest(range({WINDOW})) AS j) WHERE r > 1
), o AS (
  SELECT doc_id, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone IS NULL) AS kept
  FROM w LEFT JOIN g USING (doc_id, i) GROUP BY 1
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""
