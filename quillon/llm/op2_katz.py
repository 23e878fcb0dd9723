"""Katz backoff bigram model: training on the corpus and scoring of every document.

P(w | v) = d(c) c(v w) / c(v) if the bigram was seen, else alpha(v) P(w); P(w) = d(c) c(w) / N if the word was
seen, else the mass that the seen words leave, as one class of unknown words. d is the Good-Turing discount for
counts up to CUTOFF. alpha(v) is the mass that the seen successors of v leave, divided by the unigram mass of all
other words, so that the probabilities after v add up to one. Katz's own rule leaves counts above CUTOFF as they are; here they keep
all but LARGE_DISCOUNT of their mass, so that a context of frequent successors only leaves some, too.

This is the scoring of the corpus that the model is learned from; `katz_model` stores the model as tables and scores other texts.

Blocks of documents ask key ranges: first for words (ids, counts), then for bigrams (counts, and what alpha needs of
each context). The answers are written tables, partitioned by range. Then each block scores its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.blocks import ROWS, Words, at_blocks, at_ranges, batch, deal, from_ipc, make_blocks, pack, unpack
from quillon.llm.common import materialize, partitions, table
from quillon.llm.words import mix64

CUTOFF = 5
LARGE_DISCOUNT = 0.005
#: Numbers of successors by count 1..CUTOFF, counts above it, unigram mass of the successors.
STATS = CUTOFF + 2
START = 0
#: Hash of the token that ends every document.
END = np.uint64(0x51ED270B7A2F4C3D)


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts for counts 0..CUTOFF+1 (the last one for all larger counts) from n[r], the number of keys with count r.

    Katz's formula over n[1..CUTOFF+1]; a count for which it gives no proper discount loses half a count instead.
    """
    d = np.ones(CUTOFF + 2)
    d[CUTOFF + 1] = 1 - LARGE_DISCOUNT
    common = (CUTOFF + 1) * n[CUTOFF + 1] / max(n[1], 1)
    for r in range(1, CUTOFF + 1):
        katz = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0
        d[r] = katz if 0 < katz < 1 else (r - 0.5) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, CUTOFF + 1)] * c


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each entry's place among them; only the distinct values are sorted."""
    import pandas as pd

    code, values = pd.factorize(x)
    order = np.argsort(values)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[code]


class Tokens:
    """The tokens of a block: words, then one end token a document; contexts; distinct words in the order they travel."""

    def __init__(self, part: pa.RecordBatch, ranges: int):
        w = Words((t.as_py() or "").encode().lower() for t in part.column("text"))
        docs = len(w.size)
        self.held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.edge = w.edge + np.arange(docs + 1)
        self.size = w.size + 1
        h = np.empty(self.edge[-1], np.uint64)
        last = self.edge[1:] - 1
        inner = np.ones(len(h), bool)
        inner[last] = False
        h[inner], h[last] = w.hash, END
        self.train = ~np.repeat(self.held, self.size)
        key, code = distinct(h)
        order, self.slices = deal(key, ranges)
        self.key = key[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.code = place[code]
        self.seen = np.bincount(self.code[self.train], minlength=len(key))

    def words(self, answers: dict[int, bytes]) -> None:
        """Ids and counts of the distinct words, as the ranges answer them."""
        got = [unpack(answers[r]) for r, _ in self.slices]
        self.id = np.concatenate([g["id"] for g in got])
        self.count = np.concatenate([g["count"] for g in got])

    def bigrams(self, ranges: int, hot: np.ndarray) -> None:
        """Distinct bigrams (places of context and word; context -1 is the start), by range, context id and word id."""
        before = np.concatenate(([-1], self.code[:-1]))
        before[self.edge[:-1]] = -1
        pair, self.pair = distinct((before + 1) << 32 | self.code)
        v, w = (pair >> 32) - 1, pair & 0xFFFFFFFF
        vid = np.where(v < 0, START, self.id[v])
        # A context goes to one range, but the successors of very frequent ones are dealt out.
        key = mix64(vid.astype(np.uint64))
        many = np.isin(vid, hot)
        key[many] = mix64(key[many] ^ self.id[w[many]].astype(np.uint64))
        own = ((key >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
        order = np.lexsort((self.id[w], vid, own))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[self.pair]
        self.v, self.w, self.vid, own = v[order], w[order], vid[order], own[order]
        cut = np.flatnonzero(np.diff(own)) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(own)]))
        self.pair_slices = [(int(own[b]), slice(int(b), int(e))) for b, e in zip(begin, end, strict=True)]


def _runs(x: np.ndarray) -> np.ndarray:
    """Places where a new value begins."""
    return np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1)) if len(x) else np.empty(0, np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 2**32 else x


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    `held_out` is a boolean column; rows where it is true teach nothing, null counts as false. A-Z are lower-cased. A null or
    empty text is its end token alone. Repeated rows and ids are documents of their own. With nothing to learn from, every
    token is unknown and certain: score 0. An empty table gives no rows; other columns are ignored. Ids are whole numbers: others
    raise a cast error.
    """
    spark = docs.sparkSession
    ranges = partitions(spark)
    blocks = make_blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")), "text", "doc_id", "katz-blocks")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for home, data in zip(b.column(0), b.column(2), strict=True):
                part = from_ipc(data.as_py())
                t = Tokens(part, ranges)
                texts = int((~t.held).sum())
                yield batch([(r, home.as_py(), pack(key=t.key[s], seen=narrow(t.seen[s]), docs=np.array([texts if k == 0 else 0]))) for k, (r, s) in enumerate(t.slices)])

    def answer_words(home: int, rows: list) -> Iterator[pa.RecordBatch]:
        got = [unpack(d) for _, d in rows]
        key, where = np.unique(np.concatenate([g["key"] for g in got]), return_inverse=True)
        count = np.bincount(where, np.concatenate([g["seen"] for g in got]), len(key)).astype(np.int64)
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((key, -count))] = np.arange(len(key))
        ids = rank * ranges + home + 1  # frequent words have small ids in every range; START is 0
        top = np.argsort(-count)[:64]  # a hot word has a 4 * ranges-th of all tokens, so ranges have few
        n = [int((count == r).sum()) for r in range(CUTOFF + 2)]
        facts = pack(n=np.array(n), total=np.array([count.sum(), (count > 0).sum(), sum(int(g["docs"][0]) for g in got)]), top=ids[top], top_count=count[top])
        at, out = 0, [(-1, home, facts)]
        for (block, _), g in zip(rows, got, strict=True):
            k = where[at : at + len(g["key"])]
            at += len(k)
            out.append((block, home, pack(id=ids[k], count=narrow(count[k]))))
        yield batch(out)

    unigrams = materialize(at_ranges(blocks.mapInArrow(ask_words, ROWS), answer_words), "katz-unigrams")
    # One row of facts a range: sums, and the range's most frequent words, of which few are hot overall.
    n1, total, tops = np.zeros(CUTOFF + 2, np.int64), np.zeros(3, np.int64), []
    for r in unigrams.filter("home = -1").select("data").toLocalIterator():
        f = unpack(bytes(r[0]))
        n1, total = n1 + f["n"], total + f["total"]
        tops.append(np.stack([f["top"], f["top_count"]], 1))
        if len(tops) > 64:
            tops = [_most(tops, 4 * ranges)]
    N, V, starts = map(int, total)
    top = _most(tops, 4 * ranges) if tops else np.empty((0, 2), np.int64)
    hot = np.append(top[top[:, 1] * 4 * ranges > N][:, 0], START)
    d1 = good_turing(list(n1))
    unknown = 1.0 if not N else 1 - sum(d1[r] * r * int(n1[r]) for r in range(1, CUTOFF + 1)) / N - d1[-1] * (N - sum(r * int(n1[r]) for r in range(1, CUTOFF + 1))) / N

    def load(rows: list) -> tuple[pa.RecordBatch, Tokens, dict[int, bytes]]:
        part = from_ipc(rows[0][1])
        t = Tokens(part, ranges)
        answers = dict(rows[1:])
        t.words(answers)
        t.bigrams(ranges, hot)
        return part, t, answers

    def ask_bigrams(home: int, rows: list) -> Iterator[pa.RecordBatch]:
        if rows[0][0] != -1:
            return
        _, t, _ = load(rows)
        seen = np.bincount(t.pair[t.train], minlength=len(t.v))
        wid, wcount = t.id[t.w], t.count[t.w]
        for r, s in t.pair_slices:
            first = _runs(t.vid[s])
            yield batch([(r, home, pack(v=t.vid[s][first], run=narrow(np.diff(np.append(first, s.stop - s.start))), w=narrow(wid[s]), seen=narrow(seen[s]), count=narrow(wcount[s])))])

    def answer_bigrams(home: int, rows: list) -> Iterator[pa.RecordBatch]:
        got = [unpack(d) for _, d in rows]
        v = np.concatenate([np.repeat(g["v"], g["run"]) for g in got])
        w = np.concatenate([g["w"] for g in got]).astype(np.int64)
        seen = np.concatenate([g["seen"] for g in got]).astype(np.int64)
        word = np.concatenate([g["count"] for g in got]).astype(np.int64)
        order = np.lexsort((w, v))
        new = np.zeros(len(v), bool)
        new[0] = True
        new[1:] = (np.diff(v[order]) != 0) | (np.diff(w[order]) != 0)
        first = np.flatnonzero(new)
        count = np.add.reduceat(seen[order], first)
        number = np.empty(len(v), np.int64)
        number[order] = np.cumsum(new) - 1
        context = v[order][first]
        mass = discounted(word[order][first], d1) / max(N, 1)
        begin = _runs(context)
        live = count > 0
        stats = np.stack([*(np.add.reduceat((count == r).astype(float), begin) for r in range(1, CUTOFF + 1)), np.add.reduceat(np.where(count > CUTOFF, count, 0).astype(float), begin), np.add.reduceat(np.where(live, mass, 0.0), begin)], 1)
        contexts = context[begin]
        n = [int((count == r).sum()) for r in range(CUTOFF + 2)]
        many = np.isin(contexts, hot)
        model = pack(n=np.array(n), hot=contexts[many], hot_stats=stats[many].ravel(), contexts=contexts, successors=narrow(np.diff(np.append(begin, len(context)))), words=w[order][first], counts=narrow(count), stats=stats.ravel())
        at, out = 0, [(-1, home, model)]
        for (block, _), g in zip(rows, got, strict=True):
            k = number[at : at + len(g["w"])]
            at += len(k)
            out.append((block, home, pack(seen=narrow(count[k]), stats=stats[np.searchsorted(contexts, g["v"])].ravel())))
        for i in range(0, len(out), 50):
            yield batch(out[i : i + 50])

    words = unigrams.filter("home >= 0")
    asked = at_blocks(blocks.unionByName(words), ask_bigrams)
    bigrams = materialize(at_ranges(asked, answer_bigrams), "katz-bigrams")
    n2, hot_stats = np.zeros(CUTOFF + 2, np.int64), {}
    for n, hot_v, hot_s in _model_facts(bigrams):
        n2 = n2 + n
        for k, s in zip(hot_v.tolist(), hot_s.reshape(-1, STATS), strict=True):
            hot_stats[k] = hot_stats.get(k, 0) + s
    d2 = good_turing(list(n2))
    hot_ids = np.array(sorted(hot_stats), np.int64)
    hot_rows = np.array([hot_stats[k] for k in hot_ids.tolist()]).reshape(-1, STATS)

    def evaluate(home: int, rows: list) -> Iterator[pa.RecordBatch]:
        if rows[0][0] != -1:
            return
        # Peers of both tables are ranges; those of bigrams were moved behind those of unigrams.
        part, t, answers = load(rows)
        got = [unpack(answers[ranges + r]) for r, _ in t.pair_slices]
        c2 = np.concatenate([g["seen"] for g in got]).astype(np.int64)
        stats = np.concatenate([np.repeat(g["stats"].reshape(-1, STATS), np.diff(np.append(_runs(t.vid[s]), s.stop - s.start)), 0) for g, (_, s) in zip(got, t.pair_slices, strict=True)])
        many = np.isin(t.vid, hot_ids)
        stats[many] = hot_rows[np.searchsorted(hot_ids, t.vid[many])]
        count = t.count.astype(np.int64)
        p1 = np.where(count > 0, discounted(count, d1) / max(N, 1), unknown)
        cv = np.where(t.v < 0, starts, count[t.v])
        left = 1 - (stats[:, :CUTOFF] @ (d2[1 : CUTOFF + 1] * np.arange(1, CUTOFF + 1)) + d2[-1] * stats[:, CUTOFF]) / np.maximum(cv, 1)
        alpha = np.where(cv > 0, left / (1 - stats[:, CUTOFF + 1]), 1.0)
        p = np.where(c2 > 0, discounted(c2, d2) / np.maximum(cv, 1), alpha * p1[t.w])
        base = np.log10((count + 0.5) / (N + 0.5 * (V + 1)))
        begin = t.edge[:-1]
        cols = {
            "doc_id": part.column("doc_id").cast(pa.int64()), "held_out": part.column("held_out"), "n_tokens": pa.array(t.size, pa.int64()),
            "n_known": pa.array(np.add.reduceat((count > 0)[t.code].astype(np.int64), begin)), "train_tokens": pa.array(np.full(len(begin), N)),
            "base_score": pa.array(np.add.reduceat(base[t.code], begin)), "score": pa.array(np.add.reduceat(np.log10(p)[t.pair], begin)),
        }
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    replies = bigrams.filter("home >= 0").withColumn("peer", F.col("peer") + ranges)
    everything = blocks.unionByName(words).unionByName(replies)
    return at_blocks(everything, evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _most(tops: list[np.ndarray], k: int) -> np.ndarray:
    t = np.concatenate(tops)
    return t[np.lexsort((t[:, 0], -t[:, 1]))][:k]


def _model_facts(bigrams: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of counts and hot contexts of every range, without the rest of its part of the model."""

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, d in zip(b.column(1), b.column(2), strict=True):
                m = unpack(d.as_py())
                rows.append((-1, p.as_py(), pack(n=m["n"], hot=m["hot"], hot_stats=m["hot_stats"])))
            yield batch(rows)

    for r in bigrams.filter("home = -1").mapInArrow(slim, ROWS).toLocalIterator():
        m = unpack(bytes(r["data"]))
        yield m["n"], m["hot"], m["hot_stats"]


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of `documents` with its scores under the model of all that are not held out."""
    unseen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return score(table(spark, sf_dir, "documents"), unseen)
