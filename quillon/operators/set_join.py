"""Joins of many questions with many memories by the similarity of their texts.

Two sets of similarity t or more share a token among their rarest ones (prefix filter) and have sizes near each other (length filter),
so texts meet on their rare tokens only, and no pair is missed. Word sets are compared by Jaccard. The ratio of matching blocks is bounded
by the characters, the grams and the longest common subsequence of two texts, for all pairs in groups of bounded size, and computed for the
pairs that are left. Equal texts are one class while pairs are formed.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import similarity
from quillon.sources.stored import written

#: Rounding of sizes must not lose a pair.
_EPS = 1e-9
#: Tokens whose counts are sent to all tasks, at most (about 20 bytes each).
FREQUENT = 200_000
#: Words of 64 bits in which the tokens of a set are marked: so many that hardly a pair that is not similar is stored.
MARKS = 4
#: Memories and questions whose matching blocks one group compares.
TEXTS = (500, 1_000)
#: The matcher looks for matches at rare characters only in texts of this length: those that are at most one in so many, and one more.
POPULAR, ONE_IN = 200, 100
#: Words of 64 bits that hold the places of a shorter text, and pairs whose common subsequences are computed at once.
WORDS, AT_ONCE = -(-POPULAR // 64), 20_000
#: Characters of the grams that two texts must share, and the buckets in which they are counted, few first.
GRAM, BUCKETS = 5, (1_024, 8_192)


def _largest(kind: str, t: float) -> float:
    """How many times as large a similar set can be."""
    return 1 / t if kind == "jaccard" else (2 - t) / t


def _frequent(sides: list[DataFrame]) -> dict[str, int]:
    """The most frequent tokens of both sides and how often each occurs, FREQUENT at most; the others count as never."""
    tokens = reduce(DataFrame.unionAll, [df.select(F.explode("tokens").alias("token")) for df in sides])
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).filter("often > 2").orderBy(F.desc("often"), "token").limit(FREQUENT)
    return {r["token"]: r["often"] for r in often.collect()}


def _rarest(df: DataFrame, key: str, frequent: dict[str, int], t: float, kind: str) -> DataFrame:
    """token (hashed), id, size, place and marks of the rarest tokens of every set: so many that any similar set shares one. Marks are a bit a token."""
    marks = [f"mark{i}_{key}" for i in range(MARKS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, at, sizes, places, bits = [], [], [], [], []
            for i, own in enumerate(b.column(1).to_pylist()):
                least = math.ceil(len(own) * (t if kind == "jaccard" else t / (2 - t)) - _EPS)
                rare = sorted(own, key=lambda w: (frequent.get(w, 0), w))[: len(own) - least + 1]
                mark = 0
                for w in own:
                    mark |= 1 << zlib.crc32(w.encode()) % (64 * MARKS)
                tokens += rare
                at += [i] * len(rare)
                sizes.append(len(own))
                places += range(1, len(rare) + 1)
                bits.append(np.frombuffer(mark.to_bytes(8 * MARKS, "little"), np.int64))
            each = pa.array(at, pa.int64())
            held = np.array(bits, np.int64).reshape(-1, MARKS).T
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), b.column(0).take(each), pa.array(sizes, pa.int32()).take(each), pa.array(places, pa.int32()), *(pa.array(x).take(each) for x in held)], names=["token", key, f"size_{key}", f"place_{key}", *marks])

    id_type = df.schema[key].dataType.simpleString()
    rows = df.select(key, "tokens").mapInArrow(run, f"token string, {key} {id_type}, size_{key} int, place_{key} int, {', '.join(f'{m} long' for m in marks)}")
    # Short rows: tokens of one hash only meet in vain.
    return rows.withColumn("token", F.xxhash64("token"))


def candidates(left: DataFrame, right: DataFrame, t: float, kind: str = "jaccard") -> DataFrame:
    """Pairs (a, b) of left (a, tokens) and right (b, tokens) with similarity of t or more; ids are unique on each side, tokens are sets.

    Empty sets are like nothing. No pair of sets is formed but by a token that is rare for both, and none is lost: the first token that two
    similar sets share leaves enough of them behind it (positions), and few enough of their marked bits differ.
    """
    if not 0 < t <= 1:
        raise ValueError("the similarity must be over 0 and at most 1")
    sets = _met(left, right, t, kind).join(left.select("a", F.col("tokens").alias("x")), "a").join(right.select("b", F.col("tokens").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    score = both / (F.size("x") + F.size("y") - both) if kind == "jaccard" else 2 * both / (F.size("x") + F.size("y"))
    return sets.select("a", "b", score.alias("similarity")).filter(F.col("similarity") >= t - _EPS)


def _met(left: DataFrame, right: DataFrame, t: float, kind: str) -> DataFrame:
    """a, b of all similar pairs and of few others, which are compared set by set."""
    frequent = _frequent([left, right])
    a, b = F.col("size_a"), F.col("size_b")
    factor = _largest(kind, t) * (1 + _EPS)
    shared = F.ceil((a + b) * (t / (1 + t) if kind == "jaccard" else t / 2) - _EPS)
    behind = 1 + F.least(a - F.col("place_a"), b - F.col("place_b"))
    differ = sum((F.bit_count(F.col(f"mark{i}_a").bitwiseXOR(F.col(f"mark{i}_b"))) for i in range(MARKS)), F.lit(0))
    met = _rarest(left, "a", frequent, t, kind).join(_rarest(right, "b", frequent, t, kind), "token").filter((a <= b * factor) & (b <= a * factor) & (behind >= shared) & (differ <= a + b - 2 * shared))
    return met.select("a", "b").distinct()


def _common(masks: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence of a text and one of this size, given by the places of its characters as bits."""
    ends = (1 << size) - 1
    v = ends
    for c in text:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & ends
    return size - v.bit_count()


def _all_common(xs: list[np.ndarray], ys: list[np.ndarray], characters: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`_common` of many pairs (xs[i], ys[j]) at once, texts being numbers of characters and none of ys over 64 * WORDS long."""
    masks = np.zeros((len(ys), characters + 1, WORDS), np.uint64)
    for n, y in enumerate(ys):
        at = np.arange(len(y))
        np.bitwise_or.at(masks[n], (y, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    size = np.array(list(map(len, xs)))
    steps = np.full((size.max(initial=0), len(xs)), characters, np.int32)  # what follows a text is in no other
    for n, x in enumerate(xs):
        steps[: len(x), n] = x
    out = np.zeros(len(i), np.int64)
    by = np.argsort(-size[i], kind="stable")
    for some in np.array_split(by, -(-len(by) // AT_ONCE) or 1):
        own, base = i[some], j[some] * (characters + 1)
        end = np.searchsorted(-size[own], -np.arange(size[own].max(initial=0)), "left")
        words = -(-max((len(ys[n]) for n in set(j[some].tolist())), default=0) // 64)
        flat = [np.ascontiguousarray(masks[:, :, w]).ravel() for w in range(words)]
        left = [np.full(len(some), ~np.uint64(0)) for _ in range(words)]
        for k, n in enumerate(end):  # the first n texts have a character k
            key, carry = base[:n] + steps[k, own[:n]], np.uint64(0)
            for mask, all_of in zip(flat, left, strict=True):
                v = all_of[:n]
                u = v & mask[key]
                total = v + u
                over = total < u
                total += carry
                over |= total < carry
                carry = over.astype(np.uint64)
                all_of[:n] = total | (v ^ u)
        for v in left:
            out[some] += 64 - np.bitwise_count(v)
    return out


def _counts(texts: list[str], places: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(places)), np.int32)
    for i, x in enumerate(texts):
        for c, n in Counter(x).items():
            out[i, places[c]] = n
    return out


def _grams(texts: list[str], buckets: int, kind: type = np.int32) -> np.ndarray:
    """How many grams of each text fall into each bucket."""
    out = np.zeros((len(texts), buckets), kind)
    for i, x in enumerate(texts):
        chars = np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = max(0, len(chars) - GRAM + 1)
        h = np.zeros(n, np.uint64)
        for k in range(GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) + chars[k : k + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
        out[i] = np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return out


def alike_in_blocks(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """a, b, score: pairs of texts (a, x) and (b, y) whose ratio of matching blocks is t or more, group by group.

    All pairs are judged: by their characters, then by their grams, then by their longest common subsequence, of which the matching blocks
    are one; the ratio is computed where all allow it. The matcher begins a block in a text of POPULAR characters or more only at a rare one, or
    at the beginning of both texts: so there are at most as many blocks as common rare characters and one more, and of each block all grams are common.
    """

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        xs, ys = asked.column("x").to_pylist(), rows.column("y").to_pylist()
        places = {c: i for i, c in enumerate(sorted(set().union(*xs, *ys)))}
        mine, sizes = _counts(xs, places), np.array([len(x) for x in xs], np.int64)
        kind = np.int16 if sizes.max(initial=0) < 2**15 else np.int32
        grams = [(n, _grams(xs, n, kind)) for n in BUCKETS]
        pairs = []
        for j, (y, own) in enumerate(zip(ys, _counts(ys, places), strict=True)):
            near = np.flatnonzero(2 * np.minimum(mine, own).sum(1) >= t * (sizes + len(y)) - _EPS)
            if len(y) >= POPULAR:
                rare = np.flatnonzero(own <= len(y) // ONE_IN + 1)
                blocks = np.minimum(mine[near[:, None], rare], own[rare]).sum(1) + 1
                least = t * (sizes[near] + len(y)) / 2 - (GRAM - 1) * blocks - _EPS
                for n, counted in grams:
                    if len(near):
                        found = np.minimum(counted[near], np.minimum(_grams([y], n), np.iinfo(kind).max).astype(kind)).sum(1, dtype=np.int64) >= least
                        near, least = near[found], least[found]
            pairs.append(near)
        short = np.flatnonzero([len(y) < POPULAR for y in ys])
        numbers = lambda x: np.fromiter((places[c] for c in x), np.int32, len(x))
        lengths = [len(pairs[j]) for j in short]
        if sum(lengths):
            near = np.concatenate([pairs[j] for j in short])
            used, place = np.unique(near, return_inverse=True)
            common = _all_common([numbers(xs[i]) for i in used], [numbers(ys[j]) for j in short], len(places), place, np.repeat(np.arange(len(short)), lengths))
            alike = 2 * common >= t * (sizes[near] + np.repeat([len(ys[j]) for j in short], lengths)) - _EPS
            for j, own, found in zip(short, *(np.split(v, np.cumsum(lengths)[:-1]) for v in (near, alike)), strict=True):
                pairs[j] = own[found]
        at, of, score = [], [], []
        matcher = SequenceMatcher(None)
        for j, (y, near) in enumerate(zip(ys, pairs, strict=True)):
            near = near.tolist()
            if near and len(y) >= POPULAR:
                masks: dict[str, int] = {}
                for k, c in enumerate(y):
                    masks[c] = masks.get(c, 0) | 1 << k
                near = [i for i in near if 2 * _common(masks, len(y), xs[i]) >= t * (len(xs[i]) + len(y)) - _EPS]
            if near:
                matcher.set_seq2(y)
            for i in near:
                matcher.set_seq1(xs[i])
                ratio = matcher.ratio()
                if ratio >= t:
                    at.append(i)
                    of.append(j)
                    score.append(ratio)
        take = lambda c, n: c.take(pa.array(n, pa.int64()))
        return pa.table({"a": take(asked.column("a"), at), "b": take(rows.column("b"), of), "score": pa.array(score, pa.float64())})

    rows, asked = similarity.in_groups(right, left, TEXTS)
    keys = ["__shard", "__block"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, f"a {left.schema['a'].dataType.simpleString()}, b {right.schema['b'].dataType.simpleString()}, score double")


def similar_pairs(left: DataFrame, right: DataFrame, t: float = 0.7, blocks: bool = True) -> DataFrame:
    """a, b, score of texts (id, text on both sides) whose word overlap or, with `blocks`, ratio of matching blocks is t or more.

    Texts are compared in lower case. Two empty texts have no words in common but match in all blocks.
    """
    words = lambda df, k: df.select(F.col("id").alias(k), similarity.words(F.col("text")).alias("tokens"))
    scored = candidates(words(left, "a"), words(right, "b"), t).select("a", "b", F.col("similarity").alias("score"))
    if not blocks:
        return scored
    x, y = left.select(F.col("id").alias("a"), F.lower("text").alias("x")), right.select(F.col("id").alias("b"), F.lower("text").alias("y"))
    empty = x.filter("x = ''").join(y.filter("y = ''"), F.lit(True)).select("a", "b", F.lit(1.0).alias("score"))  # one class each
    matched = alike_in_blocks(x, y, t)
    return scored.unionAll(matched).unionAll(empty).groupBy("a", "b").agg(F.max("score").alias("score"))


def similar_usages(questions: DataFrame, memories: DataFrame, t: float = 0.7, limit: int = 10, blocks: bool = True, same: str | None = None) -> DataFrame:
    """question_id, memory_id, score, rank: the best `limit` memories (memory_id, text) of every question (question_id, text).

    Scores are rounded to 6 places; ties go by memory_id. Null texts count as empty. With `same`, a column of both, only memories with an
    equal value are taken (a tool's name), nulls being no value. Texts of one class are told apart again at the end, and only `limit` of each.
    """
    group = F.col(same).cast("string") if same else F.lit("")
    clean = lambda df, k: df.select(F.col(k), group.alias("__of"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("__of IS NOT NULL").withColumn("id", F.sha2(F.lower("text"), 256))
    # Classes have short numbers, stored, since they go with every token.
    classes = lambda df, name: written(df.groupBy("id").agg(F.min("text").alias("text")).select(F.monotonically_increasing_id().alias("n"), "id", "text"), name)
    asked, held = written(clean(questions, "question_id"), "questions"), written(clean(memories, "memory_id"), "memories")
    asked_classes, held_classes = classes(asked, "question-classes"), classes(held, "memory-classes")
    numbered = lambda df, of: df.drop("text").join(of.select("n", "id"), "id").drop("id").withColumnRenamed("n", "id")
    asked, held = numbered(asked, asked_classes), numbered(held, held_classes)
    texts = lambda of: of.select(F.col("n").alias("id"), "text")
    pairs = similar_pairs(texts(asked_classes), texts(held_classes), t, blocks).withColumn("score", F.round("score", 6))
    # Of a class only the first members can be among the best.
    place = F.row_number().over(W.partitionBy("id", "__of").orderBy("memory_id"))
    members = held.select("memory_id", "__of", "id").withColumn("place", place).filter(F.col("place") <= limit).drop("place")
    per_class = pairs.join(members.withColumnRenamed("id", "b"), "b")
    best = W.partitionBy("a", "__of").orderBy(F.desc("score"), "memory_id")
    per_class = per_class.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    return asked.select("question_id", "__of", F.col("id").alias("a")).join(per_class, ["a", "__of"]).select("question_id", "memory_id", "score", "rank")
