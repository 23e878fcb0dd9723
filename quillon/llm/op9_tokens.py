"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The model: the pieces of a public vocabulary, with probabilities estimated here from how often each piece occurs when the
vocabulary's own tokenizer splits the corpus' pre-tokens, counted with their frequencies over all documents. Pre-tokens are
visited in sorted order, which is the preorder of their trie; a stack holds the forward scores of the current path, so the
scores of a shared prefix are computed once. A terminal's count is the length of its best segmentation. Terminals of
frequent pre-tokens are solved once and stored in a table of bounded size that all tasks use; the others are solved where
they occur. Documents then add up their terminals' counts beside the scan.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table
from quillon.llm.words import bounded

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts are taken together up to so many bytes, which bounds the trie.
BATCH_BYTES = 4_000_000
#: Distinct pre-tokens that a task counts before it sends them; pre-tokens that it solves before it forgets them.
COUNTED, SOLVED = 200_000, 600_000
#: Frequent pre-tokens whose counts are stored and sent to all tasks, at most (about 20 bytes each).
STORED = 200_000
SPACE = "▁"


@dataclass
class Model:
    #: Piece -> log probability.
    pieces: dict[str, float]
    #: Stored terminals: pre-token (string), n (its frequency), tokens; in the order of the trie.
    terminals: DataFrame


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n for the texts in the first column; a word comes again when COUNTED others were sent before."""

    def sent(n: Counter) -> Iterator[pa.RecordBatch]:
        words, times = list(n), list(n.values())
        n.clear()
        for at in range(0, len(words), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words[at : at + 10_000]]), pa.array(times[at : at + 10_000], pa.int64())], names=["word", "n"])

    n: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            n.update((t.as_py() or "").encode().split())
            if len(n) >= COUNTED:
                yield from sent(n)
    yield from sent(n)


def pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: the distinct pre-tokens of all texts and how often each occurs."""

    return docs.select(text).mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> Model:
    """Piece probabilities from the whole corpus, and the stored terminals.

    Counts are smoothed by half an occurrence, so pieces that never occur stay possible. `vocabulary` must be readable at this path on
    the driver and on every executor. Null and empty texts teach nothing; from an empty table all pieces are equally likely.
    """
    words = materialize(pre_tokens(docs, text), "pre-tokens")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        for b in batches:
            found = sp.encode(b.column(0).to_pylist(), num_threads=1)
            ids = np.fromiter((i for f in found for i in f), np.int64)
            times = np.bincount(ids, np.repeat(b.column(1).to_numpy(), list(map(len, found))).astype(float)) if len(ids) else np.empty(0)
            used = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(times[used].astype(np.int64))], names=["piece", "n"])

    # A row a piece comes to the driver, as the model itself does.
    counts = dict(words.mapInArrow(split, "piece long, n long").groupBy("piece").agg(F.sum("n")).collect())
    names = load_pieces(vocabulary)
    total = sum(counts.get(i, 0) + 0.5 for i in names)
    pieces = {p: math.log((counts.get(i, 0) + 0.5) / total) for i, p in names.items()}
    # The smallest power of two of which at most STORED pre-tokens have that frequency.
    sizes = sorted(words.groupBy(F.floor(F.log2("n")).alias("k")).count().collect(), key=lambda r: -r["k"])
    least, held = None, 0
    for r in sizes:
        held += r["count"]
        if held > STORED:
            break
        least = 2 ** r["k"]
    frequent = words.filter(F.col("n") >= F.lit(least)) if least else words.limit(0)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = trie_counts({w.encode() for w in b.column(0).to_pylist()}, pieces)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([found[w.encode()] for w in b.column(0).to_pylist()], pa.int64())], names=["word", "n", "tokens"])

    return Model(pieces, materialize(frequent.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(solve, "word string, n long, tokens long"), "terminals"))


def load_pieces(path: str = VOCABULARY) -> dict[int, str]:
    """Id -> piece of a public vocabulary, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {i: sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


def trie_counts(words: set[bytes], pieces: dict[str, float]) -> dict[bytes, int]:
    """Tokens in the best segmentation of each pre-token; ties go to fewer tokens.

    A character that is no piece falls back to its UTF-8 bytes, each below every piece's probability.
    """
    longest = max(map(len, pieces), default=1)
    fallback = min(pieces.values(), default=0.0) - 10.0
    keys = sorted((SPACE + w.decode("utf-8", "replace"), w) for w in words)
    path, score, count, out = "", [0.0], [0], {}
    get = pieces.get
    for word, raw in keys:
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            width = len(word[end - 1].encode("utf-8", "replace"))
            best, tokens = score[end - 1] + width * fallback, count[end - 1] + width
            for begin in range(max(0, end - longest), end):
                p = get(word[begin:end])
                if p is not None:
                    s, n = score[begin] + p, count[begin] + 1
                    if s > best or s == best and n < tokens:
                        best, tokens = s, n
            score.append(best)
            count.append(tokens)
        path = word
        out[raw] = count[-1]
    return out


class Solved(dict):
    """Token counts of pre-tokens: the stored ones, and those that this task solves, forgotten when there are too many."""

    def __init__(self, stored: dict[bytes, int], pieces: dict[str, float]):
        super().__init__(stored)
        self.stored, self.pieces = stored, pieces

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self)
        if len(self) + len(new) > len(self.stored) + SOLVED:
            self.clear()
            self.update(self.stored)
            new = words.difference(self)
        self.update(trie_counts(new, self.pieces))

    def totals(self, batches: Iterator[pa.RecordBatch], doc_id: str, text: str) -> Iterator[pa.RecordBatch]:
        """doc_id, n_words, n_tokens. Texts are split twice, so that no more than the distinct pre-tokens of BATCH_BYTES are held."""
        for part in bounded(batches, text, BATCH_BYTES):
            new: set[bytes] = set()
            for t in part.column(text):
                new.update((t.as_py() or "").encode().split())
            self.learn(new)
            n_words, totals = [], []
            for t in part.column(text):
                words = (t.as_py() or "").encode().split()
                n_words.append(len(words))
                totals.append(sum(map(self.__getitem__, words)))
            out = pa.table({"doc_id": part.column(doc_id).cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_tokens": pa.array(totals, pa.int64())})
            yield from out.combine_chunks().to_batches()


def count_tokens(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words (pre-tokens), n_tokens, one row per input row.

    A null or empty text, or one of white space only, has zero of both. Repeated rows and ids are counted alike,
    other columns are ignored, an empty table gives no rows. Ids are whole numbers. White space between pre-tokens is part of the next one.
    """
    spark = docs.sparkSession
    # At most STORED rows.
    stored = spark.sparkContext.broadcast(({r["word"].encode(): r["tokens"] for r in model.terminals.select("word", "tokens").toLocalIterator()}, model.pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Solved(*stored.value).totals(batches, doc_id, text)

    return docs.select(*dict.fromkeys([doc_id, text])).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of `documents` with its number of tokens, by probabilities counted on all of them."""
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, fit(docs))
