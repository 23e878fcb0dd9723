"""Words of a text as numbers, and runs of documents of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a block, unless one document has more.
BLOCK_BYTES = 12_000_000
#: Distinct words that a memo holds before it starts anew.
MEMO = 1_000_000
_STEP = np.uint64(0xD1342543DE82EF95)


class Codes(dict):
    """A number for each new word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Hashes(dict):
    """XXH64 of words, computed once for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` entries from each place on; as many as there are such places."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for i in range(1, size):
        acc *= _STEP
        acc += h[i : i + n]
    return mix64(acc)


def bounded(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows in their order, as tables of at most `limit` bytes of text each, or of one row."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        begin = 0
        for i, n in enumerate(lengths):
            if size + n > limit and (held or i > begin):
                if i > begin:
                    held.append(b.slice(begin, i - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, i
            size += n
        if begin < b.num_rows:
            held.append(b.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for every range, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)
