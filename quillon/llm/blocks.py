"""Documents in blocks, and exchanges between blocks and key ranges.

A corpus-wide question about word sequences is asked once per block: the block sends each distinct key (a 64-bit
hash, or ids) to the key's range, the range answers over all blocks, and the answers come back to the block. Spark
shuffles both ways; keys travel as packed arrays, so a hot key is one entry per block however often it occurs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, partitions
from quillon.llm.words import BLOCK_BYTES, Hashes

#: Rows that travel: `home` is a block or a key range, `peer` the other side.
ROWS = "home long, peer long, data binary"


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight stand together."""
    import zstandard

    head = json.dumps({k: [a.dtype.str, len(a)] for k, a in arrays.items()}).encode()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays.values())
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, {}
    for k, (kind, size) in json.loads(raw[4:at]).items():
        dtype = np.dtype(kind)
        end = at + size * dtype.itemsize
        out[k] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, end - at, at).reshape(dtype.itemsize, size).T).view(dtype).reshape(size)
        at = end
    return out


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches(max_chunksize=None)[0]


def make_blocks(docs: DataFrame, text: str, doc_id: str, name: str) -> DataFrame:
    """A table (home: block number, peer: -1, data: the documents with all their columns, by id, null last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.take(pa.compute.sort_indices(t, sort_keys=[(doc_id, "ascending")], null_placement="at_end"))
            return pa.RecordBatch.from_arrays([pa.array([base + count]), pa.array([-1]), pa.array([to_ipc(t.combine_chunks().to_batches(max_chunksize=None)[0])], pa.binary())], names=["home", "peer", "data"])

        import pyarrow.compute  # noqa: F401

        for b in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
            part = (np.cumsum(lengths) + size) // BLOCK_BYTES
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                piece = b.slice(rows[0], len(rows))
                if size + int(lengths[rows].sum()) > BLOCK_BYTES and held:
                    yield close()
                    count, held, size = count + 1, [], 0
                held.append(piece)
                size += int(lengths[rows].sum())
        if held:
            yield close()

    return materialize(docs.mapInArrow(run, ROWS), name)


def by_group(rows: DataFrame, run: Callable[[int, list[tuple[int, bytes]]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Call `run(home, [(peer, data), ...])` once for every home, over rows that are sorted by home and peer."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held = None, []
        for b in batches:
            for h, p, d in zip(b.column(0), b.column(1), b.column(2), strict=True):
                if h.as_py() != home:
                    if held:
                        yield from run(home, held)
                    home, held = h.as_py(), []
                held.append((p.as_py(), d.as_py()))
        if held:
            yield from run(home, held)

    return rows.sortWithinPartitions("home", "peer").mapInArrow(each, schema)


def at_ranges(rows: DataFrame, run: Callable, schema: str = ROWS) -> DataFrame:
    """`run` for every key range; ranges are numbered below the session's number of shuffle partitions."""
    return by_group(rows.repartitionById(partitions(rows.sparkSession), F.col("home").cast("int")), run, schema)


def at_blocks(rows: DataFrame, run: Callable, schema: str = ROWS) -> DataFrame:
    """`run` for every block; the block itself has peer -1 and so comes first."""
    return by_group(rows.repartition(partitions(rows.sparkSession), "home"), run, schema)


def deal(key: np.ndarray, ranges: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the keys by range, and the slice of every range that has some. Keys of one range keep their order."""
    own = ((key >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    cut = np.flatnonzero(np.diff(own[order])) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
    return order, [(int(own[order[b]]), slice(int(b), int(e))) for b, e in zip(begin, end, strict=True) if e > b]


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["home", "peer", "data"])


class Words:
    """The words of a block's documents: XXH64 of each in one array, each document's place in `edge`."""

    def __init__(self, texts: Iterable[bytes]):
        memo, parts, edge = Hashes(), [], [0]
        for t in texts:
            parts.append(memo.of(t.split()))
            edge.append(edge[-1] + len(parts[-1]))
        self.hash = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.edge = np.array(edge)
        self.size = np.diff(self.edge)
