"""Near-duplicate detection: SimHash fingerprints linked under a generalised pigeonhole filter.

Bits that agree together over all fingerprints are grouped into one partition; a dynamic program gives each
partition its own threshold (-1 skips it) from candidate counts over all fingerprints, such that every pair
within the radius meets some partition's threshold. Signatures under those thresholds are probed and every
candidate is verified on all bits. Only distinct fingerprints are linked, and a probed group yields a spanning
forest of its links, so a group of any size yields fewer links than members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table
from quillon.llm.components import connected_components

BITS = 64
SHINGLE, SEED = 3, 42
RADIUS = 2
#: Probed groups above so many distinct fingerprints are dealt out again by the bits outside their signature.
LARGE_GROUP = 20_000
#: Cost of one signature row, in verified pairs.
SIGNATURE_COST = 40.0


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority vote of the XXH64 of word shingles, repeats included; a bit is 1 if set in over half of them.
    Fewer words than a shingle: the whole sequence is the one shingle. No words: zero. A-Z are lower-cased."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        h = np.array([digest(joined[b:e], SEED) for b, e in zip(begins[at : min(n, at + 65_536)].tolist(), last[at : at + 65_536].tolist(), strict=False)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the `keep` columns, fp (the 64 bits as a signed long), one row per input row."""
    cols, kept = list(dict.fromkeys([doc_id, text, *keep])), list(dict.fromkeys([doc_id, *keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint((t.as_py() or "").encode(), shingle) for t in b.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(fp)], names=[*kept, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", fp long"
    return docs.select(*cols).mapInArrow(run, schema)


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, in how many both are set: sums over all rows, 64 x 64 numbers to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(x), 100_000):
                total += x[at : at + 100_000].T @ x[at : at + 100_000]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["cell", "n"])

    cells = dict(fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    return cells.get(BITS * BITS, 0), np.array([cells.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Equal partitions of the bits, each grown from the least even free bit by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(var, var))
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        own = [max(free, key=lambda b: (abs(p[b] - 0.5), -b))]
        free.remove(own[0])
        while len(own) < width:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def allocate(costs: list[dict[int, float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1, one a partition, with sum(t_i + 1) = radius + 1 and the least total cost."""
    table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, ts) in table_.items():
            for t, cost in c.items():
                if used + t + 1 <= radius + 1 and (used + t + 1 not in step or total + cost < step[used + t + 1][0]):
                    step[used + t + 1] = (total + cost, [*ts, t])
        table_ = step
    return table_.get(radius + 1, (float("inf"), []))


def plan_signatures(fps: DataFrame, radius: int = RADIUS) -> list[int]:
    """Bit masks such that every pair within the radius agrees on the bits of at least one mask."""
    n, both = bit_moments(fps)
    layouts = {m: group_bits(n, both, m) for m in range(2, radius + 3)}
    keys = [(m, i, mask_of(bits)) for m, parts in layouts.items() for i, bits in enumerate(parts)]
    probe = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for k, (_, _, mask) in enumerate(keys)])).alias("s")
    same = fps.select(probe).groupBy("s.k", "s.v").count().groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    pairs = {keys[r["k"]][:2]: r["pairs"] for r in same.collect()}
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[int]] = (float("inf"), [])
    for m, parts in layouts.items():
        costs = []
        for i, bits in enumerate(parts):
            exact = pairs.get((m, i), 0.0)
            costs.append({-1: 0.0, 0: n * SIGNATURE_COST + exact, 1: n * SIGNATURE_COST * len(bits) + sum(exact / agree[b] for b in bits)})
        total, ts = allocate(costs, radius)
        if total < best[0]:
            masks = [mask_of(bits) for bits, t in zip(parts, ts, strict=True) if t == 0]
            masks += [mask_of([b for b in bits if b != out]) for bits, t in zip(parts, ts, strict=True) if t == 1 for out in bits]
            best = (total, masks)
    return best[1]


def _labels(adjacent: np.ndarray) -> np.ndarray:
    n = len(adjacent)
    label = np.arange(n)
    while True:
        low = np.where(adjacent, label[None, :], n).min(1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def link_group(fps: np.ndarray, radius: int, out: list[np.ndarray]) -> None:
    """Append (member, earlier member) rows that connect exactly what pairs within the radius connect. fps: distinct, sorted int64."""
    n = len(fps)
    if n < 2:
        return
    if n == 2:
        if int(np.bitwise_count(fps[:1].view(np.uint64) ^ fps[1:].view(np.uint64))[0]) <= radius:
            out.append(fps[None, ::-1])
        return
    u = fps.view(np.uint64)
    if n <= 1_200:
        label = _labels(np.bitwise_count(u[:, None] ^ u[None, :]) <= radius)
        child = label != np.arange(n)
        out.append(np.stack([fps[child], fps[label[child]]], 1))
        return
    varying = np.bitwise_or.reduce(u ^ u[0])
    bits = [b for b in range(BITS) if int(varying) >> b & 1]
    if len(bits) <= radius:
        out.append(np.stack([fps[1:], np.full(n - 1, fps[0])], 1))
        return
    # radius + 1 parts of the bits that still vary: a close pair agrees on one of them.
    for k in range(radius + 1):
        part = u & np.uint64(sum(1 << b for b in bits[k :: radius + 1]))
        order = np.argsort(part, kind="stable")
        for run in np.split(fps[order], np.flatnonzero(np.diff(part[order])) + 1):
            link_group(np.sort(run), radius, out)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: distinct fingerprints (fp long). -> (u, v): a forest that connects exactly what pairs within the radius connect."""
    masks = plan_signatures(fps, radius)
    if not masks:
        return fps.sparkSession.createDataFrame([], "u long, v long")
    key = lambda ms: F.explode(F.array(*[F.struct(F.lit(k).alias("sid"), F.col("fp").bitwiseAND(F.lit(m)).alias("val")) for k, m in enumerate(ms)])).alias("s")
    probes = fps.select("fp", key(masks)).select("fp", "s.sid", "s.val")
    # Groups of one have no candidates; large groups are dealt out by the radius + 1 parts of their other bits.
    sizes = probes.groupBy("sid", "val").agg(F.count("*").alias("size")).filter("size > 1")
    probes = probes.join(sizes, ["sid", "val"])
    rest = []
    for m in masks:
        other = [b for b in range(BITS) if not (m >> b) & 1]
        rest.append([mask_of(other[k :: radius + 1]) for k in range(radius + 1)])
    second = F.element_at(F.array(*[F.array(*[F.lit(x) for x in r]) for r in rest]), F.col("sid") + 1)
    sub = F.when(F.col("size") > LARGE_GROUP, F.transform(F.zip_with(second, F.sequence(F.lit(0), F.lit(radius)), lambda m, k: F.struct(m.alias("m"), k.alias("k"))), lambda x: F.struct(x["k"].alias("k"), F.col("fp").bitwiseAND(x["m"]).alias("v")))).otherwise(F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("v"))))
    probes = probes.select("fp", F.col("sid"), F.col("val"), F.explode(sub).alias("x")).select("fp", F.xxhash64("sid", "val", "x.k", "x.v").alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        fp, g = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((fp, g))
        fp, g = fp[order], g[order]
        cut = np.flatnonzero(np.diff(g)) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(g)]))
        two = end - begin == 2
        a, b = fp[begin[two]], fp[begin[two] + 1]
        near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius
        out = [np.stack([b[near], a[near]], 1)]
        for i, j in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist(), strict=True):
            link_group(np.unique(fp[i:j]), radius, out)
        found = np.unique(np.concatenate(out), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return probes.repartition("g").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the `keep` columns, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most `radius` bits.

    One row per input row. A null or empty text, or one of white space only, has fingerprint zero and is linked
    like any other. Repeated rows and ids share a component. Null ids count only where a component has no other.
    An empty table gives no rows; other columns are ignored.
    """
    # Kept columns may have any name while they pass through.
    aside = {c: f"__kept_{i}" for i, c in enumerate(keep)}
    docs = docs.select(F.col(doc_id), F.col(text), *[F.col(c).alias(a) for c, a in aside.items()])
    prints = materialize(fingerprints(docs, doc_id, text, shingle, tuple(aside.values())), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("first_doc")), "classes")
    forest = materialize(connected_components(links(classes.select("fp"), radius)), "components")
    rooted = classes.join(forest, classes["fp"] == forest["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_doc")
    lowest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    kept = [F.col(c).alias({a: k for k, a in aside.items()}.get(c, c)) for c in prints.columns if c != "fp"]
    return prints.join(named, "fp").select(*kept, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of `documents` with its fingerprint and component."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
