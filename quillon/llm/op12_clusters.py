"""Centroid clustering with Hamerly's bounds, in whole numbers.

Every vector keeps one upper bound (of the distance to its centroid) and one lower bound (to the second nearest). After each
round the bounds are loosened by the centroids' drift; only a vector whose upper bound reaches its lower one, or half the way to
the next centroid, is scanned against all centroids. Scans are exact; bounds are rounded outwards, so a skipped vector could not
have changed, ties included.

Vectors are stored once, bounds once a round, both bucketed by row number: a round joins them without a shuffle. Sums follow by the
vectors that moved. The driver holds k centroids and their sums.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize, partitions, shared_dir, table

CLUSTERS, ROUNDS, SCALE, DIMENSIONS, SEED = 8, 10, 1024, 64, "3"
#: Whole numbers beyond this are refused: squared distances of 64 of them would not fit a long.
LARGEST = 1 << 27
#: Rows of a bucket, and of a scan.
BUCKET, SCAN = 250_000, 4_096
#: Room for rounding in bounds.
SLACK = 1e-9


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, int64. Products of floats below 2^53 are exact, and fast."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= 1 << 21:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


class Round:
    """Centroids of a round and how far they came since the round before."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None) -> None:
        self.centroids = np.array(centroids, np.int64)
        k = len(centroids)
        drift = np.zeros(k) if before is None else np.sqrt(((self.centroids - np.array(before, np.int64)) ** 2).sum(1).astype(np.float64))
        self.drift = drift * (1 + SLACK) + SLACK
        #: The largest drift of any other centroid.
        self.others = np.array([max([0.0, *np.delete(self.drift, j)]) for j in range(k)])
        apart = np.sqrt(distances(self.centroids, self.centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 * (1 - SLACK) - SLACK

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster is -1 where no bounds are known. Returns the new clusters and bounds."""
        known = cluster >= 0
        upper = np.where(known, (upper + self.drift[cluster]) * (1 + SLACK), np.inf)
        lower = np.where(known, (lower - self.others[cluster]) * (1 - SLACK) - SLACK, -np.inf)
        cluster = cluster.copy()
        unsure = np.flatnonzero(~(upper < np.maximum(lower, np.where(known, self.half[cluster], -np.inf))))
        for i in range(0, len(unsure), SCAN):
            at = unsure[i : i + SCAN]
            d = distances(x[at], self.centroids)
            cluster[at] = d.argmin(1)
            near = np.sqrt(np.sort(d, 1)[:, :2].astype(np.float64))
            upper[at] = near[:, 0] * (1 + SLACK) + SLACK
            lower[at] = near[:, 1] * (1 - SLACK) - SLACK if near.shape[1] > 1 else np.inf
        return cluster, upper, lower


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int, scale: int) -> DataFrame:
    """vec_id, x array<int>: floor(scale * component) of vectors of the right size without null, NaN or infinite components."""
    e = F.col("e")
    ok = e.isNotNull() & (F.size(e) == dimensions) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).filter(ok)
    far = F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}: its squared distance may not fit a long"))
    return kept.select("vec_id", F.transform(e, lambda v: F.when(F.abs(v * scale) > LARGEST, far).otherwise(F.floor(v * scale))).cast("array<int>").alias("x"))


class Bucketed:
    """A table of n buckets by rid in the shared folder."""

    def __init__(self, df: DataFrame, n: int) -> None:
        self.spark, self.name = df.sparkSession, f"clusters_{uuid.uuid4().hex}"
        df.write.bucketBy(n, "rid").option("path", f"{shared_dir(self.spark)}/{self.name}").option("compression", "zstd").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        discard(self.rows)
        self.spark.sql(f"DROP TABLE {self.name}")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _round(now: Round, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with new bounds, and for every cluster of a task one row with what joined and left it (n not null, in a bucket of the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now.centroids)
        n, sums, rid = np.zeros(k, np.int64), np.zeros((k, width), np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), width)
            old = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, upper, lower = now.assign(x, old, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("upper", "lower")))
            for j in range(k):
                came, left = (cluster == j) & (old != j), (cluster != j) & (old == j)
                n[j] += came.sum() - left.sum()
                sums[j] += x[came].sum(0) - x[left].sum(0)
            rid = b.column("rid")[0].as_py()
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], schema=out)
        if rid is not None:
            moved = [j for j in range(k) if n[j] or sums[j].any()]
            yield pa.RecordBatch.from_pydict({"rid": [rid] * len(moved), "cluster": moved, "upper": [None] * len(moved), "lower": [None] * len(moved), "n": n[moved].tolist(), "sums": sums[moved].tolist()}, out)

    out = pa.schema([("rid", pa.int64()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    return run


def _final(now: Round, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """vec_id, cluster and exact squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), width)
            cluster, _, _ = now.assign(x, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("upper", "lower")))
            d = ((x - now.centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another size or with null, NaN or infinite components are left out; one with a component beyond 2^27 / scale raises an
    error, since distances would not fit. The first centroids are the k vectors of smallest sha256(`seed:vec_id`), in that order (a null id
    counts as empty; equal ids go by components); fewer vectors make fewer centroids, none give no rows. Repeated rows are vectors of
    their own. Ties go to the smaller number, clusters that lose all vectors keep their centroid. Sums beyond a long are given as the
    largest long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    n = max(partitions(spark), -(-vectors.count() // BUCKET))
    given = whole_numbers(vectors, vec_id, embedding, dimensions, scale)
    stored = Bucketed(given.withColumn("rid", F.monotonically_increasing_id()).repartition(n, "rid"), n)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r.x for r in stored.rows.select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()]
    kind = given.schema["vec_id"].dataType
    if not first:
        stored.drop()
        return spark.createDataFrame([], f"vec_id {kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, before, bounds = first, None, None
    counts, sums = [0] * len(first), [[0] * dimensions for _ in first]

    def known() -> DataFrame:
        if bounds is None:
            return stored.rows.select("rid", "vec_id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
        return stored.rows.join(bounds.rows.filter("n IS NULL").select("rid", "cluster", "upper", "lower").hint("shuffle_hash"), "rid")

    for _ in range(rounds):
        now = Round(centroids, before)
        moved = known().select("rid", "x", "cluster", "upper", "lower").mapInArrow(_round(now, dimensions), "rid long, cluster int, upper double, lower double, n long, sums array<long>")
        old, bounds = bounds, Bucketed(moved, n)
        if old:
            old.drop()
        change = bounds.rows.filter("n IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)])
        for r in change.collect():
            counts[r.cluster] += int(r.n)
            sums[r.cluster] = [s + int(r[f"s{i}"]) for i, s in enumerate(sums[r.cluster])]
        before, centroids = centroids, [[s // c for s in row] if c else old_row for row, c, old_row in zip(sums, counts, centroids, strict=True)]
    done = materialize(known().mapInArrow(_final(Round(centroids, before), dimensions), f"vec_id {kind.simpleString()}, cluster int, distance long"), "clusters")
    for t in (stored, bounds):
        if t:
            t.drop()
    largest = (1 << 63) - 1
    inertia = {r.cluster: int(r.d) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = [(j, min(d, largest), min(sum(inertia.values()), largest), digests[j]) for j, d in inertia.items()]
    return done.join(F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector of `embeddings` with its cluster after ten rounds over eight centroids."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    parts = [
        f"""k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: coalesce(isfinite(v), false))) = {DIMENSIONS}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM k ORDER BY h, x LIMIT {CLUSTERS})
)""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, min(d) AS d FROM (SELECT row_number() OVER () AS i, * FROM k), LATERAL (SELECT [CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), j] AS d FROM c{r}) GROUP BY i, vec_id, x)")
        if r < ROUNDS:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT j, list(v ORDER BY p) AS m FROM (
      SELECT d[2] AS j, p, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM (SELECT d, unnest(x) AS v, unnest(range(len(x))) AS p FROM a{r}) GROUP BY ALL
    ) GROUP BY j
  ) USING (j)
)"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d[1] AS distance, CAST(sum(d[1]) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d[1]) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON d[2] = j
"""


ORACLE = _oracle()
