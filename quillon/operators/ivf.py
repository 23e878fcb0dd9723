"""Index of vectors by cells: coarse centroids from a bounded sample, every vector assigned, cells pruned by the triangle inequality.

A vector at distance r of its centroid lies at least |d(q, centroid) - r| from a query q. In exact mode a query first searches its
nearest cells, which gives a distance that k vectors do not exceed, and then every cell and vector that the bound cannot rule out. In
probing mode only the nearest cells are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import similarity
from quillon.sources.stored import new_path, written

#: The sample that centroids are fitted on, the number of cells and of rounds. Every vector is indexed.
SAMPLE, CELLS, ROUNDS = 20_000, 32, 12
#: Vectors of a cell that one task searches.
PART = 4_000
#: Queries that a part of a cell meets at once.
BLOCK = 8_000
#: Values are ranked by 6 places, so bounds leave as much room.
_ROOM = 1e-5


def fit(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from vectors spread over the sample; empty cells keep their centroid."""
    distinct = np.unique(sample, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(cells, len(distinct))).astype(int)] if len(distinct) else distinct
    for _ in range(rounds if len(centroids) else 0):
        near = _distances(sample, centroids).argmin(1)
        for j in np.unique(near):
            centroids[j] = sample[near == j].mean(0)
    return centroids


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one size as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1 if len(column) else 0)


def _unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(similarity.dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


@dataclass(frozen=True)
class Ivf:
    """A stored index: its vectors by cell, and the centroids. measure: l2 or cosine (distances of unit vectors)."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    measure: str = "l2"

    @property
    def vectors(self) -> DataFrame:
        """id, v, raw, cell, part, r (distance to the centroid); folders are cells."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    def _point(self, queries: DataFrame) -> DataFrame:
        """query_id, raw, v, cell, d: every query beside every centroid, k rows a query."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _matrix(b.column("v"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(_distances(v, centroids)), pa.list_(pa.float64()))], names=[*b.schema.names, "ds"])

        given = queries.select("query_id", F.col("q").alias("raw"), F.col("q").cast("array<double>").alias("v"))
        given = given.withColumn("v", _unit(F.col("v"))) if self.measure == "cosine" else given
        kind = given.schema["query_id"].dataType.simpleString()
        near = given.mapInArrow(run, f"query_id {kind}, raw {given.schema['raw'].dataType.simpleString()}, v array<double>, ds array<double>")
        return near.select("query_id", "raw", "v", F.posexplode("ds").alias("cell", "d"))

    def _search(self, probes: DataFrame, k: int) -> DataFrame:
        """The k best of the probed cells: query_id, id, value, rank. A probe carries `reach`, beyond which nothing is wanted.

        A part of a cell meets its probes in blocks of about BLOCK, so that a group is bounded on both sides.
        """
        blocks = max(1, -(-probes.select("query_id").distinct().count() // BLOCK))
        parts = self.spark.read.parquet(f"{self.path}/cells").select("cell", "parts")
        asked = probes.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = asked.select("query_id", F.col("raw").alias("q"), "cell", "part", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "d", "reach")
        rows = self.vectors.select("id", F.col("raw").alias("v"), "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "r")
        return similarity.ranked(similarity.best_of_groups(rows, asked, ["cell", "part", "block"], self.measure, k), self.measure, k, "id")

    def probe(self, queries: DataFrame, k: int = 10, cells: int = 4) -> DataFrame:
        """query_id, id, value, rank among the vectors of the `cells` nearest cells. queries: query_id (unique), q."""
        return self._search(self._nearest_cells(self._point(queries), cells).withColumn("reach", F.lit(float("inf"))), k)

    def search(self, queries: DataFrame, k: int = 10, cells: int = 2) -> DataFrame:
        """The same over all vectors, exactly: cells and vectors are left out only where the triangle inequality allows it."""
        points = written(self._point(queries), "ivf-points")
        first = self._search(self._nearest_cells(points, cells).withColumn("reach", F.lit(float("inf"))), k)
        # The k-th value found is a distance that k vectors keep; with fewer, there is no bound yet.
        worst = F.max("value") if self.measure == "l2" else F.min("value")
        found = first.groupBy("query_id").agg(F.count("value").alias("n"), worst.alias("worst"))
        far = F.col("worst") if self.measure == "l2" else F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("worst") - _ROOM)))
        bound = found.select("query_id", F.when(F.col("n") == k, far * (1 + _ROOM) + _ROOM).alias("bound"))
        radius = F.broadcast(self.spark.read.parquet(f"{self.path}/cells").select("cell", "nearest", "radius"))
        reach = points.join(bound, "query_id", "left").join(radius, "cell").withColumn("reach", F.coalesce("bound", F.lit(float("inf"))))
        # Vectors of a cell lie between `nearest` and `radius` from its centroid.
        open_cells = reach.filter((F.col("d") - F.col("radius") <= F.col("reach")) & (F.col("nearest") - F.col("d") <= F.col("reach")))
        return self._search(open_cells.select("query_id", "raw", "cell", "d", "reach"), k)

    def _nearest_cells(self, points: DataFrame, cells: int) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy("d", "cell"))
        return points.withColumn("place", place).filter(F.col("place") <= cells).select("query_id", "raw", "cell", "d")

    def recall(self, queries: DataFrame, k: int = 10, cells: int = 4) -> float:
        """Share of the exact k best that probing finds."""
        exact, found = self.search(queries, k).select("query_id", "id"), self.probe(queries, k, cells).select("query_id", "id")
        row = exact.agg(F.count("*").alias("n")).crossJoin(exact.join(found, ["query_id", "id"], "left_semi").agg(F.count("*").alias("hit"))).first()  # one row each
        return row["hit"] / row["n"] if row["n"] else 1.0


def build(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", measure: str = "l2", cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> Ivf:
    """Index every row that has a vector. Centroids are fitted on the `sample` rows of smallest hash of their id, in one task.

    Vectors must have one size and finite components. A cell of many vectors is cut into parts of about PART, so that no task gets it whole.
    """
    if measure not in ("l2", "cosine"):
        raise ValueError("measure must be l2 or cosine")
    spark = vectors.sparkSession
    path = path or new_path(spark, "ivf")
    given = vectors.filter(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector).alias("raw"), F.col(vector).cast("array<double>").alias("v"))
    given = given.withColumn("v", _unit(F.col("v"))) if measure == "cosine" else given
    chosen = given.select("v").orderBy(F.xxhash64("id"), "id").limit(sample)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in b.column("v").to_pylist()]
        yield pa.RecordBatch.from_pydict({"c": [c.tolist() for c in fit(np.array(rows, float), cells, rounds)]}, pa.schema([("c", pa.list_(pa.float64()))]))

    centroids = np.array([r.c for r in chosen.coalesce(1).mapInArrow(train, "c array<double>").collect()], float)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_matrix(b.column("v")), centroids)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=[*b.schema.names, "cell", "r"])

    kind = {n: given.schema[n].dataType.simpleString() for n in ("id", "raw")}
    placed = given.mapInArrow(assign, f"id {kind['id']}, raw {kind['raw']}, v array<double>, cell int, r double").drop("v")
    placed = written(placed, "ivf-placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("nearest"), F.max("r").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    sizes.write.mode("overwrite").parquet(f"{path}/cells")
    parts = F.broadcast(spark.read.parquet(f"{path}/cells").select("cell", "parts"))  # a row a cell
    cut = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int")).drop("parts")
    cut.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    return Ivf(spark, path, centroids, measure)
