"""Facts stored in buckets by order key, so that orders and their items join without a shuffle.

The buckets are written once, with one shuffle of each fact. Tables live in the folder in spark.checkpoint.dir and in the session's catalog.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.stored import shared_dir
from quillon.sources.tables import Star, load

#: Fact -> the key that its buckets are dealt and sorted by.
FACTS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
#: Rows of a bucket of the largest fact, about.
ROWS = 4_000_000


@dataclass(frozen=True)
class BucketedStar(Star):
    """The star over stored facts; other tables are read where they are."""

    names: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name]) if name in self.names else super().table(name)

    def drop(self) -> None:
        """Forget the tables; their files stay in the shared folder."""
        for t in self.names.values():
            self.spark.sql(f"DROP TABLE {t}")


def store(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> BucketedStar:
    """Write the facts in equally many buckets; as many as make about 4,000,000 rows each, and no fewer than shuffle partitions."""
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), *[-(-load(spark, sf_dir, t).count() // ROWS) for t in FACTS])
    names, token = {}, uuid.uuid4().hex
    for t, key in FACTS.items():
        names[t] = f"quillon_{t}_{token}"
        # Dealt as the buckets are, so that each bucket is one file.
        load(spark, sf_dir, t).repartition(n, F.col(key)).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_dir(spark)}/{names[t]}").saveAsTable(names[t])
    return BucketedStar(spark, sf_dir, names)
