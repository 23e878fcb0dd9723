"""Raw releases: CSV files read as text with their place, and all tables of a release published in one step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import quality
from quillon.sources.snapshots import Rejected, Snapshots
from quillon.sources.tables import read_csv

#: New column -> (column of the file, strict conversion or None for trimmed text), as `quality.convert` takes it.
Spec = dict[str, tuple[str, Callable[[Column], Column] | None]]


def raw(spark: SparkSession, path: str) -> DataFrame:
    """A file's rows as text, with `_file` and `_row`: 2 is the first row under the header, as in an editor if no value has line breaks.

    A file that holds quoted line breaks is read by one task, so rows are numbered in its order.
    """
    rows = read_csv(spark, path).withColumns({"_file": F.col("_metadata.file_name"), "__at": F.monotonically_increasing_id()})
    # The first row of each file counts its task's numbers from the header on.
    first = rows.groupBy("_file").agg(F.min("__at").alias("__first"))
    return rows.join(F.broadcast(first), "_file").withColumn("_row", F.col("__at") - F.col("__first") + 2).drop("__at", "__first")  # a row a file


def load_release(target: Snapshots, files: dict[str, tuple[str, Spec]], version: str, parents: dict[str, tuple[str, str]] | None = None) -> int:
    """Convert all files strictly and publish them as one snapshot, which replaces every table of the one before; returns its number.

    files: table -> (path, spec). parents: "table.column" -> (parent table, its column), checked on what was written. A row that cannot be
    read, or a key without a parent, fails the load with its place, and readers keep the release they had.
    """
    frames = {}
    for name, (path, spec) in files.items():
        accepted, rejected = quality.convert(raw(target.spark, path), spec, version)
        quality.require_clean(rejected, name)
        frames[name] = accepted

    def check(written: dict[str, DataFrame]) -> None:
        for child, (parent, key) in (parents or {}).items():
            table, column = child.split(".")
            lost = written[table].filter(F.col(column).isNotNull()).join(written[parent].select(F.col(key).alias(column)), column, "left_anti").agg(F.count("*"), F.min(column)).first()
            if lost[0]:
                raise Rejected(f"{child}: {lost[0]} rows without a row of {parent}, one is {lost[1]}")

    return target.commit(frames, checks=check, replace_all=True)


def numeric_columns(df: DataFrame) -> DataFrame:
    """Text columns whose values are all numbers, as long or double; nothing is taken for a date. One pass over the data."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    as_type = lambda c, t: F.count(F.col(f"`{c}`").try_cast(t))
    seen = df.agg(*[x for i, c in enumerate(text) for x in (F.count(f"`{c}`").alias(f"n{i}"), as_type(c, "long").alias(f"l{i}"), as_type(c, "double").alias(f"d{i}"))]).first() if text else None
    kinds = {c: "long" if seen[f"l{i}"] == seen[f"n{i}"] else "double" if seen[f"d{i}"] == seen[f"n{i}"] else "string" for i, c in enumerate(text) if seen[f"n{i}"]}
    return df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns])


def chart_frame(spark: SparkSession, path: str) -> DataFrame:
    """A result file for charts: numbers as numbers, everything else as text."""
    return numeric_columns(read_csv(spark, path))
