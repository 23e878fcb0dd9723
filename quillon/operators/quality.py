"""Data quality: typed conversion with rejects, referential splits, keys, ranges, and publishing of results."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T


class BadRows(ValueError):
    """Rows that a strict conversion cannot read."""


def convert(df: DataFrame, spec: dict[str, tuple[str, Callable[[Column], Column] | None]], version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) after a typed projection. spec: new name -> (source column, strict conversion or None for trimmed text).

    Conversions return struct(value, bad). Rejected rows keep their source columns and list the bad new columns.
    """
    parts = {n: (conv(F.col(src)) if conv else F.struct(F.trim(F.col(src)).alias("value"), F.lit(False).alias("bad"))) for n, (src, conv) in spec.items()}
    bad = F.filter(F.array(*[F.when(F.coalesce(p["bad"], F.lit(False)), F.lit(n)) for n, p in parts.items()]), lambda x: x.isNotNull())
    judged = df.withColumn("bad_columns", bad)
    extra = [F.lit(version).alias("dataset_version_id")] if version else []
    return judged.filter(F.size("bad_columns") == 0).select(*[p["value"].alias(n) for n, p in parts.items()], *extra), judged.filter(F.size("bad_columns") > 0)


def require_clean(rejected: DataFrame, name: str) -> None:
    """Fail with the number of bad rows and one example: its columns, and its file and row if it comes from `sources.release.raw`."""
    place = [c for c in ("_file", "_row") if c in rejected.columns]
    row = rejected.agg(F.count("*").alias("n"), F.min_by(F.struct("bad_columns", *place), *(["_row"] if place else [F.size("bad_columns")])).alias("example")).first()
    if row["n"]:
        at = f" at {row['example']['_file']} row {row['example']['_row']}" if place else ""
        raise BadRows(f"{name}: {row['n']} rows cannot be read, one{at} in {', '.join(row['example']['bad_columns'])}")


def split_by_parent(child: DataFrame, parent: DataFrame, key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(children whose parent exists, others with rejection_reason)."""
    keys = parent.select(key).distinct()
    return child.join(keys, key, "left_semi"), child.join(keys, key, "left_anti").withColumn("rejection_reason", F.lit(reason))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def multiplicity(df: DataFrame, keys: list[str]) -> int:
    """Largest number of rows of one key; over 1 means that a join multiplied rows. 0 for an empty frame."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: in how many rows each rule is false (null passes), in one pass."""
    counts = df.agg(*[F.count_if(~cond).alias(name) for name, cond in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.inline(pairs))


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows."""
    return reduce(DataFrame.unionByName, [f.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, f in frames.items()])


def publish(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write beside the target and rename when complete, so that readers never see half a result; the old result is replaced.

    A rename that fails raises and leaves the old result in place. A run that died between its renames is repaired first.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target, staging, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", "__staging", "__old"))
    fs = target.getFileSystem(conf)
    if fs.exists(old) and not fs.exists(target):
        _rename(fs, old, target)
    try:
        df.write.mode("overwrite").format(fmt).options(**options).save(path + "__staging")
        swap(fs, staging, target, old)
    finally:
        fs.delete(staging, True)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def swap(fs, staging, target, old) -> None:
    """Put `staging` in the place of `target`; Hadoop reports a failed rename by its result."""
    if not fs.exists(target):
        _rename(fs, staging, target)
        return
    fs.delete(old, True)
    _rename(fs, target, old)
    try:
        _rename(fs, staging, target)
    except Exception:
        _rename(fs, old, target)
        raise
    fs.delete(old, True)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file under a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_checksums(spark: SparkSession, path: str, manifest: dict[str, str]) -> None:
    """Every file that the manifest names must be there with its checksum."""
    found = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in checksums(spark, path).collect()}
    wrong = sorted(f for f, digest in manifest.items() if found.get(f) != digest)
    if wrong:
        raise BadRows(f"missing or changed files: {', '.join(wrong)}")


#: Characters of a result that are shown beside its file.
PREVIEW = 1000


def write_artifact(df: DataFrame, path: str, limit: int = 1000) -> str:
    """A result as CSV with header; nulls are empty, values with commas, quotes or newlines are quoted. Returns a preview of it."""
    few = df.limit(limit)
    publish(few.coalesce(1), path, "csv", header="true", escape='"', nullValue="")
    return preview(few)


def preview(df: DataFrame, chars: int = PREVIEW) -> str:
    """The first characters of a small result's CSV, and a note if there are more."""
    line = F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]), {"escape": '"', "nullValue": ""})
    # A row has a line of its own at least, so no more rows than characters are needed.
    text = ",".join(df.columns) + "\n" + "".join(f"{r[0]}\n" for r in df.limit(chars).select(F.left(line, F.lit(chars + 1))).collect())
    return text if len(text) <= chars else f"{text[:chars]}\n(Results truncated to {chars} characters.)"


def append_audit(df: DataFrame, path: str) -> None:
    """Audit rows as Parquet, one folder a day, with secrets replaced: the whole values of columns and keys with secret names, at any depth of
    maps, structs, arrays and JSON text.

    `line` is the row as JSON, for logs.
    """
    secret = re.compile("|".join(map(re.escape, T.SECRET_KEYS)))

    def safe(f) -> Column:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if secret.search(f.name.lower()):
            return F.when(c.isNotNull(), F.lit("[REDACTED]")).alias(f.name)
        if kind == "string":
            return T.redact_json(c).alias(f.name)
        # Maps, structs and arrays are cleaned as JSON; a number under a secret key becomes null.
        return (F.from_json(T.redact_json(F.to_json(c)), f.dataType) if kind.startswith(("map", "struct", "array")) else c).alias(f.name)

    clean = df.select(*map(safe, df.schema))
    clean.withColumn("day", F.to_date("created_at")).withColumn("line", T.redact_json(F.to_json(F.struct(*df.columns)))).write.mode("append").partitionBy("day").parquet(path)
