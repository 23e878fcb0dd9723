"""Metadata and history scans, evaluation cases, and bounded previews for people."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def information_schema(spark: SparkSession) -> DataFrame:
    """table_name, column_name, data_type of every table and view of the current database."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def query_history(history: DataFrame, contains: str, limit: int = 10, seed: int = 0, text: str = "query_text", rows: str = "rows_produced") -> DataFrame:
    """A random sample of distinct queries that returned more than one row and mention a name (case ignored)."""
    hit = history.filter((F.col(rows) > 1) & F.lower(text).contains(contains.lower()))
    return hit.select(text).distinct().orderBy(F.rand(seed), text).limit(limit)


def suggested_questions(training: DataFrame, limit: int = 5, seed: int = 0, question: str = "question") -> DataFrame:
    return training.filter(F.col(question).isNotNull()).select(question).orderBy(F.rand(seed)).limit(limit)


def audit_events(audits: DataFrame, filters: dict[str, object] | None = None, start: str | None = None, end: str | None = None, limit: int = 100, time: str = "ts") -> DataFrame:
    """Newest audit rows with the given values in a half-open time range."""
    for k, v in (filters or {}).items():
        audits = audits.filter(F.col(k).eqNullSafe(F.lit(v)))
    if start:
        audits = audits.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if end:
        audits = audits.filter(F.col(time) < F.lit(end).cast("timestamp"))
    return audits.orderBy(F.desc(time)).limit(limit)


def load_cases(spark: SparkSession, path: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """Evaluation cases from a YAML or JSON list: id, category, question, expected (a string map); optionally those with the given values."""
    raw = Path(path).read_text()
    cases = json.loads(raw) if path.endswith(".json") else yaml.safe_load(raw)
    rows = [(str(c["id"]), str(c.get("category", "")), str(c.get("question", "")), {k: str(v) for k, v in c.items() if k not in ("id", "category", "question")}) for c in cases]
    df = spark.createDataFrame(rows, "id string, category string, question string, expected map<string,string>")
    for k, v in (metadata or {}).items():
        df = df.filter(F.element_at("expected", k) == v)
    return df


def save_cases(df: DataFrame, path: str) -> None:
    rows = [{"id": r["id"], "category": r["category"], "question": r["question"], **r["expected"]} for r in df.orderBy("id").collect()]
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=1) if path.endswith(".json") else yaml.safe_dump(rows, allow_unicode=True, sort_keys=False))


def search_files(spark: SparkSession, folder: str, term: str, limit: int = 20, content: bool = True) -> DataFrame:
    """path, snippet of text files whose name, or content, holds a term; case is ignored."""
    from quillon.functions.text import snippet

    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    named = F.lower(F.element_at(F.split("path", "/"), -1)).contains(term.lower())
    hit = named | F.lower("text").contains(term.lower()) if content else named
    return files.filter(hit).select("path", snippet(F.col("text"), term).alias("snippet")).orderBy("path").limit(limit)


def markdown(df: DataFrame, rows: int = 10) -> str:
    """The first rows as a Markdown table; bars and newlines are escaped."""
    clean = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(clean, r)) + " |" for r in df.limit(rows).collect()])


def json_summary(df: DataFrame, rows: int = 8, max_chars: int = 1200) -> str:
    """Sample rows as JSON of bounded length: rows are dropped from the end until it fits."""
    sample = [json.loads(r[0]) for r in df.limit(rows).select(F.to_json(F.struct(*df.columns))).collect()]
    while len(text := json.dumps({"columns": df.columns, "rows": sample}, ensure_ascii=False)) > max_chars and sample:
        sample.pop()
    return text
