"""Evaluation scores and reports over tables of expected and actual results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS_SCORE = 0.7


def trajectory_score(expected: Column, forbidden: Column, actual: Column) -> Column:
    """1, less half the share of expected tools that were not called and half the share of forbidden tools that were; other calls are free."""
    share = lambda tools, bad: F.coalesce(F.try_divide(F.size(F.filter(tools, bad)), F.size(tools)), F.lit(0.0))
    missing = share(expected, lambda x: ~F.array_contains(actual, x))
    wrong = share(forbidden, lambda x: F.array_contains(actual, x))
    return F.greatest(F.round(1 - 0.5 * missing - 0.5 * wrong, 6), F.lit(0.0))


def output_score(text: Column, wanted: Column, unwanted: Column) -> Column:
    """Share of the conditions met: each wanted string is in the text, each unwanted one is not; case is ignored. No conditions: 1."""
    t = F.lower(F.coalesce(text, F.lit("")))
    met = F.size(F.filter(wanted, lambda x: t.contains(F.lower(x)))) + F.size(F.filter(unwanted, lambda x: ~t.contains(F.lower(x))))
    return F.round(F.coalesce(F.try_divide(met, F.size(wanted) + F.size(unwanted)), F.lit(1.0)), 6)


def efficiency_score(millis: Column, tokens: Column, max_millis: float, max_tokens: int, case_millis: Column) -> Column:
    """1, less 0.33 each if time or tokens exceed their budgets, and 0.34 if time exceeds the case's own; a null budget is none."""
    over = lambda x, m, w: F.when(x > m, w).otherwise(0.0)
    return F.round(1 - over(millis, max_millis, 0.33) - over(tokens, max_tokens, 0.33) - over(millis, case_millis, 0.34), 6)


def report(results: DataFrame, by: list[str], score: str = "score", millis: str = "millis", tokens: str = "tokens") -> DataFrame:
    """cases, pass_rate, avg_score, avg_millis, total_tokens for each group."""
    return results.groupBy(*by).agg(
        F.count("*").alias("cases"), F.round(F.avg((F.col(score) >= PASS_SCORE).cast("int")), 6).alias("pass_rate"), F.round(F.avg(score), 6).alias("avg_score"), F.round(F.avg(millis), 6).alias("avg_millis"), F.sum(tokens).alias("total_tokens")
    )


def best_variant(reports: DataFrame, metric: str, variant: str = "variant") -> DataFrame:
    """The variant with the largest score or pass rate, or the smallest time; ties to the smaller name."""
    column, sign = {"score": ("avg_score", -1), "time": ("avg_millis", 1), "pass_rate": ("pass_rate", -1)}[metric]
    return reports.agg(F.min_by(variant, F.struct((F.col(column) * sign).alias("v"), F.col(variant))).alias("best_variant"))


def label_counts(labels: DataFrame, fields: list[str]) -> DataFrame:
    """field, label ('NA' for null), count: one unpivot and one grouping."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("NA")).alias("label")) for f in fields])).alias("c")
    return labels.select(cells).groupBy("c.field", "c.label").agg(F.count("*").alias("count"))


def golden_diff(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, expected, actual where a field differs; a missing row differs in every field."""
    e = expected.select(F.col(key).alias("key"), F.posexplode(F.array(*[F.col(f).cast("string") for f in fields])).alias("i", "expected"))
    a = actual.select(F.col(key).alias("key"), F.posexplode(F.array(*[F.col(f).cast("string") for f in fields])).alias("i", "actual"))
    both = e.join(a, ["key", "i"], "full").filter(~F.col("expected").eqNullSafe(F.col("actual")))
    return both.select("key", F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("i") + 1).alias("field"), "expected", "actual")


def case_table(results: DataFrame, scores: list[str], variant: str = "variant", case: str = "case_id", message: str = "message", score: str = "score", millis: str = "millis", tokens: str = "tokens", error: str = "error") -> DataFrame:
    """One row per variant and case, for comparison: the message's first 50 characters, passed, score, time, tokens, error and every evaluator's score as JSON."""
    return results.select(
        F.col(variant).alias("variant"), F.col(case).alias("case_id"), F.substring(message, 1, 50).alias("message"), (F.col(score) >= PASS_SCORE).alias("passed"), F.col(score).alias("score"), F.col(millis).alias("millis"),
        F.col(tokens).alias("tokens"), F.coalesce(F.col(error), F.lit("")).alias("error"), F.to_json(F.struct(*scores)).alias("evaluator_scores"),
    )
