"""Chart-ready shaping: the kind of chart follows from the column types, the data from one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS, MAX_SERIES, BINS = 200, 5, 10


def bar(df: DataFrame, category: str, value: str) -> DataFrame:
    """Sums by category; a null category is left out."""
    return df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.sum(value).alias(value))


def grouped_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("count"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, r for every pair of columns, in one pass over pairwise complete rows."""
    cells = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(cells)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(f"r{i}", 6).alias("r")) for i, (a, b) in enumerate(cells)])))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """bin (1..bins), low, high, count over equal widths; the largest value is in the last bin."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.when(width > 0, F.floor((x - F.col("lo")) / width) + 1).otherwise(1), F.lit(bins))
    with_ends = df.filter(x.isNotNull()).crossJoin(F.broadcast(ends))  # one row
    return with_ends.groupBy(b.cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("count")).select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), (F.col("lo") + F.col("bin") * width).alias("high"), "count")


def chart_spec(df: DataFrame) -> tuple[str, DataFrame]:
    """(kind, shaped data), by column types alone: four or more columns are a table; time and numbers a line; one number a
    histogram, with one category a bar; two numbers a scatter; more a heat map of correlations; two categories grouped counts."""
    kinds = {f.name: "time" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "number" if isinstance(f.dataType, T.NumericType) else "category" for f in df.schema}
    of = lambda k: [n for n, x in kinds.items() if x == k]
    numbers, categories, times = of("number"), of("category"), of("time")
    if not df.columns:
        raise ValueError("nothing to draw")
    if len(df.columns) >= 4:
        return "table", df.limit(MAX_ROWS)
    if times and numbers:
        return "line", df.select(times[0], *numbers[:MAX_SERIES]).orderBy(times[0])
    if len(numbers) == 1 and not categories:
        return "histogram", histogram(df, numbers[0])
    if len(numbers) == 1 and len(categories) == 1:
        return "bar", bar(df, categories[0], numbers[0])
    if len(numbers) == 2:
        return "scatter", df.select(*numbers).limit(MAX_ROWS)
    if len(numbers) >= 3:
        return "heatmap", correlations(df, numbers)
    if len(categories) >= 2:
        return "grouped_bar", grouped_counts(df, *categories[:2])
    return "bar", value_counts(df, df.columns[0])


def chartable(df: DataFrame) -> bool:
    """More than one row and a number to draw."""
    return any(isinstance(f.dataType, T.NumericType) for f in df.schema) and df.limit(2).count() > 1
