"""What of the catalog a question needs: metrics, tables, joins and columns under limits, for a whole table of questions at once.

The catalog is small and becomes literals; each question is one row, folded over them with array functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Catalog, CatalogError
from quillon.functions.text import alias_score
from quillon.operators.metrics import METRICS
from quillon.plans.routing import DIMENSION_WORDS, MIN_SCORE

#: Columns of each metric in the catalog's tables, its time column first.
SOURCES = {
    "gmv": ("orders.o_orderdate", "orders.o_orderkey", "orders.o_orderstatus", "lineitem.l_orderkey", "lineitem.l_extendedprice"),
    "paid_order_count": ("orders.o_orderdate", "orders.o_orderkey", "orders.o_orderstatus"),
    "average_delivery_days": ("orders.o_orderdate", "orders.o_orderkey", "lineitem.l_orderkey", "lineitem.l_shipdate"),
    "positive_review_rate": ("labels.doc_id", "labels.quality"),
}
DIMENSION_TABLES = {"customer_state": "nation", "category": "part", "seller_state": "supplier", "segment": "customer", "lang": "documents"}


@dataclass(frozen=True)
class Limits:
    tables: int = 4
    columns: int = 10
    metrics: int = 4
    joins: int = 6
    chars: int = 12_000


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _map(pairs: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), _strings(v))])


def _joins(tables: Column, catalog: Catalog) -> Column:
    """Names of the catalog's joins between the tables, in its order."""
    joins = F.array(*[F.struct(F.lit(j.left).alias("a"), F.lit(j.right).alias("b")) for j in catalog.joins])
    return F.transform(F.filter(joins, lambda j: F.array_contains(tables, j["a"]) & F.array_contains(tables, j["b"])), lambda j: F.concat(j["a"], F.lit("-"), j["b"]))


def table_names(table: str) -> tuple[str, ...]:
    return (table, table.removesuffix("s"))


def column_names(column: str) -> tuple[str, ...]:
    return (column, column.split("_", 1)[-1])


def retrieve(questions: DataFrame, catalog: Catalog, limits: Limits = Limits(), question: str = "question") -> DataFrame:
    """Adds metrics, tables, joins (sorted or in the catalog's order), columns (table -> names), prompt and reason.

    Metrics are taken from the best on as far as their tables, joins and columns fit the limits; one that does not fit is left out whole. A
    dimension that the question names brings the tables on the shortest path to its own. Then tables that the question names are added,
    best first and again until nothing changes, if a join connects them. Columns of the metrics come first, then those that the question
    names, then keys. If the prompt is longer than the limit, nothing is selected: the reason is context_limit. A null or blank question selects nothing.
    """
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    best = lambda names: F.greatest(*[alias_score(q, F.lit(a)) for a in (*names, "\0")])
    ranked = lambda entries: F.transform(F.filter(F.array_sort(F.array(*[F.struct((-best(names)).alias("s"), F.lit(k).alias("k")) for k, names in entries.items()])), lambda x: x["s"] <= -MIN_SCORE), lambda x: x["k"])
    tables_of = _map({m: tuple(dict.fromkeys(c.split(".")[0] for c in cols)) for m, cols in SOURCES.items()})
    columns_of = _map(SOURCES)
    fits = lambda tables: (F.size(tables) <= limits.tables) & (F.size(_joins(tables, catalog)) <= limits.joins)
    none = _strings(())

    def few_columns(metrics: Column) -> Column:
        needed = F.array_distinct(F.flatten(F.transform(metrics, lambda m: F.element_at(columns_of, m))))
        return F.forall(_strings(tuple(catalog.tables)), lambda t: F.size(F.filter(needed, lambda c: F.substring_index(c, ".", 1) == t)) <= limits.columns)

    def take_metric(acc: Column, m: Column) -> Column:
        tables, metrics = F.array_union(acc["tables"], F.element_at(tables_of, m)), F.concat(acc["metrics"], F.array(m))
        return F.when((F.size(acc["metrics"]) < limits.metrics) & fits(tables) & few_columns(metrics), F.struct(tables.alias("tables"), metrics.alias("metrics"))).otherwise(acc)

    df = questions.withColumns({"__metrics": ranked({m: catalog.aliases[m] for m in SOURCES}), "__tables": ranked({t: table_names(t) for t in catalog.tables})})
    df = df.withColumn("__taken", F.aggregate("__metrics", F.struct(none.alias("tables"), none.alias("metrics")), take_metric))
    paths = {}
    for d, target in DIMENSION_TABLES.items():
        for t in catalog.tables:
            try:
                paths[f"{t}>{target}"] = (t, *(j.right for j in catalog.path({t}, target)))
            except CatalogError:
                continue
    way = _map(paths)
    named = F.filter(F.array(*[F.when(F.exists(_strings(DIMENSION_WORDS[d]), lambda w: q.contains(w)), F.lit(t)) for d, t in DIMENSION_TABLES.items()]), lambda x: x.isNotNull())

    def reach(tables: Column, target: Column) -> Column:
        ways = F.array_sort(F.transform(F.filter(F.transform(tables, lambda t: F.element_at(way, F.concat(t, F.lit(">"), target))), lambda w: w.isNotNull()), lambda w: F.struct(F.size(w).alias("n"), w.alias("w"))))
        more = F.array_union(tables, F.coalesce(F.get(ways, F.lit(0))["w"], none))
        return F.when(~F.array_contains(tables, target) & fits(more), more).otherwise(tables)

    df = df.withColumn("__closed", F.aggregate(named, F.col("__taken.tables"), reach))
    near = _map({t: tuple(sorted({j.right if j.left == t else j.left for j in catalog.joins if t in (j.left, j.right)})) for t in catalog.tables})

    def add(tables: Column, t: Column) -> Column:
        more = F.concat(tables, F.array(t))
        linked = (F.size(tables) == 0) | F.arrays_overlap(tables, F.element_at(near, t))
        return F.when(~F.array_contains(tables, t) & linked & fits(more), more).otherwise(tables)

    df = df.withColumn("__all", F.array_sort(F.aggregate(F.flatten(F.array_repeat("__tables", limits.tables)), F.col("__closed"), add)))
    keys = {t: tuple(sorted({j.left_key for j in catalog.joins if j.left == t} | {j.right_key for j in catalog.joins if j.right == t})) for t in catalog.tables}
    metric_columns = F.flatten(F.transform("__taken.metrics", lambda m: F.element_at(columns_of, m)))

    def columns(t: str) -> Column:
        mine = F.array_sort(F.transform(F.filter(metric_columns, lambda c: F.substring_index(c, ".", 1) == t), lambda c: F.substring_index(c, ".", -1)))
        scored = F.array_sort(F.filter(F.array(*[F.struct((-best(column_names(c))).alias("s"), F.lit(c).alias("c")) for c in catalog.tables[t]]), lambda x: x["s"] < 0))
        return F.slice(F.array_distinct(F.concat(mine, F.transform(scored, lambda x: x["c"]), _strings(keys[t]))), 1, limits.columns)

    chosen = F.map_filter(F.create_map(*[x for t in catalog.tables for x in (F.lit(t), columns(t))]), lambda t, _: F.array_contains("__all", t))
    df = df.withColumns({"__columns": chosen, "__joins": _joins(F.col("__all"), catalog)})
    label = F.create_map(*[x for m in SOURCES for x in (F.lit(m), F.lit(f"{m}: {METRICS[m].label}, time {METRICS[m].time or 'none'}"))])
    lines = F.concat(
        F.transform("__taken.metrics", lambda m: F.concat(F.lit("metric "), F.element_at(label, m))),
        F.transform("__all", lambda t: F.concat(F.lit("table "), t, F.lit(": "), F.array_join(F.element_at("__columns", t), ", "))),
        F.transform("__joins", lambda j: F.concat(F.lit("join "), j)),
    )
    df = df.withColumn("__prompt", F.array_join(lines, "\n")).withColumn("__over", F.char_length("__prompt") > limits.chars)
    keep = lambda c, empty: F.when(F.col("__over"), empty).otherwise(c)
    reason = F.when(F.col("__over"), "context_limit").when(F.size("__taken.metrics") > 0, "metrics").when(F.size("__all") > 0, "tables").otherwise("no_match")
    return df.withColumns({
        "metrics": keep(F.col("__taken.metrics"), none),
        "tables": keep(F.col("__all"), none),
        "joins": keep(F.col("__joins"), none),
        "columns": keep(F.col("__columns"), F.create_map().cast("map<string,array<string>>")),
        "prompt": keep(F.col("__prompt"), F.lit(f"The context has more than {limits.chars} characters: narrow the question.")),
        "reason": reason,
    }).drop("__metrics", "__tables", "__taken", "__closed", "__all", "__columns", "__joins", "__prompt", "__over")
