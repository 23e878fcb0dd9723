"""Catalog retrieval for a table of questions, against the same rules as loops over one question."""

import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillon import catalog as C
from quillon.plans.data_queries import QUESTIONS
from quillon.plans.retrieval import DIMENSION_TABLES, SOURCES, Limits, column_names, retrieve, table_names
from quillon.plans.routing import DIMENSION_WORDS, definitions, route

MORE = ["customer market segment and gmv by state", "lineitem quantity of parts and suppliers", "documents by language and labels quality", "sales, orders, delivery days and good reviews by category and seller", "region", None, "orders by customer state and part size with supplier nation"]


def score(q, alias):
    tokens = lambda t: set(re.findall(r"[a-z0-9_]+|[一-鿿]+", t))
    if alias in q:
        return 2 + min(len(alias), 16) / 16
    return 0.75 + min(len(alias), 12) / 48 if tokens(alias) and tokens(alias) <= tokens(q) else 0


def loops(question, c, limits):
    q = (question or "").strip().lower()
    best = lambda names: max(score(q, a) for a in names)
    rank = lambda entries: [k for s, k in sorted((-best(n), k) for k, n in entries.items()) if s <= -1.25]
    joins = lambda ts: [f"{j.left}-{j.right}" for j in c.joins if j.left in ts and j.right in ts]
    fits = lambda ts: len(ts) <= limits.tables and len(joins(ts)) <= limits.joins
    tables, metrics = [], []
    for m in rank({m: c.aliases[m] for m in SOURCES}):
        more = list(dict.fromkeys([*tables, *(x.split(".")[0] for x in SOURCES[m])]))
        needed = {x for k in (*metrics, m) for x in SOURCES[k]}
        if len(metrics) < limits.metrics and fits(more) and all(sum(x.startswith(t + ".") for x in needed) <= limits.columns for t in c.tables):
            tables, metrics = more, [*metrics, m]
    for d, target in DIMENSION_TABLES.items():
        if not any(w in q for w in DIMENSION_WORDS[d]) or target in tables:
            continue
        ways = []
        for t in tables:
            queue, seen = deque([(t, [t])]), {t}
            while queue:
                at, way = queue.popleft()
                if at == target:
                    ways.append((len(way), way))
                    break
                for j in c.joins:
                    for a, b in ((j.left, j.right), (j.right, j.left)):
                        if a == at and b not in seen:
                            seen.add(b)
                            queue.append((b, [*way, b]))
        more = list(dict.fromkeys([*tables, *(min(ways)[1] if ways else [])]))
        if fits(more):
            tables = more
    changed = True
    while changed:
        changed = False
        for t in rank({t: table_names(t) for t in c.tables}):
            linked = not tables or any({j.left, j.right} == {t, x} for j in c.joins for x in tables)
            if t not in tables and linked and fits([*tables, t]):
                tables, changed = [*tables, t], True
    cols = {}
    for t in tables:
        mine = sorted(x.split(".")[1] for m in metrics for x in SOURCES[m] if x.startswith(t + "."))
        named = [k for s, k in sorted((-best(column_names(x)), x) for x in c.tables[t]) if s < 0]
        keys = sorted({j.left_key for j in c.joins if j.left == t} | {j.right_key for j in c.joins if j.right == t})
        cols[t] = list(dict.fromkeys([*mine, *named, *keys]))[: limits.columns]
    return metrics, sorted(tables), joins(tables), cols


@pytest.mark.parametrize("limits", [Limits(), Limits(tables=2, columns=3, metrics=1), Limits(joins=1)])
def test_retrieval_against_loops(spark, limits):
    c = C.load_catalog()
    asked = [q[0] for q in QUESTIONS] + MORE
    got = retrieve(spark.createDataFrame(list(enumerate(asked)), "id int, question string"), c, limits).collect()
    assert any(len(r["tables"]) > 2 for r in got) or limits.tables == 2 or limits.joins == 1
    for r in got:
        assert (r["metrics"], r["tables"], r["joins"], r["columns"]) == loops(asked[r["id"]], c, limits), asked[r["id"]]
        assert r["reason"] == ("metrics" if r["metrics"] else "tables" if r["tables"] else "no_match")


def test_too_long_a_context_selects_nothing(spark):
    r = retrieve(spark.createDataFrame([("gmv by state",)], "question string"), C.load_catalog(), Limits(chars=50)).first()
    assert (r["metrics"], r["tables"], r["joins"], r["columns"], r["reason"]) == ([], [], [], {}, "context_limit")


def test_definitions_read_no_data(spark):
    q = definitions(route(spark.createDataFrame([(1, "what is gmv"), (2, "gmv by month")], "id int, question string"), C.load_catalog()))
    got = {r["id"]: r["answer"] for r in q.collect()}
    assert got[2] is None and got[1].splitlines()[2] == "| Gross merchandise value (`gmv`) | ordered_at | effective orders only |"


def test_intents_and_warnings(spark):
    said = {
        "为什么本月 GMV 下降": ("missing_time", "data_analysis", []),
        "2017年 GMV 下降的影响因素，同比": ("answerable", "data_analysis", []),
        "what is gmv and how many in 2017": ("answerable", "mixed_request", []),
        "gmv by state in 2017": ("answerable", "data_query", []),
        "gmv and positive review rate by month in 2017": ("answerable", "data_query", ["selected_metrics_use_different_time_fields"]),
        "gmv and orders by month in 2017": ("answerable", "data_query", []),
        "gmv and average delivery days by category": ("dimension_policy", "clarification_required", ["dimension_not_supported_by_all_metrics"]),
        "delete all orders": ("unauthorized", "unsafe_or_unauthorized", []),
        "业务上如何提升留存": ("general_business", "general_business", []),
        "为什么会这样，结合当前数据": ("missing_metric", "clarification_required", []),
        "what is gmv": ("definition", "catalog_definition", []),
        "help": ("help", "help", []),
    }
    df = spark.createDataFrame([(q,) for q in said], "question string")
    got = {r.question: (r.reason, r.intent, list(r.warnings)) for r in route(df, C.load_catalog()).collect()}
    assert got == said


def test_remembered_metrics(spark):
    df = spark.createDataFrame([("by month", ["gmv"]), ("by category", ["average_delivery_days"]), ("by month", None), ("orders by month", ["gmv"])], "question string, known array<string>")
    got = [(r.reason, r.metric_ids) for r in route(df, C.load_catalog(), remembered=F.col("known")).collect()]
    assert got == [("answerable", ["gmv"]), ("dimension_policy", ["average_delivery_days"]), ("missing_metric", []), ("answerable", ["paid_order_count"])]
