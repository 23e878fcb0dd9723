"""Queries over stored structures (lattice, buckets, indexes, snapshots), joins of texts, streams' batch plans, and their SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.catalog import load_catalog
from quillon.functions import text as T
from quillon.operators import ivf, match_index, metrics, rollup, set_join
from quillon.plans import memory, routing
from quillon.plans.data_queries import QUESTIONS
from quillon.plans.metric_queries import ORACLES as METRIC_ORACLES
from quillon.sources import bucketed
from quillon.sources.snapshots import Snapshots
from quillon.sources.stored import new_path
from quillon.sources.tables import CATEGORY_NAMES, Star, load
from quillon.streaming import joined
from quillon.streaming.incremental import Incremental

_CELLS = ["gmv", "item_count", "order_count", "customer_count"]
SPAN = ("1996-02-10", "1998-07-20")


def rollup_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grain by category from one daily lattice."""
    return rollup.build(Star(spark, sf_dir)).grains(_CELLS, ("category",))


def rollup_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All subsets of region and category, between two days inside months."""
    return rollup.build(Star(spark, sf_dir)).cube([*_CELLS, "average_order_value"], ("customer_region", "category"), *SPAN)


def rollup_renewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters by region of a lattice that was built and then renewed from a day on."""
    star = Star(spark, sf_dir)
    lattice = rollup.build(star)
    return rollup.build(star, lattice.path, since="1998-05-05").query(["gmv", "order_count", "customer_count"], ("customer_region",), "quarter")


@dataclass(frozen=True)
class Gapped(Star):
    """The star without the orders of one month."""

    def orders(self) -> DataFrame:
        return super().orders().filter("NOT (ordered_at >= TIMESTAMP '1997-03-01' AND ordered_at < TIMESTAMP '1997-04-01')")


def gmv_mom_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compare_periods(Gapped(spark, sf_dir), "gmv", "month", "previous_period", calendar=True)


def orders_day_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region and day beside the same day a year before, empty days included."""
    return metrics.compare_periods(Gapped(spark, sf_dir), "paid_order_count", "day", "year_over_year", ("customer_region",), calendar=True)


def bucketed_state_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.query(bucketed.store(spark, sf_dir), ["gmv", "paid_order_count"], ("customer_state",))


def order_facts_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics of one fact in one aggregate."""
    return metrics.query(Star(spark, sf_dir), ["gmv", "paid_order_count", "average_delivery_days", "item_count", "average_order_value", "on_time_delivery_rate"], ("segment",), "year")


def _ivf(measure: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = load(spark, sf_dir, "embeddings")
        asked = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        return ivf.build(v, measure=measure).search(asked, 10).select("query_id", F.col("id").alias("vec_id"), "value", "rank")

    return query


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "role", "text")


def text_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every message the ten most alike by words, at 0.7 or more, of the same role."""
    rows = _said(spark, sf_dir)
    return set_join.similar_usages(rows.withColumnRenamed("id", "question_id"), rows.withColumnRenamed("id", "memory_id"), blocks=False, same="role")


def text_usage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every fiftieth conversation with all messages, by words or matching blocks."""
    rows = _said(spark, sf_dir)
    return set_join.similar_usages(rows.filter("conv_id % 50 = 0").withColumnRenamed("id", "question_id"), rows.withColumnRenamed("id", "memory_id"))


def match_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items divisible by 50 as queries over all documents, and again inside their language."""
    index = match_index.build(load(spark, sf_dir, "documents"), collection="lang")
    asked = load(spark, sf_dir, "benchmark").filter("item_id % 50 = 0")
    langs = F.explode(F.array(F.lit(None).cast("string"), F.lit("en"), F.lit("de"))).alias("collection")
    queries = asked.select("item_id", "text", langs).select(F.concat_ws("-", F.col("item_id").cast("string"), "collection").alias("query_id"), "text", "collection")
    return index.search(queries, 10)


def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and items published together, then renewed, then rolled back: rows and key sums that readers of each version see."""
    store = Snapshots(spark, new_path(spark, "snapshots"))
    orders, items = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    store.commit({"orders": orders, "items": items})
    store.commit({"orders": orders.filter("key % 2 = 0")})
    store.rollback(1)
    parts = [store.read(t, v).agg(F.count("*").alias("rows"), F.sum("key").alias("keys")).select(F.lit(v).alias("version"), F.lit(t).alias("table_name"), "rows", "keys") for v in store.versions() for t in store.tables(v)]
    return reduce(DataFrame.unionByName, parts)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def incremental_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by kind after five batches, of which one came twice and three were compacted in between."""
    found = Incremental(spark, new_path(spark, "incremental"))
    batch = lambda n: _events(spark, sf_dir).filter(F.col("event_id") % 5 == n)
    for n in (0, 1, 2, 2):
        found.merge(batch(n), n)
    found.compact()
    for n in (2, 3, 4, 3):
        found.merge(batch(n), n)
    return found.totals().select("event_type", "rows", F.col("total").cast("double").alias("total"), "first", "last")


def runs_with_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of their user in the two hours after."""
    ev = _events(spark, sf_dir)
    runs = ev.filter("event_type = 'click'").select(F.col("event_id").alias("run_id"), "user_id", F.col("ts").alias("run_at"))
    audits = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("audit_id"), "user_id", F.col("ts").alias("audit_at"), F.col("value").alias("audit_value"))
    return joined.with_audits(runs, audits, "2 hours").select("run_id", "audit_id", "audit_value")


def asked_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of `conversations` asks one of QUESTIONS, by its conversation and turn."""
    k = F.col("conv_id") * 7 + F.col("turn") * 3
    q = F.element_at(F.array(*[F.lit(x[0]) for x in QUESTIONS]), (k % len(QUESTIONS) + 1).cast("int"))
    return load(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").select("conv_id", "turn", q.alias("question"))


def conversation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversation has settled after every turn."""
    m = memory.replay(memory.features(asked_in_turns(spark, sf_dir), load_catalog()))
    return m.select("conv_id", "turn", F.array_join("metric_ids", ",").alias("metrics"), F.col("time_range.start").alias("first_day"), F.col("time_range.end").alias("last_day"), "comparison", "pending_question", "pending_missing")


def routed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of all messages and benchmark items as they are."""
    c = load(spark, sf_dir, "conversations").select(F.lit("conversation").alias("kind"), "text")
    b = load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), "text")
    return routing.route(c.unionByName(b), load_catalog(), "text").groupBy("kind", "reason", "intent").agg(F.count("*").alias("texts"))


def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error categories of all messages and of the raw properties of all events, as they are."""
    said = load(spark, sf_dir, "conversations").select(F.lit("conversation").alias("kind"), "text").unionByName(load(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("props").alias("text")))
    return said.select("kind", T.error_category(F.coalesce("text", F.lit(""))).alias("c")).groupBy("kind", "c.category", "c.retryable").agg(F.count("*").alias("texts"))


def json_safe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as values that JSON can hold; some values are made infinite or not a number."""
    ev = load(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 11 == 0, float("inf")).when(F.col("event_id") % 13 == 0, float("nan")).otherwise(F.col("value") / 3))
    ev = ev.withColumn("props", F.repeat("props", 5))
    return ev.select(*[T.json_safe(F.col(f.name), f.dataType).alias(f.name) for f in ev.select("event_id", "ts", "value", "props").schema])


QUERIES = {
    "rollup_grains": rollup_grains,
    "rollup_cube": rollup_cube,
    "rollup_renewed": rollup_renewed,
    "gmv_mom_calendar": gmv_mom_calendar,
    "orders_day_calendar": orders_day_calendar,
    "bucketed_state_orders": bucketed_state_orders,
    "order_facts_by_segment": order_facts_by_segment,
    "ivf_l2_topk": _ivf("l2"),
    "ivf_cosine_topk": _ivf("cosine"),
    "text_set_join": text_set_join,
    "text_usage_join": text_usage_join,
    "match_index_topk": match_index_topk,
    "snapshot_versions": snapshot_versions,
    "incremental_totals": incremental_totals,
    "runs_with_audits": runs_with_audits,
    "conversation_memory": conversation_memory,
    "routed_texts": routed_texts,
    "json_safe_rows": json_safe_rows,
    "error_texts": error_texts,
}

_EFF = "o_orderstatus NOT IN ('P')"
_PRICE = "CAST(l_extendedprice AS DECIMAL(14,2))"
_STAR = f"""(
  SELECT o_orderdate, o_orderkey, o_custkey, r_name AS customer_region,
         CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_NAMES.items())} ELSE coalesce(p_type, 'uncategorized') END AS category, {_PRICE} AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey WHERE {_EFF}
)"""
_MEASURES = "CAST(sum(price) AS DOUBLE) AS gmv, count(*) AS item_count, count(DISTINCT o_orderkey) AS order_count, count(DISTINCT o_custkey) AS customer_count"
_GAP = "NOT (o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01')"
_CHANGE = "round((x - baseline) / CAST(nullif(baseline, 0) AS DOUBLE), 6) AS change"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> ''))"
_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')"
#: Facts of QUESTIONS that the memory keeps: own metrics (none of general ones), range, comparison, and the reason with nothing known.
_FACTS = ", ".join(
    "({}, {}, {}, {}, {}, {}, {})".format(
        i, *["NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in (q[0], q[2] if q[2] and q[7] not in memory.GENERAL else None, q[5], q[6], "year_over_year" if "year over year" in q[0] else None, "followup_without_result" if q[1] else q[7])]
    )
    for i, q in enumerate(QUESTIONS)
)


def _route_sql() -> str:
    """Reasons of texts that name no metric, in the order of the router; a text that names one is not expected here."""
    r = routing
    match = lambda p, t="s": f"regexp_matches({t}, '{p.replace(chr(39), chr(39) * 2)}')"
    rest = f"regexp_replace(s, '{r.DEFINITION}', '', 'g')"
    return f"""CASE WHEN s = '' THEN 'empty' WHEN {match(r.UNAUTHORIZED)} THEN 'unauthorized' WHEN {match(r.UNSUPPORTED)} THEN 'unsupported' WHEN {match(r.HELP)} THEN 'help'
    WHEN {match(r.RESULT_FOLLOWUP)} THEN 'followup_without_result' WHEN {match(r.DEFINITION)} AND NOT {match(r.DATA_INTENT, rest)} THEN 'general_definition'
    WHEN {match(r.GENERAL_BUSINESS)} AND NOT {match(r.DATA_CONTEXT)} THEN 'general_business' ELSE 'missing_metric' END"""


ORACLES = {
    "rollup_grains": " UNION ALL ".join(f"SELECT '{g}' AS grain, CAST(date_trunc('{g}', o_orderdate) AS DATE) AS period, category, {_MEASURES} FROM {_STAR} GROUP BY 2, 3" for g in metrics.GRAINS),
    "rollup_cube": f"""SELECT CAST(grouping(customer_region) + grouping(category) AS INTEGER) AS level, customer_region, category, {_MEASURES}, round(CAST(sum(price) AS DOUBLE) / count(DISTINCT o_orderkey), 6) AS average_order_value
        FROM {_STAR} WHERE o_orderdate >= TIMESTAMP '{SPAN[0]}' AND o_orderdate < TIMESTAMP '{SPAN[1]}' + INTERVAL 1 DAY GROUP BY CUBE (customer_region, category)""",
    "rollup_renewed": f"SELECT customer_region, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CAST(sum(price) AS DOUBLE) AS gmv, count(DISTINCT o_orderkey) AS order_count, count(DISTINCT o_custkey) AS customer_count FROM {_STAR} GROUP BY 1, 2",
    "gmv_mom_calendar": f"""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum({_PRICE}) AS DOUBLE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {_EFF} AND {_GAP} GROUP BY 1),
        c AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), INTERVAL 1 MONTH)) AS DATE) AS period),
        l AS (SELECT period, x, lag(x) OVER (ORDER BY period) AS baseline FROM c LEFT JOIN m USING (period)) SELECT period, x AS gmv, baseline, {_CHANGE} FROM l""",
    "orders_day_calendar": f"""WITH m AS (SELECT r_name AS customer_region, CAST(date_trunc('day', o_orderdate) AS DATE) AS period, count(*) AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey WHERE {_EFF} AND {_GAP} GROUP BY 1, 2),
        c AS (SELECT customer_region, CAST(unnest(generate_series((SELECT min(period) FROM m), (SELECT max(period) FROM m), INTERVAL 1 DAY)) AS DATE) AS period FROM (SELECT DISTINCT customer_region FROM m)),
        l AS (SELECT c.customer_region, c.period, m.x, t.x AS baseline FROM c LEFT JOIN m USING (customer_region, period) LEFT JOIN m t ON t.customer_region = c.customer_region AND t.period = CAST(c.period - INTERVAL 1 YEAR AS DATE))
        SELECT customer_region, period, x AS paid_order_count, baseline, {_CHANGE} FROM l""",
    "bucketed_state_orders": METRIC_ORACLES["state_gmv_and_orders"],
    "order_facts_by_segment": f"""WITH o AS (SELECT o.*, c_mktsegment AS segment, CAST(date_trunc('year', o_orderdate) AS DATE) AS period FROM orders o LEFT JOIN customer ON o_custkey = c_custkey),
        i AS (SELECT l_orderkey, sum({_PRICE}) AS price, count(*) AS items, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
        SELECT segment, period, CAST(sum(price) FILTER ({_EFF}) AS DOUBLE) AS gmv, count(*) FILTER ({_EFF}) AS paid_order_count,
          round(avg((epoch_us(shipped) - epoch_us(o_orderdate)) / 86400000000.0) FILTER (shipped >= o_orderdate), 6) AS average_delivery_days, CAST(sum(items) AS BIGINT) AS item_count,
          round(CAST(sum(price) FILTER ({_EFF}) AS DOUBLE) / count(price) FILTER ({_EFF}), 6) AS average_order_value,
          round(avg(CAST(shipped <= o_orderdate + INTERVAL 60 DAY AS INT)) FILTER (shipped >= o_orderdate), 6) AS on_time_delivery_rate
        FROM o LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "ivf_l2_topk": "SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS value, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6), v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 10",
    "ivf_cosine_topk": "SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS value, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 10",
    "text_set_join": f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, role, {_WORDS} AS w FROM conversations),
        s AS (SELECT q.id AS question_id, m.id AS memory_id, len(list_intersect(q.w, m.w)) AS n, len(q.w) + len(m.w) AS z FROM w q JOIN w m ON q.role = m.role AND len(m.w) >= 0.69 * len(q.w) AND len(q.w) >= 0.69 * len(m.w)),
        r AS (SELECT question_id, memory_id, round(n / (z - n), 6) AS score FROM s WHERE n > 0 AND n / (z - n) >= 0.7 - 1e-9)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, memory_id) AS rank FROM r) WHERE rank <= 10""",
    "match_index_topk": f"""WITH d AS (SELECT doc_id, lang, {_TERMS} AS w FROM documents),
        c AS (SELECT unnest([NULL, 'en', 'de']) AS wanted),
        z AS (SELECT wanted, count(*) AS n, avg(len(w)) AS avg_len FROM c JOIN d ON wanted IS NULL OR wanted = lang GROUP BY 1),
        p AS (SELECT doc_id, lang, len(w) AS dl, unnest(w) AS term FROM d),
        t AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM p GROUP BY ALL),
        f AS (SELECT wanted, term, count(*) AS df FROM c JOIN t ON wanted IS NULL OR wanted = lang GROUP BY 1, 2),
        q AS (SELECT DISTINCT item_id, wanted, unnest({_TERMS}) AS term FROM benchmark, c WHERE item_id % 50 = 0),
        s AS (SELECT CAST(item_id AS VARCHAR) || coalesce('-' || q.wanted, '') AS query_id, doc_id,
                round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
              FROM q JOIN t ON t.term = q.term AND (q.wanted IS NULL OR q.wanted = t.lang) JOIN z ON z.wanted IS NOT DISTINCT FROM q.wanted JOIN f ON f.wanted IS NOT DISTINCT FROM q.wanted AND f.term = q.term GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "snapshot_versions": "SELECT CAST(v AS INTEGER) AS version, t AS table_name, count(*) AS rows, CAST(sum(key) AS BIGINT) AS keys FROM (SELECT 'orders' AS t, o_orderkey AS key FROM orders UNION ALL SELECT 'items', l_orderkey FROM lineitem), (SELECT unnest([1, 2, 3]) AS v) WHERE NOT (v = 2 AND t = 'orders' AND key % 2 <> 0) GROUP BY 1, 2",
    "incremental_totals": "SELECT event_type, count(*) AS rows, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1",
    "runs_with_audits": "SELECT r.event_id AS run_id, a.event_id AS audit_id, a.value AS audit_value FROM events r LEFT JOIN events a ON a.event_type = 'purchase' AND a.user_id = r.user_id AND a.ts BETWEEN r.ts AND r.ts + INTERVAL 2 HOUR WHERE r.event_type = 'click'",
    "routed_texts": f"""SELECT kind, reason, CASE reason WHEN 'missing_metric' THEN 'clarification_required' WHEN 'followup_without_result' THEN 'clarification_required' WHEN 'empty' THEN 'unsupported' WHEN 'unauthorized' THEN 'unsafe_or_unauthorized'
          WHEN 'general_definition' THEN 'general_knowledge' ELSE reason END AS intent, count(*) AS texts
        FROM (SELECT kind, {_route_sql()} AS reason FROM (SELECT 'conversation' AS kind, trim(coalesce(text, '')) AS s FROM conversations UNION ALL SELECT 'benchmark', trim(coalesce(text, '')) FROM benchmark)) GROUP BY ALL""",
    "json_safe_rows": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END AS ts,
        CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN round(value / 3, 6) END AS value, left(repeat(props, 5), 160) AS props FROM events""",
    "error_texts": f"""WITH t AS (SELECT 'conversation' AS kind, lower(coalesce(text, '')) AS s FROM conversations UNION ALL SELECT 'event', lower(coalesce(props, '')) FROM events),
        c AS (SELECT kind, CASE {" ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for n, p, _ in T.ERROR_CATEGORIES)} ELSE 'unknown' END AS category FROM t)
        SELECT kind, category, category IN ({", ".join(f"'{n}'" for n, _, r in T.ERROR_CATEGORIES if r)}) AS retryable, count(*) AS texts FROM c GROUP BY ALL""",
    "conversation_memory": f"""WITH f(i, q, m, a, b, c, r) AS (VALUES {_FACTS}),
        t AS (SELECT conv_id, turn, f.* FROM conversations JOIN f ON i = (conv_id * 7 + turn * 3) % {len(QUESTIONS)} WHERE conv_id IS NOT NULL),
        k AS (SELECT *, last_value(m IGNORE NULLS) OVER w AS ms, last_value(a IGNORE NULLS) OVER w AS first_day, last_value(b IGNORE NULLS) OVER w AS last_day, last_value(c IGNORE NULLS) OVER w AS cs,
                last_value(a IGNORE NULLS) OVER e AS known_period, last_value(c IGNORE NULLS) OVER e AS known_comparison, last_value(m IGNORE NULLS) OVER e AS known_metrics
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        p AS (SELECT *, CASE WHEN r = 'missing_time' AND known_period IS NOT NULL THEN 'answerable' WHEN r = 'missing_comparison' AND known_comparison IS NOT NULL THEN 'answerable'
                WHEN r = 'missing_metric' AND known_metrics IS NOT NULL THEN 'answerable' ELSE r END AS reason FROM k),
        o AS (SELECT *, reason IN ({", ".join(f"'{c}'" for c in memory.CLOSED)}) AS closed FROM p)
        SELECT conv_id, turn, coalesce(ms, '') AS metrics, first_day, last_day, cs AS comparison, CASE WHEN NOT closed THEN q END AS pending_question, CASE WHEN NOT closed THEN reason END AS pending_missing FROM o""",
}
