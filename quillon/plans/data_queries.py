"""Data quality, charts, retrieval, sessions and evaluation over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.catalog import load_catalog
from quillon.functions import text as T
from quillon.operators import charts, evaluation, quality, sessions, similarity
from quillon.operators.validation import Contract, validate
from quillon.plans.retrieval import retrieve
from quillon.plans.routing import contracts, once, route
from quillon.sources.tables import TABLES, Star, load
from quillon.streaming import events as stream

TERM = "that the"
#: Questions that exercise the router: text, whether a result is known, metrics, dimensions, grain, first and last day, reason.
QUESTIONS = [
    ("gmv by month in 2017", False, "gmv", "", "month", "2017-01-01", "2017-12-31", "answerable"),
    ("orders by category", False, "paid_order_count", "category", None, None, None, "answerable"),
    ("average delivery days by category", False, "average_delivery_days", "category", None, None, None, "dimension_policy"),
    ("delete all orders", False, "paid_order_count", "", None, None, None, "unauthorized"),
    ("what is gmv", False, "gmv", "", None, None, None, "definition"),
    ("", False, "", "", None, None, None, "empty"),
    ("hello", False, "", "", None, None, None, "missing_metric"),
    ("gmv year over year", False, "gmv", "", None, None, None, "answerable"),
    ("sales and orders by state weekly", False, "paid_order_count,gmv", "customer_state", "week", None, None, "answerable"),
    ("positive review rate by language", False, "positive_review_rate", "lang", None, None, None, "answerable"),
    ("help", False, "", "", None, None, None, "help"),
    ("this result by month", True, "", "", "month", None, None, "followup_new_scope"),
    ("why so high", True, "", "", None, None, None, "followup"),
    ("why so high", False, "", "", None, None, None, "followup_without_result"),
    ("what is churn", False, "", "", None, None, None, "general_definition"),
    ("how can we improve good reviews", False, "positive_review_rate", "", None, None, None, "general_business"),
    ("gmv last month", False, "gmv", "", None, None, None, "missing_time"),
    ("highest gmv", False, "gmv", "", None, None, None, "missing_comparison"),
    ("forecast the gmv of next year", False, "gmv", "", None, None, None, "unsupported"),
    ("gmv growth compared with 2016", False, "gmv", "", None, "2016-01-01", "2016-12-31", "answerable"),
]
#: Questions, failures and raw cells that are dealt out over whole tables by id.
FAILURES = ("ERROR: column x.y does not exist", "canceling statement due to statement timeout", "[TABLE_OR_VIEW_NOT_FOUND] t", "permission denied for table a", "[PARSE_SYNTAX_ERROR] near x", "something else", "could not connect to server")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw release would hold them: text, some of it empty, padded, or unreadable."""
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"),
        F.when(k % 7 == 0, "").when(k % 11 == 0, F.concat(k.cast("string"), F.lit("x"))).otherwise(k.cast("string")).alias("n"),
        F.when(k % 13 == 0, "1.2.3").otherwise(F.concat((k % 1000).cast("string"), F.lit("."), F.lpad((k * 5 % 1000).cast("string"), 3, "0"), F.lit("00"))).alias("amount"),
        F.when(k % 17 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("seen_at"),
        F.concat(F.lit(" "), F.lower(F.substring("o_orderpriority", 3, F.when(k % 19 == 0, 3).otherwise(2))), F.lit(" ")).alias("state"),
    )


def _early_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter("o_orderdate < TIMESTAMP '1998-01-01'").select(F.col("o_orderkey").alias("l_orderkey"))


def _split_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return quality.split_by_parent(load(spark, sf_dir, "lineitem"), _early_orders(spark, sf_dir), "l_orderkey", "missing_fact_order")


def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")]
    parts = [load(spark, sf_dir, c).select(F.col(k).alias("k")).join(load(spark, sf_dir, p).select(F.col(pk).alias("k")), "k", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(f"{c}.{k}").alias("key"), "orphans") for c, k, p, pk in pairs]
    return reduce(DataFrame.unionByName, parts)


def rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check(load(spark, sf_dir, "lineitem"), {"price_not_negative": F.col("l_extendedprice") >= 0, "discount_below_one": F.col("l_discount").between(0, 1), "known_status": F.col("l_linestatus").isin("O", "F"), "quantity_positive": F.col("l_quantity") > 0, "line_number_small": F.col("l_linenumber") <= 5})


def _asked(df: DataFrame, key: str) -> DataFrame:
    """The query set of a search: rows whose id is divisible by 50."""
    return df.filter(F.col(key) % 50 == 0)


def _nearest(measure: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = load(spark, sf_dir, "embeddings")
        return similarity.nearest(v, _asked(v, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), measure, 10)

    return query


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All score conventions over the distance to every query vector."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = similarity.pair_values(v, _asked(v, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    d = 1 - F.col("value")
    return both.select("query_id", "vec_id", *[F.round(f(d), 5).alias(n) for n, f in similarity.SCORES.items()])


def text_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("memory_id"), similarity.words(F.col("text")).alias("w"))
    both = similarity.in_blocks(words, _asked(words, "memory_id").select(F.col("memory_id").alias("query_id"), F.col("w").alias("q")))
    scored = both.select("query_id", "memory_id", F.round(similarity.jaccard(F.col("w"), F.col("q")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))).filter("rank <= 10")


def text_search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = load(spark, sf_dir, "documents").withColumn("snippet", T.snippet(F.col("text"), TERM)).filter("snippet IS NOT NULL")
    return hit.select("doc_id", "snippet").orderBy("doc_id").limit(20)


def context_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sessions.trim_context(load(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL"), 1200, 5)
    return kept.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min("turn").alias("first_turn"), F.sum(F.char_length("text")).alias("chars"))


def runs_and_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: events by kind with FILTER aggregates, beside the user's last purchase, if any."""
    ev = load(spark, sf_dir, "events")
    counts = ev.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("max_click"))
    last = sessions.latest(ev.filter("event_type = 'purchase'").select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", F.col("event_id").alias("last_purchase"))
    return counts.join(last, "user_id", "left")


def redacted_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("api_key"), F.col("props"), F.lit("kind"), F.col("event_type"), F.lit("User_Token"), F.col("user_id").cast("string")).alias("m"))
    m = T.redact(F.col("m"))
    return ev.select("event_id", *[F.element_at(m, k).alias(k.lower()) for k in ("api_key", "kind", "User_Token")])


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a case of a variant (its type) with scores made from its value."""
    tokens, limit = F.col("event_id") % 1000, F.col("event_id") % 30 + 10
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("variant"), F.col("event_id").alias("case_id"), F.col("props").alias("message"), evaluation.efficiency_score(F.col("value"), tokens, 20.0, 600, limit).alias("score"),
        F.col("value").alias("millis"), tokens.alias("tokens"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("user_id") % 3).alias("trajectory"),
    )


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report(eval_results(spark, sf_dir), ["variant"])


def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = eval_report(spark, sf_dir)
    return reduce(DataFrame.unionByName, [evaluation.best_variant(r, m).select(F.lit(m).alias("metric"), "best_variant") for m in ("score", "time", "pass_rate")])


def trajectory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of neighbouring benchmark items as expected, actual and forbidden tool calls."""
    b = load(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t"))
    beside = lambda k, name: b.select((F.col("item_id") - k).alias("item_id"), F.col("t").alias(name))
    j = b.join(beside(1, "u"), "item_id").join(beside(2, "v"), "item_id")
    tools = lambda c: F.split(c, " ")
    return j.select("item_id", evaluation.trajectory_score(tools("t"), tools("v"), tools("u")).alias("trajectory"), evaluation.output_score(F.col("t"), F.array(F.lit("the"), F.lit("OF ")), F.array(F.lit("zz"), F.lit("of the"))).alias("output"))


def raw_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, bad = quality.convert(_raw(spark, sf_dir), {"n": ("n", T.strict_int), "amount": ("amount", T.strict_decimal), "seen_at": ("seen_at", T.strict_timestamp), "state": ("state", T.strict_state), "id": ("id", None)}, "v1")
    good = ok.select(F.col("id").cast("long").alias("id"), F.col("n").cast("long").alias("n"), F.col("amount").cast("double").alias("amount"), F.col("seen_at").cast("string").alias("seen_at"), "state", F.lit("").alias("bad"))
    return good.unionByName(bad.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("seen_at"), F.lit(None).cast("string").alias("state"), F.array_join("bad_columns", ",").alias("bad")))


def _asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks one of QUESTIONS, by its id."""
    k = F.col("event_id")
    return load(spark, sf_dir, "events").select(k.alias("id"), _pick([q[0] for q in QUESTIONS], k).alias("question"), F.when(_pick([q[1] for q in QUESTIONS], k), "gmv was 5").alias("summary"))


def _routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal questions are routed once."""
    return once(_asked_questions(spark, sf_dir), ["question", "summary"], lambda q: route(q, load_catalog(), result=F.col("summary")))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _routed_questions(spark, sf_dir)
    return q.select("id", F.array_join("metric_ids", ",").alias("metrics"), F.array_join("dimensions", ",").alias("dimensions"), "grain", F.col("range.start").alias("first_day"), F.col("range.end").alias("last_day"), "reason")


def question_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = contracts(_routed_questions(spark, sf_dir), load_catalog()).filter("contract IS NOT NULL")
    return q.select("id", F.array_join("contract.required", ",").alias("required"), F.col("contract.start").alias("first_day"), F.array_join("contract.warnings", ",").alias("warnings"))


def catalog_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks one of QUESTIONS; what of the catalog it needs."""
    r = once(_asked_questions(spark, sf_dir), ["question"], lambda q: retrieve(q, load_catalog()))
    return r.select("id", F.array_join("metrics", ",").alias("metrics"), F.array_join("tables", ",").alias("tables"), F.array_join("joins", ",").alias("joins"), "reason")


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on three results: a good one, one whose item join multiplied orders, and an empty one."""
    star = Star(spark, sf_dir)
    orders, items = star.orders(), star.items()
    out = [
        ("good", validate(orders, Contract(("order_id", "ordered_at"), ("customer_id",), "ordered_at", max_rows=10**9, grain=("order_id",)))),
        ("multiplied", validate(items, Contract(("order_id",), ("price",), max_rows=10**9, grain=("order_id",)))),
        ("empty", validate(orders.filter("false"), Contract(("order_id",), ("customer_id",)))),
        ("missing", validate(orders, Contract(("nothing",)))),
    ]
    return spark.createDataFrame([(n, v.state, v.reason) for n, v in out], "name string, state string, reason string")


def ui_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of customer in which any column holds 'mach' (case ignored), balance first, nulls last, a page of 100."""
    c = load(spark, sf_dir, "customer")
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(x).cast("string"), F.lit(""))).contains("mach") for x in c.columns])
    return c.filter(hit).orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(100).select("c_custkey", "c_acctbal", "c_mktsegment")


def formatted_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", "value", F.element_at(F.array(*[F.lit(x) for x in ("positive_review_rate", "average_delivery_days", "paid_order_count", "gmv")]), (F.col("event_id") % 4 + 1).cast("int")).alias("metric_id"))
    return rows.select("event_id", T.format_value(F.col("metric_id"), F.when(F.col("event_id") % 10 != 0, F.floor("value"))).alias("shown"))


def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event fails in one of the ways of FAILURES, by its id."""
    df = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.error_category(F.concat(_pick(FAILURES, F.col("event_id")), F.lit(" at event "), F.col("event_id"))).alias("c"))
    return df.select("id", "c.category", "c.retryable")


def question_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias scores of benchmark items against two aliases, and their tokens' fingerprint."""
    b = load(spark, sf_dir, "benchmark")
    return b.select("item_id", F.round(T.alias_score(F.col("text"), F.lit("of the")), 6).alias("phrase"), F.round(T.alias_score(F.col("text"), F.lit("the that of")), 6).alias("words"), F.size(T.mixed_tokens(F.col("text"))).alias("tokens"), T.fingerprint(F.col("text")).alias("fingerprint"))


def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").withColumn("tokens", F.char_length("text") / 4.0)
    return sessions.pack_context(c, "conv_id", "turn", "tokens", 150.0).groupBy("conv_id").agg(F.count("*").alias("snippets"), F.sum("tokens").alias("tokens"))


def budget_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = sessions.within_budget(load(spark, sf_dir, "events"), "user_id", "event_type", "event_id", {"click": 4, "purchase": 2, "error": 1})
    return ev.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    new = c.filter("turn < 3").withColumn("turn", F.col("turn") + 1).withColumn("role", F.lit("new")).dropDuplicates(["conv_id", "turn"])
    return sessions.upsert(c, new, ["conv_id", "turn"]).groupBy("role").agg(F.count("*").alias("rows"))


def training_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL, documentation and dialogue examples in one frame, by kind."""
    a = load(spark, sf_dir, "benchmark").select(F.lit("sql").alias("kind"), F.col("item_id").alias("id"), F.col("text").alias("question"))
    b = load(spark, sf_dir, "documents").select(F.lit("documentation").alias("kind"), F.col("doc_id").alias("id"), "lang")
    c = load(spark, sf_dir, "conversations").select(F.lit("dialogue").alias("kind"), F.col("conv_id").alias("id"), F.col("text").alias("question"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count("*").alias("rows"), F.count("question").alias("questions"), F.countDistinct("lang").alias("langs"))


def golden_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    changed = n.withColumn("n_regionkey", F.when(F.col("n_nationkey") % 7 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey"))).filter("n_nationkey != 3")
    return evaluation.golden_diff(n, changed, "n_nationkey", ["n_name", "n_regionkey"])


QUERIES = {
    "orphan_counts": orphan_counts,
    "items_accepted": lambda s, d: _split_items(s, d)[0].agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("orders")),
    "items_rejected": lambda s, d: _split_items(s, d)[1].groupBy("rejection_reason").agg(F.count("*").alias("rows")),
    "dup_keys": lambda s, d: quality.duplicate_keys(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "row_counts": lambda s, d: quality.row_counts({t: load(s, d, t) for t in TABLES}),
    "rule_checks": rule_checks,
    "invalid_ship_dates": lambda s, d: Star(s, d).items().filter("shipped_at < ordered_at").agg(F.count("*").alias("lines"), F.countDistinct("order_id").alias("orders")),
    "raw_converted": raw_converted,
    "chart_bar": lambda s, d: charts.bar(load(s, d, "events"), "event_type", "value").select("event_type", F.round("value", 2).alias("value")),
    "chart_grouped_counts": lambda s, d: charts.grouped_counts(load(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
    "chart_value_counts": lambda s, d: charts.value_counts(load(s, d, "orders"), "o_orderpriority"),
    "chart_corr": lambda s, d: charts.chart_spec(load(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"))[1],
    "chart_histogram": lambda s, d: charts.chart_spec(load(s, d, "customer").select("c_acctbal"))[1].select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count"),
    "vector_cosine_topk": _nearest("cosine"),
    "vector_l2_topk": _nearest("l2"),
    "vector_dot_topk": _nearest("dot"),
    "vector_scores": vector_scores,
    "rank_score": lambda s, d: similarity.rank_score(_nearest("cosine")(s, d)).select("query_id", "vec_id", "rank", "score"),
    "text_jaccard_topk": text_jaccard_topk,
    "text_memory_search": lambda s, d: similarity.similar_texts(load(s, d, "benchmark").select(F.col("item_id").alias("memory_id"), F.col("text").alias("question")), "The that of and to in", limit=5, threshold=0.05).select("memory_id", "rank"),
    "text_match_topk": lambda s, d: similarity.text_match(load(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "the that queue of"),
    "text_search_snippets": text_search_snippets,
    "phase_timing": lambda s, d: sessions.phase_timing(load(s, d, "events"), "event_type", "value", "event_id"),
    "label_counts": lambda s, d: evaluation.label_counts(load(s, d, "labels"), ["quality", "toxic"]),
    "recent_events_page": lambda s, d: sessions.newest(load(s, d, "events").select("event_id", "user_id", "event_type"), "event_id", 20, 40),
    "audit_by_user": lambda s, d: sessions.visible_audits(load(s, d, "events"), 8, "analyst").groupBy("event_type").agg(F.count("*").alias("events")),
    "audit_by_admin": lambda s, d: sessions.visible_audits(load(s, d, "events"), 8, "admin").groupBy("event_type").agg(F.count("*").alias("events")),
    "runs_and_audits": runs_and_audits,
    "sensitive_redaction": redacted_props,
    "context_trim": context_trim,
    "packed_context": packed_context,
    "budget_replay": budget_replay,
    "upserted": upserted,
    "newest_kept": lambda s, d: sessions.keep_newest(load(s, d, "events").select("event_id", "ts"), "event_id", 100).agg(F.count("*").alias("rows"), F.min("event_id").alias("oldest")),
    "memory_stats": lambda s, d: sessions.memory_stats(load(s, d, "events").withColumn("ok", F.col("event_type") != "error"), "event_type", "user_id", "ok"),
    "memories_left": lambda s, d: sessions.clear_memories(load(s, d, "events").select("event_id", F.col("event_type").alias("tool_name"), F.col("ts").alias("created_at")), "click", "2024-01-10").groupBy("tool_name").agg(F.count("*").alias("rows")),
    "training_union": training_union,
    "eval_report": eval_report,
    "eval_cases": lambda s, d: evaluation.case_table(eval_results(s, d), ["trajectory"]),
    "best_variants": best_variants,
    "trajectory_scores": trajectory_scores,
    "golden_differences": golden_differences,
    "routed_questions": routed,
    "question_contracts": question_contracts,
    "catalog_context": catalog_context,
    "validated_results": validated,
    "ui_search": ui_search,
    "formatted_values": formatted_overview,
    "error_categories": error_categories,
    "question_scores": question_scores,
    "events_tumbling": lambda s, d: stream.tumbling(load(s, d, "events")),
    "events_sliding": lambda s, d: stream.sliding(load(s, d, "events")),
    "events_sessions": lambda s, d: stream.sessions(load(s, d, "events")),
}

_EV = "VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in (i, *r)) + ")" for i, (_, _, *r) in enumerate(QUESTIONS))
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
_VEC = f"""(SELECT query_id, vec_id, dot, dot / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('q', 'q')})) AS cosine, l2 FROM (
  SELECT query_id, vec_id, embedding, q, {_DOT.format('embedding', 'q')} AS dot,
    sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) ** 2))) AS l2
  FROM embeddings, (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)))"""
_W = "list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))"
_EVAL = "(SELECT event_type AS variant, event_id AS case_id, props, user_id % 3 AS trajectory, event_type = 'error' AS failed, round(1 - CASE WHEN value > 20 THEN 0.33 ELSE 0 END - CASE WHEN event_id % 1000 > 600 THEN 0.33 ELSE 0 END - CASE WHEN value > event_id % 30 + 10 THEN 0.34 ELSE 0 END, 6) AS score, value AS millis, event_id % 1000 AS tokens FROM events)"
_REPORT = f"(SELECT variant, count(*) AS cases, round(avg(CAST(score >= 0.7 AS INT)), 6) AS pass_rate, round(avg(CAST(score AS DOUBLE)), 6) AS avg_score, round(avg(millis), 6) AS avg_millis, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM {_EVAL} GROUP BY 1)"
#: Exchanges of conversations from the newest on, folded one by one: the first stays, others if they fit.
_TRIM = """WITH RECURSIVE m AS (
  SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS exchange, length(coalesce(text, '')) + 16 AS cost FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT conv_id, exchange, sum(cost) AS cost, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY exchange DESC) AS r FROM m GROUP BY 1, 2
), f AS (
  SELECT conv_id, exchange, r, true AS kept, cost AS chars, n AS many FROM t WHERE r = 1
  UNION ALL
  SELECT t.conv_id, t.exchange, t.r, chars + cost <= 1200 AND many + n <= 5, CASE WHEN chars + cost <= 1200 AND many + n <= 5 THEN chars + cost ELSE chars END, CASE WHEN chars + cost <= 1200 AND many + n <= 5 THEN many + n ELSE many END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1
), k AS (
  SELECT m.*, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS many FROM m JOIN f USING (conv_id, exchange) WHERE kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), a AS (
  SELECT *, coalesce(max(place) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id), 1) AS asked, coalesce(max(place) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id), many) AS answered FROM k
), c AS (
  SELECT *, CASE WHEN many > 5 AND place = asked THEN 0 ELSE place END AS seat FROM a WHERE many <= 5 OR place IN (asked, answered)
), b AS (
  SELECT *, sum(cost) OVER (PARTITION BY conv_id) AS total, sum(cost) OVER (PARTITION BY conv_id ORDER BY seat ROWS UNBOUNDED PRECEDING) - cost AS before FROM c
)
SELECT conv_id, count(*) AS messages, min(turn) AS first_turn, CAST(sum(CASE WHEN total > 1200 THEN least(length(text), greatest(1200 - before - 16, 0)) ELSE length(text) END) AS BIGINT) AS chars FROM b GROUP BY 1"""
_PACK = """WITH RECURSIVE t AS (
  SELECT conv_id, length(text) / 4.0 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations
), f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS r, CAST(0 AS DOUBLE) AS total, 0 AS n FROM t WHERE r = 1
  UNION ALL
  SELECT t.conv_id, t.r, CASE WHEN total + tokens < 150 THEN total + tokens ELSE total END, CASE WHEN total + tokens < 150 THEN n + 1 ELSE n END FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.r = f.r + 1
)
SELECT conv_id, CAST(max(n) AS BIGINT) AS snippets, max(total) AS tokens FROM f GROUP BY 1 HAVING max(n) > 0"""
_ODD = "(CAST(o_orderkey * 5 % 1000 AS BIGINT) + 1000 * (o_orderkey % 1000))"
_BAD = "concat_ws(',', CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN 'n' END, CASE WHEN o_orderkey % 13 = 0 THEN 'amount' END, CASE WHEN o_orderkey % 17 = 0 THEN 'seen_at' END, CASE WHEN NOT regexp_full_match(s, '[A-Z]{2}') THEN 'state' END)"


def _topk(measure: str, order: str) -> str:
    return f"SELECT query_id, vec_id, value, row_number() OVER (PARTITION BY query_id ORDER BY value {order}, vec_id) AS rank FROM (SELECT query_id, vec_id, round({measure}, 6) AS value FROM {_VEC}) QUALIFY rank <= 10"


ORACLES = {
    "orphan_counts": " UNION ALL ".join(f"SELECT '{c}.{k}' AS key, count(*) AS orphans FROM {c} WHERE NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.{pk} = {c}.{k})" for c, k, p, pk in [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")]),
    "items_accepted": "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')",
    "items_rejected": "SELECT 'missing_fact_order' AS rejection_reason, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')",
    "dup_keys": "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES),
    "rule_checks": " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT ({c})) AS violations FROM lineitem" for n, c in {"price_not_negative": "l_extendedprice >= 0", "discount_below_one": "l_discount BETWEEN 0 AND 1", "known_status": "l_linestatus IN ('O', 'F')", "quantity_positive": "l_quantity > 0", "line_number_small": "l_linenumber <= 5"}.items()),
    "invalid_ship_dates": "SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate",
    "raw_converted": f"SELECT o_orderkey AS id, CASE WHEN bad = '' AND o_orderkey % 7 <> 0 THEN o_orderkey END AS n, CASE WHEN bad = '' THEN ({_ODD} // 10 + CASE WHEN {_ODD} % 10 > 5 OR ({_ODD} % 10 = 5 AND {_ODD} // 10 % 2 = 1) THEN 1 ELSE 0 END) / CAST(100 AS DOUBLE) END AS amount, CASE WHEN bad = '' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS seen_at, CASE WHEN bad = '' THEN s END AS state, bad FROM (SELECT *, {_BAD} AS bad FROM (SELECT *, trim(upper(substr(o_orderpriority, 3, CASE WHEN o_orderkey % 19 = 0 THEN 3 ELSE 2 END))) AS s FROM orders))",
    "chart_bar": "SELECT event_type, round(sum(value), 2) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "chart_grouped_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2",
    "chart_value_counts": "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1",
    "chart_corr": " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")),
    "chart_histogram": "WITH e AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 10 AS w FROM customer), b AS (SELECT CAST(least(floor((c_acctbal - lo) / w) + 1, 10) AS INT) AS bin, lo, w FROM customer, e) SELECT bin, round(lo + (bin - 1) * w, 6) AS low, round(lo + bin * w, 6) AS high, count(*) AS count FROM b GROUP BY bin, lo, w",
    "vector_cosine_topk": _topk("cosine", "DESC"),
    "vector_l2_topk": _topk("l2", "ASC"),
    "vector_dot_topk": _topk("dot", "DESC"),
    "vector_scores": f"SELECT query_id, vec_id, round(1 / (1 + d), 5) AS inverse_distance, round(1 - d, 5) AS one_minus, round(greatest(0.0, 1 - d), 5) AS clipped, round(least(d / 10, 1.0), 5) AS tenth, round(d, 5) AS raw FROM (SELECT query_id, vec_id, 1 - cosine AS d FROM {_VEC})",
    "rank_score": f"SELECT query_id, vec_id, rank, greatest(round(1 - CAST(0.1 AS DOUBLE) * (rank - 1), 6), 0.0) AS score FROM ({_topk('cosine', 'DESC')})",
    "text_jaccard_topk": f"SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM (SELECT query_id, item_id AS memory_id, round(CAST(len(list_intersect(w, q)) AS DOUBLE) / len(list_distinct(list_concat(w, q))), 6) AS score FROM (SELECT item_id, {_W} AS w FROM benchmark), (SELECT item_id AS query_id, {_W} AS q FROM benchmark WHERE item_id % 50 = 0)) QUALIFY rank <= 10",
    "text_search_snippets": f"SELECT doc_id, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(text, b, e - b) || CASE WHEN e <= length(text) THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, text, greatest(instr(lower(text), '{TERM}') - 60, 1) AS b, least(instr(lower(text), '{TERM}') + {len(TERM)} + 60, length(text) + 1) AS e FROM documents WHERE instr(lower(text), '{TERM}') > 0) ORDER BY doc_id LIMIT 20",
    "text_match_topk": "WITH d AS (SELECT item_id AS doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS w FROM benchmark), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), h AS (SELECT doc_id, len(w) AS l, t, len(list_filter(w, lambda x: x = t)) AS tf FROM d, (SELECT unnest(['the', 'that', 'queue', 'of']) AS t)), f AS (SELECT t, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l / a))), 6) AS score FROM h JOIN f USING (t), s WHERE tf > 0 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 5",
    "phase_timing": "SELECT event_type, count(*) AS count, round(sum(value), 2) AS total, max_by(value, event_id) AS last, max(value) AS longest FROM events GROUP BY 1",
    "label_counts": "SELECT 'quality' AS field, coalesce(CAST(quality AS VARCHAR), 'NA') AS label, count(*) AS count FROM labels GROUP BY 1, 2 UNION ALL SELECT 'toxic', coalesce(CAST(toxic AS VARCHAR), 'NA'), count(*) FROM labels GROUP BY 1, 2",
    "recent_events_page": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 20 OFFSET 40",
    "audit_by_user": "SELECT event_type, count(*) AS events FROM events WHERE user_id = 8 GROUP BY 1",
    "audit_by_admin": "SELECT event_type, count(*) AS events FROM events GROUP BY 1",
    "runs_and_audits": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) FILTER (WHERE event_type = 'click') AS max_click, max(event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase FROM events GROUP BY 1",
    "sensitive_redaction": "SELECT event_id, '[REDACTED]' AS api_key, event_type AS kind, '[REDACTED]' AS user_token FROM events",
    "packed_context": _PACK,
    "budget_replay": "SELECT user_id, count(*) FILTER (WHERE r <= lim) AS allowed, count(*) FILTER (WHERE r > lim) AS denied FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r, CASE event_type WHEN 'click' THEN 4 WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS lim FROM events) GROUP BY 1",
    "upserted": "WITH n AS (SELECT DISTINCT conv_id, turn + 1 AS turn FROM conversations WHERE turn < 3) SELECT role, count(*) AS rows FROM (SELECT role FROM conversations UNION ALL SELECT 'new' FROM n WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = n.conv_id AND c.turn = n.turn)) GROUP BY 1",
    "newest_kept": "SELECT count(*) AS rows, min(event_id) AS oldest FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100)",
    "memory_stats": "SELECT count(*) AS total, count(DISTINCT event_type) AS tools, count(DISTINCT user_id) AS questions, round(avg(CAST(event_type <> 'error' AS INT)), 6) AS success_rate, (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_used FROM events",
    "memories_left": "SELECT event_type AS tool_name, count(*) AS rows FROM events WHERE NOT (event_type IS NOT DISTINCT FROM 'click' AND (ts IS NULL OR ts < TIMESTAMP '2024-01-10')) GROUP BY 1",
    "training_union": "SELECT 'sql' AS kind, count(*) AS rows, count(text) AS questions, CAST(0 AS BIGINT) AS langs FROM benchmark UNION ALL SELECT 'documentation', count(*), 0, count(DISTINCT lang) FROM documents UNION ALL SELECT 'dialogue', count(*), count(text), 0 FROM conversations",
    "eval_report": f"SELECT * FROM {_REPORT}",
    "eval_cases": f"SELECT variant, case_id, substr(props, 1, 50) AS message, score >= 0.7 AS passed, CAST(score AS DOUBLE) AS score, millis, tokens, CASE WHEN failed THEN 'failed' ELSE '' END AS error, '{{\"trajectory\":' || trajectory || '}}' AS evaluator_scores FROM {_EVAL}",
    "context_trim": _TRIM,
    "best_variants": " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT variant FROM {_REPORT} ORDER BY {c}, variant LIMIT 1) AS best_variant" for m, c in {"score": "-avg_score", "time": "avg_millis", "pass_rate": "-pass_rate"}.items()),
    "trajectory_scores": "WITH j AS (SELECT b.item_id, lower(b.text) AS t, string_split(lower(b.text), ' ') AS e, string_split(lower(o.text), ' ') AS a, string_split(lower(x.text), ' ') AS x FROM benchmark b JOIN benchmark o ON o.item_id = b.item_id + 1 JOIN benchmark x ON x.item_id = b.item_id + 2) SELECT item_id, greatest(round(1 - CAST(0.5 AS DOUBLE) * (len(list_filter(e, lambda w: NOT list_contains(a, w))) / CAST(len(e) AS DOUBLE)) - CAST(0.5 AS DOUBLE) * (len(list_filter(x, lambda w: list_contains(a, w))) / CAST(len(x) AS DOUBLE)), 6), 0.0) AS trajectory, round((CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'of ') AS INT) + CAST(NOT contains(t, 'zz') AS INT) + CAST(NOT contains(t, 'of the') AS INT)) / CAST(4 AS DOUBLE), 6) AS output FROM j",
    "golden_differences": "SELECT CAST(n_nationkey AS INT) AS key, 'n_regionkey' AS field, CAST(n_regionkey AS VARCHAR) AS expected, CASE WHEN n_nationkey = 3 THEN NULL ELSE CAST(n_regionkey + 1 AS VARCHAR) END AS actual FROM nation WHERE n_nationkey % 7 = 0 OR n_nationkey = 3 UNION ALL SELECT n_nationkey, 'n_name', n_name, NULL FROM nation WHERE n_nationkey = 3",
    "routed_questions": f"SELECT event_id AS id, metrics, dimensions, grain, first_day, last_day, reason FROM events JOIN ({_EV}) t(k, metrics, dimensions, grain, first_day, last_day, reason) ON event_id % {len(QUESTIONS)} = k",
    "question_contracts": f"SELECT event_id AS id, concat_ws(',', nullif(metrics, ''), nullif(dimensions, ''), CASE WHEN grain IS NOT NULL THEN 'time' END) AS required, first_day, concat_ws(',', CASE WHEN first_day IS NULL THEN 'no_time_range' END, CASE WHEN contains(metrics, ',') AND dimensions <> '' THEN 'dimensions_shared_by_metrics' END) AS warnings FROM events JOIN ({_EV}) t(k, metrics, dimensions, grain, first_day, last_day, reason) ON event_id % {len(QUESTIONS)} = k WHERE reason IN ('answerable', 'followup_new_scope')",
    "validated_results": "SELECT 'good' AS name, CASE WHEN max(c) > 1 THEN 'refuse' WHEN count(*) = 0 THEN 'needs_clarification' ELSE 'valid' END AS state, CASE WHEN max(c) > 1 THEN 'join_multiplied_rows' WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS reason FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey) UNION ALL SELECT 'multiplied', CASE WHEN max(c) > 1 THEN 'refuse' ELSE 'valid' END, CASE WHEN max(c) > 1 THEN 'join_multiplied_rows' ELSE 'ok' END FROM (SELECT count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey) UNION ALL SELECT 'empty', CASE WHEN count(*) = 0 THEN 'needs_clarification' ELSE 'valid' END, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END FROM orders WHERE false UNION ALL SELECT 'missing', 'refuse', 'missing_column:nothing' FROM (SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders' AND column_name = 'nothing' HAVING count(*) = 0)",
    "ui_search": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE lower(c_mktsegment) LIKE '%mach%' OR lower(c_name) LIKE '%mach%' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 100",
    "formatted_values": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'no data' WHEN event_id % 4 = 0 THEN printf('%.2f', floor(value) * 100) || '%' WHEN event_id % 4 = 1 THEN printf('%.2f', floor(value)) || ' days' WHEN event_id % 4 = 2 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', floor(value)) END AS shown FROM events",
    "error_categories": "SELECT event_id AS id, list_extract(['unknown_column', 'timeout', 'unknown_table', 'permission', 'syntax', 'unknown', 'connection'], event_id % 7 + 1) AS category, event_id % 7 IN (0, 2, 4) AS retryable FROM events",
    "question_scores": "WITH t AS (SELECT item_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+|[一-鿿]+')) AS w FROM benchmark) SELECT item_id, round(CASE WHEN contains(lower(text), 'of the') THEN 2.0 + 6 / 16.0 WHEN list_has_all(w, ['of', 'the']) THEN 0.75 + 6 / 48.0 ELSE 0 END, 6) AS phrase, round(CASE WHEN contains(lower(text), 'the that of') THEN 2.0 + 11 / 16.0 WHEN list_has_all(w, ['of', 'the', 'that']) THEN 0.75 + 11 / 48.0 ELSE 0 END, 6) AS words, CAST(len(w) AS INT) AS tokens, substr(sha256(text), 1, 16) AS fingerprint FROM t",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS window_start, event_type, count(*) AS events FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2",
    "events_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM b GROUP BY user_id, s",
}
