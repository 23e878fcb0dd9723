"""Metric queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import metrics
from quillon.sources.tables import CATEGORY_NAMES, Star, load


def _metrics(*ids: str, **how):
    return lambda spark, sf_dir: metrics.query(Star(spark, sf_dir), list(ids), **how)


def top_customers_by_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten customers with the largest discounted sales; ties go to the smaller name. Items meet orders before customers, on keys only."""
    amount = F.sum(F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(6,2)")))
    by_customer = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(amount.alias("amount"))
    named = by_customer.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_name").alias("customer_name")).agg(F.sum("amount").cast("double").alias("total_sales"))
    return named.orderBy(F.desc("total_sales"), "customer_name").limit(10)


def _ranked_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top five states by orders as one text, in order of rank."""
    top = metrics.query(Star(spark, sf_dir), ["paid_order_count"], dims=("customer_state",), top=5)
    rank = F.row_number().over(W.orderBy(F.desc("paid_order_count"), "customer_state"))  # five rows
    ranked = top.withColumn("rank", rank)
    return ranked.agg(F.expr("listagg(concat(customer_state, ':', paid_order_count), ',') WITHIN GROUP (ORDER BY rank)").alias("ranked"))


def _seller_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by seller shown as ranks and states: grouped by the sensitive id inside, which is not shown."""
    star = Star(spark, sf_dir)
    sold = star.items().filter(~F.col("order_status").isin(*metrics.EXCLUDED_STATUS)).groupBy("seller_id").agg(F.sum("price").cast("double").alias("gmv"))
    top = sold.join(star.sellers(), "seller_id").orderBy(F.desc("gmv"), "seller_id").limit(10)
    return top.select(F.row_number().over(W.orderBy(F.desc("gmv"), "seller_id")).alias("rank"), "seller_state", "gmv")


QUERIES = {
    "top_customers_by_sales": top_customers_by_sales,
    "gmv_total": _metrics("gmv"),
    "paid_order_count_total": _metrics("paid_order_count"),
    "avg_delivery_days_total": _metrics("average_delivery_days"),
    "positive_rate_total": _metrics("positive_review_rate"),
    "item_count_total": _metrics("item_count"),
    "avg_order_value_total": _metrics("average_order_value"),
    "on_time_rate_total": _metrics("on_time_delivery_rate"),
    "avg_review_score_by_lang": _metrics("average_review_score", dims=("lang",)),
    "positive_rate_by_source": _metrics("positive_review_rate", dims=("source",)),
    **{f"gmv_by_{g}": _metrics("gmv", grain=g) for g in metrics.GRAINS},
    "gmv_in_1997": _metrics("gmv", grain="month", start="1997-01-01", end="1997-12-31"),
    "orders_by_state_top5": _metrics("paid_order_count", dims=("customer_state",), top=5),
    "orders_by_category_top10": _metrics("paid_order_count", dims=("category",), top=10),
    "gmv_by_state_top10": _metrics("gmv", dims=("customer_state",), top=10),
    "gmv_by_category_top10": _metrics("gmv", dims=("category",), top=10),
    "gmv_by_brand_and_region": _metrics("gmv", dims=("brand", "customer_region")),
    "metric_overview": _metrics("gmv", "paid_order_count", "average_delivery_days", "positive_review_rate"),
    "state_gmv_and_orders": _metrics("gmv", "paid_order_count", dims=("customer_state",)),
    "category_gmv_and_orders": _metrics("gmv", "paid_order_count", dims=("category",)),
    "month_state_gmv_and_orders": _metrics("gmv", "paid_order_count", dims=("customer_state",), grain="month"),
    "avg_order_value_by_month": _metrics("average_order_value", grain="month"),
    "item_count_by_state": _metrics("item_count", dims=("customer_state",)),
    "delivery_and_on_time_by_quarter": _metrics("average_delivery_days", "on_time_delivery_rate", grain="quarter"),
    "gmv_mom": lambda s, d: metrics.compare_periods(Star(s, d), "gmv", "month", "previous_period"),
    "gmv_yoy": lambda s, d: metrics.compare_periods(Star(s, d), "gmv", "month", "year_over_year"),
    "orders_yoy_by_region": lambda s, d: metrics.compare_periods(Star(s, d), "paid_order_count", "quarter", "year_over_year", ("customer_region",)),
    "ranked_state_list": _ranked_list,
    "seller_ranks": _seller_ranks,
}

_EFF = "o_orderstatus NOT IN ('P')"
_ITEMS = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_PRICE = "CAST(l_extendedprice AS DECIMAL(14,2))"
_GMV = f"CAST(sum({_PRICE}) AS DOUBLE) AS gmv"
_CUST = "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
_CAT = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_NAMES.items()) + " ELSE coalesce(p_type, 'uncategorized') END"
_DELIVERED = "(SELECT o.*, shipped FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE shipped >= o_orderdate)"
_DAYS = "round(avg((epoch_us(shipped) - epoch_us(o_orderdate)) / 86400000000.0), 6) AS average_delivery_days"
_ONTIME = "round(avg(CAST(shipped <= o_orderdate + INTERVAL 60 DAY AS INT)), 6) AS on_time_delivery_rate"
_AOV = f"round(CAST(sum({_PRICE}) AS DOUBLE) / count(DISTINCT o_orderkey), 6) AS average_order_value"


def _period(grain: str) -> str:
    return f"CAST(date_trunc('{grain}', o_orderdate) AS DATE) AS period"


def _compare(metric: str, base: str, keys: str, back: str) -> str:
    on = " AND ".join(f"n.{k} = t.{k}" for k in keys.split(", ") if k) + (" AND " if keys else "")
    show = "".join(f"n.{k}, " for k in keys.split(", ") if k)
    return f"WITH m AS ({base}) SELECT {show}n.period, n.{metric}, t.{metric} AS baseline, round((n.{metric} - t.{metric}) / CAST(nullif(t.{metric}, 0) AS DOUBLE), 6) AS change FROM m n LEFT JOIN m t ON {on}n.period = CAST(t.period + INTERVAL {back} AS DATE)"


ORACLES = {
    "top_customers_by_sales": f"SELECT c_name AS customer_name, CAST(sum({_PRICE} * (1 - CAST(l_discount AS DECIMAL(6,2)))) AS DOUBLE) AS total_sales FROM {_ITEMS} JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY total_sales DESC, customer_name LIMIT 10",
    "gmv_total": f"SELECT {_GMV} FROM {_ITEMS} WHERE {_EFF}",
    "paid_order_count_total": f"SELECT count(*) AS paid_order_count FROM orders WHERE {_EFF}",
    "avg_delivery_days_total": f"SELECT {_DAYS} FROM {_DELIVERED}",
    "positive_rate_total": "SELECT round(avg(CAST(quality >= 1 AS INT)), 6) AS positive_review_rate FROM labels WHERE quality BETWEEN 0 AND 1",
    "item_count_total": f"SELECT count(*) AS item_count FROM {_ITEMS}",
    "avg_order_value_total": f"SELECT {_AOV} FROM {_ITEMS} WHERE {_EFF}",
    "on_time_rate_total": f"SELECT {_ONTIME} FROM {_DELIVERED}",
    "avg_review_score_by_lang": "SELECT lang, round(avg(quality), 6) AS average_review_score FROM labels LEFT JOIN documents USING (doc_id) WHERE quality BETWEEN 0 AND 1 GROUP BY 1",
    "positive_rate_by_source": "SELECT source, round(avg(CAST(quality >= 1 AS INT)), 6) AS positive_review_rate FROM labels LEFT JOIN documents USING (doc_id) WHERE quality BETWEEN 0 AND 1 GROUP BY 1",
    **{f"gmv_by_{g}": f"SELECT {_period(g)}, {_GMV} FROM {_ITEMS} WHERE {_EFF} GROUP BY 1" for g in metrics.GRAINS},
    "gmv_in_1997": f"SELECT {_period('month')}, {_GMV} FROM {_ITEMS} WHERE {_EFF} AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1",
    "orders_by_state_top5": f"SELECT n_name AS customer_state, count(*) AS paid_order_count FROM orders {_CUST} WHERE {_EFF} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "orders_by_category_top10": f"SELECT {_CAT} AS category, count(DISTINCT o_orderkey) AS paid_order_count FROM {_ITEMS} LEFT JOIN part ON l_partkey = p_partkey WHERE {_EFF} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "gmv_by_state_top10": f"SELECT n_name AS customer_state, {_GMV} FROM {_ITEMS} {_CUST} WHERE {_EFF} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "gmv_by_category_top10": f"SELECT {_CAT} AS category, {_GMV} FROM {_ITEMS} LEFT JOIN part ON l_partkey = p_partkey WHERE {_EFF} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "gmv_by_brand_and_region": f"SELECT p_brand AS brand, r_name AS customer_region, {_GMV} FROM {_ITEMS} {_CUST} LEFT JOIN part ON l_partkey = p_partkey WHERE {_EFF} GROUP BY 1, 2",
    "metric_overview": f"SELECT * FROM (SELECT {_GMV} FROM {_ITEMS} WHERE {_EFF}), (SELECT count(*) AS paid_order_count FROM orders WHERE {_EFF}), (SELECT {_DAYS} FROM {_DELIVERED}), (SELECT round(avg(CAST(quality >= 1 AS INT)), 6) AS positive_review_rate FROM labels WHERE quality BETWEEN 0 AND 1)",
    "state_gmv_and_orders": f"SELECT customer_state, gmv, paid_order_count FROM (SELECT n_name AS customer_state, {_GMV} FROM {_ITEMS} {_CUST} WHERE {_EFF} GROUP BY 1) FULL JOIN (SELECT n_name AS customer_state, count(*) AS paid_order_count FROM orders {_CUST} WHERE {_EFF} GROUP BY 1) USING (customer_state)",
    "category_gmv_and_orders": f"SELECT {_CAT} AS category, {_GMV}, count(DISTINCT o_orderkey) AS paid_order_count FROM {_ITEMS} LEFT JOIN part ON l_partkey = p_partkey WHERE {_EFF} GROUP BY 1",
    "month_state_gmv_and_orders": f"SELECT customer_state, period, gmv, paid_order_count FROM (SELECT n_name AS customer_state, {_period('month')}, {_GMV} FROM {_ITEMS} {_CUST} WHERE {_EFF} GROUP BY 1, 2) FULL JOIN (SELECT n_name AS customer_state, {_period('month')}, count(*) AS paid_order_count FROM orders {_CUST} WHERE {_EFF} GROUP BY 1, 2) USING (customer_state, period)",
    "avg_order_value_by_month": f"SELECT {_period('month')}, {_AOV} FROM {_ITEMS} WHERE {_EFF} GROUP BY 1",
    "item_count_by_state": f"SELECT n_name AS customer_state, count(*) AS item_count FROM {_ITEMS} {_CUST} GROUP BY 1",
    "delivery_and_on_time_by_quarter": f"SELECT {_period('quarter')}, {_DAYS}, {_ONTIME} FROM {_DELIVERED} GROUP BY 1",
    "gmv_mom": _compare("gmv", f"SELECT {_period('month')}, {_GMV} FROM {_ITEMS} WHERE {_EFF} GROUP BY 1", "", "1 MONTH"),
    "gmv_yoy": _compare("gmv", f"SELECT {_period('month')}, {_GMV} FROM {_ITEMS} WHERE {_EFF} GROUP BY 1", "", "1 YEAR"),
    "orders_yoy_by_region": _compare("paid_order_count", f"SELECT r_name AS customer_region, {_period('quarter')}, count(*) AS paid_order_count FROM orders {_CUST} WHERE {_EFF} GROUP BY 1, 2", "customer_region", "1 YEAR"),
    "ranked_state_list": f"SELECT string_agg(customer_state || ':' || n, ',' ORDER BY n DESC, customer_state) AS ranked FROM (SELECT n_name AS customer_state, count(*) AS n FROM orders {_CUST} WHERE {_EFF} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)",
    "seller_ranks": f"SELECT row_number() OVER (ORDER BY gmv DESC, l_suppkey) AS rank, n_name AS seller_state, gmv FROM (SELECT l_suppkey, {_GMV} FROM {_ITEMS} WHERE {_EFF} GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey ORDER BY gmv DESC, l_suppkey LIMIT 10",
}
