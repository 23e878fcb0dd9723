"""Deterministic routing of questions to metric requests, for a whole table of questions at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.catalog import Catalog
from quillon.functions.text import alias_score, requested_range
from quillon.operators.metrics import METRICS

MIN_SCORE = 1.25
#: Words for dimensions and periods.
DIMENSION_WORDS = {
    "customer_state": ("state", "province", "region", "州", "地区", "省份"),
    "category": ("category", "categories", "品类", "类目"),
    "seller_state": ("seller", "merchant", "卖家", "商家"),
    "segment": ("segment",),
    "lang": ("language",),
}
GRAIN_WORDS = {"day": ("by day", "daily", "per day", "按日", "每日"), "week": ("by week", "weekly", "按周", "每周"), "month": ("by month", "monthly", "per month", "按月", "每月"), "quarter": ("by quarter", "quarterly", "按季", "季度"), "year": ("by year", "yearly", "annual", "按年", "每年")}
BASELINE_WORDS = {"year_over_year": ("year over year", "yoy", "同比"), "previous_period": ("previous period", "mom", "month over month", "环比")}
#: Patterns of questions, in Chinese and English.
UNAUTHORIZED = r"(?i)写入|删除|修改|更新|插入|建表|导出原始|密码|密钥|token|api.?key|information_schema|pg_catalog|app\.|系统表|任意文件|\b(delete|update|drop|insert|truncate|alter|grant|password)\b"
UNSUPPORTED = r"(?i)预测|机器学习训练|自动下单|发起退款|执行脚本|运行 python|运行代码|\b(forecast|predict|train a model|refund|run (a )?script|run code)\b"
HELP = r"(?i)你能做什么|能做什么|怎么用|如何使用|帮助|使用说明|功能介绍|支持哪些|有哪些功能|^/?help$|what can you do"
RESULT_FOLLOWUP = r"(?i)这个结果|该结果|刚才|上面的?(数字|结果|数据)|上一轮|前面查询|为什么这么高|为什么这么低|是否合理|是否正常|结果如何|this result|that result|the last result|why so (high|low)"
DRILLDOWN = r"(?i)按|拆分|展开|下钻|明细|分解|排名|趋势|对比|比较|\bby\b|break down|drill"
DEFINITION = r"(?i)是什么|指什么|含义|定义|统计口径|口径是什么|口径|怎么算|如何计算|definition|\bdefine\b|what is|how is"
DATA_INTENT = r"(?i)概览|多少|数值|统计|查询|分析|趋势|排名|前[一二三四五六七八九十0-9]+|总|平均|比例|数量|金额|按|对比|比较|变化|增长|下降|最好|最高|最低|\b(how many|total|trend|top \d+|compare|by (day|week|month|quarter|year|state|category))\b"
GENERAL_BUSINESS = r"(?i)通常|一般|为什么会|原因|如何提升|怎么提升|最佳实践|建议|策略|经验|怎么理解|业务上|行业|背离|改善|\b(usually|in general|best practice|how (can|do) we improve|advice)\b"
DATA_CONTEXT = r"(?i)当前数据|这份数据|本数据|数据库中|查一下|查当前|实际数据|数据里|数据中|基于当前|结合当前|从结果看|本次结果|本轮结果|in (our|the) data"
DATA_REQUEST = r"(?i)概览|多少|数值|统计|查询|查一下|排名|前[一二三四五六七八九十0-9]+|总|平均|比例|数量|金额|按.{0,10}(州|地区|品类|城市|卖家|月|周|日|年)|同比|环比|\b(how many|total|top \d+|by (day|week|month|quarter|year|state|category))\b"
RELATIVE_TIME = r"(?i)本月|本周|本季度|今年|最近|近[一二三四五六七八九十0-9]+天|上月|上个月|去年|过去|\b(this|last) (week|month|quarter|year)\b|recently"
CAUSE = r"(?i)归因|原因|影响因素|驱动因素|为什么.*(?:下降|增长|变化|异常)|\b(root cause|cause of|reasons? (for|behind)|what drives|driven by)\b"
#: Words that name a baseline themselves (year over year, month over month) need none, so they stand in BASELINE only.
NEEDS_BASELINE = r"(?i)相比|对比|比较|变化|增长|下降|趋势|最好|最高|最低|异常|\b(compare|change|growth|decline|trend|best|highest|lowest)\b"
BASELINE = r"(?i)上月|上个月|去年|同比|环比|与.+相比|year over year|\byoy\b|previous period|month over month|\bmom\b|compared (with|to)"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _named(text: Column, names: dict[str, tuple[str, ...]]) -> Column:
    return F.filter(F.array(*[F.when(_any(text, words), F.lit(n)) for n, words in names.items()]), lambda x: x.isNotNull())


STATES = {
    "answerable": "answerable", "followup_new_scope": "answerable", "definition": "answer_from_catalog", "help": "help", "followup": "answer_from_result", "general_definition": "general_knowledge",
    "general_business": "general_business", "unauthorized": "refuse", "unsupported": "refuse",
}


#: What a question wants, by the reason of its route; an answerable one asks for data, causes, or a definition as well.
INTENTS = {
    "definition": "catalog_definition", "help": "help", "followup": "result_followup", "general_definition": "general_knowledge", "general_business": "general_business", "followup_new_scope": "data_analysis",
    "unauthorized": "unsafe_or_unauthorized", "unsupported": "unsupported", "empty": "unsupported",
}
#: Intents that a question keeps while it is asked back for a period or a baseline.
_OPEN = ("answerable", "missing_time", "missing_comparison")


def needs_period(said: Column, span: Column) -> Column:
    """Whether a question names a relative time and no range."""
    return said.rlike(RELATIVE_TIME) & span.isNull()


def needs_baseline(said: Column) -> Column:
    """Whether a question compares without saying with what."""
    return said.rlike(NEEDS_BASELINE) & ~said.rlike(BASELINE)


def route(
    questions: DataFrame, catalog: Catalog, question: str = "question", result: Column | None = None, period: Column | None = None, comparison: Column | None = None, remembered: Column | None = None
) -> DataFrame:
    """Adds metric_ids (best score first, then id), dimensions, grain, baseline, range, reason, state, intent, plan_type and warnings.

    `result`, `period`, `comparison` and `remembered` are what the conversation knows: a summary of the last result, a period, a baseline, and
    metrics for a question that names none. The first that holds: empty, unauthorized, unsupported, help, follow-up on a result (with a new scope, on a known result, or without one), a definition
    (of a metric, or of something else) without a request for data, general business advice, no metric, a dimension that would multiply the
    metric's rows, a relative time without a period, a comparison without a baseline, else answerable. An answerable question that also
    asks for a definition is a mixed request, one that asks for causes an analysis. Warnings tell of metrics with different time
    columns under a grain, and of dimensions that not all metrics have.
    """
    said = F.trim(F.coalesce(question, F.lit("")))
    q = F.lower(said)
    known = lambda c: F.lit(False) if c is None else F.coalesce(c.cast("string") != "", F.lit(False))
    scores = F.array(*[F.struct((-F.greatest(*[alias_score(q, F.lit(a)) for a in (*names, "\0")])).alias("s"), F.lit(m).alias("m")) for m, names in catalog.aliases.items()])
    metrics = F.transform(F.filter(F.array_sort(scores), lambda x: x["s"] <= -MIN_SCORE), lambda x: x["m"])
    if remembered is not None:
        metrics = F.when(F.size(metrics) > 0, metrics).otherwise(F.coalesce(remembered, F.array().cast("array<string>")))
    allowed = F.create_map(*[x for m in METRICS.values() for x in (F.lit(m.metric_id), F.array(*[F.lit(d) for d in (*m.dimensions, *m.through_items)]))])
    df = questions.withColumns({
        "metric_ids": metrics,
        "dimensions": _named(q, DIMENSION_WORDS),
        "grain": F.get(_named(q, GRAIN_WORDS), F.lit(0)),
        "baseline": F.get(_named(q, BASELINE_WORDS), F.lit(0)),
        "range": requested_range(q),
    })
    wrong = F.exists("metric_ids", lambda m: F.size(F.array_except("dimensions", F.element_at(allowed, m))) > 0)
    rest = F.regexp_replace(said, DEFINITION, "")
    asks = F.when(said.rlike(DRILLDOWN) & said.rlike(DATA_INTENT), "followup_new_scope").otherwise("followup")
    reason = (
        F.when(said == "", "empty").when(said.rlike(UNAUTHORIZED), "unauthorized").when(said.rlike(UNSUPPORTED), "unsupported").when(said.rlike(HELP), "help")
        .when(said.rlike(RESULT_FOLLOWUP), F.when(known(result), asks).otherwise("followup_without_result"))
        .when(said.rlike(DEFINITION) & ~rest.rlike(DATA_INTENT), F.when(F.size("metric_ids") > 0, "definition").otherwise("general_definition"))
        .when(said.rlike(GENERAL_BUSINESS) & ~said.rlike(DATA_CONTEXT) & ~rest.rlike(DATA_REQUEST), "general_business")
        .when(F.size("metric_ids") == 0, F.when(said.rlike(GENERAL_BUSINESS) & ~said.rlike(DATA_CONTEXT), "general_business").otherwise("missing_metric")).when(wrong, "dimension_policy")
        .when(needs_period(said, F.col("range")) & ~known(period), "missing_time").when(needs_baseline(said) & ~known(comparison), "missing_comparison").otherwise("answerable")
    )
    state = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), reason), F.lit("needs_clarification"))
    plan = F.when(state != "answerable", None).when(F.col("baseline").isNotNull(), "comparison").when(F.size("metric_ids") == 1, "single_metric").when((F.size("dimensions") > 0) | F.col("grain").isNotNull(), "grouped_multi_metric").otherwise("scalar_overview")
    known_intent = F.element_at(F.create_map(*[F.lit(x) for pair in INTENTS.items() for x in pair]), reason)
    open_intent = F.when(said.rlike(DEFINITION) & rest.rlike(DATA_INTENT), "mixed_request").when(said.rlike(CAUSE), "data_analysis").otherwise("data_query")
    intent = F.coalesce(known_intent, F.when(reason.isin(*_OPEN), open_intent), F.lit("clarification_required"))
    times = F.create_map(*[F.lit(x) for m in METRICS.values() for x in (m.metric_id, m.time)])
    warnings = F.filter(F.array(
        F.when(F.col("grain").isNotNull() & (F.size(F.array_distinct(F.transform("metric_ids", lambda m: F.element_at(times, m)))) > 1), "selected_metrics_use_different_time_fields"),
        F.when(wrong, "dimension_not_supported_by_all_metrics"),
    ), lambda x: x.isNotNull())
    return df.withColumns({"reason": reason, "state": state, "intent": intent, "plan_type": plan, "warnings": warnings})


def once(rows: DataFrame, columns: list[str], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `answer` adds to the rows, found once for every distinct value of the columns, which must be all that it looks at (null is a value)."""
    asked = rows.select(*[F.col(c).alias(f"__{c}") for c in columns]).distinct()
    answered = answer(asked.select(*[F.col(f"__{c}").alias(c) for c in columns])).withColumnsRenamed({c: f"__{c}" for c in columns})
    return rows.join(answered, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])).drop(*[f"__{c}" for c in columns])


def definitions(routed: DataFrame) -> DataFrame:
    """Adds answer: for definitions, a table of the metrics' names, time columns, and whether unfinished orders are left out; no data is read."""
    line = F.create_map(*[x for m in METRICS.values() for x in (F.lit(m.metric_id), F.lit(f"| {m.label} (`{m.metric_id}`) | {m.time or 'none'} | {'effective orders only' if m.effective_only else 'none'} |"))])
    head = "| Metric | Time column | Default filter |\n| --- | --- | --- |"
    rows = F.array_join(F.concat(F.array(F.lit(head)), F.transform("metric_ids", lambda m: F.element_at(line, m))), "\n")
    return routed.withColumn("answer", F.when(F.col("reason") == "definition", rows))


def contracts(routed: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds contract: what the result of each answerable question must hold.

    Required columns (metrics, dimensions, and time where a time grain is asked for), metric columns, the time column with the names it may
    have, the period, labels of the metrics, the catalog's version, and warnings.
    """
    label = F.create_map(*[x for m in METRICS.values() for x in (F.lit(m.metric_id), F.lit(m.label))])
    timed = F.col("grain").isNotNull()
    names = F.array(*[F.lit(x) for x in ("time", "date", "day", "week", "month", "quarter", "year")])
    warnings = F.filter(F.array(F.when(F.col("range").isNull(), "no_time_range"), F.when((F.size("metric_ids") > 1) & (F.size("dimensions") > 0), "dimensions_shared_by_metrics")), lambda x: x.isNotNull())
    contract = F.struct(
        F.concat("metric_ids", "dimensions", F.when(timed, F.array(F.lit("time"))).otherwise(F.array().cast("array<string>"))).alias("required"),
        F.col("metric_ids").alias("metrics"),
        F.when(timed, "time").alias("time"),
        F.when(timed, names).otherwise(F.array().cast("array<string>")).alias("time_aliases"),
        F.col("range.start").alias("start"),
        F.col("range.end").alias("end"),
        F.map_from_arrays("metric_ids", F.transform("metric_ids", lambda m: F.element_at(label, m))).alias("labels"),
        F.lit(catalog.version).alias("catalog_version"),
        warnings.alias("warnings"),
    )
    return routed.withColumn("contract", F.when(F.col("state") == "answerable", contract))


def carry_over(routed: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Follow-up questions take what they leave out (metrics, dimensions, grain, range) from the last turn that named it."""
    before = W.partitionBy(conv).orderBy(turn).rowsBetween(W.unboundedPreceding, 0)
    named = lambda c: F.when(F.size(c) > 0, F.col(c))
    return routed.withColumns({
        "metric_ids": F.coalesce(F.last(named("metric_ids"), ignorenulls=True).over(before), F.col("metric_ids")),
        "dimensions": F.coalesce(F.last(named("dimensions"), ignorenulls=True).over(before), F.col("dimensions")),
        "grain": F.last("grain", ignorenulls=True).over(before),
        "range": F.last("range", ignorenulls=True).over(before),
    })
