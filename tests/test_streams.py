"""Streams give what the batch gives, once the watermark has passed; replayed input changes nothing."""

import pytest
from pyspark.sql import functions as F

from quillon.catalog import load_catalog
from quillon.operators import sessions
from quillon.plans import memory, stored_queries
from quillon.streaming import budgets, joined
from quillon.streaming import events as stream
from quillon.streaming.incremental import Incremental


def run(df, path, mode="append"):
    q = stream.write_stream(df, f"{path}/out", f"{path}/cp", mode)
    assert q.awaitTermination(180)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out"), q


def in_files(df, folder, parts, order):
    """The rows in files of their own, in order, with times that files are read by."""
    import os
    import time

    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)
        new = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getctime)
        at = time.time() - 10_000 + len(os.listdir(folder))
        os.utime(new, (at, at))


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props")


@pytest.mark.parametrize("name", ["sliding", "sessions"])
def test_windows_as_streams(spark, sf, tmp_path, name):
    in_files(events(spark, sf), str(tmp_path / "in"), 3, "ts")
    make = getattr(stream, name)
    got, _ = run(make(stream.event_stream(spark, str(tmp_path / "in"), "*.parquet", 1)), str(tmp_path))
    got, batch = {tuple(r) for r in got.collect()}, {tuple(r) for r in make(events(spark, sf)).collect()}
    assert got <= batch and len(got) >= 0.8 * len(batch)


def test_first_seen_as_a_stream(spark, sf, tmp_path):
    rows = events(spark, sf).limit(200)
    in_files(rows.unionByName(rows), str(tmp_path / "in"), 2, "ts")
    got, _ = run(stream.first_seen(stream.event_stream(spark, str(tmp_path / "in"), "*.parquet", 1)), str(tmp_path))
    assert got.count() == rows.count() == got.select("event_id").distinct().count()


def test_runs_and_audits_as_streams(spark, sf, tmp_path):
    """The outer join of two streams against the batch join, up to the watermark; a late run is left out and counted."""
    ev = events(spark, sf)
    runs = ev.filter("event_type = 'click'").select(F.col("event_id").alias("run_id"), "user_id", F.col("ts").alias("run_at"))
    audits = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("audit_id"), "user_id", F.col("ts").alias("audit_at"), F.col("value").alias("audit_value"))
    in_files(runs, str(tmp_path / "runs"), 4, "run_at")
    in_files(audits, str(tmp_path / "audits"), 4, "audit_at")
    spark.createDataFrame([(-1, 1, "1990-01-01 00:00:00")], "run_id long, user_id long, run_at string").withColumn("run_at", F.col("run_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
    follow = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out, q = run(joined.with_audits(follow("runs", runs), follow("audits", audits), "2 hours"), str(tmp_path))
    got, batch = {tuple(r) for r in out.collect()}, {tuple(r) for r in joined.with_audits(runs, audits, "2 hours").collect()}
    assert got <= batch and joined.late_rows(q) == 1
    # Runs so far behind the last times that no audit of theirs can come are all there.
    last = min(runs.agg(F.max("run_at")).first()[0], audits.agg(F.max("audit_at")).first()[0])
    closed = {r.run_id for r in runs.filter(F.col("run_at") < F.lit(last) - F.expr("INTERVAL 4 HOURS")).collect()}
    assert {t for t in batch if t[0] in closed} <= got and any(t[3] is None for t in got) and any(t[3] is not None for t in got)


def test_a_replayed_batch_changes_nothing(spark, sf, tmp_path):
    ev = events(spark, sf)
    in_files(ev, str(tmp_path / "in"), 4, "event_id")
    found = Incremental(spark, str(tmp_path / "sums"))
    assert found.totals() is None and found.compact() == -1
    assert found.start(stream.event_stream(spark, str(tmp_path / "in"), "*.parquet", 1), str(tmp_path / "cp")).awaitTermination(180)
    want = sorted(map(tuple, found.partial(ev).collect()))
    assert sorted(map(tuple, found.totals().collect())) == want
    # Without its checkpoint a restarted query sends all batches again, under the same numbers.
    assert found.start(stream.event_stream(spark, str(tmp_path / "in"), "*.parquet", 1), str(tmp_path / "cp2")).awaitTermination(180)
    assert sorted(map(tuple, found.totals().collect())) == want
    assert found.compact() == 3
    assert found.start(stream.event_stream(spark, str(tmp_path / "in"), "*.parquet", 1), str(tmp_path / "cp3")).awaitTermination(180)
    assert sorted(map(tuple, found.totals().collect())) == want
    found.merge(ev.limit(10), 4)
    assert found.totals().agg(F.sum("rows")).first()[0] == ev.count() + 10


def test_memory_as_a_stream(spark, sf, tmp_path):
    """Turns in several micro-batches leave the memory that one batch leaves, for messages of `conversations`."""
    turns = memory.features(stored_queries.asked_in_turns(spark, sf), load_catalog()).withColumn("at", F.timestamp_seconds(1_700_000_000 + 60 * F.col("turn")))
    in_files(turns, str(tmp_path / "in"), 2, "turn")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out, _ = run(memory.follow(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    columns = ["conv_id", "turn", "reason", "metric_ids", "time_range", "comparison", "pending_question", "pending_missing"]
    assert not out.filter("late").count()
    assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, memory.replay(turns).select(columns).collect()))


def test_budgets_as_a_stream(spark, sf, tmp_path):
    """Counters in state allow what the window over the whole batch allows."""
    ev = events(spark, sf).filter("user_id < 20")
    in_files(ev, str(tmp_path / "in"), 3, "event_id")
    limits = {"click": 4, "purchase": 2, "error": 1}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out, _ = run(budgets.within_budget(stream.event_stream(spark, str(tmp_path / "in"), "*.parquet", 1), "user_id", "event_type", "event_id", limits), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = sessions.within_budget(ev, "user_id", "event_type", "event_id", limits).select("user_id", "event_type", "event_id", "allowed")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.filter("allowed").count() > 10


def test_memory_is_forgotten(spark, tmp_path):
    """An hour after its last turn a conversation begins anew."""
    said = [(1, 0, "gmv in 2017", 0), (1, 1, "by month", 30), (2, 0, "orders", 300), (2, 1, "by state", 301), (1, 2, "by month", 302), (2, 2, "by year", 330)]
    turns = memory.features(spark.createDataFrame(said, "conv_id long, turn long, question string, m long").withColumn("at", F.timestamp_seconds(1_700_000_000 + 60 * F.col("m"))), load_catalog())
    for m in (0, 30, 300, 301, 302, 330):
        in_files(turns.filter(F.col("m") == m), str(tmp_path / "in"), 1, "m")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out, _ = run(memory.follow(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.conv_id, r.turn): (list(r.metric_ids), r.time_range) for r in out.collect()}
    assert got[1, 1][0] == ["gmv"] and got[1, 1][1].start == "2017-01-01" and got[1, 2] == ([], None) and got[2, 2][0] == ["paid_order_count"]


def test_memory_rules(spark):
    said = [
        "gmv by state in 2017", "how can we improve good reviews", "average delivery days last month", "by category", "highest", "delete all orders", "orders year over year", "highest gmv", "",
    ]
    turns = memory.features(spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "conv_id long, turn long, question string"), load_catalog())
    got = memory.replay(turns).orderBy("turn").collect()
    assert [",".join(r.metric_ids) for r in got] == ["gmv", "gmv", "average_delivery_days", "average_delivery_days", "average_delivery_days", "average_delivery_days", "paid_order_count", "gmv", "gmv"]
    assert [r.reason for r in got] == ["answerable", "general_business", "answerable", "dimension_policy", "missing_comparison", "unauthorized", "answerable", "answerable", "empty"]
    assert got[3].pending_question == "by category" and got[3].pending_missing == "dimension_policy" and got[5].pending_question is None
    assert got[-1].time_range.start == "2017-01-01" and got[-1].comparison == "year_over_year"
