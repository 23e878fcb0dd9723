import pytest
from pyspark.sql import functions as F

from quillon import catalog as C
from quillon.functions import text as T
from quillon.operators import charts, metrics, quality, sessions
from quillon.operators.validation import Contract, validate
from quillon.plans.routing import carry_over, route
from quillon.sources import history
from quillon.sources.jdbc import Database
from quillon.sources.tables import Star, read_csv
from quillon.streaming import events as stream


def test_catalog_paths_and_rules(spark, sf, tmp_path):
    c = C.load_catalog()
    assert [j.right for j in c.path({"lineitem"}, "region")] == ["orders", "customer", "nation", "region"]
    assert C.drift(c, spark, sf) == {}
    with pytest.raises(C.CatalogError):
        c.join_path(spark, sf, "region", "nation")
    assert c.join_path(spark, sf, "orders", "region").count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    bad = tmp_path / "c.yaml"
    bad.write_text(C.DEFAULT.read_text().replace("sensitive: [", "sensitive: [no_such_column, "))
    with pytest.raises(C.CatalogError):
        C.load_catalog(bad)
    bad.write_text(C.DEFAULT.read_text() + "more: 1\n")
    with pytest.raises(C.CatalogError):
        C.load_catalog(bad)


def test_metrics_keep_their_grain(spark, sf):
    star = Star(spark, sf)
    with pytest.raises(metrics.NeedsClarification):
        metrics.measure(star, "average_delivery_days", ("category",))
    with pytest.raises(metrics.NeedsClarification):
        metrics.measure(star, "positive_review_rate", grain="month")
    both = metrics.query(star, ["gmv", "paid_order_count"], ("customer_state",))
    assert both.agg(F.sum("paid_order_count")).first()[0] == metrics.query(star, ["paid_order_count"]).first()[0]


def test_convert_and_publish(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text('id,note,amount\n1,"two\nlines ""quoted""",1.005\n2,,x\n')
    ok, bad = quality.convert(read_csv(spark, str(raw)), {"id": ("id", T.strict_int), "note": ("note", None), "amount": ("amount", T.strict_decimal)}, "v1")
    assert [(r["id"], r["note"], float(r["amount"]), r["dataset_version_id"]) for r in ok.collect()] == [(1, 'two\nlines "quoted"', 1.0, "v1")]
    with pytest.raises(quality.BadRows):
        quality.require_clean(bad, "raw")
    path = str(tmp_path / "out")
    quality.publish(ok, path)
    quality.publish(ok.union(ok), path)
    assert spark.read.parquet(path).count() == 2
    quality.write_artifact(ok, str(tmp_path / "csv"))
    digest = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in quality.checksums(spark, str(tmp_path / "raw.csv")).collect()}
    quality.verify_checksums(spark, str(raw), digest)
    with pytest.raises(quality.BadRows):
        quality.verify_checksums(spark, str(raw), {"raw.csv": "0"})


def test_validation_order(spark):
    df = spark.createDataFrame([("2017-01-01", 1.0), ("2017-02-01", float("inf"))], "month string, gmv double")
    assert validate(df, Contract(("month",), ("gmv",), "month")).reason == "not_finite:gmv"
    good = df.filter("gmv = 1")
    assert validate(good, Contract(("month",), ("gmv",), "month", "2017-01-01", "2017-12-31")).state == "valid"
    assert validate(good, Contract(("month",), ("gmv",), "month", "2018-01-01", "2018-12-31")).reason == "time_out_of_range"
    assert validate(good, Contract(("month",), ("GMV",), max_rows=1)).reason == "truncated"
    assert validate(good.withColumn("gmv", F.lit(None).cast("double")), Contract(("month",), ("gmv",))).reason == "all_null:gmv"
    assert validate(good, Contract(("month",), ("gmv",), "gmv")).reason == "time_unreadable"


def test_chart_kinds(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0), (None, 3, 4.0)], "k string, n int, x double")
    kinds = [charts.chart_spec(df.select(*c))[0] for c in (["k", "n"], ["n"], ["n", "x"], ["k"])]
    assert kinds == ["bar", "histogram", "scatter", "bar"]
    assert charts.chart_spec(df.select("k", "n"))[1].count() == 2
    assert charts.chart_spec(df.withColumn("a", F.lit(1)))[0] == "table"
    assert charts.chart_spec(df.select("n", "x", (F.col("n") * 2).alias("m")))[0] == "heatmap"


def test_text_functions(spark):
    one = spark.createDataFrame([("ＡＢＣ Straße", "see ```sql\nSELECT 1;\n``` ok", "2017-01-01 to 2017-02-03")], "a string, b string, c string")
    r = one.select(T.normalize("a").alias("n"), T.extract_sql(F.col("b")).alias("s"), T.requested_range(F.col("c")).alias("r")).first()
    assert (r["n"], r["s"], r["r"]["start"], r["r"]["end"]) == ("abc strasse", "SELECT 1;", "2017-01-01", "2017-02-03")


def test_stream_gives_the_batch_result(spark, sf, tmp_path):
    out = str(tmp_path / "out")
    q = stream.write_stream(stream.tumbling(stream.event_stream(spark, sf)), out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    batch = {tuple(r) for r in stream.tumbling(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    # The last windows stay open until the watermark passes them.
    assert got <= batch and len(got) >= 0.9 * len(batch)


def test_history_and_cases(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/region.parquet").createOrReplaceTempView("region_view")
    assert {"r_name", "r_regionkey"} <= {r["column_name"] for r in history.information_schema(spark).filter("table_name = 'region_view'").collect()}
    log = spark.createDataFrame([("SELECT a FROM Sales", 5), ("SELECT a FROM Sales", 7), ("SELECT 1", 9), ("SELECT b FROM sales", 1)], "query_text string, rows_produced int")
    assert [r[0] for r in history.query_history(log, "sales").collect()] == ["SELECT a FROM Sales"]
    path = str(tmp_path / "cases.yaml")
    cases = spark.createDataFrame([("1", "c", "q", {"state": "ok"}), ("2", "c", "r", {"state": "no"})], "id string, category string, question string, expected map<string,string>")
    for p in (path, path.replace(".yaml", ".json")):
        history.save_cases(cases, p)
        assert [r["id"] for r in history.load_cases(spark, p, {"state": "ok"}).collect()] == ["1"]
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.txt").write_text("x" * 100 + " Needle " + "y" * 100)
    found = history.search_files(spark, str(tmp_path / "notes"), "needle").first()
    assert found["snippet"].startswith("…") and "Needle" in found["snippet"]
    assert history.markdown(cases.select("id")).splitlines()[2] == "| 1 |"
    assert len(history.json_summary(cases, max_chars=130)) <= 130
    events = history.audit_events(spark.read.parquet(f"{sf}/events.parquet"), {"event_type": "click"}, "2024-01-02", "2024-01-03")
    assert {r["event_type"] for r in events.collect()} == {"click"}


def test_follow_up_questions(spark):
    q = spark.createDataFrame([(1, 0, "gmv by state in 2017"), (1, 1, "by month"), (1, 2, "and orders weekly")], "conv_id int, turn int, question string")
    got = {r["turn"]: r for r in carry_over(route(q, C.load_catalog())).collect()}
    assert got[1]["metric_ids"] == ["gmv"] and got[1]["dimensions"] == ["customer_state"] and got[1]["grain"] == "month" and got[1]["range"]["start"] == "2017-01-01"
    assert got[2]["metric_ids"] == ["paid_order_count"] and got[2]["grain"] == "week"


def test_jdbc_round_trip(spark):
    db = Database(spark, "derby", "memory:quillon;create=true")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")
    db.write(df, "t1")
    assert sorted(db.run_sql("SELECT * FROM t1;").collect()) == sorted(df.collect(), key=lambda r: r["id"])
    assert db.run_sql("SELECT * FROM t1", "id", (1, 4), 3).rdd.getNumPartitions() == 3
    assert Database(spark, "postgres", "d", "h").url() == "jdbc:postgresql://h:5432/d"


def test_extract_sql(spark):
    said = ["a ```sql\nSELECT x\n``` b", "```\nfoo\n```", "CREATE TABLE t AS SELECT 1; SELECT 2;", "WITH a AS (SELECT 1) SELECT * FROM a; done", "SELECT 1; then SELECT 2;", "nothing"]
    got = [r[0] for r in spark.createDataFrame(enumerate(said), "i int, t string").orderBy("i").select(T.extract_sql(F.col("t"))).collect()]
    assert got == ["SELECT x", "foo", "CREATE TABLE t AS SELECT 1;", "WITH a AS (SELECT 1) SELECT * FROM a;", "SELECT 2;", "nothing"]


def test_decimals_round_once(spark):
    from decimal import ROUND_HALF_EVEN, Decimal

    said = ["1.01499999999999", "58.915", "58.905", ".5", "1e2", "-2.5e-1", "0.125", "0.12500000000000000000000001", "7.00500000000000000000", "+3", "4."]
    got = {r["t"]: r["d"]["value"] for r in spark.createDataFrame([(x,) for x in said], "t string").select("t", T.strict_decimal(F.col("t")).alias("d")).collect()}
    assert got == {x: Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_EVEN) for x in said}
    bad = spark.createDataFrame([("1.2.3",), ("x",), ("1e",), ("1,5",)], "t string").select(T.strict_decimal(F.col("t")).alias("d")).collect()
    assert all(r["d"]["bad"] for r in bad)


class Files:
    """A file system of which some renames fail, reported as Hadoop does."""

    def __init__(self, *names, refuse=()):
        self.names, self.refuse = dict.fromkeys(names, 0), refuse
        for n in names:
            self.names[n] = n

    def exists(self, p):
        return p in self.names

    def delete(self, p, _):
        self.names.pop(p, None)

    def rename(self, a, b):
        if (a, b) in self.refuse or a not in self.names or b in self.names:
            return False
        self.names[b] = self.names.pop(a)
        return True


def test_swap_keeps_one_copy():
    fs = Files("staging", "target")
    quality.swap(fs, "staging", "target", "old")
    assert fs.names == {"target": "staging"}
    for refuse in ([("staging", "target")], [("target", "old")]):
        fs = Files("staging", "target", refuse=refuse)
        with pytest.raises(OSError):
            quality.swap(fs, "staging", "target", "old")
        assert fs.names["target"] == "target"


def test_audit_holds_no_secret(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", '{"password":"hunter2","n":1}', "hunter2", {"oauth": "hunter2", "x": "1"}, '{"a":{"auth_header":"hunter2"}}')]
    df = spark.createDataFrame(rows, "created_at string, sql string, api_token string, params map<string,string>, detail string")
    quality.append_audit(df, str(tmp_path / "audit"))
    r = spark.read.parquet(str(tmp_path / "audit")).collect()[0]
    assert "hunter2" not in str(r) and r["params"]["x"] == "1" and '"n":1' in r["sql"]


def test_memories_without_a_time(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "2024-01-05 00:00:00"), (3, "a", "2024-02-01 00:00:00"), (4, "b", None)], "id int, tool_name string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    left = lambda *a, **k: [r["id"] for r in sessions.clear_memories(df, *a, **k).orderBy("id").collect()]
    assert left("a", "2024-01-10") == [3, 4] and left("a") == [4] and left() == [] and left(None, "2024-01-10") == [3]
    assert left("a", text=True) == [1, 2, 3, 4] and left(None, "2024-01-10", text=True) == [3]


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (1, 1, 9.0), (1, 2, 4.0), (1, 3, 3.0), (2, 0, 99.0)], "g int, turn int, tokens double")
    assert [(r["g"], r["turn"], r["running"]) for r in sessions.pack_context(df, "g", "turn", "tokens", 10.0).orderBy("turn").collect()] == [(1, 0, 3.0), (1, 2, 7.0)]


def test_chartable(spark):
    df = spark.createDataFrame([("query_results_0a1b2c3d.csv", 200, 3), ("query_results_0a1b2c3d.csv", 201, 3), ("../x.csv", 1, 1), ("query_results_0a1b2c3d.csv", 1, 4)], "f string, r int, c int")
    assert [r[0] for r in df.select(T.chartable(F.col("f"), F.col("r"), F.col("c"))).collect()] == [True, False, False, False]


def test_limit_applied(spark):
    assert validate(spark.range(3), Contract(("id",), limit_applied=True)).truncated
