"""Stored structures: what they read, what they leave when something fails, and that they give what a plain path gives."""

import json
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import ivf, match_index, metrics, quality, rollup, set_join, similarity
from quillon.sources import bucketed, release
from quillon.sources.snapshots import Conflict, Rejected, Snapshots
from quillon.sources.stored import new_path
from quillon.sources.tables import Star


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text, name):
    return len(re.findall(rf"FileScan parquet .*?{name}\.parquet", text))


def test_metrics_of_a_fact_share_one_scan(spark, sf):
    every = [m for m in metrics.METRICS if metrics.METRICS[m].fact == "orders"]
    text = plan(metrics.query(Star(spark, sf), every, ("customer_state",), "month"))
    assert scans(text, "lineitem") == 1 and scans(text, "orders") == 1 and scans(text, "customer") == 1
    both = plan(metrics.query(Star(spark, sf), ["gmv", "paid_order_count"], ("category",)))
    assert scans(both, "lineitem") == 1 and scans(both, "orders") == 1
    assert scans(plan(metrics.query(Star(spark, sf), ["paid_order_count"], ("customer_state",))), "lineitem") == 0


def test_dimensions_are_joined_above_sums(spark, sf):
    """From the root down: final aggregate, join with the dimension, partial and final aggregate by foreign key, join of the facts."""
    optimized = metrics.query(Star(spark, sf), ["gmv"], ("customer_state",))._jdf.queryExecution().optimizedPlan().toString()
    kinds = [(len(line) - len(line.lstrip(" :+-")), re.search(r"(Aggregate \[[^\]]*\]|Join|Relation \[[^\]#]*)", line)) for line in optimized.splitlines()]
    order = [m.group(0) for _, m in kinds if m]
    first_join = next(i for i, x in enumerate(order) if x == "Join")
    below = order[first_join + 1 :]
    assert order[0].startswith("Aggregate [customer_state") and any(x.startswith("Aggregate [customer_id") or x.startswith("Aggregate [o_custkey") for x in below)
    assert any(x.startswith("Aggregate [l_orderkey") or x.startswith("Aggregate [order_id") for x in below)


def test_metrics_without_rows(spark, sf):
    none = metrics.query(Star(spark, sf), ["gmv", "paid_order_count", "average_delivery_days"], start="2030-01-01").collect()
    assert [tuple(r) for r in none] == [(None, 0, None)]
    assert metrics.query(Star(spark, sf), ["gmv", "paid_order_count"], ("category",), start="2030-01-01").count() == 0
    with pytest.raises(metrics.NeedsClarification):
        metrics.query(Star(spark, sf), ["average_delivery_days"], ("category",))


def test_lattice_reads_no_facts(spark, sf):
    lattice = rollup.build(Star(spark, sf))
    df = lattice.query(["order_count", "customer_count", "average_order_value"], ("category",), "month", "1996-03-05", "1996-07-09")
    assert "lineitem" not in plan(df) and "orders.parquet" not in plan(df) and "month" in re.search(r"PartitionFilters: \[(.*?)\]", plan(df)).group(1)
    items = Star(spark, sf).items().filter("order_status != 'P' AND ordered_at >= '1996-03-05' AND ordered_at < '1996-07-10'").join(Star(spark, sf).products(), "product_id")
    want = items.groupBy("category", F.date_trunc("month", "ordered_at").cast("date").alias("period")).agg(F.countDistinct("order_id").alias("o"), F.countDistinct("customer_id").alias("c"))
    assert {(r.category, r.period): (r.order_count, r.customer_count) for r in df.collect()} == {(r.category, r.period): (r.o, r.c) for r in want.collect()}
    with pytest.raises(metrics.NeedsClarification):
        lattice.query(["gmv"], ("brand",))


def test_lattice_of_sparse_and_shared_keys(spark, sf, tmp_path):
    """Keys far apart, and orders that move between days when the lattice is renewed."""

    class Small(Star):
        day = "1998-05-07"

        def orders(self):
            return spark.createDataFrame([(1, 10, "F", "1998-04-01"), (2**40, 10, "F", self.day), (7, 2**33, "O", "1998-05-09"), (8, 11, "P", "1998-05-09")], "order_id long, customer_id long, order_status string, ordered_at string").withColumn("ordered_at", F.col("ordered_at").cast("timestamp"))

        def lines(self):
            return spark.createDataFrame([(1, 1, 1.5), (1, 2, 2.0), (2**40, 1, 3.0), (2**40, 1, 4.0), (7, 3, 5.0), (8, 1, 9.0)], "order_id long, product_id long, price double").withColumn("price", F.col("price").cast("decimal(14,2)"))

    star = Small(spark, sf)
    lattice = rollup.build(star)
    got = lattice.query(["gmv", "item_count", "order_count", "customer_count"], (), "month", None, None).orderBy("gmv").collect()
    assert [tuple(r)[1:] for r in got] == [(3.5, 2, 1, 1), (12.0, 3, 2, 2)]
    Small.day = "1998-06-01"
    rollup.build(star, lattice.path, since="1998-05-05")
    got = lattice.query(["gmv", "order_count", "customer_count"], (), "month").orderBy("period").collect()
    assert [tuple(r)[1:] for r in got] == [(3.5, 1, 1), (5.0, 1, 1), (7.0, 1, 1)]
    assert [tuple(r) for r in lattice.query(["order_count", "customer_count"]).collect()] == [(3, 2)]


def test_facts_join_without_a_shuffle(spark, sf):
    star = bucketed.store(spark, sf, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(star.items())
        assert "Join" in text and "Exchange" not in text
        sums = plan(star.lines().groupBy("order_id").agg(F.sum("price").alias("p")).join(star.orders(), "order_id"))
        assert "Exchange" not in sums
        assert star.items().count() == Star(spark, sf).items().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        star.drop()


def test_snapshot_is_all_or_nothing(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.tables() == {}
    assert store.commit({"a": spark.range(3), "b": spark.range(5)}, {"a": 3}) == 1
    held = store.read("a")

    def fail(written):
        assert written["a"].count() == 9
        raise RuntimeError("between tables")

    with pytest.raises(Rejected):
        store.commit({"a": spark.range(7), "b": spark.range(7)}, {"b": 8})
    with pytest.raises(RuntimeError):
        store.commit({"a": spark.range(9), "b": spark.range(9)}, checks=fail)
    with pytest.raises(Exception, match="(?i)divide"):
        store.commit({"a": spark.range(9), "b": spark.range(9).select((F.lit(1) / (F.col("id") - 4)).alias("x"))})
    assert store.versions() == [1] and store.read("a").count() == 3 and store.read("b").count() == 5
    assert store.commit({"a": spark.range(4)}) == 2
    assert (store.read("a").count(), store.read("b").count(), held.count(), store.read("a", 1).count()) == (4, 5, 3, 3)
    assert store.rollback(1) == 3 and store.read("a").count() == 3
    with pytest.raises(Conflict):
        store._put({"version": 3, "tables": {}})
    store.commit({"b": spark.range(1)}, replace_all=True)
    assert set(store.tables()) == {"b"}
    gone = store.vacuum(1)
    assert store.versions() == [4] and store.read("b").count() == 1 and len([g for g in gone if g.startswith("a/")]) >= 2


def test_release_loads_whole_or_not(spark, tmp_path):
    (tmp_path / "orders.csv").write_text('id,amount,seen_at\n1,58.9,2017-10-02 10:56:33\n2,3,2017-10-03 00:00:00\n')
    (tmp_path / "items.csv").write_text('order,note\n1,"two\nlines, ""quoted"""\n2,x\n')
    orders = (str(tmp_path / "orders.csv"), {"id": ("id", T.strict_int), "amount": ("amount", T.strict_decimal), "seen_at": ("seen_at", T.strict_timestamp)})
    items = (str(tmp_path / "items.csv"), {"order_id": ("order", T.strict_int), "note": ("note", None)})
    store = Snapshots(spark, str(tmp_path / "store"))
    load = lambda: release.load_release(store, {"orders": orders, "items": items}, "v1", {"items.order_id": ("orders", "id")})
    assert load() == 1
    assert {r.note for r in store.read("items").collect()} == {'two\nlines, "quoted"', "x"} and {r.dataset_version_id for r in store.read("orders").collect()} == {"v1"}
    (tmp_path / "orders.csv").write_text("id,amount,seen_at\n1,58.9,2017-10-02 10:56:33\n2,3,not-a-date\n3,x,2017-10-02 10:56:33\n")
    with pytest.raises(quality.BadRows, match=r"orders: 2 rows .* at orders.csv row 3 in seen_at"):
        load()
    (tmp_path / "orders.csv").write_text("id,amount,seen_at\n1,58.9,2017-10-02 10:56:33\n")
    with pytest.raises(Rejected, match="items.order_id: 1 rows without a row of orders, one is 2"):
        load()
    assert store.versions() == [1] and store.read("orders").count() == 2


def vectors(spark, n=1500):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(400)] + [(n + 500, [0.0] * 16), (n + 501, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


@pytest.mark.parametrize("measure", ["l2", "cosine"])
def test_vector_index(spark, measure, monkeypatch):
    """Exact mode against all pairs, with a cell of copies in several parts, and the recall of probing."""
    monkeypatch.setattr(ivf, "PART", 100)
    v = vectors(spark)
    asked = v.filter("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = ivf.build(v, measure=measure, cells=16)
    assert index.vectors.count() == v.filter("embedding IS NOT NULL").count() and index.vectors.groupBy("cell").agg(F.max("part").alias("p")).filter("p > 2").count() > 0
    want = similarity.nearest(v.filter("embedding IS NOT NULL"), asked, measure, 10)
    assert sorted(map(tuple, index.search(asked, 10).select("query_id", "id", "value", "rank").collect()), key=str) == sorted(map(tuple, want.select("query_id", "vec_id", "value", "rank").collect()), key=str)
    assert index.recall(asked, 10, cells=4) >= 0.9


def test_vector_index_on_the_test_table(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert ivf.build(v, cells=16).recall(asked, 10, cells=12) >= 0.9
    few = ivf.build(v.limit(3), cells=16)
    assert few.search(asked, 10).count() == 3 * asked.count() and few.probe(asked.limit(0)).count() == 0


def usages(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.left("text", F.lit(160)).alias("text"))
    text = rows.first().text
    odd = [(-1, ""), (-2, None), (-3, "   "), (-4, text), (-5, text.upper()), (-6, text[:-9] + " zzz"), (-7, "a b c d e f g h i j"), (-8, "a b c d e f g h i k"), (-9, "the cat"), (-10, "the  CAT"), (-11, "eta cht")]
    return rows.unionByName(spark.createDataFrame(odd, "id long, text string"))


def test_usages_against_all_pairs(spark, sf):
    rows = usages(spark, sf)
    texts = {r.id: r.text or "" for r in rows.collect()}
    got = {}
    for r in set_join.similar_usages(rows.withColumnRenamed("id", "question_id"), rows.withColumnRenamed("id", "memory_id"), 0.7, 10).collect():
        got.setdefault(r.question_id, []).append((r["rank"], r.memory_id, r.score))
    sets = {i: set(t.lower().split()) for i, t in texts.items()}
    for a, x in texts.items():
        found = []
        for b, y in texts.items():
            m = SequenceMatcher(None, x.lower(), y.lower())
            both = sets[a] | sets[b]
            score = max(len(sets[a] & sets[b]) / len(both) if both else 0.0, m.ratio() if m.real_quick_ratio() >= 0.7 and m.quick_ratio() >= 0.7 else 0.0)
            if score >= 0.7 - 1e-9:
                found.append((-round(score, 6), b))
        assert [(k + 1, b, -s) for k, (s, b) in enumerate(sorted(found)[:10])] == sorted(got.get(a, [])), (a, x)


def test_pairs_meet_on_rare_tokens_only(spark):
    """A token that all texts share does not make them meet."""
    rows = spark.createDataFrame([(i, ["the", "of", "and", "to"] + [f"w{i}_{j}" for j in range(6)]) for i in range(300)], "id long, tokens array<string>")
    left, right = rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b")
    assert set_join.candidates(left, right, 0.7).count() == 300
    with pytest.raises(ValueError):
        set_join.candidates(left, right, 0)


def test_match_index(spark, sf):
    docs = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text", F.when(F.col("item_id") % 3 == 0, "x").otherwise("y").alias("of"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "", None), (-3, "The the THE queue", None)], "doc_id long, text string, of string"))
    index = match_index.build(docs, collection="of")
    asked = [("a", "the that queue of", None), ("b", "THE the", "y"), ("c", "nowordlikethis", None), ("d", None, None), ("e", "the that queue of", "x")]
    found = {}
    for r in index.search(spark.createDataFrame(asked, "query_id string, text string, collection string"), 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for q, text, of in asked:
        want = similarity.text_match(docs if of is None else docs.filter(F.col("of") == of), text, 5).collect() if text else []
        assert sorted(found.get(q, [])) == [(i + 1, r.doc_id, r.score) for i, r in enumerate(want)], q
    one = spark.createDataFrame([("a", "queue")], "query_id string, text string").select("query_id", F.explode(match_index.terms(F.col("text"))).alias("term")).withColumn("bucket", match_index._bucket("term", index.buckets))
    read = index.postings(one)
    assert "bucket" in re.search(r"PartitionFilters: \[(.*?)\]", plan(read)).group(1) and read.select("bucket").distinct().count() <= 1


@pytest.mark.parametrize(
    "said",
    ['{"token":{"v":"hunter2"}}', '{"password":["hunter2","p2"]}', '[{"a":[{"api_key":{"x":["hunter2"]}}]}]', '{"a":"{\\"secret\\":{\\"b\\":\\"hunter2\\"}}"}', 'SELECT 1 WHERE x = \'{"auth": ["hunter2"]}\' -- {"k":1}', '{"password":["hunter2"', 'x {"token": {"a": "hunter2", ', '{"my_Token" : "hunter2", "n": 1}', '{"a": {"credential": 1, "b": {"private_key": null}}, "access_key": [["hunter2"]]}', '[[[[{"secret":"hunter2"}]]]]', '{"password": "hunter2'],
)
def test_no_secret_is_left(spark, said):
    got = spark.createDataFrame([(said,)], "t string").select(T.redact_json(F.col("t"))).first()[0]
    assert "hunter2" not in got and "[REDACTED]" in got


def test_redaction_leaves_the_rest(spark):
    said = ['{"n": 1, "a": [1, 2.50, null], "b": "x"}', "no json { at all [", '{"tokens_left": 5, "n": 1.5}', None, "", '{"a":"ü","token":1}']
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string").orderBy("i").select(T.redact_json(F.col("t"))).collect()]
    assert got == [said[0], said[1], '{"tokens_left":"[REDACTED]","n":1.5}', None, "", '{"a":"ü","token":"[REDACTED]"}']
    assert len(T.scrub('{"secret":' * 3 + "[" * 20_000 + '"hunter2"')) < 30_000 and "hunter2" not in T.scrub("[" * 20_000 + '{"secret":"hunter2"}' + "]" * 20_000)


def test_audit_cleans_nested_columns(spark, tmp_path):
    df = spark.sql("""SELECT '2024-01-01 00:00:00' AS created_at, named_struct('a', named_struct('password', 'hunter2', 'n', 1)) AS s, array(map('token', 'hunter2', 'k', 'v')) AS l, map('x', '{"secret":["hunter2"]}') AS m""")
    quality.append_audit(df, str(tmp_path / "audit"))
    r = spark.read.parquet(str(tmp_path / "audit")).first()
    assert "hunter2" not in str(r) and r["s"]["a"]["n"] == 1 and r["l"][0]["k"] == "v" and json.loads(r["line"])["s"]["a"]["password"] == "[REDACTED]"


def test_artifact_and_its_chart(spark, tmp_path):
    df = spark.createDataFrame([("SP", 10, "2017-01-01"), ('R"J,', 5, None)], "state string, orders int, day string")
    shown = quality.write_artifact(df, str(tmp_path / "csv"))
    assert shown.splitlines()[0] == "state,orders,day" and "SP,10,2017-01-01" in shown and '"R""J,",5,' in shown
    back = release.chart_frame(spark, str(tmp_path / "csv"))
    assert dict(back.dtypes) == {"state": "string", "orders": "bigint", "day": "string"} and back.filter("orders = 5").first().state == 'R"J,'
    long = quality.preview(spark.range(2000))
    assert len(long) < 1100 and long.endswith("(Results truncated to 1000 characters.)")


def test_bounds_of_texts_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    rows, queries = spark.range(50).withColumnRenamed("id", "row"), spark.range(10).withColumnRenamed("id", "query_id")
    pairs = similarity.in_blocks(rows, queries)
    assert pairs.count() == 500 and pairs.distinct().count() == 500 and pairs.columns == ["row", "query_id"]


def test_paths_are_new(spark):
    assert new_path(spark, "x") != new_path(spark, "x")
