import pytest

from quillon import catalog as C
from quillon import policy
from quillon.operators.validation import Contract

REFUSED = [
    "DELETE FROM orders", "UPDATE orders SET o_orderstatus = 'x'", "INSERT INTO orders VALUES ('x')", "DROP TABLE orders", "SELECT 1; DROP TABLE orders", "SELECT * FROM information_schema.tables",
    "SELECT reflect('java.lang.System', 'exit') FROM orders", "SELECT * FROM orders FOR UPDATE", "SELECT * FROM orders", "SELECT o_orderkey FROM orders", "SELECT * FROM app.audits", "SELECT input_file_name() FROM orders",
    "COPY orders TO '/tmp/x'", "CREATE TABLE x AS SELECT * FROM orders", "TRUNCATE TABLE orders", "SELECT n_name FROM nation LIMIT 0", "SELECT n_name FROM nation LIMIT $1", "WITH x AS (DELETE FROM orders RETURNING *) SELECT * FROM x",
    "SELECT vec_id FROM embeddings", "SELECT n_name FROM other.nation", "SELECT 1", "SELECT n_name FROM nation LIMIT -1", "WITH x AS (SELECT o_orderkey k FROM orders) SELECT max(k) AS m FROM x",
    "SELECT o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM secret)", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey", "SELECT o_orderstatus FROM orders ORDER BY o_custkey",
    "SELECT r_name AS a FROM region UNION SELECT c_name FROM customer", "SELECT nope FROM orders", "SELECT (SELECT max(c_custkey) FROM customer) AS z, r_name FROM region", "SELECT r_name AS c_name FROM region", "SELECT * FROM range(5)", "",
    "SELECT k FROM orders LATERAL VIEW explode(array(o_orderkey)) t AS k", "SELECT t.k FROM orders, LATERAL (SELECT o_orderkey AS k) t", "SELECT o_orderkey + 0 AS k, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderkey)",
    "SELECT k FROM (SELECT o_orderkey + 0 AS k, count(*) AS n FROM orders GROUP BY CUBE(o_orderkey)) x", "SELECT k FROM orders LATERAL VIEW inline(transform(array(1), x -> named_struct('k', o_orderkey))) t AS k",
    "SELECT s.v FROM secret s, nation WHERE EXISTS (WITH secret AS (SELECT 1 AS q FROM nation) SELECT q FROM secret)", "WITH a AS (SELECT v FROM secret), secret AS (SELECT 1 AS v FROM nation) SELECT v FROM a",
    "WITH x AS (SELECT o_orderkey AS k FROM orders), y AS (SELECT k + 1 AS z FROM x) SELECT z FROM y", "SELECT max(o_custkey) OVER (PARTITION BY o_orderstatus) AS m FROM orders",
    "SELECT v FROM IDENTIFIER('sec' || 'ret'), nation", "SELECT IDENTIFIER('current_' || 'user')() AS u FROM nation", "SELECT IDENTIFIER('c_' || 'name') AS n FROM customer",
    "SELECT current_user AS u FROM nation", "SELECT session_user AS u FROM nation", "SELECT user AS u FROM nation", "SELECT current_schema() AS u FROM nation", "SELECT current_user() AS u FROM nation", "SELECT current_database() AS u FROM nation",
    "SELECT a FROM orders AS o(a, b, c, d, e, f)", "WITH x AS (SELECT * FROM orders AS o(a, b, c, d, e, f)) SELECT a FROM x", "SELECT count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "FROM orders |> SELECT o_custkey", "TABLE nation |> WHERE true", "SELECT n_name FROM nation WHERE n_name = current_user", "SELECT k FROM orders UNPIVOT (v FOR k IN (o_custkey))",
    "TABLE nation", "SELECT * FROM nation UNION ALL SELECT * FROM nation", "SELECT * EXCEPT (n_name) FROM nation", "SELECT struct(*) AS s FROM nation", "SELECT n.* FROM nation n", "SELECT n_name FROM (SELECT * FROM nation) x",
    "SELECT n_name FROM nation UNION ALL TABLE region", "SELECT count(*) AS n FROM orders GROUP BY o_orderkey UNION ALL SELECT 1 FROM nation", "SELECT n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) x",
    "SELECT s FROM (SELECT o_orderstatus AS s FROM orders ORDER BY o_custkey) x", "WITH x(a, b) AS (SELECT o_orderkey, o_orderstatus FROM orders) SELECT a FROM x", "WITH x(a, b, c, d, e, f) AS (SELECT * FROM orders) SELECT a FROM x",
    "WITH x AS (SELECT o_orderpriority AS p FROM orders UNION SELECT c_name FROM customer) SELECT p FROM x", "WITH x AS (SELECT named_struct('k', o_orderkey) AS s FROM orders) SELECT s.k AS v FROM x",
    "SELECT k FROM orders LATERAL VIEW inline(array(named_struct('k', o_orderkey))) t", "WITH x AS (SELECT (SELECT max(c_custkey) FROM customer) AS z, r_name FROM region) SELECT z FROM x",
    "WITH x AS (SELECT stack(1, o_orderkey, 1) AS (a, b) FROM orders) SELECT a FROM x", "SELECT max_by(o_custkey, o_totalprice) AS m FROM orders", "SELECT count_if(o_custkey = 5) AS n FROM orders",
    "SELECT o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)", "WITH x AS (SELECT o_orderkey AS k FROM orders) SELECT count(*) AS n FROM x GROUP BY k",
]
ALLOWED = [
    ("SELECT n_name FROM nation LIMIT 999999", 200), ("SELECT n_name FROM nation -- harmless", 200), ("SELECT COUNT(o_orderkey) AS n FROM orders", 200), ("SELECT n_name FROM nation LIMIT 1", 1),
    ("WITH x AS (SELECT o_orderkey k, o_totalprice p FROM orders) SELECT sum(p) AS s, count(k) AS n FROM x", 200), ("SELECT o_orderstatus FROM orders WHERE o_custkey = 5", 200),
    ("SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)", 200), ("SELECT p FROM orders LATERAL VIEW explode(array(o_orderpriority)) t AS p", 200),
    ("WITH x AS (SELECT n_name AS v FROM nation) SELECT v FROM x WHERE EXISTS (SELECT 1 FROM x AS y)", 200),
    ("WITH x AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT avg(n) AS a FROM x", 200), ("SELECT count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", 200), ("SELECT max(o_totalprice) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_orderstatus)", 200),
    ("WITH x AS (SELECT * FROM orders) SELECT o_orderstatus, count(*) AS n FROM x GROUP BY 1 ORDER BY 2", 200), ("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region", 200),
    ("SELECT c_mktsegment AS s, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL", 200),
    ("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", 200),
]


@pytest.fixture(scope="module")
def catalog(spark, sf):
    c = C.load_catalog()
    for t in c.tables:
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)
    spark.sql("SELECT 'hidden' AS v").createOrReplaceTempView("secret")
    return c


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, catalog, sql):
    with pytest.raises(policy.PolicyViolation):
        policy.evaluate(spark, sql, catalog)


@pytest.mark.parametrize("sql,limit", ALLOWED)
def test_allowed(spark, catalog, sql, limit):
    assert policy.evaluate(spark, sql, catalog).row_limit == limit


def test_admin(spark, catalog):
    assert policy.evaluate(spark, "SELECT * FROM orders", catalog, "admin").row_limit == 1000
    with pytest.raises(policy.PolicyViolation):
        policy.evaluate(spark, "SELECT n_name FROM nation", catalog, "guest")
    assert len(policy.run(spark, "SELECT n_name FROM nation ORDER BY n_name LIMIT 2", catalog)) == 2


def test_one_repair(spark, catalog):
    asked = []

    def candidate(sql, code):
        asked.append(code)
        return "SELECT n_name FROM nation LIMIT 1" if len(asked) < 3 else "DELETE FROM nation"

    assert len(policy.run_with_repair(spark, "SELECT n_nam FROM nation", catalog, candidate)) == 1
    assert len(policy.run_with_repair(spark, "SELEC n_name FROM nation", catalog, candidate)) == 1
    with pytest.raises(policy.PolicyViolation):
        policy.run_with_repair(spark, "SELECT n_nam FROM nation", catalog, candidate)
    with pytest.raises(policy.PolicyViolation):
        policy.run_with_repair(spark, "DROP TABLE nation", catalog, candidate)
    assert asked == ["not_resolved", "syntax", "not_resolved"]


def test_guarded_scan(spark, catalog, tmp_path):
    log = str(tmp_path / "audit")
    rows, verdict = policy.guarded(spark, "SELECT n_name AS name, n_regionkey AS size FROM nation LIMIT 5", catalog, Contract(("name",), ("size",)), log)
    assert rows.count() == 5 and verdict.state == "valid"
    rows, verdict = policy.guarded(spark, "SELECT o_orderstatus AS name FROM orders", catalog, Contract(("name",)), log)
    assert rows is None and verdict.truncated
    rows, verdict = policy.guarded(spark, "SELECT n_name AS name FROM nation WHERE false", catalog, Contract(("name",)), log)
    assert rows is None and verdict.reason == "empty"
    with pytest.raises(policy.PolicyViolation):
        policy.guarded(spark, 'SELECT o_orderkey FROM orders WHERE o_orderstatus = \'{"password":"hunter2"}\'', catalog, audit=log)
    audit = spark.read.parquet(log).orderBy("created_at").collect()
    assert [(r["status"], r["reason"], r["rows"]) for r in audit] == [("valid", "ok", 5), ("needs_clarification", "truncated", 200), ("needs_clarification", "empty", 0), ("refused", "sensitive_column", 0)]
    assert audit[0]["tables"] == "nation" and "hunter2" not in str(audit)
