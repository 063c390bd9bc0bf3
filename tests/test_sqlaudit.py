from __future__ import annotations

import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stallmark.operators import sqlaudit
from tests import fixtures as fx


def audit(spark, *statements):
    df = spark.createDataFrame([(s,) for s in statements], "stmt string")
    return [r.asDict() for r in sqlaudit.audit_sql(df).collect()]


@pytest.mark.parametrize("stmt, reason", [
    ("DELETE FROM dim_seller WHERE state = 'X'", "Only SELECT queries are allowed."),
    ("TRUNCATE TABLE dim_date", "Only SELECT queries are allowed."),
    ("SELECT city FROM dim_seller; SELECT 2", "Only one statement is allowed."),
    ("INSERT INTO dim_product VALUES ('a')", "Only SELECT queries are allowed."),
    ("GRANT ALL ON dim_date TO someone", "Only SELECT queries are allowed."),
    ("SELECT price FROM hidden_prices", "Unknown or not allowed table(s): hidden_prices"),
    ("SELECT * FROM zeta JOIN alpha ON true", "Unknown or not allowed table(s): alpha, zeta"),
    ("WITH gone AS (UPDATE dim_seller SET city = 'y') SELECT 2", "Forbidden keyword: UPDATE"),
    ("", "Empty query."), (" \n ", "Empty query."),
])
def test_unsafe_statements(spark, stmt, reason):
    got = audit(spark, stmt)[0]
    assert (got["ok"], got["reason"], got["safe_sql"]) == (False, reason, None)


def test_limit_is_added_or_kept(spark):
    kept = "WITH few AS (SELECT order_id FROM fact_orders) SELECT max(order_id) FROM few LIMIT 7"
    added, same, twice = audit(spark, "SELECT city FROM dim_seller \n", kept, "SELECT 1 FROM dim_date LIMIT 5 OFFSET 2")
    assert added["safe_sql"] == "SELECT city FROM dim_seller\nLIMIT 500"
    assert same["safe_sql"] == kept and same["tables"] == ["fact_orders", "few"]
    assert twice["safe_sql"].endswith("OFFSET 2\nLIMIT 500")


def test_strings_and_comments_are_no_code(spark):
    texts = ["SELECT 1 FROM fact_reviews WHERE comment_message = 'please insert; it'", "SELECT 1 /* drop\n it; */ FROM dim_date",
             "SELECT 'it''s; a' FROM dim_date -- update; later", "SELECT created_at FROM fact_orders"]
    assert [r["ok"] for r in audit(spark, *texts)] == [True] * 4


def test_a_long_string_literal(spark):
    assert audit(spark, "SELECT '" + "x" * 200_000 + "' FROM dim_date")[0]["ok"]


@pytest.mark.parametrize("reply, stmt", [
    ("Try this:\n```sql\nSELECT max(year) FROM dim_date;\n```\nGood luck", "SELECT max(year) FROM dim_date"),
    ("It is with b as (select 2) select * from b ;; ", "with b as (select 2) select * from b"),
    ("DELETE FROM x;", "DELETE FROM x"),
])
def test_statement_is_pulled_out(spark, reply, stmt):
    df = spark.createDataFrame([(reply,)], "r string")
    assert fx.rows(df.select(sqlaudit.extract_sql(F.col("r")))) == [(stmt,)]


@pytest.fixture
def orders(spark):
    return {"fact_orders": spark.range(700).withColumnRenamed("id", "x")}


def test_guarded_run(spark, orders):
    assert fx.rows(sqlaudit.run_guarded(spark, orders, "SELECT count(*) AS n FROM fact_orders")) == [(700,)]
    assert sqlaudit.run_guarded(spark, orders, "SELECT x FROM fact_orders").count() == 500
    assert sqlaudit.run_guarded(spark, orders, "SELECT x FROM fact_orders", row_limit=None).count() == 700
    own = "WITH a AS (SELECT x FROM FACT_ORDERS), b AS (SELECT * FROM a, a AS c WHERE a.x = c.x) SELECT count(*) FROM b"
    assert fx.rows(sqlaudit.run_guarded(spark, orders, own)) == [(700,)]
    with pytest.raises(sqlaudit.UnsafeStatement, match="Only SELECT"):
        sqlaudit.run_guarded(spark, orders, "REPLACE TABLE fact_orders AS SELECT 1")


@pytest.mark.parametrize("stmt", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT `java_method`('java.lang.System', 'getProperty', 'user.home') FROM fact_orders",
    "SELECT x FROM fact_orders WHERE x = (SELECT count(try_reflect('java.lang.Math', 'random')) FROM fact_orders)",
    "SELECT * FROM fact_orders, parquet.`/root/testdata/sf0.001/customer.parquet`",
    "SELECT * FROM `parquet`.`/root/testdata/sf0.001/customer.parquet`",
    "SELECT * FROM fact_orders, other_view", "SELECT * FROM `other_view`",
    "SELECT x FROM fact_orders WHERE x IN (SELECT y FROM (SELECT 1 AS y), `other_view`)",
    "SELECT * FROM range(10), fact_orders",
    "SELECT " + ", ".join(f"x AS c{i}" for i in range(40)) + ", reflect('java.lang.System', 'getProperty', 'user.home') AS home FROM fact_orders",
    "WITH other_view AS (SELECT * FROM other_view) SELECT * FROM other_view",
    "SELECT * FROM other_view s JOIN (WITH other_view AS (SELECT 1 AS id) SELECT * FROM other_view) t ON true",
    "SELECT * FROM fact_orders WHERE EXISTS (SELECT nvl(reflect('java.lang.Math', 'random'), '1'))",
    "SELECT transform(array(x), y -> reflect('java.lang.Math', 'random')) AS a FROM fact_orders",
    "SELECT max(x) OVER (ORDER BY reflect('java.lang.Math', 'random')) AS a FROM fact_orders",
    "SELECT own_udf(x) AS a FROM fact_orders", "SELECT input_file_name() AS a FROM fact_orders", "SELECT current_user() AS a FROM fact_orders",
    "SELECT * FROM global_temp.shared_view", "SELECT * FROM VALUES (1), (2)", "SELECT 1 AS a FROM fact_orders LATERAL VIEW own_udtf() t AS b",
])
def test_what_spark_reads_is_checked_too(spark, orders, stmt):
    spark.range(3).createOrReplaceTempView("other_view")
    spark.range(3).createOrReplaceGlobalTempView("shared_view")
    spark.udf.register("own_udf", lambda x: x)
    given = {**orders, "shared_view": spark.range(1)} if "shared_view" in stmt else orders
    with pytest.raises((sqlaudit.UnsafeStatement, AnalysisException)):
        sqlaudit.run_guarded(spark, given, stmt).collect()
    spark.catalog.dropTempView("other_view")
    spark.catalog.dropGlobalTempView("shared_view")


@pytest.mark.parametrize("stmt, rows", [
    ("WITH a AS (SELECT x, x % 3 AS k FROM fact_orders WHERE x < 9) SELECT k, count(*) AS n, sum(x) AS s FROM a GROUP BY k ORDER BY k",
     [(0, 3, 9), (1, 3, 12), (2, 3, 15)]),
    ("SELECT x FROM fact_orders WHERE x IN (SELECT max(x) FROM fact_orders UNION SELECT 1) ORDER BY x", [(1,), (699,)]),
    ("SELECT x, rank() OVER (PARTITION BY x % 2 ORDER BY x DESC) AS r FROM fact_orders WHERE x < 4 ORDER BY x", [(0, 2), (1, 2), (2, 1), (3, 1)]),
    ("SELECT a.x, upper(lpad(nvl(string(b.x), 'none'), 5, '*')) AS t FROM fact_orders a LEFT JOIN fact_orders b ON a.x = b.x + 1 WHERE a.x < 2 "
     "ORDER BY 1", [(0, "*NONE"), (1, "****0")]),
    ("SELECT round(avg(x), 1) AS m, date_trunc('month', timestamp'2020-02-03') IS NULL AS d, ceil(1.2) AS c, percentile_approx(x, 0.5) AS p "
     "FROM fact_orders f WHERE x = (SELECT max(x) FROM fact_orders g WHERE g.x = f.x)", [(349.5, False, 2, 349)]),
    ("SELECT y, count(*) AS n FROM fact_orders LATERAL VIEW explode(array(1, 2)) t AS y GROUP BY y HAVING count(*) > 1 ORDER BY y", [(1, 700), (2, 700)]),
    ("SELECT DISTINCT CASE WHEN x BETWEEN 1 AND 2 THEN 'a' WHEN x LIKE '3%' THEN 'b' ELSE NULL END AS c FROM fact_orders ORDER BY c",
     [(None,), ("a",), ("b",)]),
])
def test_plain_statements_run(spark, orders, stmt, rows):
    assert [tuple(r) for r in sqlaudit.run_guarded(spark, orders, stmt).collect()] == rows


def test_given_tables_may_hold_anything(spark):
    made = spark.range(4).selectExpr("id", "uuid() AS u", "reflect('java.lang.Math', 'abs', -1) AS r")
    assert sqlaudit.run_guarded(spark, {"fact_orders": made}, "SELECT r, count(*) AS n FROM fact_orders GROUP BY r").collect() == [("1", 4)]


def test_a_slow_statement_ends_at_its_limit(spark, orders):
    many = {"fact_orders": spark.range(0, 200_000_000, 1, 800).withColumnRenamed("id", "x")}
    slow = "SELECT sum(length(sha2(sha2(sha2(string(x), 512), 512), 512))) AS n FROM fact_orders"
    began = time.monotonic()
    with pytest.raises(sqlaudit.StatementTimeout, match="4 seconds"):
        sqlaudit.fetch_guarded(spark, many, slow, seconds=4)
    assert time.monotonic() - began < 8
    assert not spark.sparkContext.getJobTags()
    assert [r.n for r in sqlaudit.fetch_guarded(spark, orders, "SELECT count(*) AS n FROM fact_orders")] == [700]
    with pytest.raises(ZeroDivisionError):
        sqlaudit.within(spark, 5, lambda: 1 / 0)


def test_views_of_the_caller_come_back_and_none_is_left(spark, orders):
    spark.range(3).createOrReplaceTempView("fact_orders")
    got = sqlaudit.run_guarded(spark, {**orders, "dim_date": spark.range(1)}, "SELECT count(*) FROM fact_orders")
    assert spark.table("fact_orders").count() == 3 and fx.rows(got) == [(700,)]
    spark.catalog.dropTempView("fact_orders")
    assert not [t.name for t in spark.catalog.listTables() if t.name in ("fact_orders", "dim_date")]
    with pytest.raises(Exception, match="no_such_column"):
        sqlaudit.run_guarded(spark, orders, "SELECT no_such_column FROM fact_orders")
    assert not [t.name for t in spark.catalog.listTables() if t.name == "fact_orders"]
