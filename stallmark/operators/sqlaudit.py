"""Audit a log of SQL statements: pull the statement out, judge it, bound it.

Judged on the text alone: quoted table names, comma joins and recursive definitions are not recognised, and
``LIMIT n OFFSET m`` does not count as a final limit.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import taxonomy as tx
from ..functions.fence import compute_once
from ..functions.text import rstrip, strip
from ..schemas import STAR_TABLES

# What a statement is read by.
FENCE = r"(?si)```(?:sql)?\s*(.*?)```"
STATEMENT = r"(?si)\b(with|select)\b.*"
STRING_LITERAL = r"'[^']*(?:''[^']*)*'"
LINE_COMMENT = r"--[^\n]*"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
OPENING = r"^\s*(select|with)\b"
FORBIDDEN = r"\b(" + "|".join(tx.FORBIDDEN_KEYWORDS) + r")\b"
DEFINED_NAME = r"(?:with|,)\s*([a-z_][a-z0-9_]*)\s+as\s*\("
USED_TABLE = r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)"
FINAL_LIMIT = r"\blimit\s+\d+\s*$"
_UNICODE = "(?U)"


def extract_sql(reply: Column) -> Column:
    """The statement in a reply: without code fence, leading words and trailing semicolons."""
    inner = F.when(reply.rlike(FENCE), F.regexp_extract(reply, FENCE, 1)).otherwise(reply)
    found = F.when(inner.rlike(STATEMENT), F.regexp_extract(inner, STATEMENT, 0)).otherwise(inner)
    return strip(F.rtrim(strip(found), F.lit(";")))


def mask(sql: Column) -> Column:
    """The statement without the content of string literals and without comments."""
    bare = F.regexp_replace(sql, STRING_LITERAL, "''")
    bare = F.regexp_replace(bare, LINE_COMMENT, " ")
    return F.regexp_replace(bare, BLOCK_COMMENT, " ")


def _names(code: Column, pattern: str) -> Column:
    return F.regexp_extract_all(code, F.lit(_UNICODE + pattern), F.lit(1))


def audit_sql(log: DataFrame, stmt: str = "stmt", allowed: list[str] = STAR_TABLES,
              row_limit: int | None = tx.STATEMENT_ROW_LIMIT) -> DataFrame:
    """Add ok, reason, tables and safe_sql. The first broken rule gives the reason; ``row_limit=None`` adds no limit."""
    sql = F.col(stmt)
    code = F.col("_code")
    masked = log.withColumn("_code", F.lower(mask(sql)))
    found = compute_once(
        masked,
        F.array_sort(F.array_distinct(_names(code, USED_TABLE))).alias("tables"),
        F.array_except(
            _names(code, USED_TABLE),
            F.concat(F.array(*[F.lit(t) for t in allowed]), _names(code, DEFINED_NAME))).alias("_unknown"),
        F.regexp_extract(code, _UNICODE + FORBIDDEN, 1).alias("_keyword"))
    reason = (F.when(strip(sql) == "", F.lit("Empty query."))
              .when(code.contains(";"), F.lit("Only one statement is allowed."))
              .when(~code.rlike(_UNICODE + OPENING), F.lit("Only SELECT queries are allowed."))
              .when(F.col("_keyword") != "", F.concat(F.lit("Forbidden keyword: "), F.upper("_keyword")))
              .when(F.size("_unknown") > 0, F.concat(
                  F.lit("Unknown or not allowed table(s): "), F.array_join(F.array_sort("_unknown"), ", "))))
    limited = sql if row_limit is None else F.when(strip(code).rlike(_UNICODE + FINAL_LIMIT), sql).otherwise(
        F.concat(rstrip(sql), F.lit(f"\nLIMIT {row_limit}")))
    return (compute_once(found, reason.alias("reason"))
            .select(*log.columns, F.col("reason").isNull().alias("ok"), "reason", "tables",
                    F.when(F.col("reason").isNull(), limited).alias("safe_sql")))


class UnsafeStatement(ValueError):
    """The statement broke a rule; the message says which."""


class StatementTimeout(UnsafeStatement):
    """The statement ran longer than its limit."""


# Nodes of a resolved plan, by class, that a statement may have beside the tables it was given.
PLAN_NODES = frozenset(
    "Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join "
    "LateralJoin LocalLimit Offset OneRowRelation Project Repartition RepartitionByExpression ResolvedHint Sample Sort "
    "SubqueryAlias Tail Union Window WithCTE".split())
SUBQUERIES = frozenset("Exists LateralSubquery ListQuery ScalarSubquery".split())
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
#: Groups of built-in functions that a statement may not call: they reach beyond the data (``reflect``, sessions, files).
REFUSED_GROUPS = frozenset({"misc_funcs", ""})


def _each(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


@lru_cache(maxsize=1)
def _refused_classes(application: str) -> frozenset[str]:
    """Expression classes of the built-in functions in refused groups that no other group has; once for each application."""
    builtin = SparkContext._active_spark_context._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    infos = [builtin.lookupFunction(name).get() for name in _each(builtin.listFunction().toSeq())]
    by_group = [(info.getGroup() or "", info.getClassName()) for info in infos]
    fine = {name for group, name in by_group if group not in REFUSED_GROUPS}
    return frozenset(name for group, name in by_group if group in REFUSED_GROUPS and name not in fine)


def _refused_in(plan, allowed: set[str], refused: frozenset[str]) -> Iterator[str]:
    """What a resolved plan has beyond the allowed views and nodes, down to every expression and subquery."""
    plans, expressions = [plan], []
    while plans or expressions:
        if expressions:
            node = expressions.pop()
            name = node.getClass().getName()
            short = name.rpartition(".")[2]
            if not name.startswith(_EXPRESSIONS) or name in refused or re.search(r"UDA?T?F|Reflect", short):
                yield short
                continue
            expressions += _each(node.children())
            if short in SUBQUERIES:
                plans.append(node.plan())
            elif "Subquery" in short and short != "InSubquery":
                yield short
            continue
        node = plans.pop()
        short = node.getClass().getName().rpartition(".")[2].rstrip("$")
        if short == "View":
            table = node.desc().identifier()
            if not node.isTempView() or table.database().isDefined() or table.table().lower() not in allowed:
                yield table.unquotedString()
            continue  # what a given table is made of is its owner's business
        if short not in PLAN_NODES:
            yield short
            continue
        expressions += _each(node.expressions())
        plans += _each(node.children())


def refused_names(spark: SparkSession, plan, allowed: Iterable[str]) -> list[str]:
    """What the resolved ``plan`` uses beyond the allowed views: other relations, functions of Spark's session or the virtual
    machine, user-defined functions, table functions, files. Its nodes are visited, not its printed form."""
    return sorted(set(_refused_in(plan, {a.lower() for a in allowed}, _refused_classes(spark.sparkContext.applicationId))))


def _resolved(spark: SparkSession, tables: dict[str, DataFrame], stmt: str) -> DataFrame:
    """The statement over ``tables`` alone, resolved in a session of its own that no other view is in, then judged."""
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, value in spark.conf.getAll.items():
        if name.startswith(("spark.sql.session.", "spark.sql.ansi.", "spark.sql.caseSensitive")):
            own.conf.set(name, value)
    session, dataset = own._jsparkSession, spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, table in tables.items():
        dataset.ofRows(session, table._jdf.logicalPlan()).createOrReplaceTempView(name)
    try:
        plan = own.sql(stmt)._jdf.queryExecution().analyzed()
        refused = refused_names(spark, plan, tables)
    finally:
        for name in tables:
            own.catalog.dropTempView(name)
    if refused:
        raise UnsafeStatement(f"Not allowed: {', '.join(refused)}")
    return DataFrame(dataset.ofRows(spark._jsparkSession, plan), spark)


def run_guarded(spark: SparkSession, tables: dict[str, DataFrame], stmt: str,
                row_limit: int | None = tx.STATEMENT_ROW_LIMIT) -> DataFrame:
    """Run one statement over the given tables, with at most ``row_limit`` rows (None: all).

    Two layers: the audit of the text, and the nodes of the plan that Spark resolves it to. Only the given tables and plain
    functions of their values can be reached. The session of the caller, its views included, is neither seen nor changed.
    A statement that does not resolve over these tables fails as Spark fails it.
    """
    verdict = audit_sql(spark.createDataFrame([(stmt,)], "stmt string"), allowed=list(tables), row_limit=row_limit).first()
    if not verdict["ok"]:
        raise UnsafeStatement(verdict["reason"])
    result = _resolved(spark, tables, verdict["safe_sql"])
    return result if row_limit is None else result.limit(row_limit)


def within(spark: SparkSession, seconds: float, action: Callable[[], object]):
    """What ``action`` returns, unless its jobs take longer than ``seconds``: then they are cancelled and the call fails.

    Only jobs that this thread starts are touched; the session stays usable.
    """
    context = spark.sparkContext
    tag, over, late = f"guarded-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            while not over.wait(0.1):  # jobs that begin later are cancelled as well
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        result = action()
    except Exception as error:
        if late.is_set():
            raise StatementTimeout(f"The statement took more than {seconds:g} seconds.") from error
        raise
    finally:
        over.set()
        context.removeJobTag(tag)
        watcher.join()
    if late.is_set():
        raise StatementTimeout(f"The statement took more than {seconds:g} seconds.")
    return result


def fetch_guarded(spark: SparkSession, tables: dict[str, DataFrame], stmt: str, seconds: float = tx.STATEMENT_SECONDS,
                  row_limit: int = tx.STATEMENT_ROW_LIMIT) -> list[Row]:
    """The rows of a guarded statement, at most ``row_limit``, within ``seconds`` from the call on."""
    return within(spark, seconds, lambda: run_guarded(spark, tables, stmt, row_limit).collect())
