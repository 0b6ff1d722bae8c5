"""Read-only SQL over the tables of a directory: admission, row cap and time limit."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stemma.tables import table

#: Rows and seconds that a gated query may take.
MAX_ROWS, MAX_SECONDS = 100, 10
# Nodes of a parsed statement that only read.
READING = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit LimitAndOffset Offset Union Distinct Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases"
    " UnresolvedInlineTable OneRowRelation UnresolvedHaving WithWindowDefinition Window LateralJoin Generate Pivot Expand UnresolvedOrdinal LocalRelation".split()
)


class SqlRejected(ValueError):
    """The text is not one reading statement over the known tables."""


@dataclass(frozen=True)
class Result:
    """The rows of a gated query, at most the cap; whether more were cut is computed on demand."""

    rows: DataFrame
    probe: DataFrame
    cap: int

    @property
    def truncated(self) -> bool:
        return self.probe.count() > self.cap


def _nodes(plan) -> list:  # noqa: ANN001
    out, stack = [], [plan]
    while stack:
        p = stack.pop()
        out.append(p)
        for seq in (p.children(), p.innerChildren()):
            it = seq.iterator()
            while it.hasNext():
                c = it.next()
                if hasattr(c, "children"):
                    stack.append(c)
        subqueries = p.expressions().iterator()
        while subqueries.hasNext():
            stack.extend(_plans(subqueries.next()))
    return out


def _plans(expression) -> list:  # noqa: ANN001
    """Plans of the subqueries inside an expression."""
    out, stack = [], [expression]
    while stack:
        e = stack.pop()
        name = e.getClass().getSimpleName()
        if name in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "UnresolvedScalarSubquery"):
            if name == "InSubquery":
                out.append(e.query().plan())
            else:
                out.append(e.plan())
        it = e.children().iterator()
        while it.hasNext():
            stack.append(it.next())
    return out


def admit(spark: SparkSession, sql: str, tables: set[str]) -> set[str]:
    """The tables that the text names, in lower case. Raises SqlRejected unless the text parses to one SELECT or set operation over `tables` and its own CTEs.

    Spark's parser reads the text; anything but reading nodes is refused, so are table functions and files as tables.
    Unlike in the engine that is re-expressed here, CTEs are allowed.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise SqlRejected(f"SQL_REJECTED: {str(e).splitlines()[0][:200]}") from e
    ctes, used = set(), set()
    for node in _nodes(plan):
        name = node.getClass().getSimpleName().rstrip("$")
        if name not in READING:
            raise SqlRejected(f"SQL_OPERATION_DENIED: {name}")
        if name == "UnresolvedWith":
            it = node.cteRelations().iterator()
            while it.hasNext():
                ctes.add(it.next()._1().lower())
        if name == "UnresolvedRelation":
            used.add(node.tableName().replace("`", "").lower())
    if unknown := used - ctes - {t.lower() for t in tables}:
        raise SqlRejected(f"SQL_TABLE_DENIED: {sorted(unknown)}")
    if re.search(r"\b(java_method|reflect|try_reflect|input_file_name|read_files|secret)\s*\(", sql, re.I):
        raise SqlRejected("SQL_FUNCTION_DENIED")
    return used


def run(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The whole result of an admitted statement over the parquet tables of a directory, without a cap.

    The statement runs as it is, in a session of its own in which the tables it names are views; so texts in it stay as they
    are, and neither sessions nor directories meet.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(d)
    known = {s.getPath().getName().removesuffix(".parquet") for s in path.getFileSystem(conf).listStatus(path)}
    used = admit(spark, sql, known)
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    for n in known:
        if n.lower() in used:
            table(own, d, n).createOrReplaceTempView(n)
    return own.sql(sql)


def capped(spark: SparkSession, d: str, sql: str, cap: int = MAX_ROWS) -> Result:
    """At most `cap` rows; a smaller LIMIT of the statement's own stays in force."""
    whole = run(spark, d, sql)
    return Result(whole.limit(cap), whole.limit(cap + 1), cap)


def collect_in_time(df: DataFrame, seconds: float = MAX_SECONDS) -> list:
    """Collects a capped result, or cancels its jobs and raises TimeoutError."""
    sc, group = df.sparkSession.sparkContext, f"gate-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "gated query", interruptOnCancel=True)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def question(spark: SparkSession, d: str, text: str, ask, cap: int = MAX_ROWS) -> tuple[str, Result]:  # noqa: ANN001
    """(SQL, rows) for a question in words: `ask` gets the question and the columns of each table, and gives one statement, which is admitted like any other."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(d)
    names = sorted(s.getPath().getName().removesuffix(".parquet") for s in path.getFileSystem(conf).listStatus(path) if s.getPath().getName().endswith(".parquet"))
    schema = {n: [f"{f.name} {f.dataType.simpleString()}" for f in table(spark, d, n).schema.fields] for n in names}
    answer = ask(text, schema)
    sql = answer.get("sql") if isinstance(answer, dict) else answer
    if not isinstance(sql, str) or not sql.strip():
        raise SqlRejected("SQL_REJECTED: no statement was given")
    return sql, capped(spark, d, sql, cap)
