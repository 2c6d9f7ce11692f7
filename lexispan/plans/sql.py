"""Guarded SQL over an index's relations, and its introspection."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a plan may hold: Spark's own parser decides, so strings, comments and names can't mislead.
_COMMANDS = ("Command", "Insert", "Create", "Drop", "Alter", "Replace", "Delete", "Update", "Merge", "Truncate", "Cache", "Refresh", "Set", "Add", "Load", "Analyze", "Use", "Show", "Describe", "Repair", "Unresolved3", "OverwriteByExpression", "OverwritePartitions", "AppendData")
FUNCTIONS_REFUSED = ("java_method", "reflect", "try_reflect")


class Refused(ValueError):
    """A statement that is no plain query."""


def _nodes(plan) -> list[str]:
    """Class names of a logical plan's nodes, those in subqueries and common table expressions included."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p.getClass().getSimpleName())
        for seq in (p.children(), p.innerChildren()):
            todo += [x for k in range(seq.size()) for x in [seq.apply(k)] if _is_plan(x)]
        for k in range(p.subqueries().size()):
            todo.append(p.subqueries().apply(k))
    return out


def _is_plan(x) -> bool:
    return "catalyst.plans" in x.getClass().getName() or "catalyst.analysis" in x.getClass().getName() or "execution" in x.getClass().getName()


def parsed(spark: SparkSession, text: str):
    """The statement as Spark's parser reads it, an EXPLAIN by what it explains."""
    statement = text.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:  # what the parser refuses, it says why
        raise Refused(str(e).split("\n")[0]) from None
    return (statement, plan.logicalPlan()) if plan.getClass().getSimpleName() == "ExplainCommand" else (statement, plan)


def check(spark: SparkSession, text: str) -> str:
    """The statement, if it is one query, or the explanation of one; else it is refused."""
    statement, plan = parsed(spark, text)
    for node in _nodes(plan):
        if node.startswith(_COMMANDS) or node.endswith(("Command", "Statement")):
            raise Refused(f"{node} is no query")
    low = plan.toString().lower()
    if any(f"'{f}(" in low or f" {f}(" in low for f in FUNCTIONS_REFUSED):
        raise Refused("a function that calls into the machine")
    return statement


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def is_limited(spark: SparkSession, text: str) -> bool:
    """Whether the statement's outermost part is a limit of its own."""
    _, plan = parsed(spark, text)
    while plan.getClass().getSimpleName() in ("UnresolvedWith", "WithCTE"):
        plan = plan.child() if plan.getClass().getSimpleName() == "UnresolvedWith" else plan.plan()
    return plan.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit", "LimitAll")


def _seq(x) -> list:
    return [x.apply(k) for k in range(x.size())]


def _not_in(plan) -> list:
    """The conditions NOT IN (query) on one column, among those that a filter's rows must all meet, subqueries left out."""
    out, todo, conditions = [], [plan], []
    while todo:
        p = todo.pop()
        todo += [x for seq in (p.children(), p.innerChildren()) for x in _seq(seq) if _is_plan(x)]
        conditions += [p.condition()] if p.getClass().getSimpleName() == "Filter" else []
    while conditions:
        e = conditions.pop()
        kinds = [e.getClass().getSimpleName(), *[x.getClass().getSimpleName() for x in _seq(e.children())]]
        if kinds[0] == "And":
            conditions += _seq(e.children())
        elif kinds == ["Not", "InSubquery"]:
            values = _seq(e.child().values())
            if [v.getClass().getSimpleName() for v in values] == ["UnresolvedAttribute"]:
                out.append((e, values[0]))
    return out


def by_shuffles(spark: SparkSession, statement: str) -> str:
    """The statement with each x NOT IN (query) of its filters spelled out: no row equal, none null, and x not null unless there are no rows.

    Spark can do NOT IN only by sending every row of the query through the driver; these it does by shuffles of distinct rows.
    What can't be told apart safely (x that is no column, queries with limits or chance) stays as it is."""
    _, plan = parsed(spark, statement)
    found, edits = _not_in(plan), []
    if not found or plan.getClass().getSimpleName() == "ExplainCommand" or "${" in statement or not statement.isascii():
        return statement
    span = lambda e: (e.origin().startIndex().get(), e.origin().stopIndex().get() + 1)
    for k, (e, x) in enumerate(found):
        (a, b), (c, d), name = span(x), span(e), f"_not_in_{k}"
        m = re.fullmatch(r"NOT\s+IN\s*(\(.*\))", statement[c:d], re.S | re.I)
        if not m or b > c or statement[b:c].strip() or {"GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Sample"} & set(_nodes(e.child().query().plan())):
            continue
        rows, col = f"FROM (SELECT DISTINCT * FROM {m[1]}) AS {name}({name}_c)", statement[a:b]
        same, null = (f"NOT EXISTS (SELECT 1 {rows} WHERE {name}_c {test})" for test in (f"= {col}", "IS NULL"))
        edits.append((a, d, f"({same} AND {null} AND ({col} IS NOT NULL OR NOT EXISTS (SELECT 1 FROM {m[1]})))"))
    for a, d, new in sorted(edits, reverse=True):
        statement = statement[:a] + new + statement[d:]
    return statement


def query(spark: SparkSession, text: str, limit: int = 100) -> DataFrame:
    """The rows of a query; at most limit of them unless it has a LIMIT of its own."""
    statement = check(spark, text)
    df = spark.sql(statement)
    if (spelled := by_shuffles(spark, statement)) != statement and df._jdf.queryExecution().analyzed().deterministic():
        try:
            df = spark.sql(spelled)
        except AnalysisException:  # a query that refers to the one around it can't stand deeper
            pass
    return df if is_limited(spark, text) or text.strip()[:7].upper() == "EXPLAIN" else df.limit(limit)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def schema(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, type, position and the table's n_rows."""
    out = None
    for name, df in tables.items():
        cols = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(i).alias("position")) for i, f in enumerate(df.schema)])
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), F.explode(cols).alias("c"), "n_rows").select("table_name", "c.*", "n_rows")
        out = part if out is None else out.unionByName(part)
    return out
