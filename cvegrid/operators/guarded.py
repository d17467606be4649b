"""SQL text from outside, limited to reading and to a capped, compact result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvegrid.catalog import VIEW_NAMES
from cvegrid.functions.text import cut_text

MAX_ROWS = 100
MAX_CELL = 200


# What a statement may consist of, as Spark's own parser names it.
STEPS = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving",
    "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot",
    "Window", "WithWindowDefinition",
}
# Built-in functions that reach beyond the rows: methods of the JVM, the session and its files.
REFUSED_FUNCTIONS = {
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length",
    "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "version", "raise_error",
}


class RejectedSql(ValueError):
    """SQL text that is not a SELECT over the registered views."""


def _listed(sequence) -> list:
    """A Scala sequence as a Python list."""
    return [sequence.apply(k) for k in range(sequence.size())]


def _check(spark: SparkSession, sql: str) -> None:
    """Refuse all but known steps, the registered views and harmless built-in functions.

    The statement is parsed by Spark, not looked up or run, before it is judged.
    """
    jvm = spark.sparkContext._jvm
    catalyst = jvm.org.apache.spark.sql.catalyst
    named = lambda name: jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}")
    step, subquery = named("plans.logical.LogicalPlan"), named("expressions.PlanExpression")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise RejectedSql("the statement cannot be parsed") from error
    builtin = catalyst.analysis.FunctionRegistry.builtin()
    generators = catalyst.analysis.TableFunctionRegistry.builtin()
    waiting = [(plan, frozenset(VIEW_NAMES.values()))]
    while waiting:
        node, names = waiting.pop()
        kind = node.getClass().getSimpleName()
        if step.isInstance(node):
            if kind not in STEPS:
                raise RejectedSql(f"{kind} is not permitted")
            if kind == "UnresolvedWith":
                parts = [(str(r.productElement(0)).lower(), r.productElement(1)) for r in _listed(node.cteRelations())]
                names = names | {name for name, _ in parts}
                waiting += [(relation, names) for _, relation in parts]
            if kind == "UnresolvedRelation":
                parts = [str(p).lower() for p in _listed(node.multipartIdentifier())]
                if len(parts) != 1 or parts[0] not in names:
                    raise RejectedSql(f"{'.'.join(parts)} is not a registered view")
            waiting += [(part, names) for part in _listed(node.expressions())]
        elif subquery.isInstance(node):
            waiting.append((node.plan(), names))
        elif kind == "UnresolvedFunction":
            parts = [str(p).lower() for p in _listed(node.nameParts())]
            function = catalyst.FunctionIdentifier(parts[-1])
            known = builtin.functionExists(function) or generators.functionExists(function)
            if len(parts) != 1 or not known or parts[0] in REFUSED_FUNCTIONS:
                raise RejectedSql(f"function {'.'.join(parts)} is not permitted")
        waiting += [(child, names) for child in _listed(node.children())]


def guarded_select(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Run a SELECT over the registered views and keep at most ``max_rows`` rows.

    Other relations, files, scripts, methods of the JVM and functions that aren't built in are
    refused.  The cap is on the result, so a LIMIT inside a subquery cannot lift it and a
    smaller outer LIMIT stands.
    """
    if not re.match(r"\s*select\b", sql, re.IGNORECASE):
        raise RejectedSql("only SELECT statements are permitted")
    statement = sql.strip().rstrip(";")
    _check(spark, statement)
    return row_cap(spark.sql(statement), max_rows)


def row_cap(result: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return result.limit(max_rows)


def cell_truncate(result: DataFrame, most: int = MAX_CELL) -> DataFrame:
    """Cut long texts; arrays print one element per line, each element cut."""
    columns = []
    for field in result.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            column = cut_text(column, most)
        elif isinstance(field.dataType, T.ArrayType):
            items = F.transform(column.cast("array<string>"), lambda item: cut_text(item, most))
            column = F.array_join(items, "\n")
        columns.append(column.alias(field.name))
    return result.select(*columns)
