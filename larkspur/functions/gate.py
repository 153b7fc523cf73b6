"""The strict profile: statements whose semantics are not promised are rejected before they run.

Statements are judged by Spark's own parse of them, node by node, so that neither nesting nor literals mislead it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rejected(Exception):
    """A statement that the engine does not run, with its SQLSTATE."""

    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"{sqlstate}: {message}")
        self.sqlstate = sqlstate


#: Error conditions and the SQLSTATE each is reported under.
SQLSTATES = {"TABLE_OR_VIEW_NOT_FOUND": "42P01", "UNRESOLVED_COLUMN": "42703", "DATATYPE_MISMATCH": "42804", "SCALAR_SUBQUERY_TOO_MANY_ROWS": "21000", "DIVIDE_BY_ZERO": "22012", "UNRESOLVED_ROUTINE": "42883", "PARSE_SYNTAX_ERROR": "42601", "CAST_INVALID_INPUT": "22P02", "ARITHMETIC_OVERFLOW": "22003"}

#: Types of bound parameters, and the most parameters and bytes of one statement.
PARAMETER_TYPES = {"smallint": int, "int": int, "bigint": int, "real": float, "double": float, "numeric": Decimal, "text": str, "varchar": str, "date": lambda v: date.fromisoformat(str(v)), "boolean": lambda v: v if isinstance(v, bool) else {"true": True, "t": True, "false": False, "f": False}[str(v).lower()]}
MOST_PARAMETERS = 1024
MOST_BYTES = 1 << 20

LITERALS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.S)
_REJECTED = {
    r"^\s*(begin|commit|rollback|start\s+transaction|savepoint)\b": "transaction blocks",
    r"\bcreate\s+table\b.*\b(primary\s+key|unique|references|check|default|not\s+null)\b": "constraints and defaults",
}
#: Parsed nodes that are refused.
_NODES = {"SpecifiedWindowFrame": "window frames", "WithWindowDefinition": "named windows", "WindowSpecReference": "named windows", "UnresolvedTableValuedFunction": "table functions", "Generate": "lateral views", "LateralJoin": "lateral joins"}


def bare(sql: str) -> str:
    """sql with empty literals and without comments."""
    return LITERALS.sub(lambda m: " " * len(m[0]) if m[0][0] in "-/" else "''", sql)


def check(sql: str) -> str:
    """The one statement of sql, or Rejected."""
    parts = [p for p in bare(sql).split(";") if p.strip()]
    if len(parts) != 1:
        raise Rejected("42601", "exactly one statement is expected")
    for pattern, what in _REJECTED.items():
        if re.search(pattern, parts[0], re.I | re.S):
            raise Rejected("0A000", f"{what} are not supported")
    return sql.rstrip().rstrip(";")


def nodes(plan) -> Iterator:
    """Every node of a parsed plan: operators, expressions, and those of CTEs and subqueries."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for part in ("children", "expressions", "innerChildren"):
            if part != "expressions" or hasattr_java(node, "expressions"):
                found = getattr(node, part)()
                todo += [found.apply(i) for i in range(found.size())]


def hasattr_java(node, name: str) -> bool:
    return any(m.getName() == name for m in node.getClass().getMethods())


def kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def parsed(spark: SparkSession, sql: str):
    """Spark's parse of one checked statement, or Rejected."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except PySparkException as e:
        raise rejected(e) from e
    for node in nodes(plan):
        name = kind(node)
        if name in _NODES:
            raise Rejected("0A000", f"{_NODES[name]} are not supported")
        if name == "UnresolvedWith" and hasattr_java(node, "allowRecursion") and node.allowRecursion():
            raise Rejected("0A000", "recursive queries are not supported")
    return plan


def rejected(e: PySparkException | Py4JJavaError) -> Rejected:
    """The refusal of a statement that failed; errors of Java alone are read from their first cause that has a condition."""
    message = str(e)
    if isinstance(e, Py4JJavaError):
        cause = e.java_exception
        while cause is not None and not hasattr_java(cause, "getCondition"):
            cause = cause.getCause()
        if cause is None:
            return Rejected("XX000", message.strip().split("\n")[0])
        e, message = cause, cause.getMessage()
    condition = (e.getCondition() or "").split(".")[0]
    return Rejected(SQLSTATES.get(condition, e.getSqlState() or "XX000"), message.strip().split("\n")[0])


def with_parameters(sql: str) -> str:
    """$1, $2, ... outside literals as named markers."""
    pieces, at = [], 0
    for m in [*LITERALS.finditer(sql), None]:
        end = m.start() if m else len(sql)
        pieces.append(re.sub(r"\$(\d+)", r":p\1", sql[at:end]))
        if m:
            pieces.append(m[0])
            at = m.end()
    return "".join(pieces)


def bound(parameters: list | None, types: list[str] | None) -> dict:
    """Named arguments; with types, each value is cast to its own, and a parameter without a known one is refused."""
    values = list(parameters or [])
    if len(values) > MOST_PARAMETERS:
        raise Rejected("54023", "too many parameters")
    if sum(len(str(v).encode("utf-8")) for v in values if v is not None) > MOST_BYTES:
        raise Rejected("54000", "parameters are too long")
    if types is None:
        return {f"p{i}": F.lit(v) for i, v in enumerate(values, 1)}
    if len(types) != len(values):
        raise Rejected("08P01", f"{len(types)} parameters are expected, {len(values)} given")
    unknown = [t for t in types if t not in PARAMETER_TYPES]
    if unknown:
        raise Rejected("42P18", f"parameters of unknown type: {unknown}")
    try:
        return {f"p{i}": F.lit(None if v is None else PARAMETER_TYPES[t](v)) for i, (v, t) in enumerate(zip(values, types, strict=True), 1)}
    except (ValueError, ArithmeticError, KeyError) as e:
        raise Rejected("22P02", str(e)) from e


def strict_sql(spark: SparkSession, sql: str, parameters: list | None = None, types: list[str] | None = None) -> DataFrame:
    """Run one checked statement with bound parameters $1, $2, ..., outside literals."""
    sql = with_parameters(check(sql))
    parsed(spark, sql)
    try:
        return spark.sql(sql, args=bound(parameters, types))
    except PySparkException as e:
        raise rejected(e) from e


def collected(df: DataFrame) -> list:
    """A result's rows; errors while it runs are reported under their SQLSTATE."""
    try:
        return df.collect()
    except (PySparkException, Py4JJavaError) as e:
        raise rejected(e) from e
