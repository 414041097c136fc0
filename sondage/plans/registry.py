"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def with_views(views: dict[str, str], needed: list[str], body: str) -> str:
    """Prefix a SQL body with the common table expressions it reads."""
    text = ", ".join(f"{name} AS ({views[name]})" for name in needed)
    return f"WITH {text} {body}"


def rnd(expr: str, digits: int = 6) -> str:
    """SQL rounding without negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def sql_case(expr: str, table: dict, default: str = "NULL") -> str:
    quote = lambda v: str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def sql_list(values) -> str:
    quote = lambda v: str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_bits(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def sql_uniform(*parts: str) -> str:
    return f"(({sql_bits(*parts)} + 0.5) / 4294967296.0::DOUBLE)"


def sql_gauss(*parts: str) -> str:
    return (
        f"(sqrt(-2.0::DOUBLE * ln({sql_uniform(*parts, chr(39) + 'g1' + chr(39))}))"
        f" * cos(2.0::DOUBLE * pi() * {sql_uniform(*parts, chr(39) + 'g2' + chr(39))}))"
    )


def sql_fixed2(x: str) -> str:
    return f"printf('%.2f', floor(({x}) * 100 + 0.500000001::DOUBLE) / 100.0::DOUBLE)"


def sql_fixed1(x: str) -> str:
    return f"printf('%.1f', floor(({x}) * 10 + 0.500000001::DOUBLE) / 10.0::DOUBLE)"


def sql_signed2(x: str) -> str:
    return f"((CASE WHEN {x} < 0 THEN '-' ELSE '+' END) || {sql_fixed2(f'abs({x})')})"
