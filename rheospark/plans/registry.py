"""How a query is registered: the Spark form, the SQL form, and doubles rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6
#: Added before rounding: decimals that end halfway between two roundings are common here, and engines differ on them.
NUDGE = 3.7e-10


def tidy(df: DataFrame, doubles: list[str]) -> DataFrame:
    """Integers as long, dates as text; the named doubles rounded, without negative zeros and NaN."""
    cells = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if f.name in doubles:
            cells[f.name] = F.round(F.nanvl(F.col(f.name).cast("double"), F.lit(None)) + NUDGE, DIGITS) + 0.0
        elif kind in ("int", "smallint", "tinyint"):
            cells[f.name] = F.col(f.name).cast("long")
        elif kind == "date":
            cells[f.name] = F.col(f.name).cast("string")
    return df.withColumns(cells) if cells else df


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query; sql may begin with WITH, and its doubles are rounded by a select around it."""
    rounded = doubles.split()

    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir), rounded)
        if sql:
            head, _, last = ("\n" + sql.strip()).rpartition("\nFINAL ")
            head = head.strip()
            replace = f" REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE) + CAST({NUDGE} AS DOUBLE), {DIGITS}) + 0.0 AS {c}' for c in rounded)})" if rounded else ""
            ORACLE[name] = f"WITH {head}\nSELECT *{replace} FROM ({last})" if head else f"SELECT *{replace} FROM ({last})"
        return f

    return register
