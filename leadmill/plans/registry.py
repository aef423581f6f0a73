"""The registry of queries and their SQL twins, and rows that the driver's tables do not have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time with or without a zone; the session's zone is UTC."""
    return F.unix_micros(c.cast("timestamp"))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(_literal, value))}]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


_SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "array<string>": "VARCHAR[]"}


@dataclass(frozen=True)
class Sample:
    """Planted rows, for Spark and for the SQL twins, so that queries reach cases the tables lack."""

    schema: str
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        fields = [f.split(" ") for f in self.schema.split(", ")]
        casts = ", ".join(f"CAST(x{i} AS {_SQL_TYPES[kind]}) AS {name}" for i, (name, kind) in enumerate(fields))
        values = ", ".join(f"({', '.join(map(_literal, row))})" for row in self.rows)
        return f"(SELECT {casts} FROM (VALUES {values}) t({', '.join(f'x{i}' for i in range(len(fields)))}))"


def shared(columns: dict[str, str]) -> list[str]:
    """Expressions that read the same in Spark and in the twin, as a select list."""
    return [f"{e} AS {c}" for c, e in columns.items()]
