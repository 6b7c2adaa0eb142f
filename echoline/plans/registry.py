"""The registry of queries (spark, sf_dir) -> DataFrame and of their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    """Sums of doubles differ in the last bits with the order of rows; both engines round them alike."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})
