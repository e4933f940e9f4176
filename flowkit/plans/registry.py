"""Collects the queries of the library and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with SQL that gives the same rows."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return put


def rounded(name: str, *columns: str, digits: int = 6) -> None:
    """Round columns of a registered query and of its SQL: sums of doubles differ in the last bits with their order."""
    fn, sql = QUERIES[name], ORACLE[name]
    QUERIES[name] = lambda spark, sf_dir: (lambda df: df.withColumns({c: F.round(c, digits) for c in columns}))(fn(spark, sf_dir))
    ORACLE[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({sql})"
