"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.operators.components import checkpoint

__all__ = ["SPACE", "WORD", "checkpoint", "table", "tasks_for", "text_of"]

#: White space of the word rules: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def tasks_for(n_bytes: int, per_task: int, least: int = 1) -> int:
    """How many tasks share n_bytes when each takes about per_task."""
    return max(least, -(-int(n_bytes) // per_task))
