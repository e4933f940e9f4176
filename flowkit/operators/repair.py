"""Repair of impossible byte counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.functions import scalar


def repair_impossible_bytes(slots: DataFrame, size: str, count: str, mean: str, most: float = 65535.0) -> DataFrame:
    """Sizes cut to count times the largest packet, means recomputed, and touched where a size was cut."""
    limit = F.col(count) * most
    return slots.withColumns({"touched": F.col(size) > limit, size: F.least(F.col(size), limit)}).withColumn(mean, scalar.safe_div(F.col(size), F.col(count)))
