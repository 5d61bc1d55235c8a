"""Checks of size before a table is broadcast or collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 50_000


def bounded(df: DataFrame, what: str, most: int = MOST) -> DataFrame:
    """df, or an error if it has more than `most` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what} has more than {most} rows")
    return df


def small(df: DataFrame, what: str, most: int = MOST) -> DataFrame:
    """df for a broadcast, of checked size."""
    return F.broadcast(bounded(df, what, most))
