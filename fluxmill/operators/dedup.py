"""One row per key, deterministically."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], sequence: str, ties: Sequence[str] | None = None) -> DataFrame:
    """The row with the greatest ``sequence`` of each key; ties fall to the greatest ``ties`` (all other columns)."""
    more = [c for c in df.columns if c not in (*keys, sequence)] if ties is None else ties
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in (sequence, *more)])
    return df.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def any_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key, the one with the greatest other columns: an aggregate with map-side combining, no sort.

    Null keys form one group each, as in grouping.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    kept = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])
