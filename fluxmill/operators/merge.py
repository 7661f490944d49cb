"""MERGE as plain joins: what a target holds after a keyed write."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxmill.operators.dedup import any_per_key, latest_per_key

log = logging.getLogger(__name__)


def tolerant(source: DataFrame, target_columns: Sequence[str], name: str = "target") -> DataFrame:
    """Only the columns the target has; the others are reported, so writers may run ahead of migrations."""
    skipped = [c for c in source.columns if c not in target_columns]
    if skipped:
        log.warning("%s has no column(s) %s yet; they are not written", name, ", ".join(skipped))
    return source.select(*[c for c in source.columns if c in target_columns])


def one_per_key(source: DataFrame, keys: Sequence[str], sequence: str | None) -> DataFrame:
    return latest_per_key(source, keys, sequence) if sequence in source.columns else any_per_key(source, keys)


def require_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail the write on a null key, which no later write could ever match. Checked in the write's own pass."""
    return source.withColumns({k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null in key column {k}"))).otherwise(F.col(k)) for k in keys})


def insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str], sequence: str | None = None) -> DataFrame:
    """The rows to append: one for each key the target doesn't hold. Null keys never match."""
    fresh = one_per_key(tolerant(source, target.columns), keys, sequence)
    return fresh.join(target.select(*keys), list(keys), "left_anti").select(*fresh.columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], sequence: str | None = None) -> DataFrame:
    """The target after the write, in its columns.

    A matched row takes the source's columns, with ``sequence`` only if the
    source's is at least the target's (null on either side: unchanged).  Columns
    the source lacks keep their value, or are null in new rows; a source of
    nothing but keys only inserts.
    """
    given = one_per_key(tolerant(source, target.columns), keys, sequence)
    other = [c for c in given.columns if c not in keys]
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("t_here"))
    s = given.select(*[F.col(c).alias(f"s_{c}") for c in given.columns], F.lit(True).alias("s_here"))
    both = t.join(s, [F.col(f"t_{k}") == F.col(f"s_{k}") for k in keys], "full_outer")
    newer = F.coalesce(F.col(f"s_{sequence}") >= F.col(f"t_{sequence}"), F.lit(False)) if sequence in other else F.lit(True)
    take = F.col("s_here").isNotNull() & (F.col("t_here").isNull() | newer)

    def column(c: str):
        if c in keys:
            return F.coalesce(f"t_{c}", f"s_{c}").alias(c)
        return (F.when(take, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")) if c in other else F.col(f"t_{c}")).alias(c)

    return both.select(*[column(c) for c in target.columns])
