"""Validation: an ordered list of rules, of which the first that fails names the reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxmill.functions.scalars import blank, outside


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a row that breaks the rule."""

    reason: str
    fails: Column


def ping_rules() -> list[Rule]:
    """The six rules of a ping, in the order they are tried."""
    return [
        Rule("missing_truck_id", blank("truck_id")),
        Rule("missing_event_ts", F.col("event_ts_raw").isNull()),
        Rule("unparseable_event_ts", F.col("event_ts").isNull()),
        Rule("missing_coordinates", F.col("latitude").isNull() | F.col("longitude").isNull()),
        Rule("latitude_out_of_range", outside("latitude", 90.0)),
        Rule("longitude_out_of_range", outside("longitude", 180.0)),
    ]


def first_failure(rules: Sequence[Rule]) -> Column:
    """The reason of the first rule that fails, or null."""
    return reduce(lambda later, rule: F.when(rule.fails, F.lit(rule.reason)).otherwise(later), reversed(rules), F.lit(None).cast("string"))


def split(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rows with one; together all rows."""
    return df.where(F.col(reason).isNull()), df.where(F.col(reason).isNotNull())
