"""Raw pings to validated, keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxmill.functions.scalars import parsed_timestamp, ping_id, reject_id
from fluxmill.operators.rules import first_failure, ping_rules

CLEAN = ["ping_id", "truck_id", "event_ts", "event_date", "latitude", "longitude", "event_ts_raw", "_source_file", "_ingested_at", "_processed_at"]
REJECTED = ["reject_id", "truck_id", "event_ts_raw", "latitude", "longitude", "reject_reason", "_source_file", "_quarantined_at"]


def typed(raw: DataFrame) -> DataFrame:
    """Parse, key and judge raw pings; narrow, so it runs on streams and batches alike."""
    named = raw.withColumnRenamed("event_ts", "event_ts_raw").withColumn("event_ts", parsed_timestamp())
    return named.withColumns({"event_date": F.to_date("event_ts"), "ping_id": ping_id(), "_processed_at": F.current_timestamp(), "reject_reason": first_failure(ping_rules())})


def clean_rows(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reject_reason").isNull()).select(*CLEAN)


def rejected_rows(judged: DataFrame) -> DataFrame:
    bad = judged.where(F.col("reject_reason").isNotNull())
    return bad.withColumns({"reject_id": reject_id("truck_id", "event_ts_raw", "latitude", "longitude", "_source_file"), "_quarantined_at": F.current_timestamp()}).select(*REJECTED)
