"""Serving tables: latest position per truck, and activity per region and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxmill.config import Geofence
from fluxmill.functions.scalars import WINDOW, capacity_tons, in_geofence, region_or_unknown, tumbling

DIMENSION = ["truck_id", "make", "model", "capacity_lbs", "home_depot", "region", "driver"]
#: Bytes of the dimension's values up to which it is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20


def measured(df: DataFrame) -> int:
    """Bytes of all values, as text, and a word for each; one aggregate."""
    each = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns[1:]), F.coalesce(F.octet_length(F.col(df.columns[0]).cast("string")), F.lit(0)) + 8)
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def enrich(df: DataFrame, trucks: DataFrame, columns: list[str], size: int | None = None) -> DataFrame:
    """Left join to the dimension on truck_id; broadcast only if ``size``, its measured bytes, allows it.

    Without a size the choice is left to the planner's own statistics.
    """
    side = trucks.select(*columns)
    if size is not None and size <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return df.join(side, "truck_id", "left")


def latest_position(pings: DataFrame) -> DataFrame:
    """Each truck's newest ping; equal instants fall to the greater latitude, then longitude."""
    newest = F.max(F.struct("event_ts", "latitude", "longitude"))
    return pings.groupBy("truck_id").agg(newest.alias("p")).select("truck_id", F.col("p.event_ts").alias("last_event_ts"), "p.latitude", "p.longitude")


def current_position(pings: DataFrame, trucks: DataFrame, fence: Geofence, size: int | None = None) -> DataFrame:
    out = enrich(latest_position(pings), trucks, DIMENSION, size)
    return out.withColumns({"in_geofence": in_geofence(fence), "geofence_name": F.lit(fence.name), "capacity_tons": capacity_tons(), "_updated_at": F.current_timestamp()})


def region_activity(pings: DataFrame, trucks: DataFrame, size: int | None = None) -> DataFrame:
    """Pings and distinct trucks per region and window.

    Pings are first added up per truck and window; the truck's region is looked
    up on those sums, and a truck counts once in its region's window, so no
    distinct expansion and no second shuffle of single pings is needed.
    """
    per_truck = pings.groupBy("truck_id", tumbling().alias("w")).agg(F.count(F.lit(1)).alias("n"))
    placed = enrich(per_truck, trucks, ["truck_id", "region"], size)
    return placed.groupBy(region_or_unknown().alias("region"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")).agg(F.sum("n").alias("ping_count"), F.count("truck_id").alias("truck_count")).withColumn("_updated_at", F.current_timestamp())


def touched_windows(batch: DataFrame, width: str = WINDOW) -> DataFrame:
    return batch.select(tumbling(width=width).start.alias("window_start")).distinct()


#: Days up to which a recompute asks for them one by one; more are asked for as a range.
LISTED_DAYS = 4096


def recompute_touched(batch: DataFrame, silver: DataFrame, trucks: DataFrame, size: int | None = None, width: str = WINDOW) -> DataFrame | None:
    """Activity of every window the batch touches, from all of Silver; None for a batch without pings.

    The days that the windows lie on become a filter on event_date, by which
    Silver is partitioned, so a late ping reads its own day and no other; the
    windows themselves are a semi-join, so no list of them passes through the
    driver.
    """
    touched = touched_windows(batch, width).persist()
    day = F.col("event_date")
    try:
        last = F.col("window_start") + F.expr(f"INTERVAL {_seconds(width) - 1} SECONDS")
        spans = touched.select(F.to_date("window_start").alias("a"), F.to_date(last).alias("b"))
        days = [r[0] for r in spans.select(F.explode(F.sequence("a", "b"))).distinct().limit(LISTED_DAYS + 1).collect()]
        if not days:
            return None
        wanted = day.isin(sorted(days)) if len(days) <= LISTED_DAYS else day.between(*[F.lit(d) for d in spans.agg(F.min("a"), F.max("b")).first()])
    finally:
        touched.unpersist()
    ranged = silver.where(wanted)
    scoped = ranged.withColumn("window_start", tumbling(width=width).start).join(touched, "window_start", "left_semi").drop("window_start")
    return region_activity(scoped, trucks, size)


def _seconds(width: str) -> int:
    number, unit = width.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
