import math

import pytest
from pyspark.sql import functions as F

from fluxmill.config import Geofence
from fluxmill.functions.scalars import capacity_tons, in_geofence
from fluxmill.operators import dedup, rules, silver

TS = "2024-01-01T00:00:00+00:00"
CASES = [
    (None, 1.0, 1.0, TS, "missing_truck_id"),
    ("  ", 1.0, 1.0, TS, "missing_truck_id"),
    ("\t", 1.0, 1.0, TS, None),
    (" a", 1.0, 1.0, TS, None),
    ("a", 1.0, 1.0, None, "missing_event_ts"),
    ("a", None, 1.0, "x", "unparseable_event_ts"),
    ("a", 1.0, 1.0, "2024", None),
    ("a", None, 500.0, TS, "missing_coordinates"),
    ("a", 1.0, None, TS, "missing_coordinates"),
    ("a", 90.0, 180.0, TS, None),
    ("a", -90.0, -180.0, TS, None),
    ("a", 90.5, 500.0, TS, "latitude_out_of_range"),
    ("a", math.nan, 1.0, TS, "latitude_out_of_range"),
    ("a", 1.0, -180.1, TS, "longitude_out_of_range"),
]


def raw(spark, rows):
    return spark.createDataFrame(rows, "truck_id string, latitude double, longitude double, event_ts string, n int").withColumns({"_source_file": F.lit("f"), "_ingested_at": F.current_timestamp()})


def test_first_failure_names_the_reason(spark):
    out = silver.typed(raw(spark, [(*c[:4], k) for k, c in enumerate(CASES)])).orderBy("n").collect()
    assert [r["reject_reason"] for r in out] == [c[4] for c in CASES]


def test_split_loses_nothing(spark):
    judged = silver.typed(raw(spark, [(*c[:4], k) for k, c in enumerate(CASES)]))
    good, bad = rules.split(judged)
    assert good.count() + bad.count() == len(CASES)
    assert silver.clean_rows(judged).columns == silver.CLEAN and silver.rejected_rows(judged).columns == silver.REJECTED


def test_keys(spark):
    rows = silver.typed(raw(spark, [("a", 1.0, 1.0, TS, 0), ("a", 2.0, 1.0, TS, 1), ("a", 1.0, 1.0, "2024-01-01T00:00:00Z", 2)])).orderBy("n").collect()
    assert rows[0]["ping_id"] == rows[1]["ping_id"] != rows[2]["ping_id"] and rows[0]["event_ts"] == rows[2]["event_ts"]
    bad = silver.rejected_rows(silver.typed(raw(spark, [(None, None, 1.0, TS, 0), ("", None, 1.0, TS, 1), ("", 0.0, 1.0, TS, 2)])))
    assert bad.select("reject_id").distinct().count() == 2  # null and empty text collide


def test_dedup(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 1.0), ("a", 2, 3.0), ("b", None, 1.0), (None, 1, 1.0), (None, 1, 2.0)], "k string, s int, v double")
    got = {(r["k"], r["s"], r["v"]) for r in dedup.latest_per_key(df, ["k"], "s").collect()}
    assert got == {("a", 2, 3.0), ("b", None, 1.0), (None, 1, 2.0)}
    any_ = dedup.any_per_key(df, ["k", "s"]).collect()
    assert len(any_) == 4 and {tuple(r) for r in any_} <= {("a", 1, 5.0), ("a", 2, 3.0), ("b", None, 1.0), (None, 1, 2.0)}
    assert dedup.any_per_key(df.select("k"), ["k"]).count() == 3


@pytest.mark.parametrize("lat, lon, inside", [(41.80, -87.75, True), (41.95, -87.55, True), (41.951, -87.6, False), (41.9, -87.76, False), (None, -87.6, None)])
def test_geofence(spark, lat, lon, inside):
    df = spark.createDataFrame([(lat, lon)], "latitude double, longitude double")
    assert df.select(in_geofence(Geofence())).first()[0] is inside


def test_capacity(spark):
    df = spark.createDataFrame([(20000,), (None,)], "capacity_lbs int").select(capacity_tons().alias("t"))
    assert [r["t"] for r in df.collect()] == [9.07, None] and df.dtypes == [("t", "double")]
