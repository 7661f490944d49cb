"""Pings and trucks: derived from the driver's tables, or synthesised with a seed."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxmill.schemas import TRUCKS
from fluxmill.streaming.files import Files


def derived_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pings made from ``events`` by the rules of FIXTURES section 3, bad and doubled rows included.

    The events are read once: every tenth is doubled by a two-element array.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    i = F.col("event_id")
    wave = lambda factor: (i * factor % 4001).cast("double") / F.lit(10000.0)
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return e.select(
        F.when(i % 37 == 5, "").otherwise(F.concat(F.lit("TRK-"), F.lpad(F.col("user_id").cast("string"), 6, "0"))).alias("truck_id"),
        F.when(i % 23 == 1, None).when(i % 29 == 2, 95.5).otherwise(F.lit(41.65) + wave(7919)).alias("latitude"),
        F.when(i % 31 == 3, -200.25).otherwise(F.lit(-87.85) + wave(104729)).alias("longitude"),
        F.when(i % 41 == 4, "not-a-timestamp").when(i % 43 == 6, None).otherwise(iso).alias("event_ts"),
        "event_id",
        F.explode(F.when(i % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def derived_trucks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truck dimension made from customers, nations and regions; nine of ten customers have one."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    places = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows at any scale
    c = read("customer").where("c_custkey % 10 <> 9")
    pounds = F.element_at(F.array(*[F.lit(x) for x in (20000, 26000, 34000, 40000)]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("TRK-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("truck_id"),
        F.col("c_mktsegment").alias("make"),
        F.concat(F.lit("M"), (F.col("c_custkey") % 4).cast("string")).alias("model"),
        pounds.alias("capacity_lbs"),
        F.col("n_name").alias("home_depot"),
        F.col("r_name").alias("region"),
        F.col("c_name").alias("driver"),
    )


# The synthetic fleet.
FLEET = 20
CENTRE = (41.85, -87.65)
MODELS = [("Freightliner", "Cascadia"), ("Volvo", "VNL"), ("Kenworth", "T680"), ("Peterbilt", "579")]
DEPOTS = [("Chicago", "Midwest"), ("Dallas", "South"), ("Denver", "West"), ("Atlanta", "Southeast")]
POUNDS = [20000, 26000, 34000, 40000]
DRIVERS = ["A. Rivera", "B. Chen", "C. Okafor", "D. Patel", "E. Nguyen", "F. Santos", "G. Kim", "H. Brooks", "I. Novak", "J. Alvarez"]


def truck_name(number: int) -> str:
    return f"TRK-{number:03d}"


def seeded_trucks(spark: SparkSession, seed: int = 42) -> DataFrame:
    """The fleet's dimension; the same rows for the same seed."""
    dice = random.Random(seed)
    rows = []
    for number in range(1, FLEET + 1):
        (make, model), (depot, region) = dice.choice(MODELS), dice.choice(DEPOTS)
        rows.append((truck_name(number), make, model, dice.choice(POUNDS), depot, region, dice.choice(DRIVERS)))
    names = [n for n in TRUCKS.schema.fieldNames() if n != "_updated_at"]
    return spark.createDataFrame(rows, ", ".join(f"{n} {TRUCKS.schema[n].dataType.simpleString()}" for n in names)).withColumn("_updated_at", F.current_timestamp())


def ping_lines(dice: random.Random, at: datetime) -> list[str]:
    """One file's lines: 5 to 15 pings, the first again, and one without a latitude."""

    def ping(second: int) -> dict:
        lat, lon = (round(c + dice.uniform(-0.2, 0.2), 6) for c in CENTRE)
        return {"truck_id": truck_name(dice.randint(1, FLEET)), "latitude": lat, "longitude": lon, "event_ts": (at + timedelta(seconds=second, microseconds=dice.randrange(10**6))).isoformat()}

    pings = [ping(k) for k in range(dice.randint(5, 15))]
    return [json.dumps(p) for p in [*pings, pings[0], {**ping(len(pings)), "latitude": None}]]


def generate(spark: SparkSession, folder: str, batches: int, seed: int = 7, start: datetime | None = None, step: timedelta = timedelta(seconds=30), sleep_seconds: float = 0.0) -> int:
    """Write ``batches`` landing files, waiting between them if asked; returns the number of lines. Files appear whole."""
    files, dice = Files(spark, folder), random.Random(seed)
    files.mkdirs(folder)
    start = start or datetime(2024, 1, 1, tzinfo=UTC)
    total = 0
    for n in range(batches):
        if n and sleep_seconds > 0:
            time.sleep(sleep_seconds)
        at = start + n * step
        rows = ping_lines(dice, at)
        files.create(f"{folder}/pings_{seed:08x}_{int(at.timestamp() * 1000)}_{n:04d}.json", "\n".join(rows) + "\n")
        total += len(rows)
    return total


def land(spark: SparkSession, folder: str, files: Sequence[Sequence[dict | str]], prefix: str = "part") -> None:
    """Write given rows (or literal lines) as landing files, in order."""
    out = Files(spark, folder)
    out.mkdirs(folder)
    for n, rows in enumerate(files):
        out.create(f"{folder}/{prefix}_{n:04d}.json", "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
