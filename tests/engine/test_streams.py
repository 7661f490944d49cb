import json
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fluxmill.config import Env
from fluxmill.operators import gold, silver
from fluxmill.plans import jobs, verify
from fluxmill.plans.migrate import Runner
from fluxmill.plans.statements import read_table
from fluxmill.schemas import ACTIVITY, POSITION, QUARANTINE, SILVER
from fluxmill.sources import landing, pings
from fluxmill.streaming.medallion import Medallion
from fluxmill.streaming.runner import StreamFailed, run_every


def ping(truck, minute, lat=41.9, lon=-87.6, second=0):
    return {"truck_id": truck, "latitude": lat, "longitude": lon, "event_ts": f"2024-01-01T00:{minute:02d}:{second:02d}+00:00"}


FILES = [
    [ping("TRK-001", 1), ping("TRK-001", 1), ping("TRK-002", 2, None)],
    [ping("TRK-001", 3), ping("TRK-002", 7), ping("TRK-099", 8)],
    [ping("TRK-002", 4), ping("TRK-001", 1), ping("TRK-003", 12, 95.0)],
]


def environment(spark, path, files=FILES, **options):
    env = Env(str(path))
    Runner(spark, env).run()
    m = Medallion(spark, env, **options)
    m.seed_trucks()
    if files:
        pings.land(spark, env.landing_path, files)
    return m


def state(m):
    key = lambda r: tuple(map(str, r))
    pick = lambda spec, *c: sorted(map(key, (m.append(spec) if spec in (SILVER, QUARANTINE) else m.snapshot(spec)).read().select(*c).collect()))
    return {
        "silver": pick(SILVER, "ping_id", "truck_id", "event_ts"),
        "quarantine": pick(QUARANTINE, "truck_id", "event_ts_raw", "reject_reason"),
        "position": pick(POSITION, "truck_id", "last_event_ts", "region", "in_geofence"),
        "activity": pick(ACTIVITY, "region", "window_start", "ping_count", "truck_count"),
    }


@pytest.fixture(scope="module")
def expected(spark, tmp_path_factory):
    m = environment(spark, tmp_path_factory.mktemp("whole"))
    done = m.run()
    assert done[0].rows == 9 and verify.problems(spark, m.env) == []
    got = state(m)
    assert len(got["silver"]) == 5 and [q[2] for q in got["quarantine"]] == ["missing_coordinates", "latitude_out_of_range"]
    assert ("UNKNOWN", "2024-01-01 00:05:00", "1", "1") in got["activity"]
    # conservation: what landed is clean, rejected or doubled
    assert 9 == len(got["silver"]) + len(got["quarantine"]) + 2
    return got


@pytest.mark.parametrize("options", [{"max_files": 1}, {"max_files": 2}, {"max_files": 1, "newest_first": True}])
def test_any_batching_and_order_ends_alike(spark, tmp_path, expected, options):
    m = environment(spark, tmp_path, **options)
    m.run()
    assert state(m) == expected


def test_rerun_and_copied_files_change_nothing(spark, tmp_path, expected):
    m = environment(spark, tmp_path)
    m.run()
    version = m.snapshot(POSITION).version
    assert [d.rows for d in m.run()] == [0, 0, 0] and m.snapshot(POSITION).version == version
    pings.land(spark, m.env.landing_path, FILES[:1], "again")
    assert m.run()[0].rows == 3
    got = state(m)
    assert {k: got[k] for k in ("silver", "position", "activity")} == {k: expected[k] for k in ("silver", "position", "activity")}
    assert m.bronze().count() == 12


@pytest.mark.parametrize("place", ["bronze", "silver", "gold"])
def test_crash_between_writes_is_made_good(spark, tmp_path, expected, place):
    calls = []

    def fault(where, batch):
        if where == place and not calls:
            calls.append(batch)
            raise RuntimeError("pulled the plug")

    m = environment(spark, tmp_path, fault=fault)
    with pytest.raises(StreamFailed, match="pulled the plug"):
        m.run()
    m.run_bronze()
    m.run_silver()
    m.run_gold()
    assert calls and state(m) == expected


def test_new_checkpoint_replays_without_doubles(spark, tmp_path, expected):
    m = environment(spark, tmp_path)
    m.run()
    for stream in (SILVER.name, "gold_build"):
        m.append(SILVER).files.delete(m.env.checkpoint_path(stream))
    m.run()
    assert state(m) == expected


def test_empty_landing_zone(spark, tmp_path):
    m = environment(spark, tmp_path, files=[])
    assert [d.rows for d in m.run()] == [0, 0, 0] and verify.problems(spark, m.env) == []


def test_stale_regions_go_on_request(spark, tmp_path):
    m = environment(spark, tmp_path, files=FILES[:1], delete_stale=True)
    m.run()
    trucks = pings.seeded_trucks(spark).withColumn("region", F.lit("Elsewhere"))
    m.seed_trucks(trucks)
    pings.land(spark, m.env.landing_path, [[ping("TRK-001", 2)]], "more")
    m.run()
    assert [(r["region"], r["ping_count"]) for r in m.snapshot(ACTIVITY).read().collect()] == [("Elsewhere", 2)]


def test_rescued_data_and_schema_log(spark, tmp_path):
    lines = ["{bad", json.dumps({**ping("a", 1), "speed": 5, "nested": {"x": [1]}}), '{"truck_id": "b", "latitude": "abc", "longitude": 1, "event_ts": "t"}', "", '{"truck_id": null}', "[1]"]
    m = environment(spark, tmp_path, files=[lines])
    m.run_bronze()
    rows = {r["truck_id"]: r for r in m.bronze().where("truck_id IS NOT NULL").collect()}
    assert json.loads(rows["a"]["_rescued_data"]) == {"speed": "5", "nested": '{"x":[1]}'} and rows["a"]["latitude"] == 41.9
    assert json.loads(rows["b"]["_rescued_data"]) == {"latitude": "abc"} and rows["b"]["latitude"] is None and rows["b"]["longitude"] == 1.0
    whole = sorted(json.loads(r["_rescued_data"])["_corrupt_record"] for r in m.bronze().where("truck_id IS NULL AND _rescued_data IS NOT NULL").collect())
    assert whole == ["[1]", "{bad"] and m.bronze().count() == 5
    log = landing.SchemaLog(spark, m.env.checkpoint_path("bronze_pings_raw_schema"))
    assert log.types() == {"latitude": "STRING", "nested": "STRING", "speed": "BIGINT"}
    assert log.note({"speed": "DOUBLE"}) == [] and log.types()["speed"] == "DOUBLE" and log.note({"speed": "BOOLEAN", "z": "BOOLEAN"}) == ["z"]
    assert log.types()["speed"] == "STRING"
    assert m.bronze().where("_source_file LIKE '%.json'").count() == 5


def test_plans(spark):
    """The dimension is broadcast when counted small, pings are added up before their shuffle, and ranges reach the scan."""
    p = silver.typed(spark.createDataFrame([("a", 1.0, 1.0, "2024-01-01T00:00:00Z")], "truck_id string, latitude double, longitude double, event_ts string").withColumns({"_source_file": F.lit("f"), "_ingested_at": F.current_timestamp()}))
    plan = gold.region_activity(p, pings.seeded_trucks(spark), 20)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "partial_count" in plan and "Expand" not in plan


def test_jobs(spark, tmp_path):
    env = Env(str(tmp_path), batches=3)
    assert [o.state for o in jobs.setup_job(spark, env)] == ["done"] * 3
    assert [o.state for o in jobs.medallion_job(spark, env)] == ["done"] * 6
    raw, clean, bad = (read_table(spark, env, t).count() for t in ("bronze_pings_raw", "silver_pings", "silver_pings_quarantine"))
    assert raw == clean + bad + 3 and bad == 3
    text = verify.report(spark, env)
    assert "all hold" in text and "missing_coordinates" in text and "capacity_tons double" in text
    lock = f"{env.home}/locks/medallion"
    m = Medallion(spark, env)
    m.append(SILVER).files.create(lock, "x")
    with pytest.raises(jobs.Busy):
        jobs.medallion_job(spark, env)
    m.append(SILVER).files.delete(lock)


def test_failed_task_skips_what_follows(spark, tmp_path):
    def fail():
        raise ValueError("no such thing")

    out = jobs.run_job(spark, Env(str(tmp_path)), "j", [jobs.Task("c", list, ("b",)), jobs.Task("a", list), jobs.Task("b", fail, ("a",))])
    assert [(o.task, o.state) for o in out] == [("a", "done"), ("b", "failed"), ("c", "skipped")]
    assert "no such thing" in jobs.last_failure(out).cause
    # the run is stored: another process finds what failed
    found = jobs.last_error(spark, Env(str(tmp_path)))
    assert found["job"] == "j" and found["task"] == "b" and "no such thing" in found["cause"]
    jobs.run_job(spark, Env(str(tmp_path)), "k", [jobs.Task("a", list)])
    assert [r["job"] for r in jobs.runs(spark, Env(str(tmp_path)))] == ["k", "j"] and jobs.last_error(spark, Env(str(tmp_path)), "k") is None
    with pytest.raises(ValueError):
        jobs.ordered([jobs.Task("x", list, ("y",))])


def test_kept_running(spark, tmp_path):
    """The same writer on a timer instead of to the end."""
    pings.land(spark, str(tmp_path / "in"), FILES)
    rows = landing.bronze_rows(landing.lines(spark, str(tmp_path / "in")))
    query = run_every(rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")), "kept", "1 second", str(tmp_path / "out"))
    try:
        query.processAllAvailable()
        assert query.isActive and spark.read.parquet(str(tmp_path / "out")).count() == 9
    finally:
        query.stop()


def test_seeded_sources(spark):
    rows = lambda: pings.seeded_trucks(spark).drop("_updated_at").collect()
    assert rows() == rows() and len({r["truck_id"] for r in rows()}) == 20


def test_fields_become_columns_on_request(spark, tmp_path):
    m = environment(spark, tmp_path, files=[[{**ping("a", 1), "speed": 5, "ok": True, "note": "x"}]], evolve=True)
    m.run_bronze()
    assert dict(m.bronze().dtypes)["speed"] == "bigint" and dict(m.bronze().dtypes)["ok"] == "boolean"
    pings.land(spark, m.env.landing_path, [[{**ping("b", 2), "speed": 7, "note": "y", "other": 1}]], "more")
    m.run()
    got = {r["truck_id"]: r for r in m.bronze().collect()}
    assert got["a"]["speed"] is None and json.loads(got["a"]["_rescued_data"])["speed"] == "5"
    assert got["b"]["speed"] == 7 and got["b"]["note"] == "y" and json.loads(got["b"]["_rescued_data"]) == {"other": "1"}
    assert m.append(SILVER).read().count() == 2


def test_one_late_ping_reads_and_rewrites_its_day(spark, tmp_path):
    def on(day, truck="TRK-001"):
        return {"truck_id": truck, "latitude": 41.9, "longitude": -87.6, "event_ts": f"2024-01-{day:02d}T10:00:00+00:00"}

    m = environment(spark, tmp_path, files=[[on(d) for d in range(1, 21)]])
    m.run()
    before = m.snapshot(ACTIVITY).entry()["parts"]
    assert sorted(before) == [f"2024-01-{d:02d}" for d in range(1, 21)]
    pings.land(spark, m.env.landing_path, [[on(7, "TRK-002")]], "late")
    m.run()
    after = m.snapshot(ACTIVITY).entry()["parts"]
    assert [d for d in after if after[d] != before[d]] == ["2024-01-07"]
    batch = m.append(SILVER).read().where("truck_id = 'TRK-002'")
    plan = gold.recompute_touched(batch, m.append(SILVER).read(), m.trucks(), 100)._jdf.queryExecution().executedPlan().toString()
    filters = [p.partition("]")[0] for p in plan.split("PartitionFilters: [")[1:]]
    assert any("event_date" in f and "2024-01-07" in f for f in filters), plan


def test_bytes_bound_a_batch(spark, tmp_path):
    m = environment(spark, tmp_path, max_bytes=1)
    assert m.run_bronze().batches == len(FILES)
    began = time.monotonic()
    assert pings.generate(spark, str(tmp_path / "g"), 3, sleep_seconds=0.2) > 0 and time.monotonic() - began >= 0.4


def test_schedules():
    at = lambda *t: datetime(2024, 1, 1, *t, tzinfo=UTC)
    assert jobs.due("hourly", at(10, 0, 1)) == at(11) and jobs.due("quarter-hourly", at(10, 15)) == at(10, 30)
    clock, waits, done = [at(10, 7)], [], []

    def sleep(seconds):
        waits.append(seconds)
        clock[0] += timedelta(seconds=seconds)

    def act():
        done.append(clock[0])
        clock[0] += timedelta(minutes=20)  # longer than the period: a start is missed

    assert jobs.run_scheduled(Env("/r", schedule="quarter-hourly"), act, 2, lambda: clock[0], sleep) == 2
    assert done == [at(10, 15), at(10, 45)] and waits == [480.0, 600.0]
    with pytest.raises(ValueError):
        jobs.run_scheduled(Env("/r"), act, 1)
