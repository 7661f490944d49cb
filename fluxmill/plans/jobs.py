"""Jobs as small graphs of tasks, one run of a job at a time, with a stored history and schedules."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession

from fluxmill.config import Env
from fluxmill.plans import verify
from fluxmill.plans.migrate import EVERYTHING, Runner
from fluxmill.sources import pings
from fluxmill.streaming.files import Files
from fluxmill.streaming.medallion import Medallion
from fluxmill.streaming.runner import root_cause

log = logging.getLogger(__name__)


class Busy(RuntimeError):
    """Another run of the job holds its lock."""


@dataclass(frozen=True)
class Task:
    name: str
    act: Callable[[], object]
    after: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outcome:
    task: str
    state: str  # done, failed or skipped
    seconds: float
    result: object = None
    cause: str = ""


def ordered(tasks: list[Task]) -> list[Task]:
    """Tasks so that each follows those it waits for."""
    left, done, out = {t.name: t for t in tasks}, set(), []
    while left:
        ready = [t for t in left.values() if set(t.after) <= done]
        if not ready:
            raise ValueError(f"tasks wait for each other or for none: {', '.join(left)}")
        for t in ready:
            out.append(t)
            done.add(t.name)
            del left[t.name]
    return out


def run_job(spark: SparkSession, env: Env, name: str, tasks: list[Task]) -> list[Outcome]:
    """Run the tasks in order under the job's lock; what follows a failed task is skipped."""
    files, lock = Files(spark, env.home), f"{env.home}/locks/{name}"
    files.mkdirs(f"{env.home}/locks")
    if not files.create(lock, uuid.uuid4().hex):
        raise Busy(f"{name} already runs in {env.schema}; if it doesn't, delete {lock}")
    outcomes: dict[str, Outcome] = {}
    try:
        for t in ordered(tasks):
            began = time.monotonic()
            if any(outcomes[a].state != "done" for a in t.after):
                outcomes[t.name] = Outcome(t.name, "skipped", 0.0)
                continue
            try:
                result = t.act()
                outcomes[t.name] = Outcome(t.name, "done", time.monotonic() - began, result)
            except Exception as e:  # the job's report names it; later tasks must not run
                log.exception("%s failed", t.name)
                outcomes[t.name] = Outcome(t.name, "failed", time.monotonic() - began, None, root_cause(f"{type(e).__name__}: {e}"))
    finally:
        files.delete(lock)
        keep_run(spark, env, name, list(outcomes.values()))
    return list(outcomes.values())


def keep_run(spark: SparkSession, env: Env, name: str, outcomes: list[Outcome], at: datetime | None = None) -> str:
    """Store a run's outcomes; file names sort by time."""
    files, folder = Files(spark, env.home), f"{env.home}/runs"
    files.mkdirs(folder)
    began = at or datetime.now(UTC)
    path = f"{folder}/{began:%Y%m%dT%H%M%S%f}-{name}-{uuid.uuid4().hex[:8]}.json"
    files.create(path, json.dumps({"job": name, "ended": began.isoformat(), "outcomes": [{**asdict(o), "result": None if o.result is None else str(o.result)[:1000]} for o in outcomes]}))
    return path


def runs(spark: SparkSession, env: Env, name: str | None = None) -> Iterator[dict]:
    """Stored runs of the environment (of one job), newest first."""
    files, folder = Files(spark, env.home), f"{env.home}/runs"
    for n in reversed(files.names(folder)):
        if n.endswith(".json") and (name is None or n.split("-")[1] == name):
            held = files.read_json(f"{folder}/{n}")
            yield {**held, "outcomes": [Outcome(**o) for o in held["outcomes"]]}


def last_error(spark: SparkSession, env: Env, name: str | None = None) -> dict | None:
    """The newest stored run that failed: its job, its end, the task that failed and the cause."""
    for run in runs(spark, env, name):
        if (failed := last_failure(run["outcomes"])) is not None:
            return {"job": run["job"], "ended": run["ended"], "task": failed.task, "cause": failed.cause}
    return None


#: How long after each other the runs of a schedule begin.
SCHEDULES = {"hourly": timedelta(hours=1), "quarter-hourly": timedelta(minutes=15)}


def due(schedule: str, after: datetime) -> datetime:
    """The schedule's next start: whole multiples of its period since midnight UTC of year one."""
    period, zero = SCHEDULES[schedule], datetime(1, 1, 1, tzinfo=UTC)
    return zero + ((after - zero) // period + 1) * period


def run_scheduled(env: Env, act: Callable[[], object], most: int | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC), sleep: Callable[[float], None] = time.sleep) -> int:
    """Run ``act`` whenever the environment's schedule is due; a run that takes longer skips the starts it misses. Returns the number of runs."""
    if not env.schedule:
        raise ValueError(f"{env.schema} has no schedule; run it by hand")
    done = 0
    while most is None or done < most:
        sleep(max(0.0, (due(env.schedule, now()) - now()).total_seconds()))
        try:
            act()
        except Busy as e:
            log.warning("%s", e)
        done += 1
    return done


def setup_job(spark: SparkSession, env: Env, through: str = EVERYTHING, seed: int = 7) -> list[Outcome]:
    """Migrate, seed the dimension, generate landing files."""
    m = Medallion(spark, env)
    return run_job(spark, env, "setup", [
        Task("migrate", lambda: Runner(spark, env).run(through)),
        Task("seed", m.seed_trucks, ("migrate",)),
        Task("generate", lambda: pings.generate(spark, env.landing_path, env.batches, seed), ("seed",)),
    ])


def medallion_job(spark: SparkSession, env: Env, through: str = EVERYTHING, max_files: int | None = None, max_bytes: int | None = None) -> list[Outcome]:
    """Migrate, then raw, clean and serving tables, then the identities, then old versions."""
    m = Medallion(spark, env, max_files, max_bytes=max_bytes)

    def check() -> list[str]:
        if found := verify.problems(spark, env):
            raise AssertionError("; ".join(found))
        return []

    return run_job(spark, env, "medallion", [
        Task("migrate", lambda: Runner(spark, env).run(through)),
        Task("bronze", m.run_bronze, ("migrate",)),
        Task("silver", m.run_silver, ("bronze",)),
        Task("gold", m.run_gold, ("silver",)),
        Task("verify", check, ("gold",)),
        Task("maintain", m.maintain, ("verify",)),
    ])


def last_failure(outcomes: list[Outcome]) -> Outcome | None:
    return next((o for o in reversed(outcomes) if o.state == "failed"), None)
