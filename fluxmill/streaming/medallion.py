"""The three streams: landing to raw, raw to clean and quarantine, clean to the serving tables."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxmill.config import Env
from fluxmill.operators import gold, silver
from fluxmill.schemas import ACTIVITY, BRONZE, POSITION, QUARANTINE, SILVER, TRUCKS, ddl
from fluxmill.sources import landing, pings
from fluxmill.streaming.files import Files
from fluxmill.streaming.runner import Drained, run_available_now
from fluxmill.streaming.storage import AppendTable, SnapshotTable

log = logging.getLogger(__name__)


class Medallion:
    """One environment's streams and tables.

    ``max_files`` and ``max_bytes`` bound a micro-batch of landing files, ``max_files``
    also the commits of one between tables; ``evolve`` gives fields not seen before a
    column of the raw table; ``fault`` is called between writes, for tests.
    """

    def __init__(self, spark: SparkSession, env: Env, max_files: int | None = None, newest_first: bool = False, fault: Callable[[str, int], None] | None = None, delete_stale: bool = False, max_bytes: int | None = None, evolve: bool = False):
        self.spark, self.env = spark, env
        self.max_files, self.max_bytes, self.newest_first, self.delete_stale, self.evolve = max_files, max_bytes, newest_first, delete_stale, evolve
        self.fault = fault or (lambda place, batch: None)

    def append(self, spec) -> AppendTable:
        return AppendTable(self.spark, self.env.table_path(spec.name))

    def snapshot(self, spec) -> SnapshotTable:
        return SnapshotTable(self.spark, self.env.table_path(spec.name))

    def _label(self, stream: str) -> Callable[[int], tuple[str, int]]:
        """Labels of a stream's appends; a checkpoint that is made anew is another writer."""
        files, folder = Files(self.spark, self.env.home), self.env.checkpoint_path(stream)
        files.mkdirs(folder)
        name = f"{folder}/engine-id.txt"
        files.create(name, uuid.uuid4().hex)
        ident = files.read(name)
        return lambda batch: (f"{stream}-{ident}", batch)

    # -- bronze ---------------------------------------------------------------

    def bronze(self) -> DataFrame:
        return self.append(BRONZE).read()

    def run_bronze(self) -> Drained:
        """Append every new landing file's lines, once each, and note the fields that each batch shows for the first time."""
        files = Files(self.spark, self.env.home)
        files.mkdirs(self.env.landing_path)
        raw = landing.lines(self.spark, self.env.landing_path, self.max_files, self.newest_first, self.max_bytes)
        checkpoint, label = self.env.checkpoint_path(BRONZE.name), self._label(BRONZE.name)
        table = AppendTable.create(self.spark, self.env.table_path(BRONZE.name), BRONZE.schema)
        seen = landing.SchemaLog(self.spark, self.env.checkpoint_path(f"{BRONZE.name}_schema"))

        def write(batch: DataFrame, number: int) -> None:
            fields = T.StructType([f for f in table.schema if not f.name.startswith("_")])
            rows = landing.bronze_rows(batch, fields)
            folder = table.append(rows, label(number))
            self.fault("bronze", number)
            added = rows if folder is None else table.folder(folder)  # only what this batch wrote is read again
            rescued = added.where(F.col(landing.RESCUED).isNotNull()).select(landing.RESCUED)
            new = seen.note(found := landing.observed_fields(rescued, landing.RESCUED))
            held = {c.lower() for c in table.columns}
            if self.evolve and (columns := [f for f in new if f.isidentifier() and not f.startswith("_") and f.lower() not in held]):
                table.add_columns(ddl(", ".join(f"{f} {found[f]}" for f in columns)))

        writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return run_available_now(writer, "bronze_ingest")

    # -- silver ---------------------------------------------------------------

    def run_silver(self) -> Drained:
        label = self._label(SILVER.name)
        raw, clean, bad = self.append(BRONZE), self.append(SILVER), self.append(QUARANTINE)

        def write(batch: DataFrame, number: int) -> None:
            judged = silver.typed(batch).persist()  # both branches read it
            try:
                # equal ping ids have equal raw instants, so equal dates: only those dates are compared
                clean.merge_insert(silver.clean_rows(judged), SILVER.sequence, label(number), "event_date")
                self.fault("silver", number)
                # a reject's id holds its file: only the batch's files are compared
                bad.merge_insert(silver.rejected_rows(judged), None, label(number), "_source_file")
            finally:
                judged.unpersist()

        if not raw.exists():
            return Drained("silver_clean", 0, 0)
        writer = raw.stream(write, self.max_files).option("checkpointLocation", self.env.checkpoint_path(SILVER.name))
        return run_available_now(writer, "silver_clean", lambda: raw.handed)

    # -- gold -----------------------------------------------------------------

    def trucks(self) -> DataFrame:
        return self.snapshot(TRUCKS).read()

    def run_gold(self) -> Drained:
        clean, position, activity = self.append(SILVER), self.snapshot(POSITION), self.snapshot(ACTIVITY)

        def write(batch: DataFrame, number: int) -> None:
            pings = batch.persist()  # read once for both tables
            try:
                if pings.isEmpty():
                    return
                trucks = self.trucks()  # as of this batch
                size = gold.measured(trucks)
                position.merge_upsert(gold.current_position(pings, trucks, self.env.geofence, size), POSITION.sequence)
                self.fault("gold", number)
                windows = gold.recompute_touched(pings, clean.read(), trucks, size)
                if windows is not None:
                    activity.merge_upsert(windows)
                    if self.delete_stale:
                        self._drop_stale(pings, windows, activity)
            finally:
                pings.unpersist()

        writer = clean.stream(write, self.max_files).option("checkpointLocation", self.env.checkpoint_path("gold_build"))
        return run_available_now(writer, "gold_build", lambda: clean.handed)

    def _drop_stale(self, batch: DataFrame, windows: DataFrame, activity: SnapshotTable) -> None:
        """Remove a touched window's rows for regions that no longer have pings in it."""
        touched, keys = gold.touched_windows(batch), ["region", "window_start"]
        old = activity.read().join(touched, "window_start", "left_semi").join(windows.select(*keys), keys, "left_anti").select(*keys).persist()
        try:
            activity.delete_keys(old)
        finally:
            old.unpersist()

    def maintain(self, keep: int = 50) -> dict[str, int]:
        """Forget all but the newest versions of every table; for the end of a run, when its streams have read what is there."""
        tables = [self.append(s) for s in (BRONZE, SILVER, QUARANTINE)] + [self.snapshot(s) for s in (TRUCKS, POSITION, ACTIVITY)]
        return {t.path.rpartition("/")[2]: t.vacuum(keep) for t in tables if t.exists()}

    # -- the rest ---------------------------------------------------------------

    def seed_trucks(self, trucks: DataFrame | None = None) -> None:
        """Write the dimension; a rerun changes nothing but the time of the change."""
        made = pings.seeded_trucks(self.spark) if trucks is None else trucks
        if "_updated_at" not in made.columns:
            made = made.withColumn("_updated_at", F.current_timestamp())
        self.snapshot(TRUCKS).merge_upsert(made)

    def run(self) -> list[Drained]:
        return [self.run_bronze(), self.run_silver(), self.run_gold()]
