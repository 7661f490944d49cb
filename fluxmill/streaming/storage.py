"""Tables on plain Parquet with commits: a log of small JSON files, each naming the folders of one version.

A write puts its rows in a folder of its own and then creates the next log entry,
which fails if another writer was first.  Readers take the newest entry, so they
never see a torn write; older entries stay readable until they are vacuumed.

Tables are laid out by the columns they are clustered by.  A date column becomes
the folders' partitions, so that a filter on dates reads only theirs.

``AppendTable`` adds folders, and puts every ``FAN`` of a tier together to one of
the next, so its list grows with the logarithm of its commits.  Its stream follows
the log: it sees the rows of each committed append once, and nothing of rewrites.
``SnapshotTable`` holds keyed rows in parts, by the day of a clustered key column or
else by buckets of a hash of the keys, and a merge rewrites only the parts it
touches; the number of buckets follows the table's size.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from fluxmill.operators import merge
from fluxmill.streaming.files import Files

log = logging.getLogger(__name__)

#: Folders of a tier that are put together.
FAN = 16
#: Bytes that a bucket may have on average before there are more of them.
PART_BYTES = 128 << 20
#: Distinct values of a shared column up to which a merge asks for them one by one; more are asked for as a range.
LISTED = 4096


class Conflict(RuntimeError):
    """Another writer committed first."""


class ColumnExists(ValueError):
    """ADD COLUMNS found a column of that name."""


def loose(schema: T.StructType) -> T.StructType:
    """The schema as Parquet readers have it, where every column may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])


class Table:
    """What both kinds of table share: schema, log and versions."""

    kind = ""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = (), buckets: int = 8, comment: str = "", cluster: Sequence[str] = (), properties: dict[str, str] | None = None):
        """Make the table unless it is there."""
        table = cls(spark, path)
        if unknown := [c for c in cluster if c not in schema.fieldNames()]:
            raise ValueError(f"{path} has no column {', '.join(unknown)} to cluster by")
        if not table.exists():
            table.files.mkdirs(f"{table.path}/log")
            try:
                table._put(0, {"kind": cls.kind, "schema": schema.jsonValue(), "keys": list(keys), "buckets": buckets, "comment": comment, "cluster": list(cluster), "properties": properties or {}, "parts": {}, "added": [], "done": {}})
            except Conflict:  # another writer has made it meanwhile
                log.info("%s was made by another writer", path)
        return table

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.path}/log") if n.endswith(".json")]

    def entry(self, version: int | None = None) -> dict:
        return self.files.read_json(f"{self.path}/log/{self.versions()[-1] if version is None else version:012d}.json")

    @property
    def version(self) -> int:
        return self.versions()[-1]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.entry()["schema"])

    @property
    def keys(self) -> list[str]:
        return self.entry()["keys"]

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def _put(self, version: int, entry: dict) -> None:
        if not self.files.create(f"{self.path}/log/{version:012d}.json", json.dumps({**entry, "version": version})):
            raise Conflict(f"{self.path}: version {version} is taken")

    def _commit(self, base: int, entry: dict, **changes) -> int:
        self._put(base + 1, {**entry, "added": [], **changes})
        return base + 1

    def _frame(self, folders: Sequence[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], loose(schema))
        return self._reader().schema(loose(schema)).parquet(*[f"{self.path}/{p}" for p in folders]).select(*schema.fieldNames())

    def _reader(self) -> DataFrameReader:
        return self.spark.read

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.entry(version)
        return self._frame([p for ps in entry["parts"].values() for p in ps], T.StructType.fromJson(entry["schema"]))

    def restore(self, version: int) -> int:
        """Make an older version the newest again; what was appended before stays appended for its writers."""
        now = self.version
        return self._commit(now, self.entry(version), done=self.entry(now)["done"])

    def set_schema(self, schema: T.StructType) -> int:
        """Add columns by the log alone: files lack the new ones, which read as null."""
        base = self.version
        return self._commit(base, self.entry(base), schema=schema.jsonValue())

    def add_columns(self, fields: T.StructType) -> int:
        held = {f.name.lower() for f in self.schema}
        if clash := [f.name for f in fields if f.name.lower() in held]:
            raise ColumnExists(f"{self.path}: {', '.join(clash)} already exists")
        return self.set_schema(T.StructType([*self.schema.fields, *fields.fields]))

    def drop_columns(self, names: Sequence[str]) -> int:
        if missing := [n for n in names if n not in self.columns]:
            raise ValueError(f"{self.path} has no column {', '.join(missing)}")
        if held := [n for n in names if n in self.keys or n in self.entry()["cluster"]]:
            raise ValueError(f"{', '.join(held)} is a key or clustered by")
        # the rows are rewritten, else a column added again under the name would show the old values
        left = T.StructType([f for f in self.schema if f.name not in names])
        return self.rewrite(lambda df: df.drop(*names), left)

    def rename_column(self, old: str, new: str) -> int:
        schema = T.StructType([T.StructField(new if f.name == old else f.name, f.dataType, f.nullable, f.metadata) for f in self.schema])
        swap = lambda names: [new if k == old else k for k in names]
        return self.rewrite(lambda df: df.withColumnRenamed(old, new), schema, keys=swap(self.keys), cluster=swap(self.entry()["cluster"]))

    def rewrite(self, change: Callable[[DataFrame], DataFrame], schema: T.StructType | None = None, **names: list[str]) -> int:
        """Copy on write of the whole table; ``names`` are new keys and cluster columns."""
        base = self.version
        entry = {**self.entry(base), **names}
        schema = schema or self.schema
        parts = self._whole(change(self.read()), entry, schema) if entry["parts"] else {}
        return self._commit(base, entry, parts=parts, schema=schema.jsonValue())

    def _required(self, df: DataFrame) -> DataFrame:
        """Hold NOT NULL columns to their word, in the pass that writes."""
        return merge.require_keys(df, [f.name for f in self.schema if not f.nullable and f.name in df.columns])

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` versions and delete folders no kept one names.

        For the table's only writer, after its streams have read what is there: a
        stream that is further behind fails rather than skip rows.
        """
        versions = self.versions()
        used = {p for v in versions[-keep:] for ps in self.entry(v)["parts"].values() for p in ps}
        for v in versions[:-keep]:
            self.files.delete(f"{self.path}/log/{v:012d}.json")
        held = [f"data/{n}" for n in self.files.names(f"{self.path}/data")]
        gone = [p for p in held if not any(u == p or u.startswith(f"{p}/") for u in used)]
        for p in gone:
            self.files.delete(f"{self.path}/{p}")
        return len(gone)


class AppendTable(Table):
    """Rows are only added; a label makes an append happen once however often it is tried."""

    kind = "append"
    handed = 0

    def _reader(self) -> DataFrameReader:
        # folders are named like partitions, so that those of several appends make one table partitioned by dates
        return self.spark.read.option("basePath", f"{self.path}/data")

    @staticmethod
    def _layout(entry: dict, schema: T.StructType) -> tuple[list[str], list[str]]:
        """The date column that becomes folders, if any, and the columns that rows are ordered by within files."""
        dates = [c for c in entry["cluster"] if isinstance(schema[c].dataType, T.DateType)][:1]
        return dates, [c for c in entry["cluster"] if c not in dates]

    def _save(self, rows: DataFrame, entry: dict, schema: T.StructType, folder: str) -> None:
        dates, order = self._layout(entry, schema)
        if dates:
            # even tasks whatever a day holds: large days are split, small ones share a task
            rows = rows.hint("rebalance", *[F.col(c) for c in dates])
        if dates or order:
            rows = rows.sortWithinPartitions(*dates, *order)
        writer = rows.write
        (writer.partitionBy(*dates) if dates else writer).parquet(f"{self.path}/{folder}")

    def append(self, df: DataFrame, label: tuple[str, int] | str | None = None) -> str | None:
        """Add rows and return their folder; None if an append of that label is already in.

        A label is a writer and its number, which only grows; the log holds each
        writer's last, so a replay of any age is known.
        """
        writer, number = (label, 0) if isinstance(label, str) else label or (None, 0)
        name = f"data/__f={uuid.uuid4().hex}" if writer is None else f"data/__f={writer}-{number:010d}"
        base = self.version
        entry = self.entry(base)
        if writer is not None and number <= entry["done"].get(writer, -1):
            return None
        schema = T.StructType.fromJson(entry["schema"])
        rows = self._required(df).select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        if not self.files.exists(f"{self.path}/{name}"):  # else a try ended between the move and the commit: its folder is whole
            draft = f"_draft/{uuid.uuid4().hex}"
            self._save(rows, entry, schema, draft)
            self.files.mkdirs(f"{self.path}/data")
            if not self.files.rename(f"{self.path}/{draft}", f"{self.path}/{name}"):
                raise Conflict(f"{self.path}: {name} can't be moved in")
        done = entry["done"] if writer is None else {**entry["done"], writer: number}
        parts = {**entry["parts"], "0": [*entry["parts"].get("0", []), name]}
        self._commit(base, entry, parts=parts, done=done, added=[name])
        if len(parts["0"]) >= FAN:
            self.tidy()
        return name

    def merge_insert(self, df: DataFrame, sequence: str | None = None, label: tuple[str, int] | str | None = None, shared: str | None = None) -> str | None:
        """Insert-only merge: an append of the rows whose keys are new.

        ``shared`` names a column in which rows of equal keys are always equal;
        the target is then only read where it has the source's values, which
        partitions or its files' statistics prune.
        """
        target = self.read()
        if shared:
            values = [r[0] for r in df.select(shared).distinct().limit(LISTED + 1).collect()]
            if len(values) <= LISTED:
                target = target.where(F.col(shared).isin([v for v in values if v is not None]))
            else:
                low, high = df.agg(F.min(shared), F.max(shared)).first()
                target = target.where(F.col(shared).between(F.lit(low), F.lit(high)))
        return self.append(merge.insert_only(target, df, self.keys, sequence), label)

    def tidy(self) -> None:
        """Put every ``FAN`` folders of a tier together to one of the next; rows are written once a tier."""
        try:
            tier = 0
            while len(self.entry()["parts"].get(str(tier), [])) >= FAN:
                self._together(self.version, [str(tier)], str(tier + 1))
                tier += 1
        except Conflict:  # a writer was faster; the next append tries again
            log.info("%s: left as it is, another writer committed", self.path)

    def compact(self) -> int:
        """Put all rows in one folder of large files, which streams of the table don't see; vacuum removes the old ones."""
        base = self.version
        tiers = list(self.entry(base)["parts"])
        return self._together(base, tiers, max(tiers, key=int, default="0"))

    def _together(self, base: int, tiers: Sequence[str], to: str) -> int:
        entry = self.entry(base)
        schema, parts = T.StructType.fromJson(entry["schema"]), entry["parts"]
        name = f"data/__f={uuid.uuid4().hex}"
        self._save(self._frame([p for t in tiers for p in parts.get(t, [])], schema), entry, schema, name)
        left = {t: ps for t, ps in parts.items() if t not in tiers}
        return self._commit(base, entry, parts={**left, to: [*left.get(to, []), name]})

    def _whole(self, rows: DataFrame, entry: dict, schema: T.StructType) -> dict[str, list[str]]:
        name = f"data/__f={uuid.uuid4().hex}"
        self._save(rows.select(*schema.fieldNames()), entry, schema, name)
        return {max(entry["parts"], key=int): [name]}

    def folder(self, name: str) -> DataFrame:
        """The rows that one append wrote."""
        return self._frame([name], self.schema)

    def _added(self, versions: Sequence[int], first: bool) -> list[str]:
        folders = []
        for k, v in enumerate(sorted(versions)):
            entry = self.entry(v)
            whole = first and k == 0 and v > 0 and v - 1 not in self.versions()
            folders += [p for ps in entry["parts"].values() for p in ps] if whole else entry["added"]
        return folders

    def added(self, versions: Sequence[int], first: bool = False) -> DataFrame:
        """The rows that these versions appended; ``first``: and, where older versions are gone, what they left."""
        return self._frame(self._added(versions, first), self.schema)

    def stream(self, write: Callable[[DataFrame, int], None], max_commits: int | None = None) -> DataStreamWriter:
        """A writer that hands each micro-batch's newly appended rows to ``write``.

        The source is the log, so a row is seen with its commit and not before;
        ``handed`` counts the appends.
        """
        self.handed = 0
        reader = self.spark.readStream.schema("version BIGINT")
        if max_commits:
            reader = reader.option("maxFilesPerTrigger", max_commits)

        def each(batch: DataFrame, number: int) -> None:
            folders = self._added([r["version"] for r in batch.collect()], number == 0)  # one small row for each commit
            if folders:
                write(self._frame(folders, self.schema), number)
                self.handed += len(folders)

        return reader.json(f"{self.path}/log").writeStream.foreachBatch(each)


class SnapshotTable(Table):
    """Keyed rows that change; each version names the folders of every part that has rows."""

    kind = "snapshot"

    @staticmethod
    def _part(entry: dict, schema: T.StructType) -> Column:
        """The part of a row: the day of a clustered key column, else a bucket of the keys."""
        for c in entry["cluster"]:
            if c in entry["keys"] and isinstance(schema[c].dataType, T.DateType | T.TimestampType):
                return F.date_format(c, "yyyy-MM-dd")
        return F.pmod(F.xxhash64(*entry["keys"]), F.lit(entry["buckets"])).cast("string") if entry["keys"] else F.lit("0")

    def _write(self, rows: DataFrame, entry: dict, schema: T.StructType) -> dict[str, list[str]]:
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("__part", self._part(entry, schema)).hint("rebalance", F.col("__part"))
        dealt.sortWithinPartitions("__part", *[c for c in entry["cluster"] if c in rows.columns]).write.partitionBy("__part").parquet(f"{self.path}/{name}")
        return {n.partition("=")[2]: [f"{name}/{n}"] for n in self.files.names(f"{self.path}/{name}") if n.startswith("__part=")}

    def _whole(self, rows: DataFrame, entry: dict, schema: T.StructType) -> dict[str, list[str]]:
        return self._write(rows, entry, schema)

    def merge_upsert(self, df: DataFrame, sequence: str | None = None) -> None:
        """Upsert, guarded by ``sequence``; only the parts of the source's keys are read and rewritten."""
        base = self.version
        entry = self.entry(base)
        schema, keys = T.StructType.fromJson(entry["schema"]), entry["keys"]
        source = merge.require_keys(merge.tolerant(df, schema.fieldNames(), self.path), keys)
        source = source.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in source.columns]).persist()
        try:
            touched = [r[0] for r in source.select(self._part(entry, schema)).distinct().collect()]  # buckets, or days
            if not touched:
                return
            target = self._frame([p for b in touched for p in entry["parts"].get(b, [])], schema)
            made = self._write(merge.upsert(target, source, keys, sequence), entry, schema)
        finally:
            source.unpersist()
        parts = {b: p for b, p in entry["parts"].items() if b not in touched} | made
        self._commit(base, entry, parts=parts)
        self._grow(made, parts)

    def _grow(self, made: dict[str, list[str]], parts: dict[str, list[str]]) -> None:
        """Deal the rows into more buckets once the written ones are twice too large on average."""
        entry = self.entry()
        if not entry["keys"] or not made or any(not b.isdigit() for b in parts):
            return
        mean = sum(self.files.size(f"{self.path}/{p}") for ps in made.values() for p in ps) / len(made)
        if mean <= 2 * PART_BYTES:
            return
        more = entry["buckets"]
        while mean * entry["buckets"] / more > PART_BYTES:
            more *= 2
        try:
            base = self.version
            grown = {**self.entry(base), "buckets": more}
            self._commit(base, grown, parts=self._write(self.read(base), grown, self.schema))
        except Conflict:  # the next merge tries again
            log.info("%s: left at %d buckets, another writer committed", self.path, entry["buckets"])

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows that differ between two versions, as the later has them (deleted ones as the earlier had them), with ``_change``.

        Only parts whose folders differ are read; columns that one version lacks are
        left out of the comparison.
        """
        before, after = self.entry(since), self.entry(until)
        schema = T.StructType.fromJson(after["schema"])
        held = T.StructType.fromJson(before["schema"]).fieldNames()
        common = T.StructType([f for f in schema if f.name in held])
        differ = [b for b in {**before["parts"], **after["parts"]} if before["parts"].get(b) != after["parts"].get(b)]
        read = lambda entry: self._frame([p for b in differ for p in entry["parts"].get(b, [])], common)
        keys, names = after["keys"], common.fieldNames()
        old = read(before).select(*[F.col(c).alias(f"o_{c}") for c in names], F.lit(True).alias("o_here"))
        new = read(after).select(*[F.col(c).alias(f"n_{c}") for c in names], F.lit(True).alias("n_here"))
        both = old.join(new, [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys], "full_outer")
        moved = F.lit(False)
        for c in names:
            moved = moved | ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
        change = F.when(F.col("o_here").isNull(), "insert").when(F.col("n_here").isNull(), "delete").when(moved, "update")
        out = both.withColumn("_change", change).where(F.col("_change").isNotNull())
        return out.select(*[F.when(F.col("n_here").isNull(), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in names], "_change")

    def update(self, changes: dict, condition) -> int:
        """Set columns where the condition is true (null counts as false)."""
        types = {f.name: f.dataType for f in self.schema}
        hit = F.coalesce(condition, F.lit(False))
        return self.rewrite(lambda df: df.withColumns({c: F.when(hit, e.cast(types[c])).otherwise(F.col(c)) for c, e in changes.items()}))

    def delete(self, condition) -> int:
        return self.rewrite(lambda df: df.where(~F.coalesce(condition, F.lit(False))))

    def delete_keys(self, keys: DataFrame) -> None:
        """Delete the rows with these keys; only their parts are rewritten."""
        base = self.version
        entry = self.entry(base)
        schema = T.StructType.fromJson(entry["schema"])
        touched = [r[0] for r in keys.select(self._part(entry, schema)).distinct().collect()]
        held = [b for b in touched if b in entry["parts"]]
        if not held:
            return
        left = self._frame([p for b in held for p in entry["parts"][b]], schema).join(keys, entry["keys"], "left_anti")
        made = self._write(left.select(*schema.fieldNames()), entry, schema)
        self._commit(base, entry, parts={b: p for b, p in entry["parts"].items() if b not in held} | made)

    def insert(self, df: DataFrame) -> None:
        """Plain insert of rows in the table's column order, by position."""
        names = self.columns
        rows = self._required(df.toDF(*names[: len(df.columns)]))
        types = {f.name: f.dataType for f in self.schema}
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in names])
        base = self.version
        entry = self.entry(base)
        made = self._write(rows, entry, self.schema)
        self._commit(base, entry, parts={b: [*entry["parts"].get(b, []), *made.get(b, [])] for b in {*entry["parts"], *made}})


def open_table(spark: SparkSession, path: str) -> Table:
    table = Table(spark, path)
    if not table.exists():
        raise FileNotFoundError(f"no table at {path}")
    return (AppendTable if table.entry()["kind"] == "append" else SnapshotTable)(spark, path)
