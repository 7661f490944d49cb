"""Helpers shared by the training-data operators: inputs, shared scratch, skew."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (Java and Python agree on this class).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows a side may hold and still be broadcast; beyond it a shuffled join runs.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where none is named, a local folder serves a session whose executors are in the
    driver's own process, as in tests; on a cluster the missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="fluxmill-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing is at yet, gone when the driver ends."""
    jvm = spark.sparkContext._jvm
    holder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    files = holder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(holder)
    files.deleteOnExit(holder)
    return f"{holder}/t"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def code_key(*names: str) -> Column:
    """One string key for columns that may be null, unambiguous, null-safe and of bounded width: long values by their SHA-256."""

    def part(name: str) -> Column:
        text = F.col(name).cast("string")
        own = F.when(F.octet_length(text) <= 48, F.concat(F.lit("="), F.base64(F.encode(text, "UTF-8")))).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))
        return F.coalesce(F.concat(own, F.lit(";")), F.lit("-;"))

    return F.concat(*[part(n) for n in names])


def join_small(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``right``, counted at ``rows``, by broadcast up to ``limit`` rows, else by a shuffle that AQE may split.

    Rows of ``right`` have a bounded width: numbers, digests and keys of ``code_key``.
    """
    return left.join(F.broadcast(right) if rows <= limit else right.hint("merge"), list(on), how)


def join_salted(left: DataFrame, right: DataFrame, on: str, rows: int, by: Column, salts: int = 16, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join on one column that may be hot in ``left``, unique in ``right``: by broadcast up to ``limit`` rows, else with hot values dealt over ``salts`` tasks by ``by``."""
    if rows <= limit:
        return left.join(F.broadcast(right), on)
    salt = F.pmod(F.xxhash64(by, F.lit(31)), F.lit(salts)).cast("int")
    dealt = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", salt).join(dealt.hint("merge"), [on, "__salt"]).drop("__salt")


_slot: dict = {}


def kept(key: str, make: Callable[[], object]):
    """A Python worker's one model: another takes its place, so a worker that serves several stages holds no more than the largest."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
    return _slot[key]


def slices(batches: Iterable[pa.RecordBatch], column: int, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and about ``size`` bytes of a text column (one row at least), empty ones too."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        ends, first = length.cumsum(), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            stop = max(first + 1, min(first + rows, int(ends.searchsorted(before + size, side="right"))))
            yield batch.slice(first, stop - first)
            first = stop


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of the frame's (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
