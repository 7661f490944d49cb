"""The landing zone as a stream: JSON lines with pinned fields, rescued data and a record of fields seen."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxmill.schemas import HINTED
from fluxmill.streaming.files import Files

RESCUED = "_rescued_data"


#: Fields of one micro-batch that are noted, the most frequent first; what senders name beyond is in the rescued data all the same.
MOST_FIELDS = 1000


def lines(spark: SparkSession, folder: str, max_files: int | None = None, newest_first: bool = False, max_bytes: int | None = None) -> DataFrame:
    """A stream of raw lines with their file; each file is read once per checkpoint. Files or their bytes bound a micro-batch."""
    reader = spark.readStream.schema("value STRING").option("latestFirst", str(newest_first).lower())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.text(folder).select("value", F.col("_metadata.file_path").alias("_source_file"))


def _fields(line: Column) -> Column:
    """The line's top-level fields as text, or null for what isn't a JSON object."""
    return F.from_json(line, T.MapType(T.StringType(), T.StringType()))


def parse(raw: DataFrame, schema: T.StructType = HINTED) -> DataFrame:
    """Pinned fields in their types; what doesn't fit goes to ``_rescued_data`` as JSON.

    Rescued are fields the schema doesn't name, values that can't be cast (the
    field itself is null) and lines that are no JSON object (whole, under
    ``_corrupt_record``).  Blank lines are dropped.
    """
    kept = raw.where(F.trim("value") != "").withColumn("__f", _fields(F.col("value")))
    value = {f.name: F.col("__f")[f.name] for f in schema}
    cast = {f.name: value[f.name] if isinstance(f.dataType, T.StringType) else value[f.name].try_cast(f.dataType) for f in schema}
    names = [F.lit(f.name) for f in schema]
    misfit = [f.name for f in schema if not isinstance(f.dataType, T.StringType)]
    odd = F.map_filter("__f", lambda k, v: ~k.isin(*names))
    for n in misfit:
        bad = value[n].isNotNull() & cast[n].isNull()
        odd = F.when(bad, F.map_concat(odd, F.create_map(F.lit(n), value[n]))).otherwise(odd)
    corrupt = F.to_json(F.create_map(F.lit("_corrupt_record"), F.col("value")))
    rescued = F.when(F.col("__f").isNull(), corrupt).when(F.size(odd) > 0, F.to_json(odd))
    others = [c for c in raw.columns if c != "value"]
    return kept.select(*[c.alias(n) for n, c in cast.items()], rescued.alias(RESCUED), *others)


def bronze_rows(raw: DataFrame, schema: T.StructType = HINTED) -> DataFrame:
    """Rows of the raw table: nothing filtered, nothing judged."""
    return parse(raw, schema).withColumn("_ingested_at", F.current_timestamp())


#: Types that a field can turn out to have, narrowest first; anything else is text.
INFERRED = ("BOOLEAN", "BIGINT", "DOUBLE", "TIMESTAMP")


def observed_fields(raw: DataFrame, column: str = "value", most: int = MOST_FIELDS) -> dict[str, str]:
    """Top-level fields that JSON texts have, with the narrowest type all their values have.

    One aggregate with map-side combining; only the ``most`` frequent names leave it.
    """
    pairs = raw.select(F.explode(_fields(F.col(column))).alias("field", "text")).where("field <> '_corrupt_record'")
    fits = [F.coalesce(F.every(F.col("text").isNull() | F.col("text").try_cast(t).isNotNull()), F.lit(False)).alias(t) for t in INFERRED]
    rows = pairs.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("filled"), *fits).orderBy(F.col("n").desc(), "field").limit(most)
    return {r["field"]: next((t for t in INFERRED if r[t] and r["filled"]), "STRING") for r in rows.collect()}


class SchemaLog:
    """Fields seen so far with their types, kept beside the checkpoint: evolution is noted, never fatal."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark, folder), folder

    def types(self) -> dict[str, str]:
        names = [n for n in self.files.names(self.folder) if n.endswith(".json")]
        return self.files.read_json(f"{self.folder}/{names[-1]}") if names else {}

    def fields(self) -> list[str]:
        return list(self.types())

    def note(self, found: dict[str, str]) -> list[str]:
        """Record new names, and wider types of known ones; returns the names that were new."""
        known = self.types()
        new = sorted(set(found) - set(known))
        wider = {n: wider_type(known[n], t) for n, t in found.items() if n in known}
        changed = {**known, **wider, **{n: found[n] for n in new}}
        if changed != known:
            self.files.mkdirs(self.folder)
            count = len([n for n in self.files.names(self.folder) if n.endswith(".json")])
            self.files.create(f"{self.folder}/{count:06d}.json", json.dumps(changed))
        return new


def wider_type(a: str, b: str) -> str:
    """The type that holds the values of both."""
    return a if a == b else "DOUBLE" if {a, b} == {"BIGINT", "DOUBLE"} else "STRING"
