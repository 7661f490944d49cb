"""Verification: the queries an operator looks at, and the identities that must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxmill.config import Env
from fluxmill.plans.statements import Executor, columns_view, list_tables, read_table

TABLES = ["bronze_pings_raw", "silver_pings", "silver_pings_quarantine", "truck_details", "gold_truck_current_position", "gold_region_activity_5m"]

# The named queries; their tables and columns are the contract of the tables.
SQL = {
    "medallion_counts": " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in TABLES),
    "bronze_report": "SELECT count(*) AS bronze_rows, count(DISTINCT _source_file) AS files_ingested, min(_ingested_at) AS first_ingest, max(_ingested_at) AS last_ingest FROM bronze_pings_raw",
    "dedup_proof": "SELECT (SELECT count(*) FROM bronze_pings_raw) AS bronze_rows, (SELECT count(*) FROM silver_pings) AS silver_rows, (SELECT count(*) FROM (SELECT DISTINCT ping_id FROM silver_pings) k) AS silver_distinct_keys, (SELECT count(*) FROM silver_pings_quarantine) AS quarantined_rows",
    "reject_reasons": "SELECT reject_reason, count(*) AS n FROM silver_pings_quarantine GROUP BY reject_reason ORDER BY n DESC, reject_reason",
    "latest_positions": "SELECT truck_id, last_event_ts, round(latitude, 4) AS lat, round(longitude, 4) AS lon, make, model, driver, home_depot, region FROM gold_truck_current_position ORDER BY last_event_ts DESC, truck_id LIMIT 20",
    "activity": "SELECT region, window_start, window_end, ping_count, truck_count FROM gold_region_activity_5m ORDER BY window_start DESC, region LIMIT 20",
    "geofence_counts": "SELECT geofence_name, in_geofence, count(*) AS trucks FROM gold_truck_current_position GROUP BY geofence_name, in_geofence ORDER BY in_geofence DESC",
    "ledger": "SELECT version, filename, applied_at, applied_by, statements FROM schema_migrations ORDER BY version",
}


def query(spark: SparkSession, env: Env, name_or_sql: str) -> DataFrame:
    """One of the named queries, or any SQL over the environment's tables."""
    return Executor(spark, env).query(SQL.get(name_or_sql, name_or_sql))


def problems(spark: SparkSession, env: Env) -> list[str]:
    """Identities that don't hold; empty when all is well. A handful of aggregates over the tables."""
    read = lambda n: read_table(spark, env, n)
    out = []
    silver, trucks = read("silver_pings"), read("truck_details")
    rows, keys = silver.agg(F.count(F.lit(1)), F.countDistinct("ping_id")).first()
    if rows != keys:
        out.append(f"silver has {rows} rows for {keys} keys")
    n, ids = trucks.agg(F.count(F.lit(1)), F.countDistinct("truck_id")).first()
    if n != ids:
        out.append(f"the dimension has {n} rows for {ids} trucks")
    counted = read("gold_region_activity_5m").agg(F.coalesce(F.sum("ping_count"), F.lit(0))).first()[0]
    if counted != rows:
        out.append(f"windows count {counted} pings of {rows}")
    located = read("gold_truck_current_position").count()
    seen = silver.select("truck_id").distinct().count()
    if located != seen:
        out.append(f"{located} positions for {seen} trucks with pings")
    return out


def report(spark: SparkSession, env: Env, limit: int = 20) -> str:
    """The queries' results as markdown."""
    parts = [f"# {env.catalog}.{env.schema}", f"tables: {', '.join(list_tables(spark, env))}; volumes: {', '.join(env.volumes)}"]
    for name in SQL:
        if name == "geofence_counts" and "in_geofence" not in read_table(spark, env, "gold_truck_current_position").columns:
            continue
        df = query(spark, env, name)
        rows = df.limit(limit).collect()
        parts.append("\n".join([f"## {name}", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]))
    cols = columns_view(spark, env).where("table_name = 'gold_truck_current_position'").orderBy("ordinal_position").collect()
    parts.append("\n".join(["## columns of gold_truck_current_position", *(f"- {r['column_name']} {r['data_type']}" for r in cols)]))
    found = problems(spark, env)
    parts.append("## identities\n" + ("\n".join(f"- broken: {p}" for p in found) or "all hold"))
    return "\n\n".join(parts) + "\n"
