"""Versioned migrations with a ledger: each file is applied once, in the order of its name."""

from __future__ import annotations

import getpass
import hashlib
import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxmill.config import Env
from fluxmill.plans.statements import Executor, render, split_statements
from fluxmill.schemas import LEDGER
from fluxmill.streaming.storage import ColumnExists, SnapshotTable

log = logging.getLogger(__name__)

FOLDER = Path(__file__).resolve().parent.parent / "migrations"
EVERYTHING = "9999"


@dataclass(frozen=True)
class Migration:
    version: str
    filename: str
    text: str

    @property
    def checksum(self) -> str:
        """Of the text before values are put in: other values are no other migration."""
        return hashlib.sha256(self.text.encode()).hexdigest()


def discover(folder: Path | str = FOLDER) -> list[Migration]:
    return [Migration(p.name.partition("_")[0], p.name, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.sql"))]


class Runner:
    def __init__(self, spark: SparkSession, env: Env, folder: Path | str = FOLDER):
        self.spark, self.env, self.folder = spark, env, folder
        self.executor = Executor(spark, env)
        self.ledger = SnapshotTable.create(spark, env.table_path(LEDGER.name), LEDGER.schema, LEDGER.keys, buckets=1, comment="Applied migrations.")

    def applied(self) -> dict[str, str]:
        """Checksum by version; as many rows as there are migration files."""
        return {r["version"]: r["checksum"] for r in self.ledger.read().collect()}

    def run(self, through: str = EVERYTHING) -> list[tuple[str, str, str]]:
        """(version, filename, outcome) of every file; versions after ``through`` (as text) are held back."""
        known, report = self.applied(), []
        for m in discover(self.folder):
            if m.version > through:
                outcome = "held back"
            elif known.get(m.version) == m.checksum:
                outcome = "already applied"
            else:
                if m.version in known:
                    log.warning("%s was changed after it was applied; it is applied again. Add a new migration instead.", m.filename)
                self._apply(m)
                outcome = "applied"
            report.append((m.version, m.filename, outcome))
        return report

    def _apply(self, m: Migration) -> None:
        """All statements, then the ledger: a file that fails half-way is tried whole the next time."""
        statements = split_statements(render(m.text, self.env.substitutions()))
        for sql in statements:
            try:
                self.executor.execute(sql)
            except ColumnExists as there:  # only ADD COLUMNS may find its work done
                log.warning("%s: %s", m.filename, there)
        row = self.spark.range(1).select(F.lit(m.version).alias("version"), F.lit(m.filename).alias("filename"), F.lit(m.checksum).alias("checksum"), F.current_timestamp().alias("applied_at"), F.lit(_user(self.spark)).alias("applied_by"), F.lit(len(statements)).alias("statements"))
        self.ledger.merge_upsert(row)

    def table(self) -> DataFrame:
        return self.ledger.read().orderBy("version")


def _user(spark: SparkSession) -> str:
    return spark.range(1).select(F.current_user()).first()[0] or getpass.getuser()
