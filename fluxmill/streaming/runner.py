"""Running streams to the end of what is there."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import DataStreamWriter

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Drained:
    """What a run did over all its micro-batches (as far as Spark keeps their progress); rows of the source: lines of files, appends of tables."""

    name: str
    batches: int
    rows: int


def run_available_now(writer: DataStreamWriter, name: str, rows: Callable[[], int] | None = None) -> Drained:
    """Start with the available-now trigger, wait for the end and add up the progress of every batch; ``rows`` counts what the source's own rows don't."""
    return _wait(writer.trigger(availableNow=True).queryName(name), name, rows)


def run_every(writer: DataStreamWriter, name: str, interval: str, path: str | None = None):
    """The same stream kept running, a micro-batch each ``interval``; returns the query."""
    writer = writer.trigger(processingTime=interval).queryName(name)
    return writer.start(path) if path else writer.start()


def _wait(writer: DataStreamWriter, name: str, rows: Callable[[], int] | None) -> Drained:
    query = writer.start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        raise StreamFailed(name, root_cause(str(e))) from e
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    done = Drained(name, len(progress), rows() if rows else sum(p["numInputRows"] for p in progress))
    log.info("%s: %d rows in %d batches", name, done.rows, done.batches)
    return done


class StreamFailed(RuntimeError):
    def __init__(self, name: str, cause: str):
        super().__init__(f"{name}: {cause}")
        self.stream, self.cause = name, cause


def root_cause(text: str, tail: int = 12) -> str:
    """The last lines of a failure that name a cause rather than a place."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("at ", "File ", "..."))]
    named = [x for x in lines if "Error" in x or "Exception" in x or x.startswith("Caused by")]
    return "\n".join((named or lines)[-tail:])
