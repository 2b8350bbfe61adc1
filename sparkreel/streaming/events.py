"""The event sink: rows of a stream, and its progress, tagged with the job they belong to."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def tagged(events: DataFrame, job_id: str) -> DataFrame:
    """Events with the id of their job first; a column of that name is replaced."""
    rest = [F.col(f"`{c}`") for c in events.columns if c != "job_id"]
    return events.select(F.lit(job_id).alias("job_id"), *rest)


def sink(events: DataFrame, job_id: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the events of a job to its partition (job_id=<id>) of a table, each once.

    The file sink's log, one for each job, drops what a retried batch writes again.
    """
    rows = tagged(events, job_id).drop("job_id")  # the folder's name holds it
    return rows.writeStream.format("parquet").queryName(f"events-{job_id}").option("path", f"{folder.rstrip('/')}/job_id={job_id}").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Progress of the queries that `sink` starts, as rows (job_id, event, batch, rows); other queries are not ours."""

    def __init__(self):
        self._names: dict[str, str] = {}
        self._rows: list[tuple[str, str, int | None, int | None]] = []
        self._lock = threading.Lock()

    def _note(self, run_id, event: str, batch: int | None = None, rows: int | None = None) -> None:
        with self._lock:
            if (job := self._names.get(str(run_id))) is not None:
                self._rows.append((job, event, batch, rows))

    def rows(self) -> list[tuple[str, str, int | None, int | None]]:
        with self._lock:
            return list(self._rows)

    def onQueryStarted(self, event) -> None:
        if event.name and event.name.startswith("events-"):
            self._names[str(event.runId)] = event.name.removeprefix("events-")
            self._note(event.runId, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._note(p.runId, "progress", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._note(event.runId, "idle")

    def onQueryTerminated(self, event) -> None:
        self._note(event.runId, "failed" if event.exception else "finished")
