"""Progress of streams as a table: a listener leaves a small document for each batch, and the table reads them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from gleanery.sources.runs import Folder

SCHEMA = "query string, run string, batch long, at timestamp, rows long, rows_a_second double, seconds double, state_rows long, watermark string, ended boolean, error string"


class Progress(StreamingQueryListener):
    """Writes below `folder`; of all streams of the session, or of one name."""

    def __init__(self, spark: SparkSession, folder: str, name: str | None = None):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        self._documents = Folder(spark, self.folder)
        self._runs: set[str] = set()

    def _write(self, **cells: object) -> None:
        self._documents.write(json.dumps(cells), f"{uuid.uuid4().hex}.json")

    def onQueryStarted(self, event) -> None:
        if self.name is None or event.name == self.name:
            self._runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) in self._runs:
            took = p.durationMs.get("triggerExecution", 0) / 1000
            self._write(query=str(p.id), run=str(p.runId), batch=p.batchId, at=p.timestamp, rows=p.numInputRows, rows_a_second=p.processedRowsPerSecond, seconds=took, state_rows=sum(s.numRowsTotal for s in p.stateOperators), watermark=p.eventTime.get("watermark", ""), ended=False, error="")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self._runs:
            self._write(query=str(event.id), run=str(event.runId), batch=None, at=None, rows=0, rows_a_second=None, seconds=None, state_rows=None, watermark="", ended=True, error=event.exception or "")

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        """Waits for what the streams have still to tell."""
        self.spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        self.spark.streams.removeListener(self)

    def table(self) -> DataFrame:
        """A row for each batch, and one for each end."""
        names = [n for n, is_folder in self._documents.names() if n.endswith(".json") and not is_folder]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.folder)
