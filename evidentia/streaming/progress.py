"""Progress of a running job (R2): progress / done / error events with
counts, as rows. Built from the query's own progress reports; no server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

EVENTS = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("status", T.StringType()),       # progress | done | error
    T.StructField("input_rows", T.LongType()),     # rows delivered (a sink's own: after repeated keys are folded)
    T.StructField("message", T.StringType()),
    T.StructField("affected", T.LongType()),       # rows changed in the table, where the sink says so
])


class ProgressLog(StreamingQueryListener):
    """Every event of a stream, as rows: one per micro-batch and one at the
    end from Spark's own reports, plus those of a sink that reports its
    batches itself (``batch_started``, ``batch_done``).

    With ``path`` the events are appended to a table there whenever FLUSH of
    them are held, so a stream of any life holds few on the driver and loses
    none; without it they are all held."""

    FLUSH = 500

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.events: list[tuple] = []
        self.spark, self.path = spark, path

    def _add(self, *event):
        self.events.append(event)
        if self.path and len(self.events) >= self.FLUSH:
            self.flush()

    def flush(self) -> None:
        held, self.events = self.events, []
        if held and self.path:
            self.spark.createDataFrame(held, EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def batch_started(self, batch_id: int) -> None:
        self._add(None, int(batch_id), "started", None, None, None)

    def batch_done(self, batch_id: int, rows: int, affected: int | None = None) -> None:
        self._add(None, int(batch_id), "progress", int(rows), None, affected)

    def run_done(self, query) -> None:
        """The end of a run that the caller has waited for."""
        e = query.exception()
        self._add(str(query.id), None, "error" if e else "done", None, str(e) if e else None, None)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self._add(str(p.id), int(p.batchId), "progress", int(p.numInputRows), None, None)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._add(str(event.id), None, "error" if event.exception else "done", None, event.exception, None)

    def frame(self, spark: SparkSession) -> DataFrame:
        if not self.path:
            return spark.createDataFrame(self.events, EVENTS)
        self.flush()
        return spark.read.schema(EVENTS).parquet(self.path)


def progress_frame(spark: SparkSession, query, log: ProgressLog | None = None) -> DataFrame:
    """Progress rows of a finished query: all of them from ``log``, if one
    was kept; else from the query's recent reports, which Spark trims to the
    last ``spark.sql.streaming.numRecentProgressUpdates``."""
    if log is not None:
        return log.frame(spark)
    rows = [(str(p["id"]), int(p["batchId"]), "progress", int(p["numInputRows"]), None, None)
            for p in query.recentProgress]
    exc = query.exception()
    rows.append((str(query.id), None, "error" if exc else "done", None, str(exc) if exc else None, None))
    return spark.createDataFrame(rows, EVENTS)
