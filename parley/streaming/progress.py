"""Progress of a stream as rows: what a listener hears of each micro-batch."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class ProgressRows(StreamingQueryListener):
    """(stage, batch, rows) of the streams named in `stages`; progress without rows isn't kept."""

    stages: set[str]
    rows: list[tuple[str, int, int]] = field(default_factory=list)
    ended: dict[str, threading.Event] = field(default_factory=dict)
    runs: dict[str, str] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        if event.name in self.stages:
            self.runs[str(event.runId)] = event.name
            self.ended.setdefault(event.name, threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name in self.stages and p.numInputRows:
            self.rows.append((p.name, p.batchId, p.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if name := self.runs.get(str(event.runId)):
            self.ended[name].set()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(set(self.rows)), "stage string, batch long, rows long")


def observed(spark: SparkSession, streams: dict[str, DataFrame], checkpoint: str, wait: float = 60.0) -> DataFrame:
    """Run the streams over what is available; (stage, batch, rows) of their micro-batches."""
    listener = ProgressRows(set(streams))
    spark.streams.addListener(listener)
    try:
        for name, stream in streams.items():
            query = stream.writeStream.format("noop").queryName(name).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
            query.awaitTermination()
            if not listener.ended.setdefault(name, threading.Event()).wait(wait):
                raise TimeoutError(f"no word of the end of {name}")
    finally:
        spark.streams.removeListener(listener)
    return listener.frame(spark)
