"""State machines: plain steps, their batch form over ordered rows, and their streaming form.

The streaming form uses `applyInPandasWithState`, keyed by source; the batch form applies the same
step to the rows of a key in time order, a batch of Arrow rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEBOUNCE = 10.0


@dataclass
class Detector:
    """Idle until a titled window has a connection that began after the start; a loss of DEBOUNCE seconds ends the call."""

    start: float = 0.0
    in_call: bool = False
    lost_at: float | None = None

    def step(self, now: float, titled: bool, connected: bool, first_seen: float | None) -> str | None:
        if not self.in_call:
            if titled and connected and first_seen is not None and first_seen > self.start:
                self.in_call, self.lost_at = True, None
                return "detected"
            return None
        if connected:
            self.lost_at = None
            return None
        self.lost_at = now if self.lost_at is None else self.lost_at
        if now - self.lost_at >= DEBOUNCE:
            self.in_call, self.lost_at = False, None
            return "ended"
        return None


@dataclass
class Reorder:
    """Releases items in the order of their ids: the next one at once, others when `stale` seconds old."""

    stale: float = 0.1
    next_id: int = 0
    held: dict[int, float] = field(default_factory=dict)

    def step(self, now: float, item: int) -> list[int]:
        if item >= self.next_id:
            self.held.setdefault(item, now)
        out = []
        while self.held:
            low = min(self.held)
            if low != self.next_id and now - self.held[low] <= self.stale:
                break
            del self.held[low]
            out.append(low)
            self.next_id = low + 1
        return out


EDGES = "key long, at double, event string"


def detect(key: int, state: Detector, rows: pd.DataFrame) -> pd.DataFrame:
    found = []
    for r in rows.sort_values(["at", "id"]).itertuples():
        event = state.step(r.at, bool(r.titled), bool(r.connected), None if pd.isna(r.first_seen) else r.first_seen)
        if event:
            found.append((key, r.at, event))
    return pd.DataFrame(found, columns=["key", "at", "event"])


def detect_batch(rows: DataFrame) -> DataFrame:
    """Edges (key, at, event) from rows (key, id, at, titled, connected, first_seen).

    The rows of a key stream through its task in time order; only the state is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        states: tuple[int | None, Detector] = (None, Detector())
        for batch in batches:
            for key, part in batch.groupby("key", sort=False):
                if states[0] != key:
                    states = (key, Detector())
                yield detect(int(key), states[1], part)

    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, EDGES)


def detect_stream(rows: DataFrame) -> DataFrame:
    """The same on a stream; rows of one micro-batch are taken in time order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Detector(*state.get) if state.exists else Detector()
        yield detect(int(key[0]), machine, pd.concat(list(batches)))
        state.update((machine.start, machine.in_call, machine.lost_at))

    return rows.groupBy("key").applyInPandasWithState(run, EDGES, "start double, in_call boolean, lost_at double", "append", GroupStateTimeout.NoTimeout)


def reorder_batch(rows: DataFrame) -> DataFrame:
    """(key, id, at, pos) as the re-ordering buffer releases rows (key, id, at) that come in the order of `at`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        current, buffer, pos, now = None, Reorder(), 0, 0.0

        def flush() -> list[tuple]:
            nonlocal pos
            out = []
            for item in sorted(buffer.held):
                out.append((current, item, now, pos))
                pos += 1
            buffer.held.clear()
            return out

        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples():
                if r.key != current:
                    out += flush() if current is not None else []
                    current, buffer, pos = int(r.key), Reorder(), 0
                now = float(r.at)
                for item in buffer.step(now, int(r.id)):
                    out.append((current, item, now, pos))
                    pos += 1
            yield pd.DataFrame(out, columns=["key", "id", "at", "pos"])
        if current is not None:
            yield pd.DataFrame(flush(), columns=["key", "id", "at", "pos"])

    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, "key long, id long, at double, pos long")


def metrics_stream(events: DataFrame, seconds: int = 5, late: str = "10 minutes") -> DataFrame:
    """Rollup over tumbling windows; rows later than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), "n", "total")


def upsert_stream(segments: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str):
    """Each micro-batch keeps the last row of a sequence id and hands it to `merge`."""

    def run(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in ("meeting_id", "sequence_id")]
        last = batch.groupBy("meeting_id", "sequence_id").agg(F.max_by(F.struct(*rest), "revision").alias("r"))
        merge(last.select("meeting_id", "sequence_id", "r.*"))

    return segments.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def aligned_windows(chunks: DataFrame, size: int) -> DataFrame:
    """Two sources cut into windows of `size` samples by their running counts, the shorter one filled with zeros.

    chunks: recording, source ('mic' or 'system'), no, samples. A chunk goes to the windows that it
    reaches as slices, so a row is exchanged for each slice and not for each sample.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.size("samples")).over(Window.partitionBy("recording", "source").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = chunks.withColumns({"at": before.cast("long"), "n": F.size("samples")}).where("n > 0")
    cut = placed.withColumn("window", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    low, high = F.greatest(F.col("at"), F.col("window") * size), F.least(F.col("at") + F.col("n"), (F.col("window") + 1) * size)
    piece = F.slice("samples", (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    pieces = cut.select("recording", "window", "source", F.struct("at", piece.alias("s")).alias("p"))
    joined = lambda name: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("source") == name, F.col("p")))), lambda p: p["s"]))
    rows = pieces.groupBy("recording", "window").agg(joined("mic").alias("mic"), joined("system").alias("system"))
    longer = F.greatest(F.size("mic"), F.size("system"))
    filled = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(0.0), longer - F.size(c)))
    return rows.select("recording", "window", filled("mic").alias("mic"), filled("system").alias("system"))
