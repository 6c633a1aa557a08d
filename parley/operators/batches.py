"""Functions over the ordered rows of a key: batches to a function one at a time, a table function that splits at silence, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from parley.functions.signal import first_cut
from parley.operators.timeline import islands, seconds


def processed(rows: DataFrame, key: str, order: list[str], size: int, process: Callable[[pa.Table], dict], made: str) -> DataFrame:
    """(key, batch, what `process` makes) of every `size` rows of a key, in order; the last batch may be shorter.

    The rows of a key come as Arrow batches and are cut anew, so a task holds one batch of `size` rows and what
    arrived last, however many rows a key has. `process` takes a table of the rows and returns the columns of `made`.
    """
    names = [field.strip().split()[0] for field in made.split(",")]
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, batch long, {made}"

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, 0

        def done(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            found = process(part)
            number += 1
            columns = [pa.array([group[0].as_py()]), pa.array([number - 1], pa.int64()), *(pa.array([found[n]]) for n in names)]
            return pa.RecordBatch.from_arrays(columns, [key, "batch", *names])

        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            while held.num_rows >= size:
                yield done(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield done(held)

    # sorted by key and order once; the grouping asks for no other order
    return rows.repartition(key).sortWithinPartitions(key, *order).groupBy(key).applyInArrow(run, kind)


@udtf(returnType="recording long, part long, first long, last long, level double")
class SilenceSplitter:
    """Parts of a recording, as its chunks (recording, no, samples, rate) come in order: at most 25 seconds, cut in the
    middle of the quietest tenth of a second within three seconds of that, or a second later where nothing is quiet.

    A part goes out as soon as nothing that is still to come can move its end, so what is held is one part and its margin.
    """

    MOST, WINDOW, RADIUS, STEP, LEAD, QUIET = 25.0, 0.1, 3.0, 0.01, 1.0, 0.02

    def __init__(self) -> None:
        self.recording, self.rate, self.x, self.before, self.part = None, 1, np.zeros(0), 0, 0

    def eval(self, row):
        self.recording, self.rate = row["recording"], row["rate"]
        self.x = np.concatenate([self.x, np.asarray(row["samples"], dtype=float)])
        margin = int((self.MOST + self.RADIUS + self.LEAD) * self.rate)
        while len(self.x) > margin:
            yield self.out(self.cut())

    def terminate(self):
        while len(self.x) > int(self.MOST * self.rate):
            yield self.out(self.cut())
        if len(self.x):
            yield self.out(len(self.x))

    def cut(self) -> int:
        count = lambda s: max(1, int(s * self.rate))
        return first_cut(self.x, count(self.MOST), count(self.WINDOW), count(self.RADIUS), count(self.STEP), self.QUIET, count(self.LEAD))

    def out(self, end: int) -> tuple:
        part = self.x[:end]
        made = (self.recording, self.part, self.before, self.before + end, float(np.sqrt(np.mean(part * part))))
        self.x, self.before, self.part = self.x[end:], self.before + end, self.part + 1
        return made


def split_recordings(chunks: DataFrame) -> DataFrame:
    """(recording, part, first, last, level) of chunks (recording, no, samples, rate)."""
    table = chunks.select("recording", "no", "samples", "rate").asTable().partitionBy("recording").orderBy("no")
    return SilenceSplitter(table)


def with_sessions(rows: DataFrame, key: str, order: list[str], ts: str, gap: int) -> DataFrame:
    """`rows` with the session they are in: session (key and number), session_start, session_end, session_seconds.

    A session ends where `gap` seconds or more pass without a row.
    """
    marked = islands(rows, key, order, ts, gap)
    whole = Window.partitionBy(key, "island")
    first, last = F.min(ts).over(whole), F.max(ts).over(whole)
    marked = marked.withColumns({"session": F.concat_ws("-", key, "island"), "session_start": first, "session_end": last})
    return marked.withColumn("session_seconds", seconds(F.col("session_end")) - seconds(F.col("session_start"))).drop("island")
