"""Files put in place by renaming, batches to functions, the splitter as a table function, sessions, progress of streams."""

import glob
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from parley.functions.signal import split_points
from parley.operators import batches
from parley.sources import sinks
from parley.streaming import inference, ordered, progress


def test_files_are_as_the_rows(spark, tmp_path):
    rows = [(f"m{i}/t {i}.txt", "é\n" * i) for i in range(40)] + [("empty.txt", None)]
    sinks.write_files(spark.createDataFrame(rows, "path string, content string").repartition(5), f"file://{tmp_path}/out")
    found = {os.path.relpath(f, f"{tmp_path}/out"): open(f).read() for f in glob.glob(f"{tmp_path}/out/**", recursive=True) if os.path.isfile(f)}
    assert json.loads(found.pop("_SUCCESS")) == {"files": 41} and found == {p: c or "" for p, c in rows}


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    writer = sinks.FileWriter(f"file://{tmp_path}")

    def rows():
        yield Row(path="a/1.txt", content="x")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(rows())
    with pytest.raises(ValueError):
        writer.write(iter([Row(path="b.txt", content="x"), Row(path="../b.txt", content="x")]))
    assert [f for f in glob.glob(f"{tmp_path}/**", recursive=True, include_hidden=True) if os.path.isfile(f)] == []
    done = writer.write(iter([Row(path="a/2.txt", content="y")]))  # of a job that another task breaks
    assert os.path.isfile(f"{tmp_path}/a/2.txt")
    writer.abort([done, None])
    assert [f for f in glob.glob(f"{tmp_path}/**", recursive=True, include_hidden=True) if os.path.isfile(f)] == []
    bad = spark.range(4).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="no"):
        sinks.write_files(bad.repartition(1), f"file://{tmp_path}/job")
    assert [f for f in glob.glob(f"{tmp_path}/job/**", recursive=True, include_hidden=True) if os.path.isfile(f)] == []


def test_batches_come_one_at_a_time(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.random()) for k, n in ((1, 2500), (2, 1), (3, 100)) for i in range(n)]
    rng.shuffle(rows)
    seen = lambda part: {"n": part.num_rows, "first": part["i"][0].as_py(), "last": part["i"][-1].as_py()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    got = batches.processed(spark.createDataFrame(rows, "k long, i long, v double").repartition(3), "k", ["i"], 100, seen, "n long, first long, last long").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, b, min(100, n - 100 * b), 100 * b, min(n, 100 * b + 100) - 1) for k, n in ((1, 2500), (2, 1), (3, 100)) for b in range(-(-n // 100))]
    assert sorted(map(tuple, got)) == want


def test_splitter_gives_out_parts_as_it_goes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(scale=0.3, size=16_000 * 70)
    x[16_000 * 24 : 16_000 * 24 + 3200] = 0  # one silence near the first limit, none near the second
    rows = [(9, n, [float(v) for v in x[a : a + 8000]], 16_000) for n, a in enumerate(range(0, len(x), 8000))]
    got = batches.split_recordings(spark.createDataFrame(rows, "recording long, no long, samples array<double>, rate int").repartition(4)).orderBy("part").collect()
    want = split_points(x, 25 * 16_000, 1600, 48_000, 160, 0.02, 16_000)
    assert [(r["first"], r["last"]) for r in got] == want and len(want) == 3 and 24 * 16_000 <= want[0][1] <= 24.2 * 16_000
    one = batches.SilenceSplitter.func()
    parts = [list(one.eval({"recording": 9, "rate": 16_000, "samples": x[a : a + 8000]})) for a in range(0, len(x), 8000)]
    assert sum(map(len, parts)) == 2 and len(one.x) <= 29 * 16_000 + 8000


def test_sessions_on_each_row(spark):
    rows = [(1, 0, 1), (1, 100, 2), (1, 160, 3), (1, 1000, 4), (2, 5, 5)]
    events = spark.createDataFrame(rows, "u long, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = batches.with_sessions(events, "u", ["ts", "id"], "ts", 100)
    assert [(r.id, r.session, r.session_seconds) for r in got.orderBy("id").collect()] == [(1, "1-1", 0.0), (2, "1-2", 60.0), (3, "1-2", 60.0), (4, "1-3", 0.0), (5, "2-1", 0.0)]


def test_progress_of_micro_batches(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("at"))
    ordered.write_slices(rows, f"{tmp_path}/in", 4, ticks=False)
    stream = spark.readStream.schema(ordered.with_ts(rows).schema).option("maxFilesPerTrigger", 1000).parquet(f"{tmp_path}/in")
    heard = progress.observed(spark, {"one": stream}, f"{tmp_path}/state").collect()
    assert [(r.stage, r["rows"]) for r in heard] == [("one", 100)]
    assert progress.observed(spark, {"one": stream}, f"{tmp_path}/state").count() == 0  # nothing new


def test_jobs_go_in_order_and_a_failure_stops_no_queue(spark):
    jobs = spark.createDataFrame([(1, 3, "a"), (1, 1, "chained"), (1, 2, "bad"), (2, 1, "chained"), (1, 4, "yielded")], "queue long, entry long, kind string").repartition(3)

    def make():
        def process(job):
            if job["kind"] == "a":
                raise RuntimeError("lost")
            return job["kind"]

        return process

    summary = lambda: lambda job: "completed"
    got = [tuple(r) for r in inference.process_jobs(jobs, make, summary).where("queue = 1").collect()]
    assert got == [(1, 1, "transcribing", "chained", None), (1, 1, "summarising", "completed", None), (1, 2, "transcribing", "failed", "no such result: bad"), (1, 3, "transcribing", "failed", "lost"), (1, 4, "transcribing", "yielded", None)]
    assert [r.result for r in inference.process_jobs(jobs, make).where("queue = 2").collect()] == ["completed"]
