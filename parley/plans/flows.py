"""Files put in place, batches to functions, parts of recordings, sessions on events, progress of streams."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import functions as F

from parley.functions.text import sanitize_name
from parley.operators import batches, timeline
from parley.plans.registry import query
from parley.sources import files, sinks
from parley.sources.tables import MEETINGS, SEGMENTS, meetings, read, segments
from parley.streaming import inference, ordered, progress


def named_segments(spark, d):
    """Segments with the folder of their meeting, which its title and beginning name."""
    folder = F.concat(sanitize_name("title"), F.lit("_"), F.date_format("created_at", "yyyy-MM-dd_HH-mm-ss"))
    return segments(spark, d).join(meetings(spark, d).select("meeting_id", folder.alias("folder")), "meeting_id")


FOLDER = "title || '_' || strftime(created_at, '%Y-%m-%d_%H-%M-%S')"


@query("transcript_writer", f"WITH {SEGMENTS}, {MEETINGS} SELECT {FOLDER} || '/transcript.txt' AS path, string_agg(text, chr(10) ORDER BY seq) AS content FROM seg JOIN m USING (conv_id) GROUP BY title, created_at")
def transcript_writer(spark, d):
    """A text file for each meeting, written and read again."""
    path = files.scratch_path(spark, "transcript-texts")
    lines = named_segments(spark, d).groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("l"))
    sinks.write_files(lines.select(F.concat("folder", F.lit("/transcript.txt")).alias("path"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content")), path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("path"), F.col("content").cast("string").alias("content"))


@query("transcript_json_writer", f"WITH {SEGMENTS}, {MEETINGS} SELECT {FOLDER} AS folder, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS BIGINT) AS sequence_id, text, start_s AS started, count(*) OVER (PARTITION BY conv_id) AS total FROM seg JOIN m USING (conv_id)")
def transcript_json_writer(spark, d):
    """A JSON document for each meeting, with sequence ids from 0, written and read again."""
    path = files.scratch_path(spark, "transcript-documents")
    each = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text", "start_s", "end_s", "dur"))), lambda s, i: F.struct(s["text"].alias("text"), s["start_s"].alias("audio_start_time"), s["end_s"].alias("audio_end_time"), s["dur"].alias("duration"), i.cast("long").alias("sequence_id")))
    rows = named_segments(spark, d).groupBy("folder").agg(F.to_json(F.struct(F.lit("1.0").alias("version"), F.count(F.lit(1)).alias("total_segments"), each.alias("segments"))).alias("content"))
    sinks.write_files(rows.select(F.concat("folder", F.lit("/transcripts.json")).alias("path"), "content"), path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    document = F.from_json(F.col("content").cast("string"), files.TRANSCRIPTS_JSON)
    rows = found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), document.alias("t")).select("folder", F.col("t.total_segments").alias("total"), F.explode("t.segments").alias("s"))
    return rows.select("folder", "s.sequence_id", "s.text", F.col("s.audio_start_time").alias("started"), "total")


@query("batch_results", "WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS batch FROM events) SELECT user_id, CAST(batch AS BIGINT) AS batch, count(*) AS n, round(sum(value), 4) AS total, max(value) AS highest, count(*) FILTER (event_type = 'error') AS errors FROM n GROUP BY user_id, batch")
def batch_results(spark, d):
    """Twenty events of a user at a time, handed to a function on Arrow tables."""

    def summary(rows):
        return {"n": rows.num_rows, "total": pc.sum(rows["value"]).as_py(), "highest": pc.max(rows["value"]).as_py(), "errors": pc.sum(pc.equal(rows["event_type"], "error")).as_py()}

    rows = read(spark, d, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return batches.processed(rows, "user_id", ["ts", "event_id"], 20, summary, "n long, total double, highest double, errors long").withColumn("total", F.round("total", 4))


@query(
    "silence_parts",
    """WITH RECURSIVE x AS (SELECT vec_id // 200 AS recording, vec_id, p, CAST(embedding[CAST(p AS INTEGER)] AS DOUBLE) * CASE WHEN vec_id % 11 = 0 THEN 0.01 ELSE 1 END AS v FROM embeddings, unnest(range(1, 65)) AS u(p)),
q AS (SELECT recording, row_number() OVER w AS p, sum(v * v) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM x WINDOW w AS (PARTITION BY recording ORDER BY vec_id, p)),
c AS (SELECT recording, list_concat([CAST(0 AS DOUBLE)], list(s ORDER BY p)) AS s, max(p) AS n FROM q GROUP BY recording),
t AS (SELECT recording, CAST(-1 AS BIGINT) AS part, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS last FROM c
UNION ALL SELECT recording, part + 1, last, CASE WHEN n - last <= 4000 THEN n WHEN low > 0.02 THEN least(cut + 160, n) ELSE cut END FROM (
  SELECT *, coalesce(list_min(levels), 1e9) AS low, CASE WHEN len(levels) > 0 THEN starts[list_position(levels, list_min(levels))] + 8 ELSE last + 4000 END AS cut FROM (
  SELECT *, list_transform(starts, lambda i: sqrt(greatest(s[i + 17] - s[i + 1], 0) / 16)) AS levels FROM (
  SELECT t.recording, t.part, t.last, c.n, c.s, range(t.last + 3520, least(t.last + 4480, c.n - 16) - 15) AS starts FROM t JOIN c USING (recording) WHERE t.last < c.n))))
SELECT t.recording, part, first, last, round(sqrt((s[last + 1] - s[first + 1]) / (last - first)), 5) AS level FROM t JOIN c USING (recording) WHERE part >= 0""",
)
def silence_parts(spark, d):
    """Frames as chunks at a rate of 160, so that the limits of 25 and 3 seconds are thousands of samples; each eleventh frame is quiet."""
    n = F.col("vec_id")
    loud = F.when(n % 11 == 0, 0.01).otherwise(1.0)
    chunks = read(spark, d, "embeddings").select(F.expr("vec_id div 200").alias("recording"), n.alias("no"), F.transform("embedding", lambda v: v.cast("double") * loud).alias("samples"), F.lit(160).alias("rate"))
    return batches.split_recordings(chunks).withColumn("level", F.round("level", 5))


@query(
    "session_events",
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 7200 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT event_id, event_type, user_id || '-' || CAST(k AS BIGINT) AS session, strftime(min(ts) OVER p, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) OVER p, '%Y-%m-%d %H:%M:%S') AS session_end, epoch(max(ts) OVER p) - epoch(min(ts) OVER p) AS session_seconds FROM s WINDOW p AS (PARTITION BY user_id, k)""",
)
def session_events(spark, d):
    """Each event with the session it is in."""
    rows = batches.with_sessions(read(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", 7200)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("event_id", "event_type", "session", text("session_start"), text("session_end"), "session_seconds")


@query("stream_progress", "SELECT 'vad' AS stage, count(*) AS n, true AS several, CAST(30 AS BIGINT) AS progress FROM events UNION ALL SELECT 'transcribing', count(*) FILTER (event_type <> 'error'), true, CAST(95 AS BIGINT) FROM events")
def stream_progress(spark, d):
    """Two stages as streams over the events; what a listener hears of their micro-batches says how far the whole has come."""
    rows = read(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    work = {"vad": rows, "transcribing": rows.where("event_type <> 'error'")}
    total, base, streams = {name: df.count() for name, df in work.items()}, files.scratch_path(spark, "progress"), {}
    for name, df in work.items():
        ordered.write_slices(df, f"{base}/{name}", ticks=False)
        streams[name] = spark.readStream.schema(ordered.with_ts(df).schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}")
    heard = progress.observed(spark, streams, f"{base}/state").groupBy("stage").agg(F.sum("rows").alias("n"), (F.count(F.lit(1)) >= 3).alias("several"))
    percent = F.col("n") * 100 / F.element_at(F.create_map(*(F.lit(x) for kv in total.items() for x in kv)), F.col("stage"))
    return heard.withColumn("progress", timeline.overall_progress(F.col("stage"), percent, {"vad": (20, 30), "transcribing": (30, 95)}))


@query(
    "processed_jobs",
    """WITH j AS (SELECT user_id % 16 AS queue, event_id AS entry, value FROM events WHERE event_type IN ('signup', 'click'))
SELECT queue, entry, 'transcribing' AS phase, CASE WHEN value < 20 THEN 'chained' WHEN value < 60 THEN 'completed' WHEN value < 80 THEN 'yielded' ELSE 'failed' END AS result, CASE WHEN value >= 80 THEN 'too long' END AS problem FROM j
UNION ALL SELECT queue, entry, 'summarising', CASE WHEN value < 10 THEN 'completed' ELSE 'failed' END, CASE WHEN value >= 10 THEN 'no model' END FROM j WHERE value < 20""",
)
def processed_jobs(spark, d):
    """Jobs of sixteen queues go through two processors, of which each fails on some."""

    def transcriber():
        def process(job):
            if job["value"] >= 80:
                raise RuntimeError("too long")
            return "chained" if job["value"] < 20 else "completed" if job["value"] < 60 else "yielded"

        return process

    def summariser():
        def process(job):
            if job["value"] >= 10:
                raise RuntimeError("no model")
            return "completed"

        return process

    jobs = read(spark, d, "events").where("event_type IN ('signup', 'click')").select((F.col("user_id") % 16).alias("queue"), F.col("event_id").alias("entry"), "value")
    return inference.process_jobs(jobs, transcriber, summariser)
