"""Batch forms of the streaming operators, over the rows of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators import timeline
from parley.plans.registry import query
from parley.sources.tables import read
from parley.streaming import processors


@query(
    "vad_sessionize",
    """WITH f AS (SELECT user_id, event_id, ts, value > 35 AS on_, lag(value > 35) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN on_ AND coalesce(NOT before, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS final FROM f)
SELECT user_id, CAST(k AS BIGINT) AS segment, count(*) AS frames, CASE WHEN bool_or(final) THEN 0.8 ELSE 0.9 END AS confidence FROM s WHERE on_ GROUP BY user_id, k""",
)
def vad_sessionize(spark, d):
    """Runs of frames over the threshold; one that is still open at the end gets the lower confidence."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, d, "events").withColumn("on", F.col("value") > 35)
    start = F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))
    rows = rows.withColumns({"start": start, "final": F.lead("event_id").over(w).isNull()})
    rows = rows.withColumn("segment", F.count_if("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("on").groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("frames"), F.when(F.bool_or("final"), 0.8).otherwise(0.9).alias("confidence"))


@query(
    "detector_fsm",
    """WITH r AS (SELECT user_id, event_id, epoch(ts) AS moment, event_type IN ('view', 'click') AS titled, event_type <> 'error' AS connected FROM events),
i AS (SELECT *, count(*) FILTER (connected) OVER (PARTITION BY user_id ORDER BY moment, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r),
l AS (SELECT *, min(moment) FILTER (NOT connected) OVER (PARTITION BY user_id, island) AS lost FROM i),
s AS (SELECT user_id, event_id, moment, connected FROM l WHERE (connected AND titled AND user_id % 10 <> 0) OR (NOT connected AND moment - lost >= 10)),
b AS (SELECT *, lag(connected) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS before FROM s)
SELECT user_id AS key, moment AS "at", CASE WHEN connected THEN 'detected' ELSE 'ended' END AS event FROM b WHERE (connected AND before IS NOT TRUE) OR (NOT connected AND before)""",
)
def detector_fsm(spark, d):
    """Meeting edges for each user: views and clicks have a window title, everything but errors a connection."""
    at = timeline.seconds(F.col("ts"))
    rows = read(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), at.alias("at"),
        F.col("event_type").isin("view", "click").alias("titled"), (F.col("event_type") != "error").alias("connected"), F.when(F.col("user_id") % 10 != 0, at).alias("first_seen"),
    )
    return processors.detect_batch(rows)


@query(
    "reorder_buffer",
    """WITH RECURSIVE r AS MATERIALIZED (SELECT l_orderkey AS key, CAST(l_linenumber - 1 AS BIGINT) AS id, CAST(l_extendedprice AS DOUBLE) / 1e6 AS moment, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS n FROM lineitem),
t AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS moment, CAST([] AS STRUCT(id BIGINT, moment DOUBLE)[]) AS held, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS following FROM r
UNION ALL SELECT key, n, moment, h, coalesce(b[1], len(h) + 1) - 1, CASE WHEN coalesce(b[1], len(h) + 1) > 1 THEN h[coalesce(b[1], len(h) + 1) - 1].id + 1 ELSE following END
FROM (SELECT *, list_filter(range(1, len(h) + 1), lambda p: NOT (h[p].id = CASE WHEN p = 1 THEN following ELSE h[p - 1].id + 1 END OR moment - h[p].moment > 0.1)) AS b
FROM (SELECT r.key, r.n, r.moment, following, list_sort(CASE WHEN r.id >= following AND NOT list_contains(list_transform(held[k + 1:], lambda x: x.id), r.id) THEN list_append(held[k + 1:], {'id': r.id, 'moment': r.moment}) ELSE held[k + 1:] END) AS h FROM t JOIN r ON r.key = t.key AND r.n = t.n + 1))),
o AS (SELECT key, n, moment, unnest(held[1:k]).id AS id FROM t WHERE n > 0 UNION ALL SELECT key, n + 1, moment, unnest(held[k + 1:]).id FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1))
SELECT key, id, moment AS "at", row_number() OVER (PARTITION BY key ORDER BY n, id) - 1 AS pos FROM o""",
)
def reorder_buffer(spark, d):
    """Lines of an order come in the order of their price; the buffer releases them by number."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") - 1).cast("long").alias("id"), (F.col("l_extendedprice") / 1e6).alias("at"))
    return processors.reorder_batch(rows)


@query(
    "aligned_windows",
    """WITH s AS (SELECT vec_id // 10 AS recording, vec_id % 2 = 0 AS mic, vec_id, embedding, (row_number() OVER (PARTITION BY vec_id // 10, vec_id % 2 ORDER BY vec_id) - 1) * 64 AS first FROM embeddings),
x AS (SELECT recording, mic, (first + i - 1) // 60 AS w, CAST(embedding[CAST(i AS INTEGER)] AS DOUBLE) AS v FROM s, unnest(range(1, 65)) AS r(i))
SELECT recording, CAST(w AS BIGINT) AS "window", CAST(greatest(count(*) FILTER (mic), count(*) FILTER (NOT mic)) AS BIGINT) AS n, round(coalesce(sum(v) FILTER (mic), 0), 6) AS mic, round(coalesce(sum(v) FILTER (NOT mic), 0), 6) AS system FROM x GROUP BY recording, w""",
)
def aligned_windows(spark, d):
    source = F.when(F.col("vec_id") % 2 == 0, "mic").otherwise("system")
    rows = read(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("recording"), source.alias("source"), F.col("vec_id").alias("no"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"))
    done = processors.aligned_windows(rows, 60)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)
    return done.select("recording", "window", F.size("mic").cast("long").alias("n"), total("mic").alias("mic"), total("system").alias("system"))
