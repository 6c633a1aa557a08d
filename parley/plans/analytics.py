"""Usage analytics: counts, sessions, state over time, classifications."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import devices
from parley.functions.text import split_count
from parley.operators import timeline
from parley.plans.registry import query
from parley.sources.tables import SEGMENTS, read, segments

REF = "TIMESTAMP '2024-02-01 00:00:00'"


def events(spark, d):
    return read(spark, d, "events")


@query("segment_stats", f"WITH {SEGMENTS} SELECT meeting_id, round(avg(dur), 6) AS mean, min(dur) AS shortest, max(dur) AS longest, round(sum(dur), 6) AS speech, round(100 * sum(dur) / (max(end_s) + 10), 6) AS coverage FROM seg GROUP BY meeting_id")
def segment_stats(spark, d):
    speech = F.sum("dur")
    return segments(spark, d).groupBy("meeting_id").agg(F.round(F.avg("dur"), 6).alias("mean"), F.min("dur").alias("shortest"), F.max("dur").alias("longest"), F.round(speech, 6).alias("speech"), F.round(100 * speech / (F.max("end_s") + 10), 6).alias("coverage"))


@query("avg_confidence", "SELECT source, round(coalesce(avg(quality), 0), 6) AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def avg_confidence(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.coalesce(F.avg("quality"), F.lit(0)), 6).alias("mean"))


@query("confidence_gate", r"SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality IS NULL OR quality >= 0.3) AND regexp_matches(text, '\S')")
def confidence_gate(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.where((F.col("quality").isNull() | (F.col("quality") >= 0.3)) & F.col("text").rlike(r"\S")).select("doc_id")


@query("meeting_metrics", rf"WITH {SEGMENTS} SELECT meeting_id, count(*) AS segments, CAST(sum(len(regexp_split_to_array(text, '\s+'))) AS BIGINT) AS words, round(CASE WHEN max(end_s) > 0 THEN sum(len(regexp_split_to_array(text, '\s+'))) / (max(end_s) / 60) ELSE 0 END, 6) AS words_per_minute FROM seg GROUP BY meeting_id")
def meeting_metrics(spark, d):
    last = F.coalesce(F.max_by("end_s", "seq"), F.max_by("start_s", "seq"), F.lit(0.0))
    rows = segments(spark, d).withColumn("w", split_count("text")).groupBy("meeting_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("w").alias("words"), last.alias("s"))
    return rows.select("meeting_id", "segments", "words", F.round(F.when(F.col("s") > 0, F.col("words") / (F.col("s") / 60)).otherwise(0.0), 6).alias("words_per_minute"))


@query("daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY strftime(ts, '%Y-%m-%d')) AS BIGINT) AS running FROM events GROUP BY 1")
def daily_counts(spark, d):
    days = events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each day is left, so the running total over all of them is small whatever the input
    return days.withColumn("running", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("day")))


@query("feature_usage", "SELECT user_id, event_type AS feature, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_used, count(*) AS use_count FROM events GROUP BY user_id, event_type")
def feature_usage(spark, d):
    return events(spark, d).groupBy("user_id", F.col("event_type").alias("feature")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_used"), F.count(F.lit(1)).alias("use_count"))


@query("copy_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def copy_counts(spark, d):
    rows = events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", ["view", "click", "purchase"]).agg(F.count(F.lit(1)))
    return rows.fillna(0)


@query("metrics_batch50", "WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 50 AS batch FROM events) SELECT user_id, CAST(batch AS BIGINT) AS batch, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, epoch(max(ts)) - epoch(min(ts)) AS span FROM n GROUP BY user_id, batch")
def metrics_batch50(spark, d):
    return timeline.count_batches(events(spark, d), "user_id", ["ts", "event_id"], 50).groupBy("user_id", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), (timeline.seconds(F.max("ts")) - timeline.seconds(F.min("ts"))).alias("span")
    )


@query(
    "hysteresis_gate",
    """WITH w AS (SELECT event_id, user_id, ts, count(*) OVER k AS c, min(value) OVER k AS lo, max(value) OVER k AS hi FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 5 PRECEDING)),
s AS (SELECT *, CASE WHEN c < 6 THEN NULL WHEN lo > 35 THEN true WHEN hi <= 35 THEN false END AS flip FROM w)
SELECT event_id, coalesce(last_value(flip IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS busy FROM s""",
)
def hysteresis_gate(spark, d):
    return timeline.hysteresis(events(spark, d), "user_id", ["ts", "event_id"], "value", 35.0, 6).select("event_id", "busy")


@query("trailing_mean", "WITH w AS (SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 29 PRECEDING) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_id, round(a, 4) AS mean FROM w WHERE n % 10 = 0")
def trailing_mean(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events(spark, d).select("user_id", "event_id", F.round(F.avg("value").over(w.rowsBetween(-29, 0)), 4).alias("mean"), F.row_number().over(w).alias("n"))
    return rows.where("n % 10 = 0").drop("n")


@query("sessionize_gap", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM s GROUP BY user_id, island")
def sessionize_gap(spark, d):
    rows = timeline.islands(events(spark, d), "user_id", ["ts", "event_id"], "ts", 3600)
    return rows.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), (timeline.seconds(F.max("ts")) - timeline.seconds(F.min("ts"))).alias("seconds"))


@query("session_windows", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    rows = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("latest_within_ttl", "SELECT DISTINCT user_id, coalesce((SELECT arg_max(event_type, event_id) FROM events b WHERE b.user_id = a.user_id AND b.ts > TIMESTAMP '2024-01-15' - INTERVAL 600 MINUTE AND b.ts <= TIMESTAMP '2024-01-15'), 'none') AS title FROM events a")
def latest_within_ttl(spark, d):
    fresh = F.expr("ts > TIMESTAMP_NTZ '2024-01-15 00:00:00' - INTERVAL '600' MINUTE AND ts <= TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    last = F.max_by(F.when(fresh, F.col("event_type")), F.when(fresh, F.col("event_id")))
    return events(spark, d).groupBy("user_id").agg(F.coalesce(last, F.lit("none")).alias("title"))


@query("gap_count", "WITH g AS (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, count(*) FILTER (gap > INTERVAL 7200 SECOND) AS gaps FROM g GROUP BY user_id")
def gap_count(spark, d):
    return timeline.gaps(events(spark, d), "user_id", ["ts", "event_id"], "ts", 7200)


@query("days_since", f"SELECT user_id, CAST(floor((epoch({REF}) - epoch(max(ts))) / 86400) AS BIGINT) AS days FROM events GROUP BY user_id")
def days_since(spark, d):
    ref = F.lit(1706745600)
    return events(spark, d).groupBy("user_id").agg(F.floor((ref - timeline.seconds(F.max("ts"))) / 86400).cast("long").alias("days"))


@query("dow_hour", "SELECT CAST(dayofweek(ts) AS BIGINT) AS day_of_week, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def dow_hour(spark, d):
    return events(spark, d).groupBy((F.dayofweek("ts") - 1).cast("long").alias("day_of_week"), F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("active_duration", "WITH l AS (SELECT user_id, event_type, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts) AS span FROM events) SELECT user_id, sum(span) AS total, coalesce(sum(span) FILTER (event_type = 'error'), 0) AS paused, sum(span) - coalesce(sum(span) FILTER (event_type = 'error'), 0) AS active FROM l GROUP BY user_id")
def active_duration(spark, d):
    """Time until the next event; what follows an error counts as a pause."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events(spark, d).select("user_id", "event_type", (timeline.seconds(nxt) - timeline.seconds(F.col("ts"))).alias("span"))
    paused = F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("span"))), F.lit(0.0))
    return rows.groupBy("user_id").agg(F.sum("span").alias("total"), paused.alias("paused"), (F.sum("span") - paused).alias("active"))


@query("eta_estimate", "SELECT o_custkey, round(CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN sum(o_totalprice) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus = 'F') * count(*) FILTER (o_orderstatus = 'O') END, 4) AS eta FROM orders GROUP BY o_custkey")
def eta_estimate(spark, d):
    done, left = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    spent = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.when(done > 0, spent / done * left), 4).alias("eta"))


@query("best_by_rank", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS n FROM part) WHERE n = 1")
def best_by_rank(spark, d):
    best = F.max(F.struct("p_size", "p_partkey")).alias("b")
    return read(spark, d, "part").groupBy("p_brand").agg(best).select("p_brand", "b.p_partkey", "b.p_size")


@query("gate_truth_table", "SELECT event_id, event_type = 'signup' OR (user_id % 5 <> 0 AND (user_id % 3 <> 0 OR value > 100) AND event_type <> 'view') AND user_id % 7 <> 0 AND event_type <> 'signup' AS shown FROM events")
def gate_truth_table(spark, d):
    """Consent and permission, not disturbed or critical, and the switch of the type; tests always show."""
    consent, quiet, critical, permitted = F.col("user_id") % 5 != 0, F.col("user_id") % 3 == 0, F.col("value") > 100, F.col("user_id") % 7 != 0
    wanted = F.col("event_type") != "view"
    return events(spark, d).select("event_id", F.when(F.col("event_type") == "signup", True).otherwise(consent & permitted & (~quiet | critical) & wanted).alias("shown"))


@query("classify_bands", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'bluetooth' WHEN event_type = 'view' THEN 'wired' WHEN value > 50 THEN 'bluetooth' WHEN value < 20 THEN 'wired' ELSE 'unknown' END AS kind, CASE WHEN value > 80 THEN 'high' WHEN value < 5 THEN 'underrun' ELSE 'ok' END AS buffer FROM events")
def classify_bands(spark, d):
    kind, v = F.col("event_type"), F.col("value")
    device = F.when(kind == "click", "bluetooth").when(kind == "view", "wired").when(v > 50, "bluetooth").when(v < 20, "wired").otherwise("unknown")
    return events(spark, d).select("event_id", device.alias("kind"), F.when(v > 80, "high").when(v < 5, "underrun").otherwise("ok").alias("buffer"))


@query("tier_table", "SELECT p_partkey, tier, CAST(CASE tier WHEN 'ultra' THEN 25000 WHEN 'high' THEN 20000 WHEN 'medium' THEN 15000 ELSE 10000 END AS BIGINT) AS chunk_ms FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size >= 16 AND p_partkey % 12 >= 8 THEN 'ultra' ELSE 'high' END WHEN 1 THEN CASE WHEN p_size >= 12 AND p_partkey % 12 >= 6 THEN 'high' ELSE 'medium' END ELSE CASE WHEN p_partkey % 12 >= 8 AND p_size >= 16 THEN 'medium' ELSE 'low' END END AS tier FROM part)")
def tier_table(spark, d):
    tier = timeline.hardware_tier(F.element_at(F.array(F.lit("cuda"), F.lit("vulkan"), F.lit("none")), (F.col("p_partkey") % 3 + 1).cast("int")), F.col("p_partkey") % 12, F.col("p_size"))
    return read(spark, d, "part").select("p_partkey", tier.alias("tier"), timeline.chunk_ms(tier).alias("chunk_ms"))


@query("pattern_whitelist", "SELECT p_partkey, (starts_with(lower(p_name), 'a') OR starts_with(lower(p_type), 's')) AND NOT contains(lower(p_type), 'brushed') AND NOT contains(lower(p_type), 'tin') AS chat FROM part")
def pattern_whitelist(spark, d):
    name, kind = F.lower("p_name"), F.lower("p_type")
    return read(spark, d, "part").select("p_partkey", ((name.startswith("a") | kind.startswith("s")) & ~kind.rlike("brushed|tin")).alias("chat"))


@query("rtf", f"WITH {SEGMENTS} SELECT meeting_id, round(sum(length(text)) / (sum(dur) * 1000), 6) AS rtf, round(sum(dur) / (sum(length(text)) / 1000.0), 6) AS realtime FROM seg GROUP BY meeting_id")
def rtf(spark, d):
    ms, dur = F.sum(F.length("text")), F.sum("dur")
    return segments(spark, d).groupBy("meeting_id").agg(F.round(ms / (dur * 1000), 6).alias("rtf"), F.round(dur / (ms / 1000.0), 6).alias("realtime"))


@query("worker_count", "SELECT p_partkey, CAST(greatest(least(least(CAST(floor(p_retailprice * 0.8 / 400) AS BIGINT), p_size % 9), 4), 1) AS BIGINT) AS workers FROM part")
def worker_count(spark, d):
    by_memory = F.floor(F.col("p_retailprice") * 0.8 / 400).cast("long")
    return read(spark, d, "part").select("p_partkey", F.greatest(F.least(by_memory, F.col("p_size") % 9, F.lit(4)), F.lit(1)).cast("long").alias("workers"))


@query("resource_flags", "SELECT event_id, value <= 80 AS memory_ok, value * 0.9 <= 85 AS cpu_ok, CASE WHEN user_id % 4 = 0 THEN true ELSE value <= 95 END AS temperature_ok, value <= 80 AND value * 0.9 <= 85 AND (user_id % 4 = 0 OR value <= 95) AS can_proceed FROM events")
def resource_flags(spark, d):
    v = F.col("value")
    temperature = F.when(F.col("user_id") % 4 != 0, v)
    flags = {"memory_ok": v <= 80, "cpu_ok": v * 0.9 <= 85, "temperature_ok": temperature.isNull() | (temperature <= 95)}
    return events(spark, d).select("event_id", *(c.alias(n) for n, c in flags.items()), (flags["memory_ok"] & flags["cpu_ok"] & flags["temperature_ok"]).alias("can_proceed"))


@query("progress_map", "SELECT event_id, CAST(20 + floor(least(value, 100) * 0.6) AS BIGINT) AS progress FROM events")
def progress_map(spark, d):
    return events(spark, d).select("event_id", (20 + F.floor(F.least(F.col("value"), F.lit(100.0)) * 0.6)).cast("long").alias("progress"))


@query("recoverable_errors", "SELECT event_id, event_type IN ('error', 'click') AS recoverable FROM events")
def recoverable_errors(spark, d):
    kind = F.when(F.col("event_type") == "error", "StreamFailed").when(F.col("event_type") == "click", "BufferOverflow").otherwise("PermissionDenied")
    return events(spark, d).select("event_id", devices.is_recoverable(kind).alias("recoverable"))


@query(
    "device_kinds",
    """WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'bluetooth' WHEN p_partkey % 4 = 1 THEN 'wired' WHEN p_size * 2 > 50 THEN 'bluetooth' WHEN p_size * 2 < 20 THEN 'wired' ELSE 'unknown' END AS kind FROM part)
SELECT p_partkey, kind, CAST(CASE kind WHEN 'wired' THEN 20 ELSE 80 END AS BIGINT) AS least, CAST(CASE kind WHEN 'wired' THEN 50 WHEN 'bluetooth' THEN 200 ELSE 180 END AS BIGINT) AS most FROM k""",
)
def device_kinds(spark, d):
    """Names of parts play devices: some wireless, some virtual, others told by a buffer of 2 ms for each unit of size."""
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" Wireless"))).when(F.col("p_partkey") % 4 == 1, F.lit("Loopback")).otherwise(F.lit("mic"))
    kind = devices.device_kind(name, F.col("p_size") * 96, F.lit(48_000))
    rows = read(spark, d, "part").select("p_partkey", kind.alias("kind"))
    return rows.withColumn("t", devices.buffer_timeout(F.col("kind"))).select("p_partkey", "kind", F.col("t.least").cast("long").alias("least"), F.col("t.most").cast("long").alias("most"))


@query("tumbling_metrics", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def tumbling_metrics(spark, d):
    rows = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "total")


@query("bench_segments", "SELECT o_orderkey, count(*) AS segments, sum(l_quantity) AS seconds, round(max(l_extendedprice), 4) AS top FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def bench_segments(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("segments"), F.sum("l_quantity").alias("seconds"), F.round(F.max("l_extendedprice"), 4).alias("top"))
    return read(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


