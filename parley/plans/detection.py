"""Meeting detection inputs, job commands, jitter and sentence updates, over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import devices
from parley.functions.text import trimmed
from parley.operators import timeline
from parley.operators.mutate import replay_commands
from parley.plans.registry import query
from parley.plans.texts import TITLES, TRIM, page_titles
from parley.sources.tables import SEGMENTS, read, segments


def events(spark, d):
    return read(spark, d, "events")


@query(
    "observations",
    """WITH e AS (SELECT user_id, event_id, ts, epoch(ts) AS moment, event_type <> 'error' AS titled, event_type = 'purchase' AS relay, event_type IN ('click', 'signup') AS broad FROM events),
i AS (SELECT *, count(*) FILTER (NOT titled) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
l AS (SELECT *, bool_or(relay AND titled) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latch FROM i),
c AS (SELECT *, titled AND (relay OR (NOT latch AND broad)) AS connected FROM l),
r AS (SELECT *, count(*) FILTER (NOT connected) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, event_id, connected, CASE WHEN connected AND run = 0 THEN 0.0 WHEN connected THEN min(moment) FILTER (connected) OVER (PARTITION BY user_id, run) END AS first_seen FROM r""",
)
def observations(spark, d):
    """Polls of a detector: views, clicks, signups and purchases have a window; purchases a relay connection, clicks and signups a plain one."""
    kind = F.col("event_type")
    polls = events(spark, d).select("user_id", "event_id", "ts", timeline.seconds(F.col("ts")).alias("at"), (kind != "error").alias("titled"), (kind == "purchase").alias("relay"), kind.isin("click", "signup").alias("broad"))
    return timeline.observations(polls, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "connected", "first_seen")


@query(
    "focus_history",
    "WITH f AS (SELECT user_id, event_id, epoch(ts) AS moment, list(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING) AS ring FROM events WHERE event_type IN ('view', 'click')) SELECT user_id, event_id, len(list_filter(ring, lambda x: x >= moment - 21600)) AS kept, list_min(list_filter(ring, lambda x: x >= moment - 21600)) AS oldest FROM f",
)
def focus_history(spark, d):
    """Ring of the last ten focused windows, of which those of the last six hours are left."""
    focused = events(spark, d).where(F.col("event_type").isin("view", "click")).withColumn("at", timeline.seconds(F.col("ts")))
    ring = F.collect_list("at").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0))
    rows = focused.withColumn("ring", ring).withColumn("fresh", F.filter("ring", lambda x: x >= F.col("at") - 21600))
    return rows.select("user_id", "event_id", F.size("fresh").cast("long").alias("kept"), F.array_min("fresh").alias("oldest"))


@query("meeting_windows", f"SELECT page_id, regexp_matches(t, '^Meet - .+|^Meet – .+|^Google Meet - Meet — .+|.+ - Google Meet$') AND page_id % 4 <> 3 AS shown FROM {TITLES}")
def meeting_windows(spark, d):
    """Meeting titles count only in windows of browsers."""
    process = F.element_at(F.array(*map(F.lit, (*devices.BROWSERS, "notepad.exe"))), (F.col("page_id") % 4 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", devices.is_meeting_window(page_titles(), process).alias("shown"))


@query(
    "relay_addresses",
    """WITH a AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 6 ELSE 4 END AS family, CASE WHEN event_id % 10 = 0 THEN 2741000000000000000 + event_id % 64 ELSE 3232235520 + event_id * 37 % 4096 END AS ip FROM events),
b AS (SELECT 4 AS family, 3232235520 + n_nationkey * 150 AS low, 3232235520 + n_nationkey * 150 + 63 AS high, n_nationkey % 3 = 0 AS relay FROM nation UNION ALL SELECT 6, 2741000000000000000 + n_nationkey * 2, 2741000000000000000 + n_nationkey * 2, true FROM nation)
SELECT event_id, b.low IS NOT NULL AS media, coalesce(b.relay AND a.family = 4, false) AS relay FROM a LEFT JOIN b ON b.family = a.family AND a.ip BETWEEN b.low AND b.high""",
)
def relay_addresses(spark, d):
    """Whether an address is in a media block, and in one of the relays' blocks, which are all of version 4."""
    n, k = F.col("n_nationkey"), F.col("event_id")
    four = read(spark, d, "nation").select(F.lit(4).alias("family"), (F.lit(3232235520) + n * 150).alias("low"), (F.lit(3232235520) + n * 150 + 63).alias("high"), (n % 3 == 0).alias("relay"))
    six = read(spark, d, "nation").select(F.lit(6).alias("family"), (F.lit(2741000000000000000) + n * 2).alias("low"), (F.lit(2741000000000000000) + n * 2).alias("high"), F.lit(True).alias("relay"))
    is_six = k % 10 == 0
    rows = events(spark, d).select(k, F.when(is_six, 6).otherwise(4).alias("family"), F.when(is_six, F.lit(2741000000000000000) + k % 64).otherwise(F.lit(3232235520) + k * 37 % 4096).alias("ip"))
    found = timeline.in_ranges(rows, four.union(six), "family", "ip", 64)
    return found.select("event_id", F.col("low").isNotNull().alias("media"), F.coalesce(F.col("relay") & (F.col("family") == 4), F.lit(False)).alias("relay"))


@query(
    "queue_commands",
    """WITH j AS (SELECT event_id AS job, user_id, ts FROM events WHERE event_type = 'signup'),
c AS (SELECT user_id % 16 AS q, event_type, ts, event_id FROM events WHERE event_type IN ('click', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts DESC, event_id DESC) = 1)
SELECT job, CASE WHEN c.event_type = 'click' AND (c.ts > j.ts OR (c.ts = j.ts AND c.event_id > j.job)) THEN 'paused' ELSE 'pending' END AS status FROM j LEFT JOIN c ON c.q = j.user_id % 16
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = j.user_id AND e.event_type = 'error' AND (e.ts > j.ts OR (e.ts = j.ts AND e.event_id > j.job)))""",
)
def queue_commands(spark, d):
    """Signups enqueue a job of their user, clicks pause all of a queue, purchases resume all, errors cancel every job of their user."""
    e = events(spark, d).withColumns({"queue": F.col("user_id") % 16, "at": F.struct("ts", "event_id")})
    jobs = e.where("event_type = 'signup'").select(F.col("event_id").alias("job"), F.col("user_id").alias("meeting"), "queue", "at")
    command = F.when(F.col("event_type") == "click", "pause_all").when(F.col("event_type") == "purchase", "resume_all").when(F.col("event_type") == "error", "cancel")
    commands = e.select(command.alias("command"), F.col("user_id").alias("meeting"), "queue", "at").where("command IS NOT NULL")
    return replay_commands(jobs, commands).select("job", "status")


@query(
    "jitter_release",
    """WITH e AS (SELECT user_id, event_id, user_id % 3 AS kind, epoch_us(ts) AS moment FROM events), r AS (SELECT *, min(moment) OVER (PARTITION BY user_id ORDER BY moment RANGE BETWEEN 2000000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS soon, min(moment) OVER (PARTITION BY user_id ORDER BY moment RANGE BETWEEN 8000000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS late FROM e)
SELECT event_id, CASE WHEN kind = 0 THEN soon ELSE late END AS released FROM r""",
)
def jitter_release(spark, d):
    """A chunk leaves its buffer at the first poll at which it is as old as the buffer of its device's kind holds it (times are stretched to the events')."""
    stretch = 100_000_000  # a millisecond of a buffer plays a hundred seconds of events
    kind = F.when(F.col("user_id") % 3 == 0, "wired").when(F.col("user_id") % 3 == 1, "bluetooth").otherwise("unknown")
    chunks = events(spark, d).select("event_id", "user_id", kind.alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    waits = {k: least * stretch for k, (least, _) in devices.TIMEOUTS.items()}
    return timeline.released(chunks, "user_id", "at", "kind", waits).select("event_id", "released")


@query("suppress_repeats", "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER w AS t, lag(floor(value / 50)) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE t IS DISTINCT FROM event_type OR v IS DISTINCT FROM floor(value / 50)")
def suppress_repeats(spark, d):
    """Rows whose content is that of the row before them are dropped."""
    rows = events(spark, d).withColumn("band", F.floor(F.col("value") / 50))
    return timeline.without_repeats(rows, "user_id", ["ts", "event_id"], ["event_type", "band"]).select("user_id", "event_id")


@query(
    "sentence_updates",
    rf"""WITH {SEGMENTS}, c AS (SELECT conv_id, meeting_id, seq, start_s, end_s, {TRIM.format("replace(replace(CASE WHEN seq % 3 = 0 THEN '[BLANK_AUDIO] ' || text ELSE text || ' [AUDIO OUT]' END, '[BLANK_AUDIO]', ''), '[AUDIO OUT]', '')")} AS t FROM seg),
k AS (SELECT *, regexp_matches(t, '[.?!]$|\.["'']$') AS ends FROM c WHERE t <> '' AND end_s - start_s >= 1.0),
s AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - CASE WHEN ends THEN 1 ELSE 0 END AS sentence FROM k)
SELECT meeting_id, CAST(sentence AS BIGINT) AS sentence, string_agg(t, ' ' ORDER BY seq) AS body, min(start_s) AS started FROM s GROUP BY meeting_id, sentence HAVING bool_or(ends)""",
)
def sentence_updates(spark, d):
    """Segments without blank-audio marks, at least a second long and no repeats, put together until a sentence ends."""
    marked = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("[BLANK_AUDIO] "), "text")).otherwise(F.concat("text", F.lit(" [AUDIO OUT]")))
    clean = marked
    for mark in ("[BLANK_AUDIO]", "[AUDIO OUT]"):
        clean = F.replace(clean, F.lit(mark), F.lit(""))
    rows = segments(spark, d).withColumn("clean", trimmed(clean)).where((F.col("clean") != "") & (F.col("end_s") - F.col("start_s") >= 1.0))
    rows = timeline.without_repeats(rows, "meeting_id", ["seq"], ["text", "start_s", "end_s"])
    ends = F.col("clean").rlike(r"[.?!]$|\.[\"']$")
    before = F.count_if(ends).over(Window.partitionBy("meeting_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"ends": ends, "sentence": F.coalesce(before, F.lit(0))})
    parts = F.sort_array(F.collect_list(F.struct("seq", "clean")))
    done = rows.groupBy("meeting_id", "sentence").agg(parts.alias("p"), F.min("start_s").alias("started"), F.bool_or("ends").alias("ends"))
    return done.where("ends").select("meeting_id", "sentence", F.array_join(F.transform("p", lambda x: x["clean"]), " ").alias("body"), "started")


@query("stage_progress", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'decoding' WHEN 'view' THEN 'vad' WHEN 'click' THEN 'transcribing' ELSE 'saving' END AS stage, CAST(CASE event_type WHEN 'signup' THEN floor(least(value, 100) * 0.2) WHEN 'view' THEN 20 + floor(least(value, 100) * 0.1) WHEN 'click' THEN 30 + floor(least(value, 100) * 0.65) ELSE 95 + floor(least(value, 100) * 0.05) END AS BIGINT) AS progress FROM events")
def stage_progress(spark, d):
    """Progress of a stage, from 0 to 100, as progress of the whole: each stage has its share."""
    stage = F.when(F.col("event_type") == "signup", "decoding").when(F.col("event_type") == "view", "vad").when(F.col("event_type") == "click", "transcribing").otherwise("saving")
    shares = {"decoding": (0, 20), "vad": (20, 30), "transcribing": (30, 95), "saving": (95, 100)}
    return events(spark, d).select("event_id", stage.alias("stage"), timeline.overall_progress(stage, F.col("value"), shares).alias("progress"))


@query("local_times", "SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') AS local_time FROM events")
def local_times(spark, d):
    shifted = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "+02:00")
    return events(spark, d).select("event_id", F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss").alias("local_time"))
