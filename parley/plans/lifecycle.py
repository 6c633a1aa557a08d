"""Inserts, upserts, deletes and job queues as frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators.mutate import cascade_delete, finish_processes, insert_new, orphans, patched, replace_keys, reset_processes
from parley.operators.search import latest
from parley.plans.registry import query
from parley.sources.tables import MEETINGS, meetings, read

NOW = "2024-06-01T00:00:00Z"
#: Orders play summary processes: F failed, O pending, P completed; every third result has a backup.
PROCESSES = """p AS (SELECT 'meeting-' || o_orderkey AS meeting_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'PENDING' ELSE 'completed' END AS status,
  strftime(o_orderdate, '%Y-%m-%d') AS created_at, strftime(o_orderdate, '%Y-%m-%d') AS updated_at, CASE WHEN o_orderstatus = 'F' THEN 'line one' || chr(10) || o_orderpriority END AS error,
  CASE WHEN o_orderstatus <> 'O' THEN '{"markdown": "' || o_orderpriority || '"}' END AS result, CASE WHEN o_orderkey % 3 = 0 THEN 'backup ' || o_orderkey END AS result_backup, o_orderkey AS k FROM orders)"""


def processes(spark, d):
    o = read(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    none = F.lit(None).cast("string")
    return o.select(
        F.concat(F.lit("meeting-"), "o_orderkey").alias("meeting_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("completed").alias("status"),
        day.alias("created_at"),
        day.alias("updated_at"),
        none.alias("start_time"),
        none.alias("end_time"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("line one\n"), "o_orderpriority")).alias("error"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit('{"markdown": "'), "o_orderpriority", F.lit('"}'))).alias("result"),
        F.lit(0).cast("long").alias("chunk_count"),
        F.lit(0.0).alias("processing_time"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("backup "), "o_orderkey")).alias("result_backup"),
        none.alias("result_backup_timestamp"),
    )


@query(
    "summary_reset",
    f"""WITH {PROCESSES}, r AS (SELECT DISTINCT 'meeting-' || l_orderkey AS m FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 'meeting-new-' || n_nationkey FROM nation)
SELECT coalesce(meeting_id, m) AS meeting_id, CASE WHEN m IS NOT NULL THEN 'PENDING' ELSE status END AS status, coalesce(created_at, '{NOW}') AS created_at, CASE WHEN m IS NOT NULL THEN '{NOW}' ELSE updated_at END AS updated_at,
  CASE WHEN m IS NULL THEN error END AS error, result, CASE WHEN m IS NOT NULL AND meeting_id IS NOT NULL THEN result ELSE result_backup END AS result_backup,
  CASE WHEN m IS NOT NULL AND result IS NOT NULL THEN '{NOW}' END AS result_backup_timestamp FROM p FULL JOIN r ON m = meeting_id""",
)
def summary_reset(spark, d):
    asked = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("meeting-"), "l_orderkey").alias("meeting_id"))
    new = read(spark, d, "nation").select(F.concat(F.lit("meeting-new-"), "n_nationkey").alias("meeting_id"))
    done = reset_processes(processes(spark, d), asked.union(new), NOW)
    return done.select("meeting_id", "status", "created_at", "updated_at", "error", "result", "result_backup", "result_backup_timestamp")


@query(
    "summary_lifecycle",
    f"""WITH {PROCESSES}, e AS (SELECT *, CASE k % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' END AS event FROM p)
SELECT meeting_id, coalesce(event, status) AS status, CASE WHEN event = 'completed' THEN 'payload' || chr(10) || k WHEN event IN ('failed', 'cancelled') THEN coalesce(result_backup, result) ELSE result END AS result,
  CASE WHEN event = 'failed' THEN 'payload ' || k WHEN event IS NULL THEN error END AS error, CASE WHEN event IS NULL THEN result_backup END AS result_backup,
  CASE WHEN event = 'completed' THEN k % 7 ELSE 0 END AS chunk_count, CASE WHEN event = 'completed' THEN CAST(k % 7 AS DOUBLE) / 2 ELSE 0.0 END AS processing_time FROM e""",
)
def summary_lifecycle(spark, d):
    k = F.col("o_orderkey")
    events = read(spark, d, "orders").where(k % 4 != 3).select(
        F.concat(F.lit("meeting-"), k).alias("meeting_id"),
        F.when(k % 4 == 0, "completed").when(k % 4 == 1, "failed").otherwise("cancelled").alias("event"),
        F.concat(F.lit("payload\n"), k).alias("payload"),
        (k % 7).alias("chunks"),
        ((k % 7) / 2).alias("seconds"),
    )
    done = finish_processes(processes(spark, d), events, NOW)
    return done.select("meeting_id", "status", "result", "error", "result_backup", "chunk_count", "processing_time")


@query("latest_per_key", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, d):
    return latest(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("title_patch", f"WITH {MEETINGS} SELECT meeting_id, coalesce(n_name, title) AS title, n_name IS NOT NULL AS changed FROM m LEFT JOIN nation ON n_nationkey = conv_id")
def title_patch(spark, d):
    patch = read(spark, d, "nation").select(F.concat(F.lit("meeting-"), "n_nationkey").alias("meeting_id"), F.col("n_name").alias("new_title"))
    target = meetings(spark, d).select("meeting_id", "title", F.lit(False).alias("changed"))
    return patched(target, patch, "meeting_id", title=F.coalesce("p.new_title", "t.title"), changed=F.lit(True))


@query("guarded_update", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) THEN 'updated' ELSE o_orderstatus END AS status FROM orders")
def guarded_update(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    there = read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return patched(orders, there, "o_orderkey", status=F.lit("updated"))


@query("cascade_delete", "SELECT 'orders' AS tab, o_orderkey AS k FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cascade_delete_q(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    tables = {"orders": orders, "lineitem": read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))}
    left = cascade_delete(tables, "k", orders.where("o_orderpriority = '1-URGENT'").select("k"), "orders")
    return left["orders"].select(F.lit("orders").alias("tab"), "k").union(left["lineitem"].select(F.lit("lineitem").alias("tab"), "k"))


@query("insert_rejects", "SELECT c_custkey AS id, c_custkey IN (SELECT s_suppkey FROM supplier) OR 'Supplier#' || lpad(CAST(c_custkey % 200 AS VARCHAR), 9, '0') IN (SELECT s_name FROM supplier) AS rejected FROM customer")
def insert_rejects(spark, d):
    have = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    new = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 200).cast("string"), 9, "0")).alias("title"))
    _, rejected = insert_new(have, new, "id", "title")
    bad = rejected.select("id", F.lit(True).alias("r"))
    return new.join(bad, "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("rejected"))


@query("replace_partition", "SELECT conv_id, turn, text FROM conversations WHERE conv_id % 10 <> 3 UNION ALL SELECT conv_id, turn, substring(text, 1, 10) FROM conversations WHERE conv_id % 10 = 3 AND role = 'user'")
def replace_partition(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "text", "role")
    new = rows.where("conv_id % 10 = 3 AND role = 'user'").withColumn("text", F.substring("text", 1, 10))
    # a meeting whose new rows are none keeps its old ones, unless it is in the request
    asked = rows.where("conv_id % 10 = 3").select("conv_id")
    return replace_keys(rows.join(asked, "conv_id", "left_anti").select(*rows.columns), new, "conv_id").select("conv_id", "turn", "text")


@query("gc_orphan_rows", f"WITH {MEETINGS} SELECT meeting_id, folder_path FROM m WHERE folder_path IS NOT NULL AND conv_id % 4 = 0")
def gc_orphan_rows(spark, d):
    m = meetings(spark, d)
    rows, _ = orphans(m, m.where("conv_id % 4 <> 0").select("folder_path").distinct())
    return rows.select("meeting_id", "folder_path")


@query("gc_orphan_parents", f"WITH {MEETINGS}, f AS (SELECT DISTINCT '/rec/' || s_suppkey AS folder_path FROM supplier) SELECT folder_path FROM f WHERE folder_path NOT IN (SELECT folder_path FROM m WHERE folder_path IS NOT NULL)")
def gc_orphan_parents(spark, d):
    folders = read(spark, d, "supplier").select(F.concat(F.lit("/rec/"), "s_suppkey").alias("folder_path")).distinct()
    return orphans(meetings(spark, d), folders)[1]


@query("segment_upsert", "SELECT conv_id, role, turn, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def segment_upsert(spark, d):
    rows = read(spark, d, "conversations")
    best = rows.groupBy("conv_id", "role").agg(F.max_by(F.struct("turn", F.length("text").cast("long").alias("chars")), "turn").alias("r"))
    return best.select("conv_id", "role", "r.turn", "r.chars")


@query("queue_upsert", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS enqueued, arg_max(event_type, event_id) AS status, count(*) AS changes FROM events GROUP BY user_id")
def queue_upsert(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("enqueued"), F.max_by("event_type", "event_id").alias("status"), F.count(F.lit(1)).alias("changes"))


#: What an event does to a job (the events of a user are the history of a job).
REPLAY = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'done' ELSE 'failed' END"


@query("queue_replay", f"SELECT user_id AS job, arg_max({REPLAY}, event_id) AS status, count(*) FILTER (event_type = 'error') AS failures, arg_max({REPLAY}, event_id) IN ('pending', 'in_progress', 'paused') AS active FROM events GROUP BY user_id")
def queue_replay(spark, d):
    rows = read(spark, d, "events").withColumn("status", F.expr(REPLAY))
    jobs = rows.groupBy(F.col("user_id").alias("job")).agg(F.max_by("status", "event_id").alias("status"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return jobs.withColumn("active", F.col("status").isin("pending", "in_progress", "paused"))


@query("queue_next", f"SELECT n.worker, n.event_id FROM (SELECT user_id % 16 AS worker, event_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS k FROM events WHERE {REPLAY} = 'pending') n WHERE k = 1")
def queue_next(spark, d):
    pending = read(spark, d, "events").where(F.expr(REPLAY) == "pending")
    return pending.groupBy((F.col("user_id") % 16).alias("worker")).agg(F.min(F.struct("ts", "event_id")).alias("n")).select("worker", "n.event_id")


@query("queue_status", f"SELECT user_id % 8 AS worker, count(*) FILTER ({REPLAY} = 'pending') AS pending, count(*) FILTER ({REPLAY} = 'in_progress') AS running, count(*) FILTER ({REPLAY} = 'paused') AS paused, count(*) FILTER ({REPLAY} = 'done') AS done, bool_and({REPLAY} = 'paused') AS all_paused FROM events GROUP BY user_id % 8")
def queue_status(spark, d):
    s = F.col("status")
    rows = read(spark, d, "events").withColumn("status", F.expr(REPLAY)).groupBy((F.col("user_id") % 8).alias("worker"))
    count = lambda v, name: F.count_if(s == v).alias(name)
    return rows.agg(count("pending", "pending"), count("in_progress", "running"), count("paused", "paused"), count("done", "done"), F.bool_and(s == "paused").alias("all_paused"))


@query("stale_jobs", f"SELECT event_id, {REPLAY} AS status FROM events WHERE {REPLAY} = 'pending' OR ({REPLAY} = 'in_progress' AND TIMESTAMP '2024-01-15' - ts > INTERVAL 15 SECOND)")
def stale_jobs(spark, d):
    rows = read(spark, d, "events").withColumn("status", F.expr(REPLAY))
    old = F.expr("CAST('2024-01-15 00:00:00' AS TIMESTAMP_NTZ) - ts > INTERVAL '15' SECOND")
    return rows.where((F.col("status") == "pending") | ((F.col("status") == "in_progress") & old)).select("event_id", "status")


@query("settings_seed", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 3 THEN 'default' ELSE s_name END AS provider FROM supplier WHERE s_suppkey % 10 IN (3, 4) OR s_suppkey % 10 <> 3")
def settings_seed(spark, d):
    rows = read(spark, d, "supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("provider"))
    seed = read(spark, d, "supplier").where("s_suppkey % 10 IN (3, 4)").select(F.col("s_suppkey").alias("id"), F.lit("default").alias("provider"))
    return rows.union(seed.join(rows.select("id"), "id", "left_anti"))
