"""Changes to tables as functions from frames to frames; a sink then overwrites or merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROCESS = ("meeting_id", "status", "created_at", "updated_at", "start_time", "end_time", "error", "result", "chunk_count", "processing_time", "result_backup", "result_backup_timestamp")


def patched(target: DataFrame, patch: DataFrame, key: str, **changes: Column) -> DataFrame:
    """`target` with `changes` where `patch` has the key; the columns of `patch` are reached as p.<name>."""
    marked = target.alias("t").join(patch.alias("p"), F.col(f"t.{key}") == F.col(f"p.{key}"), "left")
    hit = F.col(f"p.{key}").isNotNull()
    return marked.select(*(F.when(hit, changes[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in changes else F.col(f"t.{c}") for c in target.columns))


def reset_processes(processes: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """Upsert of requested processes: new ones are PENDING; known ones keep their result, with a copy as backup, and lose their error."""
    old, new = processes.alias("o"), requests.select(F.col("meeting_id").alias("m")).distinct().alias("r")
    both = old.join(new, F.col("o.meeting_id") == F.col("r.m"), "full")
    asked, known = F.col("r.m").isNotNull(), F.col("o.meeting_id").isNotNull()
    now = F.lit(as_of)
    value = {
        "meeting_id": F.coalesce("o.meeting_id", "r.m"),
        "status": F.when(asked, "PENDING").otherwise(F.col("o.status")),
        "created_at": F.coalesce("o.created_at", now),
        "updated_at": F.when(asked, now).otherwise(F.col("o.updated_at")),
        "start_time": F.when(asked, now).otherwise(F.col("o.start_time")),
        "error": F.when(~asked, F.col("o.error")),
        "result_backup": F.when(asked & known, F.col("o.result")).otherwise(F.col("o.result_backup")),
        "result_backup_timestamp": F.when(asked & known & F.col("o.result").isNotNull(), now).otherwise(F.col("o.result_backup_timestamp")),
    }
    return both.select(*(value.get(c, F.col(f"o.{c}")).alias(c) for c in PROCESS if c in processes.columns))


def finish_processes(processes: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Apply one event (meeting_id, event, payload, chunks, seconds) to each process.

    completed: the payload becomes the result, the backup goes. failed and cancelled: the backup, if
    there is one, becomes the result again and goes; failed keeps the payload as error.
    """
    event, back = F.col("p.event"), event_in("failed", "cancelled")
    return patched(
        processes,
        events,
        "meeting_id",
        status=event,
        updated_at=F.lit(as_of),
        end_time=F.lit(as_of),
        result=F.when(event == "completed", F.col("p.payload")).when(back, F.coalesce("t.result_backup", "t.result")).otherwise(F.col("t.result")),
        error=F.when(event == "failed", error_text("p.payload")),
        chunk_count=F.when(event == "completed", F.col("p.chunks")).otherwise(F.col("t.chunk_count")),
        processing_time=F.when(event == "completed", F.col("p.seconds")).otherwise(F.col("t.processing_time")),
        result_backup=F.lit(None).cast("string"),
    )


def event_in(*names: str) -> Column:
    return F.col("p.event").isin(*names)


def error_text(c: str) -> Column:
    """Without line breaks, a thousand characters at most."""
    return F.substring(F.translate(F.col(c), "\r\n", "  "), 1, 1000)


def cascade_delete(tables: dict[str, DataFrame], key: str, gone: DataFrame, parent: str) -> dict[str, DataFrame]:
    """Each table without the rows of keys in `gone` that the parent table has; children are to be written first.

    The keys that go grow with the parent table, so all joins are by sorting: no task holds a hash table of them.
    """
    there = gone.join(tables[parent].select(key).hint("merge"), key, "left_semi").select(key).distinct()
    return {name: rows.join(there.hint("merge"), key, "left_anti") for name, rows in tables.items()}


def insert_new(target: DataFrame, rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(target with the new rows, rows rejected because one of `keys` exists)."""
    fresh = rows
    for k in keys:
        fresh = fresh.join(target.select(k), k, "left_anti")
    return target.unionByName(fresh.select(*target.columns)), rows.join(fresh.select(keys[0]), keys[0], "left_anti")


def accepted_families(parents: DataFrame, children: DataFrame, key: str, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(parents, children) that go in: a family with one bad child stays out whole, and so do children without a parent."""
    out = children.where(F.coalesce(bad, F.lit(True))).select(key).distinct()
    good = parents.join(out, key, "left_anti")
    return good, children.join(good.select(key), key, "left_semi")


def replay_commands(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """`jobs` (job, meeting, queue, at) that are left, with their status, after `commands` (command, meeting, queue, at).

    cancel removes all jobs of a meeting that came before it. Of pause_all and resume_all the last one
    after a job came says whether it is paused.
    """
    gone = commands.where("command = 'cancel'").groupBy("meeting").agg(F.max("at").alias("cancelled"))
    turn = commands.where("command IN ('pause_all', 'resume_all')").groupBy("queue").agg(F.max_by("command", "at").alias("last"), F.max("at").alias("turned"))
    rows = jobs.join(gone, "meeting", "left").where("cancelled IS NULL OR cancelled < at").join(turn, "queue", "left")
    paused = F.coalesce((F.col("last") == "pause_all") & (F.col("turned") > F.col("at")), F.lit(False))
    return rows.withColumn("status", F.when(paused, "paused").otherwise("pending")).drop("cancelled", "last", "turned")


def replace_keys(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in `rows` replaced by those."""
    return target.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*target.columns))


def orphans(rows: DataFrame, folders: DataFrame, column: str = "folder_path") -> tuple[DataFrame, DataFrame]:
    """(rows whose folder isn't there, folders that no row names); reported, never deleted."""
    named = rows.where(F.col(column).isNotNull())
    return named.join(folders, column, "left_anti"), folders.join(named.select(column), column, "left_anti")
