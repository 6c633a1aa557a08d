"""Sources and sinks beyond Parquet: transcript CSV and JSON, audio files, templates, key-value exports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import sanitize_name

#: Audio file name endings that are taken, and names that are preferred in this order (fixed values).
AUDIO_EXTENSIONS = ("mp4", "m4a", "wav", "mp3", "flac", "ogg", "aac", "mkv", "webm", "wma")
PREFERRED = ("audio", "recording")
MAX_BYTES = 20 * 1024**3

TRANSCRIPTS_JSON = (
    "version string, total_segments long, "
    "segments array<struct<id: string, text: string, audio_start_time: double, audio_end_time: double, duration: double, display_time: string, sequence_id: long>>"
)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (`spark.checkpoint.dir`).

    On one machine a temporary folder does where the session names none; on a cluster that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="parley-")
    return f"{shared.rstrip('/')}/parley/{name}-{uuid.uuid4().hex}"


def transcript_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a transcript CSV: needs a header with `text`; trims and drops blank rows; an empty result is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "text" not in rows.columns:
        raise ValueError("the CSV needs a column 'text'")
    rows = rows.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where(F.length("text") > 0)
    if rows.isEmpty():
        raise ValueError("the CSV has no transcript segments")
    return rows


def transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """Transcript files (one JSON document each): file, text of all segments joined by a space."""
    rows = spark.read.schema(TRANSCRIPTS_JSON).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    checked = F.when(F.col("segments").isNull(), F.raise_error(F.lit("segments array is missing"))).otherwise(F.col("segments"))
    return rows.select("file", F.array_join(F.transform(checked, lambda s: s["text"]), " ").alias("text"))


def write_transcript_json(segments: DataFrame, path: str) -> None:
    """One JSON line for each meeting, segments in order with sequence ids from 0; the commit protocol makes it atomic."""
    body = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text", "start_s", "end_s", "dur"))), lambda s, i: F.struct(s["text"].alias("text"), s["start_s"].alias("audio_start_time"), s["end_s"].alias("audio_end_time"), s["dur"].alias("duration"), i.alias("sequence_id")))
    segments.groupBy("meeting_id").agg(F.lit("1.0").alias("version"), F.count(F.lit(1)).alias("total_segments"), body.alias("segments")).write.mode("overwrite").json(path)


def merged_metadata(old: DataFrame, status: str, when: str, engine: str) -> DataFrame:
    """(meeting_id, metadata JSON) with three keys set and the others kept; a missing or broken document starts anew."""
    kept = F.coalesce(F.from_json("metadata", T.MapType(T.StringType(), T.StringType())), F.create_map().cast("map<string,string>"))
    fresh = F.create_map(F.lit("status"), F.lit(status), F.lit("retranscribed_at"), F.lit(when), F.lit("engine"), F.lit(engine))
    rest = F.map_filter(kept, lambda k, _: ~k.isin("status", "retranscribed_at", "engine"))
    return old.withColumn("metadata", F.to_json(F.map_concat(rest, fresh)))


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of audio files below `folder`; the content column isn't read until it is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return audio_candidates(files)


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    return F.element_at(F.split(file_name(path), r"\."), -1)


def audio_candidates(listing: DataFrame) -> DataFrame:
    """Files of a listing (path, length) that can be audio, with extension and stem."""
    named = listing.withColumns({"extension": extension(F.col("path")), "stem": F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "")})
    return named.where(audio_problem(F.col("path"), F.col("length")).isNull())


def audio_problem(path: Column, length: Column) -> Column:
    """Why a file can't be imported, null if it can."""
    return F.when(path.isNull() | length.isNull(), "file not found").when(~extension(path).isin(*AUDIO_EXTENSIONS), "unsupported format").when(length > MAX_BYTES, "file too large")


def duration(frames: Column, rate: int) -> Column:
    """Seconds of so many frames."""
    return frames / F.lit(float(rate))


def accumulated(chunks: DataFrame) -> DataFrame:
    """(recording, samples, problem) of chunks (recording, no, samples), put together in the order of no."""
    rows = chunks.groupBy("recording").agg(F.sort_array(F.collect_list(F.struct("no", "samples"))).alias("c"))
    samples = F.flatten(F.transform("c", lambda x: x["samples"]))
    return rows.select("recording", samples.alias("samples"), F.when(F.size(samples) == 0, "no audio data").alias("problem"))


def transcript_files(segments: DataFrame, folder: str, stamp: str) -> DataFrame:
    """(path, content) of one text file for each meeting (name, seq, text), in a folder of its name."""
    lines = segments.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("l"))
    path = F.concat(F.lit(folder + "/"), sanitize_name("name"), F.lit(f"/transcript_{stamp}.txt"))
    return lines.select(path.alias("path"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"))


def first_audio_file(files: DataFrame) -> DataFrame:
    """One file for each folder: preferred names first, then extensions in their order, then the path."""
    stem = F.coalesce(F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("stem")), F.lit(0))
    rank = F.struct(F.when(stem == 0, 99).otherwise(stem), F.array_position(F.array(*map(F.lit, AUDIO_EXTENSIONS)), F.col("extension")), "path")
    rows = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    best = Window.partitionBy("folder").orderBy(rank)
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema`: those missing are added as typed nulls, others are cast."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """Model catalogues as landed JSON: id, name, context length (the provider's own value first)."""
    schema = "data array<struct<id:string,name:string,context_length:long,top_provider:struct<context_length:long>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data").alias("m"))
    return rows.select("m.id", "m.name", F.coalesce("m.top_provider.context_length", "m.context_length").alias("context_length"))


def catalogs_with_fallback(spark: SparkSession, path: str, providers: DataFrame, fallback: list[tuple[str, int]]) -> DataFrame:
    """(provider, id, context_length) of catalogues landed as a JSON line for each model; `providers` without one get the fallback list."""
    rows = spark.read.schema("provider string, id string, name string, context_length long, top_provider struct<context_length: long>").json(path)
    own = rows.where("id IS NOT NULL").select("provider", "id", F.coalesce("top_provider.context_length", "context_length").alias("context_length"))
    other = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).cast("long").alias("context_length")) for i, n in fallback))
    empty = providers.select("provider").distinct().join(own.select("provider").distinct(), "provider", "left_anti")
    return own.unionByName(empty.select("provider", F.explode(other).alias("m")).select("provider", "m.id", "m.context_length"))
