"""Sources, sinks, imports and input checks, each over a whole table; files go through the session's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import checks
from parley.functions.text import format_prompt, sanitize_name
from parley.operators.mutate import accepted_families
from parley.plans.registry import query
from parley.plans.texts import TRIM
from parley.sources import files
from parley.sources.tables import SEGMENTS, read, segments


@query("csv_round_trip", f"WITH {SEGMENTS} SELECT meeting_id, seq, {TRIM.format('text')} AS text FROM seg WHERE {TRIM.format('text')} <> ''")
def csv_round_trip(spark, d):
    path = files.scratch_path(spark, "segments-csv")
    rows = segments(spark, d).select("meeting_id", "seq", F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.transcript_csv(spark, path).select("meeting_id", F.col("seq").cast(rows.schema["seq"].dataType).alias("seq"), "text")


@query("json_round_trip", f"WITH {SEGMENTS} SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY seq) - 1 AS BIGINT) AS sequence_id, text, start_s AS started FROM seg")
def json_round_trip(spark, d):
    path = files.scratch_path(spark, "transcripts-json")
    files.write_transcript_json(segments(spark, d), path)
    rows = spark.read.schema(f"meeting_id string, {files.TRANSCRIPTS_JSON}").json(path)
    return rows.select("meeting_id", F.explode("segments").alias("s")).select("meeting_id", "s.sequence_id", "s.text", F.col("s.audio_start_time").alias("started"))


@query("transcript_files", rf"WITH {SEGMENTS} SELECT '/out/' || {TRIM.format("'Conversation: ' || conv_id").replace(': ', '_ ')} || '/transcript_2024-06-01_00-00-00.txt' AS path, string_agg(text, chr(10) ORDER BY seq) AS content FROM seg GROUP BY conv_id")
def transcript_files(spark, d):
    name = F.concat(F.lit("Conversation: "), "conv_id")
    return files.transcript_files(segments(spark, d).withColumn("name", name), "/out", "2024-06-01_00-00-00")


LISTING = """l AS (SELECT p_partkey, '/rec/' || p_partkey // 5 AS folder, ['zzz', 'audio', 'recording', 'notes', 'mix'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS stem,
 ['mp4', 'm4a', 'wav', 'mp3', 'flac', 'ogg', 'aac', 'mkv', 'webm', 'wma', 'txt', 'doc'][CAST(p_size % 12 + 1 AS INTEGER)] AS ext, CAST(p_size AS BIGINT) * 500000000 AS n FROM part)"""


def listing(spark, d):
    """Parts play the listing of a folder tree."""
    k = F.col("p_partkey")
    stem = F.element_at(F.array(*map(F.lit, ("zzz", "audio", "recording", "notes", "mix"))), (k % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, (*files.AUDIO_EXTENSIONS, "txt", "doc"))), (F.col("p_size") % 12 + 1).cast("int"))
    path = F.concat(F.lit("/rec/"), F.floor(k / 5), F.lit("/"), stem, F.lit("."), kind)
    return read(spark, d, "part").select(k, path.alias("path"), (F.col("p_size").cast("long") * 500_000_000).alias("length"))


@query(
    "audio_pick",
    f"""WITH {LISTING}, o AS (SELECT *, CASE stem WHEN 'audio' THEN 1 WHEN 'recording' THEN 2 ELSE 99 END AS a, list_position(['mp4', 'm4a', 'wav', 'mp3', 'flac', 'ogg', 'aac', 'mkv', 'webm', 'wma'], ext) AS b FROM l WHERE n <= 21474836480)
SELECT folder, stem || '.' || ext AS picked FROM o WHERE b IS NOT NULL AND b > 0 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY a, b, folder || '/' || stem || '.' || ext) = 1""",
)
def audio_pick(spark, d):
    found = files.first_audio_file(files.audio_candidates(listing(spark, d)))
    return found.select("folder", F.element_at(F.split("path", "/"), -1).alias("picked"))


@query(
    "audio_checks",
    f"""WITH {LISTING} SELECT p_partkey, CASE WHEN list_position(['mp4', 'm4a', 'wav', 'mp3', 'flac', 'ogg', 'aac', 'mkv', 'webm', 'wma'], ext) IS NULL OR ext IN ('txt', 'doc') THEN 'unsupported format' WHEN n > 21474836480 THEN 'file too large' END AS problem,
 round(CAST(n AS DOUBLE) / 2 / 48000, 6) AS seconds FROM l""",
)
def audio_checks(spark, d):
    """Whether a file can be imported, and its duration from its frames (two bytes each) and rate."""
    rows = listing(spark, d)
    return rows.select("p_partkey", files.audio_problem(F.col("path"), F.col("length")).alias("problem"), F.round(files.duration(F.col("length") / 2, 48_000), 6).alias("seconds"))


@query(
    "accumulate_audio",
    "WITH c AS (SELECT vec_id // 16 AS recording, vec_id, CASE WHEN (vec_id // 16) % 7 = 0 THEN [] ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS s FROM embeddings) SELECT recording, CAST(sum(len(s)) AS BIGINT) AS n, round(coalesce(sum(list_sum(s)), 0), 6) AS total, CASE WHEN sum(len(s)) = 0 THEN 'no audio data' END AS problem FROM c GROUP BY recording",
)
def accumulate_audio(spark, d):
    """Chunks of a recording put together when it ends; one without samples is an error."""
    recording = F.expr("vec_id div 16")
    chunk = F.when(recording % 7 == 0, F.array().cast("array<double>")).otherwise(F.transform("embedding", lambda v: v.cast("double")))
    done = files.accumulated(read(spark, d, "embeddings").select(recording.alias("recording"), F.col("vec_id").alias("no"), chunk.alias("samples")))
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return done.select("recording", F.size("samples").cast("long").alias("n"), F.round(total, 6).alias("total"), "problem")


@query("legacy_import", "SELECT CAST(o_orderkey AS VARCHAR) AS meeting_id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, true AS no_folder FROM orders")
def legacy_import(spark, d):
    """A table of an older schema: columns are cast, those missing are null, those unknown go."""
    schema = T.StructType().add("meeting_id", "string").add("title", "string").add("created_at", "timestamp_ntz").add("folder_path", "string")
    old = read(spark, d, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"), "o_custkey")
    rows = files.conform(old, schema)
    return rows.select("meeting_id", "title", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("folder_path").isNull().alias("no_folder"))


@query(
    "model_catalogs",
    """WITH b AS (SELECT DISTINCT p_brand FROM part), f AS (SELECT * FROM (VALUES ('small', 4000), ('large', 8000)) v(id, n))
SELECT p_brand AS provider, CAST(p_partkey AS VARCHAR) AS id, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 100 ELSE p_size END AS BIGINT) AS context_length FROM part WHERE NOT ends_with(p_brand, '3')
UNION ALL SELECT p_brand, f.id, f.n FROM b, f WHERE ends_with(p_brand, '3')""",
)
def model_catalogs(spark, d):
    """Catalogues landed as JSON; a provider whose catalogue is empty gets the fallback list."""
    top = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 100).alias("context_length"))
    path = files.scratch_path(spark, "catalogs-json")
    parts = read(spark, d, "part").withColumnRenamed("p_brand", "provider")
    listed = parts.where(~F.col("provider").endswith("3"))
    listed.select("provider", F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("context_length"), top.alias("top_provider")).write.json(path)
    return files.catalogs_with_fallback(spark, path, parts, [("small", 4000), ("large", 8000)])


@query(
    "insert_families",
    "WITH bad AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) SELECT 'orders' AS tab, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM bad) UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad) AND l_orderkey IN (SELECT o_orderkey FROM orders)",
)
def insert_families(spark, d):
    """A parent goes in with all of its children or not at all: one bad child keeps the family out."""
    parents = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    children = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") > 49).alias("bad"))
    p, c = accepted_families(parents, children, "k", F.col("bad"))
    return p.select(F.lit("orders").alias("tab"), "k").union(c.select(F.lit("lineitem").alias("tab"), "k"))


@query("provider_keys", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN p_name WHEN 4 THEN p_brand END AS api_key, CASE WHEN p_partkey % 7 = 6 THEN 'Invalid provider: other' END AS problem FROM part")
def provider_keys(spark, d):
    """The column that a provider's name stands for, from a fixed list; other names are an error, never part of a query."""
    names = ("openai", "ollama", "groq", "claude", "openrouter", "builtin-ai", "other")
    provider = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 7 + 1).cast("int"))
    columns = {"openai": "p_name", "ollama": "p_brand", "groq": "p_type", "claude": "p_name", "openrouter": "p_brand", "builtin-ai": None}
    key, problem = checks.by_name(provider, columns, "Invalid provider: ")
    return read(spark, d, "part").select("p_partkey", key.alias("api_key"), problem.alias("problem"))


@query("transcript_problems", rf"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'meeting_id cannot be empty' WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'transcript_text cannot be empty' WHEN doc_id % 10 = 1 THEN 'Invalid chunk_size or overlap values' WHEN length(text) > 5000 THEN 'Transcript text too large' END AS problem FROM documents")
def transcript_problems(spark, d):
    k = F.col("doc_id") % 10
    meeting = F.when(k == 0, "  ").otherwise("m")
    problem = checks.transcript_problem(meeting, F.col("text"), F.when(k == 1, 0).otherwise(5000), F.lit(1000), most=5000)
    return read(spark, d, "documents").select("doc_id", problem.alias("problem"))


@query(
    "chunk_settings",
    """WITH r AS (SELECT p_partkey, p_partkey % 2 = 0 AS local, p_size % 4 < 2 AS small, CAST(p_size AS BIGINT) * 100 - 200 AS size, CAST(p_size AS BIGINT) * 90 - 150 AS overlap FROM part)
SELECT p_partkey, CASE WHEN size <= 0 THEN 'chunk_size must be positive' WHEN overlap < 0 THEN 'overlap must be non-negative' END AS problem,
 CASE WHEN size > 0 AND overlap >= 0 THEN CASE WHEN local AND small THEN 10000 WHEN local THEN 30000 ELSE size END END AS size,
 CASE WHEN size > 0 AND overlap >= 0 THEN CASE WHEN local THEN 1000 ELSE least(overlap, size - 1) END END AS overlap FROM r""",
)
def chunk_settings(spark, d):
    """Chunk sizes as asked for, an overlap that is too large clamped; local models have their own."""
    n = F.col("p_size").cast("long")
    model = F.element_at(F.array(F.lit("phi4-mini"), F.lit("Llama3.2"), F.lit("gemma3"), F.lit("mistral")), (F.col("p_size") % 4 + 1).cast("int"))
    provider = F.when(F.col("p_partkey") % 2 == 0, "ollama").otherwise("groq")
    s = checks.chunk_settings(provider, model, n * 100 - 200, n * 90 - 150)
    return read(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.problem", "s.size", "s.overlap")


@query("prompt_template", "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE 'system: Write for ' || role || chr(10) || 'user: ' || text || chr(10) END AS prompt, CASE WHEN turn % 5 = 4 THEN 'Unknown template: other' END AS problem FROM conversations")
def prompt_template(spark, d):
    templates = {"plain": "system: {system_prompt}\nuser: {user_prompt}\n"}
    name = F.when(F.col("turn") % 5 == 4, "other").otherwise("plain")
    prompt, problem = format_prompt(name, templates, F.concat(F.lit("Write for "), "role"), F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", prompt.alias("prompt"), problem.alias("problem"))


@query("unsaved_meetings", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_updated FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') = 0 OR arg_max(event_type, event_id) <> 'purchase' ORDER BY last_updated DESC")
def unsaved_meetings(spark, d):
    """Meetings that weren't saved last, the latest first."""
    rows = read(spark, d, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_updated"), F.max_by("event_type", "event_id").alias("last"))
    return rows.where("last <> 'purchase'").orderBy(F.desc("last_updated"), "user_id").drop("last")
