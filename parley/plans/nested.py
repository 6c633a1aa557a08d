"""JSON and nested columns: summaries, sections, blocks, templates, property maps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import summaries as s
from parley.functions.text import section_key
from parley.plans.registry import query
from parley.sources.tables import read


@query("json_unwrap", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderpriority END AS name, CASE WHEN o_orderkey % 4 < 2 THEN 'p' || o_orderkey % 10 END AS first_block FROM orders""")
def json_unwrap(spark, d):
    """Results encoded once, twice, as a list, and broken."""
    k, name = F.col("o_orderkey"), F.col("o_orderpriority")
    block = F.array(F.struct(F.concat(F.lit("p"), k % 10).alias("id")))
    body = F.to_json(F.struct(name.alias("MeetingName"), F.struct(F.lit("People").alias("title"), block.alias("blocks")).alias("People")))
    twice = F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('\\"')), F.lit('"'))
    raw = F.when(k % 4 == 0, body).when(k % 4 == 1, twice).when(k % 4 == 2, F.lit("[1, 2]")).otherwise(F.lit("{broken"))
    v = s.unwrapped(F.col("raw"), s.SUMMARY)
    return read(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", v.alias("v")).select("o_orderkey", F.col("v.MeetingName").alias("name"), F.get(F.col("v.People.blocks"), F.lit(0))["id"].alias("first_block"))


@query("section_keys", "WITH t AS (SELECT conv_id, turn, role || ' & Notes' AS title, replace(replace(lower(role || ' & Notes'), ' & ', '_'), ' ', '_') AS k FROM conversations) SELECT conv_id, CAST(pos AS BIGINT) AS pos, CASE WHEN n > 1 THEN k || '_' || pos ELSE k END AS key FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS n FROM t)")
def section_keys(spark, d):
    title = F.concat("role", F.lit(" & Notes")).alias("title")
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", title))).alias("l"))
    keys = s.section_keys(F.transform("l", lambda x: x["title"]))
    return rows.select("conv_id", F.posexplode(keys).alias("pos", "key")).withColumn("pos", F.col("pos").cast("long"))


@query("summary_merge", "SELECT conv_id, role AS section, string_agg(length(text)::VARCHAR, ',' ORDER BY turn) AS blocks, arg_max(CASE WHEN turn % 3 <> 0 THEN 'name ' || turn END, CASE WHEN turn % 3 <> 0 THEN turn END) AS last_name FROM conversations GROUP BY conv_id, role")
def summary_merge(spark, d):
    """Chunk results in order: blocks of equal sections are appended, the last name that isn't empty wins."""
    rows = read(spark, d, "conversations").withColumn("name", F.when(F.col("turn") % 3 != 0, F.concat(F.lit("name "), "turn")))
    block = F.struct("turn", F.length("text").cast("string").alias("c"))
    merged = rows.groupBy("conv_id", F.col("role").alias("section")).agg(F.sort_array(F.collect_list(block)).alias("l"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("turn"))).alias("last_name"))
    return merged.select("conv_id", "section", F.array_join(F.transform("l", lambda x: x["c"]), ",").alias("blocks"), "last_name")


@query("summary_shape", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'processing' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'key_items_' || l || ';next_steps' END AS section_order FROM (SELECT *, lower(replace(o_orderpriority, ' ', '_')) AS l FROM orders)")
def summary_shape(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "Pending").otherwise("completed")
    titles = F.array(F.concat(F.lit("Key Items & "), "o_orderpriority"), F.lit("Next Steps"))
    order = F.array_join(F.transform(titles, lambda x: section_key(x)), ";")
    return read(spark, d, "orders").select("o_orderkey", s.shown_status(status).alias("status"), F.when(status == "completed", order).alias("section_order"))


@query("summary_status", "SELECT c_custkey, coalesce(min(o_orderstatus), 'idle') AS status, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def summary_status(spark, d):
    done = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("status"), F.count("o_orderkey").alias("n"))
    rows = read(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("status", F.lit("idle")).alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


KINDS = "CASE turn % 4 WHEN 0 THEN 'heading1' WHEN 1 THEN 'bullet' WHEN 2 THEN 'text' ELSE 'heading2' END"


def block_rows(spark, d):
    k = F.col("turn") % 4
    kind = F.when(k == 0, "heading1").when(k == 1, "bullet").when(k == 2, "text").otherwise("heading2")
    block = F.struct("turn", F.concat(F.lit("b"), "turn").alias("id"), kind.alias("type"), F.col("text").alias("content"), F.lit("").alias("color"))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))


@query("blocks_to_markdown", f"""SELECT conv_id, '## Part ' || conv_id || chr(10) || chr(10) || string_agg(CASE {KINDS} WHEN 'heading1' THEN '### ' || c || chr(10) || chr(10) WHEN 'heading2' THEN '#### ' || c || chr(10) || chr(10) WHEN 'bullet' THEN '- ' || c || chr(10) ELSE c || chr(10) || chr(10) END, '' ORDER BY turn)
 || CASE WHEN bool_or({KINDS} = 'bullet') THEN chr(10) ELSE '' END AS markdown FROM (SELECT *, text AS c FROM conversations) GROUP BY conv_id""")
def blocks_to_markdown(spark, d):
    return block_rows(spark, d).select("conv_id", s.to_markdown(F.concat(F.lit("Part "), "conv_id"), F.col("blocks")).alias("markdown"))


@query("blocks_defaults", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, CASE WHEN turn % 2 = 0 THEN 'block-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) ELSE 'b' || turn END AS id, CASE WHEN role = 'user' THEN 'paragraph' ELSE role END AS type, trim(text) AS content, 'default' AS color FROM conversations")
def blocks_defaults(spark, d):
    block = F.struct("turn", F.when(F.col("turn") % 2 != 0, F.concat(F.lit("b"), "turn")).alias("id"), F.when(F.col("role") != "user", F.col("role")).otherwise("").alias("type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("color"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    return rows.select("conv_id", F.posexplode(s.with_defaults(F.col("blocks"))).alias("pos", "b")).select("conv_id", F.col("pos").cast("long").alias("pos"), "b.id", "b.type", "b.content", "b.color")


@query("block_range", "WITH l AS (SELECT conv_id, list('b' || turn ORDER BY turn) AS ids FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, ids, list_position(ids, 'b3') AS a, list_position(ids, 'b1') AS b FROM l) SELECT conv_id, CASE WHEN a > 0 AND b > 0 THEN array_to_string(ids[least(a, b):greatest(a, b)], ',') ELSE '' END AS picked FROM p")
def block_range(spark, d):
    ids = F.transform("blocks", lambda b: b["id"])
    return block_rows(spark, d).select("conv_id", F.array_join(s.block_range(ids, F.lit("b3"), F.lit("b1")), ",").alias("picked"))


def templates(spark, d):
    """A template for every ten suppliers, with a section for each of them."""
    item = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("| "), "s_name", F.lit(" |")))
    section = F.struct("s_suppkey", F.col("s_name").alias("title"), F.concat(F.lit("List "), "s_name").alias("instruction"), F.when(F.col("s_suppkey") % 7 == 6, "table").otherwise("list").alias("format"), item.alias("item_format"))
    return read(spark, d, "supplier").groupBy(F.expr("s_suppkey div 10").alias("template")).agg(F.sort_array(F.collect_list(section)).alias("sections"))


@query("template_render", "SELECT s_suppkey // 10 AS template, '# <Add Title here>' || chr(10) || chr(10) || string_agg('**' || s_name || '**' || chr(10) || chr(10), '' ORDER BY s_suppkey) AS skeleton, string_agg('- **For the ''' || s_name || ''' section:** List ' || s_name || '.' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '  - Items in this section should follow the format: `| ' || s_name || ' |`.' || chr(10) ELSE '' END, '' ORDER BY s_suppkey) AS instructions FROM supplier GROUP BY s_suppkey // 10")
def template_render(spark, d):
    skeleton, instructions = s.template_text(F.col("sections"))
    return templates(spark, d).select("template", skeleton.alias("skeleton"), instructions.alias("instructions"))


@query("template_validate", "SELECT s_suppkey // 10 AS template, CASE WHEN s_suppkey // 10 % 5 = 4 THEN 'empty name' WHEN bool_or(s_suppkey % 7 = 6) THEN 'bad format' END AS problem FROM supplier GROUP BY s_suppkey // 10")
def template_validate(spark, d):
    name = F.when(F.col("template") % 5 == 4, "").otherwise(F.concat(F.lit("Template "), "template"))
    return templates(spark, d).select("template", s.template_problem(name, F.col("sections")).alias("problem"))


@query("map_first_key", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 10 WHEN 1 THEN p_size * 20 WHEN 2 THEN 4000 ELSE p_size * 30 END AS context FROM part")
def map_first_key(spark, d):
    n, k = F.col("p_size"), F.col("p_size") % 4
    named = lambda key, v: F.create_map(F.lit(key), v.cast("string"))
    values = F.when(k == 0, F.map_concat(named("m.context_length", n * 10), named("context_length", n))).when(k == 1, named("m.context_size", n * 20)).when(k == 2, named("m.context_length", F.lit("many"))).otherwise(named("context_length", n * 30))
    keys = [F.lit(x) for x in ("m.context_length", "m.context_size", "context_length", "context_size")]
    return read(spark, d, "part").select("p_partkey", s.first_key(values, keys, 4000).cast("int").alias("context"))


@query("event_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'session-' || user_id AS session_id FROM events""")
def event_props(spark, d):
    props = F.from_json("props", T.MapType(T.StringType(), T.StringType()))
    full = F.map_concat(F.map_filter(props, lambda k, _: k != "session_id"), F.create_map(F.lit("session_id"), F.concat(F.lit("session-"), "user_id")))
    return read(spark, d, "events").select("event_id", full.alias("m")).select("event_id", F.col("m")["k"].cast("long").alias("k"), F.col("m")["session_id"].alias("session_id"))


@query("nested_precedence", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 100 ELSE p_size END AS context_length FROM part")
def nested_precedence(spark, d):
    top = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 100).alias("context_length")).alias("top_provider")
    return read(spark, d, "part").select("p_partkey", "p_size", top).select("p_partkey", F.coalesce("top_provider.context_length", "p_size").alias("context_length"))


@query("metadata_merge", """SELECT o_orderkey, json_extract_string(m, '$.status') AS status, json_extract_string(m, '$.kept') AS kept FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '{"status":"completed"}' ELSE '{"status":"completed","kept":"' || o_orderpriority || '"}' END AS m FROM orders)""")
def metadata_merge(spark, d):
    from parley.sources.files import merged_metadata

    old = F.when(F.col("o_orderkey") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.lit("old").alias("status"), F.col("o_orderpriority").alias("kept"))))
    rows = merged_metadata(read(spark, d, "orders").select("o_orderkey", old.alias("metadata")), "completed", "2024-06-01", "native")
    return rows.select("o_orderkey", F.get_json_object("metadata", "$.status").alias("status"), F.get_json_object("metadata", "$.kept").alias("kept"))
