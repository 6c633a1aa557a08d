"""Search, paging, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.text import contains_literal, snippet
from parley.operators.search import first_per, page, phrase_hits, search_segments, search_with_fallback
from parley.plans.registry import query
from parley.sources.tables import MEETINGS, SEGMENTS, meetings, read, segments

TERM, FULL_TERM = "the", "tion"
TS = "yyyy-MM-dd HH:mm:ss"
SNIPPET = """(CASE WHEN greatest(hit - 100, 1) > 1 THEN '...' ELSE '' END) || substring(text, greatest(hit - 100, 1), least(hit + {n} - 1 + 100, length(text)) - greatest(hit - 100, 1) + 1)
  || (CASE WHEN least(hit + {n} - 1 + 100, length(text)) < length(text) THEN '...' ELSE '' END)"""


@query("meetings_recent", f"WITH {MEETINGS} SELECT meeting_id, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM m ORDER BY created_at DESC")
def meetings_recent(spark, d):
    return meetings(spark, d).orderBy(F.desc("created_at"), "meeting_id").select("meeting_id", "title", F.date_format("created_at", TS).alias("created_at"))


@query("meeting_by_id", f"WITH {MEETINGS} SELECT meeting_id, title, folder_path FROM m WHERE conv_id = 7")
def meeting_by_id(spark, d):
    return meetings(spark, d).where("conv_id = 7").select("meeting_id", "title", "folder_path")


@query("segment_timing", f"WITH {SEGMENTS} SELECT meeting_id, seq, start_s, end_s, dur FROM seg")
def segment_timing(spark, d):
    return segments(spark, d).select("meeting_id", "seq", "start_s", "end_s", "dur")


@query("meeting_rollup", f"WITH {SEGMENTS}, {MEETINGS} SELECT m.meeting_id, m.title, count(seg.seq) AS n_segments, max(end_s) AS end_s FROM m LEFT JOIN seg USING (conv_id) GROUP BY ALL")
def meeting_rollup(spark, d):
    stats = segments(spark, d).groupBy("conv_id").agg(F.count("seq").alias("n"), F.max("end_s").alias("end_s"))
    return meetings(spark, d).join(stats, "conv_id", "left").select("meeting_id", "title", F.coalesce("n", F.lit(0)).alias("n_segments"), "end_s")


@query("page_segments", f"WITH {SEGMENTS} SELECT meeting_id, seq, start_s, text FROM seg ORDER BY conv_id, start_s NULLS FIRST, seq LIMIT 25 OFFSET 50")
def page_segments(spark, d):
    rows = segments(spark, d)
    return page(rows, [F.col("conv_id"), F.asc_nulls_first("start_s"), F.col("seq")], 50, 25).select("meeting_id", "seq", "start_s", "text")


@query("page_total", "SELECT 'meeting-' || conv_id AS meeting_id, count(*) AS total, 2 + least(greatest(count(*) - 2, 0), 3) < count(*) AS has_more FROM conversations GROUP BY conv_id")
def page_total(spark, d):
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    shown = F.least(F.greatest(F.col("total") - 2, F.lit(0)), F.lit(3))
    return rows.select(F.concat(F.lit("meeting-"), "conv_id").alias("meeting_id"), "total", (2 + shown < F.col("total")).alias("has_more"))


@query("search_segments", f"WITH {SEGMENTS}, {MEETINGS} SELECT m.meeting_id, m.title, seg.seq, seg.text FROM m JOIN seg USING (conv_id) WHERE contains(lower(seg.text), '{TERM}')")
def search_segments_q(spark, d):
    return search_segments(meetings(spark, d), segments(spark, d), TERM).select("meeting_id", "title", "seq", "text")


@query(
    "search_snippet",
    f"WITH {SEGMENTS}, {MEETINGS}, h AS (SELECT *, instr(lower(text), '{TERM}') AS hit FROM seg) SELECT m.meeting_id, m.title, h.seq, {SNIPPET.format(n=len(TERM))} AS context, start_s FROM m JOIN h USING (conv_id) WHERE hit > 0",
)
def search_snippet(spark, d):
    hits = search_segments(meetings(spark, d), segments(spark, d), TERM)
    return hits.orderBy(F.desc("created_at"), "meeting_id", "seq").select("meeting_id", "title", "seq", snippet("text", TERM).alias("context"), "start_s")


@query(
    "search_fallback_anti",
    f"""WITH {MEETINGS}, part AS (SELECT conv_id, text, 'turn ' || turn AS stamp FROM conversations WHERE turn % 2 = 0),
f AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
h AS (SELECT *, instr(lower(text), '{FULL_TERM}') AS hit FROM part), g AS (SELECT *, instr(lower(text), '{FULL_TERM}') AS hit FROM f)
SELECT m.meeting_id, m.title, {SNIPPET.format(n=len(FULL_TERM))} AS context, stamp, CAST(0 AS BIGINT) AS rank FROM m JOIN h USING (conv_id) WHERE hit > 0
UNION ALL SELECT m.meeting_id, m.title, {SNIPPET.format(n=len(FULL_TERM))} AS context, '2024-06-01' AS stamp, CAST(1 AS BIGINT) AS rank FROM m JOIN g USING (conv_id)
WHERE hit > 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = g.conv_id AND h.hit > 0)""",
)
def search_fallback_anti(spark, d):
    rows = read(spark, d, "conversations").withColumn("meeting_id", F.concat(F.lit("meeting-"), "conv_id"))
    part = rows.where("turn % 2 = 0").select("meeting_id", "text", F.concat(F.lit("turn "), "turn").alias("stamp"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ")
    return search_with_fallback(meetings(spark, d), part, rows.groupBy("meeting_id").agg(body.alias("text")), FULL_TERM, "2024-06-01")


@query("search_title_or_body", f"WITH {MEETINGS} SELECT meeting_id, title FROM m WHERE contains(lower(title), '1') OR conv_id IN (SELECT conv_id FROM conversations WHERE contains(lower(text), 'ing the'))")
def search_title_or_body(spark, d):
    m = meetings(spark, d)
    hits = read(spark, d, "conversations").where(contains_literal("text", "ing the")).select("conv_id")
    return m.join(hits, "conv_id", "left_semi").unionByName(m.where(contains_literal("title", "1"))).select("meeting_id", "title").distinct()


@query("first_snippet_per_meeting", f"WITH h AS (SELECT conv_id, turn, text, instr(lower(text), '{TERM}') AS hit FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM h WHERE hit > 0), {MEETINGS} SELECT m.meeting_id, coalesce(turn, -1) AS seq, {SNIPPET.format(n=len(TERM))} AS context FROM m LEFT JOIN k ON k.conv_id = m.conv_id AND n = 1")
def first_snippet_per_meeting(spark, d):
    hits = read(spark, d, "conversations").where(contains_literal("text", TERM))
    first = first_per(hits, "conv_id", F.col("turn")).select("conv_id", F.col("turn").alias("seq"), snippet("text", TERM).alias("context"))
    return meetings(spark, d).join(first, "conv_id", "left").select("meeting_id", F.coalesce("seq", F.lit(-1)).alias("seq"), "context")


@query("meeting_details_nested", f"WITH {SEGMENTS}, {MEETINGS} SELECT m.meeting_id, m.title, string_agg(seq || '|' || role || '|' || length(text), ';' ORDER BY seq) AS segments, count(*) AS n FROM m JOIN seg USING (conv_id) GROUP BY m.meeting_id, m.title")
def meeting_details_nested(spark, d):
    nested = segments(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "role", F.length("text").alias("chars")))).alias("segments"))
    flat = F.array_join(F.transform("segments", lambda s: F.concat_ws("|", s["seq"], s["role"], s["chars"])), ";")
    return meetings(spark, d).join(nested, "conv_id").select("meeting_id", "title", flat.alias("segments"), F.size("segments").cast("long").alias("n"))


@query("summary_with_transcript", "SELECT o_orderkey AS process_id, o_orderstatus AS status, doc_id, n_chars FROM orders JOIN documents ON doc_id = o_orderkey")
def summary_with_transcript(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    return read(spark, d, "orders").join(docs, F.col("o_orderkey") == F.col("doc_id")).select(F.col("o_orderkey").alias("process_id"), F.col("o_orderstatus").alias("status"), "doc_id", "n_chars")


@query("singleton_or_default", "SELECT coalesce(max(CASE WHEN c_custkey = 1 THEN c_name END), 'none') AS first, coalesce(max(CASE WHEN c_custkey = -1 THEN c_name END), 'none') AS missing FROM customer")
def singleton_or_default(spark, d):
    one = spark.range(1)
    pick = lambda key, name: read(spark, d, "customer").where(F.col("c_custkey") == key).limit(1).select(F.col("c_name").alias(name))
    both = one.join(pick(1, "first"), F.lit(True), "left").join(pick(-1, "missing"), F.lit(True), "left")
    return both.select(F.coalesce("first", F.lit("none")).alias("first"), F.coalesce("missing", F.lit("none")).alias("missing"))


@query("range_semi_join", "SELECT e.event_id, 3232235520 + e.event_id * 37 % 4096 AS ip FROM events e WHERE EXISTS (SELECT 1 FROM nation n WHERE 3232235520 + e.event_id * 37 % 4096 BETWEEN 3232235520 + n_nationkey * 150 AND 3232235520 + n_nationkey * 150 + 63)")
def range_semi_join(spark, d):
    """Addresses inside a block: blocks and addresses meet in cells of 64, so the join has an equality and needs no broadcast."""
    cell = F.lit(64)
    blocks = read(spark, d, "nation").select((F.lit(3232235520) + F.col("n_nationkey") * 150).alias("low")).withColumn("high", F.col("low") + 63)
    placed = blocks.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor(F.col("high") / cell))))
    rows = read(spark, d, "events").select("event_id", (F.lit(3232235520) + F.col("event_id") * 37 % 4096).alias("ip"))
    r, p = rows.withColumn("at", F.floor(F.col("ip") / cell)), placed
    return r.join(p, (F.col("at") == F.col("cell")) & F.col("ip").between(F.col("low"), F.col("high")), "left_semi").select("event_id", "ip")


@query("stable_order", "SELECT event_id, coalesce(value, 0.0) AS key1, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0.0), event_id) AS BIGINT) AS pos FROM events")
def stable_order(spark, d):
    from pyspark.sql import Window

    rows = read(spark, d, "events").withColumn("key1", F.coalesce("value", F.lit(0.0)))
    return rows.select("event_id", "key1", F.row_number().over(Window.partitionBy("user_id").orderBy("key1", "event_id")).cast("long").alias("pos"))


@query("page_merge", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def page_merge(spark, d):
    """Two pages that overlap in half of the table."""
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type")
    return rows.where("event_id % 4 <> 3").unionByName(rows.where("event_id % 4 <> 0")).dropDuplicates(["event_id"])


@query("seq_dedup", "SELECT conv_id, turn FROM conversations a WHERE turn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn AND b.role = 'user')")
def seq_dedup(spark, d):
    rows = read(spark, d, "conversations")
    known = rows.where("role = 'user'").select("conv_id", "turn")
    return rows.where("turn IS NOT NULL").join(known, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("dedup_text_time", "SELECT DISTINCT text, turn FROM conversations")
def dedup_text_time(spark, d):
    return read(spark, d, "conversations").select("text", "turn").dropDuplicates(["text", "turn"])


@query("id_union_sorted", "SELECT DISTINCT id FROM (SELECT s_name AS id FROM supplier UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation) ORDER BY id")
def id_union_sorted(spark, d):
    names = [read(spark, d, "supplier").select(F.col("s_name").alias("id")), read(spark, d, "customer").select("c_name"), read(spark, d, "nation").select("n_name")]
    return names[0].union(names[1]).union(names[2]).distinct().orderBy("id")


@query("template_overlay", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' custom' WHEN s_suppkey % 2 = 0 THEN s_name || ' bundled' ELSE s_name END AS template FROM supplier")
def template_overlay(spark, d):
    base = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("a"))
    bundled = base.where("id % 2 = 0").select("id", F.concat("a", F.lit(" bundled")).alias("b"))
    custom = base.where("id % 3 = 0").select("id", F.concat("a", F.lit(" custom")).alias("c"))
    return base.join(bundled, "id", "full").join(custom, "id", "full").select("id", F.coalesce("c", "b", "a").alias("template"))


@query("sequence_ids", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS sequence_id FROM conversations")
def sequence_ids(spark, d):
    from pyspark.sql import Window

    return read(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("sequence_id"))


@query("ordered_reassembly", "SELECT o_orderkey AS job, string_agg(CAST(l_quantity AS BIGINT)::VARCHAR, ',' ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def ordered_reassembly(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q")))).alias("p"))
    joined = read(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_orderkey").alias("job"), F.array_join(F.transform("p", lambda s: s["q"].cast("string")), ",").alias("parts"))


@query("phrase_containment", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def phrase_containment(spark, d):
    """Documents that hold a search phrase whole."""
    return phrase_hits(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark").select("item_id", F.col("text").alias("phrase")))


#: Phrases of all lengths from the turns themselves: three to a dozen words, cut within words at both ends.
CUT_PHRASES = "SELECT conv_id * 1000 + turn AS item_id, substring(text, CAST(3 + turn AS INTEGER), CAST(12 + 4 * (conv_id % 12) AS INTEGER)) AS phrase FROM conversations WHERE turn % 3 = 0"


@query("quoted_turns", f"WITH p AS ({CUT_PHRASES}), c AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE turn IS NOT NULL) SELECT p.item_id, c.doc_id FROM p JOIN c ON contains(c.text, p.phrase)")
def quoted_turns(spark, d):
    """Turns that hold a passage of another turn, one that may begin and end within words."""
    turns = read(spark, d, "conversations").where("turn IS NOT NULL").select(F.expr("conv_id * 1000 + turn").alias("doc_id"), "turn", "conv_id", "text")
    cut = F.substring("text", (F.col("turn") + 3).cast("int"), (F.col("conv_id") % 12 * 4 + 12).cast("int"))
    return phrase_hits(turns.select("doc_id", "text"), turns.where("turn % 3 = 0").select(F.col("doc_id").alias("item_id"), cut.alias("phrase")))
