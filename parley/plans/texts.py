"""Text operators over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as t
from parley.functions.devices import is_meeting_title
from parley.plans import greedy
from parley.plans.registry import query
from parley.sources.tables import SEGMENTS, read, segments

WS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


#: Junk of recognisers, and a word as overlaps compare it, in SQL.
JUNK = "(regexp_matches(lower(text), 'thank you for watching|thanks for watching|like and subscribe|music playing|applause|laughter|um um um|uh uh uh|ah ah ah') OR (len(list_distinct(string_split(text, ''))) <= 3 AND strlen(text) > 10))"
BARE = r"""translate(lower({0}), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')"""


def docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


@query("chunk_fixed", "SELECT doc_id, i AS chunk, substring(text, CAST(i * 4000 + 1 AS INTEGER), 5000) AS piece FROM documents, unnest(range(0, CAST(ceil(length(text) / 4000.0) AS BIGINT))) AS r(i)")
def chunk_fixed(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(t.fixed_chunks("text", 5000, 1000)).alias("chunk", "piece")).withColumn("chunk", F.col("chunk").cast("long"))


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) * 35 / 100.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", t.token_estimate("text").alias("tokens"))


@query(
    "chunk_boundary",
    """WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 2858 THEN [0] ELSE range(0, CAST(ceil((n - 2858) / 2572.0) * 2572 + 1 AS BIGINT), 2572) END) AS s FROM n),
r AS (SELECT *, substring(text, s + 1, 2858) AS raw FROM s),
p AS (SELECT *, instr(reverse(raw), ' .') AS dot, instr(reverse(raw), ' ') AS gap FROM r)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS BIGINT) AS chunk,
  CASE WHEN s + 2858 >= n THEN raw WHEN dot > 0 THEN substring(raw, 1, length(raw) - dot + 1) WHEN gap > 0 THEN substring(raw, 1, length(raw) - gap + 1) ELSE raw END AS piece FROM p""",
)
def chunk_boundary(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(t.boundary_chunks("text", 1000, 100)).alias("chunk", "piece")).withColumn("chunk", F.col("chunk").cast("long"))


#: Documents dressed up as model output: reasoning blocks, fences and titles by the remainder of the id.
DRESSED = """(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<think>' || chr(10) || 'plan</think> ' || chr(10) || text WHEN 1 THEN '```markdown' || chr(10) || '# ' || text || chr(10) || '```'
  WHEN 2 THEN ' ```' || chr(10) || text || chr(10) || '```  ' ELSE 'intro' || chr(10) || '# # Title ' || doc_id || ' ' || chr(10) || chr(10) || text END AS text FROM documents)"""


def dressed(spark, d):
    x, nl = F.col("text"), F.lit("\n")
    k = F.col("doc_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("<think>\nplan</think> \n"), x))
        .when(k == 1, F.concat(F.lit("```markdown\n# "), x, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit(" ```\n"), x, F.lit("\n```  ")))
        .otherwise(F.concat(F.lit("intro\n# # Title "), "doc_id", F.lit(" "), nl, nl, x))
    )
    return docs(spark, d).withColumn("text", text)


@query(
    "clean_markdown",
    rf"""WITH a AS (SELECT doc_id, {TRIM.format(r"regexp_replace(text, '<think(?:ing)?>.*?</think(?:ing)?>', '', 'gs')")} AS t FROM {DRESSED})
SELECT doc_id, CASE WHEN starts_with(t, '```markdown' || chr(10)) AND ends_with(t, '```') THEN {TRIM.format("substring(t, 13, length(t) - 15)")}
 WHEN starts_with(t, '```' || chr(10)) AND ends_with(t, '```') THEN {TRIM.format("substring(t, 5, length(t) - 7)")} ELSE t END AS cleaned FROM a""",
)
def clean_markdown(spark, d):
    return dressed(spark, d).select("doc_id", t.clean_markdown("text").alias("cleaned"))


@query("extract_title", rf"SELECT doc_id, CASE WHEN l <> '' THEN {TRIM.format("regexp_replace(l, '^(?:# )+', '')")} END AS title FROM (SELECT doc_id, regexp_extract(text, '(?m)^(# [^\n]*)$', 1) AS l FROM {DRESSED})")
def extract_title(spark, d):
    return dressed(spark, d).select("doc_id", t.first_title("text").alias("title"))


@query(
    "strip_title",
    rf"""SELECT doc_id, CASE WHEN {TRIM.format("regexp_replace(l, '^(?:# )+', '')")} = '' THEN text WHEN e > 0 THEN regexp_replace(substring(text, hit + e - 1), '^\s+', '') ELSE '' END AS body
FROM (SELECT doc_id, text, instr(text, '#') AS hit, instr(substring(text, instr(text, '#')), chr(10)) AS e, regexp_extract(text, '(?m)^(# [^\n]*)$', 1) AS l FROM {DRESSED})""",
)
def strip_title(spark, d):
    return dressed(spark, d).select("doc_id", t.without_title("text").alias("body"))


@query("junk_filter", "SELECT conv_id, turn, regexp_matches(lower(text), 'thank you for watching|thanks for watching|like and subscribe|music playing|applause|laughter|um um um|uh uh uh|ah ah ah') OR (len(list_distinct(string_split(text, ''))) <= 3 AND strlen(text) > 10) AS junk FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN repeat('ha', 6) WHEN conv_id % 3 = 1 THEN text ELSE text || ' Applause' END AS text FROM conversations)")
def junk_filter(spark, d):
    rows = read(spark, d, "conversations")
    text = F.when(F.col("conv_id") % 3 == 0, F.repeat(F.lit("ha"), 6)).when(F.col("conv_id") % 3 == 1, F.col("text")).otherwise(F.concat("text", F.lit(" Applause")))
    return rows.select("conv_id", "turn", t.is_meaningless(text).alias("junk"))


@query("remove_fillers", rf"SELECT conv_id, turn, array_to_string(list_filter(list_filter(regexp_split_to_array('Um, ' || replace(text, ' the ', ' uh the Hmm... '), '\s+'), lambda x: x <> ''), lambda w: NOT list_contains(['uh','um','er','ah','oh','hm','hmm','uhh','umm','err','ahh','ohh'], regexp_replace(lower(w), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g'))), ' ') AS cleaned FROM conversations")
def remove_fillers(spark, d):
    text = F.concat(F.lit("Um, "), F.replace("text", F.lit(" the "), F.lit(" uh the Hmm... ")))
    return read(spark, d, "conversations").select("conv_id", "turn", t.remove_fillers(text).alias("cleaned"))


#: Spaces before marks and after the ends of sentences, in SQL.
MARKS = "replace(replace(replace(replace(replace(replace(replace({0}, ' .', '.'), ' ,', ','), ' ?', '?'), ' !', '!'), '.  ', '. '), '?  ', '? '), '!  ', '! ')"
RAW = TRIM.format("'  ' || replace(text, '. ', ' .   ')")


@query("normalize_punct", f"WITH a AS (SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace({RAW}, ' .', '.'), ' ,', ','), ' ?', '?'), ' !', '!'), '.  ', '. '), '?  ', '? '), '!  ', '! ') AS t FROM conversations) SELECT conv_id, turn, upper(substring(t, 1, 1)) || substring(t, 2) AS normalized FROM a")
def normalize_punct(spark, d):
    text = F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(" .   ")))
    return read(spark, d, "conversations").select("conv_id", "turn", t.normalize_punctuation(text).alias("normalized"))


def _contractions(c):
    for w in t.CONTRACTIONS:
        c = f"replace({c}, '{w}', '{w[:-1]}''t')"
    return c


@query("fix_contractions", f"SELECT doc_id, {_contractions("text || ' we dont and cant, significant'")} AS fixed FROM documents")
def fix_contractions(spark, d):
    return docs(spark, d).select("doc_id", t.fix_contractions(F.concat("text", F.lit(" we dont and cant, significant"))).alias("fixed"))


NAME = TRIM.format(r"""regexp_replace(url || ' ?*|', '[/\\:*?"<>|[:cntrl:]]', '_', 'g')""")


@query("sanitize_name", f"SELECT page_id, {NAME} AS name FROM pages")
def sanitize_name(spark, d):
    return read(spark, d, "pages").select("page_id", t.sanitize_name(F.concat("url", F.lit(" ?*|"))).alias("name"))


TITLES = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Meet - ' || url || ' ' WHEN 1 THEN 'Google Meet - Meet — ' || url || ' — x' WHEN 2 THEN 'Meet – ' || url || ' and 3 more pages' WHEN 3 THEN url || ' - Google Meet' ELSE url END AS t FROM pages)"


def page_titles():
    u, k = F.col("url"), F.col("page_id") % 5
    return F.when(k == 0, F.concat(F.lit("Meet - "), u, F.lit(" "))).when(k == 1, F.concat(F.lit("Google Meet - Meet — "), u, F.lit(" — x"))).when(k == 2, F.concat(F.lit("Meet – "), u, F.lit(" and 3 more pages"))).when(k == 3, F.concat(u, F.lit(" - Google Meet"))).otherwise(u)


@query(
    "strip_affix",
    f"""SELECT page_id, CASE WHEN starts_with(t, 'Meet - ') THEN {TRIM.format("substring(t, 8)")} WHEN starts_with(t, 'Google Meet - Meet ') THEN {TRIM.format("string_split(t, '—')[2]")}
WHEN starts_with(t, 'Meet – ') THEN {TRIM.format("string_split(substring(t, 8), ' and ')[1]")} WHEN ends_with(t, ' - Google Meet') THEN {TRIM.format("substring(t, 1, length(t) - 14)")} ELSE t END AS name FROM {TITLES}""",
)
def strip_affix(spark, d):
    return read(spark, d, "pages").select("page_id", t.strip_meeting_affix(page_titles()).alias("name"))


@query("format_mmss", f"WITH {SEGMENTS} SELECT meeting_id, seq, CASE WHEN seq % 5 = 0 THEN '--' ELSE '[' || lpad((CAST(floor(start_s) AS BIGINT) // 60)::VARCHAR, 2, '0') || ':' || lpad((CAST(floor(start_s) AS BIGINT) % 60)::VARCHAR, 2, '0') || ']' END AS clock FROM seg")
def format_mmss(spark, d):
    start = F.when(F.col("seq") % 5 != 0, F.col("start_s"))
    return segments(spark, d).select("meeting_id", "seq", t.format_mmss(start, F.lit("--")).alias("clock"))


@query("format_hms", "SELECT event_id, lpad((CAST(floor(value * 97) AS BIGINT) // 3600)::VARCHAR, 2, '0') || ':' || lpad((CAST(floor(value * 97) AS BIGINT) % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((CAST(floor(value * 97) AS BIGINT) % 60)::VARCHAR, 2, '0') AS clock FROM events")
def format_hms(spark, d):
    return read(spark, d, "events").select("event_id", t.format_hms(F.col("value") * 97).alias("clock"))


@query("render_transcript", f"WITH {SEGMENTS} SELECT meeting_id, string_agg('[' || lpad((CAST(floor(start_s) AS BIGINT) // 60)::VARCHAR, 2, '0') || ':' || lpad((CAST(floor(start_s) AS BIGINT) % 60)::VARCHAR, 2, '0') || '] ' || text, chr(10) ORDER BY seq) AS body FROM seg GROUP BY meeting_id")
def render_transcript(spark, d):
    line = F.concat(t.format_mmss("start_s"), F.lit(" "), "text").alias("line")
    lines = segments(spark, d).groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct("seq", line))).alias("l"))
    return lines.select("meeting_id", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("body"))


@query("transcript_flatten", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def transcript_flatten(spark, d):
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda s: s["text"]), " ").alias("body"))


@query("word_count", rf"SELECT doc_id, len({WS}) AS words, len(regexp_split_to_array(text, '\s+')) AS pieces FROM documents")
def word_count(spark, d):
    return docs(spark, d).select("doc_id", t.word_count("text").cast("long").alias("words"), t.split_count("text").cast("long").alias("pieces"))


@query("path_parts", "SELECT page_id, string_split(replace(url, '\\', '/'), '/')[-2] AS folder, string_split(replace(url, '\\', '/'), '/')[-1] AS name FROM pages")
def path_parts(spark, d):
    parts = F.split(F.replace("url", F.lit("\\"), F.lit("/")), "/")
    return read(spark, d, "pages").select("page_id", F.try_element_at(parts, F.lit(-2)).alias("folder"), F.element_at(parts, -1).alias("name"))


@query("meeting_titles", f"SELECT page_id, regexp_matches(t, '^Meet - .+|^Meet – .+|^Google Meet - Meet — .+|.+ - Google Meet$') AS is_meeting FROM {TITLES}")
def meeting_titles(spark, d):
    return read(spark, d, "pages").select("page_id", is_meeting_title(page_titles()).alias("is_meeting"))


@query("format_size", "SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || ' MB' ELSE printf('%.1f', n / 1073741824.0) || ' GB' END AS shown FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * 37 AS n FROM orders)")
def format_size(spark, d):
    return read(spark, d, "orders").select("o_orderkey", t.format_size(F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("shown"))


@query("regex_param", r"SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract('FROM x' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'PARAMETER num_ctx ' || p_size * 100 END, 'PARAMETER\s+num_ctx\s+(\d+)', 1), '') AS BIGINT), 4000) AS num_ctx FROM part")
def regex_param(spark, d):
    body = F.concat(F.lit("FROM x\n"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("PARAMETER num_ctx "), F.col("p_size") * 100)))
    found = F.regexp_extract(body, r"PARAMETER\s+num_ctx\s+(\d+)", 1)
    return read(spark, d, "part").select("p_partkey", F.coalesce(F.try_to_number(F.nullif(found, F.lit("")), F.lit("9999999999")).cast("long"), F.lit(4000)).alias("num_ctx"))


@query("collapse_repeats", rf"WITH w AS (SELECT doc_id, {WS} AS w FROM documents) SELECT doc_id, array_to_string([w[i] for i in range(1, len(w) + 1) if i = 1 OR w[i] <> w[i - 1]], ' ') AS cleaned FROM w")
def collapse_repeats(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(t.collapse_repeats(t.words("text")), " ").alias("cleaned"))


@query("repetition_ratio", rf"WITH w AS (SELECT doc_id, {WS} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) < 4 THEN 0.0 ELSE CAST(len(w) - len(list_distinct(list_transform(w, lambda x: lower(x)))) AS DOUBLE) / len(w) END, 6) AS ratio FROM w")
def repetition_ratio(spark, d):
    return docs(spark, d).select("doc_id", F.round(t.repetition_ratio("text"), 6).alias("ratio"))


@query("text_preview", "SELECT doc_id, substring(text, 1, 100) AS preview FROM documents")
def text_preview(spark, d):
    return docs(spark, d).select("doc_id", F.substring("text", 1, 100).alias("preview"))


@query("prompt_assembly", "SELECT conv_id, 'system: summarise' || chr(10) || string_agg('chunk ' || turn || ': ' || text, chr(10) || '---' || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def prompt_assembly(spark, d):
    part = F.concat(F.lit("chunk "), "turn", F.lit(": "), "text").alias("part")
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part))).alias("l"))
    return rows.select("conv_id", F.concat(F.lit("system: summarise\n"), F.array_join(F.transform("l", lambda s: s["part"]), "\n---\n")).alias("prompt"))


@query(
    "phrase_collapse",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id AS id, {WS} AS w FROM documents), {greedy.phrases("s")}
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(w, ' '), '') END AS cleaned FROM documents LEFT JOIN kept ON id = doc_id""",
)
def phrase_collapse(spark, d):
    return docs(spark, d).select("doc_id", t.collapse_phrases("text").alias("cleaned"))


@query(
    "clean_repetitive",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id AS id, {WS} AS w FROM documents), s AS MATERIALIZED (SELECT id, [w[i] for i in range(1, len(w) + 1) if i = 1 OR w[i] <> w[i - 1]] AS w FROM d), {greedy.phrases("s")}
SELECT doc_id, CASE WHEN {JUNK} THEN '' WHEN len(d.w) < 3 THEN text
  WHEN len(kept.w) >= 4 AND CAST(len(kept.w) - len(list_distinct(list_transform(kept.w, lambda x: lower(x)))) AS DOUBLE) / len(kept.w) > 0.7 THEN '' ELSE array_to_string(kept.w, ' ') END AS cleaned
FROM documents JOIN d ON d.id = doc_id LEFT JOIN kept ON kept.id = doc_id""",
)
def clean_repetitive(spark, d):
    return docs(spark, d).select("doc_id", t.clean_repetitive("text").alias("cleaned"))


@query(
    "overlap_stitch",
    f"""WITH s AS MATERIALIZED (SELECT row_number() OVER () AS id, x.conv_id, x.turn, x.text AS one, y.text AS two FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
l AS MATERIALIZED (SELECT id, conv_id, turn, one, two, {WS.replace("text", "one")} AS a, {WS.replace("text", "two")} AS b FROM s),
u AS (SELECT id, i, {BARE.format("a[i]")} AS x FROM l, unnest(range(1, len(a) + 1)) AS r(i)), v AS (SELECT id, j, {BARE.format("b[j]")} AS x FROM l, unnest(range(1, len(b) + 1)) AS r(j)),
m AS (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS island FROM u JOIN v USING (id, x)),
c AS (SELECT id, min(i) AS i, min(j) AS j, count(*) AS n FROM m GROUP BY id, i - j, island),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, i, j) = 1)
SELECT conv_id, turn, CASE WHEN one IS NOT NULL AND two IS NOT NULL THEN array_to_string(list_concat(CASE WHEN best.id IS NULL THEN a WHEN i > 1 THEN a[1:i - 1] ELSE [] END, CASE WHEN best.id IS NULL THEN b ELSE b[j:len(b)] END), ' ') END AS stitched
FROM l LEFT JOIN best USING (id)""",
)
def overlap_stitch(spark, d):
    a = read(spark, d, "conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", t.stitch("text", "next").alias("stitched"))


@query(
    "post_process",
    rf"""WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER () AS id, conv_id, turn, 'um so so we dont we dont ' || text AS text FROM conversations),
s AS MATERIALIZED (SELECT id, {WS} AS w FROM o), {greedy.older("s")},
c AS (SELECT id, array_to_string(list_filter(w, lambda w: NOT list_contains(['uh','um','er','ah','oh','hm','hmm','uhh','umm','err','ahh','ohh'], regexp_replace(lower(w), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g'))), ' ') AS t FROM kept),
a AS (SELECT id, {MARKS.format(TRIM.format("t"))} AS t FROM c), b AS (SELECT id, upper(substring(t, 1, 1)) || substring(t, 2) AS t FROM a)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN t ELSE {_contractions("t")} END AS processed, CASE WHEN text IS NULL THEN 0.5 WHEN turn % 2 = 0 THEN 0.8 ELSE 0.95 END AS confidence FROM o LEFT JOIN b USING (id)""",
)
def post_process(spark, d):
    """Conversation turns with stutters; every other one is a partial result."""
    text = F.concat(F.lit("um so so we dont we dont "), "text")
    rows = read(spark, d, "conversations").select("conv_id", "turn", t.post_process(text, F.col("turn") % 2 == 0).alias("p"))
    return rows.select("conv_id", "turn", F.col("p.text").alias("processed"), "p.confidence")


@query(
    "collapse_older",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id AS id, {WS} AS w FROM documents), {greedy.older("s")}
SELECT doc_id, CASE WHEN len(s.w) < 4 THEN text ELSE array_to_string(kept.w, ' ') END AS cleaned FROM documents JOIN s ON s.id = doc_id LEFT JOIN kept ON kept.id = doc_id""",
)
def collapse_older(spark, d):
    return docs(spark, d).select("doc_id", t.collapse_older("text").alias("cleaned"))


@query(
    "join_tokens",
    rf"WITH w AS (SELECT doc_id, text, {WS} AS w FROM documents) SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[\p{{L}}\p{{M}}\p{{N}}_]') THEN ' ' ELSE '' END || x), '') END AS joined FROM w",
)
def join_tokens(spark, d):
    """Words of documents in tokens of four characters, each word with the space before it."""
    tokens = F.flatten(F.transform(t.words("text"), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1, F.lit(4)), lambda i: F.substring(F.concat(F.lit(" "), w), i, F.lit(4)))))
    return docs(spark, d).select("doc_id", t.join_tokens(tokens).alias("joined"))
