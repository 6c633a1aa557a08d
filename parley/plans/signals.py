"""Signal operators; embeddings play sample frames: even ids the microphone, odd ones the system."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import signal as g
from parley.plans.registry import query
from parley.sources.tables import SEGMENTS, read, segments

D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def frames(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "embedding")


def pairs(spark, d):
    e = frames(spark, d)
    mic = e.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("w"), F.col("embedding").alias("mic"))
    system = e.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("w"), F.col("embedding").alias("sys"))
    return mic.join(system, "w")


PAIRS = f"pr AS (SELECT a.vec_id // 2 AS w, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS mic, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS sys FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"


def exploded(rows, x, key="vec_id", places=6):
    return rows.select(key, F.posexplode(x).alias("i", "v")).select(key, F.col("i").cast("long").alias("i"), F.round("v", places).alias("v"))


@query("to_mono", f"SELECT vec_id, CAST(i AS BIGINT) AS i, round((e[CAST(i * 4 + 1 AS INTEGER)] + e[CAST(i * 4 + 2 AS INTEGER)]) / 2, 6) AS v FROM (SELECT vec_id, {D} AS e FROM embeddings), unnest(range(0, 16)) AS r(i)")
def to_mono(spark, d):
    return exploded(frames(spark, d), g.to_mono(F.col("embedding"), 4))


@query("rms_peak", f"SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 6) AS rms, round(list_max(list_transform(e, lambda x: abs(x))), 6) AS peak, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)) > 0.001 AS active FROM (SELECT vec_id, {D} AS e FROM embeddings)")
def rms_peak(spark, d):
    x = F.col("embedding")
    return frames(spark, d).select("vec_id", F.round(F.least(g.rms(x), F.lit(1.0)), 6).alias("rms"), F.round(F.least(g.peak(x), F.lit(1.0)), 6).alias("peak"), (g.rms(x) > 0.001).alias("active"))


@query("range_normalize", f"SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round(e[CAST(i AS INTEGER)] * 5 / greatest(list_max(list_transform(e, lambda x: abs(x))) * 5, 1), 6) AS v FROM (SELECT vec_id, {D} AS e FROM embeddings), unnest(range(1, 65)) AS r(i)")
def range_normalize(spark, d):
    return exploded(frames(spark, d), g.range_normalize(F.transform("embedding", lambda v: v.cast("double") * 5)))


@query("soft_clip_gain", f"WITH a AS (SELECT vec_id, {D} AS e FROM embeddings), b AS (SELECT *, greatest(least(0.9 / sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 0.95 / list_max(list_transform(e, lambda x: abs(x)))), 1.5) AS gain FROM a), c AS (SELECT vec_id, i, e[CAST(i AS INTEGER)] * gain AS s FROM b, unnest(range(1, 65)) AS r(i)) SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round(CASE WHEN s > 0.95 THEN 0.95 + (s - 0.95) * 0.05 WHEN s < -0.95 THEN -0.95 + (s + 0.95) * 0.05 ELSE s END, 6) AS v FROM c")
def soft_clip_gain(spark, d):
    return exploded(frames(spark, d), g.soft_clip_gain(F.col("embedding")))


@query("mix_streams", f"WITH {PAIRS} SELECT w, CAST(i - 1 AS BIGINT) AS i, round(CASE WHEN abs(s) > 1 THEN sign(s) ELSE s END, 6) AS v FROM (SELECT w, i, mic[CAST(i AS INTEGER)] * 6 + 0.7 * 6 * sys[CAST(i AS INTEGER)] AS s FROM pr, unnest(range(1, 65)) AS r(i))")
def mix_streams(spark, d):
    six = lambda c: F.transform(c, lambda v: v.cast("double") * 6)
    return exploded(pairs(spark, d), g.mix(six("mic"), six("sys")), "w")


@query("mix_ducking", f"WITH {PAIRS} SELECT w, CAST(i - 1 AS BIGINT) AS i, round(greatest(-1, least(1, mic[CAST(i AS INTEGER)] + sys[CAST(i AS INTEGER)] * CASE WHEN sqrt(list_sum(list_transform(mic, lambda x: x * x)) / len(mic)) > 0.01 THEN 0.6 ELSE 1.0 END)), 6) AS v FROM pr, unnest(range(1, 65)) AS r(i)")
def mix_ducking(spark, d):
    return exploded(pairs(spark, d), g.mix_ducking(F.col("mic"), F.col("sys")), "w")


@query("stream_align_outer", "WITH a AS (SELECT vec_id // 3 AS w, sum(label) AS mic FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 5 <> 0 GROUP BY 1), b AS (SELECT vec_id // 3 AS w, sum(label) AS sys FROM embeddings WHERE vec_id % 3 = 1 AND vec_id % 7 <> 0 GROUP BY 1) SELECT w, CAST(coalesce(mic, 0) AS BIGINT) AS mic, CAST(coalesce(sys, 0) AS BIGINT) AS sys FROM a FULL JOIN b USING (w)")
def stream_align_outer(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.expr("vec_id div 3").alias("w"))
    mic = e.where("vec_id % 3 = 0 AND vec_id % 5 <> 0").groupBy("w").agg(F.sum("label").alias("mic"))
    system = e.where("vec_id % 3 = 1 AND vec_id % 7 <> 0").groupBy("w").agg(F.sum("label").alias("sys"))
    return mic.join(system, "w", "full").select("w", F.coalesce("mic", F.lit(0)).alias("mic"), F.coalesce("sys", F.lit(0)).alias("sys"))


@query("fixed_frames", "SELECT vec_id, CAST(i AS BIGINT) AS frame, len(embedding[CAST(i * 10 + 1 AS INTEGER):CAST(i * 10 + 10 AS INTEGER)]) AS n, round(list_sum(list_transform(embedding[CAST(i * 10 + 1 AS INTEGER):CAST(i * 10 + 10 AS INTEGER)], lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings, unnest(range(0, 7)) AS r(i)")
def fixed_frames(spark, d):
    rows = frames(spark, d).select("vec_id", F.posexplode(g.frames(F.col("embedding"), 10)).alias("frame", "x"))
    return rows.select("vec_id", F.col("frame").cast("long").alias("frame"), F.size("x").cast("long").alias("n"), F.round(g.fold(F.col("x"), lambda a, v: a + v), 6).alias("total"))


@query("segment_seconds", f"WITH {SEGMENTS} SELECT meeting_id, seq, round(start_s * 1000 / 1000, 6) AS start_seconds, round(end_s * 1000 / 1000, 6) AS end_seconds, round(end_s - start_s, 6) AS seconds FROM seg")
def segment_seconds(spark, d):
    ms = segments(spark, d).withColumns({"a": F.col("start_s") * 1000, "b": F.col("end_s") * 1000})
    return ms.select("meeting_id", "seq", F.round(F.col("a") / 1000, 6).alias("start_seconds"), F.round(F.col("b") / 1000, 6).alias("end_seconds"), F.round((F.col("b") - F.col("a")) / 1000, 6).alias("seconds"))


@query("quietest_window", f"WITH a AS (SELECT vec_id, {D} AS e FROM embeddings), b AS (SELECT vec_id, i, sqrt(list_sum(list_transform(e[CAST(i + 1 AS INTEGER):CAST(i + 8 AS INTEGER)], lambda x: x * x)) / 8) AS r FROM a, unnest(range(0, 57, 4)) AS q(i)) SELECT vec_id, CAST(arg_min(i, r) AS BIGINT) AS start, round(min(r), 6) AS rms FROM b GROUP BY vec_id")
def quietest_window(spark, d):
    rows = frames(spark, d).select("vec_id", g.quietest(F.col("embedding"), 8, 4).alias("q"))
    return rows.select("vec_id", F.col("q.start").cast("long").alias("start"), F.round("q.rms", 6).alias("rms"))


@query("speaker_energy", f"WITH {PAIRS}, e AS (SELECT w, list_sum(list_transform(mic, lambda x: abs(x))) AS a, list_sum(list_transform(sys, lambda x: abs(x))) AS b FROM pr) SELECT w, CASE WHEN a > 1.1 * b THEN '0' WHEN b > 1.1 * a THEN '1' ELSE '?' END AS speaker FROM e")
def speaker_energy(spark, d):
    return pairs(spark, d).select("w", g.louder_channel(F.col("mic"), F.col("sys")).alias("speaker"))


@query("length_confidence", "SELECT conv_id, round(avg(least(length(text) / 100.0, 0.9) + 0.1), 6) AS confidence FROM conversations GROUP BY conv_id")
def length_confidence(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.avg(F.least(F.length("text") / 100.0, F.lit(0.9)) + 0.1), 6).alias("confidence"))


@query("audio_ctx", f"WITH {SEGMENTS} SELECT meeting_id, seq, dur < 15 AS is_partial, least(CAST(floor(dur * 16000 / 320) AS BIGINT) + 32, 1500) AS ctx FROM seg")
def audio_ctx(spark, d):
    return segments(spark, d).select("meeting_id", "seq", (F.col("dur") < 15).alias("is_partial"), F.least(F.floor(F.col("dur") * 16000 / 320).cast("long") + 32, F.lit(1500)).cast("long").alias("ctx"))


@query("argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS token, round(0.08 * vec_id, 6) AS at FROM embeddings")
def argmax(spark, d):
    return frames(spark, d).select("vec_id", g.argmax(F.col("embedding")).alias("token"), F.round(0.01 * 8 * F.col("vec_id"), 6).alias("at"))


@query("resample_band", "SELECT p_partkey, CAST(CASE WHEN p_size / 16.0 >= 2 THEN 512 WHEN p_size / 16.0 >= 1.5 THEN 384 WHEN p_size / 16.0 > 1 THEN 256 WHEN p_size / 16.0 <= 0.5 THEN 512 ELSE 384 END AS BIGINT) AS taps FROM part WHERE p_size <> 16")
def resample_band(spark, d):
    return read(spark, d, "part").where("p_size <> 16").select("p_partkey", g.resample_band(F.col("p_size") / 16.0).alias("taps"))


@query("db_convert", "SELECT event_id, round(20 * log10(value + 1), 6) AS decibel, round(pow(10, value / 200), 6) AS linear FROM events")
def db_convert(spark, d):
    return read(spark, d, "events").select("event_id", F.round(g.to_decibel(F.col("value") + 1), 6).alias("decibel"), F.round(g.from_decibel(F.col("value") / 10), 6).alias("linear"))


@query("latest_level", "SELECT label AS device, vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 6) AS rms FROM embeddings WHERE vec_id IN (SELECT max(vec_id) FROM embeddings GROUP BY label)")
def latest_level(spark, d):
    last = read(spark, d, "embeddings").groupBy(F.col("label").alias("device")).agg(F.max(F.struct("vec_id", "embedding")).alias("r"))
    return last.select("device", "r.vec_id", F.round(g.rms(F.col("r.embedding")), 6).alias("rms"))


@query("sliding_rms", "SELECT user_id, event_id, round(sqrt(avg(value * value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 1023 PRECEDING)), 4) AS rms FROM events")
def sliding_rms(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-1023, 0)
    return read(spark, d, "events").select("user_id", "event_id", F.round(F.sqrt(F.avg(F.col("value") * F.col("value")).over(w)), 4).alias("rms"))


HIGHPASS = "(16000 / (2 * pi() * 80)) / (16000 / (2 * pi() * 80) + 1)"


@query("highpass", f"SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round(list_sum(list_transform(range(1, i + 1), lambda k: pow({HIGHPASS}, i - k + 1) * (e[k] - CASE WHEN k > 1 THEN e[k - 1] ELSE 0 END))), 6) AS v FROM (SELECT vec_id, {D} AS e FROM embeddings), unnest(range(1, 65)) AS r(i)")
def highpass(spark, d):
    return exploded(frames(spark, d), g.each(g.highpass)("embedding"))


@query("linear_resample", f"SELECT vec_id, i, round(list_avg(e[greatest(3 * i - 1, 1):least(3 * i + 3, 64)]), 6) AS v FROM (SELECT vec_id, {D} AS e FROM embeddings), unnest(range(0, 21)) AS r(i)")
def linear_resample(spark, d):
    return exploded(frames(spark, d), g.each(g.linear_resample)("embedding"))


#: The kernel in SQL at a distance {u} in samples: cutoff times sinc times the squared Blackman-Harris window.
SINC = """(CASE WHEN abs({u}) < taps / 2.0 THEN CASE WHEN abs({u}) < 1e-12 THEN cut ELSE sin(pi() * cut * ({u})) / (pi() * ({u})) END
  * pow(0.35875 + 0.48829 * cos(2 * pi() * ({u}) / taps) + 0.14128 * cos(4 * pi() * ({u}) / taps) + 0.01168 * cos(6 * pi() * ({u}) / taps), 2) ELSE 0 END)"""
RATES = ((8_000, 16_000), (32_000, 48_000), (44_100, 48_000), (48_000, 16_000), (48_000, 32_000))
AT_PHASE = SINC.format(u="(k + {step}) / CAST(taps AS DOUBLE) + base - (j - 1)")


@query(
    "sinc_resample",
    f"""WITH b(band, rate, dest, taps, cubic) AS (VALUES (0, 8000, 16000, 512, true), (1, 32000, 48000, 384, true), (2, 44100, 48000, 256, false), (3, 48000, 16000, 512, true), (4, 48000, 32000, 384, false)),
c AS (SELECT *, dest / CAST(rate AS DOUBLE) AS ratio, 0.95 * least(1.0, dest / CAST(rate AS DOUBLE)) AS cut FROM b),
n AS (SELECT band, sum({SINC.format(u="k / CAST(taps AS DOUBLE) - o")}) / max(taps) AS norm FROM c, unnest(range(0, 512)) AS r(k), unnest(range(-255, 257)) AS q(o) WHERE k < taps AND o > -taps / 2.0 AND o <= taps / 2.0 GROUP BY band),
w AS (SELECT vec_id, {D} AS e, c.*, i, i / ratio AS place, CAST(floor(i / ratio) AS BIGINT) AS base FROM embeddings JOIN c ON band = vec_id % 5, unnest(range(0, 128)) AS r(i) WHERE i < floor(64 * ratio)),
p AS (SELECT *, CAST(floor((place - base) * taps) AS BIGINT) AS k, (place - base) * taps - floor((place - base) * taps) AS mu FROM w)
SELECT vec_id, i, round(sum(e[j] * CASE WHEN cubic THEN {SINC.format(u="place - (j - 1)")} ELSE (1 - mu) * {AT_PHASE.format(step=0)} + mu * {AT_PHASE.format(step=1)} END) / max(norm), 5) AS v FROM p JOIN n USING (band), unnest(range(1, 65)) AS s(j) GROUP BY vec_id, i""",
)
def sinc_resample(spark, d):
    """Each band of ratios for a fifth of the frames."""
    rate, to = (F.element_at(F.array(*(F.lit(r[i]) for r in RATES)), (F.col("vec_id") % len(RATES) + 1).cast("int")) for i in (0, 1))
    return exploded(frames(spark, d), g.resampled("embedding", rate, to), places=5)


@query("limiter", f"WITH s AS (SELECT vec_id, CAST(i AS BIGINT) AS i, e[CAST(i - 6 AS INTEGER)] * 6 AS x FROM (SELECT vec_id, {D} AS e FROM embeddings), unnest(range(0, 64)) AS r(i)) SELECT vec_id, i, round(CASE WHEN i < 7 THEN 0.0 WHEN abs(x) > pow(10, -0.05) THEN sign(x) * pow(10, -0.05) ELSE x END, 6) AS v FROM s")
def limiter(spark, d):
    return exploded(frames(spark, d), g.limiter(F.transform("embedding", lambda v: v.cast("double") * 6), rate=800))


def recordings(spark, d, frames_each: int = 200):
    """Frames one after the other as recordings: recording, samples."""
    rows = frames(spark, d).groupBy(F.expr(f"vec_id div {frames_each}").alias("recording")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("c"))
    return rows.select("recording", F.flatten(F.transform("c", lambda x: g.doubles(x["embedding"]))).alias("samples"))


def levels(rows, x):
    """Samples, level and peak of an array of each recording."""
    return rows.select("recording", x.alias("x")).select("recording", F.size("x").cast("long").alias("n"), F.round(g.rms(F.col("x")), 6).alias("rms"), F.round(g.peak(F.col("x")), 6).alias("peak"))


@query("loudness")
def loudness(spark, d):
    return levels(recordings(spark, d), g.each(g.loudness)("samples"))


@query("gain_readout")
def gain_readout(spark, d):
    """Mean gain by second, at a rate of 3,200 so that a recording has seconds."""
    gains = recordings(spark, d).select("recording", F.posexplode(g.each(lambda x: g.gain_readout(x, rate=3200))("samples")).alias("second", "gain_db"))
    return gains.select("recording", "second", F.round("gain_db", 4).alias("gain_db"))


@query("chunked_resample")
def chunked_resample(spark, d):
    """Chunks of a tenth of a second, so that a recording has several."""
    return levels(recordings(spark, d), g.each(lambda x: g.chunked_resample(x, chunk=0.1, overlap=0.01))("samples"))


@query(
    "spectral_subtraction",
    f"""WITH s AS (SELECT vec_id // 20 AS recording, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id, k) - 1 AS i, CAST(embedding[CAST(k AS INTEGER)] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS r(k)),
m AS (SELECT recording, avg(v * v) AS noise FROM s GROUP BY recording),
f AS (SELECT recording, k, sum(v * cos(2 * pi() * (i * k % 1600) / 1600)) AS re, -sum(v * sin(2 * pi() * (i * k % 1600) / 1600)) AS im FROM s, unnest(range(0, 801)) AS q(k) WHERE i < 1600 GROUP BY recording, k),
g AS (SELECT recording, k, re * share * side AS re, im * share * side AS im FROM (SELECT f.*, sqrt(greatest(1 - noise / nullif(re * re + im * im, 0), 0)) AS share, CASE WHEN k IN (0, 800) THEN 1 ELSE 2 END AS side FROM f JOIN m USING (recording))),
y AS (SELECT recording, i, sum(re * cos(2 * pi() * (i * k % 1600) / 1600) - im * sin(2 * pi() * (i * k % 1600) / 1600)) AS v FROM g, unnest(range(0, 1600)) AS q(i) GROUP BY recording, i)
SELECT recording, count(*) AS n, round(sqrt(avg(v * v)), 6) AS rms, round(max(abs(v)), 6) AS peak FROM y GROUP BY recording""",
)
def spectral_subtraction(spark, d):
    return levels(recordings(spark, d, 20), g.each(g.spectral_subtraction)("samples"))


@query("mix_dynamic", f"WITH {PAIRS}, l AS (SELECT w, mic, sys, sqrt(list_sum(list_transform(mic, lambda x: x * x)) / len(mic)) AS m, sqrt(list_sum(list_transform(sys, lambda x: x * x)) / len(sys)) AS s FROM pr), r AS (SELECT *, CASE WHEN m = 0 AND s = 0 THEN 0.5 WHEN m = 0 THEN 0 WHEN s = 0 THEN 1 ELSE greatest(least(m / (m + s), 0.9), 0.1) END AS share FROM l) SELECT w, CAST(i - 1 AS BIGINT) AS i, round(mic[CAST(i AS INTEGER)] * share + sys[CAST(i AS INTEGER)] * (1 - share), 6) AS v FROM r, unnest(range(1, 65)) AS q(i)")
def mix_dynamic(spark, d):
    return exploded(pairs(spark, d), g.mix_dynamic(F.col("mic"), F.col("sys")), "w")


@query("energy_fallback", f"WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2) AS e FROM embeddings), b AS (SELECT vec_id, e, list_filter(e, lambda x: abs(x) > 0.1) AS sp, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)) AS r, list_max(list_transform(e, lambda x: abs(x))) AS p FROM a) SELECT vec_id, CAST(CASE WHEN len(sp) >= 35 THEN len(sp) WHEN r >= 0.2 AND p >= 0.2 THEN len(e) ELSE 0 END AS BIGINT) AS n FROM b")
def energy_fallback(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double") * 2)
    kept = g.energy_fallback(x, F.filter(x, lambda v: F.abs(v) > 0.1), least=35)
    return frames(spark, d).select("vec_id", F.size(kept).cast("long").alias("n"))


@query("long_enough", r"WITH c AS (SELECT vec_id // 10 AS recording, vec_id, embedding[1:CAST(vec_id % 64 + 1 AS INTEGER)] AS s FROM embeddings) SELECT vec_id, recording FROM c WHERE len(s) >= 16")
def long_enough(spark, d):
    """Pieces below the least length (here 16 samples) aren't worth a transcription."""
    rows = frames(spark, d).select("vec_id", F.expr("vec_id div 10").alias("recording"), F.slice("embedding", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("s"))
    return rows.where(F.size("s") >= 16).select("vec_id", "recording")


@query(
    "split_at_silence",
    f"""WITH RECURSIVE x AS MATERIALIZED (SELECT vec_id, {D} AS e, len(embedding) AS n FROM embeddings),
t AS (SELECT vec_id, CAST(-1 AS BIGINT) AS part, CAST(0 AS BIGINT) AS "start", CAST(0 AS BIGINT) AS "end" FROM x WHERE n > 0
UNION ALL SELECT vec_id, part + 1, pos, CASE WHEN n - pos <= 25 THEN n WHEN len(l) = 0 THEN least(pos + 29, n) WHEN list_min(l) > 0.05 THEN least(pos + 24 + list_position(l, list_min(l)), n) ELSE pos + 20 + list_position(l, list_min(l)) END
FROM (SELECT t.vec_id, t.part, t."end" AS pos, n, list_transform(range(19, least(31, n - t."end" - 4) - 3), lambda s: round(sqrt(list_sum(list_transform(e[t."end" + s + 1:t."end" + s + 4], lambda v: v * v)) / 4), 12)) AS l FROM t JOIN x USING (vec_id) WHERE t."end" < n))
SELECT vec_id, part, "start", "end" FROM t WHERE part >= 0""",
)
def split_at_silence(spark, d):
    rows = frames(spark, d).select("vec_id", F.posexplode(g.split_at_silence("embedding")).alias("part", "p"))
    return rows.select("vec_id", F.col("part").cast("long").alias("part"), "p.start", "p.end")
