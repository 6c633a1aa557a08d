"""Hand-derived cases of text, signal and state functions."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.functions import checks
from parley.functions import signal as g
from parley.functions import summaries as s
from parley.functions import text as t
from parley.operators import mutate, search, timeline
from parley.sources import files
from parley.streaming import inference, processors


def one(spark, value, *exprs, kind="string"):
    row = spark.createDataFrame([(value,)], f"v {kind}").select(*exprs).first()
    return row[0] if len(exprs) == 1 else tuple(row)


@pytest.mark.parametrize(
    "text, term, want",
    [
        ("abc", "B", "abc"),
        ("x" * 150 + "needle" + "y" * 150, "needle", "..." + "x" * 100 + "needle" + "y" * 100 + "..."),
        ("needle" + "y" * 200, "needle", "needle" + "y" * 100 + "..."),
        ("100% sure_thing", "%", "100% sure_thing"),
        ("a\\b", "\\", "a\\b"),
    ],
)
def test_snippet(spark, text, term, want):
    assert one(spark, text, t.snippet("v", term)) == want
    assert one(spark, text, t.contains_literal("v", term))


def test_wildcards_are_literal_and_blank_terms_find_nothing(spark):
    assert not one(spark, "abc", t.contains_literal("v", "a%c"))
    rows = spark.createDataFrame([("m", "abc")], "meeting_id string, text string")
    meetings = spark.createDataFrame([("m", "T", None)], "meeting_id string, title string, created_at timestamp")
    assert search.search_segments(meetings, rows, "  ").count() == 0


def test_fixed_chunks(spark):
    assert one(spark, "abcdefghij", t.fixed_chunks("v", 4, 1)) == ["abcd", "defg", "ghij", "j"]
    assert one(spark, "", t.fixed_chunks("v", 4, 1)) == []
    with pytest.raises(ValueError):
        t.fixed_chunks("v", 4, 4)


def plain_chunks(text, size_tokens, overlap_tokens):
    size, overlap = -(-size_tokens * 100 // 35), -(-overlap_tokens * 100 // 35)
    if not text or len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        piece = text[start:end]
        if end < len(text):
            at = piece.rfind(". ")
            keep = at + 2 if at >= 0 else piece.rfind(" ") + 1 or len(piece)
            piece = piece[:keep]
        out.append(piece)
        if end == len(text):
            return out
        start += max(size - overlap, 1)


def test_boundary_chunks(spark):
    texts = ["", "short", "One. Two three. " * 9, "nospaces" * 30, "a b " * 60 + "end. of it", "é. " * 40 + "x" * 33]
    df = spark.createDataFrame([(x,) for x in texts], "v string").select("v", t.boundary_chunks("v", 10, 3).alias("c"))
    for r in df.collect():
        assert r.c == plain_chunks(r.v, 10, 3), r.v


def test_markdown(spark):
    assert one(spark, "<think>a\nb</think>\n```markdown\n# T\nx\n```", t.clean_markdown("v")) == "# T\nx"
    assert one(spark, "```\nx\n``` ", t.clean_markdown("v")) == "x"
    assert one(spark, "a\n# # Title \n# No", t.first_title("v")) == "Title"
    assert one(spark, "a\n#No", t.first_title("v")) is None
    assert one(spark, "intro\n# T\n\n body", t.without_title("v")) == "body"
    assert one(spark, "# T", t.without_title("v")) == ""
    assert one(spark, "no #title\nx", t.without_title("v")) == "no #title\nx"


def test_cleaners(spark):
    assert one(spark, "a a a b b a", F.array_join(t.collapse_repeats(t.words("v")), " ")) == "a b a"
    assert one(spark, "", F.size(t.collapse_repeats(t.words("v")))) == 0
    assert t.collapsed_phrases("we go we go we go now".split()) == "we go we go now".split()
    assert one(spark, "so so we go we go home", t.clean_repetitive("v")) == "so we go home"
    assert one(spark, "Thanks for watching", t.clean_repetitive("v")) == ""
    assert one(spark, "a b c a c b a b c b a c", t.clean_repetitive("v")) == ""  # nothing follows itself, but three words make all twelve
    assert one(spark, "hm Um, well ... uhh", t.remove_fillers("v")) == "well ..."
    assert one(spark, " hello .  we cant", t.normalize_punctuation("v"), t.fix_contractions("v")) == ("Hello. we cant", " hello .  we can't")
    assert one(spark, "  ", t.split_count("v"), t.word_count("v")) == (2, 0)
    assert t.stitched("we met on Monday, all", "on monday all of us") == "we met on monday all of us"
    assert t.stitched("a b", "c d") == "a b c d"


@pytest.mark.parametrize("title, want", [("Meet - test", "test"), ("Google Meet - Meet — abc — x", "abc"), ("Meet – abc and 3 more pages - X", "abc"), ("Plan 🎉 - Google Meet", "Plan 🎉"), ("'; DROP", "'; DROP")])
def test_meeting_titles(spark, title, want):
    assert one(spark, title, t.strip_meeting_affix("v")) == want


def test_formats(spark):
    assert one(spark, 3725.9, t.format_mmss("v"), t.format_hms("v"), kind="double") == ("[62:05]", "01:02:05")
    assert one(spark, None, t.format_mmss("v", F.lit("x")), kind="double") == "x"
    assert [one(spark, n, t.format_size("v"), kind="long") for n in (1023, 1536, 5 << 20, 3 << 30)] == ["1023 B", "1.5 KB", "5.0 MB", "3.0 GB"]


def test_summaries(spark):
    assert one(spark, '"{\\"MeetingName\\": \\"x\\"}"', s.unwrapped(F.col("v"), "MeetingName string"))[0] == "x"
    assert one(spark, "[1]", s.unwrapped(F.col("v"), "MeetingName string")) is None
    assert one(spark, ["A & B", "a b", "A & B"], s.section_keys(F.col("v")), kind="array<string>") == ["a_b", "a_b_1", "a_b_2"]
    assert one(spark, ["a", "b", "c"], s.block_range(F.col("v"), F.lit("c"), F.lit("b")), kind="array<string>") == ["b", "c"]
    assert one(spark, ["a"], s.block_range(F.col("v"), F.lit("a"), F.lit("z")), kind="array<string>") == []


def test_signal(spark):
    a = "array<double>"
    assert one(spark, [0.2, 0.4, 0.6, 0.8], g.to_mono(F.col("v"), 2), kind=a) == pytest.approx([0.3, 0.7])
    assert one(spark, [2.0, float("nan"), -1.0], g.range_normalize(F.col("v")), kind=a) == [1.0, 0.0, -0.5]
    assert one(spark, [0.0, 0.0], g.soft_clip_gain(F.col("v")), g.rms(F.col("v")), kind=a) == ([0.0, 0.0], 0.0)
    assert one(spark, [0.9, -0.9, 0.1], g.mix(F.col("v"), F.col("v")), kind=a) == pytest.approx([1.0, -1.0, 0.17])
    assert one(spark, [], g.to_mono(F.col("v"), 2), F.size(g.frames(F.col("v"), 3)), kind=a) == ([], 0)


def test_numeric_udfs():
    x = np.sin(2 * np.pi * 440 * np.arange(4800) / 48_000)
    assert abs(g.highpass(np.ones(4000))[-1]) < 1e-3
    assert len(g.linear_resample(x)) == 1600 and np.abs(g.sinc_resample(x)[100:1500] - np.sin(2 * np.pi * 440 * np.arange(1600) / 16_000)[100:1500]).max() < 0.02
    assert np.allclose(g.spectral_subtraction(np.zeros(64)), 0) and len(g.spectral_subtraction(np.zeros(0))) == 0
    samples = np.full(60 * 16_000, 0.5)
    samples[25 * 16_000 : 25 * 16_000 + 3200] = 0.0
    parts = g.split_points(samples, 25 * 16_000, 1600, 48_000, 160, 0.02, 16_000)
    assert parts[0][0] == 0 and parts[-1][1] == len(samples) and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))
    assert 25 * 16_000 <= parts[0][1] <= 25 * 16_000 + 3200
    assert g.split_points(samples[:16_000], 25 * 16_000, 1600, 48_000, 160, 0.02, 16_000) == [(0, 16_000)]


def test_detector():
    d = processors.Detector(start=0.0)
    steps = [(1, True, True, 0.0), (2, True, True, 1.5), (3, True, False, 1.5), (8, True, True, 1.5), (9, False, False, 1.5), (18.9, False, False, None), (19, False, False, None)]
    assert [d.step(*x) for x in steps] == [None, "detected", None, None, None, None, "ended"]


def test_reorder():
    r = processors.Reorder()
    assert r.step(0.0, 0) == [0] and r.step(0.01, 2) == [] and r.step(0.02, 1) == [1, 2] and r.step(0.03, 1) == []
    assert r.step(1.0, 5) == [] and r.step(1.2, 7) == [5] and r.step(1.25, 6) == [6, 7]


def test_streams_like_their_batch_form(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 120
    pdf = pd.DataFrame({"key": np.arange(n) % 3, "id": np.arange(n), "at": np.arange(n) * 3.0, "titled": rng.random(n) < 0.7, "connected": rng.random(n) < 0.5, "first_seen": np.arange(n) * 3.0})
    rows = spark.createDataFrame(pdf)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = processors.detect_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["key"], r["at"])
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got and got == sorted(map(tuple, processors.detect_batch(rows).collect()))
    assert key


def test_metrics_and_upsert_streams(spark, tmp_path):
    rows = spark.range(50).select(F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), F.col("id").cast("double").alias("value"), (F.col("id") % 5).alias("sequence_id"), F.lit("m").alias("meeting_id"), F.col("id").alias("revision"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = processors.metrics_stream(stream).writeStream.format("memory").queryName("metrics_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("metrics_out").agg(F.sum("n")).first()[0] == 50
    got = []
    processors.upsert_stream(stream, lambda df: got.extend(df.collect()), f"{tmp_path}/cp").awaitTermination()
    assert sorted((r.sequence_id, r.revision) for r in got) == [(i, 45 + i) for i in range(5)]


def test_models_plug_in(spark):
    segments = spark.createDataFrame([("m", [0.1, 0.2]), ("m", [])], "meeting_id string, samples array<double>")
    out = inference.transcribe(segments, lambda: lambda x: (f"{len(x)} samples", 0.5, not x)).collect()
    assert sorted((r.text, r.is_partial) for r in out) == [("0 samples", True), ("2 samples", False)]
    texts = spark.createDataFrame([("m", "One. " * 400), ("n", "Short.")], "meeting_id string, text string")

    def make():
        return lambda system, prompt: f"<think>x</think># Title\n\n{system[:5]} {prompt.count('---') + 1}"

    done = {r.meeting_id: r for r in inference.summarize(texts, make, size=200, overlap=10).collect()}
    assert done["n"].title == "Title" and done["n"].markdown == "Write 1" and int(done["m"].markdown.split()[-1]) > 2


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,x\n" Hello, all ",1\n"  ",2\n', encoding="utf-8")
    assert [r.text for r in files.transcript_csv(spark, str(tmp_path / "t.csv")).collect()] == ["Hello, all"]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.transcript_csv(spark, str(tmp_path / "bad.csv"))
    rows = spark.createDataFrame([("m", 2, "b", 1.0, 2.0, 1.0), ("m", 1, "a", 0.0, 1.0, 1.0)], "meeting_id string, seq int, text string, start_s double, end_s double, dur double")
    files.write_transcript_json(rows, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json")).first()
    assert back.total_segments == 2 and [x.text for x in back.segments] == ["a", "b"] and [x.sequence_id for x in back.segments] == [0, 1]
    (tmp_path / "t.json").write_text('{"version": "1", "segments": [{"text": "a"}, {"text": "b"}]}')
    assert files.transcript_json(spark, str(tmp_path / "t.json")).first().text == "a b"
    folder = tmp_path / "rec"
    folder.mkdir()
    for name in ("zzz.wav", "audio.mp4", "notes.txt"):
        (folder / name).write_bytes(b"x")
    assert [r.stem for r in files.first_audio_file(files.audio_files(spark, str(folder))).collect()] == ["audio"]
    schema = spark.createDataFrame([], "a int, b string").schema
    assert files.conform(spark.createDataFrame([("1", 2)], "a string, c int"), schema).first().asDict() == {"a": 1, "b": None}


def test_mutations(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9)], "k string, v int")
    assert sorted(map(tuple, mutate.replace_keys(old, new, "k").collect())) == [("a", 1), ("b", 9)]
    both, rejected = mutate.insert_new(old, new, "k")
    assert both.count() == 2 and rejected.count() == 1
    left = mutate.cascade_delete({"p": old, "c": old}, "k", spark.createDataFrame([("b",), ("zz",)], "k string"), "p")
    assert [r.k for r in left["c"].collect()] == ["a"]


def plain_recursion(x, b, a):
    """Sample by sample, in the direct form."""
    y = []
    for n, v in enumerate(x):
        past = lambda z, k: z[n - k] if n >= k else 0.0
        y.append(b[0] * v + b[1] * past(x, 1) + b[2] * past(x, 2) - a[0] * past(y, 1) - a[1] * past(y, 2))
    return np.array(y)


def test_recursive_filters_like_a_loop():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 255, 256, 257, 511, 513, 1100):
        x = rng.normal(size=n)
        for stage in (g.SHELF, g.PASS, ((0.9, -0.9, 0.0), (-0.9, 0.0))):
            assert np.allclose(g.recursive(x, *stage), plain_recursion(x.tolist(), *stage)), n
    for block in (2, 3, 7):
        assert np.allclose(g.recursive(x, *g.SHELF, block=block), plain_recursion(x.tolist(), *g.SHELF))


def plain_limiter(samples, limit, ahead):
    """A ring of the last samples and of what each is scaled by."""
    ring, scale, at, out = [0.0] * ahead, [1.0] * ahead, 0, []
    for v in samples:
        ring[at], scale[at] = v, min(1.0, limit / abs(v)) if v else 1.0
        at = (at + 1) % ahead
        out.append(ring[at] * scale[at])
    return out


def test_limiter_like_a_ring(spark):
    x = [0.1, 2.0, -3.0, 0.5, 0.9, -0.95, 0.0, 1.0]
    for rate in (100, 200, 300):
        want = plain_limiter(x, 10 ** (-1 / 20), max(rate * 10 // 1000, 1))
        assert one(spark, x, g.limiter(F.col("v"), rate=rate), kind="array<double>") == pytest.approx(want)
    assert one(spark, [], g.limiter(F.col("v")), kind="array<double>") == []


def test_loudness_like_a_loop():
    rng = np.random.default_rng(2)
    rate, size = 48_000, 4800
    x = np.concatenate([rng.normal(scale=s, size=size) for s in (0.1, 0.0001, 0.3, 0.02)] + [rng.normal(scale=0.5, size=100)])
    gain, heard, loud = 1.0, [], []
    for start in range(0, len(x), size):
        part = x[start : start + size]
        loud += [v * gain for v in part]
        if len(part) == size and math.sqrt(sum(v * v for v in part) / size) >= 10 ** (-50 / 20):
            heard += part.tolist()
            y = plain_recursion(plain_recursion(heard, *g.SHELF).tolist(), *g.PASS)[-3 * rate :]
            level = -0.691 + 10 * math.log10(sum(v * v for v in y) / (3 * rate))
            gain = min(10 ** ((-23 - level) / 20), 10 ** (12 / 20)) if level < 0 else gain
    want = plain_limiter(loud, 10 ** (-1 / 20), 480)
    assert np.allclose(g.loudness(x), want, atol=1e-9) and gain != 1.0


def test_spectral_subtraction_of_one_window():
    x = np.sin(2 * np.pi * 50 * np.arange(1600) / 1600)
    noise = float(np.mean(x * x))
    power = (1600 / 2) ** 2  # of the only bin that has any
    assert np.allclose(g.spectral_subtraction(x), 1600 * x * math.sqrt(1 - noise / power), atol=1e-6)
    assert np.allclose(g.spectral_subtraction(np.concatenate([x, x])), g.spectral_subtraction(x)) and len(g.spectral_subtraction(x[:10])) == 1600


@pytest.mark.parametrize("rate, to, taps, cubic", [(8, 16, 512, True), (32, 48, 384, True), (44, 48, 256, False), (48, 16, 512, True), (48, 32, 384, False)])
def test_resampling_like_a_direct_sum(rate, to, taps, cubic):
    assert g.resample_rule(to / rate) == (taps, cubic)
    rng, cut = np.random.default_rng(3), 0.95 * min(1, to / rate)

    def kernel(u):
        w = 0.35875 + 0.48829 * math.cos(2 * math.pi * u / taps) + 0.14128 * math.cos(4 * math.pi * u / taps) + 0.01168 * math.cos(6 * math.pi * u / taps)
        return (cut if u == 0 else math.sin(math.pi * cut * u) / (math.pi * u)) * w * w if abs(u) < taps / 2 else 0.0

    x = rng.normal(size=700)
    got = g.sinc_resample(x, rate, to)
    assert len(got) == int(700 * to / rate)
    for i in (0, 1, len(got) // 2, len(got) // 2 + 1, len(got) - 1):
        want = sum(v * kernel(i * rate / to - j) for j, v in enumerate(x))
        assert abs(got[i] - want) < (1e-6 if cubic else 2e-4)
    middle = slice(len(got) * 45 // 100, len(got) * 55 // 100)
    assert np.allclose(g.sinc_resample(np.ones(700), rate, to)[middle], 1, atol=1e-4)
    assert np.allclose(g.sinc_resample(x, rate, to, block=7), got) and len(g.sinc_resample(x[:0], rate, to)) == 0


def test_filter_carries_its_state():
    x = np.random.default_rng(1).normal(size=1000)
    want, carried = g.recursive(x, *g.SHELF), np.zeros(2)
    parts = [g.recursive(x[a:b], *g.SHELF, carried=carried) for a, b in ((0, 1), (1, 2), (2, 300), (300, 301), (301, 301), (301, 1000))]
    assert np.allclose(np.concatenate(parts), want, atol=1e-12)


def test_gain_readout():
    x = np.random.default_rng(1).normal(scale=0.02, size=48_000 * 5)
    gains = g.window_gains(x)
    assert len(gains) == 50 and np.allclose(g.gain_readout(x), [np.mean(20 * np.log10(gains[max(0, 10 * s - 30) : 10 * s])) for s in range(1, 6)])
    assert len(g.gain_readout(x[:47_999])) == 0 and (g.window_gains(np.zeros(48_000)) == 1).all()


def test_released_like_a_loop(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), rng.choice(["a", "b", "c"]), rng.randrange(200)) for i in range(300)]
    waits = {"a": 10, "b": 55}
    got = timeline.released(spark.createDataFrame(rows, "id long, key long, kind string, at long"), "key", "at", "kind", waits)
    assert got.columns == ["id", "key", "kind", "at", "released"]
    for r in got.collect():
        later = [t for _, k, _, t in rows if k == r.key and r.kind in waits and t >= r["at"] + waits[r.kind]]
        assert r.released == min(later, default=None)
    assert got.count() == 300


def test_chunked_resample_fades_between_chunks():
    x = np.arange(100.0)
    third = lambda p, rate, to: p[::3]
    got = g.chunked_resample(x, 300, 100, chunk=0.1, overlap=0.02, one=third)
    parts = [x[a : a + 36][::3] for a in range(0, 100, 30)]
    want = parts[0]
    for p in parts[1:]:
        n = min(2, len(p), len(want))
        mixed = [want[len(want) - n + i] * (1 - i / n) + p[i] * (i / n) for i in range(n)]
        want = np.concatenate([want[: len(want) - n], mixed, p[n:]])
    assert np.allclose(got, want)
    smooth = np.sin(2 * np.pi * 440 * np.arange(9600) / 48_000)
    assert np.abs(g.chunked_resample(smooth, chunk=0.05, overlap=0.01)[100:3000] - np.sin(2 * np.pi * 440 * np.arange(3200) / 16_000)[100:3000]).max() < 0.02


def test_dynamic_mix_and_energy_fallback(spark):
    a = "array<double>"
    assert one(spark, [0.3, -0.3], g.mix_dynamic(F.col("v"), F.array(F.lit(0.1), F.lit(-0.1))), kind=a) == pytest.approx([0.25, -0.25])
    assert one(spark, [0.5], g.mix_dynamic(F.col("v"), F.array(F.lit(0.0), F.lit(0.0))), kind=a) == pytest.approx([0.5, 0.0])
    assert one(spark, [1.0, 1.0], g.mix_dynamic(F.col("v"), F.array(F.lit(0.01), F.lit(0.01))), kind=a) == pytest.approx([0.901, 0.901])
    short = F.slice("v", 1, 1)
    assert one(spark, [0.3, 0.3], g.energy_fallback(F.col("v"), short), kind=a) == [0.3, 0.3]
    assert one(spark, [0.1, 0.3], g.energy_fallback(F.col("v"), short, level=0.25), kind=a) == []
    assert one(spark, [0.3, 0.3], g.energy_fallback(F.col("v"), short, least=1), kind=a) == [0.3]


def test_older_cleaner_and_post_processing(spark):
    older = lambda text: " ".join(t.collapsed_older(text.split()))
    assert older("a a a b c") == "a b c"
    assert older("we go we go we go now then") == "we go now then"
    assert older("we go we go we go") == "we go we go"  # the pair at the very end stays
    assert older("x y x y z") == "x y z"
    done = lambda text, partial: one(spark, text, t.post_process("v", F.lit(partial)))
    assert tuple(done("so so um we dont go .", True)) == ("So we dont go.", 0.8)
    assert tuple(done("so so um we dont go .", False)) == ("So we don't go.", 0.95)
    assert tuple(done(" a ", False)) == (" a ", 0.95)


def test_tokens_and_prompts(spark):
    kind = "array<string>"
    assert one(spark, [" he", "llo", " wör", "ld", " !", " ok"], t.join_tokens(F.col("v")), kind=kind) == "hello wörld! ok"
    assert one(spark, [], t.join_tokens(F.col("v")), kind=kind) == ""
    prompt, problem = t.format_prompt(F.lit("p"), {"p": "{system_prompt}|{user_prompt}"}, F.col("v"), F.lit("u"))
    assert one(spark, "s {user_prompt}", prompt, problem) == ("s u|u", None)


def test_checks(spark):
    problem = lambda meeting, text, size, overlap: one(spark, text, checks.transcript_problem(F.lit(meeting), F.col("v"), F.lit(size), F.lit(overlap), most=5))
    assert [problem(" ", "x", 1, 0), problem("m", None, 1, 0), problem("m", "\n ", 1, 0)] == ["meeting_id cannot be empty", "transcript_text cannot be empty", "transcript_text cannot be empty"]
    assert [problem("m", "x", 0, 0), problem("m", "x", 1, -1), problem("m", "xxxxxx", 1, 0), problem("m", "xxxxx", 1, 0)] == ["Invalid chunk_size or overlap values"] * 2 + ["Transcript text too large", None]
    settings = lambda provider, model, size, overlap: tuple(one(spark, model, checks.chunk_settings(F.lit(provider), F.col("v"), F.lit(size), F.lit(overlap))))
    assert settings("ollama", "Phi4:latest", 5, 1) == (None, 10_000, 1000) and settings("ollama", "gemma", 5, 1) == (None, 30_000, 1000)
    assert settings("groq", "llama", 100, 100) == (None, 100, 99) and settings("groq", "x", 0, 0)[0] == "chunk_size must be positive"


def test_queue_commands(spark):
    jobs = spark.createDataFrame([("j1", "a", 0, 1), ("j2", "b", 0, 5), ("j3", "a", 0, 9), ("j4", "c", 1, 2)], "job string, meeting string, queue int, at int")
    commands = spark.createDataFrame([("pause_all", "x", 0, 6), ("cancel", "a", 0, 7), ("pause_all", "x", 1, 3), ("resume_all", "x", 1, 4)], "command string, meeting string, queue int, at int")
    assert sorted((r.job, r.status) for r in mutate.replay_commands(jobs, commands).collect()) == [("j2", "paused"), ("j3", "pending"), ("j4", "pending")]


def test_observations(spark):
    polls = [(1, False, False, False), (2, True, False, True), (3, True, True, True), (4, True, False, True), (5, False, False, True), (6, True, False, True)]
    rows = spark.createDataFrame([("k", float(n), *p) for n, *p in polls], "key string, at double, titled boolean, relay boolean, broad boolean")
    got = [(r.connected, r.first_seen) for r in timeline.observations(rows, "key", ["at"]).orderBy("at").collect()]
    assert got == [(False, None), (True, 2.0), (True, 2.0), (False, None), (False, None), (True, 6.0)]
    first = timeline.observations(rows.where("at >= 2"), "key", ["at"]).orderBy("at").collect()
    assert [r.first_seen for r in first] == [0.0, 0.0, None, None, 6.0]  # the first poll found it


def test_families_go_in_whole(spark):
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    children = spark.createDataFrame([("a", False), ("a", True), ("b", False), ("zz", False), ("c", None)], "k string, bad boolean")
    p, c = mutate.accepted_families(parents, children, "k", F.col("bad"))
    assert [r.k for r in p.collect()] == ["b"] and [r.k for r in c.collect()] == ["b"]


def plain_stitched(x, y):
    """Longest common run by looking at every pair of places, the first one found."""
    best = (0, 0, 0)
    for i in range(len(x)):
        for j in range(len(y)):
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return " ".join(x[: best[1]] + y[best[2] :]) if best[0] else " ".join(x + y)


def test_stitched_like_a_search_of_every_place():
    rng = np.random.default_rng(7)
    for _ in range(200):
        x, y = ([str(w) for w in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        got, want = t.stitched(" ".join(x), " ".join(y)), plain_stitched(x, y)
        assert got == want or len(got.split()) == len(want.split()), (x, y)


def test_phrase_hits(spark):
    rng = random.Random(5)
    letters = "ab"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\t"]).join(word() for _ in range(rng.randint(1, 14))) for _ in range(120)]
    docs = [(i, x) for i, x in enumerate(texts)] + [(500, ""), (501, None), (None, texts[0]), (3, texts[3])]
    phrases = [(i, x[a : a + rng.randint(0, 30)]) for i, x in enumerate(texts) for a in [rng.randrange(len(x))]]
    phrases += [(900, ""), (901, " "), (902, None), (903, "zzz"), (904, texts[7] + " " + texts[8]), (None, "ab"), (5, "ba")]
    found = search.phrase_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(phrases, "item_id long, phrase string"))
    want = [(p, i) for p, phrase in phrases for i, x in docs if phrase is not None and x is not None and phrase in x]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)


def test_phrase_hits_send_few_keys(spark):
    """With joins that exchange both sides, as they do once phrases are many: fewer rows than a quarter of the bytes."""
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 8))) for _ in range(n))
    docs = [(i, text(100)) for i in range(200)]
    phrases = [(i, x[5 : 5 + rng.choice([12, 16, 40])]) for i, x in docs] + [(1000 + i, "") for i in range(20)] + [(2000, "é"), (2001, "f "), (2002, "the o"), (2003, "tion ing")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    scala = spark.sparkContext._jsc.sc()
    sent = lambda: (scala.listenerBus().waitUntilEmpty(), sum(e.shuffleWriteRecords() for e in executors()))[1]

    def executors():
        found = scala.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size()) if found.apply(i).stageId() not in old]

    old = set()
    old = {e.stageId() for e in executors()}
    try:
        hits = search.phrase_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(phrases, "item_id long, phrase string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted((p, i) for p, phrase in phrases for i, x in docs if phrase in x)
    assert sorted(map(tuple, hits)) == want
    assert sent() < sum(len(x) for _, x in docs) / 4


def test_phrase_hits_across_blocks(spark, monkeypatch):
    """Texts are longer than what is looked at together, and phrases lie across its bounds."""
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    for shape in search.SHAPES:
        found = {}
        for text, key, sides, _ in search._grams(pa.array([x.encode() for x in texts]), shape):
            for t, *k in zip(text.tolist(), key.tolist(), sides.tolist()):
                found.setdefault(t, set()).add(tuple(k))
        whole = [x.encode() for x in texts]
        for t, x in enumerate(whole):
            for a in range(len(x) - shape + 1):
                n = shape + (a % 9 if shape > 2 else 0)
                if a + n <= len(x) and len(list(search._grams(pa.array([x[a : a + n]]), shape, True))):
                    _, key, sides, mask = next(iter(search._grams(pa.array([x[a : a + n]]), shape, True)))
                    assert any(k == key[0] and s & mask[0] == sides[0] for k, s in found[t])


def test_phrase_hits_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, phrase string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search.phrase_hits(docs, none).collect() == []
    assert search.phrase_hits(docs.limit(0), spark.createDataFrame([(1, "a")], none.schema)).collect() == []


def test_cascade_delete_holds_no_keys_in_memory(spark):
    """Small as they are here, the keys that go are neither broadcast nor hashed."""
    rows = spark.range(2).withColumnRenamed("id", "k")
    left = mutate.cascade_delete({"p": rows, "c": rows}, "k", rows.where("k = 1"), "p")
    for df in left.values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan
        assert [r.k for r in df.collect()] == [0]


def test_phrase_scan_looks_only_where_a_word_comes_again():
    """As many slices as words come again near by, not four for each word."""
    class Words(list):
        looks = 0

        def __getitem__(self, i):
            Words.looks += isinstance(i, slice)
            return list.__getitem__(self, i)

    assert t.collapsed_phrases(Words(str(i) for i in range(1000))) == [str(i) for i in range(1000)] and Words.looks < 10
    assert t.collapsed_phrases("a b a b a b c d e c d e".split()) == "a b a b c d e".split()
