import collections
import math
import random

from parley.llm import lm_score


def brute(rows, least=lm_score.LEAST, alpha=0.4):
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for _, w in words:
        one.update(w)
        two.update(zip(w, w[1:]))
    total, out = sum(one.values()), []
    for i, w in words:
        log = 0.0
        for n, v in enumerate(w):
            u = w[n - 1] if n else None
            pair = two[(u, v)] if n else 0
            log += math.log(pair / one[u] if pair >= least else (alpha if n else 1.0) * one[v] / total)
        out.append((i, len(w), round(log, 6)))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    rng = random.Random(6)
    words = ["The", "the", "of", "and", "é", "É", "x1", "rare%d"]
    rows = [(i, " ".join(w.replace("%d", str(rng.random())) for w in rng.choices(words, k=rng.choice([0, 1, 2, 40, 400])))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (3, rows[3][1]), (None, "the of")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_score.score(docs).collect()), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in brute(rows)]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, brute(rows)))
    assert lm_score.score(docs.limit(0)).count() == 0
    for least in (1, 2):
        want, plain = brute(rows, least), lm_score.score_rows(docs, least).collect()
        assert [(r.doc_id, r.n_words) for r in sorted(plain, key=lambda r: str((r.doc_id, r.n_words, round(r.log_score, 6))))] == [w[:2] for w in want]
        assert sorted(round(r.log_score, 3) for r in plain) == sorted(round(w[2], 3) for w in want)


def test_pairs_that_occur_once(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "lone"), (4, None), (5, "on the dog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 2, 3):
        got = sorted((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_score.score(docs, least=least).collect())
        assert got == brute(rows, least=least), least


def test_very_long_and_repeated_texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(rng.choices(words, k=120_000))), (2, "w1 w2 w3"), (2, "w1 w2 w3"), (3, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.log_score) for r in lm_score.score(docs).collect())
    want = brute(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-6 * max(1, abs(w[2])) for g, w in zip(got, want))
