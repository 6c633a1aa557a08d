import random
import zlib

import numpy as np

from parley.llm import quality, toxicity


def corpus(spark, n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "house", "tree"]) + rng.choice(["", "s", ","]) for _ in range(rng.randint(3, 200))]
        bad, rude = rng.random() < 0.2, rng.random() < 0.2
        if bad:
            words = [w + rng.choice(["&&&", "###", "$$$"]) for w in words]
        if rude:
            words[rng.randrange(len(words))] = rng.choice(["VILE", "nasty,", "nasty"])
        rows.append((i, " ".join(words), 1))
        if rng.random() < 0.8:
            labels.append((i, int(not bad), int(rude)))
    rows += [(10_000, None, 1), (10_001, "", 1), (10_002, "x" * 200_000, 1), (3, rows[3][1], 1), (None, "null id", 1)]
    labels += [(3, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(found, labels, column):
    rows = found.toPandas().merge(labels.toPandas().dropna(), on="doc_id")
    rows = rows[rows.held_out]
    assert len(rows) > 40
    return float((rows.predicted == rows[column]).mean())


def test_quality(spark):
    docs, labels = corpus(spark)
    found = quality.assess(docs, labels)
    assert found.count() == docs.count() and held_out(found, labels, "quality") > 0.95
    rows = found.toPandas()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    assert all(h == (zlib.crc32(str(int(d)).encode()) % 5 == 0) for d, h in zip(rows.doc_id, rows.held_out) if d == d)
    assert {r.score for r in quality.assess(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.assess(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    docs, labels = corpus(spark)
    found = toxicity.assess(docs, labels)
    assert found.count() == docs.count() and held_out(found, labels, "toxic") > 0.9
    assert found.toPandas().score.between(0, 1).all()
    assert {r.score for r in toxicity.assess(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.assess(docs.limit(0), labels).count() == 0


def test_unlabelled_sample_holds_positives_in_the_share_of_the_prior(spark, monkeypatch):
    rng, seen = random.Random(4), []
    rude = [rng.random() < 0.2 for _ in range(1500)]
    docs = spark.createDataFrame([(i, ("vile " if r else "") + f"house tree {i}") for i, r in enumerate(rude)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(r)) for i, r in enumerate(rude)], "doc_id long, toxic int")
    plain = toxicity.non_negative_pu
    monkeypatch.setattr(toxicity, "non_negative_pu", lambda x_p, x_u, prior: seen.append((x_p, x_u, prior)) or plain(x_p, x_u, prior))
    toxicity.learn(docs, labels, unlabelled=750)
    x_p, x_u, prior = seen[0]
    assert len(x_p) == sum(rude) and 600 < len(x_u) < 900
    assert abs(x_u.any(axis=1).mean() - prior) < 0.05


def test_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    x = np.stack([truth & (rng.random(4000) < 0.9), rng.random(4000) < 0.5], axis=1).astype(float)
    w, b = toxicity.non_negative_pu(x[truth][:400], x, 0.3)
    score = x @ w + b
    assert ((score > 0) == (x[:, 0] > 0)).all()
