"""The classifiers against plain loops over the same definitions."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from parley.llm import common, langid, quality, toxicity


def plain_viterbi(scores, switch):
    """Best labels of one document's words by dynamic programming over every pair of languages."""
    best = [(float(s), [k]) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((b + (0 if j == k else -switch) + float(s), path + [k]) for j, (b, path) in enumerate(best)), key=lambda c: c[0]) for k, s in enumerate(row)]
    return max(best, key=lambda c: c[0])


def path_score(scores, labels, switch):
    return sum(float(s[k]) for s, k in zip(scores, labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:]))


def test_viterbi_like_plain_dynamic_programming():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 7, 30, 3, 0, 12]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    scores = rng.normal(scale=4, size=(len(doc), 4)).astype(np.float32)
    label = langid.viterbi(scores, doc, len(sizes), switch=3.0)
    for d in set(doc.tolist()):
        mine = scores[doc == d]
        assert path_score(mine, label[doc == d].tolist(), 3.0) == pytest.approx(plain_viterbi(mine, 3.0)[0], abs=1e-3)


def plain_language(texts, model, switch=langid.SWITCH):
    """Language and share of each text, word by word from trigrams of bytes."""
    out = []
    for text in texts:
        words = [w for w in langid.NOT_LETTER.split((text or "").lower()) if w]
        if not words:
            out.append(("und", 0.0))
            continue
        rows = []
        for w in words:
            data = b" " + w.encode() + b" "
            code = np.frombuffer(data, np.uint8).astype(np.uint32)
            c = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
            c = ((c ^ (c >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
            script = langid.CODES[np.searchsorted(langid.STARTS, ord(w[0]), side="right") - 1]
            ok = model.allowed[script] if model.allowed[script].any() else np.ones(len(model.langs), bool)
            rows.append(np.where(ok, model.table[c].sum(axis=0), -1e4))
        labels = plain_viterbi(rows, switch)[1]
        weight = collections.Counter()
        for w, k in zip(words, labels):
            weight[k] += len(w.encode())
        k = max(range(len(model.langs)), key=lambda j: weight[j])
        out.append((model.langs[k], weight[k] / sum(weight.values())))
    return out


WORDS = {"en": "the house is over there and we walk home with them".split(), "de": "das haus ist dort drüben und wir gehen nach hause".split(), "ru": "дом стоит там и мы идём домой".split()}


def test_identify_like_plain_loops(spark):
    rng = random.Random(2)
    make = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, make(lang, 12), lang) for i in range(300) for lang in [rng.choice(list(WORDS))]]
    rows += [(400, make("en", 4) + " " + make("de", 9) + ", " + make("ru", 3), None), (401, None, "en"), (402, "", "de"), (403, "42 --", "ru"), (404, make("de", 20_000), None)]
    rows += [(405, "THE House", "en"), (405, "THE House", "en"), (None, "das Haus", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, "z", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    model = langid.learn(langid.teachers(docs))
    found = langid.identify(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2, lang, round(s, 6)) for (i, _, _), (lang, s) in zip(rows, plain_language([r[1] for r in rows], model))]
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in found.collect()), key=str) == sorted(want, key=str)
    assert langid.identify(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, "alpha beta", f"junk{i}") for i in range(40)] + [(100 + i, "gamma delta", "en") for i in range(5)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=3)
    assert set(model.langs) == {f"junk{i}" for i in range(40)} | {"en"}


def test_shares_of_huge_tables():
    assert common.share_bound(4000, 4000) == common.share_bound(9000, 5) == common.share_bound(3, 0) == (1 << 63) - 1
    for wanted, total in ((4000, 10**10), (9000, 10**12), (3000, 10**15)):
        assert abs(common.share_bound(wanted, total) * total / 2**63 / wanted - 1) < 1e-3
    assert common.share_bound(1, 1 << 63) >= 1


def test_long_texts_in_pieces_like_in_one(spark, monkeypatch):
    en, de = "the house is over there and we walk", "das haus ist dort drüben und wir gehen"
    model = langid.learn(spark.createDataFrame([(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string"))
    rng = random.Random(4)
    text = " ".join(rng.choice([en, en, de, de, de, "42, 17 --", "ωψξ", "xqzw vvkq"]) for _ in range(300)) + " " + "a" * 3000
    for flat in (False, True):
        whole = langid.letters(model, [text], flat, spans=True)
        assert len(whole[1][0]) > 20
        monkeypatch.setattr(langid.Model, "block", lambda self: 200)
        got = langid.letters(model, [text], flat)
        plain = [langid.letters(model, [text[:-3001]], flat, spans=True)]
        monkeypatch.undo()
        want = langid.letters(model, [text[:-3001]], flat, spans=True)
        assert (plain[0][0] == want[0]).all() and plain[0][1] == want[1]
        assert got[0].sum() == whole[0].sum()  # the one long word counts as several
    assert langid.pieces("", 5) == [] and langid.pieces("abc", 5) == [(0, 3)]
    cuts = langid.pieces("ab cd " * 10 + "x" * 40, 8)
    assert cuts[0][0] == 0 and cuts[-1][1] == 100 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and max(b - a for a, b in cuts) <= 16


def test_texts_in_no_language_go(spark):
    rng = random.Random(2)
    words = {lang: ["".join(rng.choice(abc) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, abc in (("en", "etaoinsh"), ("de", "enisratü"))}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, make(lang := rng.choice(["en", "de"]), 200), lang) for i in range(300)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    rows = [(1, make("en", 30), "x"), (2, make("de", 1), "x"), (3, "xqz wvk jjq pqx zzkw qqvj " * 5, "x"), (4, "Ωψξ ζηθ", "x"), (5, "42 !!", "x"), (6, None, "x"), (7, make("en", 5) + " xqzwvk jjqpqx", "x"), (8, make("en", 400_000), "x"), (None, make("de", 9), "x")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    kept = langid.drop_unknown(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {1, 2, 7, 8, None}
    assert {r.doc_id for r in langid.drop_unknown(table, None).collect()} == {1, 2, 3, 4, 7, 8, None}


def test_documents_in_no_language_are_dropped(spark):
    model = langid.learn(spark.createDataFrame([(i, " ".join(WORDS[k]), k) for i, k in enumerate(list(WORDS) * 30)], "doc_id long, text string, lang string"))
    texts = ["the house is over there", "12 --", None, " ".join(sum(([w] * 8 for w in ("the", "дом", "drüben")), []))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in langid.drop_unknown(docs, model).collect()) == [0, 3]
    assert sorted(r.doc_id for r in langid.drop_unknown(docs, model, least=0.9).collect()) == [0]


def plain_discriminant(x, y, rows):
    """Posterior of class 1 by log-densities from the inverse and determinant of each shrunk covariance."""
    d, logs, covs = len(x[0]), [], []
    parts = [np.array([v for v, c in zip(x, y) if c == k]) for k in (0, 1)]
    for p in parts:
        mean = p.mean(axis=0)
        covs.append(sum(np.outer(v - mean, v - mean) for v in p) / len(p))
    pooled = sum(len(p) * c for p, c in zip(parts, covs)) / len(x)
    for p, cov in zip(parts, covs):
        cov = (1 - quality.SHRINK_POOLED) * cov + quality.SHRINK_POOLED * pooled
        cov = (1 - quality.SHRINK_SPHERE) * cov + quality.SHRINK_SPHERE * np.trace(cov) / d * np.eye(d)
        inverse, mean = np.linalg.inv(cov), p.mean(axis=0)
        logs.append([math.log(len(p) / len(x)) - 0.5 * (v - mean) @ inverse @ (v - mean) - 0.5 * np.linalg.slogdet(cov)[1] for v in rows])
    return [1 / (1 + math.exp(min(a - b, 500))) for a, b in zip(*logs)]


def test_quality_like_plain_discriminant(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta,", "g4mma", "x|y", "delta."]) for _ in range(rng.randint(1, 60))) + ("\n" * rng.randint(0, 3))) for i in range(150)]
    labels = [(i, int(rng.random() < 0.6)) for i in range(150)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    teach = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5]
    x = {i: quality.statistics(t) for i, t in rows}
    want = plain_discriminant([np.array(x[i]) for i in teach], [labels[i][1] for i in teach], [np.array(x[i]) for i in range(150)])
    got = {r.doc_id: r.score for r in quality.assess(docs, lab).collect()}
    assert max(abs(got[i] - want[i]) for i in range(150)) < 1e-6


def plain_risk(w, b, x_p, x_u, prior):
    """The non-negative risk and its gradient by central differences of the branch that counts."""
    loss = lambda z, y: math.log1p(math.exp(-y * z)) if y * z > -30 else -y * z
    mean = lambda x, y, w, b: sum(loss(float(r @ w) + b, y) for r in x) / len(x)
    rest = lambda w, b: mean(x_u, -1, w, b) - prior * mean(x_p, -1, w, b)
    part = (lambda w, b: prior * mean(x_p, 1, w, b) + rest(w, b)) if rest(w, b) >= 0 else (lambda w, b: -rest(w, b))
    e = 1e-5
    grad = [(part(w + e * d, b) - part(w - e * d, b)) / (2 * e) for d in np.eye(len(w))]
    return np.array([*grad, (part(w, b + e) - part(w, b - e)) / (2 * e)])


def test_toxicity_training_like_plain_risk():
    rng = np.random.default_rng(4)
    for prior, steps in ((0.3, 25), (0.9, 25)):
        x_u = (rng.random((60, 4)) < 0.4).astype(float)
        x_p = (rng.random((20, 4)) < [0.9, 0.5, 0.4, 0.1]).astype(float)
        w, b = np.zeros(4), math.log(prior / (1 - prior))
        m, v = np.zeros(5), np.zeros(5)
        for t in range(1, steps + 1):
            grad = plain_risk(w, b, x_p, x_u, prior)
            grad[:4] += 1e-4 * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:4], b - step[4]
        got_w, got_b = toxicity.non_negative_pu(x_p, x_u, prior, steps=steps)
        assert np.allclose(got_w, w, atol=1e-3) and abs(got_b - b) < 1e-3


def test_repeated_documents_fill_no_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "vile vile")] * 5000 + [(i, f"house tree {i}") for i in range(2, 200)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 200)], "doc_id long, toxic int")
    seen = []
    plain = toxicity.with_words
    monkeypatch.setattr(toxicity, "with_words", lambda rows: seen.append(rows.count()) or plain(rows))
    toxicity.learn(docs, labels)
    assert seen[0] <= 199
