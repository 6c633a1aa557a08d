import random
import re

import corpus_pipeline
from parley.llm import common, langid, pii
from tests.llm.test_jaccard import brute, near_copies


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "mail me at jo.b@site.org " + t if i % 9 == 0 else t) for i, t in near_copies(rng, 150)]
    rows += [(500, None), (501, "12 34 -- !!"), (502, ""), (503, rows[5][1].upper())]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    left = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    exact = {}
    for i, t in left:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        exact[low] = max(exact.get(low, (-1, "")), (i, t))
    exact = sorted(exact.values())
    near = {c for _, _, c in brute(exact)}
    final = {i: pii.redacted(t) for i, t in exact if i in near}

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [dict(left), dict(exact), {i: t for i, t in exact if i in near}, final]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        now = common.stored(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns, name
        assert {r.doc_id: r.text for r in now.collect()} == expected, name
        assert now.count() == len(expected), name
    assert all("@" not in t for t in final.values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == set(final)
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_null_ids_long_texts_and_clashing_columns_go_through_all_stages(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, twin, copy = text(300_000), text(200), text(80)
    rows = [(i, text(100)) for i in range(60)] + [(None, text(50)), (None, text(60)), (100, long), (101, twin), (102, twin + " more"), (103, copy), (104, copy.upper()), (103, copy), (None, copy)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t), "d", 1, 2.0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_key int, score double, row_key string")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.stored(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns, name
    left = [(r.doc_id, r.text) for r in now.collect()]
    want = [r for r in rows[:62]] + [(100, long), (101, twin), (104, copy.upper())]
    assert sorted(left, key=str) == sorted(want, key=str)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).toPandas()
    assert pieces.length.sum() == pieces.drop_duplicates(["doc_id", "doc_tokens"]).doc_tokens.sum() or pieces.doc_id.isna().any()
    assert set(pieces.doc_id.dropna()) == {i for i, _ in want if i is not None}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_spans(spark):
    en, de = "the house is over there and we walk", "das haus ist dort drüben und wir gehen"
    docs = spark.createDataFrame([(i, (en if i % 2 else de) + " " + str(i), ("en" if i % 2 else "de")) for i in range(200)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    mixed = spark.createDataFrame([(1, f"{en} {en} {de} {de} {de}"), (2, None), (3, "42"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(mixed, model, spans=True).collect()}
    assert got[1].lang_pred == "de" and [s.lang for s in got[1].spans] == ["en", "de"] and got[1].spans[0].last_word == 15
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0
    assert {r.lang_pred for r in langid.predict(mixed, None).collect()} == {"und"}
    assert langid.learn(docs.limit(0)) is None


def test_scripts_narrow_candidates(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("дом стоит там", "ru"), ("das haus steht", "de"), ("το σπιτι ειναι", "el")] * 30)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    found = spark.createDataFrame([(1, "ъъъ жжж"), (2, "zzz qqq"), (3, "ωωω")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(found, model).orderBy("doc_id").collect()] == ["ru", "de", "el"]
