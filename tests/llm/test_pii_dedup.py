import hashlib
import random
import re

from parley.llm import exact_dedup, pii


def naive(text):
    text = text or ""
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_base_spans_like_the_plain_patterns(spark):
    rng = random.Random(11)
    pools = ["a.b@c.de", "@", ".", "1", "192.168.0.1", "4111 1111 1111 1111", "+1 (706) 555-3138", " ", "-", "x", "256.1.1.1", "é", "+", "0", "DE89 3704 0044 0532 0130 00"]
    texts = ["".join(rng.choice(pools) for _ in range(rng.randint(0, 25))) for _ in range(500)] + [None, "", "1." * 3000, "a" * 50_000 + "@b.c"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for r in pii.find(docs).collect():
        want = naive(texts[r.doc_id])
        names = [f"{k}:{a}:{b}" for k in pii.BASE for a, b in want[k]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r.spans.split(",")[: len(names)] == names or not names
    assert pii.find(docs.limit(0)).count() == 0


def test_added_kinds_and_redaction(spark):
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == ["iban"]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01") == []
    assert kinds("his social security number is 219-09-9999") == ["ssn"] and kinds("part 219-09-9999") == []
    assert pii.redacted("write to a@b.co or call +1 (706) 555-3138 now") == "write to [EMAIL] or call [PHONE] now"
    docs = spark.createDataFrame([(1, "a@b.co", 6, "x"), (2, None, None, "y"), (3, "clean", 99, None)], "doc_id long, text string, n_chars long, email string")
    assert sorted(map(tuple, pii.redact(docs).collect())) == [(1, "[EMAIL]", 7, "x"), (2, None, None, "y"), (3, "clean", 99, None)]


def test_context_words_are_whole_and_on_either_side():
    score = lambda t, kind: next((s for k, _, _, s in pii.spans_of(t) if k == kind), None)
    assert score("the ship 10.0.0.1 sails", "ip") == 0.6 and score("the ip 10.0.0.1 answers", "ip") == 0.9
    assert score("10.0.0.1 is the server", "ip") == 0.9 and score("10.0.0.1 " + "x " * 30 + "server", "ip") == 0.6
    assert score("version 10.0.0.1", "ip") == 0.3 and score("hotel +1 (706) 555-3138", "phone") == 0.6
    assert score("219-09-9999 is my social security number", "ssn") == 0.7
    assert score("serial 219-09-9999 for tax", "ssn") is None and score("ssn 219-09-9999", "ssn") == 0.7


def test_ibans_before_capital_or_numeric_words():
    spans = lambda t: [t[a:b] for k, a, b, _ in pii.spans_of(t) if k == "iban"]
    belgian, german = "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"
    for after in ("", " EUR", " 50", " A", " EURO", " EUR 50", " PAID", "."):
        assert spans(f"to {belgian}{after}") == [belgian], after
        assert pii.redacted(f"to {belgian}{after}") == f"to [IBAN]{after}"
    assert spans(f"{belgian} {german} {belgian} EUR") == [belgian, german, belgian]
    assert spans(f"AB12 3456 7890 {german}") == [german]
    assert spans("BE68539007547034EUR") == [] and spans("BE68 5390 0754 7035 EUR") == []


ROWS = [(1, "Same"), (2, "same"), (3, "SAME"), (4, "É"), (5, "é"), (6, None), (7, ""), (3, "SAME"), (None, "same"), (None, "lone"), (9, "x" * 100_000)]


def test_exact_groups(spark):
    docs = spark.createDataFrame([(*r, "z") for r in ROWS], "doc_id long, text string, digest string")
    got = sorted(map(tuple, exact_dedup.assign(docs).drop("text_sha256").collect()), key=str)
    want = [(1, 3, 5, False), (2, 3, 5, False), (3, 3, 5, True), (3, 3, 5, False), (None, 3, 5, False), (4, 4, 1, True), (5, 5, 1, True), (6, 7, 2, False), (7, 7, 2, True), (None, None, 1, True), (9, 9, 1, True)]
    assert got == sorted(want, key=str)
    kept = exact_dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 4, 5, 7, None, 9], key=str)
    assert exact_dedup.assign(docs.limit(0)).count() == 0


def test_index_drops_what_it_has(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(5, "A"), (6, "c"), (7, "c")], "doc_id long, text string")
    exact_dedup.assign(first, index).collect()
    got = sorted(tuple(r)[:4] for r in exact_dedup.assign(second, index).collect())
    assert got == [(5, 1, 1, False), (6, 7, 2, False), (7, 7, 2, True)]
    assert index.rows().count() == 3
    again = exact_dedup.DigestIndex(spark, path=index.path, buckets=3)
    assert again.rows().count() == 3


def test_rows_fed_again_are_dropped(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "A"), (None, None)], "doc_id long, text string").repartition(3)
    index = exact_dedup.DigestIndex(spark, buckets=3)
    assert sorted((r.doc_id for r in exact_dedup.keep_unique(docs, index).collect()), key=str) == [2, 3, None]
    assert exact_dedup.keep_unique(docs, index).count() == 0
    assert [tuple(r)[:4] for r in exact_dedup.assign(docs, index).where("kept OR group_size < 1").collect()] == []
    assert exact_dedup.assign(docs, index).where("doc_id = 2").select("keep_id", "group_size").distinct().collect() == [(2, 2)]
    assert index.rows().count() == 3


def test_hot_digests_are_told_by_the_batch(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    exact_dedup.assign(spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS STRING) AS text"), index)
    seen = []
    plain = exact_dedup.join_on_key
    monkeypatch.setattr(exact_dedup, "join_on_key", lambda rows, table, key, weight, total: seen.append((table.agg({weight: "max"}).first()[0], total)) or plain(rows, table, key, weight, total))
    assert exact_dedup.assign(spark.createDataFrame([(9, "0"), (10, "x")], "doc_id long, text string"), index).count() == 2
    assert seen == [(1, 2)]
