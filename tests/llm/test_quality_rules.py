import random
import re
from collections import Counter

import numpy as np

from parley.llm import quality_rules


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(fives)
    repeated = len({i + k for i, f in enumerate(fives) if count[f] > 1 for k in range(5)})
    chars, symbols, capitals = sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum("A" <= c <= "Z" for c in t)
    twice = len(lines) - len(set(lines))
    base = len(words) < 10 or 100 * repeated > 20 * len(words)
    letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words)
    n = len(words)
    kept = not base and 100 * symbols <= 10 * n and 100 * twice <= 40 * len(lines) and 2 * n <= chars <= 14 * n and 100 * letters >= 60 * n and 100 * capitals <= 40 * len(t)
    return n, chars, symbols, twice, repeated, base, kept


def texts(rng):
    words = ["alpha", "beta,", "Gamma", "déjà", "42", "x", "###", " y"]
    out = [None, "", " \n ", "word", "a b c d e f", "LOUD WORDS " * 40, "\n".join(["one line of it", "other"] * 9), "long" * 400_000, "p q r s t " * 110_000]
    for _ in range(120):
        t = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", "\n", "\r\n"]) for _ in range(rng.randrange(3, 120)))
        out.append(t + t[: rng.randrange(len(t))] * rng.choice([0, 0, 0, 1]))
    for _ in range(80):
        out.append(" ".join(f"{rng.choice(words[:4])}{rng.randrange(9999)}" for _ in range(rng.randrange(5, 200))))
    return out


def test_against_brute_force(spark):
    rows = [(i, t, 1, "n") for i, t in enumerate(texts(random.Random(2)))] + [(4, "a b c d e f", 1, "n"), (4, "a b c d e f", 1, "n"), (None, "null id", 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rule_text int, kept string").repartition(4)
    got = quality_rules.verdicts(docs).collect()
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(((r.doc_id is None, r.doc_id or 0), *(r[c] for c in fields)) for r in got) == sorted(((i is None, i or 0), *brute(t)) for i, t, *_ in rows)
    assert all((r.rejected_by is None) == r.kept for r in got) and 0 < sum(r.kept for r in got) < len(got)
    passed = quality_rules.passed(docs)
    assert passed.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in passed.collect()) == sorted((i, t) for i, t, *_ in rows if brute(t)[-1])
    assert quality_rules.verdicts(docs.limit(0)).count() == 0 and quality_rules.passed(docs.limit(0)).count() == 0


def test_order_follows_rejections_for_a_second_and_changes_no_result(spark):
    rules = quality_rules.RULES
    costs = {"few_words": (1.0, 0.5), "capitals": (0.1, 0.4), "symbols": (0.1, 0.0)}
    assert [r.name for r in quality_rules.ordered(rules, costs)][:3] == ["capitals", "few_words", "symbols"]
    for t in [t for t in texts(random.Random(8)) if len(t or "") < 10_000]:
        one = quality_rules.Measured(t or "")
        assert {quality_rules.rejecting(one, order) is None for order in (rules, rules[::-1])} == {brute(t)[-1]}
    docs = spark.createDataFrame([(i, "word " * (5 if i % 3 else 50)) for i in range(400)], "doc_id long, text string")
    found = quality_rules.sampled_costs(docs, rows=16)
    assert 0.4 < found["few_words"][1] < 0.9
    assert set(found) == {r.name for r in rules} and all(s > 0 for s, _ in found.values())


def test_windows_that_share_a_hash_are_compared_word_by_word(monkeypatch):
    monkeypatch.setattr(quality_rules, "MIX", np.zeros(5, np.uint64))
    rng = random.Random(1)
    for _ in range(50):
        ids = [rng.randrange(4) for _ in range(rng.randrange(1, 60))]
        count = Counter(tuple(ids[i : i + 5]) for i in range(len(ids) - 4))
        want = len({i + k for i in range(len(ids) - 4) if count[tuple(ids[i : i + 5])] > 1 for k in range(5)})
        assert quality_rules.repeated_words(np.array(ids)) == want
