import random
import re
from itertools import permutations

import numpy as np

from parley.llm import filter_audit

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    good, toxic = ({d for d, *y in labels if d is not None and y[i] == 1} for i in (0, 1))
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [d for d, x, _ in docs if (x or "") == t and d is not None]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and any(d < doc_id for d in same),
        }
        rows.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in mine)
                out[part, "".join(order), step] = [len(left), len(removed), sum(r[0][f] for r in gone), only, sum(r[1] for r in removed), sum(r[2] for r in removed)]
                gone = gone + removed
    for key in out:
        f = key[1][key[2] - 1]
        out[key].append(sum(v[1] for k, v in out.items() if len(v) > 1 and k[0] == key[0] and k[1][k[2] - 1] == f))
    return out


def test_every_order_against_brute_force(spark):
    rng = random.Random(3)
    docs = []
    for i in range(120):
        words = [rng.choice(["alpha", "Beta", "GAMMA"]) + str(rng.randrange(400)) for _ in range(rng.choice([5, 99, 100, 101, 300]))]
        text = rng.choice([" ", "\x0b", "  ", "\n"]).join(words) + rng.choice(["", "", " |", " é"])
        docs.append((i, text, rng.choice(["en", "de", None, ""])))
    docs += [(200 + i, docs[i % 4][1], "en") for i in range(40)]
    docs += [(5, docs[5][1], "en"), (5, docs[5][1], "en"), (300, None, "de"), (301, "", None), (None, docs[7][1], "de"), (None, None, None), (302, "W" * 3_000_000 + " #", "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(150)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, part long, failed long").repartition(5)
    found = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in found}
    assert len(got) == len(found) and got == brute(docs, labels)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_carry_save_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 100, 1001):
        words, times = rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(1, 1 << 40, n)
        bits = (words[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        assert (filter_audit.carry_save(words) == bits.sum(axis=0)).all()
        assert (filter_audit.carry_save(words, times) == (bits * times[:, None]).sum(axis=0)).all()
