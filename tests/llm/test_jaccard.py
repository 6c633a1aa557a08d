import random
import re

import numpy as np

from parley.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 30, 60, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocabulary)], ["NEW", "text"]])
        rows.append((i, " ".join(w)))
        if rng.random() < 0.3:  # a copy of a copy
            bases.append(w)
    return rows


def test_like_brute_force(spark):
    for seed, n in ((1, 120), (2, 260)):
        rng = random.Random(seed)
        rows = near_copies(rng, n)
        rows += [(900 + i, t) for i, t in enumerate([None, "", " ", "a", "A", "one two", "One\ttwo", "a b c d e", "a b c d e f", "é É", "É é"])]
        rows += [(3, rows[3][1]), (3, rows[3][1])]
        rng.shuffle(rows)
        docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node int").repartition(5)
        got = sorted(map(tuple, jaccard.link(docs).collect()))
        assert got == brute(rows)
        kept = jaccard.keep_first(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


def test_keep_first_decides_by_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    near = lambda t: t + " more"
    rows = [(None, one), (None, near(one)), (None, two), (None, None), (None, ""), (None, ""), (7, three), (7, near(two)), (5, near(three)), (9, "p q r s t"), (9, "u v w x y")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, keep_key int").repartition(3)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first(docs).collect()]
    null_one = [r for r in kept if r in ((None, one), (None, near(one)))]
    assert len(null_one) == 1
    rest = [r for r in kept if r not in null_one]
    assert sorted(rest, key=str) == sorted([(None, None), (None, ""), (7, near(two)), (5, near(three)), (9, "p q r s t"), (9, "u v w x y")], key=str)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link(empty).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")
    assert list(map(tuple, jaccard.link(one).collect())) == [(None, 2, None)]


def test_components_of_a_path(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")]
    labels = {bytes(r.node): bytes(r.label) for r in jaccard.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert set(labels.values()) == {b"\x00", b"\xf0"} and len(labels) == 43


def test_components_of_a_long_path_with_shuffled_ids(spark):
    nodes = [i.to_bytes(4, "big") for i in range(3000)]
    random.Random(3).shuffle(nodes)
    links = list(zip(nodes[:2500], nodes[1:2500])) + [(nodes[2500], n) for n in nodes[2501:]]
    labels = {bytes(r.node): bytes(r.label) for r in jaccard.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert labels == {n: min(part) for part in (nodes[:2500], nodes[2500:]) for n in part}


def test_sets_of_long_and_short_texts():
    keys, sizes = jaccard.shingle_sets(["a b c d e " * 50, "", "a b", "A B"])
    assert sizes.tolist() == [5, 0, 1, 1] and keys[-1] == keys[-2]
    many = ["x y z"] * 70_000
    keys, sizes = jaccard.shingle_sets(many)
    assert len(np.unique(keys)) == 1 and (sizes == 1).all()


def test_one_template_in_many_texts(spark):
    """Texts that share most shingles: some link, some miss the similarity by little, in sizes of several bands."""
    rng = random.Random(7)
    parts = [[f"p{k}w{i}" for i in range(40)] for k in range(5)]
    rows = []
    for i in range(160):
        w = [x for k in sorted(rng.sample(range(5), rng.choice([1, 3, 4, 5]))) for x in parts[k]]
        own = [f"own{rng.randrange(30)}x{j}" for j in range(rng.choice([0, 3, 8, 15, 30, 50]))]
        rows.append((i, " ".join(own + w if rng.random() < 0.5 else w + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.link(docs).collect())) == brute(rows)
