import numpy as np

from parley.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def brute(rows, k):
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    good = list({(i, v.tobytes()): (i, v) for i, v in good}.values())
    out = {}
    for i, q in good:
        if i % 20 == 0:
            near = sorted((-float(q @ v), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def check(spark, rows, least):
    want = brute(rows, 20)
    got = {}
    for r in sorted(ann.nearest(table(spark, rows).repartition(4)).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert {q for q, n in want.items() if n} == set(got)
    hit = total = 0
    for q, near in want.items():
        assert len(got.get(q, [])) == len(near)
        hit += len({j for j, _ in near} & {j for j, _ in got.get(q, [])})
        total += len(near)
        assert [s for _, s in got.get(q, [])] == sorted((s for _, s in got.get(q, [])), reverse=True)
    assert hit >= least * total, hit / max(total, 1)
    return want, got


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[1000:] /= np.linalg.norm(x[1000:], axis=1)[:, None]  # lengths differ: the inner product isn't the angle
    check(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], 0.95)


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(100)]
    rows += [(100 + i, rng.normal(size=3).tolist(), 0) for i in range(60)]
    rows += [(200, None, 0), (220, [0.0, 0.0, 0.0], 0), (240, [1.0, None, 2.0], 0), (260, [float("nan"), 1.0, 1.0], 0), (280, [float("inf"), 1.0, 1.0], 0), (300, [], 0), (None, [1.0, 1.0, 1.0], 0)]
    rows += [(320, [1.0, 1.0], 0), (321, [2.0, -1.0], 0), (0, [1.0, 2.0, 3.0], 0)]
    want, got = check(spark, rows, 1.0)
    assert [j for j, _ in got[0]] == [j for j, _ in want[0]]
    assert got[320] == want[320]


def test_empty_table(spark):
    assert ann.nearest(table(spark, [])).count() == 0


def test_ties_go_to_smaller_ids_before_anything_is_cut(spark):
    rows = [(i, [1.0, i / 7], 0) for i in range(200)]
    got = {r["rank"]: r.vec_id for r in ann.nearest(table(spark, rows)).where("query_id = 0").collect()}
    assert got == {n: n for n in range(1, 21)}


def test_recall_of_a_full_shard():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(ann.SHARD // 64, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, levels = ann.build(x, ann.LINKS, 1)
    assert sorted(order.tolist()) == list(range(len(x))) and len(levels[0]) == len(x)
    y, q = x[order], x[:200]
    found = ann.search(q.astype(np.float32), y.astype(np.float32), levels, ann.BEAM)
    near = np.argsort(-(q @ y.T), axis=1)[:, : ann.K // ann.LEAST_SHARDS]
    assert np.mean([len(set(a) & set(b)) / len(a) for a, b in zip(near.tolist(), found.tolist())]) > 0.9


def test_recall_of_twenty_in_a_full_shard():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(ann.SHARD // 64, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, levels = ann.build(x, ann.LINKS, 1)
    y, q = x[order], x[:100]
    found = ann.search(q.astype(np.float32), y.astype(np.float32), levels, ann.BEAM)
    near = np.argsort(-(q @ y.T), axis=1)[:, : ann.K]
    assert np.mean([len(set(a) & set(b)) / len(a) for a, b in zip(near.tolist(), found.tolist())]) > 0.9


def test_an_id_on_two_vectors_asks_two_queries(spark):
    rows = [(20, [7.0, 0.0], 0), (20, [-3.0, 1.0], 0), *((i, [float(i), 1.0], 0) for i in range(1, 6))]
    got = [(r["rank"], r.vec_id, r.score) for r in ann.nearest(table(spark, rows)).where("query_id = 20").collect()]
    assert sorted(got) == sorted([(6 - i, i, 7.0 * i) for i in range(1, 6)] + [(i, i, 1.0 - 3 * i) for i in range(1, 6)])


def test_small_graphs_find_all(spark):
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 70, 130):
        x = rng.normal(size=(n, 5))
        order, levels = ann.build(x, ann.LINKS, 2)
        found = ann.search(x.astype(np.float32), x[order].astype(np.float32), levels, ann.BEAM)
        assert all(sorted(row[row >= 0].tolist()) == list(range(n)) for row in found), n
