import hashlib
import random
import re
import zlib
from collections import defaultdict

from parley.llm import prefix_trie


def key_of(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), key_of(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = full[c] = tuple(own.get(int(c / 20) * 20, [])[:h] + mine[h:])  # the remainder has the sign of c
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    out = set()
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(str(c) for c in sorted(c for c in members if full[c] == k))
        out.add((
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(len(x) == len(k) + 1 for x in below),
            sum(map(leaf, below)), sum((len(nodes[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def found(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, pos long").repartition(3)
    got = [tuple(r[c] for c in prefix_trie.RESULT) for r in prefix_trie.trie(table, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations(rng, n):
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "d e f", "é x y"])))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = conversations(rng, 90)
    rows += [(c, t, "user", "same again and again") for c in range(200, 260) for t in range(5)]  # a frequent conversation
    rows += [(301, None, None, None), (301, 1, "", ""), (302, None, "user", None), (303, 2, "user", "x"), (303, 2, "user", "x"), (303, 2, "assistant", "x"), (None, 1, "user", "x"), (-7, 0, "user", "minus")]
    rows += [(400, t, "user", f"long {t % 7}") for t in range(300)] + [(401, t, "user", f"long {t % 7}") for t in range(299)] + [(404, 0, "user", "w " * 1_000_000)]
    want = brute(rows)
    assert found(spark, rows) == want
    for shard_turns in (4, 40, 500):  # nodes are spread over many shards
        assert found(spark, rows, shard_turns=shard_turns) == want


def test_only_turnless_and_none(spark):
    rows = [(c, 0, "user", "x") for c in range(21, 60)]  # bases 40 only; those with a head and no base are turnless
    assert found(spark, rows, shard_turns=3) == brute(rows)
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, "user", "x")]) == set()


def test_tree_is_balanced():
    tree = prefix_trie.TernaryTree()
    lists = [[i, i % 3] for i in range(1000)]
    for k in prefix_trie.middle_first(len(lists)):
        tree.insert(lists[k], [1, 1])

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.next[0]) == 10
    order = tree.nodes()
    assert sorted(order) == list(range(2001)) and [tree.turn[n] for n in order if tree.depth[n] == 1] == list(range(1000))
