"""Prefix trie of conversations: what they share from their first turn on, and what sharing it would save.

Turns (role, text) get numbers from a dictionary, so a conversation is a short list of them. The lists are
sorted and cut into ranges; each range, a shard, puts its lists into a ternary search tree, middle first, so
that the lower and higher links of siblings stay balanced. One iterative traversal gives the nodes in order,
and going through them backwards adds up members, leaves and savings.

Only nodes on the path of a shard's first or last list can have members in other shards. These are left open:
a pass over them in the order of shards, holding one path, merges those that are equal, adds what closed
children have, and digests the members that end there. It runs for each first turn by itself. What lies under an open
node learns its parent's smallest member by a join.

A very frequent conversation is as many short lists, spread over shards like any others, and a frequent first
turn is one open node for each shard. A conversation itself is one list: 16 bytes for a turn in one row.

Defined results: rows without conv_id take no part; null role and null text are empty; turns are ordered by
turn (null first), turns of one number by the SHA-256 of role and text; repeated rows are repeated turns; no
conversations, no nodes; the remainder c % EVERY has the sign of c; other columns are ignored; long texts are
digested and counted where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import join_on_key, stored

#: Turns of a shard at about which another one is made.
SHARD_TURNS = 1 << 17
EVERY, HEAD = 20, 4
FIELDS = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
NODES = ", ".join(f"{c} long" for c in FIELDS) + ", parent_conv_id long, up_shard long, up_no long, ends_sha256 string"
PARTS = ", ".join(f"{c} long" for c in FIELDS) + ", words long, turn long, top long, shard long, no long, up_shard long, up_no long, ends binary"


def coded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, words): each turn by its number in the dictionary of distinct (role, text)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    rows = rows.withColumns({
        "digest": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)),
        "words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    })
    rows = rows.select("conv_id", "turn", "digest", "words")  # no text is exchanged
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    rows = stored(rows.withColumn("pos", F.row_number().over(order).cast("long") - 1).select("conv_id", "pos", "digest", "words"), "trie-turns")
    distinct = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    # the numbers are fixed once written
    dictionary = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    return join_on_key(rows, dictionary, "digest", "n", rows.count()).select("conv_id", "pos", "id", "words")


def head_length(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEAD)).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words): the first turns of conversation c - c % EVERY, then c's own after as many."""
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("own"))
    own = stored(own.select("conv_id", F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("own")), "trie-conversations")
    heads = own.where(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEAD - 1).alias("head"))
    rows = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % EVERY, "h": head_length(F.col("conv_id"))}).join(heads, "base", "left")
    nothing = F.array().cast("array<struct<id: bigint, words: bigint>>")
    head = F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h"))
    turns = F.concat(head, F.slice("own", F.col("h") + 1, F.size("own")))
    rows = rows.select("conv_id", turns.alias("turns"))
    return rows.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


class TernaryTree:
    """Lists of numbers in flat arrays: a node has a number, lower and higher siblings, and what follows it."""

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.next, self.words, self.depth, self.up = [-1], [-1], [-1], [-1], [0], [0], [-1]

    def new(self, turn: int, words: int, up: int) -> int:
        for column, value in zip((self.turn, self.low, self.high, self.next, self.words, self.depth, self.up), (turn, -1, -1, -1, words, self.depth[up] + 1, up)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, ids: list[int], words: list[int]) -> int:
        """The node at which the list ends; node 0 is the root."""
        turn, at = self.turn, 0
        for t, n in zip(ids, words):
            up, link, node = at, self.next, self.next[at]
            while node >= 0 and turn[node] != t:
                link, at = (self.low, node) if t < turn[node] else (self.high, node)
                node = link[at]
            if node < 0:
                node = link[at] = self.new(t, n, up)
            at = node
        return at

    def nodes(self) -> list[int]:
        """All nodes, each before what follows it and siblings in order; without recursion."""
        out, waiting = [0], []
        node = self.next[0]
        while node >= 0 or waiting:
            while node >= 0:
                waiting.append(node)
                node = self.low[node]
            node = waiting.pop()
            if node < 0:  # everything under the sibling before is out
                node = self.high[~node]
                continue
            out.append(node)
            waiting.append(~node)
            node = self.next[node]
        return out

    def path(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(node)
            node = self.up[node]
        return out[::-1]


def middle_first(n: int) -> Iterator[int]:
    spans = [(0, n)]
    while spans:
        a, b = spans.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            spans += [(a, m), (m + 1, b)]


def digest(ids: Iterable[bytes]) -> str:
    return hashlib.sha256(b",".join(ids)).hexdigest()


def shard_nodes(shard: int, lists: list[tuple[list[int], list[int], list[int]]]) -> tuple[list[tuple], list[tuple]]:
    """Finished nodes and open parts of a shard from its sorted distinct (ids, words, conv_ids ascending)."""
    tree = TernaryTree()
    end_of = [0] * len(lists)
    for k in middle_first(len(lists)):
        end_of[k] = tree.insert(lists[k][0], lists[k][1])
    size = len(tree.turn)
    members, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    ends: list[list[int]] = [[]] * size
    for node, (_, _, convs) in zip(end_of, lists):
        members[node], least[node], ends[node] = len(convs), convs[0], convs
    edge = tree.path(end_of[0])
    edge += [node for node in tree.path(end_of[-1]) if node not in set(edge)]
    number = {node: i for i, node in enumerate(edge)}
    order, up = tree.nodes(), tree.up
    for node in reversed(order):
        open_ = node in number
        if not open_:  # open parts get their own leaf and savings when all of them are together
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.words[node]
        above = up[node]
        if above >= 0:
            members[above] += members[node]
            least[above] = least[node] if least[above] is None else min(least[above], least[node])
            if not open_:
                children[above] += 1
                leaves[above] += leaves[node]
                saved[above] += saved[node]
    done, parts, top = [], [], -1
    for node in order:
        above = up[node]
        if tree.depth[node] == 1:
            top = tree.turn[node]
        own = (least[node], tree.depth[node], members[node], children[node], leaves[node], saved[node])
        text = [b"%d" % c for c in ends[node]]
        if node in number:
            parts.append((*own, tree.words[node], tree.turn[node], top, shard, number[node], shard if above >= 0 else None, number.get(above), b",".join(text)))
        elif above in number:
            done.append((*own, None, shard, number[above], digest(text)))
        else:
            done.append((*own, least[above], None, None, digest(text)))
    return done, parts


def sharded(rows: DataFrame, shards: int) -> DataFrame:
    """`NODES` and `PARTS` of every shard in one table; finished nodes have no turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[tuple[list[int], list[int], list[int]]] = []
        for batch in batches:
            for conv, ids, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "words"))):
                if lists and lists[-1][0] == ids:
                    lists[-1][2].append(conv)
                else:
                    lists.append((ids, words, [conv]))
        if not lists:
            return
        done, parts = shard_nodes(TaskContext.get().partitionId(), lists)
        width, kinds = len(FIELDS), [f.type for f in SHAPE]
        table = [(*r[:width], None, None, None, None, None, r[width + 1], r[width + 2], None, r[width], r[width + 3]) for r in done]
        table += [(*r[: width + 7], r[-1], None, None) for r in parts]
        for first in range(0, len(table), 4096):
            columns = zip(*table[first : first + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], SHAPE.names)

    kind = PARTS + ", parent_conv_id long, ends_sha256 string"
    return rows.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id").mapInArrow(run, kind)


SHAPE = pa.schema([(c, pa.int64()) for c in (*FIELDS, "words", "turn", "top", "shard", "no", "up_shard", "up_no")] + [("ends", pa.binary()), ("parent_conv_id", pa.int64()), ("ends_sha256", pa.string())])


class OpenNode:
    """Parts of one node, put together as they come."""

    def __init__(self, row: dict):
        self.row, self.parts = dict(row), []
        self.sha, self.some = hashlib.sha256(), False
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            self.row[c] = 0

    def add(self, row: dict) -> None:
        own = self.row
        own["conv_id"] = min(own["conv_id"], row["conv_id"])
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            own[c] += row[c]
        self.parts.append((row["shard"], row["no"]))
        if row["ends"]:
            self.sha.update(b"," * self.some + row["ends"])
            self.some = True

    def close(self, above: OpenNode | None) -> tuple:
        own = self.row
        own["n_leaves"] += not own["n_children"] and own["depth"] > 0  # the root's children are told apart by first turn
        own["saved_tokens"] += (own["n_convs"] - 1) * own["words"]
        if above:
            above.row["n_children"] += 1
            above.row["n_leaves"] += own["n_leaves"]
            above.row["saved_tokens"] += own["saved_tokens"]
        return (*(own[c] for c in FIELDS), own["up_shard"], own["up_no"], self.sha.hexdigest(), [p[0] for p in self.parts], [p[1] for p in self.parts])


MERGED = ", ".join(f"{c} long" for c in FIELDS) + ", up_shard long, up_no long, ends_sha256 string, shards array<long>, nos array<long>"
MERGED_KINDS = [*[pa.int64()] * (len(FIELDS) + 2), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
MERGED_NAMES = [*FIELDS, "up_shard", "up_no", "ends_sha256", "shards", "nos"]


def merged(parts: DataFrame) -> DataFrame:
    """Open parts put together: one row for each node with the parts it had; the root's lacks its open children."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[OpenNode] = []
        top, out = None, []

        def close(depth: int) -> None:
            while path and path[-1].row["depth"] >= depth:
                node = path.pop()
                out.append(node.close(path[-1] if path else None))

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(MERGED_NAMES)
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, MERGED_KINDS)], MERGED_NAMES)
            out.clear()
            return made

        for rows in batches:
            for row in rows.to_pylist():
                if row["top"] != top:
                    close(0)
                    top = row["top"]
                at = row["depth"] - (path[0].row["depth"] if path else 0)
                same = path[at] if 0 <= at < len(path) else None
                if same is None or same.row["turn"] != row["turn"]:
                    close(row["depth"])
                    path.append(same := OpenNode(row))
                same.add(row)
            yield batch()
        close(0)
        yield batch()

    ranked = parts.repartition("top").sortWithinPartitions("top", "shard", "no")
    return ranked.mapInArrow(run, MERGED)


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    spark = conversations.sparkSession
    rows = stored(rebuilt(coded_turns(conversations)), "trie-rebuilt")
    total = rows.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if total > 4096 else 1, -(-total // shard_turns))
    found = stored(sharded(rows, shards), "trie-shards")
    done, parts = found.where("no IS NULL"), found.where("no IS NOT NULL")
    open_ = stored(merged(parts), "trie-open")
    at_root = lambda c: F.sum(F.when(F.col("depth") == 0, F.col(c)).otherwise(0))
    root = open_.where("depth <= 1").agg(
        F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), at_root("n_convs").alias("n_convs"),
        F.sum(F.when(F.col("depth") == 0, F.col("n_children")).otherwise(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max(F.when(F.col("depth") == 0, F.col("ends_sha256"))).alias("ends_sha256"),
    )
    root = root.where("conv_id IS NOT NULL").withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")))
    # a part's parent is known by its place in its shard
    place = F.explode(F.arrays_zip("shards", "nos")).alias("p")
    parents = open_.select(F.col("conv_id").alias("parent_conv_id"), place).select("parent_conv_id", F.col("p.shards").alias("up_shard"), F.col("p.nos").alias("up_no"))
    below = done.where("up_no IS NOT NULL").drop("parent_conv_id").select(*RESULT_FIELDS, "up_shard", "up_no").unionByName(open_.where("depth > 0").select(*RESULT_FIELDS, "up_shard", "up_no"))
    linked = below.join(parents, ["up_shard", "up_no"])
    result = lambda df: df.select(*RESULT)
    return result(done.where("up_no IS NULL")).unionByName(result(linked)).unionByName(result(root))


RESULT_FIELDS = (*FIELDS, "ends_sha256")
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH t0 AS (SELECT conv_id, turn, octet_length(CAST(coalesce(role, '') AS BLOB)) || ':' || coalesce(role, '') || coalesce(text, '') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(k)) AS pos FROM t0),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, k, words FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, pos, k, words FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
l AS (SELECT conv_id, coalesce(list(k ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ks, coalesce(list(words ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ws FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, d AS depth, ks[1:d] AS k, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words, len(ks) = d AS final FROM l, unnest(range(0, len(ks) + 1)) AS u(d)),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (final), '')) AS ends_sha256 FROM p GROUP BY k, depth),
ch AS (SELECT k[1:depth - 1] AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k, depth)),
s AS (SELECT f.k[1:d] AS k, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM f, unnest(range(0, f.depth + 1)) AS u(d) GROUP BY ALL)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (k, depth) LEFT JOIN n q ON q.depth = f.depth - 1 AND q.k = f.k[1:f.depth - 1]
"""
