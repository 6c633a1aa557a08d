"""Exact n-gram Jaccard join by grouped prefixes, and the components of its links.

1. Every document becomes its set of hashed word shingles; documents of equal sets form a class.
2. Document frequencies of all shingles are counted (`hash_counts`). A shingle of one document can't
   be shared, so documents with too few others drop out; the rest order theirs from rare to common.
3. Two sets of similarity t share one of the first n - ceil(t n) + 1 in that order. Documents with
   equal prefixes and sizes are one group; an inverted index leads from a shingle to its groups.
4. Only links between different components matter. Each group is first held against one central
   group among those that share its prefix shingles; what is then left between different components
   passes the size and position filters, is expanded to members and verified. So a large group of
   near copies costs a pair for each member, not for each two of them, and no link between different
   texts is lost.

Shingles are 64-bit hashes; sets are kept and counted by their high 48 bits or more, as many as the
corpus asks for (`key_width`), so two documents would have to share several wrong ones for a wrong link.

Defined results: null and empty texts have no shingles and are linked with nothing; texts of fewer
words than a shingle count as one; repeated rows are copies of each other; a null id is never the
smallest of a component; an empty table gives an empty result; other columns are ignored by `link`
and carried through by `keep_first`; very long texts are shingled whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import free_name, join_on_key, stored, text_slices
from parley.llm.hash_counts import BATCH_KEYS, Bucketed, answers, buckets_for, counted_keys, key_width, looked_up, mixed, narrowed, pack_keys, slots, unpack_keys

WORDS, PERCENT = 5, 75
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts): the distinct 64-bit shingle hashes of each text, text after text and sorted, and how many."""
    word = xxhash.xxh3_64_intdigest
    lists = [t.encode().lower().split() for t in texts]
    lengths = np.array([len(x) for x in lists], np.int64)
    h = np.array([word(w) for x in lists for w in x], np.uint64)
    starts = np.cumsum(lengths) - lengths
    shingles = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    doc = np.repeat(np.arange(len(texts)), shingles)
    first = np.repeat(starts - (np.cumsum(shingles) - shingles), shingles) + np.arange(len(doc))
    width = np.minimum(lengths, size)[doc]
    key = width.astype(np.uint64)
    for i in range(size):
        there = i < width
        key = np.where(there, key * STEP + h[np.minimum(first + i, len(h) - 1)] if len(h) else key, key)
    key = mixed(key)
    order = np.argsort(key)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(texts) <= 1 << 16 else doc[order], kind="stable")]
    doc, key = doc[order], key[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.zeros(0, bool)
    doc, key = doc[new], key[new]
    return key, np.bincount(doc, minlength=len(texts))


def shingled(docs: DataFrame, width: int, size: int = WORDS, row_key: str = "NULL") -> DataFrame:
    """Batches of documents: batch, doc_ids, row_keys (a binary SQL expression on each row), sizes, digests, keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple[list, list, np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            nonlocal n, held
            ids, row_keys = ([i for h in held for i in h[c]] for c in (0, 1))
            keys, sizes = (np.concatenate([h[c] for h in held]) for c in (2, 3))
            ends = np.cumsum(sizes)
            data = np.ascontiguousarray(keys).view(np.uint8)
            digests = [hashlib.blake2b(data[8 * (e - s) : 8 * e], digest_size=16).digest() if s else None for s, e in zip(sizes.tolist(), ends.tolist())]
            n, held = n + 1, []
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{n}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([row_keys], pa.list_(pa.binary())), pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())), pa.array([digests], pa.list_(pa.binary())), pa.array([pack_keys(narrowed(keys, width), width)], pa.binary())],
                ["batch", "doc_ids", "row_keys", "sizes", "digests", "keys"],
            )

        for rows, texts in text_slices(batches):
            held.append((rows.column("doc_id").to_pylist(), rows.column("row_key").to_pylist(), *shingle_sets(texts, size)))
            if sum(len(h[2]) for h in held) >= BATCH_KEYS:
                yield flushed()
        if held:
            yield flushed()

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", f"CAST({row_key} AS BINARY) AS row_key").mapInArrow(
        run, "batch string, doc_ids array<long>, row_keys array<binary>, sizes array<int>, digests array<binary>, keys binary"
    )


SETS = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("keys", pa.binary())])


def ordered_sets(batches: DataFrame, counted: DataFrame, buckets: int, width: int, percent: int) -> DataFrame:
    """(node, n, keys): of each class that can have a link, its shared shingles from rare to common."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[bytes, tuple[int, bytes]] = {}
        known, counts = answers(right, width, whole=False)
        for row in left.to_pylist():
            keys, sizes = unpack_keys(row["keys"], width), row["sizes"]
            df = looked_up(slots(keys, buckets, width, False), known, counts)
            at = 0
            for n, node in zip(sizes, row["digests"]):
                k, d = keys[at : at + n], df[at : at + n]
                at += n
                shared = d > 1
                if n and node not in out and 100 * int(shared.sum()) >= percent * n:
                    k, d = k[shared], d[shared]
                    out[node] = (n, pack_keys(k[np.lexsort((k, d))], width))
        return pa.Table.from_arrays([pa.array(list(out), pa.binary()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.binary())], schema=SETS)

    found = batches.select("batch", "sizes", "digests", "keys").groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(run, "node binary, n long, keys binary")
    # copies in different batches have the same set in the same order
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))


def prefixes(sets: DataFrame, percent: int, width: int) -> DataFrame:
    """(key, gid, node, n, single, pos): a row for each shared shingle in a prefix; pos counts the unshared ones before it."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            cols: list[list] = [[], [], [], [], [], []]
            for node, n, data in zip(*(part.column(c).to_pylist() for c in ("node", "n", "keys"))):
                keys = unpack_keys(data, width)
                single = n - len(keys)
                length = n - -(-percent * n // 100) + 1 - single
                keys = keys[: max(length, 0)]
                if not len(keys):
                    continue
                # unshared shingles differ, so only prefixes without one can be equal
                gid = node if single else hashlib.blake2b(keys.tobytes() + int(n).to_bytes(8, "little"), digest_size=16).digest()
                m = len(keys)
                for to, x in zip(cols, (keys.astype(np.int64).tolist(), [gid] * m, [node] * m, [n] * m, [single] * m, range(single, single + m))):
                    to.extend(x)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "gid", "node", "n", "single", "pos"])

    return sets.mapInArrow(run, "key long, gid binary, node binary, n long, single long, pos long")


def may_link(a: str, b: str, percent: int):
    """Size and position filter: sharing this shingle first, the two can still reach the similarity."""
    n_a, n_b, p_a, p_b = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    most = F.least(n_a - p_a, n_b - p_b)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * most >= percent * (n_a + n_b))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) of nodes that link; a node may be the b of any number of pairs.

    The few sets that stand for b are written apart, so that both sides of that join are exchanged
    for it and a node of very many pairs is split over tasks.
    """
    pairs = stored(pairs, "pairs")
    ends = stored(sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi"), "ends")
    side = lambda sets, c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}"))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            keep = []
            for n_a, n_b, x, y in zip(part.column("n_a").to_pylist(), part.column("n_b").to_pylist(), part.column("keys_a"), part.column("keys_b")):
                both = len(np.intersect1d(unpack_keys(x.as_py(), width), unpack_keys(y.as_py(), width), assume_unique=True))
                keep.append(100 * both >= percent * (n_a + n_b - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side(sets, "a"), "a").join(side(ends, "b").hint("merge"), "b").select("a", "b", "n_a", "n_b", "keys_a", "keys_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of `links` (a, b, different): the smallest node of each component.

    Large and small stars in turn until every edge (high, low) leads straight to a root. No step adds
    an edge, and rounds grow with the logarithm of the nodes, however long a path is.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges")
    while True:
        # stored, so that the joins below exchange both sides and a node of very many edges is split over tasks
        near = stored(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")), "near")
        up = near.withColumnRenamed("node", "low")
        if edges.count() == near.count() and edges.join(up, "low", "left_semi").isEmpty():
            return edges.select(F.col("high").alias("node"), F.col("low").alias("label")).union(edges.select("low", "low").distinct())
        edges = stored(edges.join(up, "low", "left").select("high", F.coalesce("root", "low").alias("low")), "edges")
        near = stored(edges.groupBy("high").agg(F.min("low").alias("root")), "near")
        others = edges.join(near, "high").where("low != root").select(F.col("low").alias("high"), F.col("root").alias("low"))
        edges = stored(others.union(near).distinct(), "edges")


def links_of(sets: DataFrame, width: int, percent: int = PERCENT) -> DataFrame:
    """(a, b): links whose components are those of all links between the sets."""
    rows = stored(prefixes(sets, percent, width), "prefixes")
    index = rows.groupBy("key", "gid").agg(F.first("n").alias("n"), F.first("single").alias("single"), F.first("pos").alias("pos"))
    members = stored(rows.select("gid", "node").distinct(), "members")
    heads = members.groupBy("gid").agg(F.min("node").alias("head"), F.count("node").alias("size"))

    # one pair for each member: with the head of its group, or of the most central group that it may link with
    best = index.groupBy("key").agg(F.min(F.struct("single", "gid", "n", "pos")).alias("c"), F.count("gid").alias("groups"))
    best = best.where(F.col("groups") > 1).select("key", F.col("c.single").alias("c_single"), F.col("c.gid").alias("c_gid"), F.col("c.n").alias("n"), F.col("c.pos").alias("pos"))
    near = index.alias("x").join(stored(best, "best").alias("c"), "key").where((F.col("x.gid") != F.col("c_gid")) & may_link("x", "c", percent))
    central = near.groupBy(F.col("x.gid").alias("gid")).agg(F.min(F.struct("c_single", "c_gid")).alias("c")).select("gid", F.col("c.c_gid").alias("c_gid"))
    own = members.join(heads.where("size > 1"), "gid").where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    far = central.join(heads.select("gid", F.col("head").alias("a")), "gid").join(heads.select(F.col("gid").alias("c_gid"), F.col("head").alias("b")), "c_gid").select("a", "b")
    first = stored(verified(own.union(far).distinct(), sets, percent, width), "links")

    # what is left between different components
    labels = components(first)
    named = stored(members.join(labels, "node", "left").select("gid", "node", F.coalesce("label", "node").alias("label")), "named")
    spread = named.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    placed = index.join(spread, "gid")
    mixed_keys = placed.groupBy("key").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.min(F.struct("single", "gid", "low")).alias("c")).where("l != h").select("key", F.col("c.low").alias("main"))
    open_rows = stored(placed.join(stored(mixed_keys, "mixed"), "key").withColumn("other", ~((F.col("low") == F.col("main")) & (F.col("high") == F.col("main")))), "open")
    apart = (F.col("x.low") != F.col("x.high")) | (F.col("y.low") != F.col("y.high")) | (F.col("x.low") != F.col("y.low"))
    # y is the smaller set of a pair, so it has to hold the shingle early, and its size is at most one band below that of x
    early = open_rows.where((100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n"))
    band = F.floor(F.log("n") / ((math.log(100 / percent) or 1.0) * (1 + 1e-9)))
    x = open_rows.withColumn("band", band).alias("x")
    y = early.withColumn("band", F.explode(F.array(band, band + 1))).alias("y")
    ordered = F.struct("y.n", "y.gid") < F.struct("x.n", "x.gid")
    pick = lambda x, y: x.join(y, ["key", "band"]).where(ordered & apart & may_link("x", "y", percent)).select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h"))
    groups = pick(x.where("other"), y).union(pick(x.where("NOT other"), y.where("other")))
    groups = groups.union(spread.where("low != high").select("gid", "gid")).distinct()
    left, right = (named.select(F.col("gid").alias(g), F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for g, c in (("g", "b"), ("h", "a")))
    rest = groups.join(left, "g").join(right, "h").where("label_a != label_b").select("a", "b").distinct()
    return first.union(stored(verified(rest, sets, percent, width), "links"))


def labelled(docs: DataFrame, size: int, percent: int, row_key: str = "NULL") -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, row_key, n_shingles, node) of each row of `docs`, (node, label) of the nodes that have links, and the number of rows."""
    spark = docs.sparkSession
    # a text has at most so many words
    words, octets = docs.agg(F.coalesce(F.sum((F.length("text") + 1).cast("long") / 2), F.lit(0)).cast("long"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    width = key_width(words)
    table = Bucketed(shingled(docs, width, size, row_key), "shingles", "batch", octets)
    batches = table.rows
    each = F.explode(F.arrays_zip("doc_ids", "row_keys", "sizes", "digests")).alias("d")
    rows = stored(batches.select(each).select(F.col("d.doc_ids").alias("doc_id"), F.col("d.row_keys").alias("row_key"), F.col("d.sizes").cast("long").alias("n_shingles"), F.col("d.digests").alias("node")), "documents")
    total_keys, total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = buckets_for(total_keys, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = counted_keys(batches, buckets, width, least=2, whole=False)
    # the sets stand bucketed by node, so the joins that verify pairs exchange the pairs only
    sets = Bucketed(ordered_sets(batches, counted, buckets, width, percent), "sets", "node", octets)
    table.drop()
    labels = components(links_of(sets.rows, width, percent))
    sets.drop()
    return rows, labels, total


def link(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id."""
    rows, labels, total = labelled(docs, size, percent)
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    named = stored(classes.join(labels, "node", "left").select("node", "least", "weight", F.coalesce("label", "node").alias("label")), "classes")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    table = named.join(smallest, "label").select("node", "weight", "component_id")
    some = join_on_key(rows.where("node IS NOT NULL"), table, "node", "weight", total)
    none = rows.where("node IS NULL").withColumn("component_id", F.col("doc_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none.select("doc_id", "n_shingles", "component_id"))


def keep_first(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of `docs` for each component, that of the smallest id and then text digest, with all its columns.

    Rows without shingles are linked with nothing and stay, repeated ones once.
    """
    digest = "coalesce(unhex(md5(text)), unhex(''))"
    rows, labels, _ = labelled(docs, size, percent, digest)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(first)
    one = classes.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    stay = one.select("first.doc_id", "first.row_key").union(rows.where("node IS NULL").select("doc_id", "row_key")).distinct()
    key, text_key = free_name(docs, "keep_key"), free_name(docs, "keep_text")
    marked = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(text_key, F.expr(digest))
    stay = stay.select(F.col("doc_id").alias("stay_id"), F.col("row_key").alias("stay_key"))
    same = marked[key].eqNullSafe(stay["stay_id"]) & (marked[text_key] == stay["stay_key"])
    return marked.join(stay.hint("merge"), same, "left_semi").dropDuplicates([key, text_key]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
