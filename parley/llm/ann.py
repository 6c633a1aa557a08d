"""Approximate nearest neighbours by inner product: one hierarchical small-world graph for each shard.

1. Equal vectors become one: only as many of their ids as a result can hold are kept (smallest first).
2. Vectors are dealt to shards by hash. A shard's graph is a hierarchical navigable small world built
   by insertion: rows are ordered by their highest level, so a level is a prefix of the rows; blocks
   of rows search the graph made so far from the level above, link to diverse near ones among what
   they found and each other, and are linked back. It is stored flat: one array of vectors, and for
   each level one array of neighbours.
3. Queries, in blocks, go to every shard; a block descends the levels greedily and then searches the
   lowest one with a beam, all queries of the block in step. What a beam found is scored in double
   precision on the original vectors, and ties go to the smaller id before anything is cut.
4. The shards' results are merged and the nearest kept.

Graphs are built in a space with one more dimension that makes all lengths equal, so that nearness
there is the inner product's. Building is linear in the rows but for the logarithm of a shard. The
number of shards grows only when shards would hold more than SHARD numbers.

Defined results: vectors that are null, zero, or hold a null or a number that isn't finite take no
part, neither as queries nor as candidates; vectors are compared with those of their own length
only; repeated rows (same id and vector) count once; an id on two different vectors asks two queries, each
with its own ranking, and no row of that id is a candidate for either; a query with fewer candidates gets all; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import join_on_key, stored

#: Results, links of a node, beam of a search and of an insertion, queries to a block.
K, LINKS, BEAM, BUILD_BEAM, BLOCK = 20, 24, 160, 64, 512
#: Numbers in the vectors of a shard at most (so its rows fit a worker whatever their length), shards at least.
SHARD, LEAST_SHARDS = 1 << 20, 4
EXPAND, BLOCKS_TO_TASK = 4, 16
EVERY = 20


def usable(vector: str = "embedding") -> F.Column:
    """Whether a vector takes part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(key, v, ids): each vector once, with its k + 1 smallest ids."""
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v")
    )
    rows = rows.withColumn("key", F.unhex(F.sha2(F.to_json("v"), 256)))
    # ranks are cut before the exchange as well, so copies of one vector don't meet in one task
    mine = Window.partitionBy("key").orderBy("vec_id")
    few = rows.dropDuplicates(["key", "vec_id"]).withColumn("n", F.row_number().over(mine)).where(F.col("n") <= k + 1)
    return few.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def beam_search(q: np.ndarray, x: np.ndarray, neighbours: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best nodes that a beam from `entry` (one for each query) finds, best first (-1: none), and their inner products."""
    m, n = len(q), len(x)
    beam = min(beam, n)
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf, np.float32)
    open_ = np.zeros((m, beam), bool)
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)
    ids[:, 0], open_[:, 0], seen[rows, entry] = entry, True, True
    sims[:, 0] = np.einsum("qd,qd->q", q, x[entry])
    expand = min(EXPAND, beam)
    active = rows
    while len(active):
        s = np.where(open_[active], sims[active], -np.inf)
        pick = np.argpartition(-s, expand - 1, axis=1)[:, :expand]
        go = np.take_along_axis(s, pick, axis=1) > -np.inf
        open_[active[:, None], pick] = False
        near = neighbours[np.where(go, ids[active[:, None], pick], 0)]
        near = np.where(go[:, :, None], near, -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        new = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        at, col = np.nonzero(new)
        found = near[at, col]
        seen[active[at], found] = True
        values = np.full(near.shape, -np.inf, np.float32)
        values[at, col] = np.einsum("nd,nd->n", q[active[at]], x[found])
        all_s = np.concatenate([sims[active], values], axis=1)
        all_i = np.concatenate([ids[active], near.astype(np.int64)], axis=1)
        all_o = np.concatenate([open_[active], new], axis=1)
        best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_s, best, axis=1)
        ids[active] = np.take_along_axis(all_i, best, axis=1)
        open_[active] = np.take_along_axis(all_o, best, axis=1) & (sims[active] > -np.inf)
        active = active[open_[active].any(axis=1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, axis=1)
    return np.where(sims > -np.inf, np.take_along_axis(ids, order, axis=1), -1), sims


def diverse(near: np.ndarray, s: np.ndarray, x: np.ndarray, links: int) -> np.ndarray:
    """Up to `links` of each row's candidates (best first, -1: none): those nearer to it than to any taken before them.

    Places that are left go to the nearest of the others.
    """
    width = near.shape[1]
    v = x[np.maximum(near, 0)]
    among = v @ v.transpose(0, 2, 1)
    keep = np.zeros(near.shape, bool)
    for j in range(width):
        rival = np.where(keep[:, :j], among[:, j, :j], -np.inf).max(axis=1, initial=-np.inf)
        keep[:, j] = (near[:, j] >= 0) & (s[:, j] > rival) & (keep[:, :j].sum(axis=1) < links)
    # taken ones first, then the others, then the places of no candidate
    rank = np.argsort(np.where(keep, 0, np.where(near >= 0, 1, 2)), axis=1, kind="stable")[:, :links]
    return np.take_along_axis(near, rank, axis=1)


def link_back(back: np.ndarray, back_sims: np.ndarray, source: np.ndarray, target: np.ndarray, sims: np.ndarray) -> None:
    """Add each source to its target's back links, of which the nearest stay."""
    links = back.shape[1]
    order = np.lexsort((-sims, target))
    source, target, sims = source[order], target[order], sims[order]
    nodes, begins = np.unique(target, return_index=True)
    row = np.repeat(np.arange(len(nodes)), np.diff(begins, append=len(target)))
    place = np.arange(len(target)) - begins[row]
    fits = place < links
    new, new_sims = np.full((len(nodes), links), -1, back.dtype), np.full((len(nodes), links), -np.inf, np.float32)
    new[row[fits], place[fits]], new_sims[row[fits], place[fits]] = source[fits], sims[fits]
    ids, s = np.concatenate([back[nodes], new], axis=1), np.concatenate([back_sims[nodes], new_sims], axis=1)
    best = np.argpartition(-s, links - 1, axis=1)[:, :links]
    back[nodes], back_sims[nodes] = np.take_along_axis(ids, best, axis=1), np.take_along_axis(s, best, axis=1)


def inserted(x: np.ndarray, links: int, entry_of, first: int) -> np.ndarray:
    """(n, 2 * links) neighbours of the rows of `x`, inserted in order, -1 where there are fewer: half chosen, half back links.

    `entry_of` gives the place where the search of each row begins; the first `first` rows are those of the level above.
    """
    n = len(x)
    out = np.full((n, 2 * links), -1, np.int32)
    chosen, back, back_sims = out[:, :links], out[:, links:], np.full((n, links), -np.inf, np.float32)
    done = 0
    while done < n:
        size = min(max(done, 64), BLOCK, n - done)
        if done < first:
            size = min(size, first - done)
        q = x[done : done + size]
        # what the block's rows are to each other
        s = q @ q.T
        np.fill_diagonal(s, -np.inf)
        near = np.where(s > -np.inf, np.arange(done, done + size), -1)
        if done:
            ids, sims = beam_search(q, x[:done], out[:done], entry_of(q, done), BUILD_BEAM)
            near, s = np.concatenate([ids, near], axis=1), np.concatenate([sims, s], axis=1)
        width = min(3 * links, near.shape[1])
        top = np.argpartition(-s, width - 1, axis=1)[:, :width]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
        near, s = np.take_along_axis(near, top, axis=1), np.take_along_axis(s, top, axis=1)
        picked = diverse(near, s, x, links)
        chosen[done : done + size, : picked.shape[1]] = picked
        source = np.repeat(np.arange(done, done + size), picked.shape[1])
        target = picked.ravel()
        there = target >= 0
        source, target = source[there], target[there]
        if len(target):
            link_back(back, back_sims, source, target, np.einsum("nd,nd->n", x[source], x[target]))
        done += size
    return out


def build(x: np.ndarray, links: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the rows in the graph, and the neighbours at each level, lowest first; a level holds the first rows."""
    n = len(x)
    rng = np.random.default_rng(seed)
    height = np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(max(links, 2))).astype(int)
    order = np.argsort(-height, kind="stable")
    x = x[order]
    norms = np.einsum("ij,ij->i", x, x)
    lifted = np.concatenate([x, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]], axis=1).astype(np.float32)
    levels: list[np.ndarray] = []
    for level in range(int(height.max(initial=0)), -1, -1):
        size = int((height >= level).sum())
        above = list(levels)

        def entry_of(q: np.ndarray, done: int) -> np.ndarray:
            first = len(above[0]) if above else 0
            return descend(q, lifted, above) if above and done >= first else np.zeros(len(q), np.int64)

        levels.insert(0, inserted(lifted[:size], links, entry_of, len(above[0]) if above else 0))
    return order, levels


def descend(q: np.ndarray, x: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """A near row for each query, from the highest of `levels` (lowest first) down."""
    entry = np.zeros(len(q), np.int64)
    for neighbours in reversed(levels):
        entry = beam_search(q, x[: len(neighbours)], neighbours, entry, EXPAND)[0][:, 0]
    return entry


def search(q: np.ndarray, x: np.ndarray, levels: list[np.ndarray], beam: int) -> np.ndarray:
    """Rows found for each query, best first, -1 where there are fewer."""
    return beam_search(q, x, levels[0], descend(q, x, levels[1:]), beam)[0]


GRAPH = "dim long, shard long, vectors binary, ids binary, id_counts binary, level_sizes array<long>, neighbours binary"


def graphs(distinct: DataFrame, shards: int, links: int = LINKS) -> DataFrame:
    """One row for each shard: its vectors, their ids and the flat arrays of its graph."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        dim, shard = (k.as_py() for k in key)
        x = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, dim)
        order, levels = build(x, links, shard)
        ids = table.column("ids").to_pylist()
        row = {
            "dim": dim, "shard": shard, "vectors": x[order].astype("<f8").tobytes(),
            "ids": np.array([i for r in order for i in ids[r]], "<i8").tobytes(), "id_counts": np.array([len(ids[r]) for r in order], "<i4").tobytes(),
            "level_sizes": [len(n) for n in levels], "neighbours": b"".join(n.astype("<i4").tobytes() for n in levels),
        }
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table({c: pa.array([v], k) for (c, v), k in zip(row.items(), kinds)})

    dealt = distinct.select("key", "v", "ids", F.size("v").cast("long").alias("dim"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("dim", "shard").applyInArrow(run, GRAPH)


def unpacked(row: dict) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Vectors, levels, ids and the place where each vector's ids begin (and the last end)."""
    x = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
    flat = np.frombuffer(row["neighbours"], "<i4").reshape(sum(row["level_sizes"]), -1)
    levels = np.split(flat, np.cumsum(row["level_sizes"])[:-1])
    return x, levels, np.frombuffer(row["ids"], "<i8"), np.concatenate([[0], np.cumsum(np.frombuffer(row["id_counts"], "<i4"))])


def ranked(found: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k + 1 best ids of each query, by exact score and then id."""
    at, col = np.nonzero(found >= 0)
    node = found[at, col]
    exact = np.einsum("nd,nd->n", q[at], x[node])

    def best(at: np.ndarray, score: np.ndarray, tie: np.ndarray) -> np.ndarray:
        order = np.lexsort((tie, -score, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        return order[place <= k]

    # no id of a vector can be among the k + 1 best unless its smallest one puts the vector there
    few = best(at, exact, ids[begins[node]])
    at, node, exact = at[few], node[few], exact[few]
    counts = begins[node + 1] - begins[node]
    each = np.repeat(np.arange(len(node)), counts)
    names = ids[begins[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)]
    few = best(at[each], exact[each], names)
    return at[each][few], names[few], exact[each][few]


def nearest(vectors: DataFrame, k: int = K, beam: int = BEAM, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    distinct = stored(distinct_vectors(vectors, k), "vectors")
    # all ids of a query vector count, not just the few that are kept as candidates
    is_query = usable() & (F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    queries = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("q")).dropDuplicates(["query_id", "q"])
    queries = stored(queries.withColumn("key", F.unhex(F.sha2(F.to_json("q"), 256))), "queries")
    numbers = distinct.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()[0]
    n_queries = queries.count()
    if not numbers or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(LEAST_SHARDS, -(-numbers // SHARD))
    index = stored(graphs(distinct, shards), "graphs")

    # equal query vectors are searched once
    unique = stored(queries.groupBy("key").agg(F.first("q").alias("q"), F.count(F.lit(1)).alias("weight")), "query-vectors")
    blocks = max(1, -(-n_queries // BLOCK))
    # a task takes up to BLOCKS_TO_TASK blocks to one shard, whose graph it gets once
    parts = max(1, -(-blocks // BLOCKS_TO_TASK))

    def block(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        q = np.asarray(table.column("q").combine_chunks().flatten()).reshape(-1, dim)
        packed = (b"".join(x.as_py() for x in table.column("key")), q.astype("<f8").tobytes())
        return pa.table({"dim": pa.array([dim]), "block": table.column("block").slice(0, 1), "query_keys": pa.array([packed[0]], pa.binary()), "queries": pa.array([packed[1]], pa.binary())})

    dealt = unique.select("key", "q", F.size("q").cast("long").alias("dim"), F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
    packed = dealt.groupBy("dim", "block").applyInArrow(block, "dim long, block long, query_keys binary, queries binary")
    packed = packed.withColumn("part", F.pmod("block", F.lit(parts))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def look(key: tuple, graph: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if graph.num_rows:
            x, levels, ids, begins = unpacked(graph.to_pylist()[0])
            narrow = x.astype(np.float32)
            for query_keys, data in zip(asked.column("query_keys").to_pylist(), asked.column("queries")):
                q = np.frombuffer(data.as_py(), "<f8").reshape(-1, x.shape[1])
                at, names, score = ranked(search(q.astype(np.float32), narrow, levels, beam), q, x, ids, begins, k)
                out.append(pa.table([pa.array([query_keys[32 * i : 32 * i + 32] for i in at.tolist()], pa.binary()), pa.array(names), pa.array(score)], schema=HITS))
        return pa.concat_tables(out) if out else HITS.empty_table()

    each = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    same = ("dim", "shard", "part")
    hits = each.groupBy(*same).cogroup(packed.groupBy(*same)).applyInArrow(look, "query_key binary, vec_id long, score double")
    # k + 1 candidates hold the k nearest even where one of them is the query itself
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    hits = stored(hits.join(unique.select(F.col("key").alias("query_key"), "weight"), "query_key"), "hits")
    mine = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    asked = queries.select("query_id", F.col("key").alias("query_key"))
    pairs = join_on_key(asked, hits, "query_key", "weight", n_queries).where("vec_id != query_id")
    return pairs.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


HITS = pa.schema([("query_key", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
