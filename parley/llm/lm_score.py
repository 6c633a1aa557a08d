"""Language-model scores by stupid backoff over the corpus's own n-gram counts.

The count tables of words and word pairs are partitioned by hash. Documents are kept in batches; a
batch sends each of its distinct n-grams to the table once, the table answers with the corpus-wide
counts, and these are joined to the batch's n-grams and summed for each document:
log c(u v) / c(u) where the pair occurs at least `least` times, else log ALPHA * c(v) / N. With
`least` 1, as here, every pair of the corpus counts; a larger one lets rare pairs back off.

Defined results: null and empty texts have no words and score 0; the first word of a text is scored
by its own frequency; words are split at ASCII white space and lower-cased in A-Z; repeated rows
count as often as they occur; an empty table gives an empty result; other columns are ignored; very
long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import join_on_key, stored, text_slices
from parley.llm.exact_dedup import ascii_lower
from parley.llm.hash_counts import BATCH_KEYS, Bucketed, answers, buckets_for, counted_keys, key_width, looked_up, mixed, narrowed, pack_keys, unpack_keys

ALPHA, LEAST = 0.4, 1
STEP = np.uint64(0x9E3779B97F4A7C15)


def batched(docs: DataFrame) -> DataFrame:
    """Batches of documents: batch, doc_ids, sizes (words of each), words (distinct, packed) and places (which word, in order)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        hashes: list[np.ndarray] = []
        word = xxhash.xxh3_64_intdigest

        def flushed() -> pa.RecordBatch:
            nonlocal n, ids, sizes, hashes
            words, places = np.unique(np.concatenate(hashes), return_inverse=True)
            columns = [pa.array([f"{part}-{n}"]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack_keys(words)], pa.binary()), pa.array([places.astype("<u4").tobytes()], pa.binary())]
            n, ids, sizes, hashes = n + 1, [], [], []
            return pa.RecordBatch.from_arrays(columns, ["batch", "doc_ids", "sizes", "words", "places"])

        for rows, texts in text_slices(batches):
            lists = [t.encode().lower().split() for t in texts]
            ids += rows.column("doc_id").to_pylist()
            sizes += map(len, lists)
            hashes.append(mixed(np.array([word(w) for x in lists for w in x], np.uint64)))
            if sum(map(len, hashes)) >= 2 * BATCH_KEYS:  # larger batches repeat more of their n-grams
                yield flushed()
        if ids:
            yield flushed()

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "batch string, doc_ids array<long>, sizes array<int>, words binary, places binary")


def grams(sizes: list[int], words: bytes, places: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of each word, of the pair that it ends, and whether it has a word before it."""
    key = unpack_keys(words)[np.frombuffer(places, "<u4")]
    inner = np.ones(len(key), bool)
    starts = np.cumsum([0, *sizes])[:-1]
    inner[starts[starts < len(key)]] = False
    pair = np.zeros(len(key), np.uint64)
    pair[1:] = mixed(key[:-1] * STEP + key[1:] + np.uint64(1))
    return narrowed(key, width), narrowed(pair, width), inner


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])


def score(docs: DataFrame, least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, log_score; pairs that occur less than `least` times back off."""
    table = Bucketed(batched(docs), "words", "batch")
    batches = table.rows
    total = batches.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    width = key_width(2 * total)
    buckets = buckets_for(2 * total, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def all_keys(sizes: list[int], words: bytes, places: bytes) -> np.ndarray:
        key, pair, inner = grams(sizes, words, places, width)
        return np.concatenate([key, pair[inner]])

    counted = counted_keys(batches, buckets, width, least=2, columns=("sizes", "words", "places"), keys_of=all_keys)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, counts = answers(right, width)
        parts = []
        for row in left.to_pylist():
            key, pair, inner = grams(row["sizes"], row["words"], row["places"], width)
            one = np.maximum(looked_up(key, known, counts), 1).astype(float)  # a word that isn't in the answer occurs once
            two = np.where(inner, np.maximum(looked_up(pair, known, counts), 1), 0)  # and so does such a pair
            before = np.concatenate([[1.0], one[:-1]]) if len(one) else one
            log = np.log(np.where(inner & (two >= least), two / before, np.where(inner, alpha, 1.0) * one / total))
            sums = np.concatenate([[0.0], np.cumsum(log)])
            ends = np.cumsum(row["sizes"])
            parts.append(pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(sums[ends] - sums[ends - row["sizes"]])], schema=OUT))
        return pa.concat_tables(parts) if parts else OUT.empty_table()

    scored = stored(batches.groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(run, "doc_id long, n_words long, log_score double"), "scores")
    table.drop()
    return scored


def hashed_words(text: Column) -> Column:
    """The hashes of a text's words, in order."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def score_rows(docs: DataFrame, least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """The same scores with a row for each n-gram, in DataFrame operations alone.

    A table of pair counts, with the counts of their words joined to it, is joined to the exploded
    pairs. No blocks, no Python; but it exchanges each pair of each document, which is several times
    the input (see the README).
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), hashed_words(F.col("text")).alias("w"))
    rows = stored(rows, "hashed-words")
    ones = stored(rows.select(F.explode("w").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c")), "word-counts")
    total = ones.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    pairs = rows.select("row", F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("u"), F.slice("w", 2, F.size("w")).alias("v"))).alias("g")).select("row", "g.u", "g.v")
    twos = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    left, right = ones.select(F.col("v").alias("u"), F.col("c").alias("c_u")), ones.select("v", F.col("c").alias("c_v"))
    logs = twos.join(left, "u").join(right, "v").select("u", "v", "n", F.log(F.when(F.col("n") >= least, F.col("n") / F.col("c_u")).otherwise(alpha * F.col("c_v") / total)).alias("log"))
    placed = join_on_key(pairs.withColumn("uv", F.struct("u", "v")).select("row", "uv"), stored(logs.select(F.struct("u", "v").alias("uv"), "n", "log"), "pair-scores"), "uv", "n", total)
    first = rows.where(F.size("w") > 0).select("row", F.get("w", F.lit(0)).alias("v")).join(right, "v").select("row", F.log(F.col("c_v") / total).alias("log"))
    sums = placed.select("row", "log").union(first).groupBy("row").agg(F.sum("log").alias("log_score"))
    return rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words")).join(sums, "row", "left").select("doc_id", "n_words", F.coalesce("log_score", F.lit(0.0)).alias("log_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("log_score", F.round("log_score", 3))


ORACLE = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT doc_id, unnest(ws) AS v, unnest(list_concat([NULL], ws[1:len(ws) - 1])) AS u FROM d WHERE len(ws) > 0),
one AS (SELECT v, count(*) AS c FROM g GROUP BY v),
two AS (SELECT u, v, count(*) AS c FROM g WHERE u IS NOT NULL GROUP BY u, v),
n AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT g.doc_id, sum(ln(CASE WHEN two.c >= 1 THEN two.c / b.c ELSE (CASE WHEN g.u IS NULL THEN 1.0 ELSE 0.4 END) * CAST(a.c AS DOUBLE) / n.n END)) AS total
  FROM g CROSS JOIN n JOIN one a ON a.v = g.v LEFT JOIN one b ON b.v = g.u LEFT JOIN two ON two.u = g.u AND two.v = g.v
  GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s.total, 0.0), 3) AS log_score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
