"""How filters interact: which of five conditions removes what, in every order of application.

Each document becomes a 32-bit word, its truth table: bit S is set if the document survives the set S of
filters (S itself five bits, A lowest). Positional popcounts over these words give the survivors of every
subset at once, for each part and label; a carry-save adder tree takes them, three words to a sum and a
carry, so each word costs a few operations and not 32. Everything asked of an order of filters is a difference
of survivors: what a step removes, what an earlier one has removed already, what nothing else would.

Filters (words: maximal runs without ASCII white space, case-sensitive): A fewer than 100 words, B fewer than
80 % distinct words, C over 10 % capitals A-Z, D a character of [#$%&*|], E the text of a smaller doc_id.

A document's marks are written once; equal texts meet by digest as (digest, doc_id, part) with a count, so
neither copies nor repeated rows pile up, and the first of a text is found by a join on digest and id.

Defined results: null text counts as empty; null lang is the part ''; a row repeated with its id fails E only
if a smaller id has its text; a null id neither fails E nor makes others fail; a document is good or toxic if
any of its labels says 1, null labels and labels without an id say nothing; repeated rows count as often as they
occur; an empty table has no parts; other columns are ignored; long texts are read in blocks of a megabyte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import byte_words, stored, text_slices

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"
#: For each set of failed filters the word of subsets that a document survives: those which hold none of them.
SURVIVED = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], dtype=np.uint32)
#: Parts whose counts a task keeps before it passes them on.
PARTS = 1024


def failed_alone(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = 0, set()
    for words in byte_words(text):
        n += len(words)
        distinct.update(words)
    data = text.encode("utf-8", "surrogatepass")
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (n < 100) | (100 * len(distinct) < 80 * n) << 1 | (100 * capitals > 10 * len(text)) << 2 | (len(data.translate(None, SIGNS)) < len(data)) << 3


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed, digest) of each document: A to D and the SHA-256 of its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            failed = pa.array([failed_alone(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), failed, digests], ["doc_id", "part", "failed", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, failed int, digest binary")


def carry_save(words: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """How often each of the 32 bits is set in `words`, each of which counts `times`.

    Level k holds words whose bits stand for 2^k. Three of them are replaced by their sum at the level and
    their carry one above, until at most two are left to be counted bit by bit.
    """
    times = np.ones(len(words), np.int64) if times is None else times
    levels = [words[(times >> k) & 1 == 1] for k in range(int(times.max(initial=0)).bit_length())]
    total, k = np.zeros(32, np.int64), 0
    while k < len(levels):
        level, carries = levels[k], []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * n :]])
        for word in level:
            total += ((int(word) >> np.arange(32)) & 1) << k
        if carries:
            above = [levels[k + 1]] if k + 1 < len(levels) else []
            levels[k + 1 : k + 2] = [np.concatenate(above + carries)]
        k += 1
    return total


def survivors(rows: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic) from rows (part, failed, good, toxic, n): documents that survive each subset."""
    names = ["part", "subset", "n", "good", "toxic"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            counts = np.concatenate([*sums.values()], axis=1) if sums else np.zeros((3, 0), np.int64)
            parts, subsets = [p for p in sums for _ in range(SUBSETS)], np.tile(np.arange(SUBSETS), len(sums))
            columns = [pa.array(parts, pa.string()), pa.array(subsets, pa.int64()), *map(pa.array, counts)]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            part = batch.column("part").dictionary_encode()
            words = SURVIVED[batch.column("failed").to_numpy(zero_copy_only=False)]
            times = batch.column("n").to_numpy(zero_copy_only=False)
            classes = [np.ones(len(words), bool), *(batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic"))]
            order = np.argsort(part.indices.to_numpy(zero_copy_only=False), kind="stable")
            code = part.indices.to_numpy(zero_copy_only=False)[order]
            for at in np.split(order, np.flatnonzero(np.diff(code)) + 1) if len(order) else []:
                name = part.dictionary[int(part.indices[int(at[0])].as_py())].as_py()
                found = np.stack([carry_save(words[at[c[at]]], times[at[c[at]]]) for c in classes])
                sums[name] = sums[name] + found if name in sums else found
            if len(sums) > PARTS:
                yield out()
        yield out()

    counted = rows.select("part", "failed", "good", "toxic", "n").mapInArrow(run, "part string, subset long, n long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in names[2:]))


def by_order(counts: DataFrame) -> DataFrame:
    """The report of every order of the filters from `survivors`."""
    orders, full = list(permutations(range(len(FILTERS)))), SUBSETS - 1
    longs = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def part_rows(part: str, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
        shapley = []
        for f in range(len(FILTERS)):
            without = [s for s in range(SUBSETS) if not s >> f & 1]
            orders_of = [factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) for s in without]
            shapley.append(sum(w * int(n[s] - n[s | 1 << f]) for s, w in zip(without, orders_of)))
        for order in orders:
            before = 0
            for step, f in enumerate(order, 1):
                after = before | 1 << f
                removed = n[before] - n[after]
                yield (
                    part, "".join(FILTERS[x] for x in order), step, n[after], removed, n[0] - n[1 << f] - removed,
                    n[full ^ 1 << f] - n[full], good[before] - good[after], toxic[before] - toxic[after], shapley[f],
                )
                before = after

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = np.array([[c["n"], c["good"], c["toxic"]] for c in sorted(row["counts"], key=lambda c: c["subset"])], np.int64).T
                columns = zip(*part_rows(row["part"], *table))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(longs)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["part", "filter_order", "step", *longs])

    parts = counts.groupBy("part").agg(F.collect_list(F.struct("subset", "n", "good", "toxic")).alias("counts"))  # 32 of a part
    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, failed, good, toxic, n): all five filters and the labels; n rows of a document are one."""
    found = stored(marks(docs), "audit-marks")
    rows = found.groupBy("digest", "doc_id", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    first = found.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    late = F.col("first").isNull() & F.col("doc_id").isNotNull()
    rows = rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(late, F.col("failed").bitwiseOR(F.lit(16))).otherwise(F.col("failed")).alias("failed"), "n")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.join(known, "doc_id", "left").select("doc_id", "part", "failed", no("good"), no("toxic"), "n")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return by_order(survivors(failures(docs, labels)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
  100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w LEFT JOIN k USING (doc_id)),
g AS (SELECT part, list_value(a, b, c, d, e) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [v.i, w.i, x.i, y.i, z.i] AS p FROM l v, l w, l x, l y, l z WHERE len(list_distinct([v.i, w.i, x.i, y.i, z.i])) = 5),
s AS (SELECT list_aggregate(list_transform(p, lambda i: chr(64 + CAST(i AS INTEGER))), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step, p[step] AS own, p[1:step - 1] AS before FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)),
r AS (SELECT g.part, filter_order, step, own,
  sum(CASE WHEN NOT fails[own] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: fails[i])), false) THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails[own] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: fails[i])), false) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails[own] AND coalesce(list_bool_or(list_transform(before, lambda i: fails[i])), false) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails[own] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails[own] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: fails[i])), false) THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails[own] AND NOT coalesce(list_bool_or(list_transform(before, lambda i: fails[i])), false) THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY g.part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
