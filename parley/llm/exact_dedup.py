"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text. New data is
grouped by digest, what the index already holds is removed by a sort-merge anti-join, and the rest
is appended under the name of its batch. Only entries of the own batch keep a row, so a row that is
fed again is dropped like any other copy of what the index holds.

Defined results: null text counts as empty; texts are equal when they are identical after
lower-casing A-Z; of equal texts within a batch the largest doc_id stays (null is the smallest; of
repeated rows with that doc_id exactly one stays); an empty table gives an empty result; other
columns of the input are ignored by `assign` and carried through by `keep_unique`, whatever their
names; very long texts are digested as they are, one row at a time.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import free_name, join_on_key, scratch_path, stored


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else (pure ASCII text takes the faster `lower`)."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_digest(text: Column) -> Column:
    """32 bytes: SHA-256 of the normalised text in UTF-8."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """Table (digest, keep_id, group_size, batch), bucketed and sorted by digest, at `path`; batch names the append that made the entry."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, name: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digests")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> str:
        """Add the groups (digest, keep_id, group_size) whose digest the index doesn't have yet; the name of their batch."""
        batch = uuid.uuid4().hex
        have = self.rows().select(F.col("digest").alias("have")).hint("merge")
        # the condition on the size keeps the join above the aggregation: hot digests are combined before the exchange
        new = groups.join(have, (F.col("digest") == F.col("have")) & (F.col("group_size") > 0), "left_anti")
        (
            new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)
        return batch


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, part, n): how often a document occurs with a digest in a partition; stored, as the text is read once.

    The partition keeps n to the rows of one task, however often a row is repeated.
    """
    rows = docs.select(text_digest(F.col(text_col)).alias("digest"), F.col(id_col).cast("long").alias("doc_id"), F.spark_partition_id().alias("part"))
    return stored(rows.groupBy("digest", "doc_id", "part").agg(F.count(F.lit(1)).alias("n")), "digest-rows")


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_part, group_size) of each distinct text; null is the smallest id."""
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "part")).alias("keep"), F.sum("n").alias("group_size"))
    return groups.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.part").alias("keep_part"), "group_size")


def assign(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Appends new digests to `index` (a fresh one by default). A text that the index held before
    keeps the entry it has, so all its rows are dropped.
    """
    rows = counted(docs)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    index = index or DigestIndex(docs.sparkSession)
    groups = stored(grouped(rows), "digest-groups")
    batch = index.append(groups)
    # what is hot is told by this batch's own counts: they add up to `total`, those of the index may not
    mine = groups.select("digest", "keep_part", F.col("group_size").alias("weight"))
    entries = index.rows().join(mine.hint("merge"), "digest").withColumn("fresh", F.col("batch") == batch)
    placed = join_on_key(rows, stored(entries, "digest-entries"), "digest", "weight", total)
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    kept = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("part") == F.col("keep_part")) & (F.col("copy") == 1)
    return copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_unique(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    index = index or DigestIndex(docs.sparkSession)
    batch = index.append(grouped(counted(docs, id_col, text_col)))
    digest, key = free_name(docs, "digest"), free_name(docs, "keep_key")
    marked = docs.withColumns({digest: text_digest(F.col(text_col)), key: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))})
    stay = index.rows().where(F.col("batch") == batch).select(F.col("digest").alias(digest), F.coalesce("keep_id", F.lit(-(1 << 63))).alias(key))
    # the join leaves each text's rows together and sorted, so dropping repeated rows adds no shuffle
    return marked.join(stay.hint("merge"), [digest, key], "left_semi").dropDuplicates([digest, key]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
