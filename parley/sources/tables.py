"""The tables that the queries read, and how they play meetings, segments and processes.

Reading is lazy, so filters and column selections reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.text import word_count


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation: conv_id, meeting_id, title, created_at, folder_path."""
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select(
        "conv_id",
        F.concat(F.lit("meeting-"), "conv_id").alias("meeting_id"),
        F.concat(F.lit("Conversation "), "conv_id").alias("title"),
        F.expr("timestampadd(HOUR, conv_id, TIMESTAMP '2024-01-01 00:00:00')").alias("created_at"),
        F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("/rec/"), "conv_id")).alias("folder_path"),
    )


def timed(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Synthetic timing: 0.4 s for each word, 0.5 s at least, one after the other within `key`.

    Tenths of seconds are added as whole numbers, so sums don't depend on their order.
    """
    tenths = F.greatest(4 * word_count(text), F.lit(5)).cast("long")
    end = F.sum("tenths").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("tenths", tenths).withColumn("end_tenths", end)
    return out.withColumns({"start_s": (F.col("end_tenths") - F.col("tenths")) / 10.0, "end_s": F.col("end_tenths") / 10.0, "dur": F.col("tenths") / 10.0}).drop("tenths", "end_tenths")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, meeting_id, seq, role, text, start_s, end_s, dur."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("meeting-"), "conv_id").alias("meeting_id"), F.col("turn").alias("seq"), "role", "text")
    return timed(rows, "conv_id", "seq")


#: The same two as common table expressions for DuckDB.
MEETINGS = """m AS (SELECT DISTINCT conv_id, 'meeting-' || conv_id AS meeting_id, 'Conversation ' || conv_id AS title,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) AS created_at, CASE WHEN conv_id % 5 <> 0 THEN '/rec/' || conv_id END AS folder_path FROM conversations)"""
SEGMENTS = r"""seg AS (SELECT conv_id, 'meeting-' || conv_id AS meeting_id, turn AS seq, role, text,
  CAST(e - t AS DOUBLE) / 10 AS start_s, CAST(e AS DOUBLE) / 10 AS end_s, CAST(t AS DOUBLE) / 10 AS dur FROM (
  SELECT *, sum(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM (
  SELECT *, greatest(4 * len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 5) AS t FROM conversations)))"""
