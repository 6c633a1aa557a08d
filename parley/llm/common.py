"""Helpers that the corpus operators share: scratch tables, free column names, hot-key joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (binds pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    A session on one machine that names none gets a temporary folder, kept in its configuration; on a
    cluster that would be no shared folder, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.parley.scratch", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.parley.scratch", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parley/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of executors without repeating what came
    before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, wherever that is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def share_bound(wanted: int, total: int) -> int:
    """The bound under which `wanted` of `total` 63-bit hashes lie, about; at least one step of 2^63 wide, so never none."""
    return (1 << 63) - 1 if wanted >= total else max(1, (wanted << 63) // total)


def hash63(*columns: Column | str) -> Column:
    """A hash of 63 bits, at least 0."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def free_name(df: DataFrame, base: str) -> str:
    """`base`, or `base` with a number where `df` already has such a column."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def join_on_key(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of `rows` with `table` (one row for each key) without a hot key in one task.

    Keys whose `weight` is over a thousandth of `total` number fewer than a thousand, whatever the
    input; those few are broadcast, everything else goes through a sort-merge join in which no key
    has more than that share.
    """
    least = max(1000, total // 1000)
    hot = F.broadcast(table.where(F.col(weight) > least))
    cold = table.where(F.col(weight) <= least)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold.hint("merge"), key))


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut where their text adds up to about `chars`; null text becomes ''.

    Bounds what a Python worker holds whatever the length of single texts.
    """
    for batch in batches:
        sizes = batch.column(column)
        if sizes.null_count:
            sizes = sizes.fill_null("")
        lengths = pa.compute.binary_length(sizes).to_pylist()
        start, have = 0, 0
        for i, n in enumerate(lengths):
            if have and have + n > chars:
                yield batch.slice(start, i - start), sizes.slice(start, i - start).to_pylist()
                start, have = i, 0
            have += n
        if start < len(lengths):
            yield batch.slice(start), sizes.slice(start).to_pylist()


SPACE = re.compile(rb"[\x20\x09-\x0D]")


def byte_words(text: str, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of `text` in UTF-8, a list for each block of about `block` bytes.

    `bytes.split` cuts at just these six characters, which UTF-8 never has within another one.
    """
    data, start = text.encode("utf-8", "surrogatepass"), 0
    while start < len(data):
        gap = SPACE.search(data, start + block) if start + block < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end
