"""Corpus-wide counts of hashed keys (shingles, n-grams), with documents kept together in batches.

One row for each key and document would be many times the input. Here a batch of documents keeps its
distinct keys in one binary column, and only these, dealt by hash into buckets, are exchanged: each
bucket adds up what all batches have of its keys and answers each batch. However common a key is, a
batch sends it once, so no bucket grows faster than the number of batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.common import removed, scratch_path

#: Keys of a batch at about which it is closed.
BATCH_KEYS = 1 << 18
#: Input to a bucket of a table, and so many buckets at most (a task may open a file for each).
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 1 << 16
#: Keys to a bucket that fit a worker with ease.
BUCKET_KEYS = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def key_width(total: int) -> int:
    """Bytes of a key, 6 to 8: as many as leave about one of `total` keys in 2^18 a namesake."""
    return min(8, max(6, -(-(max(total, 1).bit_length() + 18) // 8)))


def narrowed(keys: np.ndarray, width: int) -> np.ndarray:
    """The high bytes of 64-bit keys."""
    return keys >> np.uint64(64 - 8 * width)


def pack_keys(keys: np.ndarray, width: int = 8) -> bytes:
    """The low `width` bytes of each key: the low four of all, then each higher byte of all, which compresses where keys are sorted."""
    high = [(keys >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(4, width)]
    return b"".join([(keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), *high])


def unpack_keys(data: bytes, width: int = 8) -> np.ndarray:
    n = len(data) // width
    keys = np.frombuffer(data, "<u4", n).astype(np.uint64)
    for i in range(4, width):
        keys |= np.frombuffer(data, np.uint8, n, i * n).astype(np.uint64) << np.uint64(8 * i)
    return keys


def buckets_for(total_keys: int, least: int) -> int:
    """So many buckets that each holds about BUCKET_KEYS keys, and at least as many as tasks should run."""
    return max(1, min(1 << 31, max(least, -(-total_keys // BUCKET_KEYS))))


def bucket_of(keys: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """Buckets are ranges of the high 32 bits."""
    return ((keys >> np.uint64(8 * width - 32)) * np.uint64(buckets)) >> np.uint64(32)


def slots(keys: np.ndarray, buckets: int, width: int, whole: bool) -> np.ndarray:
    """What is counted: the whole key, or its bucket and low 32 bits (a few keys then share a count)."""
    return keys if whole else (bucket_of(keys, buckets, width) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def counted_keys(batches: DataFrame, buckets: int, width: int, least: int = 1, whole: bool = True, columns: tuple[str, ...] = ("keys",), keys_of: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """(batch, bucket, keys, counts): for each batch its keys with a corpus-wide count of at least `least`.

    `batches` has batch (string) and `columns`, from whose values `keys_of` makes a batch's keys of
    `width` bytes in any order, as often as they count (by default: one column of packed keys). With
    `whole` false a bucket is sent the low 32 bits of its keys only, which saves a third of the
    exchange; keys that agree in them and in the bucket get the sum of their counts.
    """
    keys_of = keys_of or (lambda d: unpack_keys(d, width))
    pack = (lambda k: pack_keys(k, width)) if whole else (lambda k: k.astype("<u4").tobytes())

    def deal(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for name, *data in zip(*(part.column(c) for c in ("batch", *columns))):
                keys, counts = np.unique(slots(keys_of(*(d.as_py() for d in data)), buckets, width, whole), return_counts=True)
                if not len(keys):
                    continue
                bucket = bucket_of(keys, buckets, width) if whole else keys >> np.uint64(32)
                used, begins = np.unique(bucket, return_index=True)
                ends = [*begins[1:], len(keys)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int64)),
                        pa.array([name.as_py()] * len(used)),
                        pa.array([pack(keys[a:b]) for a, b in zip(begins, ends)], pa.binary()),
                        pa.array([counts[a:b].astype("<u4").tobytes() for a, b in zip(begins, ends)], pa.binary()),
                    ],
                    ["bucket", "batch", "keys", "counts"],
                )

    def add_up(table: pa.Table) -> pa.Table:
        names, buckets_ = table.column("batch").to_pylist(), table.column("bucket").to_pylist()
        load = (lambda d: unpack_keys(d, width)) if whole else (lambda d: np.frombuffer(d, "<u4"))
        parts = [load(d.as_py()) for d in table.column("keys")]
        counts = [np.frombuffer(d.as_py(), "<u4") for d in table.column("counts")]
        keys, n = np.concatenate(parts), np.concatenate(counts).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sums = np.empty(len(keys), np.int64)
        sums[order] = np.repeat(np.add.reduceat(n[order], heads), np.diff(heads, append=len(keys)))
        out, at = [], 0
        for name, bucket, k in zip(names, buckets_, parts):
            mine = sums[at : at + len(k)]
            at += len(k)
            keep = mine >= least
            if keep.any():
                out.append((name, bucket, pack(k[keep]), np.minimum(mine[keep], 0xFFFFFFFF).astype("<u4").tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(SHAPE)], schema=SHAPE)

    dealt = batches.select("batch", *columns).mapInArrow(deal, "bucket long, batch string, keys binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(add_up, "batch string, bucket long, keys binary, counts binary")


SHAPE = pa.schema([("batch", pa.string()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def answers(table: pa.Table, width: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The slots of one batch, sorted, and their counts, from its rows of `counted_keys`."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if whole:
        keys = [unpack_keys(d.as_py(), width) for d in table.column("keys")]
    else:
        keys = [np.frombuffer(d.as_py(), "<u4").astype(np.uint64) | (np.uint64(b) << np.uint64(32)) for d, b in zip(table.column("keys"), table.column("bucket").to_pylist())]
    keys = np.concatenate(keys)
    counts = np.concatenate([np.frombuffer(d.as_py(), "<u4") for d in table.column("counts")]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def looked_up(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each key, 0 where it isn't known (`known` is sorted)."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0)


class Bucketed:
    """`rows` as a table bucketed by `key`: joining or grouping by the key doesn't shuffle it. `drop` frees its disk.

    The files lie in the shared folder, whatever the warehouse is. There are as many buckets as shuffles have
    partitions, or as `bytes_in` asks for at about BUCKET_BYTES each.
    """

    def __init__(self, rows: DataFrame, name: str, key: str, bytes_in: int = 0):
        self.spark, self.table, self.path = rows.sparkSession, f"{name}_{uuid.uuid4().hex}", scratch_path(rows.sparkSession, name)
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, -(-bytes_in // BUCKET_BYTES)))
        writer = rows.write.format("parquet").option("compression", "zstd").option("parquet.block.size", 16 << 20).option("path", self.path)
        if n > int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
            self.spark.conf.set("spark.sql.sources.bucketing.maxBuckets", n)
        writer.bucketBy(n, key).saveAsTable(self.table)
        self.rows = self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        removed(self.spark, self.path)
