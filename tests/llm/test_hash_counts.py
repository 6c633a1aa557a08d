import collections

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import hash_counts as h


@pytest.mark.parametrize("width", [6, 7, 8])
def test_keys_keep_their_high_bytes(width):
    keys = h.mixed(np.arange(1000, dtype=np.uint64))
    narrow = h.narrowed(keys, width)
    data = h.pack_keys(narrow, width)
    assert len(data) == 1000 * width and (h.unpack_keys(data, width) == narrow).all()
    for buckets in (1, 7, 1 << 20, 1 << 31):
        bucket = h.bucket_of(narrow, buckets, width)
        assert (bucket < buckets).all() and (bucket == h.bucket_of(keys, buckets, 8)).all()


def test_width_and_buckets_grow_with_the_corpus():
    assert [h.key_width(n) for n in (0, 10**6, 10**9, 10**12, 10**14, 10**18)] == [6, 6, 6, 8, 8, 8]
    assert h.buckets_for(0, 8) == 8
    for total in (10**9, 10**12, 10**15):
        assert total / h.buckets_for(total, 8) <= h.BUCKET_KEYS


@pytest.mark.parametrize("whole", [True, False])
def test_counts_of_all_batches(spark, whole):
    rng = np.random.default_rng(1)
    keys = h.narrowed(h.mixed(np.arange(500, dtype=np.uint64)), 6)
    batches = [rng.choice(keys, 300) for _ in range(5)]
    rows = spark.createDataFrame([(str(i), bytearray(h.pack_keys(b, 6))) for i, b in enumerate(batches)], "batch string, keys binary")
    want = collections.Counter(np.concatenate(batches).tolist())
    found = h.counted_keys(rows, 9, 6, least=2, whole=whole).collect()
    for i, b in enumerate(batches):
        mine = [r for r in found if r.batch == str(i)]
        table = pa.Table.from_arrays([pa.array([getattr(r, f.name) for r in mine], f.type) for f in h.SHAPE], schema=h.SHAPE)
        known, counts = h.answers(table, 6, whole=whole)
        got = h.looked_up(h.slots(b, 9, 6, whole), known, counts)
        assert got.tolist() == [want[k] if want[k] > 1 else 0 for k in b.tolist()]
