import os
import random
import zlib

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from parley.llm import packing  # noqa: E402

LIB = Tokenizer.from_file(packing.vocabulary())


def ids_of(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_like_the_library():
    rng = random.Random(3)
    pools = ["abc ", "don't I'll ", "  \n\t", "É ü ß ñ ", "!!.,&&&%%%", "12 345²Ⅷ_", "漢字 ", "́\x85\x1c\xa0"]
    texts = ["", " ", "\n", "a\n\nb", "x <|endoftext|> y", "a b\nc d,", "re.\nErtion", " lead", "trail ", "a\n b", "it's_ok' 's"]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    encoder = packing.ByteLevelEncoder(packing.vocabulary())
    for _ in range(2):  # the second time from the memo
        for text, got in zip(texts, encoder.many(texts)):
            assert np.frombuffer(got, "<u4").tolist() == ids_of(text)[:-1], repr(text)


def test_differencing_places_each_item():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (5, 8), (50, 7), (300, 40)):
        sizes = rng.integers(1, 513, n)
        window, most = packing.differencing(sizes, k)
        sums = np.bincount(window, weights=sizes, minlength=k)
        assert len(window) == n and window.min() >= 0 and window.max() < k and sums.max() == most
    sums = np.bincount(packing.differencing(rng.integers(1, 513, 400), 40)[0], weights=None, minlength=40)
    assert sums.min() > 0
    sizes = np.array([8, 7, 6, 5, 4])
    assert packing.differencing(sizes, 2)[1] == 16  # the classical example: differencing leaves 16 and 14


def test_windows_rise_until_all_fit():
    sizes = np.array([2048, 2047, 2, 1, 1500, 1500])
    window = packing.pool_windows(sizes, 2048)
    assert np.bincount(window, weights=sizes).max() <= 2048


def test_every_id_is_in_one_piece(spark):
    rng = random.Random(4)
    words = ["the", "entint", "hehe,", "re.", "&&&", "é", "x" * 50]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 700, 6000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (None, "null id")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, offset int").repartition(3)
    pieces = packing.pack(docs).toPandas()
    by_doc = {}
    for doc, text in rows:
        by_doc.setdefault(doc, []).append(ids_of(text))
    for doc, same in by_doc.items():
        mine = pieces[pieces.doc_id.isna()] if doc is None else pieces[pieces.doc_id == doc]
        assert mine.length.sum() == sum(map(len, same)) and set(mine.doc_tokens) == {len(same[0])}
        for p in mine.itertuples():
            part = np.asarray(same[0][p.start : p.start + p.length], "<u4")
            assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= 2048
    used = pieces.groupby("sequence_id").length.sum()
    assert (2048 - used).sum() < 3 * 2 * 2048 + 0.02 * used.sum()
    assert packing.pack(docs.limit(0)).count() == 0
