import hashlib
import os
import random
import struct

import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from parley.llm import bpe  # noqa: E402

CODEC = bpe.Codec(bpe.vocabulary())
LIB = Tokenizer.from_file(bpe.vocabulary())


def expected(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    decoded = LIB.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digests(text):
    return tuple(column[0] for column in CODEC.digests([text]))


CASES = [
    "", " ", "a", "Don't it's I'LL we've", "ab\u0085cd\x1cef\x1f  Σας ΟΔΟΣ İst x​y ²Ⅷ é é ́x",
    "<|endoftext|>a<|startoftext|> <|endoftext|", "a﻿b 힣각 漢字かな مرحبا", " 　tabs\tand\nnew\r\nlines\x0bv\x0cf",
    "!!!???...,,, ### $$$ 1234567890 ٣٤", "ﬁ ﬂ K Å \U0001d400 👩‍👩‍👧‍👦",
]


@pytest.mark.parametrize("text", CASES)
def test_like_the_library(text):
    assert CODEC.encode(text) == LIB.encode(text, add_special_tokens=False).ids
    assert digests(text) == expected(text)


def test_random_unicode():
    rng = random.Random(5)
    pools = ["abcdefghij", "aeiou'stll ", "éèêüßäöñ ", "ΣσςΑαΒ", "̣̀́ae ", " \t\n\x85 a1!", "漢字仮名ー한국어", "０１２３½²"]
    for _ in range(400):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60)))
        assert digests(text) == expected(text), repr(text)


def test_lookahead_suffices_for_long_words():
    rng = random.Random(7)
    syllables = ["th", "er", "on", "an", "ing", "tion", "a", "s", "ation", "e"]
    for alphabet in (["a"], ["a", "b"], syllables, list("etaoinshrdlu"), ["ab", "ba", "aa"]):
        word = "".join(rng.choice(alphabet) for _ in range(6000))
        machine = bpe.Transducer(CODEC.merges, CODEC.lengths, room=8)
        out = list(machine.feed(word.encode()))
        assert len(machine.buffer) < machine.most
        out += machine.close()
        assert out == LIB.encode(word, add_special_tokens=False).ids
        assert digests(word * 20) == expected(word * 20)


def test_blocks_do_not_change_results():
    text = ("The end is, near—and über-long words; " * 5000) + "x" * 100_000 + "é" * 5000
    assert digests(text) == expected(text)


def test_pieces_stay_open_across_small_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 6)
    rng = random.Random(11)
    pools = ["abcdefgh", "'stll ", "éß", "ΣσΑ", "\u0323\u0300ae", "\x85 a1", "漢字한", "12½", "!?.-", "<|endoftext|>"]
    for _ in range(1500):
        pool = rng.sample(pools, 3)
        text = "".join(rng.choice(rng.choice(pool)) if rng.random() < 0.95 else rng.choice(pools) for _ in range(rng.randint(0, 90)))
        assert digests(text) == expected(text), repr(text)
        assert CODEC.decode(CODEC.encode(text)) == LIB.decode(LIB.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_bank_and_single_transducers_agree():
    rng = random.Random(13)
    words = ["".join(rng.choice("etaoinshrdlucmé") for _ in range(rng.randint(1, 63))).encode()[:63] for _ in range(500)] + [b"a", b"'", "é".encode()]
    for word, ids in zip(words, CODEC.bank.encode(words, rows=64)):
        machine = bpe.Transducer(CODEC.merges, CODEC.lengths, room=8)
        assert [*machine.feed(word), *machine.close()] == list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_memo_ages_without_changing_results(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    rng = random.Random(17)
    for _ in range(40):
        texts = [" ".join(rng.choice(["the", "of", "tion"]) + rng.choice("abcdefgh") + rng.choice("123!") for _ in range(30)) for _ in range(3)]
        assert list(zip(*CODEC.digests(texts))) == list(map(expected, texts))


def test_byte_decoder_round_trip():
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    text = "naïve 漢字 👩‍👧 \n tabs\t"
    ids = lib.encode(text, add_special_tokens=False).ids
    machine = bpe.ByteDecoder({i: t for t, i in lib.get_vocab().items()})
    assert "".join(map(machine.feed, ids)) + machine.close() == text
    machine = bpe.ByteDecoder({i: t for t, i in lib.get_vocab().items()})
    cut = [i for i in ids if i != ids[2]][:-2]
    assert "".join(map(machine.feed, cut)) + machine.close() == lib.decode(cut, skip_special_tokens=False)


def test_query_rows(spark):
    rows = [(1, None), (2, ""), (3, "Ab ab"), (3, "Ab ab"), (None, "x")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, ids_sha256 string, n_tokens long")
    got = sorted(map(tuple, bpe.encode_digests(docs).collect()), key=str)
    assert got == sorted(((i, *expected(t)) for i, t in rows), key=str)
    assert bpe.encode_digests(docs.limit(0)).count() == 0
    assert bpe.encode(docs.where("doc_id = 2")).first().ids == []
