"""BPE encoding and decoding as streaming transducers with bounded memory.

Encoding. A merge can depend on what follows only through merges of better rank that would take its
right part first, and those again only through merges of still better rank. The longest such chain
of a merge list, measured in symbols, is its sufficient lookahead: tokens that end that far before
the end of what has been read are final whatever follows. Every piece of text goes through such a
transducer: it reads symbols into a buffer of bounded length, applies the merges to it, emits the
tokens that are final and goes on from there; the end of the piece makes the rest final. Pieces that
end within the buffer are many and short: a bank of transducers takes them in step, one merge of
each at a time, and remembers what came out. A longer piece has a transducer of its own, which stays
open from one block of text to the next.

Decoding. Tokens are turned into text as they come, by a state machine: for byte-level vocabularies
it holds the bytes of an unfinished character, for vocabularies without a decoder whether a
separator is due.

Defined results: null counts as empty; an empty text has no tokens and decodes to ''; strings of
special tokens in a text become these tokens, as the tokenizers library does by default; repeated
rows give repeated rows; other columns are ignored; long texts are read in blocks, which are cut at
white space or, in a run without any, where neither a combining character nor a contraction is near.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import text_slices

#: Characters read at once, symbols of a piece from which it has a transducer of its own, entries of a generation of a worker's memo.
BLOCK, LONG, MEMO = 1 << 16, 64, 250_000
#: Characters of pieces that are held before the bank takes what it doesn't know yet.
HELD = 1 << 20
#: White space in the sense of Unicode's White_Space property (fixed values).
SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
NONE = np.int64(1) << 40


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Merges:
    """The merge list: rank and result of a pair of ids, and its sufficient lookahead in symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (u, v) in enumerate(merges):
            self.rank.setdefault((vocab[u], vocab[v]), (n, vocab[u + v]))
        letters = byte_letters()
        self.inner = {c: vocab[c] for c in letters if c in vocab}
        self.last = {c: vocab[c + suffix] for c in letters if c + suffix in vocab}
        self.lookahead = self._lookahead(merges)
        # the same as sorted arrays, for the bank
        self.base = max(vocab.values()) + 2
        codes = np.array([a * self.base + b for a, b in self.rank], np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.ranks, self.results = np.array(list(self.rank.values()), np.int64).reshape(-1, 2)[order].T
        self.inner_ids, self.last_ids = (np.array([d.get(c, -1) for c in letters], np.int64) for d in (self.inner, self.last))

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """The longest chain: f(u,v) = |v| + max f(w,z) over earlier merges whose left part w ends v."""
        size = lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t)
        ends: dict[str, set[str]] = {}  # tokens that can be the right end of a token while it is built
        best: dict[str, int] = {}
        most = 1
        for u, v in merges:
            tails = ends.get(v) or {v}
            reach = size(v) + max((best.get(w, 0) for w in tails), default=0)
            best[u] = max(best.get(u, 0), reach)
            most = max(most, reach)
            ends.setdefault(u + v, {u + v}).update(tails)
        return most

    def apply(self, ids: list[int]) -> list[int]:
        """All merges, best rank first and leftmost first among equals."""
        rank = self.rank
        if len(ids) < 64:
            while len(ids) > 1:
                least, at, new = 1 << 60, -1, -1
                for i in range(len(ids) - 1):
                    if (m := rank.get((ids[i], ids[i + 1]))) and m[0] < least:
                        least, new = m
                        at = i
                if at < 0:
                    break
                ids[at : at + 2] = [new]
            return ids
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [t for t in ids if t >= 0]


class Transducer:
    """Encodes the bytes of one piece as they come; holds at most `room` symbols beyond the lookahead."""

    def __init__(self, merges: Merges, lengths: list[int], room: int = 1024):
        self.merges, self.lengths = merges, lengths
        self.look, self.most = merges.lookahead, merges.lookahead + room
        self.buffer: list[int] = []
        self.pending = -1  # the last byte: it differs if the piece ends with it

    def feed(self, data: bytes) -> Iterator[int]:
        """Add bytes; yields the tokens that are final."""
        inner, letters = self.merges.inner, byte_letters()
        for byte in data:
            if self.pending >= 0:
                self.buffer.append(inner[letters[self.pending]])
            self.pending = byte
            if len(self.buffer) >= self.most:
                safe, done = len(self.buffer) - self.look, 0
                for token in self.merges.apply(list(self.buffer)):
                    if done + self.lengths[token] > safe:
                        break
                    done += self.lengths[token]
                    yield token
                del self.buffer[:done]

    def close(self) -> Iterator[int]:
        """The piece ends here; yields all that is left."""
        if self.pending >= 0:
            ids, self.buffer = self.merges.apply([*self.buffer, self.merges.last[byte_letters()[self.pending]]]), []
            self.pending = -1
            yield from ids


class Bank:
    """Transducers of many pieces that end within their buffers, in step: each step makes the next merge of every piece."""

    def __init__(self, merges: Merges):
        self.m = merges

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each two ids; NONE where no merge does."""
        m = self.m
        codes = np.where((left >= 0) & (right >= 0), left * m.base + right, -1)
        at = np.minimum(np.searchsorted(m.codes, codes), len(m.codes) - 1)
        there = m.codes[at] == codes
        return np.where(there, m.ranks[at], NONE), np.where(there, m.results[at], -1)

    def block(self, data: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian, 32 bits) of pieces of at most `width` bytes."""
        n = len(data)
        sizes = np.fromiter(map(len, data), np.int64, n)
        there = np.arange(width) < sizes[:, None]
        symbols = np.full((n, width), -1, np.int64)
        symbols[there] = self.m.inner_ids[np.frombuffer(b"".join(data), np.uint8)]
        rows = np.arange(n)
        symbols[rows, sizes - 1] = self.m.last_ids[np.frombuffer(b"".join([d[-1:] for d in data]), np.uint8)]
        rank, result = self.ranks(symbols[:, :-1], symbols[:, 1:]) if width > 1 else (np.full((n, 1), NONE),) * 2
        columns = np.arange(width)
        out: list[bytes] = [b""] * n

        def finished(ids: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> None:
            for row, s, x in zip(ids.tolist(), sizes.tolist(), symbols.astype("<u4")):
                out[row] = x[:s].tobytes()

        while True:
            at = rank.argmin(axis=1)  # best rank, leftmost among equals
            going = rank[np.arange(len(rank)), at] < NONE
            if not going.all():
                finished(rows[~going], symbols[~going], sizes[~going])
                rows, symbols, sizes, rank, result, at = (x[going] for x in (rows, symbols, sizes, rank, result, at))
            if not len(rows):
                return out
            every = np.arange(len(rows))
            symbols[every, at] = result[every, at]
            # close the gap after the merged symbol
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, shift, axis=1)
            symbols[:, -1] = -1
            sizes = sizes - 1
            rank, result = (np.take_along_axis(x, shift[:, :-1].clip(max=width - 2), axis=1) for x in (rank, result))
            rank[:, -1] = NONE
            for place in (at - 1, at):
                ok = (place >= 0) & (place < width - 1)
                r, p = every[ok], place[ok]
                rank[r, p], result[r, p] = self.ranks(symbols[r, p], symbols[r, p + 1])

    def encode(self, data: list[bytes], rows: int = 1 << 13) -> list[bytes]:
        """Ids of each piece; pieces of similar length go together."""
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        out: list[bytes] = [b""] * len(data)
        for a in range(0, len(order), rows):
            part = order[a : a + rows]
            for i, ids in zip(part, self.block([data[i] for i in part], len(data[part[-1]]))):
                out[i] = ids
        return out


class SpacedDecoder:
    """Incremental decoder of vocabularies that name no decoder: the text of each token after a separator that is due."""

    def __init__(self):
        self.due = False

    def feed(self, texts: bytes) -> bytes:
        """What to put out for tokens, given as their texts with a space before each."""
        if self.due or not texts:
            return texts
        self.due = True
        return texts[1:]


class Codec:
    """Encoder and decoder of the word-end vocabulary."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        self.text = [self.token.get(i, "").encode() for i in range(max(self.token) + 1)]
        self.lengths = [len(self.token.get(i, "").removesuffix(self.suffix)) for i in range(max(self.token) + 1)]
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        # the split pattern of the vocabulary file: contractions, letter runs, single numbers, other runs
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letter, self.letters, self.number = regex.compile(r"\p{L}"), regex.compile(r"\p{L}+"), regex.compile(r"\p{N}")
        self.others = regex.compile(r"[^\s\p{L}\p{N}]+")
        self.safe = regex.compile(r"(?<=[^\s']{3})(?=[\p{NFC_Quick_Check=Yes}&&[\p{Canonical_Combining_Class=0}]])", regex.V1)
        self.bank = Bank(self.merges)
        self.ids: dict[str, bytes] = {}  # of pieces
        self.texts: dict[str, bytes] = {}  # decoded, a space before each token
        self.old: dict[str, bytes] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, character by character (no rule for final sigma)."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def decoded(self, ids: bytes) -> bytes:
        return b"".join([b" " + self.text[i] for i in array("I", ids)])

    def learn(self, pieces: set[str]) -> None:
        """Put pieces that aren't known through the bank, or a long one through a transducer of its own."""
        again = pieces.intersection(self.old)
        self.ids.update(zip(again, map(self.old.__getitem__, again)))
        new = list(pieces.difference(again))
        data = [p.encode() for p in new]
        short = [i for i, d in enumerate(data) if len(d) < LONG]
        self.ids.update(zip([new[i] for i in short], self.bank.encode([data[i] for i in short])))
        for i, d in enumerate(data):
            if len(d) >= LONG:
                machine = Transducer(self.merges, self.lengths)
                self.ids[new[i]] = array("I", [*machine.feed(d), *machine.close()]).tobytes()
        self.texts.update([(p, self.decoded(self.ids[p])) for p in pieces])

    def age(self) -> None:
        """A memo that is full becomes the older generation; what isn't asked for again goes with it."""
        if len(self.ids) > MEMO:
            self.old, self.ids, self.texts = self.ids, {}, {}

    def cuts(self, text: str, start: int, end: int) -> Iterator[str]:
        """Normal form of a part of a text, in blocks."""
        while start < end:
            cut = end
            if start + BLOCK < end and (m := SPACE.search(text, start + BLOCK, min(end, start + 2 * BLOCK)) or self.safe.search(text, start + BLOCK, end)):
                cut = m.start()
            yield self.normal(text[start:cut])
            start = cut

    def stretch(self, text: str, start: int, end: int) -> Iterator[list[str] | bytes]:
        """Pieces of a part of a text without special tokens; the ids of a piece over several blocks as they become final."""
        machine = kind = None
        for block in self.cuts(text, start, end):
            if machine and (m := kind.match(block)):
                yield array("I", machine.feed(m[0].encode())).tobytes()
                if m.end() == len(block):
                    continue
                block = block[m.end() :]
            if machine:
                yield array("I", machine.close()).tobytes()
                machine = None
            found = self.pieces.findall(block)
            # the piece at the end of a block may go on in the next one
            if found and block.endswith(found[-1]) and not self.number.match(found[-1]):
                kind = self.letters if self.letter.match(found[-1][-1]) else self.others
                machine = Transducer(self.merges, self.lengths)
                opened = array("I", machine.feed(found.pop().encode())).tobytes()
                yield found
                yield opened
            else:
                yield found
        if machine:
            yield array("I", machine.close()).tobytes()

    def parts(self, text: str) -> Iterator[list[str] | bytes]:
        """A text as lists of pieces and, between them, ids."""
        special = self.split_special is not None and self.split_special.search(text)
        if len(text) <= BLOCK and not special:
            yield self.pieces.findall(self.normal(text))
            return
        start = 0
        for m in self.split_special.finditer(text) if special else ():
            yield from self.stretch(text, start, m.start())
            yield array("I", [self.special[m[0]]]).tobytes()
            start = m.end()
        yield from self.stretch(text, start, len(text))

    def encoded(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(place of the text, ids, decoded with a space before each token) part by part, in order."""
        held: list[tuple[int, list[str] | bytes]] = []
        size = 0

        def flushed() -> Iterator[tuple[int, bytes, bytes]]:
            self.age()
            missing: set[str] = set()
            for _, part in held:
                if isinstance(part, list):
                    missing.update(set(part).difference(self.ids))
            self.learn(missing)
            for n, part in held:
                if isinstance(part, list):
                    yield n, b"".join(map(self.ids.__getitem__, part)), b"".join(map(self.texts.__getitem__, part))
                else:
                    yield n, part, self.decoded(part)
            for p in missing:
                if len(p) >= LONG:
                    del self.ids[p], self.texts[p]

        for n, text in enumerate(texts):
            for part in self.parts(text):
                held.append((n, part))
                size += 8 * len(part)
                if size >= HELD:
                    yield from flushed()
                    held, size = [], 0
        yield from flushed()

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Number of tokens, SHA-256 of the ids and of the decoded text of each text; ids and texts are held part by part."""
        counts = [0] * len(texts)
        ids, decoded = ([hashlib.sha256() for _ in texts] for _ in range(2))
        machines = [SpacedDecoder() for _ in texts]
        for n, data, words in self.encoded(texts):
            counts[n] += len(data) // 4
            ids[n].update(data)
            decoded[n].update(machines[n].feed(words))
        return counts, [h.hexdigest() for h in ids], [h.hexdigest() for h in decoded]

    def encode(self, text: str) -> list[int]:
        return [i for _, data, _ in self.encoded([text]) for i in array("I", data)]

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary names no decoder, so tokens are set apart by spaces."""
        machine = SpacedDecoder()
        return b"".join(machine.feed(b" " + self.text[i]) for i in ids if i in self.token).decode()


@lru_cache(1)
def codec(path: str) -> Codec:
    """A worker's codec: kept from task to task, with the pieces that it has seen."""
    return Codec(path)


class ByteDecoder:
    """Incremental decoder of byte-level vocabularies: bytes of an unfinished character are held back."""

    def __init__(self, tokens: dict[int, str]):
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for i, t in tokens.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        return self.state.decode(self.bytes.get(token, b""))

    def close(self) -> str:
        return self.state.decode(b"", final=True)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each document: doc_id, ids (array of int), decoded."""
    path = path or vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(path)
        for rows, texts in text_slices(batches):
            ids = [machine.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(machine.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256; neither ids nor texts leave the task."""
    path = path or vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(path)
        for rows, texts in text_slices(batches):
            n, ids, decoded = machine.digests(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
