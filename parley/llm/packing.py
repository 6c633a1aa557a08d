"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut: full windows stand alone, what is left of a document is cut to
items of at most a quarter of a window. Each task gathers items into pools of bounded size and
splits a pool into near-equal windows: partial partitions with the largest imbalance are merged,
heavy windows of one with light windows of the other, until one partition is left. While a window
of it exceeds the capacity, the pool is split again into more windows. Nothing is shuffled and
nothing but a pool is held, so the work grows with the input alone.

Defined results: null and empty texts are documents of the end token alone; repeated rows are
packed as often as they occur; an empty table gives no pieces; other columns are ignored; very
long texts are tokenised in blocks that end where the tokenizer's own pre-tokens end.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import text_slices

CAPACITY, POOL, END = 2048, 768, 1
#: Marks that may follow a word's letters (ASCII punctuation, fixed values).
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
#: Entries of a generation of a worker's memo of words; there are two.
MEMO = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteLevelEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, through the tokenizers library.

    The byte-level pre-tokenizer never joins what a single space or newline between two other
    characters separates, nor letters and the punctuation after them. So words are encoded once each
    and their ids put together. Texts with other white space are split by the pre-tokenizer's
    pattern first; texts that hold a special token's string go to the library in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        tokens = self.tok.get_vocab()
        self.opens = np.zeros(max(tokens.values()) + 1, bool)  # tokens that start with a space
        self.opens[[i for t, i in tokens.items() if t[0] == "\u0120"]] = True
        self.pieces: dict[str, bytes] = {}  # of strings as they are
        self.old_words: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # of words after a space, after the newline or nothing that their first character says

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def learn_pieces(self, pieces: Iterable[str]) -> None:
        new = [p for p in set(pieces) if p not in self.pieces]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.pieces.update((p, array("I", e.ids).tobytes()) for p, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)))

    def stems(self, stems: list[str], block: int = 1000) -> dict[str, bytes]:
        """Letter runs after a space, encoded many at a time; each starts at the next token that has a space."""
        out: dict[str, bytes] = {}
        parts = [stems[i : i + block] for i in range(0, len(stems), block)]
        for part, e in zip(parts, self.tok.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            at = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(at) == len(part):
                data = ids.tobytes()
                out.update(zip(part, map(data.__getitem__, map(slice, at, [*at[1:], len(data)]))))
            else:
                out.update((w, self.whole(" " + w)) for w in part)
        return out

    def learn_words(self, words: set[str]) -> None:
        """Words apart from the marks that follow them; what the older generation knows moves up."""
        if self.old_words:
            old = self.old_words
            again = [w for w in words if w in old]
            self.words.update(zip(again, map(old.__getitem__, again)))
            words = words.difference(again)
        alone = [w for w in words if w.isalpha()]
        cut, plain = [], []
        for w in words.difference(alone):
            stem = w.rstrip(MARKS)
            if stem.isalpha():
                cut.append((w, stem, w[len(stem) :]))
            else:
                plain.append((w, w[1:] if w[0] == "\0" else w if w[0] == "\n" else " " + w))
        known, old = self.words, self.old_words
        known.update(self.stems(alone))
        stems = {s: known.get(s) or old.get(s) for _, s, _ in cut}
        stems.update(self.stems([s for s, ids in stems.items() if ids is None]))
        pieces = self.pieces
        self.learn_pieces([p for _, p in plain])
        self.learn_pieces({m for _, _, m in cut if m})
        known.update([(w, pieces[p]) for w, p in plain])
        known.update([(w, stems[s] + pieces[m]) for w, s, m in cut])

    def age(self) -> None:
        """A memo that is full becomes the older generation; what isn't asked for again goes with it."""
        if len(self.words) > MEMO:
            self.words, self.old_words = {}, self.words
        if len(self.pieces) > MEMO:
            self.pieces = {}

    def rest(self) -> None:
        """Between tasks no words are kept, since the worker may go on to other stages."""
        self.words, self.old_words, self.pieces = {}, {}, {}

    def many(self, texts: list[str]) -> list[bytes]:
        self.age()
        out: list[bytes] = [b""] * len(texts)
        get, missing, odd = self.words.get, set(), set()
        regular: list[tuple[int, list[bytes | None], list[int], list[str]]] = []
        other: list[tuple[int, list[str]]] = []
        for n, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                out[n] = self.whole(text)
                continue
            parts = ("\0" + text).replace("\n", " \n").split(" ")
            found = list(map(get, parts))
            holes = absent(found)
            new = [parts[i] for i in holes]
            if "\0" not in text and single_words(new):
                missing.update(new)
                regular.append((n, found, holes, new))
            else:
                parts = self.pattern.findall(text)
                odd.update(parts)
                other.append((n, parts))
        self.learn_words(missing)
        self.learn_pieces(odd)
        words = self.words
        for n, found, holes, new in regular:
            for i, w in zip(holes, new):
                found[i] = words[w]
            out[n] = b"".join(found)
        for n, parts in other:
            out[n] = b"".join(map(self.pieces.__getitem__, parts))
        return out


def absent(found: list) -> list[int]:
    """Where the list holds None."""
    holes, at = [], -1
    try:
        while True:
            at = found.index(None, at + 1)
            holes.append(at)
    except ValueError:
        return holes


def single_words(parts: list[str]) -> bool:
    """Whether each part is one run without white space, after a newline or start mark at most."""
    joined = " ".join(parts)
    return not parts or ("\0" not in parts and joined.split() == joined.replace("\n", "").split(" "))


@lru_cache(1)
def encoder(path: str) -> ByteLevelEncoder:
    """A worker's encoder: the tokenizer is kept from task to task."""
    return ByteLevelEncoder(path)


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The window (0 to k-1) of each item, and the largest sum, by multiway differencing.

    A partial partition is k sums in falling order, less the smallest; the two with the largest
    spread are merged in opposite order until one is left.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    if n <= k:
        window = np.empty(n, dtype=np.int64)
        window[order] = np.arange(n)
        return window, int(sizes.max(initial=0))
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)  # the tree of merged windows; items are its leaves
    made = n
    # as long as a window is empty, the next item goes there: the first k merges at once
    first = (sizes[order[:k]].astype(np.int64), order[:k].astype(np.int64))
    heap: list[tuple[int, int, object]] = [(-int(first[0][0] - first[0][-1]), -1, (first[0] - first[0][-1], first[1]))]
    heap += [(-int(sizes[i]), int(i), None) for i in order[k:]]
    heapq.heapify(heap)
    count = n

    def spread_out(i: int, part):
        if part is not None:
            return part
        sums, nodes = np.zeros(k, dtype=np.int64), np.full(k, -1)
        sums[0], nodes[0] = sizes[i], i
        return sums, nodes

    while len(heap) > 1:
        (_, i, a), (_, j, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, na), (sb, nb) = spread_out(i, a), spread_out(j, b)
        sums, nb = sa + sb[::-1], nb[::-1]
        nodes = np.where(na >= 0, na, nb)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        new = np.arange(made, made + len(both))
        left[new], right[new], nodes[both] = na[both], nb[both], new
        made += len(both)
        rank = np.argsort(-sums, kind="stable")
        sums, nodes = sums[rank], nodes[rank]
        sums = sums - sums[-1]
        count += 1
        heapq.heappush(heap, (-int(sums[0]), count, (sums, nodes)))
    window = np.full(2 * n, -1)
    nodes = heap[0][2][1]
    window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for node in range(made - 1, n - 1, -1):
        window[left[node]] = window[right[node]] = window[node]
    window = window[:n]
    return window, int(np.bincount(window, weights=sizes, minlength=k).max())


def pool_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Near-equal windows of at most `capacity`: as few as the sum asks for, more while one exceeds it."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, most = differencing(sizes, k)
        if most <= capacity:
            return window
        k += 1


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, pool: int = POOL, end_id: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = encoder(path).many
        sequence = TaskContext.get().partitionId() << 32
        tail = np.asarray([end_id], dtype="<u4").tobytes()
        item, size = max(1, capacity // 4), 4
        full: list[tuple] = []
        items: list[tuple] = []

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            ids = pa.array([p[0] for p in pieces], pa.int64())
            rest = np.asarray([p[1:] for p in pieces], dtype=np.int64).T
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, np.ascontiguousarray(rest))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def emptied() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, items
            if items:
                sizes = np.asarray([p[2] for p in items], dtype=np.int64)
                window = pool_windows(sizes, capacity)
                order = np.lexsort((np.arange(len(sizes)), window))
                runs = np.cumsum(sizes[order]) - sizes[order]
                begins = np.searchsorted(window[order], window[order])
                offsets = runs - runs[begins]
                names = np.cumsum(np.diff(window[order], prepend=window[order[0]]) != 0)
                yield rows([(*items[i], sequence + int(s), int(o)) for i, s, o in zip(order, names, offsets)])
                sequence += int(names[-1]) + 1
                items = []

        for batch, texts in text_slices(batches, chars=1 << 21):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), many(texts)):
                ids += tail
                n = len(ids) // size
                for at in range(0, n - n % capacity, capacity):
                    full.append((doc, at, capacity, zlib.crc32(ids[at * size : (at + capacity) * size]), n, sequence, 0))
                    sequence += 1
                for at in range(n - n % capacity, n, item):
                    piece = ids[at * size : (at + item) * size]
                    items.append((doc, at, len(piece) // size, zlib.crc32(piece), n))
                if len(items) >= pool:
                    yield from emptied()
            if full:
                yield rows(full)
                full = []
        yield from emptied()
        encoder(path).rest()

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
