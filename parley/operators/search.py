"""Search, paging and reconciliation over meetings and segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import contains_literal, snippet


def search_segments(meetings: DataFrame, segments: DataFrame, term: str) -> DataFrame:
    """Segments that contain the term, with their meeting; a blank term finds nothing.

    The term is matched before the join, so only hits are exchanged.
    """
    hits = segments.where(contains_literal("text", term) if term.strip() else F.lit(False))
    return hits.join(meetings.select("meeting_id", "title", "created_at"), "meeting_id")


def search_with_fallback(meetings: DataFrame, segments: DataFrame, full: DataFrame, term: str, as_of: str) -> DataFrame:
    """Segment hits (rank 0), then hits in full transcripts of meetings without a segment hit (rank 1)."""
    hits = search_segments(meetings, segments, term)
    rest = search_segments(meetings, full, term).join(hits.select("meeting_id"), "meeting_id", "left_anti")
    shape = lambda df, rank, stamp: df.select("meeting_id", "title", snippet("text", term).alias("context"), stamp.alias("stamp"), F.lit(rank).cast("long").alias("rank"))
    return shape(hits, 0, F.col("stamp")).unionByName(shape(rest, 1, F.lit(as_of)))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def first_per(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def latest(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """The last row of each key, by aggregation: no sort, and combined before the exchange."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(key, "r.*")


#: What is looked for of a phrase of at least so many bytes: the least of `WINDOW` grams that lie side by side, each of `GRAM` bytes.
SHAPES = {12: (8, 5), 6: (4, 3), 3: (3, 1), 2: (2, 1), 1: (1, 1)}
#: Bytes on either side of a gram that are compared with it; bits of the filter; bytes of texts that a task looks at together.
SIDE, FILTER_BITS, BLOCK = 4, 1 << 24, 1 << 20
#: Parts in which all documents meet the empty phrases.
PARTS = 64
MIXER = np.uint64(0x9E3779B97F4A7C15)


def _grams(texts: pa.Array, least: int, best: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, key, sides and mask of the grams to look for in texts (binary, no nulls), block by block.

    Of each window of grams the one whose mixed bytes are least is taken, so a text takes the grams of every phrase that it
    holds. The key is these bytes; the sides are the bytes around the gram, the mask has ones where the text has them.
    With `best` only one gram of each text, that with the most of its sides.
    """
    gram, window = SHAPES[least]
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    span, found = gram + window - 1, []
    for a in range(low, high - span + 1, BLOCK):
        piece = data[a : min(a + BLOCK + span - 1, high)]
        mixed = np.zeros(len(piece) - gram + 1, np.uint64)
        for j in range(gram):
            mixed |= piece[j : j + len(mixed)].astype(np.uint64) << np.uint64(8 * j)
        mixed = (mixed ^ np.uint64(least)) * MIXER
        mixed ^= mixed >> np.uint64(32)
        n = len(mixed) - window + 1
        at, low_one = np.arange(n), mixed[:n].copy()
        for j in range(1, window):
            other = mixed[j : j + n]
            less = other < low_one
            at[less], low_one[less] = np.flatnonzero(less) + j, other[less]
        starts = np.arange(a, a + n)
        text = np.searchsorted(offsets, starts, "right") - 1
        whole = starts + span <= offsets[text + 1]
        at, text = at[whole], text[whole]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        at, text = at[new], text[new]
        key, at = mixed[at], at + a
        if gram <= 2:  # the whole phrase, so once for each text is enough
            order = np.lexsort((key, text))
            again = np.r_[False, (np.diff(key[order].view(np.int64)) == 0) & (np.diff(text[order]) == 0)]
            key, at, text = (c[order[~again]] for c in (key, at, text))
        sides, mask = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for j, d in enumerate([*range(-SIDE, 0), *range(gram, gram + SIDE)] if gram > 2 else []):
            inside = (at + d >= offsets[text]) & (at + d < offsets[text + 1])
            sides[inside] |= data[at[inside] + d].astype(np.uint64) << np.uint64(8 * j)
            mask[inside] |= np.uint64(255) << np.uint64(8 * j)
        out = text, key.view(np.int64), sides.view(np.int64), mask.view(np.int64)
        if best:
            found.append(out)
        else:
            yield out
    if found:
        text, key, sides, mask = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((key, -np.bitwise_count(mask).astype(int), text))
        first = order[np.unique(text[order], return_index=True)[1]]
        yield text[first], key[first], sides[first], mask[first]


def _slots(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)


def phrase_keys(rows: DataFrame, id: str, text: str, wanted: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(id, key, sides, mask): of phrases one gram each; of texts all grams of the shapes in `wanted` that pass its filters."""
    bare = f"{id} {rows.schema[id].dataType.simpleString()}, key long, sides long, mask long"

    def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        if wanted is None:
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            above = None
            for least in SHAPES:
                mine = np.flatnonzero((size >= least) & (size < above if above is not None else True))
                for text, *rest in _grams(texts.take(pa.array(mine)), least, best=True):
                    yield mine[text], *rest
                above = least
            return
        for least, bits in wanted.items():
            for out in _grams(texts, least):
                slot = _slots(out[1])
                passed = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                yield tuple(c[passed] for c in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, *rest in grams(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *map(pa.array, rest)], [id, "key", "sides", "mask"])

    return rows.where(F.col(text).isNotNull()).select(id, F.col(text).cast("binary").alias("text")).mapInArrow(run, bare)


def _filters(phrases: DataFrame, keys: DataFrame) -> dict[int, np.ndarray]:
    """For each shape that occurs among `phrases` the bits that the `keys` of all of them set: 2 MB, however many they are."""
    size = F.octet_length("phrase")
    shape = F.coalesce(*(F.when(size >= least, least) for least in SHAPES))
    shapes = [r[0] for r in phrases.where("phrase <> ''").select(shape).distinct().collect()]
    slots = keys.select(F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("s"))
    words = slots.groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 32))")).alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    return dict.fromkeys(shapes, bits.view(np.uint8))


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(item_id, doc_id) of documents (doc_id, text) that hold a phrase (item_id, phrase), which may cut words at its ends.

    Texts and phrases meet by a few bytes, whatever their words: of each five grams of eight bytes side by side the least one
    is a key, so a text has about one for three bytes, and a phrase needs one of its own. Shorter phrases have shorter grams,
    which texts are asked for only where such phrases occur. A filter of a fixed size, the bits of all phrases' keys, keeps
    most other keys of texts from the exchange; four bytes on either side of the gram are compared where keys meet, so that
    a frequent gram makes no candidates by itself. Candidates are then looked at in whole texts. An empty phrase is in every
    text, which needs no look; null texts and phrases are not found.
    """
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")
    empty = phrases.where("phrase = ''").select("item_id", part)
    every = docs.where("text IS NOT NULL").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("_part")).join(empty, "_part").select("item_id", "doc_id")
    own = phrase_keys(phrases.where("phrase <> ''"), "item_id", "phrase")
    wanted = _filters(phrases, own)
    if not wanted:
        return every
    theirs = phrase_keys(docs, "doc_id", "text", wanted).select("doc_id", F.col("key").alias("_key"), F.col("sides").alias("_sides"))
    meet = (F.col("_key") == F.col("key")) & (F.col("_sides").bitwiseAND(F.col("mask")) == F.col("sides"))
    pairs = theirs.join(own, meet).select(F.col("item_id").alias("_item"), F.col("doc_id").alias("_doc")).distinct()
    near = pairs.join(phrases, F.col("_item").eqNullSafe(F.col("item_id"))).join(docs, F.col("_doc").eqNullSafe(F.col("doc_id")))
    return near.where(F.contains("text", "phrase")).select("item_id", "doc_id").unionByName(every)
