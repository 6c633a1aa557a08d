"""Language of each document, by words: script ranges, letter-trigram scores, Viterbi over languages.

Each word gets a score for every language from hashed byte trigrams. The script of a word narrows
the languages to those that were seen in that script. A Viterbi pass with a penalty for changing
language labels every word, which marks the spans of mixed texts; the language with most letters is
the document's.

Learning takes a sample of about `per_lang` labelled rows of each language, picked by a hash of the id, and all
of a language that has fewer; every language is learned. Its table has BUCKETS numbers of four bytes for a language,
on the driver and in each worker. Prediction reads every text whole, in blocks that shrink as languages get more: a
text longer than a block goes through Viterbi forwards, which keeps the best scores at the start of each block, and
backwards, which works the blocks out again with their back pointers.

With `flat` there is one more label, `und`, under which every trigram is as likely as any other: what no learned
language explains better than that is in none. The pipeline drops documents by it; `identify` names a learned one.

Defined results: null text and text without a letter are `und` with score 0; rows without a
language teach nothing; with nothing to learn from every text is `und`; repeated rows give repeated
rows; a null id counts as the text ''; other columns are ignored; a run of letters that is longer than two
blocks counts as several words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import hash63, share_bound, text_slices

PER_LANG, BUCKETS, SWITCH, UNKNOWN = 4000, 1 << 16, 12.0, "und"
#: Words times languages that a worker looks at together, and languages whose counts a task keeps.
CELLS, KEPT = 1 << 24, 32
#: A document whose main language covers less than this share of its letters is in no language.
LEAST_SHARE = 1 / 3
#: Starts of script ranges in Unicode blocks (fixed values); letters between belong to the range before.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
CODES = np.array([NAMES.index(n) for _, n in SCRIPTS])
NOT_LETTER, LETTER = re.compile(r"[\W\d_]+"), re.compile(r"[^\W\d_]")


def id_text_crc(col: str | Column) -> Column:
    """CRC-32 of an id written as text; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")).cast("binary"))


@dataclass
class Words:
    """The words of some texts: lower-case letters in one byte array, a space before and after each word."""

    data: np.ndarray
    starts: np.ndarray  # of each word
    sizes: np.ndarray  # in bytes
    doc: np.ndarray  # of each word

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        cleaned = [NOT_LETTER.sub(" ", t.lower()).encode() for t in texts]
        data = np.frombuffer(b" " + b" ".join(cleaned) + b"  ", dtype=np.uint8)
        letter = data != 32
        edges = np.flatnonzero(np.diff(letter.astype(np.int8)))  # always starts and ends with a space
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        bounds = np.cumsum([1] + [len(c) + 1 for c in cleaned])
        return cls(data, starts, ends - starts, np.searchsorted(bounds, starts, side="right") - 1)

    def trigrams(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each trigram of the words first to last-1, and where each word's begin.

        A word of n bytes has n trigrams, centred on its bytes and with the spaces at its ends.
        """
        a, b = self.starts[first], self.starts[last - 1] + self.sizes[last - 1]
        d = self.data[a - 1 : b + 1].astype(np.uint32)
        code = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))
        code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        sizes = self.sizes[first:last]
        offsets = np.cumsum(sizes) - sizes
        keep = np.repeat(self.starts[first:last] - a - offsets, sizes) + np.arange(int(sizes.sum()))
        return code[keep], offsets

    def scripts(self) -> np.ndarray:
        """Script of each word's first letter."""
        at = [self.data[np.minimum(self.starts + i, len(self.data) - 1)].astype(np.int64) for i in range(4)]
        low = [x & 63 for x in at]
        point = np.select(
            [at[0] < 0x80, at[0] < 0xE0, at[0] < 0xF0],
            [at[0], (at[0] & 31) << 6 | low[1], (at[0] & 15) << 12 | low[1] << 6 | low[2]],
            (at[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3],
        )
        return CODES[np.searchsorted(STARTS, point, side="right") - 1]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages): log-probability of a trigram
    allowed: np.ndarray  # (scripts, languages)

    def block(self) -> int:
        """Bytes of text that are looked at together."""
        return min(1 << 22, max(1 << 16, CELLS // (len(self.langs) + 1)))

    def word_scores(self, words: Words, flat: bool = False) -> np.ndarray:
        """The log-probability of each word in each language; with `flat` also under equal odds for all trigrams."""
        n, langs = len(words.starts), len(self.langs)
        out = np.empty((n, langs + flat), dtype=np.float32)
        most, ends, first = max(1 << 10, (1 << 22) // langs), np.cumsum(words.sizes), 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
            codes, offsets = words.trigrams(first, last)
            if len(codes) > most:  # one very long word
                out[first, :langs] = sum(self.table[codes[a : a + most]].sum(axis=0) for a in range(0, len(codes), most))
            else:
                out[first:last, :langs] = np.add.reduceat(self.table[codes], offsets, axis=0)
            first = last
        ok = self.allowed[words.scripts()]
        if not flat:
            ok[~ok.any(axis=1)] = True
        out[:, :langs][~ok] = -1e4
        if flat:
            out[:, langs] = words.sizes * -np.log(np.float32(BUCKETS))
        return out


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, for all documents in step: the n-th words of all are done at once."""
    count = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-count, kind="stable")
    first = np.cumsum(count) - count
    heads, sizes = first[order], count[order]
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")  # documents that still have an n-th word
    back = np.full(scores.shape, -1, dtype=np.int16)
    best = np.zeros((n_docs, scores.shape[1]), dtype=np.float32)
    final = np.full(n_docs, -1)
    for t, n in enumerate(active):
        at = heads[:n] + t
        if t:
            prior = best[:n]
            top = prior.argmax(axis=1)
            change = prior[np.arange(n), top] - switch
            moved = prior < change[:, None]
            back[at] = np.where(moved, top[:, None], np.arange(prior.shape[1]))
            best[:n] = np.maximum(prior, change[:, None])
        best[:n] += scores[at]
        done = active[t + 1] if t + 1 < len(active) else 0
        final[done:n] = best[done:n].argmax(axis=1)
    label = np.empty(len(doc), dtype=np.int16)
    state = final.copy()
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = heads[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return label


def follow(scores: np.ndarray, best: np.ndarray, switch: float = SWITCH, moved: np.ndarray | None = None, top: np.ndarray | None = None) -> None:
    """Take `best` over the words of one text; with `moved` and `top` also what each label at each word came from."""
    for t in range(len(scores)):
        lead = int(best.argmax())
        change = best[lead] - np.float32(switch)
        if moved is not None:
            np.less(best, change, out=moved[t])
            top[t] = lead
        np.maximum(best, change, out=best)
        best += scores[t]


def pieces(text: str, size: int) -> list[tuple[int, int]]:
    """`text` cut between words into pieces of about `size` characters, twice that at most."""
    out, a = [], 0
    while a < len(text):
        gap = NOT_LETTER.search(text, a + size, a + 2 * size) if a + size < len(text) else None
        b = gap.start() if gap else min(len(text), a + 2 * size if a + size < len(text) else len(text))
        out.append((a, b))
        a = b
    return out


def long_labels(model: Model, text: str, size: int, flat: bool) -> Iterator[tuple[Words, np.ndarray]]:
    """The words and labels of the pieces of a long text, last piece first; equals `viterbi` on the whole."""
    best, starts, cuts = np.zeros(len(model.langs) + flat, np.float32), [], pieces(text, size)
    for a, b in cuts:
        starts.append(best.copy())
        follow(model.word_scores(Words.of([text[a:b]]), flat), best)
    state = int(best.argmax())
    for (a, b), best in zip(reversed(cuts), reversed(starts)):
        words = Words.of([text[a:b]])
        moved, top = np.zeros((len(words.starts), len(best)), bool), np.zeros(len(words.starts), np.int32)
        follow(model.word_scores(words, flat), best, SWITCH, moved, top)
        label = np.empty(len(words.starts), np.int32)
        for t in range(len(label) - 1, -1, -1):
            label[t] = state
            if moved[t, state]:
                state = int(top[t])
        yield words, label


def letters(model: Model, texts: list[str], flat: bool = False, spans: bool = False) -> tuple[np.ndarray, list[list[dict]]]:
    """Bytes of the words of each text by label (learned languages, then `und` if `flat`), and the runs of words if `spans`."""
    names = [*model.langs, UNKNOWN]
    weight, runs = np.zeros((len(texts), len(model.langs) + flat)), [[] for _ in texts]
    if len(texts) == 1 and len(texts[0]) > model.block():
        labels = []
        for words, label in long_labels(model, texts[0], model.block(), flat):
            np.add.at(weight[0], label, words.sizes)
            if spans:
                labels.append(label)
        label, doc = np.concatenate([*labels[::-1], np.zeros(0, np.int32)]), None
        doc = np.zeros(len(label), np.int64)
    else:
        words = Words.of(texts)
        doc = words.doc
        label = viterbi(model.word_scores(words, flat), doc, len(texts)) if len(doc) else np.zeros(0, np.int32)
        np.add.at(weight, (doc, label), words.sizes)
    if spans and len(label):
        cut = np.flatnonzero(np.diff(label, prepend=-1) | np.diff(doc, prepend=-1))
        heads = np.searchsorted(doc, np.arange(len(texts)))
        for a, b in zip(cut, [*cut[1:], len(label)]):
            runs[doc[a]].append({"first_word": int(a - heads[doc[a]]), "last_word": int(b - 1 - heads[doc[a]]), "lang": names[label[a]]})
    return weight, runs


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Trigram and script tables from `docs` (doc_id, text, lang), all of which may teach."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    bounds = [F.lit(x) for lang, n in sizes.items() if n > per_lang for x in (lang, share_bound(per_lang, n))]
    sample = docs.where(hash63("doc_id") <= F.coalesce(F.try_element_at(F.create_map(*bounds), F.col("lang")), F.lit((1 << 63) - 1))) if bounds else docs
    width = BUCKETS + len(NAMES)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, both in total.items():
                used = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(both[used])], ["lang", "slot", "n"])
            total.clear()

        for rows, texts in text_slices(batches):
            words = Words.of(texts)
            langs = np.array(rows.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                mine = Words(words.data, *(x[langs[words.doc] == lang] for x in (words.starts, words.sizes, words.doc)))
                both = total.setdefault(lang, np.zeros(width, np.int64))
                for first in range(0, len(mine.starts), 1 << 15):
                    both[:BUCKETS] += np.bincount(mine.trigrams(first, min(first + (1 << 15), len(mine.starts)))[0], minlength=BUCKETS)
                both[BUCKETS:] += np.bincount(mine.scripts(), minlength=len(NAMES))
            if len(total) > KEPT:
                yield from out()
        yield from out()

    def pack(table: pa.Table) -> pa.Table:
        used = [np.asarray(table.column(c)).astype(kind).tobytes() for c, kind in (("slot", "<i4"), ("n", "<i8"))]
        return pa.table({"lang": table.column("lang")[:1], "slots": pa.array([used[0]], pa.binary()), "counts": pa.array([used[1]], pa.binary())})

    counts = sample.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # one row for a language, of at most BUCKETS slots
    found = sorted(counts.groupBy("lang").applyInArrow(pack, "lang string, slots binary, counts binary").collect(), key=lambda r: r["lang"])
    if not found:
        return None
    seen, scripts = np.zeros(BUCKETS, bool), np.zeros((len(NAMES), len(found)))
    for r in found:
        slots = np.frombuffer(r["slots"], "<i4")
        seen[slots[slots < BUCKETS]] = True
    table = np.empty((BUCKETS, len(found)), np.float32)
    for i, r in enumerate(found):
        slots, n = np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["counts"], "<i8")
        grams = np.zeros(width)
        grams[slots] = n
        scripts[:, i] = grams[BUCKETS:]
        table[:, i] = np.log((grams[:BUCKETS] + 0.5) / (grams[:BUCKETS].sum() + 0.5 * max(1, int(seen.sum()))))
    return Model([r["lang"] for r in found], table, scripts >= np.maximum(1, 1e-3 * scripts.sum(axis=0)))


def predict(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with `spans` also (first_word, last_word, lang) of each run of words in one language."""
    shape = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*(model.langs if model else []), UNKNOWN], dtype=object)
        for rows, texts in text_slices(batches, chars=model.block() if model else 1 << 22):
            n = len(texts)
            pick, score, runs = np.full(n, len(langs) - 1), np.zeros(n), [[] for _ in range(n)]
            if model:
                weight, runs = letters(model, texts, spans=spans)
                some = weight.sum(axis=1) > 0
                pick[some] = weight[some].argmax(axis=1)
                score[some] = weight[some].max(axis=1) / weight[some].sum(axis=1)
            columns = [rows.column("doc_id"), pa.array(langs[pick], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(runs, shape)] * spans, ["doc_id", "lang_pred", "score"] + ["spans"] * spans)

    kind = "doc_id long, lang_pred string, score double" + ", spans array<struct<first_word: long, last_word: long, lang: string>>" * spans
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, kind)


def teachers(docs: DataFrame) -> DataFrame:
    """The rows that may teach: not held out."""
    return docs.where(F.pmod(id_text_crc("doc_id"), F.lit(4)) != 2)


def identify(docs: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang)."""
    found = predict(docs, learn(teachers(docs)), spans)
    return found.select("doc_id", (F.pmod(id_text_crc("doc_id"), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score", *["spans"] * spans)


def drop_unknown(docs: DataFrame, model: Model | None, least: float = LEAST_SHARE) -> DataFrame:
    """`docs` without texts that are in no language; one pass, no join.

    A text stays if a learned language has `least` of its letters, where words that equal odds for all trigrams
    explain better have none. Without a model a letter is enough.
    """
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, chars=model.block() if model else 1 << 22):
            if model:
                weight, _ = letters(model, texts, flat=True)
                keep = (weight.sum(axis=1) > 0) & (weight[:, :-1].max(axis=1) >= least * weight.sum(axis=1))
            else:
                keep = np.array([bool(LETTER.search(t)) for t in texts])
            yield pa.RecordBatch.from_arrays(rows.columns, names).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
