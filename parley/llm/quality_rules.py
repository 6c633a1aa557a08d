"""Quality rules as a short-circuit cascade, ordered by what a sample says of their cost and selectivity.

A rule looks at one text and says whether it fails. On a sample every rule is timed and its rejections are
counted; rules that reject most for each second come first. A document goes through the rules in that order
and leaves at the first that it fails, so the dear ones see only what the cheap ones let pass. What several
rules need of a text (its words, its lines) is measured once and only when a rule asks for it.

Whether a document stays doesn't depend on the order, since it has to pass every rule; only the time and the
name of the rule that was first to reject it do. So the sample, bounded by `SAMPLE_PARTS` partitions with
`SAMPLE_ROWS` rows each, steers the speed and no result.

Defined results: null text has no words and fails `few_words`; repeated rows give repeated rows; an empty
table gives an empty result; `verdicts` ignores other columns, `passed` carries them through whatever their
names; a null id is kept as it is; long texts are cut into words by blocks of a megabyte.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import byte_words, free_name, text_slices

WINDOW, SAMPLE_PARTS, SAMPLE_ROWS = 5, 64, 16
BLANKS, SYMBOLS, CAPITALS = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91))
NO_LETTERS = bytes(x for x in range(128) if not chr(x).isalpha())
#: Odd multipliers that mix the words of a window.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more.

    Windows with a hash of their own are told apart at once; those that share one are compared word by word.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    hashes = np.zeros(n, np.uint64)
    for i in range(window):
        hashes += (ids[i : i + n].astype(np.uint64) + np.uint64(1)) * MIX[i % len(MIX)]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return 0
    near = np.sort(order[np.append(same, False) | np.append(False, same)])
    _, inverse, counts = np.unique(np.stack([ids[near + i] for i in range(window)], axis=1), axis=0, return_inverse=True, return_counts=True)
    starts = near[counts[inverse.reshape(-1)] > 1]
    covered = np.zeros(len(ids), bool)
    for i in range(window):
        covered[starts + i] = True
    return int(covered.sum())


class Measured:
    """A text, of which each property is measured when it is first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    def without(self, characters: bytes) -> int:
        """How many of these ASCII characters the text has."""
        return len(self.data) - len(self.data.translate(None, characters))

    @cached_property
    def words(self) -> tuple[np.ndarray, int]:
        """A number for each word, and how many words have a letter."""
        known: dict[bytes, int] = {}
        ids = [np.fromiter((known.setdefault(w, len(known)) for w in part), np.int64, len(part)) for part in byte_words(self.text)]
        numbers = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        lettered = np.fromiter((bool(w.translate(None, NO_LETTERS)) for w in known), bool, len(known))
        return numbers, int(lettered[numbers].sum()) if len(numbers) else 0

    @property
    def n_words(self) -> int:
        return len(self.words[0])

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self.without(BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return self.without(SYMBOLS)

    @cached_property
    def capitals(self) -> int:
        return self.without(CAPITALS)

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them that equal an earlier one."""
        found = [x for x in self.text.split("\n") if x.strip(" \t\v\f\r")]
        return len(found), len(found) - len(set(found))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words[0])


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Measured], bool]


#: The first two are the base; the others are mild forms of published rules for web text.
RULES = (
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    Rule("symbols", lambda t: 100 * t.n_symbols > 10 * t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.lines[1] > 40 * t.lines[0]),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words),
    Rule("few_letters", lambda t: 100 * t.words[1] < 60 * t.n_words),
    Rule("capitals", lambda t: 100 * t.capitals > 40 * len(t.text)),
)
BASE = RULES[:2]


def sampled_costs(docs: DataFrame, rules: tuple[Rule, ...] = RULES, parts: int = SAMPLE_PARTS, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Of each rule its seconds and its rejections for a document of the sample.

    The sample is the first `rows` rows of about `parts` partitions; a task reads no further than that. Each
    rule measures the text for itself, as if it were the first.
    """
    stride = max(1, docs.rdd.getNumPartitions() // parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, spent, rejected = rows, [0.0] * len(rules), [0] * len(rules)
        if TaskContext.get().partitionId() % stride == 0:
            for _, texts in text_slices(batches):
                for text in texts[:left]:
                    for i, rule in enumerate(rules):
                        began = time.perf_counter()
                        rejected[i] += bool(rule.fails(Measured(text)))
                        spent[i] += time.perf_counter() - began
                left -= min(left, len(texts))
                if not left:
                    break
        yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(spent), pa.array(rejected, pa.int64()), pa.array([rows - left] * len(rules), pa.int64())], ["rule", "s", "rejected", "n"])

    found = docs.select("text").mapInArrow(run, "rule string, s double, rejected long, n long").groupBy("rule").agg(F.sum("s"), F.sum("rejected"), F.sum("n"))
    return {rule: (s / n, rejected / n) for rule, s, rejected, n in found.collect() if n}


def ordered(rules: tuple[Rule, ...], costs: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """By rejections for a second, most first; rules without figures come last, ties stay as they are."""
    gain = {name: rejected / max(s, 1e-9) for name, (s, rejected) in costs.items()}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, -1.0)))


def rejecting(text: Measured, rules: Iterable[Rule]) -> str | None:
    """The first rule that the text fails."""
    return next((r.name for r in rules if r.fails(text)), None)


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and rejected_by (which depends on the sample) of each document."""
    plan = ordered(rules, sampled_costs(docs, rules))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            found: list[tuple] = []
            for t in map(Measured, texts):
                by, base = rejecting(t, plan), rejecting(t, BASE) is not None
                found.append((t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words, base, by is None and not base, by))
            kinds = [*[pa.int64()] * len(longs), pa.bool_(), pa.bool_(), pa.string()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], ["doc_id", *longs, "base_failed", "kept", "rejected_by"])

    kind = "doc_id long, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, kept boolean, rejected_by string"
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, kind)


def passed(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that pass all rules, with all their columns; a rule measures only what it needs."""
    text = free_name(docs, "rule_text")
    plan = ordered(rules, sampled_costs(docs.select(F.col(text_col).alias("text")), rules))
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, text):
            keep = [rejecting(Measured(t), plan) is None for t in texts]
            yield pa.RecordBatch.from_arrays(rows.columns[:-1], names).filter(pa.array(keep))

    return docs.select("*", F.col(text_col).alias(text)).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM d), w AS (SELECT r, i, ws[i:i + 4] AS five FROM n),
again AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest([0, 1, 2, 3, 4]) AS u(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d), lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, t, ws, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_symbols <= 10 * n_words AND 100 * n_dup_lines <= 40 * n_lines AND word_chars BETWEEN 2 * n_words AND 14 * n_words
  AND 100 * len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) >= 60 * n_words AND 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) <= 40 * length(t) AS kept FROM b
"""
