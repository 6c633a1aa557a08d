"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (lengths, letter classes, repetition, lines).
For each class the mean and covariance come from sums over all labelled rows, added up by Spark;
the covariance is shrunk towards the pooled one and towards a multiple of the identity. The score
is the posterior from the difference of the Mahalanobis log-densities, through Cholesky factors
that are computed once.

Defined results: null text counts as empty; empty and very long texts get a score like any other;
null labels teach nothing and a document labelled twice counts with its larger label; if a class has
fewer than two rows every score is the share of label 1 (0.5 without labels); repeated rows give
repeated rows; a null id counts as the text ''; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import stored, text_slices
from parley.llm.langid import id_text_crc

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "bang", "bar", "stop", "comma", "high", "distinct", "lines", "line_repeat", "top_word", "entropy",
)
SHRINK_POOLED, SHRINK_SPHERE, THRESHOLD, FOLDS = 0.3, 0.005, 0.3, 5
LETTERS, UPPER = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER[65:91] = True
SYMBOLS = np.isin(np.arange(256), [*b"#$%&*+<=>@\\^_`~{}[]/"])


def logit(part: float, whole: float) -> float:
    """A share on an open scale, flattened far from a half; half a count is added on both sides."""
    return 4 * math.tanh(math.log((part + 0.5) / (max(whole - part, 0) + 0.5)) / 4)


def statistics(text: str) -> list[float]:
    data = text.encode()
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words = len(data), text.split()
    lines = text.split("\n")
    letters = int(hist[LETTERS].sum())
    seen = set(words)
    share = hist[hist > 0] / max(n, 1)
    longest = max(map(len, words), default=0)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p((n - len(words)) / max(len(words), 1)),
        logit(int(hist[UPPER].sum()), letters),
        logit(int(hist[48:58].sum()), n),
        logit(int(hist[SYMBOLS].sum()), n),
        logit(int(hist[33] + hist[63]), n),
        logit(int(hist[124]), n),
        logit(int(hist[46]), n),
        logit(int(hist[44]), n),
        logit(int(hist[128:].sum()), n),
        logit(len(seen), len(words)),
        4 * math.tanh(math.log1p(len(lines)) / 4),
        logit(len(lines) - len(set(lines)), len(lines)),
        4 * math.tanh(math.log1p(longest) / 4),
        4 * math.tanh(float(-(share * np.log(share)).sum()) / 4),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the vector x of each document; the texts are read this once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Class means, inverse Cholesky factors, log-determinants and log-priors; `share` where there is nothing to tell apart."""

    share: float
    means: list[np.ndarray] | None = None
    whiten: list[np.ndarray] | None = None
    offset: list[float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        log = []
        for mean, factor, offset in zip(self.means, self.whiten, self.offset):
            log.append(offset - 0.5 * np.square((x - mean) @ factor.T).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def learn(x: DataFrame, labels: DataFrame, column: str) -> Model:
    """Fit from the vectors `x` of labelled documents (doc_id) whose `column` is 0 or 1."""
    known = labels.where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    d = len(FEATURES)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for rows in batches:
            if not rows.num_rows:
                continue
            v = np.asarray(rows.column("x").flatten()).reshape(-1, d)
            y = np.asarray(rows.column("y"))
            for c in total:
                mine = v[y == c]
                total[c] += np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()])
        for c, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(t)), pa.array(range(len(t))), pa.array(t)], ["y", "slot", "value"])

    rows = x.join(known, "doc_id").select("x", "y").mapInArrow(sums, "y long, slot long, value double")
    got = {(r["y"], r["slot"]): r["value"] for r in rows.groupBy("y", "slot").agg(F.sum("value").alias("value")).collect()}
    parts = [np.array([got.get((c, i), 0.0) for i in range(1 + d + d * d)]) for c in (0, 1)]
    counts = [p[0] for p in parts]
    if min(counts) < 2:
        return Model((counts[1] / sum(counts)) if sum(counts) else 0.5)
    means = [p[1 : 1 + d] / p[0] for p in parts]
    covs = [p[1 + d :].reshape(d, d) / p[0] - np.outer(m, m) for p, m in zip(parts, means)]
    pooled = sum(n * c for n, c in zip(counts, covs)) / sum(counts)
    whiten, offset = [], []
    for n, cov in zip(counts, covs):
        cov = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
        cov = (1 - SHRINK_SPHERE) * cov + SHRINK_SPHERE * max(float(np.trace(cov)) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        offset.append(float(np.log(n / sum(counts)) - np.log(np.diag(factor)).sum()))
    return Model(counts[1] / sum(counts), means, whiten, offset)


def scored(x: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            v = np.asarray(rows.column("x").flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(v))], ["doc_id", "score"])

    return x.mapInArrow(run, "doc_id long, score double")


def assess(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text)."""
    x = stored(features(docs), "quality-features")
    teach = labels.where(F.pmod(id_text_crc("doc_id"), F.lit(FOLDS)) != 0)
    return scored(x, learn(x, teach, column)).select(
        "doc_id",
        (F.pmod(id_text_crc("doc_id"), F.lit(FOLDS)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
