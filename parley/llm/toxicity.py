"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives, all documents that may teach are unlabelled. A linear
classifier on the presence of words is trained in numpy on the risk corrected for the class prior:
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)); while the second term is below zero its gradient is
followed upwards, which keeps the classifier from explaining the positives away. The words, and beginnings
of words, are those whose document frequency differs most between positives and unlabelled, counted by Spark;
those with small weights are left out and the rest is trained again.

Learning takes at most about `positives` toxic and `unlabelled` of all documents, picked by independent
hashes (a document may be in both samples; a repeated row counts once), and `words` words; every text
is scored whole.

Defined results: null text counts as empty; empty texts get the score of the bias alone; null labels
teach nothing; without a positive every score is 0; repeated rows give repeated rows; a null id
counts as the text ''; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import hash63, share_bound, stored, text_slices
from parley.llm.langid import id_text_crc

POSITIVES, UNLABELLED, WORDS, FOLDS, THRESHOLD = 3000, 9000, 1024, 5, 0.5
#: A word's count among positives has to be that many standard deviations above what the unlabelled documents suggest.
SURE = 3.0
#: Letters of the beginnings of words that count as words; weights under this share of the largest are taken for noise.
STEMS, LEAST_WEIGHT = (4, 5, 7), 0.25
#: Of the documents that hold a word, the share that is toxic, as far as both samples tell.
LEAST_SHARE = 0.9
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """The distinct words, and with a star the beginnings of longer ones, which stand for their inflected forms."""
    words = set(LETTERS.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, positive, unlabelled and the distinct words of each document."""
    names = ["doc_id", "positive", "unlabelled"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*map(rows.column, names), pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string()))], [*names, "words"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "positive", "unlabelled").mapInArrow(run, "doc_id long, positive boolean, unlabelled boolean, words array<string>")


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        found = [self.words[w] for w in self.words.keys() & words_of(text)]
        z = self.bias + (float(self.weights[sorted(found)].sum()) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def non_negative_pu(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss."""
    d, kind = x_p.shape[1], x_p.dtype
    w, b = np.zeros(d), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, steps + 1):
        narrow = w.astype(kind)  # else numpy would widen the whole matrix at each step
        s_p, s_u = sigmoid((x_p @ narrow).astype(float) + b), sigmoid((x_u @ narrow).astype(float) + b)
        rest = -np.log(np.maximum(1 - s_u, 1e-12)).mean() + prior * np.log(np.maximum(1 - s_p, 1e-12)).mean()
        # derivatives of the losses by the margins
        as_positive = prior * (s_p - 1) / len(s_p)
        negative_p, negative_u = -prior * s_p / len(s_p), s_u / len(s_u)
        g_p, g_u = (as_positive + negative_p, negative_u) if rest >= 0 else (-negative_p, -negative_u)
        grad = np.append((x_p.T @ g_p.astype(kind) + x_u.T @ g_u.astype(kind)).astype(float), g_p.sum() + g_u.sum())
        grad[:d] += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:d], b - step[d]
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, n_words: int = WORDS) -> Model | None:
    """Fit from `docs` and `labels`, all of whose rows may teach."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("y"))
    n_known, n_pos = known.agg(F.count("y"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    if not n_pos:
        return None
    prior = min(max(n_pos / n_known, 1e-3), 0.5)
    n_docs = docs.count()
    rank = hash63("doc_id")
    # a second rank, that doesn't depend on the first and differs between rows of a null id
    free = hash63(F.lit("unlabelled"), "doc_id", "text")
    # both samples are of bounded expected size, so the ids can be broadcast
    chosen = known.where((F.col("y") == 1) & (rank <= share_bound(positives, n_pos))).select("doc_id", F.lit(True).alias("positive"))
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left")
    picked = picked.select("doc_id", "text", F.coalesce("positive", F.lit(False)).alias("positive"), (free <= share_bound(unlabelled, n_docs)).alias("unlabelled"))
    # a document that is repeated counts once, so the samples are bounded whatever is repeated
    once = picked.where("positive OR unlabelled").withColumn("same", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).dropDuplicates(["doc_id", "same"])
    sample = stored(with_words(once), "toxicity-sample")
    count_p, count_u = sample.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    if not count_p:
        return None
    each = sample.select("positive", "unlabelled", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.col("positive").cast("long")).alias("p"), F.sum(F.col("unlabelled").cast("long")).alias("u")
    )
    expected = (F.col("u") + 0.5) * (count_p / max(count_u, 1))
    sure = (F.col("p") - expected) / F.sqrt(expected + 1)
    share = prior * (F.col("p") / count_p) / ((F.col("u") + 0.5) / max(count_u, 1))
    top = each.where((sure >= SURE) & (share >= LEAST_SHARE)).orderBy(sure.desc(), "word").limit(n_words).select("word").collect()
    words = {r["word"]: i for i, r in enumerate(top)}
    if not words:
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    few = sample.select("doc_id", "positive", "unlabelled", F.filter("words", lambda w: w.isin(list(words))).alias("words"))
    rows = few.orderBy("doc_id", "positive").select("positive", "unlabelled", "words").toPandas()
    x = np.zeros((len(rows), len(words)), dtype=np.float32)
    for i, found in enumerate(rows["words"]):
        x[i, [words[w] for w in found]] = 1
    # the unlabelled sample is one of all documents: it holds positives too, in the share that the prior states
    x_p, x_u = x[rows["positive"].to_numpy(dtype=bool)], x[rows["unlabelled"].to_numpy(dtype=bool)] if count_u else x
    weights, bias = non_negative_pu(x_p, x_u, prior)
    # many small weights would add up in long texts; the large ones are learned again without them
    large = np.flatnonzero(weights >= max(LEAST_WEIGHT * weights.max(), 0.0))
    weights, bias = non_negative_pu(np.ascontiguousarray(x_p[:, large]), np.ascontiguousarray(x_u[:, large]), prior)
    kept = set(large.tolist())
    return Model({w: n for n, w in enumerate(w for w, i in words.items() if i in kept)}, weights, bias)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([model.score(t) if model else 0.0 for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, score double")


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text)."""
    teach = lambda df: df.where(F.pmod(id_text_crc("doc_id"), F.lit(FOLDS)) != 0)
    return scored(docs, learn(teach(docs), teach(labels))).select(
        "doc_id",
        (F.pmod(id_text_crc("doc_id"), F.lit(FOLDS)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
