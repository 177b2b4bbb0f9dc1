"""Quality classifier by positive-unlabelled learning.

A linear model over binned text statistics minimises the non-negative unbiased risk (Kiryo et al., 2017): with class prior
pi and sigmoid loss, R = pi * mean loss of trusted positives as positive + max(0, mean loss of unlabelled texts as negative
- pi * mean loss of positives as negative). Trusted positives are documents labelled 1; unlabelled texts are documents
whatever their label; pi is estimated as the smoothed share of label 1 among the labelled training rows.

Labels are learnt only from rows outside the held-out third (crc32 of doc_id as text, modulo 3, is 1). Labels, lang, source
and doc_id are never inputs of a score. The fit uses at most `most_positive` positives and `most_unlabelled` unlabelled
documents, those of least hash; scoring covers every whole text and needs no shuffle.

Null or empty text: all statistics are 0, scored like any other text. No labels, or no documents to learn from: every score is
0.5, and `keep` keeps all. Equal texts get equal scores, so repeated rows do; of rows with equal doc_id one is learnt from. Ties at
0.5 count as good. Very long texts are read whole, one at a time. Rows without doc_id are scored, not learnt from. doc_id: any
integer type. Extra columns are ignored by `predict` and kept by `keep`. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

MOST_POSITIVE, MOST_UNLABELLED, BINS = 6000, 6000, 12
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


def statistics(text: str) -> list[float]:
    """Of the whole text; each is 0 for the empty text."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * 16
    k = len(words)
    kinds = Counter(words)
    lines = text.split("\n")
    letters = sum(map(len, _LETTER_RUN.findall(text)))
    spaces = k - 1 + len(text) - len(text.rstrip())
    digits = sum(map(text.count, "0123456789"))
    upper = n - sum(map(str.__eq__, text, text.lower()))
    pairs = len(set(zip(words, words[1:], strict=False))) / (k - 1) if k > 1 else 1.0
    bare = sum(1 for w in words if not w[0].isalnum() and not w[-1].isalnum())
    return [
        math.log1p(k),
        (n - letters - digits - spaces) / n,
        text.count("|") / k,
        upper / n,
        digits / n,
        n / k,
        math.log1p(len(kinds)) / math.log1p(k),
        len(kinds) / k,
        pairs,
        kinds.most_common(1)[0][1] / k if k > 4 else 0.0,
        1 - len(set(lines)) / len(lines),
        k / len(lines) if len(lines) > 1 else 0.0,
        len(_SENTENCE.findall(text)) / k,
        bare / k,
        sum(map(text.count, "#$%&*@^~<>{}[]=\\_")) / n,
        max(map(len, kinds)) / 40.0,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    weight: np.ndarray
    bias: float
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """One column for each statistic and bin."""
        out = np.zeros((len(x), sum(len(e) + 1 for e in self.edges)))
        at = 0
        for j, e in enumerate(self.edges):
            out[np.arange(len(x)), at + np.searchsorted(e, x[:, j], "left")] = 1
            at += len(e) + 1
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z, at = np.full(len(x), self.bias), 0
        for j, e in enumerate(self.edges):
            z += self.weight[at + np.searchsorted(e, x[:, j], "left")]
            at += len(e) + 1
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of scores z of positives and unlabelled texts, with sigmoid loss: l(z, +) = s(-z), l(z, -) = s(z)."""
    p, u = _sigmoid(positive), _sigmoid(unlabelled)
    return float(prior * (1 - p).mean() + max(0.0, u.mean() - prior * p.mean()))


def slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The direction of a step for each score: the risk's derivative, or, where its negative part is below 0 (over-fitted), that of
    the negative part alone, reversed."""
    p, u = _sigmoid(positive), _sigmoid(unlabelled)
    at_p, at_u = p * (1 - p) / len(p), u * (1 - u) / len(u)
    return (-2 * prior * at_p, at_u) if u.mean() - prior * p.mean() >= 0 else (prior * at_p, -at_u)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-2) -> Model:
    both = np.concatenate([positive, unlabelled])
    edges = []
    for j in range(both.shape[1]):
        # bins by the positives' quantiles, and two well beyond their range on either side: what no positive shows stands apart
        inner = np.quantile(positive[:, j], np.linspace(0.0, 1.0, BINS - 1))
        middle = inner[len(inner) // 2]
        low, high = inner[0] - (middle - inner[0]) / 2, inner[-1] + (inner[-1] - middle) / 2
        inner = np.array([*inner[1:-1], high])
        above, below = both[both[:, j] > high, j], both[both[:, j] < low, j]
        outer = [*(np.quantile(above, [0.5]) if len(above) else []), *(np.quantile(below, [0.5]) if len(below) else [])]
        edges.append(np.unique(np.concatenate([inner, [np.nextafter(low, -np.inf)], outer])))
    model = Model(edges, np.zeros(0), 0.0, prior)
    p, u = model.design(positive), model.design(unlabelled)
    model.weight = np.zeros(p.shape[1])
    m, v, mb, vb = np.zeros_like(model.weight), np.zeros_like(model.weight), 0.0, 0.0
    for t in range(1, steps + 1):
        gp, gu = slopes(p @ model.weight + model.bias, u @ model.weight + model.bias, prior)
        g, gb = p.T @ gp + u.T @ gu + decay * model.weight / len(edges), float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        model.weight -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model.bias -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """None if there is no positive or no text to learn from. Holds the bounded samples' statistics on the driver."""
    mine = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    share = mine.agg(F.sum((F.col("quality") == 1).cast("int")).alias("p"), F.count("*").alias("n")).first()
    if not share["p"]:
        return None
    prior = (share["p"] + 1) / (share["n"] + 2)
    order = F.xxhash64(F.lit("sample"), "doc_id")
    least = lambda df, n: df.select("doc_id").dropDuplicates().orderBy(order, "doc_id").limit(n)
    chosen = least(mine.where("quality = 1"), most_positive).withColumn("positive", F.lit(True))
    chosen = chosen.union(least(docs.where(F.col("doc_id").isNotNull() & ~held_out()), most_unlabelled).withColumn("positive", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "positive", "x"])

    # at most most_positive + most_unlabelled ids are broadcast: a bound that doesn't follow the input
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text").mapInArrow(run, "doc_id long, positive boolean, x array<double>")
    sample = sample.groupBy("doc_id", "positive").agg(F.min("x").alias("x")).toPandas()  # one row for each id chosen
    sample = sample.sort_values(["doc_id", "positive"], kind="stable")
    x, positive = np.array(sample["x"].tolist(), dtype=float), sample["positive"].to_numpy(dtype=bool)
    if not positive.any() or positive.all():
        return None
    return fit(x[positive], x[~positive], prior)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([statistics(t) for t in texts_of(part.column("text"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x) if model else np.full(len(x), 0.5))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts; rows without labels decide like any other."""
    model = train(docs, labels)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([statistics(t) for t in texts_of(part.column("text"))])
                good = model.score(x) >= 0.5 if model else np.ones(len(x), dtype=bool)
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema).select(*columns)
