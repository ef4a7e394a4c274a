"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are words and the first letters of words (``abcd*``) that labelled
toxic documents use far more often than others; a document's value is the
logarithm of one plus the count, and the length of texts that have any is a
feature, since a long text meets some beginnings by chance.  One weight vector
is shared by the ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k), so a
grade's chance is the difference of two neighbours.  The expected severity is
the sum of the P(grade >= k).  The labels only say toxic or not; among toxic
documents the grades 1 to 3 are the thirds of the number of marked words.  So
what is learnt from labels is the first threshold and the weights; the upper
grades restate the features on one scale with it.

The fit maximizes the likelihood of the grades (with a ridge on the weights)
over a bounded sample of labelled rows (``TRAIN_ROWS``) by scoring steps whose
sums are formed by partition; a step is shortened until the thresholds stay in
order and the likelihood grows.  Every document is scored.

Defined cases: null and empty texts have no features and the base severity;
without labels of both kinds, or without a feature that tells them apart,
every severity is 0; repeated rows are scored each; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.text import CACHED_WORDS, WORDS, slices, texts
from basketlens.session import written

TRAIN_ROWS = 20_000          # labelled rows the fit reads, by hash of the id
MAX_FEATURES = 128
LEAST_TOXIC, LEAST_LIFT, LEAST_Z = 4, 4.0, 5.0   # a feature's toxic documents, rate ratio and z score
GRADES = 3
RIDGE = 0.05
SCORING_STEPS = 30
SHARES = 0.5 ** np.arange(9)  # of a scoring step that are tried
STEMS = (4, 5)
CUT = 0.5                    # rejected from this chance of any toxicity on


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for every row of values."""
        eta = x @ self.weights
        return 1 / (1 + np.exp(self.thresholds[None, :] - eta[:, None]))


class _Known(dict):
    """Feature numbers of a word; remembers the words of a task."""

    def __init__(self, features: dict[str, int]):
        self.features = features

    def __missing__(self, word: str) -> list[int]:
        found = [self.features[f] for f in word_features(word) if f in self.features]
        if len(self) < CACHED_WORDS:
            self[word] = found
        return found


def _values(values: list[str], known: _Known, width: int) -> np.ndarray:
    """Per text the logarithms of one plus the counts of the features and, where it has any, of the words."""
    out = np.zeros((len(values), width + 1))
    for i, text in enumerate(values):
        words = WORDS.findall(text.lower())
        for word in words:
            for j in known[word]:
                out[i, j] += 1
        out[i, width] = len(words) if out[i].any() else 0
    return np.log1p(out)


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(toxic, text) of at most ``rows`` labelled documents.  The chosen labels are
    bounded by that parameter, so they are broadcast and no text is shuffled."""
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.join(F.broadcast(chosen), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")


def _select(train: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The features that toxic documents use far more often than others."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches, "text"):
            names, marks = [], []
            for toxic, text in zip(batch.column("toxic").to_pylist(), values):
                found = {f for w in set(WORDS.findall(text.lower())) for f in word_features(w)}
                names += found
                marks += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(marks, pa.int32())], ["feature", "toxic"])

    seen = (train.mapInArrow(run, "feature string, toxic int").groupBy("feature")
            .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    rate = (F.col("a") + F.col("b")) / (n_toxic + n_clean)
    p1, p0 = F.col("a") / n_toxic, F.col("b") / n_clean
    z = (p1 - p0) / F.sqrt(rate * (1 - rate) * (1 / n_toxic + 1 / n_clean))
    return [r["feature"] for r in seen
            .where((F.col("a") >= LEAST_TOXIC) & (p1 >= LEAST_LIFT * (F.col("b") + 0.5) / n_clean))
            .withColumn("z", z).where(F.col("z") >= LEAST_Z)
            .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]


def chances(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """[row, k]: P(grade >= k) for k from 0 to one above the highest grade."""
    above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - eta[:, None], -500, 500)))
    return np.hstack([np.ones((len(eta), 1)), above, np.zeros((len(eta), 1))])


def losses(x: np.ndarray, grade: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """For every parameter vector the negative log-likelihood of the grades (infinite where thresholds are not ordered)."""
    width, rows, out = x.shape[1], np.arange(len(x)), np.full(len(betas), np.inf)
    for i, beta in enumerate(betas):
        if (np.diff(beta[width:]) > 0).all():
            above = chances(x @ beta[:width], beta[width:])
            out[i] = -np.log(np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-300)).sum()
    return out


def scoring_sums(x: np.ndarray, grade: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the negative log-likelihood at ``beta`` (weights, thresholds) and its expected curvature."""
    width, rows = x.shape[1], np.arange(len(x))
    grades = len(beta) - width
    above = chances(x @ beta[:width], beta[width:])
    slope = above * (1 - above)
    chance = np.maximum(above[:, :-1] - above[:, 1:], 1e-12)             # of every grade
    # derivatives of a grade's chance: by w.x, and by the thresholds below and above it
    by_eta = slope[:, :-1] - slope[:, 1:]
    by_t = np.zeros((len(x), grades + 1, grades))
    for k in range(1, grades + 1):
        by_t[:, k, k - 1] = -slope[:, k]
        by_t[:, k - 1, k - 1] = slope[:, k]
    own = chance[rows, grade]
    gradient = -np.concatenate([x.T @ (by_eta[rows, grade] / own), (by_t[rows, grade] / own[:, None]).sum(axis=0)])
    both = by_t / chance[:, :, None]
    eta_eta = (by_eta ** 2 / chance).sum(axis=1)
    eta_t = (by_eta[:, :, None] * both).sum(axis=1)
    curvature = np.zeros((len(beta), len(beta)))
    curvature[:width, :width] = (x * eta_eta[:, None]).T @ x
    curvature[:width, width:] = x.T @ eta_t
    curvature[width:, :width] = curvature[:width, width:].T
    curvature[width:, width:] = np.einsum("nki,nkj->ij", by_t, both)
    return gradient, curvature


def _summed(data: DataFrame, width: int, parts) -> list[np.ndarray]:
    """The arrays that ``parts(x, grade)`` gives, summed over the rows of ``data`` by partition."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, width)
                found = parts(x, batch.column("grade").to_numpy(zero_copy_only=False))
                total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[a.tobytes() for a in total]], pa.list_(pa.binary()))], ["sums"])

    rows = data.mapInArrow(run, "sums array<binary>").collect()   # one row per partition of a bounded sample
    return [sum(np.frombuffer(r["sums"][i]) for r in rows) for i in range(len(rows[0]["sums"]))]


def maximized(data: DataFrame, width: int, grades: int = GRADES) -> np.ndarray:
    """Weights and ordered thresholds with the greatest penalized likelihood of ``data`` (grade, x)."""
    counts = np.zeros(grades + 1)
    for r in data.groupBy("grade").count().collect():
        counts[r["grade"]] = r["count"]
    share = np.cumsum((counts + 0.5)[::-1])[::-1][1:] / (counts + 0.5).sum()      # of grade k and above
    beta = np.concatenate([np.zeros(width), np.log(1 / share - 1)])
    ridge = np.concatenate([np.full(width, RIDGE), np.full(grades, 1e-3)])
    penalty = lambda betas: 0.5 * (betas ** 2 * ridge).sum(axis=1)
    for _ in range(SCORING_STEPS):
        gradient, curvature = _summed(data, width, lambda x, grade: list(scoring_sums(x, grade, beta)))
        step = np.linalg.solve(curvature.reshape(len(beta), -1) + np.diag(ridge), gradient + ridge * beta)
        tried = np.concatenate([beta[None, :], beta - SHARES[:, None] * step])
        loss = _summed(data, width, lambda x, grade: [losses(x, grade, tried)])[0] + penalty(tried)
        best = int(np.argmin(loss))
        if loss[0] - loss[best] < 1e-9 * abs(loss[0]):        # no share of the step is better
            break
        beta = tried[best]
    return beta


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on (doc_id, text) and (doc_id, toxic)."""
    empty = Model({}, np.zeros(1), np.full(GRADES, np.inf))
    train = written(_training(docs, labels, rows), "toxicity")
    counts = train.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    n_toxic, n_clean = counts["toxic"] or 0, counts["n"] - (counts["toxic"] or 0)
    names = _select(train, n_toxic, n_clean) if n_toxic and n_clean else []
    if not names:
        return empty
    features, width = {f: i for i, f in enumerate(names)}, len(names) + 1   # and the length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(features)
        for batch, values in texts(batches, "text"):
            x = _values(values, known, len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(np.expm1(x[:, :-1]).sum(axis=1)),
                 pa.array([row.tobytes() for row in x], pa.binary())], ["toxic", "marks", "x"])

    marked = written(train.mapInArrow(run, "toxic int, marks double, x binary"), "marked")
    cuts = marked.where("toxic = 1").agg(F.percentile_approx(
        "marks", [k / GRADES for k in range(1, GRADES)], 10_000)).first()[0]
    grade = F.lit(1)
    for cut in cuts:
        grade = grade + (F.col("marks") > cut).cast("int")
    data = written(marked.select(F.when(F.col("toxic") == 1, grade).otherwise(0).alias("grade"), "x").coalesce(12), "grades")
    beta = maximized(data, width)
    return Model(features, beta[:width], beta[width:])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic), one row per document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model.features)
        for batch, values in texts(batches, "text"):
            p = model.severity(_values(values, known, len(model.features)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1), pa.int32()),
                 pa.array(p[:, 0]), pa.array(p[:, 0] >= CUT)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, severity double, grade int, p_toxic double, toxic boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns (of any name), that the model does not reject; no shuffle."""
    place = [c.lower() for c in docs.columns].index(text_col.lower())
    rows = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model.features)
        for batch in slices(batches):
            values = [t or "" for t in batch.column("row").field(place).to_pylist()]
            p = model.severity(_values(values, known, len(model.features)))
            yield batch.filter(pa.array(p[:, 0] < CUT))

    return rows.mapInArrow(run, rows.schema).select("row.*")


def grades(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """Fit on the labelled documents and score all."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic"))
    return score(docs, fit(docs, labels, rows))
