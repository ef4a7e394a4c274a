"""Quality classifier: kernel ridge by random Fourier features, calibrated.

Statistics of a text (never its labels, language, source or id) are
standardized and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel.  Ridge regression on them is solved from normal
equations that are summed by partition; isotonic regression on rows the ridge
has not seen turns its output into the share of good documents.

The fit reads a bounded sample of labelled rows (``TRAIN_ROWS``) outside the
held-out fold; every document is scored.

Defined cases: null and empty texts have all statistics 0 and are scored like
any other; without labelled rows every score is 0.5, with labels of one kind
that label; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.quality_rules import measured
from basketlens.session import written

TRAIN_ROWS = 20_000     # labelled rows the fit reads, by hash of the id
FEATURES = 256          # random Fourier features
BANDWIDTH = 3.0         # of the Gaussian kernel, in standard deviations
RIDGE = 1.0
SEED = 11
FOLDS = 5               # crc32(doc_id) mod FOLDS: 0 is held out, FOLDS - 1 calibrates, the others fit

STATISTICS = ("log_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio",
              "exclaim_ratio", "digit_ratio", "stop_ratio", "line_words", "distinct_ratio")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) with one column per name in ``STATISTICS``; built-in functions only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda characters: F.regexp_count(text, F.lit(f"[{characters}]")) / size
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("_n_lines"), F.lit(1))
    return (measured(docs)
            .withColumn("log_words", F.log1p("n_words"))
            .withColumn("word_length", F.least(F.col("word_chars") / n, F.lit(30.0)))
            .withColumn("symbol_ratio", F.least(F.col("n_symbols") / n, F.lit(4.0)))
            .withColumn("dup_line_ratio", F.col("n_dup_lines") / lines)
            .withColumn("repeat_ratio", F.col("n_repeat_words") / n)
            .withColumn("upper_ratio", share("A-Z"))
            .withColumn("exclaim_ratio", share("!?") * 10)
            .withColumn("digit_ratio", share("0-9"))
            .withColumn("stop_ratio", share(".,;:") * 10)
            .withColumn("line_words", F.log1p(F.col("n_words") / lines))
            .withColumn("distinct_ratio", F.size(F.array_distinct(F.split(text, " "))) / n))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray      # isotonic boundaries and values
    values: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale) @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps, self.values), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(name).to_numpy(zero_copy_only=False).astype(float) for name in STATISTICS])


def _normal_equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y, summed by partition; one row per partition of a bounded sample comes back."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz, zy = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = model.mapped(_matrix(batch))
            zz += z.T @ z
            zy += z.T @ batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()]), pa.array([zy.tobytes()])], ["zz", "zy"])

    parts = train.coalesce(12).mapInArrow(run, "zz binary, zy binary").collect()
    return (sum(np.frombuffer(r["zz"]).reshape(FEATURES + 1, FEATURES + 1) for r in parts),
            sum(np.frombuffer(r["zy"]) for r in parts))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on (doc_id, text) and (doc_id, quality)."""
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
              .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))      # bounded, so it is broadcast
    train = written(statistics(docs.join(F.broadcast(chosen), "doc_id"))
                    .select(fold(F.col("doc_id")).alias("fold"), "quality", *STATISTICS), "statistics")
    summary = train.agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("good"),
                        *[F.avg(c).alias(f"m_{c}") for c in STATISTICS],
                        *[F.stddev_pop(c).alias(f"s_{c}") for c in STATISTICS]).first()
    width = len(STATISTICS)
    mean = np.array([summary[f"m_{c}"] or 0.0 for c in STATISTICS])
    scale = np.array([summary[f"s_{c}"] or 1.0 for c in STATISTICS])
    random = np.random.default_rng(SEED)
    model = Model(mean, scale, random.normal(0, 1 / BANDWIDTH, (width, FEATURES)),
                  random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1),
                  np.array([0.0]), np.array([0.5 if summary["good"] is None else float(summary["good"])]))
    if summary["good"] in (None, 0.0, 1.0):
        return model
    calibrating = train.where(F.col("fold") == FOLDS - 1)
    fitting = train.where(F.col("fold") != FOLDS - 1)
    if calibrating.isEmpty() or fitting.isEmpty():
        calibrating = fitting = train
    zz, zy = _normal_equations(fitting, model)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(zz + penalty, zy)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(model.raw(_matrix(batch))), batch.column("quality").cast(pa.float64())], ["raw", "label"])

    pairs = VectorAssembler(inputCols=["raw"], outputCol="features").transform(
        calibrating.mapInArrow(run, "raw double, label double"))
    isotonic = IsotonicRegression().fit(pairs)
    model.steps, model.values = isotonic.boundaries.toArray(), isotonic.predictions.toArray()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row.  Texts stay in the JVM; Python gets the statistics."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    return (statistics(docs.select("doc_id", "text")).select("doc_id", *STATISTICS)
            .mapInArrow(run, f"doc_id {id_type}, score double"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", least: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per document; fits on the rows not held out."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("quality"))
    return score(docs, fit(docs, labels, rows)).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"))
