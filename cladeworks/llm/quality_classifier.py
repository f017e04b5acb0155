"""Operator 10: quality classifier.

Statistics of a document's text are standardised and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel. Ridge regression on a bounded, hash-chosen sample of labelled
rows is fitted from normal equations that Spark sums over partitions; isotonic calibration on labelled rows left out of that
turns its outputs into probabilities. Scoring is one pass over all texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cladeworks.llm.common import cut, text_or_empty

FIT_ROWS = 40_000  # bound on the labelled rows that are fitted and calibrated on
N_FEATURES = 160
RIDGE = 1e-2
SEED = 7
BINS = 512  # of the ridge outputs, for calibration
THRESHOLD = 0.3
FOLDS = 5  # crc32(id) modulo this: 0 is held out, 1 calibrates, the others are fitted

STATS = (
    "log_bytes", "upper", "digits", "blanks", "stops", "symbols", "cries", "bars", "high", "word_length",
    "distinct_words", "repeated_words", "top_word", "packed", "log_line", "distinct_lines", "capital_words", "marked_words",
)

_BYTE = np.arange(256)
_KINDS = np.stack([
    (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57), np.isin(_BYTE, list(b" \n\t\r")), np.isin(_BYTE, list(b".,;:?-'\"()")),
    np.isin(_BYTE, list(b"#$%&*+/<=>@[\\]^_`{}~")), _BYTE == 33, _BYTE == 124, _BYTE >= 128,
]).astype(float)


def text_stats(text: str) -> list[float]:
    """The statistics of one whole text; all 0 for an empty one."""
    if not text:
        return [0.0] * len(STATS)
    raw = text.encode("utf-8", "replace")
    shares = _KINDS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    counts = Counter(words)
    return [
        np.log1p(len(raw)), *shares, np.log1p(len(text) / n), len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n, max(counts.values(), default=0) / n,
        len(zlib.compress(raw, 1)) / len(raw), np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines),
        sum(map(str.isupper, words)) / n, sum(1 for w in counts if not w[-1].isalnum()) / max(1, len(counts)),
    ]


def stats_of(text: Column) -> Column:
    """text_stats as a column."""

    @arrow_udf("array<double>")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([text_stats(x or "") for x in batch.to_pylist()], pa.list_(pa.float64()))

    return stats(text)


@dataclass(frozen=True)
class Model:
    """A fitted classifier: small arrays whose size depends on the parameters only."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.weights + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([wave, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1; a trace of the raw output keeps the order inside a level."""
        raw = self.raw(stats)
        level = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.full(len(raw), self.beta[-1])
        return np.clip(0.998 * level + 0.002 * (np.clip(raw, -1, 2) + 1) / 3, 0, 1)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids have none."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> DataFrame:
    """Statistics, label and fold of at most about fit_rows labelled documents outside the held-out fold.

    Which rows are taken depends on a hash of the id only.
    """
    usable = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_label"))
        .where(F.col("_label").isNotNull() & (fold_of(F.col("_id")) != 0))
        .distinct()
    )
    n = usable.count()
    share = min(1.0, fit_rows / max(1, n))
    chosen = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # at most about fit_rows rows of two numbers: small enough to broadcast at every input size
    texts = df.select(F.col("doc_id").alias("_doc_id"), text_or_empty().alias("text"))  # other columns may be named like those here
    joined = texts.join(F.broadcast(chosen), F.col("_doc_id") == F.col("_id"))
    return joined.select(
        stats_of(text_or_empty()).alias("stats"), F.col("_label").alias("label"), fold_of(F.col("_id")).alias("fold")
    )


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x; returns centres and levels of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, t, w in zip(x, total, weight):
        blocks.append([a * w, t, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(
    df: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, n_features: int = N_FEATURES
) -> Model:
    """Fit and calibrate on the labelled documents of df (columns doc_id, text).

    Rows whose label is null and the held-out fold are not used. Without usable rows of both
    labels every document scores the mean label (0.5 if there is none).
    """
    sample = cut(labelled_sample(df, labels, label, fit_rows), "quality-sample")
    k = len(STATS)
    columns = [F.col("stats")[i] for i in range(k)]
    moments = sample.select(
        F.array(*[F.avg(c) for c in columns]), F.array(*[F.stddev_pop(c) for c in columns]), F.avg("label"), F.count("*")
    ).first()
    rng = np.random.default_rng(SEED)
    weights = rng.normal(0, 1 / np.sqrt(k), (k, n_features))
    shift = rng.uniform(0, 2 * np.pi, n_features)
    empty = np.array([])
    if not moments[3] or moments[2] in (0.0, 1.0):
        level = moments[2] if moments[3] else 0.5
        return Model(np.zeros(k), np.ones(k), weights, shift, np.append(np.zeros(n_features), level), empty, empty)
    mean, scale = np.array(moments[0]), np.maximum(np.array(moments[1]), 1e-6)
    bare = Model(mean, scale, weights, shift, np.zeros(n_features + 1), empty, empty)
    width = n_features + 1

    def normal(batches):
        """Of a partition: the rows of (features'features | features'label), each with its number."""
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                phi = bare.features(np.array(batch.column("stats").to_pylist()))
                label_values = batch.column("label").to_numpy(zero_copy_only=False)
                total += phi.T @ np.column_stack([phi, label_values])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"]
        )

    fitted = sample.where("fold > 1").coalesce(16)
    sums = (
        fitted.select("stats", "label")
        .mapInArrow(normal, "i int, row array<double>")
        .select("i", F.posexplode("row").alias("j", "v"))
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()  # n_features squared numbers
    )
    gram = np.zeros((width, width + 1))
    gram[sums["i"], sums["j"]] = sums["v"]
    n_fit = max(1.0, gram[-1, width - 1])
    beta = np.linalg.solve(gram[:, :width] / n_fit + RIDGE / n_features * np.eye(width), gram[:, width] / n_fit)
    plain = Model(mean, scale, weights, shift, beta, empty, empty)

    @arrow_udf("double")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(plain.raw(np.array(batch.to_pylist()).reshape(-1, k)))

    bins = (
        sample.where("fold = 1")
        .withColumn("raw", raw("stats"))
        .groupBy(F.floor(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * (BINS / 3)).alias("bin"))
        .agg(F.avg("raw").alias("x"), F.sum("label").alias("total"), F.count("*").alias("n"))
        .orderBy("bin")
        .toPandas()  # at most BINS + 1 rows
    )
    knots, levels = isotonic(bins["x"].to_numpy(), bins["total"].to_numpy(float), bins["n"].to_numpy(float))
    return Model(mean, scale, weights, shift, beta, knots, levels)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from THRESHOLD on) to every row.

    Null texts score like empty ones, whose statistics are all 0. Repeated rows stay repeated; input
    columns named like an output are replaced; an empty table stays empty.
    """
    k = len(STATS)

    @arrow_udf("double")
    def calibrated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            stats = np.array([text_stats(x or "") for x in batch.to_pylist()]).reshape(-1, k)
            yield pa.array(model.score(stats))

    scored = df.withColumn("score", calibrated(text_or_empty(text)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
