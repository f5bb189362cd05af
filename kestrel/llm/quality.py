"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes ``len(STATS)`` transformed statistics (shares of character classes, word and
line lengths, repetition; shares pass through a log that spreads small values, counts through
log1p). Class means and second moments are sums over all labelled training rows, formed per
partition and added by Spark; the class covariances are shrunk towards the pooled covariance
(``pool``) and towards a multiple of the identity (``ridge``). The score is the logistic of the
difference of the two Gaussian log densities plus the log prior odds; each density takes the
Mahalanobis distance from the class's inverse Cholesky factor, computed once at fit and shared.
The log odds are softly bounded at +-30 before the logistic, so that ranks survive at the ends.

Defined cases: null and empty texts have the statistics of the empty text and are scored like any
other; labels other than 0 and 1, null labels and labels of unknown documents are not learned
from; repeated labels of a document count once (the smallest, if they differ); repeated rows
score alike. With labels of one class only, or none, every score is that of the smoothed
prior ``(n1 + 1) / (n + 2)``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import append_columns, appended_schema, broadcast_value, is_fold, lean, slices, texts

STATS = ("log_chars", "log_words", "mean_word", "upper", "digit", "stop_punct", "symbol", "bang", "bar", "non_ascii",
         "space", "word_variety", "top_word", "repeat_pair", "mean_line", "repeat_line", "short_line", "line_end",
         "char_entropy", "capital_words")
_U = np.zeros(256, bool)
_U[65:91] = True
_D = np.zeros(256, bool)
_D[48:58] = True
_P = np.zeros(256, bool)
_P[[ord(c) for c in ".,;:?'\"-()"]] = True
_S = np.zeros(256, bool)
_S[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = True
_A = np.arange(256) >= 128
_W = np.zeros(256, bool)
_W[[9, 10, 11, 12, 13, 32]] = True


def document_stats(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``STATS``."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(STATS)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)

    def spread(x: float) -> float:  # a share, with small values spread
        return float(np.log(x + 0.005))

    words = raw.split()
    w = max(1, len(words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    p = hist[hist > 0] / n
    caps = sum(c for x, c in counts.items() if 65 <= x[0] <= 90)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p((n - hist[_W].sum()) / w)),
        spread(hist[_U].sum() / n), spread(hist[_D].sum() / n), spread(hist[_P].sum() / n), spread(hist[_S].sum() / n),
        spread(hist[33] / n), spread(hist[124] / n), spread(hist[_A].sum() / n), spread(hist[_W].sum() / n),
        float(np.log1p(len(counts)) / np.log1p(w)), spread(max(counts.values(), default=0) / w),
        spread(1.0 - pairs / (w - 1) if w > 1 else 0.0),
        float(np.log1p(n / k)), spread(1.0 - len(set(lines)) / k if lines else 0.0),
        spread(sum(len(x) < 40 for x in lines) / k), spread(sum(x.rstrip()[-1:] in b".!?" for x in lines) / k),
        float(-(p * np.log2(p)).sum()), spread(caps / w),
    ]


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [document_stats(t) for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATS)
    sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column(1).values.to_numpy(zero_copy_only=False)).reshape(-1, d)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                z = x[y == k]
                sums[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
                                     names=["label", "sums"])


@dataclass
class QualityModel:
    prior: float
    means: np.ndarray | None = None  # 2 x d
    factors: np.ndarray | None = None  # inverse Cholesky factors, 2 x d x d
    offsets: np.ndarray | None = None  # log prior - half the log determinant

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        dens = [self.offsets[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        odds = dens[1] - dens[0]
        odds = odds / (1.0 + np.abs(odds) / 30.0)
        return 1.0 / (1.0 + np.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", train: Column | None = None,
        pool: float = 0.6, ridge: float = 0.02) -> QualityModel:
    """Learn from the documents with a label 0 or 1, where ``train`` (over ``doc_id``) holds."""
    y = (labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
         .groupBy("id").agg(F.min("y").alias("y")))
    rows = docs.where(train) if train is not None else docs
    x = rows.select(F.col("doc_id").alias("id"), F.col(text)).mapInArrow(lean(_stats_rows), f"id {dict(docs.dtypes)['doc_id']}, x array<double>")
    sums = (x.join(y, "id").select("y", "x").mapInArrow(lean(_moments), "label int, sums array<double>")
            .select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("v")).toPandas())
    d = len(STATS)
    n, mean, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        v = sums[sums["label"] == k].sort_values("pos")["v"].to_numpy()
        if len(v):
            n[k] = v[0]
            mean[k] = v[1 : 1 + d] / max(1.0, n[k])
            second[k] = v[1 + d :].reshape(d, d) / max(1.0, n[k])
    prior = (n[1] + 1) / (n.sum() + 2)
    if n.min() < 1:
        return QualityModel(prior)
    cov = second - mean[:, :, None] * mean[:, None, :]
    pooled = (n[:, None, None] * cov).sum(0) / n.sum()
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-4))  # statistics in units of their pooled spread
    factors, offsets = [], []
    for k in (0, 1):
        c = ((1 - pool) * cov[k] + pool * pooled) / np.outer(unit, unit)
        c = (1 - ridge) * c + ridge * max(1e-3, np.trace(c) / d) * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low) / unit)
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum())
    return QualityModel(prior, mean, np.array(factors), np.array(offsets))


def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on) appended."""
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            col = batch.column(batch.schema.get_field_index(text))
            x = np.array([document_stats(t) for t in texts(col)]).reshape(-1, len(STATS))
            s = m.scores(x)
            yield append_columns(batch, {"score": pa.array(s, pa.float64()),
                                         "predicted": pa.array((s >= threshold).astype(np.int32), pa.int32())})

    return docs.mapInArrow(lean(run), appended_schema(docs, "score double, predicted int"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract form: learn from labelled rows outside fold 0, score every row."""
    model = fit(docs, labels, train=~is_fold(F.col("doc_id"), 0))
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", is_fold(F.col("doc_id"), 0).alias("held_out"), "score", "predicted"))
