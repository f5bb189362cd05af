"""Language ID by error-correcting output codes.

Every language gets a codeword of +1/-1 bits. One binary n-gram classifier per bit separates the
languages with bit +1 from those with -1: its weight for a hashed byte trigram is the log ratio of
the trigram's mean frequency in the two sides (each language counts alike, however many
documents it has), and its margin for a text is the mean weight over the text's trigrams.
Decoding is loss-weighted: the language with the smallest sum over the bits of
``v_b * log(1 + exp(-code * margin / scale_b))`` wins, where ``scale_b`` is the typical margin of
bit ``b`` on its own training languages and ``v_b`` grows with how well the bit separates them. A
prediction is ambiguous when the runner-up's loss lies within ``gap`` of the winner's.

Fitting is one aggregation over all training texts: counts per (language, trigram bucket), at most
``BUCKETS`` rows per language and partition, summed by Spark; only the languages x ``BUCKETS``
table reaches the driver. Prediction is a map over the texts.

Defined cases: null texts, empty texts and texts without a letter give ``und`` with score 0 and
``ambiguous`` false; with no learned language every text is ``und``; one learned language is
always predicted with score 1. Repeated rows are predicted alike. Ties in the loss go to the
language that sorts first. Null languages and null ids are never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import append_columns, appended_schema, broadcast_value, is_fold, lean, slices, texts

BUCKETS = 1 << 16
SMOOTH = 0.5
CHUNK = 1 << 18
UND = "und"
_LETTER = regex.compile(r"\p{L}")
# ASCII characters other than letters act as word borders
_BORDER = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigram_buckets(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text; runs of non-letters are one border."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BORDER).split()) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    h = (x[:-2] * np.uint32(65536) + x[1:-1] * np.uint32(256) + x[2:]) * np.uint32(2654435761)
    return h >> np.uint32(16)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n x bits matrix of +1/-1. Up to 5 languages: the exhaustive code (every split once);
    beyond, the best of 20 random codes of ``ceil(10 log2 n)`` bits by least Hamming distance."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cols = [[1 if (c >> i) & 1 else -1 for i in range(n)] for c in range(1, 1 << n, 2) if c != (1 << n) - 1]
        return np.array(cols, np.int8).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, best_d = None, -1
    for _ in range(20):
        code = rng.permuted(np.tile(np.where(np.arange(n) % 2, 1, -1).astype(np.int8)[:, None], (1, bits)), axis=0)
        d = min(int((code[i] != code[i + 1:]).sum(1).min()) for i in range(n - 1))
        if d > best_d:
            best, best_d = code, d
    return best


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray  # langs x bits
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray  # bits
    value: np.ndarray  # bits

    def margins(self, text: str) -> np.ndarray:
        idx = trigram_buckets(text)
        total = np.zeros(self.weights.shape[1])
        for a in range(0, len(idx), CHUNK):
            total += self.weights.take(idx[a : a + CHUNK], axis=0).sum(0, dtype=np.float64)
        return total / max(1, len(idx))

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Loss of every language."""
        return (np.logaddexp(0.0, -self.code * (margins / self.scale) * 4.0) * self.value).sum(1)

    def predict(self, text: str | None, gap: float) -> tuple[str, float, bool]:
        if not text or not self.langs or not _LETTER.search(text):
            return UND, 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = self.decode(self.margins(text))
        best = int(np.argmin(loss))
        p = float(1.0 / np.exp(loss[best] - loss).sum())
        second = np.partition(loss, 1)[1]
        return self.langs[best], p, bool(second - loss[best] < gap)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    pending: dict[str, list[np.ndarray]] = {}
    held = 0

    def flush() -> None:
        for lang, parts in pending.items():
            c = np.bincount(np.concatenate(parts), minlength=BUCKETS)
            counts[lang] = counts[lang] + c if lang in counts else c
        pending.clear()

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            idx = trigram_buckets(text)
            if len(idx):
                pending.setdefault(lang, []).append(idx)
                held += len(idx)
                if held > 1 << 22:
                    flush()
                    held = 0
    flush()
    for lang, c in counts.items():
        nz = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(nz), pa.string()), pa.array(nz.astype(np.int32)), pa.array(c[nz].astype(np.int64))],
            names=["lang", "bucket", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", train: Column | None = None) -> LanguageModel:
    """Learn from the rows of ``docs`` where ``train`` holds and neither column is null."""
    rows = docs.where(train) if train is not None else docs
    rows = rows.select(F.col(lang).cast("string"), F.col(text)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    got = (rows.mapInArrow(lean(_count), "lang string, bucket int, n bigint")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(got["lang"].unique())
    code = codewords(len(langs))
    if not langs:
        return LanguageModel([], code, np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.ones(1))
    freq = np.full((len(langs), BUCKETS), SMOOTH)
    freq[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), got["bucket"].to_numpy()] += got["n"].to_numpy()
    freq /= freq.sum(1, keepdims=True)
    bits = code.shape[1]
    weights = np.zeros((BUCKETS, bits), np.float32)
    scale, value = np.ones(bits), np.ones(bits)
    for b in range(bits if len(langs) > 1 else 0):
        on = code[:, b] > 0
        weights[:, b] = np.log(freq[on].mean(0)) - np.log(freq[~on].mean(0))
        typical = (freq @ weights[:, b].astype(np.float64)) * code[:, b]
        scale[b] = max(1e-6, np.abs(typical).mean())
        value[b] = max(0.05, min(1.0, typical.min() / scale[b]))
    return LanguageModel(langs, code, weights, scale, value)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", gap: float = 0.5) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous`` appended (own columns of these
    names give way)."""
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            col = batch.column(batch.schema.get_field_index(text))
            got = [m.predict(t, gap) for t in texts(col)]
            yield append_columns(batch, {"lang_pred": pa.array([g[0] for g in got], pa.string()),
                                         "score": pa.array([g[1] for g in got], pa.float64()),
                                         "ambiguous": pa.array([g[2] for g in got], pa.bool_())})

    return docs.mapInArrow(lean(run), appended_schema(docs, "lang_pred string, score double, ambiguous boolean"))


def op9(docs: DataFrame) -> DataFrame:
    """Contract form: learn from rows outside fold 0, predict every row."""
    model = fit(docs, train=~is_fold(F.col("doc_id"), 0) & F.col("doc_id").isNotNull())
    return (predict(docs.select("doc_id", "text"), model)
            .select("doc_id", is_fold(F.col("doc_id"), 0).alias("held_out"), "lang_pred", "score", "ambiguous"))
