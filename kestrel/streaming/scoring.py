"""Stateless scorers on streaming DataFrames.

The reference reads every input whole and has no stream; scaling (M2), PCA projection (M7) and
linear prediction (C5) are row maps with fitted parameters as literals, so the same functions
apply unchanged to a ``readStream`` DataFrame. The sparse-filter transform is not offered here:
its batch norms depend on the rows seen together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.arrays import dot_literal


def score_stream(stream: DataFrame, scaler=None, pca=None, model=None, features: str = "features") -> DataFrame:
    out = stream
    if pca is not None:
        out = pca.transform(out, features)
    if scaler is not None:
        out = scaler.transform(out, features)
    if model is not None:
        if model.nystroem is not None:
            from kestrel.plans.model_selection import predict

            return predict(out, model, features)
        w = model.weights
        out = out.withColumn("score", dot_literal(features, w[:-1], w[-1])).withColumn(
            "prediction", (F.col("score") > 0).cast("double"))
    return out
