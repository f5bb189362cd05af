"""Scaler (M1-M3): feature mask -> log10 -> log2 -> log1p -> standardise, flags compounding in
that order. Moments are one posexplode + hash aggregate (d groups, partial-aggregated map-side);
the transform is a codegen'd ``transform`` against literal moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from kestrel.functions.arrays import log_features, select_indices, standardise
from kestrel.operators.stats import moments_arrays


@dataclass
class Scaler:
    standardise: bool = True
    log10: bool = False
    log2: bool = False
    log1p: bool = False
    mask: Sequence[int] | None = None  # feature indexes kept (and scaled)
    mean: list = field(default=None)
    std: list = field(default=None)

    def _pre(self, df: DataFrame, features: str) -> DataFrame:
        col = select_indices(features, self.mask) if self.mask is not None else df[features]
        for flag, kind in ((self.log10, "log10"), (self.log2, "log2"), (self.log1p, "log1p")):
            if flag:
                col = log_features(col, kind)
        return df.withColumn(features, col)

    def fit(self, df: DataFrame, features: str = "features") -> "Scaler":
        pre = self._pre(df, features)
        if self.standardise:
            mean, std = moments_arrays(pre, features)
            self.mean, self.std = [float(v) for v in mean], [float(v) for v in std]
        return self

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        out = self._pre(df, features)
        if self.standardise:
            if self.mean is None:
                raise ValueError("scaler is not fitted")
            out = out.withColumn(features, standardise(features, self.mean, self.std))
        return out

    def fit_transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        return self.fit(df, features).transform(df, features)

    def to_dict(self) -> dict:
        return {k: getattr(self, k) for k in ("standardise", "log10", "log2", "log1p", "mask", "mean", "std")}

    @classmethod
    def from_dict(cls, d: dict) -> "Scaler":
        return cls(**d)


def dataset_scaling(df: DataFrame, features: str = "features") -> tuple[DataFrame, Scaler]:
    """M3: standardisation only, returning data and scaler."""
    sc = Scaler(standardise=True)
    return sc.fit_transform(df, features), sc
