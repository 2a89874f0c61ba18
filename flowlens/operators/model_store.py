"""A fitted detector as one thing to keep: model, scaler, features and threshold."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from flowlens import fixed_values as fv
from flowlens.operators import models
from flowlens.operators.sampling import balance
from flowlens.operators.scaling import apply_robust_windows, collect_params, robust_params
from flowlens.operators.windows import window_table_rows, window_table_stats
from flowlens.session import stage

MODEL, SETTINGS = "model", "settings"


@dataclass(frozen=True)
class Settings:
    name: str
    features: list[str]
    length: int
    params: dict[str, list[float]]        # median and scale per feature
    threshold: float
    clip: float


@dataclass(frozen=True)
class Detector:
    """Scores window tables and, by ``streaming.live.score_requests``, requests."""

    settings: Settings
    model: PipelineModel

    @property
    def params(self) -> dict[str, tuple[float, float]]:
        return {f: (m, s) for f, (m, s) in self.settings.params.items()}

    def score(self, windows: DataFrame) -> DataFrame:
        """``(day, split, seq, model, y, p)`` of a window table that isn't scaled yet."""
        s = self.settings
        scaled = apply_robust_windows(windows, s.features, self.params, s.clip)
        return models.predict(self.model, window_table_stats(scaled, s.features), s.name)

    def save(self, path: str) -> None:
        """Write the model, then its settings, which mark a finished copy."""
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(os.path.join(path, MODEL))
        row = spark.createDataFrame([(json.dumps(asdict(self.settings)),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(os.path.join(path, SETTINGS))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Detector:
        kept = json.loads(spark.read.text(os.path.join(path, SETTINGS)).first()[0])
        return Detector(Settings(**kept), PipelineModel.load(os.path.join(path, MODEL)))


def fit_detector(windows: DataFrame, features: Sequence[str], name: str = "XGBoost",
                 length: int = fv.WINDOW_LENGTH, threshold: float = fv.DETECT_THRESHOLD,
                 fit_on: str = "store", rounds: int | None = None,
                 seed: int = fv.SEED) -> Detector:
    """Fit a candidate for serving on the train windows of a window table.

    ``fit_on`` says what the scaler sees: ``store``, all train windows with the serving clip, or
    ``balanced``, the 1:4 sample with the training clip. The model is fitted on the sample.
    """
    if fit_on not in ("store", "balanced"):
        raise ValueError("fit_on is 'store' or 'balanced'")
    train = stage(windows.where("split = 'train'"), "train-windows")
    sample = stage(balance(train, ["day", "seq"], seed=seed), "balanced")
    seen, clip = (train, fv.CLIP_SERVING) if fit_on == "store" else (sample, fv.CLIP_TRAINING)
    params = collect_params(robust_params(window_table_rows(seen, features), features))
    stats = window_table_stats(apply_robust_windows(sample, features, params, clip), features)
    model, _ = models.fit_tabular(name, stage(stats, "stats"), features, rounds=rounds)
    return Detector(Settings(name, list(features), length, {f: list(p) for f, p in params.items()},
                             threshold, clip), model)
