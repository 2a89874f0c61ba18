"""Windows, scaling and scoring as one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowlens import fixed_values as fv
from flowlens.operators.scaling import apply_robust, robust_params
from flowlens.operators.windows import window_rows
from flowlens.session import stage


@dataclass(frozen=True)
class ScaledWindows:
    rows: DataFrame          # rows of complete windows, unscaled, without time, ties and positions
    params: DataFrame        # one row per feature
    scaled: DataFrame        # the same rows with scaled features


def scaled_windows(rows: DataFrame, features: Sequence[str], ties: Sequence[str],
                   clip: float = fv.CLIP_TRAINING, step: int = 1,
                   length: int = fv.WINDOW_LENGTH) -> ScaledWindows:
    """Window the rows, fit the robust scaler on train rows and apply it to all.

    The windowed rows are written once: the exact quantiles read them three times and the
    scaling once more. What only their order needed isn't written.
    """
    ordered = window_rows(rows, ties, step, length)
    windowed = stage(ordered.drop(*{"ts", *ties, "pos", "n", "offset", "split_n"} - set(features)), "windows")
    params = stage(robust_params(windowed.where("split = 'train'"), features), "scaler")
    return ScaledWindows(windowed, params, apply_robust(windowed, features, params, clip))
