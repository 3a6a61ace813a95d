"""The last events of a curve as rows of a network's input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.curves import KEYS
from .arrays import mapped, robust_scale


def event_tensor(t: np.ndarray, y: np.ndarray, most: int = 128) -> np.ndarray:
    """A row per event, of the last ones only: standardised flux and log gap,
    relative time, slope (within 20) and its size."""
    t, y = t[-most:], y[-most:]

    def standard(x: np.ndarray) -> np.ndarray:
        return (x - np.median(x)) / robust_scale(x, 1e-6)

    z, gap = standard(y), np.maximum(np.diff(t, prepend=t[0]), 0.0)
    slope = np.concatenate([[0.0], np.clip(np.diff(z) / np.maximum(gap[1:], 1e-3), -20, 20)])
    span = t[-1] - t[0]
    return np.stack([z, standard(np.log1p(gap)), (t - t[0]) / span if span > 0 else np.zeros(len(t)), slope, np.abs(slope)], axis=1)


def event_rows(curves: DataFrame, most: int = 128) -> DataFrame:
    """The tensor's rows of each curve: i and the five channels."""
    rows = curves.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("p")).select(*KEYS, F.col("p")["t"].alias("pt"), F.col("p")["y"].alias("py"))
    names = ("z", "log_gap", "relative_t", "slope", "slope_size")

    def kernel(t: np.ndarray, y: np.ndarray) -> dict:
        found = event_tensor(t, y, most)
        return {"i": np.arange(1, len(found) + 1), **dict(zip(names, found.T, strict=True))}

    return mapped(rows, KEYS, kernel, "i int, " + ", ".join(f"{n} double" for n in names))
