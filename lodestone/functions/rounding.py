"""Rounding of many numbers as Spark does it: half up, by the decimal text of a double."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """``F.round(x, places)`` of numbers under 2^30 or so; those next to a tie are settled by their decimal text."""
    scale, step = 10.0**places, Decimal(1).scaleb(-places)
    y = np.abs(x) * scale
    low = np.floor(y)
    out = np.copysign(np.floor(y + 0.5) / scale, x)
    near = np.flatnonzero(np.abs(y - low - 0.5) < 1e-4)
    if len(near):
        values, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) for v in values.tolist()])[at]
    return out
