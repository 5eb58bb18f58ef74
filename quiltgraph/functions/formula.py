"""Weights by formula: exact in binary and the same in every engine."""

import numpy as np


def formula_weights(rows: int, cols: int) -> np.ndarray:
    """W[i, j] = (((31 i + 17 j) mod 13) - 6) / 64."""
    i, j = np.indices((rows, cols))
    return ((31 * i + 17 * j) % 13 - 6) / 64.0
