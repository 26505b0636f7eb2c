"""Vectors of Arrow list columns as numpy matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array, size: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: the places in the column and the matrix (rows, components) in doubles.

    Null and empty vectors are left out, as are those that hold a null or non-finite
    component, and those that have not ``size`` components where it is given.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    found = {}
    for n in np.unique(lengths).tolist() if size is None else [size]:
        at = np.flatnonzero(lengths == n)
        if not n or not len(at):
            continue
        flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, n)  # nulls become NaN
        whole = np.isfinite(x).all(axis=1)
        if whole.any():
            found[n] = at[whole], x[whole]
    return found
