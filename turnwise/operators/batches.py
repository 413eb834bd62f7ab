"""Groups and runs within batches of sorted rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs up to so long are added up place by place, all at once.
SHORT = 32


def begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows at which a group of equal keys begins; nulls are equal."""
    new = np.zeros(max(len(table) - 1, 0), bool)
    for name in keys if len(table) > 1 else []:
        one, two = (table.column(name).slice(k, len(table) - 1) for k in (0, 1))
        new |= pc.not_equal(one, two).fill_null(False).to_numpy() | pc.xor(one.is_null(), two.is_null()).to_numpy()
    return np.append(0, np.flatnonzero(new) + 1) if len(table) else np.zeros(0, np.int64)


def running(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row the sum of the values before it in its run, added in their order; first: the row at which each run begins."""
    out = np.zeros(len(values))
    size = np.append(first[1:], len(values)) - first
    for a, n in zip(first[size > SHORT].tolist(), size[size > SHORT].tolist()):
        np.cumsum(values[a : a + n - 1], out=out[a + 1 : a + n])
    short = (first[size <= SHORT], size[size <= SHORT])
    for k in range(1, int(short[1].max(initial=0))):
        at = short[0][short[1] > k] + k
        out[at] = out[at - 1] + values[at - 1]
    return out
