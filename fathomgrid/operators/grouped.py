"""Whole groups of sorted rows inside a task, and connected components of many small graphs at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows in batches of whole groups, and the places where groups begin. Rows of equal first `by` columns, which hold no
    nulls, follow each other; no more than a batch and a group is held."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, (None,)):
        if batch is not None and not batch.num_rows:
            continue
        held += [batch] * (batch is not None)
        if not held:
            return
        rows = pa.concat_batches(held) if len(held) > 1 else held[0]
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in rows.columns[:by]:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        if batch is None:
            yield rows, starts
        else:
            held = [rows.slice(starts[-1])]
            if starts[-1]:
                yield rows.slice(0, starts[-1]), starts[:-1]


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least one that links between a and b reach."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    return label
