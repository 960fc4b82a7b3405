"""Bounded stretches of Arrow batches, for Python code that needs more room than the batch itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def stretches(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive stretches of at most ``most`` bytes of text, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes + 1), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield at, to
        at = to
