"""Texts inside a task, a few megabytes at a time.

A batch that Spark hands to Python has thousands of rows. Turned into Python strings all at once, with
what is made of them, they take several times their size in every worker of an executor, and the more
so the fuller the batches of a large table are. A function that takes and gives iterators may return a
batch in parts, so only one part is held as Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of texts that are Python strings at a time, and rows at most.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1024


def slices(texts: pa.Array, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most ``most_bytes`` together; a longer text is alone."""
    reach = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = before = 0
    while at < len(texts):
        end = int(np.searchsorted(reach, before + most_bytes, side="right"))
        end = min(max(end, at + 1), at + most_rows, len(texts))
        yield texts.slice(at, end - at).to_pylist()
        at, before = end, int(reach[end - 1])
