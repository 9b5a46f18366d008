"""Arrow batches in slices of about the same bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker has as Python objects at once; a longer row is a slice of its own.
SLICE = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches, of which Spark makes tens of MB each, in slices of at most size bytes of the column text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to
