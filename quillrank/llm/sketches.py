"""Fixed-size summaries that tasks build over all rows and that are merged by ranges of their counters.

Their size is a parameter and doesn't depend on the input, so the merged
summary can be broadcast at any scale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 14
SCHEMA = "piece int, counters binary"


def pieces(vector: np.ndarray) -> pa.RecordBatch:
    """The non-zero parts of a vector, as rows (piece, counters)."""
    parts = [(k, vector[k * PIECE : (k + 1) * PIECE]) for k in range(-(-len(vector) // PIECE))]
    parts = [(k, p) for k, p in parts if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], names=["piece", "counters"])


def merged(partial: DataFrame, width: int, stored: type, result: type, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum (by ``add``) of all partial vectors. Tasks merge streams of pieces; the driver gets each piece once."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(raw.as_buffer(), stored).astype(result)
                found[k] = add(found[k], values) if k in found else values
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["piece", "counters"])

    out = np.zeros(width, result)
    for k, raw in partial.repartition(max(1, min(64, width // PIECE)), "piece").mapInArrow(merge, SCHEMA).collect():
        values = np.frombuffer(raw, result)
        at = slice(k * PIECE, k * PIECE + len(values))
        out[at] = add(out[at], values)
    return out
