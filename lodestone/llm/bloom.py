"""Bloom filters of 64-bit hashes, built by tasks and of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import as_long, mix

MOST_BITS = 1 << 28
BITS_EACH = 16


def _bits(values: np.ndarray, size: int) -> list[np.ndarray]:
    return [(mix(values + np.uint64(k)) % np.uint64(size)).astype(np.int64) for k in (1, 2, 3)]


def bloom_filter(values: DataFrame, column: str, most_bits: int = MOST_BITS) -> np.ndarray:
    """Filter of a long column as bytes. Beyond ``most_bits`` more values do not enlarge it: it lets more through and loses none."""
    size = 1 << 10
    wanted = BITS_EACH * values.count()
    while size < min(wanted, most_bits):
        size *= 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), size)))
            block, start = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(as_long(mask))], names=["block", "mask"])

    table = values.select(column).mapInArrow(emit, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[table.column("block").to_numpy()] = table.column("mask").to_numpy()
    return out.view(np.uint8)


def holds(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    found = np.ones(len(values), dtype=bool)
    for bit in _bits(values, 8 * len(filter_)):
        found &= (filter_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return found
