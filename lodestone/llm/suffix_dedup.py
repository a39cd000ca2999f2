"""Substring removal by a depth-limited radix sort of suffixes.

Every byte position starts a suffix, of which only the first ``depth`` bytes count. The first pass deals
runs of neighbouring suffixes by the minimiser of their ``depth`` bytes (repeats.py); inside a bucket suffixes are sorted
by most-significant-digit passes of eight bytes, down to ``depth`` and no further. A pass touches only groups whose
digits differ, and suffixes left alone drop out. Groups that remain equal at full depth are repeated ``depth``-byte
strings; every byte that such a string covers is removed. Only buckets with several different runs are sorted: a bucket
whose runs all have the same 128 bits of hash is settled by counting them, and windows of a bucket that is dealt over several
groups meet again by a 128-bit digest. So results are exact short of a collision of hashes.

Null text: empty. Texts shorter than ``depth`` bytes keep everything. Repeated rows are documents of
their own and so repeat each other. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import BYTE_HASH, row_slices, text_buffer
from .repeats import covered, repeated_windows, stretches
from .shared import free_name

DEPTH = 400
ANCHOR = 128
SLICE = 1 << 18


def byte_elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_HASH[data[offsets[0] : offsets[-1]]], offsets - offsets[0]


def _pack(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    return [data[s : s + n].tobytes() for s, n in zip(start, length)]


def sort_suffixes(packed: list[bytes], copies: np.ndarray, bucket: np.ndarray, depth: int):
    """Flags of suffixes whose first ``depth`` bytes occur at least twice in their bucket, flags of the first
    suffix of each different one, suffixes per string. ``bucket``: ascending number of each string."""
    lengths = np.array([len(p) for p in packed])
    sizes = lengths - depth + 1
    buffer = np.frombuffer(b"".join(packed) + bytes(8), dtype=np.uint8)
    bases = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(packed)), sizes)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bases[owner]
    digit = np.zeros(len(buffer) - 7, dtype=np.uint64)
    for i in range(8):
        digit |= buffer[i : len(buffer) - 7 + i].astype(np.uint64) << np.uint64(8 * (7 - i))
    repeated = copies[owner] > 1
    # ``rank``: suffixes in sorted order so far; ``group``: number of their group, ascending.
    rank = np.arange(len(start))
    group = bucket[owner]
    for d in range(0, depth, 8):
        at = min(d, depth - 8)  # the last digit may overlap the one before
        key = digit[start[rank] + at]
        heads = np.concatenate(([True], group[1:] != group[:-1]))
        lead = key[np.flatnonzero(heads)[np.cumsum(heads) - 1]]
        uneven = np.zeros(group[-1] + 1, dtype=bool)
        uneven[group[key != lead]] = True
        touched = np.flatnonzero(uneven[group])
        if len(touched):
            order = touched[np.lexsort((key[touched], group[touched]))]
            rank[touched], key[touched] = rank[order], key[order]
        split = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(split) - 1
        keep = np.bincount(group)[group] > 1
        if not keep.all():
            rank, group = rank[keep], group[keep]
            if not len(rank):
                break
            group = np.cumsum(np.concatenate(([True], group[1:] != group[:-1]))) - 1
    lead = np.ones(len(start), dtype=bool)
    lead[rank] = np.concatenate(([True], group[1:] != group[:-1])) if len(rank) else True
    repeated[rank] = True
    return repeated, lead, sizes


def _digest(packed: bytes, index: int, depth: int) -> bytes:
    return blake2b(packed[index : index + depth], digest_size=16).digest()


def remove_repeats(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_bytes, n_removed, n_spans (long), removed (array of byte ranges
    ``begin``, ``end``) and kept (binary: the bytes left; a cut may fall inside a character)."""
    own = ("n_bytes", "n_removed", "n_spans", "removed", "kept")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = repeated_windows(
        keyed.select(F.col(key).alias("key"), "text"), byte_elements, _pack, partial(sort_suffixes, depth=depth),
        partial(_digest, depth=depth), depth, anchor, SLICE,
    )
    ranges = free_name(docs, "_ranges")
    joined = keyed.join(found.select(F.col("key").alias(key), F.col("ranges").alias(ranges)), key, "left").drop(key)
    schema = T.StructType(
        docs.schema.fields
        + [T.StructField(c, T.LongType()) for c in own[:3]]
        + [T.StructField("removed", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
           T.StructField("kept", T.BinaryType())]
    )
    passed = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            n, removed, spans, kept = [], [], [], []
            for i, j in row_slices(offsets, SLICE):
                first = offsets[i : j + 1] - offsets[i]
                gone = covered(batch.column(ranges), (i, j), first, depth)
                for r in range(i, j):
                    a, b = first[r - i], first[r - i + 1]
                    flags, piece = gone[a:b], data[offsets[r] : offsets[r + 1]]
                    begin, end = stretches(flags)
                    n.append(b - a)
                    removed.append(int(flags.sum()))
                    spans.append([{"begin": x, "end": y} for x, y in zip(begin.tolist(), end.tolist())])
                    kept.append(piece[~flags].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed]
                + [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                   pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=[*passed, *own],
            )

    return joined.mapInArrow(cut, schema)

