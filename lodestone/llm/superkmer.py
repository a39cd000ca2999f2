"""Repeated word windows by super-k-mer partitioning.

Consecutive windows of ``window`` words that share a minimiser travel as one packed string (their words,
joined by a space) to the minimiser's bucket, where sorting counts every window exactly (repeats.py deals
the buckets, and settles those in which all strings are equal by counting them). A word is removed when a
window that covers it starts anywhere else too.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null text: no words; texts shorter than a window keep everything.
Repeated rows are documents of their own and so repeat each other. Input columns named like an output
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import row_slices, text_buffer, word_arrays
from .repeats import covered, repeated_windows, stretches
from .shared import free_name

WINDOW = 35
MINIMISER_WORDS = 12
SLICE = 1 << 20


def word_elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, first = word_arrays(data, offsets)
    return hashes, first


def _pack(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    _, s, e, _ = word_arrays(data, np.array([0, len(data)]))
    return [b" ".join(data[s[a] : e[a + n - 1]].tobytes().split()) for a, n in zip(start, length)]


def count_windows(packed: list[bytes], copies: np.ndarray, bucket: np.ndarray, window: int):
    """Flags of windows that occur at least twice in their bucket (each string counts ``copies`` times), flags of
    the first window of each different one, windows per string."""
    strings = [p.split(b" ") for p in packed]
    sizes = np.array([len(s) - window + 1 for s in strings])
    ids: dict[bytes, int] = {}
    rows = [
        np.lib.stride_tricks.sliding_window_view(np.array([ids.setdefault(w, len(ids)) for w in s], dtype=np.int32), window)
        for s in strings
    ]
    owner = np.repeat(np.arange(len(strings)), sizes)
    windows = np.column_stack((bucket[owner].astype(np.int32), np.concatenate(rows)))
    flat = np.ascontiguousarray(windows).view(np.dtype((np.void, windows.itemsize * (window + 1)))).ravel()
    order = np.argsort(flat, kind="stable")
    ordered = windows[order]
    new = np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1)))
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=copies[owner][order])
    repeated = np.zeros(len(flat), dtype=bool)
    repeated[order] = total[group] > 1
    lead = np.zeros(len(flat), dtype=bool)
    lead[order] = new
    return repeated, lead, sizes


def _digest(packed: bytes, index: int, window: int) -> bytes:
    return blake2b(b" ".join(packed.split(b" ")[index : index + window]), digest_size=16).digest()


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_removed (long) and kept (string: the text without the
    ranges of removed words; white space between kept words stays)."""
    own = ("n_words", "n_removed", "kept")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    key, ranges = free_name(docs, "_key"), free_name(docs, "_ranges")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = repeated_windows(
        keyed.select(F.col(key).alias("key"), "text"), word_elements, _pack, partial(count_windows, window=window),
        partial(_digest, window=window), window, minimiser, SLICE,
    )
    joined = keyed.join(found.select(F.col("key").alias(key), F.col("ranges").alias(ranges)), key, "left").drop(key)
    schema = T.StructType(
        docs.schema.fields + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    )
    passed = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            n_words, n_removed, kept = [], [], []
            for i, j in row_slices(offsets, SLICE):
                _, s, e, first = word_arrays(data, offsets[i : j + 1])
                gone = covered(batch.column(ranges), (i, j), first, window)
                for r in range(i, j):
                    a, b = int(first[r - i]), int(first[r - i + 1])
                    raw = data[offsets[r] : offsets[r + 1]]
                    begin, end = stretches(gone[a:b])
                    n_words.append(b - a)
                    n_removed.append(int((end - begin).sum()))
                    if len(begin):
                        base = offsets[r] - offsets[i]
                        cuts_from, cuts_to = s[a + begin] - base, e[a + end - 1] - base
                        edges = np.concatenate(([0], np.column_stack((cuts_from, cuts_to)).ravel(), [len(raw)]))
                        kept.append(b"".join(raw[x:y].tobytes() for x, y in edges.reshape(-1, 2)))
                    else:
                        kept.append(raw.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed]
                + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*passed, *own],
            )

    return joined.mapInArrow(cut, schema)
