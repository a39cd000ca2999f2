"""Postings on their way to disk: a term's chunks of one batch travel as one row, and chunks as numbers, not as ids.

A chunk's number is the 64-bit hash of its id, so it is the same in every segment (two of a million chunks share one with a chance of 3e-8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.plain import Hasher, term_postings

_PACKED = "field string, term string, numbers array<long>, tfs array<int>"


def chunk_number() -> Column:
    return F.xxhash64("chunk_id")


def _rows(field: pa.Array, term: pa.Array, heads: np.ndarray, numbers: np.ndarray, tfs: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.append(heads, len(numbers)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((numbers, pa.int64()), (tfs, pa.int32()))]
    return pa.RecordBatch.from_arrays([field, term, *lists], names=["field", "term", "numbers", "tfs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number, size = batch.column("number").to_numpy(), batch.num_rows
        for name in ("title", "body"):
            column = batch.column(f"{name}_terms")
            coded = column.flatten().dictionary_encode()
            if not len(coded):
                continue
            places = pc.list_parent_indices(column).to_numpy().astype(np.int64)
            keys, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * size + places, return_counts=True)
            code = keys // size
            heads = np.flatnonzero(np.diff(code, prepend=-1))
            terms = coded.dictionary.take(pa.array(code[heads]))
            yield _rows(pa.array([name] * len(heads), pa.string()), terms, heads, number[keys % size], counts)


def _count_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        number = batch.column("number").to_numpy()
        for name in ("title", "body"):
            terms, heads, rows, counts = term_postings(batch.column(f"{name}_source"), hasher)
            if len(terms):
                yield _rows(pa.array([name] * len(heads), pa.string()), terms, heads, number[rows], counts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        field, term = (batch.column(c).dictionary_encode() for c in ("field", "term"))
        code = term.indices.to_numpy().astype(np.int64) * len(field.dictionary) + field.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        heads = np.flatnonzero(np.diff(code[order], prepend=-1))
        first = pa.array(order[heads])
        yield _rows(batch.column("field").take(first), batch.column("term").take(first), heads, batch.column("number").to_numpy()[order], batch.column("tf").to_numpy()[order])


def counted(table: DataFrame) -> DataFrame:
    """Packed postings of term lists (number, title_terms, body_terms): counted in the row's own task, nothing is shuffled."""
    return table.select("number", "title_terms", "body_terms").mapInArrow(_count, _PACKED)


def counted_plain(texts: DataFrame) -> DataFrame:
    """As :func:`counted`, of plain texts (number, title_source, body_source)."""
    return texts.select("number", "title_source", "body_source").mapInArrow(_count_plain, _PACKED)


def packed(rows: DataFrame) -> DataFrame:
    """Packed form of postings (number, field, term, tf)."""
    return rows.select("number", "field", "term", F.col("tf").cast("int").alias("tf")).mapInArrow(_pack, _PACKED)


def unpacked(rows: DataFrame, *keep: str) -> DataFrame:
    each = F.arrays_zip(F.col("numbers").alias("number"), F.col("tfs").alias("tf"))
    return rows.select(*keep, "field", "term", F.inline(each))
