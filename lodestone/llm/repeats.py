"""Which windows of a corpus start more than once, without a row per window.

Consecutive windows that share their minimiser (the smallest k-element span) form a run. Equal windows
have equal minimisers at equal places, so windows are compared only inside the bucket of a minimiser:

1. minimisers are counted; a run whose minimiser occurs once cannot hold a repeated window;
2. equal runs of the rest are counted together (partial sums per task, so thousands of copies of a passage
   travel as one row each task);
3. buckets of one distinct run are settled: all its windows repeat. In the others one occurrence of every
   distinct run goes to its bucket as a packed string, where ``compare`` finds the windows that repeat.
   Strings of buckets of more than BUCKET_RUNS are texts to the same steps with longer spans, which deal them
   by more of their content. Buckets that are as large there are dealt over several groups by run hash, and their
   windows meet again by digest;
4. the verdict of each distinct run is joined back to its occurrences and collected by document.

Hashes of 64 bits only choose buckets and group whole runs (128 bits together with the minimiser). Joins on
hot minimisers read stored tables on both sides, so that adaptive execution can split them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import as_long, long_minimiser_runs, row_slices, text_buffer
from .shared import shared_table

BUCKET_RUNS = 1024
RUN_SCHEMA = "key long, start int, n int, anchor long, whole long"
STRING_SCHEMA = "anchor long, salt int, whole long, copies int, parts int, packed binary"
VERDICT_SCHEMA = "anchor long, whole long, digest binary, copies int, first int, last int"

# elements(data, offsets) -> element hashes, index of each text's first element
Elements = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def run_rows(keyed: DataFrame, elements: Elements, window: int, k: int, slice_bytes: int) -> DataFrame:
    """One row per run of ``keyed`` (key, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for i, j in row_slices(offsets, slice_bytes):
                values, first = elements(data, offsets[i : j + 1])
                owner, start, n, anchor, whole = long_minimiser_runs(values, first, window, k)
                if len(owner):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[i:j][owner]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                         pa.array(as_long(anchor)), pa.array(as_long(whole))],
                        names=["key", "start", "n", "anchor", "whole"],
                    )

    return keyed.select("key", "text").mapInArrow(emit, RUN_SCHEMA)


def _strings(wanted: DataFrame, pack: Callable, window: int) -> DataFrame:
    """Packed strings of the wanted runs of each text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            lists = batch.column("wanted")
            for i in range(batch.num_rows):
                w = lists[i].values
                start, n = w.field("start").to_numpy(), w.field("n").to_numpy()
                packed = pack(data[offsets[i] : offsets[i + 1]], start, n + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [w.field("anchor"), w.field("salt"), w.field("whole"), w.field("copies"), w.field("parts"),
                     pa.array(packed, pa.binary())],
                    names=["anchor", "salt", "whole", "copies", "parts", "packed"],
                )

    return wanted.mapInArrow(emit, STRING_SCHEMA)


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _verdict_rows(packed: list, meta: np.ndarray, compare: Callable, digest: Callable) -> pa.RecordBatch | None:
    """Verdicts of whole buckets; meta columns: anchor, salt, whole, copies, parts.

    Ranges of windows that repeat within their group; of groups that are part of a bucket also the
    digest of every different window, once each.
    """
    bucket = np.cumsum(np.concatenate(([0], (meta[1:, :2] != meta[:-1, :2]).any(axis=1))))
    repeated, lead, sizes = compare(packed, meta[:, 3], bucket)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    owner, first, last = [], [], []
    for i in range(len(packed)):
        begin, end = stretches(repeated[bounds[i] : bounds[i + 1]])
        owner.append(np.full(len(begin), i))
        first.append(begin)
        last.append(end)
    owner, first, last = (np.concatenate(x).astype(np.int64) for x in (owner, first, last))
    digests, copies = [None] * len(owner), np.full(len(owner), 2)
    parted = np.flatnonzero(lead & np.repeat(meta[:, 4] > 1, sizes))
    if len(parted):
        string = np.searchsorted(bounds, parted, side="right") - 1
        index = parted - bounds[string]
        digests += [digest(packed[i], k) for i, k in zip(string.tolist(), index.tolist())]
        copies = np.concatenate((copies, np.where(repeated[parted], 2, 1)))
        owner, first, last = np.concatenate((owner, string)), np.concatenate((first, index)), np.concatenate((last, index + 1))
    if not len(owner):
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(meta[owner, 0]), pa.array(meta[owner, 2]), pa.array(digests, pa.binary()), pa.array(copies.astype(np.int32)),
         pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
        names=["anchor", "whole", "digest", "copies", "first", "last"],
    )


def _compare_buckets(strings: DataFrame, compare: Callable, digest: Callable) -> DataFrame:
    """Streams a sorted partition through ``compare``, whole groups (anchor, salt) of about BUCKET_RUNS strings at a time."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("anchor", "salt", "whole", "copies", "parts")]).astype(np.int64)
            packed = batch.column("packed").to_pylist()
            cut = np.flatnonzero((keys[1:, :2] != keys[:-1, :2]).any(axis=1)) + 1
            for i, j in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))):
                begins = not rows or (keys[i, :2] != rows[-1][-1, :2]).any()
                if begins and len(held) >= BUCKET_RUNS:
                    out = _verdict_rows(held, np.concatenate(rows), compare, digest)
                    if out is not None:
                        yield out
                    held, rows = [], []
                held.extend(packed[i:j])
                rows.append(keys[i:j])
        if held:
            out = _verdict_rows(held, np.concatenate(rows), compare, digest)
            if out is not None:
                yield out

    return strings.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(emit, VERDICT_SCHEMA)


def repeated_windows(
    keyed: DataFrame, elements: Elements, pack: Callable, compare: Callable, digest: Callable, window: int, k: int, slice_bytes: int,
    deeper: bool = True,
) -> DataFrame:
    """key, ranges: array<struct<first, last>> of window starts (in elements) that occur elsewhere too.

    ``keyed``: key, text; rows with equal keys count as separate texts. ``deeper``: whether large buckets are dealt by longer spans first.
    """
    runs = run_rows(keyed, elements, window, k, slice_bytes)
    anchors = shared_table(
        runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "anchors"
    )
    live = shared_table(runs.join(anchors, "anchor", "left_semi").select("key", "start", "n", "anchor", "whole"), "live-runs")
    kinds = live.groupBy("anchor", "whole").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "start", "n")).alias("at")
    )
    kinds = shared_table(kinds.select("anchor", "whole", F.least("c", F.lit(2)).cast("int").alias("copies"), "at"), "kinds")
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed = shared_table(mixed.select("anchor", F.ceil(F.col("k") / BUCKET_RUNS).cast("int").alias("parts")), "mixed")

    alone = kinds.join(mixed, "anchor", "left_anti").select(
        "anchor", "whole", F.lit(0).alias("first"), F.col("at.n").alias("last")
    )
    wanted = (
        kinds.join(mixed, "anchor")
        .select(F.col("at.key").alias("key"), F.struct(
            F.col("at.start").alias("start"), F.col("at.n").alias("n"), "anchor",
            F.pmod(F.col("whole"), F.col("parts")).cast("int").alias("salt"), "whole", "copies", "parts",
        ).alias("w"))
        .groupBy("key").agg(F.collect_list("w").alias("wanted"))
    )
    texts = wanted.join(keyed.select("key", "text"), "key")
    strings = _strings(texts.select("key", "text", "wanted"), pack, window)
    below = None
    if deeper and not mixed.where("parts > 1").isEmpty():
        large = shared_table(strings.where("parts > 1").select("anchor", "whole", "copies", F.col("packed").alias("text")), "large")
        strings = strings.where("parts = 1")
        name = F.xxhash64("anchor", "whole")
        # A string that occurs several times is there twice, so that all its windows repeat.
        texts = large.select(name.alias("key"), F.explode(F.array_repeat("text", F.col("copies"))).alias("text"))
        within = repeated_windows(texts, elements, pack, compare, digest, window, (k + window) // 2, slice_bytes, deeper=False)
        below = large.select("anchor", "whole", name.alias("key")).join(within, "key").select("anchor", "whole", F.inline("ranges"))
    compared = shared_table(_compare_buckets(strings, compare, digest), "compared")
    settled = compared.where("digest is null").select("anchor", "whole", "first", "last")
    parted = compared.where("digest is not null")
    again = shared_table(parted.groupBy("digest").agg(F.sum("copies").alias("c")).where("c > 1").select("digest"), "digests")
    met = parted.join(again, "digest", "left_semi").select("anchor", "whole", "first", "last")
    found = alone.unionByName(settled).unionByName(met)
    verdicts = shared_table(found if below is None else found.unionByName(below), "verdicts")
    ranges = live.join(verdicts, ["anchor", "whole"]).select(
        "key", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")).alias("r")
    )
    return ranges.groupBy("key").agg(F.collect_list("r").alias("ranges"))


def covered(lists, rows: tuple[int, int], first: np.ndarray, window: int) -> np.ndarray:
    """Flags of elements that a repeated window covers; ``lists``: the ranges column, ``first``: element bounds."""
    i, j = rows
    mark = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    for r in range(i, j):
        cell = lists[r].values
        if cell is None or not len(cell):
            continue
        base = int(first[r - i])
        np.add.at(mark, base + cell.field("first").to_numpy(), 1)
        np.add.at(mark, base + cell.field("last").to_numpy() + (window - 1), -1)
    return np.cumsum(mark[:-1]) > 0
