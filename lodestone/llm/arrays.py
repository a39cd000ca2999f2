"""Numpy building blocks for tasks: word hashes, rolling span hashes, minimiser runs.

Everything works on slices of an Arrow batch, so a task holds a few megabytes besides the batch.
Hash constants are arbitrary odd numbers; results do not depend on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _B
    x ^= x >> _U(27)
    x *= _C
    x ^= x >> _U(31)
    return x


BYTE_HASH = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _A)
_WORD_BYTE = np.where(SPACE, _U(0), BYTE_HASH)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, SLICE_BYTES + 1)
        table = np.full(size, _U(base), dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table[:n]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[column.offset : column.offset + n + 1] if raw else np.zeros(n + 1, np.int64)
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values, offsets


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of one long text that end after white space, about SLICE_BYTES each."""
    n, i = len(data), 0
    while i < n:
        j = min(i + SLICE_BYTES, n)
        if j < n:
            back = np.flatnonzero(SPACE[data[i:j]])
            if len(back):
                j = i + int(back[-1]) + 1
            else:
                while j < n and not SPACE[data[j]]:
                    j += 1
        yield i, j
        i = j


def _words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    inside = ~SPACE[data]
    border = np.zeros(n + 1, dtype=bool)
    border[first] = True
    border[n] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    value = _WORD_BYTE[data]
    value *= _power_table(_BASE, n)
    value = np.add.reduceat(value, starts)
    value *= _power_table(_INVERSE, n)[starts]
    value += (ends - starts).astype(np.uint64) * _A
    return mix(value), starts, ends


def word_arrays(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Words of consecutive texts: 64-bit hashes, byte starts and ends (relative to
    ``offsets[0]``), and the index of each text's first word (one more than texts)."""
    low, high = int(offsets[0]), int(offsets[-1])
    data = data[low:high]
    if lower:
        data = LOWER[data]
    rows = offsets - low
    if len(data) <= SLICE_BYTES or len(rows) > 2:
        h, s, e = _words(data, rows[:-1][rows[:-1] < len(data)])
    else:
        parts = []
        for i, j in _cuts(data):
            ph, ps, pe = _words(data[i:j], np.zeros(1, np.int64))
            parts.append((ph, ps + i, pe + i))
        h, s, e = (np.concatenate(x) for x in zip(*parts))
    return h, s, e, np.searchsorted(s, rows)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _A
    out += right
    out ^= out >> _U(29)
    out *= _C
    out ^= out >> _U(32)
    return out


def span_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values (empty for fewer), by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, size, current, left = None, 0, 1, values, k
    while left:
        if left & 1:
            piece = current[done : done + n]
            out = piece if out is None else _join(out, piece)
            done += size
        left >>= 1
        if left:
            current = _join(current[:-size], current[size:])
            size *= 2
    return mix(out ^ _U(k))


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys."""
    size, current = 1, keys
    while size * 2 <= width:
        current = np.minimum(current[:-size], current[size:])
        size *= 2
    rest = width - size
    return np.minimum(current[: len(keys) - width + 1], current[rest : rest + len(keys) - width + 1])


def minimiser_runs(values: np.ndarray, first: np.ndarray, window: int, k: int):
    """Runs of consecutive windows that share their minimiser.

    ``values``: element hashes of consecutive texts; ``first``: index of each text's first element
    and the total. A window is ``window`` elements of one text; its minimiser is the leftmost
    k-element span with the smallest hash in it. Returns arrays: text, start of the first window in
    its text, number of windows, minimiser hash, hash of all elements that the run covers.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(values) < window:
        return empty
    anchors = span_hashes(values, k)
    position = np.arange(len(anchors), dtype=np.uint64)
    bits = _U(max(int(len(anchors)).bit_length(), 1))
    keys = ((mix(anchors) >> bits) << bits) | position
    low = window_minimum(keys, window - k + 1)
    at = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)
    lengths = np.diff(first)
    counts = np.maximum(lengths - window + 1, 0)
    texts = np.flatnonzero(counts)
    if not len(texts):
        return empty
    counts, base = counts[texts], first[texts]
    # Window starts that lie in one text.
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start, owner = step + np.repeat(base, counts), np.repeat(texts, counts)
    at = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(start)))
    begin = start[head]
    # Hash of the covered elements from prefix sums of value * base^index.
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values + _A) * _power_table(_BASE, len(values)), out=total[1:])
    whole = (total[begin + n - 1 + window] - total[begin]) * _power_table(_INVERSE, len(values))[begin]
    whole = mix(whole ^ (n.astype(np.uint64) * _B) ^ ((at[head] - begin).astype(np.uint64) * _C))
    return owner[head], begin - first[owner[head]], n, anchors[at[head]], whole


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64) if values.dtype == np.uint64 else values


def long_minimiser_runs(values: np.ndarray, first: np.ndarray, window: int, k: int, limit: int = 1 << 18):
    """``minimiser_runs`` in bounded memory: one long text is taken in pieces that overlap by
    ``window - 1`` elements, so each window lies in exactly one piece."""
    if len(first) != 2 or len(values) <= limit + window:
        return minimiser_runs(values, first, window, k)
    parts = []
    for i in range(0, len(values) - window + 1, limit):
        piece = values[i : i + limit + window - 1]
        own, start, n, anchor, whole = minimiser_runs(piece, np.array([0, len(piece)]), window, k)
        parts.append((own, start + i, n, anchor, whole))
    return tuple(np.concatenate(x) for x in zip(*parts))
