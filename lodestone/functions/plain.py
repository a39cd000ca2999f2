"""Index terms of plain texts by array operations: the same terms as ``tokenize``, as hashes of their bytes.

Plain are texts of ASCII and the letters U+00C0 to U+00FF (with the two signs among them): normalisation leaves them alone, and a term's
bytes can be told from their neighbours. Terms of one text are equal if ``HASH_BITS`` bits of hash are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

MAX_BYTES = 1 << 22
SLICE_BYTES, SLICE_ROWS = 1 << 18, 1 << 10
HASH_BITS = 54
_ROW = np.uint64(HASH_BITS)
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BASE = 0xD6E8FEB86659FD93


def is_plain(text: Column) -> Column:
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.coalesce((F.octet_length(text) <= MAX_BYTES) & (ascii_ | ~text.rlike("[^\\x00-\\x7F\\u00C0-\\u00FF]")), F.lit(False))


def not_plain(column: pa.Array) -> np.ndarray:
    """Flags of the rows of a column of texts that are null, too long or hold another character, as :func:`is_plain` tells them from plain ones."""
    out = column.is_null().to_numpy(zero_copy_only=False).copy()
    for i, j, text, first in slices(column):
        lead, high = text == 0xC3, text >= 0x80
        if high.any():
            pair = lead[:-1] & high[1:] & (text[1:] < 0xC0)
            high[:-1] &= ~pair
            high[1:] &= ~pair
            out[np.searchsorted(first, np.flatnonzero(high), side="right") - 1 + i] = True
        out[i:j] |= np.diff(first) > MAX_BYTES
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _set(*parts: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for part in parts:
        out[list(part)] = True
    return out


_UPPER, _LOWER, _DIGIT = _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(b"0123456789")
_LETTER = _UPPER | _LOWER | _set(bytes(range(128, 256)))
_BOTH, _JOINER = _set(b"'."), _set(b"'.,;")
_ALPHA, _ALNUM = _UPPER | _LOWER, _UPPER | _LOWER | _DIGIT
_IDENTIFIER = _ALNUM | _set(b"_.$-")
_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX[0])
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[65:91] += 32
# Kinds of a byte as bits, looked up by ``bytes.translate``, which is several times faster than indexing with bytes.
_KINDS = {"letter": _LETTER, "digit": _DIGIT, "line": _set(b"_"), "joiner": _JOINER, "identifier": _IDENTIFIER, "alpha": _ALPHA, "upper": _UPPER}
_BIT = {kind: 1 << i for i, kind in enumerate(_KINDS)}
_KIND = sum(flags.astype(np.uint8) << np.uint8(i) for i, flags in enumerate(_KINDS.values())).astype(np.uint8).tobytes()
_DOWN_BYTES = _DOWN.tobytes()


def _kinds(data: np.ndarray):
    """Flags of the bytes of any of the named kinds."""
    kind = np.frombuffer(data.tobytes().translate(_KIND), dtype=np.uint8)
    return lambda *names: (kind & np.uint8(sum(_BIT[n] for n in names))) != 0


def _shifted(flags: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the byte before and of the byte behind, none over the edge of a text."""
    before, behind = np.empty_like(flags), np.empty_like(flags)
    before[1:], behind[:-1] = flags[:-1], flags[1:]
    before[first], behind[last] = False, False
    return before, behind


def _lower(data: np.ndarray, *flags: np.ndarray) -> np.ndarray:
    """Bytes in lower case; the two signs among the letters lose their ``flags``."""
    low = np.frombuffer(bytearray(data.tobytes().translate(_DOWN_BYTES)), dtype=np.uint8)
    odd = np.flatnonzero(data[:-1] == 0xC3)
    if len(odd):
        behind = data[odd + 1]
        signs = odd[(behind == 0x97) | (behind == 0xB7)]
        low[odd + 1] += np.where((behind <= 0x9E) & (behind != 0x97), 0x20, 0).astype(np.uint8)
        for at in (signs, signs + 1):
            for flag in flags:
                flag[at] = False
    return low


class Hasher:
    def __init__(self) -> None:
        self.size = 0

    def _sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n >= self.size:
            self.size = max(n + 1, SLICE_BYTES + 1)
            self.up, self.down = _powers(_BASE, self.size), _powers(pow(_BASE, -1, 1 << 64), self.size)
        total = np.zeros(n + 1, dtype=np.uint64)
        value = _BYTE[data]
        value *= self.up[:n]
        np.cumsum(value, out=total[1:])
        return total

    def windows(self, data: np.ndarray, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each place on."""
        total = self._sums(data)
        return (total[width:] - total[:-width]) * self.down[: max(0, len(data) - width + 1)]

    def _hashes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = self._sums(low)
        value = (total[ends] - total[starts]) * self.down[starts]
        return _mix(value + (ends - starts).astype(np.uint64) * _MIX[0])

    def words(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every run of two or more letters, digits and underscores, in lower case; ``first`` as in :meth:`terms`."""
        word = _kinds(data)("letter", "digit", "line")
        low = _lower(data, word)
        before, behind = _shifted(word, first, np.append(first[1:], len(data)) - 1)
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~behind) + 1
        long = ends - starts > np.where(data[starts] == 0xC3, 2, 1)
        starts, ends = starts[long], ends[long]
        return starts, self._hashes(low, starts, ends)

    def terms(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every term of consecutive texts, duplicates kept, and their bytes in lower case.

        ``first``: where the texts begin, empty ones left out.
        """
        n = len(data)
        last = np.append(first[1:], n) - 1
        kinds = _kinds(data)
        letter, word = kinds("letter"), kinds("letter", "digit", "line")
        low = _lower(data, letter, word)
        joiner = np.flatnonzero(kinds("joiner"))
        if len(joiner):
            inside = joiner[(joiner > 0) & (joiner < n - 1)]
            edge = np.zeros(n + 1, dtype=bool)
            edge[first] = True
            inside = inside[~edge[inside] & ~edge[inside + 1]]
            a, b, digit = inside - 1, inside + 1, kinds("digit")
            word[inside] = (letter[a] & letter[b] & _BOTH[data[inside]]) | (digit[a] & digit[b])
        before, behind = _shifted(word, first, last)
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~behind) + 1
        line = kinds("line")
        if line.any():
            lines = np.concatenate(([0], np.cumsum(line)))
            real = lines[ends] - lines[starts] < ends - starts
            starts, ends = starts[real], ends[real]
        # Identifiers: of each run of their characters, what follows from the first letter on.
        run = kinds("identifier")
        before, behind = _shifted(run, first, last)
        begin, stop = np.flatnonzero(run & ~before), np.flatnonzero(run & ~behind) + 1
        alpha = kinds("alpha")
        late = np.flatnonzero(~alpha[begin])
        if len(late):
            letters = np.append(np.flatnonzero(alpha), n)
            begin[late] = letters[np.searchsorted(letters, begin[late])]
            begin, stop = begin[begin < stop], stop[begin < stop]
        # Their parts, cut at signs and humps.
        alnum = kinds("alpha", "digit")
        before, _ = _shifted(alnum, first, last)
        head = alnum & ~before
        upper = np.flatnonzero(kinds("upper"))
        if len(upper):
            was = upper[before[upper]]  # a letter or digit of the same text stands before
            follows = np.zeros(len(was), dtype=bool)
            room = was < n - 1
            follows[room] = _LOWER[data[was[room] + 1]]
            over = np.zeros(n + 1, dtype=bool)
            over[first] = True
            follows &= ~over[was + 1]
            head[was[~_UPPER[data[was - 1]] | follows]] = True
        head[begin] = True
        _, behind = _shifted(alnum & ~head, first, last)
        part, close = np.flatnonzero(head), np.flatnonzero(alnum & ~behind) + 1
        outside = np.flatnonzero(_DIGIT[data[part]])
        if len(outside):  # digits before the first letter belong to no identifier
            own = np.searchsorted(begin, part[outside], side="right") - 1
            within = np.zeros(len(outside), dtype=bool)
            within[own >= 0] = part[outside][own >= 0] < stop[own[own >= 0]]
            kept = np.ones(len(part), dtype=bool)
            kept[outside] = within
            part, close = part[kept], close[kept]
        starts, ends = np.concatenate((starts, begin, part)), np.concatenate((ends, stop, close))
        return starts, ends, self._hashes(low, starts, ends), low


def term_hashes(terms: pa.Array, mask: np.uint64 = HASH_MASK) -> np.ndarray:
    """Hashes of whole terms, each as one."""
    hasher, out = Hasher(), np.zeros(len(terms), dtype=np.uint64)
    for i, j, text, first in slices(terms):
        out[i:j] = hasher._hashes(text, first[:-1], first[1:])
    return out & mask


def _rows(first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row of each of the ``starts``, which are a few ascending pieces; ``first``: where each row begins, and where the last ends."""
    cuts = np.concatenate(([0], np.flatnonzero(starts[1:] < starts[:-1]) + 1, [len(starts)]))
    rows = np.arange(len(first) - 1)
    return np.concatenate([np.repeat(rows, np.diff(np.searchsorted(starts[a:b], first))) for a, b in zip(cuts[:-1], cuts[1:])])


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges [i, j) of a column of texts with their bytes and where each row begins in them (and the last ends)."""
    raw = column.cast(pa.binary())
    size = len(raw)
    bounds = np.frombuffer(raw.buffers()[1] or bytes(4), dtype=np.int32)[raw.offset : raw.offset + size + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < size:
        j = min(max(int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, side="right")) - 1, i + 1), size, i + SLICE_ROWS)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def term_postings(column: pa.Array, hasher: Hasher) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a column of plain texts, where the postings of each begin, and row and count of every posting."""
    rows, counts, hashes, begins, sizes, texts, done = [], [], [], [], [], [], 0
    for i, _, text, first in slices(column):
        if not len(text):
            continue
        starts, ends, value, low = hasher.terms(text, np.unique(first[first < len(text)]))
        row = _rows(first, starts)
        key = (row.astype(np.uint64) << _ROW) | (value & HASH_MASK)
        order = np.argsort(key)
        key = key[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        one = order[heads]  # any of its occurrences stands for a term
        rows.append(row[one] + i)
        counts.append(np.diff(np.append(heads, len(key))))
        hashes.append(value[one])
        begins.append(starts[one] + done)
        sizes.append(ends[one] - starts[one])
        texts.append(low)
        done += len(low)
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return pa.array([], pa.string()), none, none, none
    rows, counts, hashes, begins, sizes, texts = map(np.concatenate, (rows, counts, hashes, begins, sizes, texts))
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, dtype=np.int64)
    begins, sizes = begins[order[heads]], sizes[order[heads]]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    letters = texts[np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])]
    terms = pa.StringArray.from_buffers(len(heads), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters))
    return terms, heads, rows[order], counts[order]


def word_counts(column: pa.Array, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct words of each row of plain texts, by row and then by hash."""
    rows, hashes, counts = ([np.zeros(0, dtype=t)] for t in (np.int64, np.uint64, np.int64))
    for i, _, text, first in slices(column):
        if not len(text):
            continue
        starts, value = hasher.words(text, np.unique(first[first < len(text)]))
        row = _rows(first, starts)
        key = (row.astype(np.uint64) << _ROW) | (value & HASH_MASK)
        order = np.argsort(key)
        key = key[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        rows.append(row[order[heads]] + i)
        hashes.append(value[order[heads]])
        counts.append(np.diff(np.append(heads, len(key))))
    return tuple(map(np.concatenate, (rows, hashes, counts)))


def counted_terms(column: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges [i, j) of a column of plain texts with the row (from i), hash and count of their distinct terms, and all terms of each row."""
    for i, j, text, first in slices(column):
        if len(text):
            starts, _, value, _ = hasher.terms(text, np.unique(first[first < len(text)]))
            row = _rows(first, starts)
            key = np.sort((row.astype(np.uint64) << _ROW) | (value & HASH_MASK))
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
            counts = np.diff(np.append(heads, len(key)))
            yield i, j, (key[heads] >> _ROW).astype(np.int64), key[heads] & HASH_MASK, counts, np.bincount(row, minlength=j - i)
        else:
            none = np.zeros(0, dtype=np.int64)
            yield i, j, none, none.astype(np.uint64), none, np.zeros(j - i, dtype=np.int64)
