"""Packing along a space-filling curve.

A document's words, hashed, form a count vector that a random sign matrix (the signs are bits of the
word hashes) projects to DIMENSIONS coordinates; their place on a Hilbert curve is the document's key. Documents are
range-partitioned by key, sorted, and laid end to end, so neighbours on the curve share sequences of
``length`` tokens, cut freely. A bucket's last tokens fill sequences of powers of two, the very last of
which alone is padded (to a power of two), so padding stays below SMALLEST tokens a bucket.

Keys of equal texts are spread by bits of a row hash, so copies can be cut into several buckets. Ids come from
a tokenizer file whose tokens never cross white space: each worker encodes a word once while its cache holds it
(CACHE_WORDS, found by 64-bit hash). Null text: empty, one closing id. Repeated rows are documents of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import row_slices, text_buffer, word_arrays

LENGTH = 2048
END_ID = 1
DIMENSIONS, BITS = 4, 11
ROW_BITS = 63 - DIMENSIONS * BITS
BUCKET_BYTES = 8 << 20
SMALLEST = 64
BOUND_ROWS = 300  # sampled rows per bucket that set the bounds of buckets
CACHE_WORDS = 1_500_000
SLICE = 2 << 20
BETWEEN = "\x01"
# Words of these letters (A-Z, precomposed letters of Latin-1) with these marks behind split in a known way.
LETTERS = "".join(chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA))
MARKS = "!#$%&()*+,-./:;=?@"
LETTERED = re.compile(f"([{LETTERS}]+)([{re.escape(MARKS)}]*)").fullmatch


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows, dimensions) with ``bits`` bits each."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):  # undo rotations and reflections of each level
        q = one << np.uint64(level)
        low = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(high, low, swap)
            x[i] ^= np.where(high, np.uint64(0), swap)
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> np.uint64(level)) & one != 0, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key


def curve_keys(hashes: np.ndarray, first: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys (63 bits) of texts from their word hashes and a row hash."""
    n = np.diff(first)
    points = np.zeros((len(n), DIMENSIONS), dtype=np.int64)
    for d in range(DIMENSIONS):
        sign = ((hashes >> np.uint64(8 + d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        total = np.concatenate(([0], np.cumsum(sign)))
        mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        # Means of natural texts lie near zero; the square root spreads them over the grid.
        place = 0.5 + 0.5 * np.sign(mean) * np.sqrt(np.abs(mean))
        points[:, d] = np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    key = hilbert_key(points, BITS)
    return ((key << np.uint64(ROW_BITS)) | (salt.astype(np.uint64) & np.uint64((1 << ROW_BITS) - 1))).astype(np.int64)


class WordCache:
    """Ids of words, encoded once. Lives as long as its worker; emptied when it holds CACHE_WORDS words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.images = self._letter_images()
        self.clear()

    def _letter_images(self) -> dict[int, str] | None:
        """What normalising and splitting make of each character of LETTERS and MARKS, where a word of letters with
        marks behind is the images of the letters in one piece and those of the marks in another; None if random words
        show that this tokenizer treats them otherwise."""
        split, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        images = {}
        for c in LETTERS + MARKS:
            plain = normal.normalize_str(c) if normal else c
            pieces = split.pre_tokenize_str(plain) if split else [(plain, None)]
            if len(pieces) != 1:
                return None
            images[ord(c)] = pieces[0][0]
        draw = np.random.default_rng(0)
        for n, m in zip(draw.integers(1, 24, 300), draw.integers(0, 4, 300)):
            stem, tail = ("".join(part[i] for i in draw.integers(0, len(part), k)) for part, k in ((LETTERS, n), (MARKS, m)))
            image = self._piece(stem.translate(images)) + (self._piece(tail.translate(images)) if tail else [])
            if image != self.tokenizer.encode(stem + tail, add_special_tokens=False).ids:
                return None
        return images

    def _piece(self, image: str) -> list[int]:
        return [token.id for token in self.tokenizer.model.tokenize(image)]

    def _lettered(self, words: list[tuple[str, str]]) -> list[list[int]]:
        """Ids of words given as letters and the marks behind them."""
        parts = dict.fromkeys(part for word in words for part in word)
        images = " ".join(parts).translate(self.images).split(" ")
        ids = {part: self._piece(image) if image else [] for part, image in zip(parts, images)}
        return [ids[stem] + ids[tail] for stem, tail in words]

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.bounds = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def _add(self, hashes: list[int], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.place), len(flat)
        while self.used + m > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(sizes) + 1 > len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        self.flat[self.used : self.used + m] = flat
        self.bounds[n + 1 : n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += m
        self.place.update(zip(hashes, range(n, n + len(sizes))))

    def _ids(self, text: bytes) -> np.ndarray:
        # The fast form leaves out character offsets, which are not needed here.
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        """Encodes new words: those of letters and marks by the model alone, other plain ones in shared calls with a
        separator between them, the rest one by one."""
        if self.images is not None:
            matches = [LETTERED(w.decode("utf-8", "replace")) for w in words]
            own = [i for i, found in enumerate(matches) if found]
            if own:
                ids = self._lettered([matches[i].groups() for i in own])
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32)
                self._add([hashes[i] for i in own], flat, np.fromiter(map(len, ids), dtype=np.int64))
                hashes = [h for h, found in zip(hashes, matches) if not found]
                words = [w for w, found in zip(words, matches) if not found]
        plain = len(self.between) == 1
        odd = [i for i, w in enumerate(words) if not plain or b"\x01" in w or b"<|" in w]
        for i in odd:
            ids = self._ids(words[i])
            self._add([hashes[i]], ids, np.array([len(ids)]))
        if odd:
            skip = set(odd)
            hashes = [h for i, h in enumerate(hashes) if i not in skip]
            words = [w for i, w in enumerate(words) if i not in skip]
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = self._ids(b" \x01 ".join(part))
            cut = np.flatnonzero(ids == self.between[0])
            sizes = np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
            self._add(hashes[i : i + 2000], ids[ids != self.between[0]], sizes)

    def encode(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, index of each word's first id and the total)."""
        known, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        listed = known.tolist()
        if len(self.place) + len(listed) > CACHE_WORDS:
            self.clear()
        new = [i for i, h in enumerate(listed) if h not in self.place]
        if new:
            raw, begin, end = data.tobytes(), starts[where].tolist(), ends[where].tolist()
            self._learn([listed[i] for i in new], [raw[begin[i] : end[i]] for i in new])
        at = np.fromiter(map(self.place.__getitem__, listed), dtype=np.int64, count=len(listed))[back]
        begin, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        total = np.concatenate(([0], np.cumsum(size)))
        index = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return self.flat[index], total


_caches: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def _tail_lengths(left: int, length: int) -> list[int]:
    """Powers of two that cut the last ``left`` tokens: exact down to SMALLEST, then one that holds the rest."""
    out, size = [], length
    while left:
        if left >= size:
            out.append(size)
            left -= size
        elif size > SMALLEST:
            size //= 2
        else:
            out.append(1 << (left - 1).bit_length())
            left = 0
    return out


class _Layout:
    """Pieces of one bucket; holds the ids of its unfinished sequence only."""

    def __init__(self, bucket: int, length: int) -> None:
        self.length, self.number, self.open, self.filled = length, bucket << 40, [], 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            take = min(len(ids) - start, self.length - self.filled)
            self.open.append((doc, start, ids[start : start + take], len(ids)))
            self.filled += take
            start += take
            if self.filled == self.length:
                yield from self._close([self.length])

    def _close(self, sizes: list[int]) -> Iterator[tuple]:
        offset, sizes = 0, list(sizes)
        for doc, start, ids, total in self.open:
            while len(ids):
                take = min(len(ids), sizes[0] - offset)
                yield doc, start, take, ids[:take].astype("<u4").tobytes(), total, self.number, offset, sizes[0]
                ids, start, offset = ids[take:], start + take, offset + take
                if offset == sizes[0]:
                    self.number, offset = self.number + 1, 0
                    sizes.pop(0)
        if offset:
            self.number += 1
        self.open, self.filled = [], 0

    def end(self) -> Iterator[tuple]:
        if self.filled:
            yield from self._close(_tail_lengths(self.filled, self.length))


_KINDS = (None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length")


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, padded_length (of its sequence). ``docs``: doc_id, text; ``tokenizer``: path of a file that
    every worker can read.

    Keys of about BOUND_ROWS documents per bucket set the bucket bounds; then every text is read once and
    moved once, as ids.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("salt"))

    def keys_of(data, offsets, salt):
        hashes, starts, ends, first = word_arrays(data, offsets)
        return hashes, starts, ends, first, curve_keys(hashes, first, salt)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            salt = batch.column("salt").to_numpy()
            for i, j in row_slices(offsets, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(data, offsets[i : j + 1], salt[i:j])[-1])], names=["key"])

    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    buckets = int(max(1, (size["b"] or 0) // bucket_bytes))
    bounds = []
    if buckets > 1:
        # Only where buckets end comes from a sample, as in a range partitioner; every row is packed.
        one_in = max(1, size["n"] // (BOUND_ROWS * buckets))
        some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
        steps = [i / buckets for i in range(1, buckets)]
        found = some.mapInArrow(keys, "key long").agg(F.percentile_approx("key", steps, max(10_000, 20 * buckets)).alias("q"))
        bounds = sorted(set(found.first()["q"] or []))
    shared_bounds = spark.sparkContext.broadcast(bounds)
    kind = dict(docs.dtypes)["doc_id"]

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, cache, closing = np.array(shared_bounds.value, dtype=np.int64), _cache(tokenizer), np.array([end_id], dtype=np.uint32)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            salt = batch.column("salt").to_numpy()
            for i, j in row_slices(offsets, SLICE):
                hashes, starts, ends, first, key = keys_of(data, offsets[i : j + 1], salt[i:j])
                flat, total = cache.encode(data[offsets[i] : offsets[j]], hashes, starts, ends)
                wide = int(max(flat.max(initial=0), end_id)) >= 1 << 16
                each = np.split(flat, total[first[1:-1]]) if j > i + 1 else [flat]
                packed = [np.append(x, closing).astype("<u4" if wide else "<u2").tobytes() for x in each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(cuts, key, side="left").astype(np.int32)), pa.array(key), batch.column("doc_id")[i:j],
                     pa.array(salt[i:j]), pa.array(np.full(j - i, wide)), pa.array(packed, pa.binary())],
                    names=["bucket", "key", "doc_id", "salt", "wide", "ids"],
                )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, current = None, None
        for batch in batches:
            out = []
            for bucket, doc, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "wide", "ids"))):
                if bucket != current:
                    if layout is not None:
                        out.extend(layout.end())
                    layout, current = _Layout(bucket, length), bucket
                out.extend(layout.add(doc, np.frombuffer(raw, dtype="<u4" if wide else "<u2")))
            if out:
                yield _pieces(out, batch.schema.field("doc_id").type)
        if layout is not None and (out := list(layout.end())):
            yield _pieces(out, batch.schema.field("doc_id").type)

    dealt = rows.mapInArrow(ids, f"bucket int, key long, doc_id {kind}, salt long, wide boolean, ids binary")
    spread = dealt.repartitionById(len(bounds) + 1, "bucket")
    return spread.sortWithinPartitions("bucket", "key", "doc_id", "salt").mapInArrow(
        lay,
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long",
    )


def _pieces(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(zip(*rows), _KINDS)], names=list(_NAMES))
