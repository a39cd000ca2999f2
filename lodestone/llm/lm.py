"""Bigram language model in a log-frequency Bloom filter.

Training counts every word and word pair of the corpus. A pair's count is quantised to a level (powers of
LEVEL_BASE), and the pair is entered once for each level up to its own. Scoring probes level after level
until one is missing; the last one found gives back the count. Probability of w after h:

    (count(h w) + kappa p(w)) / (count(h) + kappa),    p(w) = (count(w) + 1) / (N + V + 1)

kappa is set so that the mass for unseen pairs equals the share of pairs seen once. Word counts are exact.

The filter is cut into slices by pair hash, the vocabulary into blocks by word hash; both grow with the corpus and are
broadcast in parts of at most PART_BYTES. Parts that do not fit into one broadcast are taken in rounds, one after another: a
round scores the tokens whose pair, word and history lie in its parts, stores its sums and gives its broadcasts back, so the
driver holds the parts of one round only. A document's score is the sum over rounds; there are filter parts x vocabulary
blocks^2 of them, each a scan of the texts.

Texts are lower-cased (A-Z); tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end. Null text: empty, one token.
A null doc_id is training text. Without training text every token has probability 1 / (0 + 0 + 1). Repeated rows are
trained on and scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import as_long, mix, row_slices, text_buffer, word_arrays
from .shared import shared_table

LEVEL_BASE = 1.6
BITS_PER_ENTRY = 12
PROBES = 5
PART_BYTES = 256 << 20
SLICE_PAIRS = 1_500_000
FLUSH = 3_000_000
FETCH_BYTES = 16 << 20  # of a part, sent to the driver at once
SLICE = 1 << 20
END = np.uint64(0x9D39247E33776D41)
_STEP = 0x9E3779B97F4A7C15


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def token_arrays(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their histories (the end mark before a first word) and each text's first token."""
    words, _, _, first = word_arrays(data, offsets, lower=True)
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    tokens = np.full(len(words) + n, END, dtype=np.uint64)
    tokens[np.arange(len(words)) + text] = words
    starts = first[:-1] + np.arange(n)
    history = np.empty_like(tokens)
    history[1:] = tokens[:-1]
    history[starts] = END
    return tokens, history, starts


def pair_hash(history: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(history * np.uint64(0xD1342543DE82EF95) + tokens)


def count_level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def level_count(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for level 0."""
    low = np.ceil(LEVEL_BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(np.ceil(LEVEL_BASE ** (levels * 1.0) - 1e-9) - 1, low)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _probe(pairs: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(pairs + np.uint64(level * _STEP % (1 << 64)))
    return a, mix(a) | np.uint64(1)


def build_filter(pairs: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(bits, bytes) of the filter of distinct pairs with their counts."""
    levels = count_level(counts)
    m = max(64, int(levels.sum()) * BITS_PER_ENTRY)
    bits = np.zeros(m, dtype=bool)
    level = 1
    while len(pairs):
        a, b = _probe(pairs, level)
        for _ in range(PROBES):
            bits[(a % np.uint64(m)).astype(np.int64)] = True
            a = a + b
        level += 1
        keep = levels >= level
        pairs, levels = pairs[keep], levels[keep]
    return m, np.packbits(bits, bitorder="little").tobytes()


class Filters:
    """Slices ``low`` to ``high`` of a log-frequency Bloom filter, one after another in ``data``.

    A slice without an entry has no pairs.
    """

    def __init__(self, slices: int, low: int, high: int, offset: np.ndarray, bits: np.ndarray, data: np.ndarray) -> None:
        self.slices, self.low, self.high, self.offset, self.bits, self.data = slices, low, high, offset, bits, data

    def holds(self, pairs: np.ndarray) -> np.ndarray:
        own = (pairs % np.uint64(self.slices)).astype(np.int64)
        return (own >= self.low) & (own < self.high)

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), dtype=np.int64)
        own = (pairs % np.uint64(self.slices)).astype(np.int64)
        alive = np.flatnonzero(self.offset[own] >= 0)
        level = 1
        while len(alive):
            a, b = _probe(pairs[alive], level)
            base, m = self.offset[own[alive]], self.bits[own[alive]]
            for _ in range(PROBES):
                bit = (a % m).astype(np.int64)
                hit = (self.data[base + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
                alive, a, b, base, m = alive[hit], a[hit] + b[hit], b[hit], base[hit], m[hit]
                if not len(alive):
                    break
            out[alive] = level
            level += 1
        return out


class Vocabulary:
    """Exact counts of the words of one block, sorted by word."""

    def __init__(self, blocks: int, block: int, words: np.ndarray, counts: np.ndarray) -> None:
        self.blocks, self.block, self.words, self.counts = blocks, block, words, counts

    def holds(self, words: np.ndarray) -> np.ndarray:
        return words % np.uint64(self.blocks) == np.uint64(self.block)

    def count(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), dtype=np.int64)
        known, back = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, known), len(self.words) - 1)
        return np.where(self.words[at] == known, self.counts[at], 0)[back]


def _summed(values: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, w = np.concatenate(values), np.concatenate(weights)
    order = np.argsort(v)
    v, w = v[order], w[order]
    head = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    return v[head], np.add.reduceat(w, head) if len(head) else w


def _word_counts(texts: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, weights, held = [], [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_slices(offsets, SLICE):
                v, w = np.unique(token_arrays(data, offsets[i : j + 1])[0], return_counts=True)
                values.append(v)
                weights.append(w)
                held += len(v)
            if held > FLUSH:
                v, w = _summed(values, weights)
                values, weights, held = [v], [w], len(v)
                if held > FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(v)), pa.array(w)], names=["word", "c"])
                    values, weights, held = [], [], 0
        if values:
            v, w = _summed(values, weights)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(v)), pa.array(w)], names=["word", "c"])

    return texts.mapInArrow(emit, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _pair_packs(texts: DataFrame, slices: int) -> DataFrame:
    """Distinct pairs of part of a task, packed by filter slice."""

    def packs(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, counts = np.unique(np.concatenate(held), return_counts=True)
        own = (pairs % np.uint64(slices)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        pairs, counts, own = pairs[order], counts[order].astype("<u4"), own[order]
        used, head = np.unique(own, return_index=True)
        ends = np.append(head[1:], len(own))
        return pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([pairs[a:b].tobytes() for a, b in zip(head, ends)], pa.binary()),
             pa.array([counts[a:b].tobytes() for a, b in zip(head, ends)], pa.binary())],
            names=["slice", "pairs", "counts"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_slices(offsets, SLICE):
                tokens, history, _ = token_arrays(data, offsets[i : j + 1])
                held.append(pair_hash(history, tokens))
                n += len(tokens)
                if n > FLUSH:
                    yield packs(held)
                    held, n = [], 0
        if held:
            yield packs(held)

    return texts.mapInArrow(emit, "slice int, pairs binary, counts binary")


def _slice_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values: dict[int, list] = {}
    weights: dict[int, list] = {}
    for batch in batches:
        for s, p, c in zip(*(batch.column(n).to_pylist() for n in ("slice", "pairs", "counts"))):
            values.setdefault(s, []).append(np.frombuffer(p, dtype=np.uint64))
            weights.setdefault(s, []).append(np.frombuffer(c, dtype="<u4").astype(np.int64))
    for s in values:
        pairs, counts = _summed(values[s], weights[s])
        m, raw = build_filter(pairs, counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([s], pa.int32()), pa.array([m], pa.int64()), pa.array([raw], pa.binary()), pa.array([int((counts == 1).sum())], pa.int64())],
            names=["slice", "m", "bits", "once"],
        )


class BigramModel:
    """Trained model: stored tables of words and filter slices, and its totals."""

    def __init__(self, words: DataFrame, filters: DataFrame, slices: int, part_bytes: int = PART_BYTES) -> None:
        self.words, self.filters, self.slices, self.part_bytes = words, filters, slices, part_bytes
        row = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.types = row["n"], row["v"]
        self.kappa = self._kappa()

    def _kappa(self) -> float:
        """Prior weight whose unseen mass, summed over histories, equals the pairs seen once."""
        once = self.filters.agg(F.coalesce(F.sum("once"), F.lit(0)).alias("n")).first()["n"]
        if not once or not self.tokens:
            return 1.0
        grid = [2.0 ** (i / 2) for i in range(-8, 61)]
        sums = self.words.agg(*[F.sum(F.col("c") * k / (F.col("c") + k)).alias(f"k{i}") for i, k in enumerate(grid)]).first()
        return min(zip(grid, sums), key=lambda x: abs(x[1] - once))[0]

    def _filter_parts(self) -> list[list[tuple[int, int]]]:
        """(slice, bytes) of the slices of each broadcast; together they cover all that have entries."""
        parts, size = [[]], 0
        for r in self.filters.select("slice", F.octet_length("bits").alias("b")).orderBy("slice").collect():
            if parts[-1] and size + r["b"] > self.part_bytes:
                parts.append([])
                size = 0
            parts[-1].append((r["slice"], r["b"]))
            size += r["b"]
        return parts

    def _filters(self, part: list[tuple[int, int]], low: int, high: int) -> Filters:
        """Slices of one part, fetched a few at a time into one array."""
        offset, bits = np.full(self.slices, -1, dtype=np.int64), np.ones(self.slices, dtype=np.uint64)
        data = np.empty(sum(b for _, b in part), dtype=np.uint8)
        at = i = 0
        while i < len(part):
            j, size = i + 1, part[i][1]
            while j < len(part) and size + part[j][1] <= FETCH_BYTES:
                size += part[j][1]
                j += 1
            table = self.filters.where(F.col("slice").between(part[i][0], part[j - 1][0])).select("slice", "m", "bits").toArrow()
            for chunk in table.to_batches():
                raw, ends = text_buffer(chunk.column("bits"))
                for k, (number, m) in enumerate(zip(chunk.column("slice").to_pylist(), chunk.column("m").to_pylist())):
                    own = raw[ends[k] : ends[k + 1]]
                    offset[number], bits[number] = at, m
                    data[at : at + len(own)] = own
                    at += len(own)
            i = j
        return Filters(self.slices, low, high, offset, bits, data)

    def _vocabulary(self, blocks: int, block: int) -> Vocabulary:
        """Words of one block in ranges of the hash, so that each fetch is small and the whole is sorted."""
        ranges = max(1, -(-16 * self.types // (blocks * FETCH_BYTES)))
        part = self.words.where(F.pmod(F.conv(F.hex("word"), 16, 10).cast("decimal(20,0)"), F.lit(blocks)) == block) if blocks > 1 else self.words
        low = -(1 << 63)
        place = F.col("word").bitwiseXOR(F.lit(low))  # signed order of this is the unsigned order of the word
        words, counts = [], []
        for k in range(ranges):
            a, b = low + ((1 << 64) * k) // ranges, low + ((1 << 64) * (k + 1)) // ranges - 1
            table = part.where(place.between(F.lit(a), F.lit(b))).toArrow()
            own = table.column("word").to_numpy().view(np.uint64)
            order = np.argsort(own)
            words.append(own[order])
            counts.append(table.column("c").to_numpy()[order])
        return Vocabulary(blocks, block, np.concatenate(words), np.concatenate(counts))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score (log10) of every row of ``docs`` (doc_id, text)."""
        context = docs.sparkSession.sparkContext
        rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("again"))
        blocks = max(1, -(-16 * self.types // self.part_bytes))
        parts = self._filter_parts()
        kind = dict(docs.dtypes)["doc_id"]
        schema = f"doc_id {kind}, row long, again long, rows long, n_tokens long, n_known long, base_score double, score double"
        totals = (self.tokens, self.types, self.kappa)
        columns = ("n_tokens", "n_known", "base_score", "score")
        if len(parts) == 1 and blocks == 1:
            filters, words = context.broadcast(self._filters(parts[0], 0, self.slices)), context.broadcast(self._vocabulary(1, 0))
            return rows.mapInArrow(_scorer(filters, words, words, True, True, *totals), schema).select("doc_id", *columns)
        out = None
        edges = [0, *(p[0][0] for p in parts[1:]), self.slices]
        for number, part in enumerate(parts):
            filters = context.broadcast(self._filters(part, edges[number], edges[number + 1]))
            for i in range(blocks):
                own = context.broadcast(self._vocabulary(blocks, i))
                for j in range(blocks):
                    other = own if i == j else context.broadcast(self._vocabulary(blocks, j))
                    once = number == 0 and j == 0
                    done = shared_table(rows.mapInArrow(_scorer(filters, own, other, once and i == 0, once, *totals), schema), f"round-{number}-{i}-{j}")
                    out = done if out is None else out.unionByName(done)
                    if other is not own:
                        other.destroy()
                own.destroy()
            filters.destroy()
        # Repeated rows are summed together and taken apart again; a row is known by its id and two hashes.
        summed = out.groupBy("doc_id", "row", "again").agg(*[F.sum(c).alias(c) for c in ("rows", *columns)])
        each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        whole = [(F.col(c) / F.col("rows")).cast("long").alias(c) for c in columns[:2]]
        return each.select("doc_id", *whole, *[(F.col(c) / F.col("rows")).alias(c) for c in columns[2:]])


def _scorer(filters, own, other, first: bool, base: bool, n: int, v: int, kappa: float):
    """Scores of one round: ``own`` has the words, ``other`` the histories, ``filters`` the pairs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, words, histories = filters.value, own.value, other.value
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_slices(offsets, SLICE):
                tokens, history, starts = token_arrays(data, offsets[i : j + 1])
                mine = words.holds(tokens)
                c = np.where(mine, words.count(tokens), 0)
                p = (c + 1) / (n + v + 1)
                pair = pair_hash(history, tokens)
                use = mine & histories.holds(history) & bloom.holds(pair)
                seen = level_count(bloom.levels(pair[use]))
                total = histories.count(history[use])
                smooth = np.zeros(len(tokens))
                # A false level can only raise a count, so it is held to what its history allows.
                smooth[use] = np.log10((np.minimum(seen, np.minimum(total, c[use])) + kappa * p[use]) / (total + kappa))
                sums = lambda x: np.add.reduceat(x, starts)
                sizes = np.diff(np.append(starts, len(tokens)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], batch.column("row")[i:j], batch.column("again")[i:j], pa.array(np.full(j - i, int(first))),
                     pa.array(sizes * int(first)), pa.array(sums(((c > 0) & base).astype(np.int64))),
                     pa.array(sums(np.where(mine & base, np.log10(p), 0.0))), pa.array(sums(smooth))],
                    names=["doc_id", "row", "again", "rows", "n_tokens", "n_known", "base_score", "score"],
                )

    return emit


def train(texts: DataFrame, part_bytes: int = PART_BYTES, slice_pairs: int = SLICE_PAIRS) -> BigramModel:
    """Model of ``texts`` (text). Pairs are counted in numbered slices of about ``slice_pairs`` occurrences."""
    texts = texts.select("text")
    words = shared_table(_word_counts(texts), "words")
    tokens = words.agg(F.sum("c").alias("n")).first()["n"] or 0
    slices = int(max(1, -(-tokens // slice_pairs)))
    filters = _pair_packs(texts, slices).repartitionById(slices, "slice").mapInArrow(_slice_filters, "slice int, m long, bits binary, once long")
    return BigramModel(words, shared_table(filters, "filters"), slices, part_bytes)


def score_corpus(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Trains on the documents that are not held out and scores all of them."""
    model = train(docs.where(~held_out(F.col("doc_id"))), part_bytes)
    scored = model.score(docs)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
