"""The best chunks of many queries, exactly, without adding up most (query, chunk) pairs one posting at a time.

Chunks are dealt into blocks of like length and stored again. A block holds the contribution of each posting also as a 16-bit level, rounded up. A few
neighbouring chunks are a group; the highest levels of a frequent id are a row over all groups of the block, added as a whole, those of other ids are
scattered, one a group. A sum over a group is at least the score of each of its chunks, so only chunks of groups whose sum reaches the query's floor are looked at, and
scored in full precision if their own levels of the most frequent ids still let them reach it. The floor is what the query's n-th best of the longest
chunks scores at least: a first pass finds it, and any chunks would do. No chunk, posting or query is left out of a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_ROW_LIMIT, small_side, stored

# Postings and chunks of a block; blocks are smaller where there would be fewer than three a core.
HITS, LEAST_HITS, CHUNKS = 5_000_000, 500_000, 65_000
# Chunks of a group (1, 2 or a multiple of 4), by the most postings a chunk of the block has on average.
GROUPS = ((80, 8), (500, 4), (1_000, 2))
# An id has a row if one group of so many holds it, and a row by chunk if one chunk of so many does, as far as the bytes go.
SHARE, OWN_SHARE, ROW_BYTES = 32, 32, 64 << 20
# Sums and scattered postings at a time.
CELLS, SCATTERED, PAIRS, TOGETHER = 1 << 20, 2_000_000, 10_000, 6_000
LEVELS, PACKED = 65_000, 4
FIRST_SHARE, FIRST_CHUNKS = 64, 16_384


def dealt(held: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``held`` stored by blocks of like length (column ``part``), and the first block of the longest chunks, which a first pass reads."""
    spark = held.sparkSession
    length = F.coalesce("body_len", F.lit(0))
    sizes = held.groupBy(length.alias("length")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("postings")).alias("bytes")
    ).toArrow().sort_by("length")
    lengths, chunks = sizes["length"].to_numpy(), sizes["chunks"].to_numpy()
    hits = sizes["bytes"].to_numpy() // 8
    most = min(HITS, max(LEAST_HITS, int(hits.sum()) // (3 * spark.sparkContext.defaultParallelism)))
    base, parts, number, rows, size = [], [], 0, 0, 0
    for c, h in zip(chunks.tolist(), hits.tolist()):
        pieces = max(1, -(-h // most), -(-c // CHUNKS))
        if rows and (rows + c > CHUNKS or size + h > most):
            number, rows, size = number + 1, 0, 0
        base.append(number)
        parts.append(pieces)
        rows, size = rows + c, size + h
        if pieces > 1:  # chunks of one length that fill several blocks
            number, rows, size = number + pieces, 0, 0
    count = max([1, *(b + p for b, p in zip(base, parts))])
    behind = np.cumsum(chunks[::-1])[::-1]
    wanted = min(max(20 * n, int(chunks.sum()) // FIRST_SHARE), FIRST_CHUNKS)
    first = base[max(0, int(np.searchsorted(-behind, -wanted, side="right")) - 1)] if len(base) else 0
    known = spark.createDataFrame(pa.table({
        "length": pa.array(lengths, pa.int32()), "base": pa.array(base, pa.int32()), "parts": pa.array(parts, pa.int32())
    }))
    part = (F.col("base") + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).cast("int")
    placed = held.withColumn("length", length).join(small_side(known, len(base) <= BROADCAST_ROW_LIMIT), "length").withColumn("part", part)
    return stored(placed.select(*held.columns, "part").repartitionById(count, "part"), "matched-by-length"), first


def usable(value: np.ndarray, starts: np.ndarray) -> bool:
    """Levels need contributions above 0 and not too many terms a query."""
    return bool((value > 0).all()) and int(np.diff(starts).max(initial=0)) < LEVELS // 2


class Block:
    """Postings (chunk, id, contribution) of a block of ``chunks`` chunks for the queries of ``starts`` and ``terms``; see :func:`usable`."""

    def __init__(self, chunks: int, row: np.ndarray, ids: np.ndarray, value: np.ndarray, size: int, starts: np.ndarray, terms: np.ndarray):
        self.chunks, self.size = chunks, size
        order = np.argsort(ids * np.int64(chunks) + row)
        self.docs, self.value = row[order].astype(np.int32), value[order]
        del order
        self.df = np.bincount(ids, minlength=size)
        self.begin = np.cumsum(self.df) - self.df
        some = np.flatnonzero(self.df)
        bound = np.zeros(size)
        bound[some] = np.maximum.reduceat(self.value, self.begin[some]) if len(some) else 0
        query = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        held = np.flatnonzero(bound[terms] > 0)
        self.query, self.terms = query[held], terms[held]
        self.counts = np.bincount(self.query, minlength=len(starts) - 1)
        self.most = np.bincount(self.query, bound[self.terms], len(starts) - 1)
        self.step = max(float(self.most.max(initial=0)), 1e-300) / (LEVELS - int(self.counts.max(initial=0)))
        used = np.zeros(size, dtype=bool)
        used[self.terms] = True
        self.level = np.empty(len(self.value), dtype=np.uint16)
        for i in range(0, len(self.value), 1 << 20):  # contributions of ids that no query has may be beyond the levels
            self.level[i : i + (1 << 20)] = np.clip(np.ceil(self.value[i : i + (1 << 20)] / self.step), 1, LEVELS)
        self.used = some[used[some]]
        self.own_slot, self.own = self._rows(self.used[self.df[self.used] * OWN_SHARE >= chunks], (self.docs, self.level, self.begin, self.df), -(-chunks // PACKED) * PACKED)

    def _grouped(self, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups of each id once, their highest levels, and where those of an id begin and how many they are."""
        if group == 1 or not len(self.docs):
            return self.docs, self.level, self.begin, self.df
        groups = self.docs // group
        head = np.concatenate(([True], groups[1:] != groups[:-1]))
        head[self.begin[self.df > 0]] = True
        head = np.flatnonzero(head)
        begin = np.searchsorted(head, self.begin)
        return groups[head], np.maximum.reduceat(self.level, head), begin, np.searchsorted(head, self.begin + self.df) - begin

    def _rows(self, ids: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Row of each id (-1: none), and the levels of every chunk or group in these rows; the most frequent ids if not all have room."""
        places, level, begin, df = postings
        ids = ids[np.argsort(-df[ids], kind="stable")][: ROW_BYTES // (2 * max(1, width))]
        slot = np.full(self.size, -1, dtype=np.int32)
        slot[ids] = np.arange(len(ids))
        table = np.zeros((len(ids), width), dtype=np.uint16)
        for line, a, z in zip(table, begin[ids].tolist(), (begin[ids] + df[ids]).tolist()):
            line[places[a:z]] = level[a:z]
        return slot, table

    def sums(self, floor: np.ndarray | None, group: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Queries that can reach their ``floor`` (in levels; None: all with a term here), where their terms begin, these, and levels by query and group."""
        open_ = self.counts > 0 if floor is None else (self.counts > 0) & (self.most / self.step + self.counts >= floor)
        queries = np.flatnonzero(open_)
        kept = open_[self.query]
        terms = self.terms[kept]
        begin = np.concatenate(([0], np.cumsum(self.counts[queries])))
        width = -(-self.chunks // group)
        places, level, first, df = postings = self._grouped(group)
        self.slot, self.table = self._rows(self.used[df[self.used] * SHARE >= width], postings, width)
        rows = list(self.table)
        slot, own = self.slot[terms], np.repeat(np.arange(len(queries), dtype=np.int32), self.counts[queries])
        scattered = np.concatenate(([0], np.cumsum(np.where(slot < 0, df[terms], 0))))[begin]
        a, wide = 0, max(1, CELLS // max(1, width))
        while a < len(queries):
            z = max(a + 1, min(a + wide, int(np.searchsorted(scattered, scattered[a] + SCATTERED, side="right")) - 1, len(queries)))
            i, j = begin[a], begin[z]
            out = np.zeros((z - a, width), dtype=np.uint16)
            at, line = slot[i:j], own[i:j] - a
            common = np.flatnonzero(at >= 0)
            self._add_rows(out, line[common], at[common], rows)
            rare = np.flatnonzero(at < 0)
            ids = terms[i:j][rare]
            count = df[ids]
            place = np.repeat(first[ids] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            np.add.at(out.reshape(-1), np.repeat(line[rare] * width, count) + places[place], level[place])
            yield queries[a:z], begin[a : z + 1], terms, out
            a = z

    def _add_rows(self, out: np.ndarray, line: np.ndarray, row: np.ndarray, rows: list[np.ndarray]) -> None:
        """Adds each ``row`` of the table to its ``line`` of ``out``; short rows of a line are copied together first, which takes fewer calls."""
        add, lines = np.add, list(out)
        if out.shape[1] > TOGETHER:
            for q, r in zip(line.tolist(), row.tolist()):
                total = lines[q]
                add(total, rows[r], total)
            return
        count = np.bincount(line, minlength=len(out))
        buffer = np.empty((int(count.max(initial=0)), out.shape[1]), dtype=np.uint16)
        i = 0
        for total, c in zip(lines, count.tolist()):
            if c:
                held = self.table.take(row[i : i + c], axis=0, out=buffer[:c], mode="clip")
                add.reduce(held, axis=0, out=total)
                i += c

    def lower(self, n: int, count: int, run: int) -> Iterator[np.ndarray]:
        """For runs of the ``count`` queries: at least so much have the n best chunks of each, in no order; 0 where fewer match."""
        start, out = 0, np.zeros((min(run, count), n), dtype=np.float32)
        for queries, begin, _, levels in self.sums(None, 1):
            top = np.partition(levels, self.chunks - n, axis=1)[:, self.chunks - n :] if self.chunks > n else levels
            least = (top.astype(np.float64) - np.diff(begin)[:, None]) * self.step
            least, a = np.maximum(least * (1 - 1e-6) - 1e-6, 0), 0
            while a < len(queries):
                while queries[a] >= start + run:
                    yield out
                    start += run
                    out = np.zeros((min(run, count - start), n), dtype=np.float32)
                z = int(np.searchsorted(queries, start + run))
                out[queries[a:z] - start, : top.shape[1]] = least[a:z]
                a = z
        while start < count:
            yield out
            start += run
            out = np.zeros((max(0, min(run, count - start)), n), dtype=np.float32)

    def best(self, floor: np.ndarray, n: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, chunk and score of the first ``n`` chunks of each query by score, then chunk, among those that reach its ``floor``."""
        least = np.minimum(np.maximum(np.floor(floor / self.step - 1e-3), 1), 65_535)
        group = next((g for most, g in GROUPS if len(self.docs) < most * self.chunks), 1)
        for queries, begin, terms, levels in self.sums(least, group):
            cell = np.flatnonzero(levels >= least[queries].astype(np.uint16)[:, None])
            for i in range(0, len(cell), PAIRS):  # queries cut here are cut to n by the caller's ranking
                q, chunk = np.divmod(cell[i : i + PAIRS], levels.shape[1])
                q, chunk = self._reaching(q, chunk, levels, least[queries], group, begin, terms, n)
                if len(q):
                    yield self._scored(queries, q, chunk, begin, terms, floor, n, digits)

    def _reaching(self, q, groups, levels, least, group, begin, terms, n) -> tuple[np.ndarray, np.ndarray]:
        """Of the groups found, the (query, chunk) pairs that can still reach their floor and the first ``n`` of their query."""
        total, units, width = levels[q, groups].astype(np.int64), groups, min(group, PACKED)
        if group > width:
            times = group // width
            units = (groups[:, None] * times + np.arange(times)).reshape(-1)
            inside = units * width < self.chunks
            q, groups, total, units = *(np.repeat(x, times)[inside] for x in (q, groups, total)), units[inside]
        at, pair = _spread(begin, q)
        ids = terms[at]
        own, highest = self.own_slot[ids], self.slot[ids]
        known = np.flatnonzero((own >= 0) & ((highest >= 0) | (group == 1)))
        pair, ends = pair[known], np.searchsorted(pair[known], np.arange(len(q) + 1))

        def summed(values: np.ndarray) -> np.ndarray:
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
            return total[ends[1:]] - total[ends[:-1]]

        # The levels of neighbouring chunks are added as one number: no sum of levels is beyond 16 bits.
        sure = summed(self.own.view(f"<u{2 * width}")[own[known], units[pair]])
        sure = sure.astype("<u8").view("<u2").reshape(-1, PACKED)[:, :width].astype(np.int64)
        if group > 1:
            total = (total - summed(self.table[highest[known], groups[pair]]).astype(np.int64))[:, None] + sure
        else:
            total = total[:, None]
        chunk = units[:, None] * width + np.arange(width)
        at, lane = np.nonzero((total >= least[q][:, None]) & (chunk < self.chunks))
        q, chunk, total, sure = q[at], chunk[at, lane], total[at, lane], sure[at, lane]
        found = np.bincount(q, minlength=len(begin) - 1)
        if len(q) and found.max() > n:  # n chunks have at least these levels of the most frequent ids, less one for each term
            order = np.lexsort((-sure, q))
            nth = np.minimum(np.cumsum(found) - found + n - 1, len(q) - 1)
            limit = np.where(found > n, sure[order[nth]] - np.diff(begin), 0)
            kept = total >= limit[q]
            q, chunk = q[kept], chunk[kept]
        return q, chunk

    def _scored(self, queries, q, chunk, begin, terms, floor, n, digits):
        at, pair = _spread(begin, q)
        ids, wanted = terms[at], chunk[pair]
        place, end = self.begin[ids], self.begin[ids] + self.df[ids]
        last = end - 1
        for _ in range(int(self.df[ids].max(initial=0)).bit_length()):  # binary search among the chunks of the id
            middle = np.minimum((place + end) >> 1, last)
            below = self.docs[middle] < wanted
            place = np.where(below, middle + 1, place)
            end = np.where(below, end, middle)
        place = np.minimum(place, last)
        hit = self.docs[place] == wanted
        score = np.round(np.bincount(pair[hit], self.value[place[hit]], len(q)), digits)
        some = np.bincount(pair[hit], minlength=len(q)) > 0  # a chunk may be here for its neighbours' sake
        q, chunk, score = q[some], chunk[some], score[some]
        query = queries[q]
        order = np.lexsort((chunk, -score, query))
        query, chunk, score = query[order], chunk[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = (rank < n) & (score >= floor[query])
        return query[kept], chunk[kept], score[kept]


def _spread(begin: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the terms of the queries ``q`` one after another, and which of ``q`` each belongs to."""
    count = np.diff(begin)[q]
    at = np.repeat(begin[q] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return at, np.repeat(np.arange(len(q)), count)


def merged(n: int):
    """Floors of a run of queries from the ``lower`` of several blocks."""

    def run(table: pa.Table) -> pa.Table:
        best = np.concatenate([np.frombuffer(b, dtype=np.float32).reshape(-1, n) for b in table["best"].to_pylist()], axis=1)
        floor = np.partition(best, best.shape[1] - n, axis=1)[:, best.shape[1] - n]
        return pa.table({"run": table["run"].slice(0, 1), "floor": pa.array([np.ascontiguousarray(floor).tobytes()], pa.binary())})

    return run
