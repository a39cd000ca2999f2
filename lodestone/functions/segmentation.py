"""Dictionary segmentation of Han text: a trie of weighted words and the cheapest path over the word lattice.

A path cuts a run of Han characters into words; a character that no word of the dictionary begins and ends at costs
``UNKNOWN``. The cheapest path wins; among equally cheap ones each end takes its longest last word. The dictionary is
configuration: it is broadcast, and one above ``MAX_BYTES`` is an error.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F, types as T
from pyspark.sql.pandas.functions import arrow_udf

from .text import HAN_RUN, STOPWORDS

UNKNOWN = 255
MAX_BYTES = 64 << 20
_CODE_BITS = 21
SLICE = 1 << 16  # code points of whole runs that are cut at a time


class HanDictionary:
    """Words with costs (less is likelier, e.g. a scaled negative log frequency)."""

    def __init__(self, entries: Iterable[tuple[str, int]]):
        costs: dict[str, int] = {}
        for word, cost in entries:
            word = unicodedata.normalize("NFKC", word)
            if not word or cost < 0:
                raise ValueError(f"Dictionary entries need a word and a cost from 0: {word!r} {cost}")
            costs[word] = min(cost, costs.get(word, cost))
        self.entries = tuple(sorted(costs.items()))
        edges: dict[int, int] = {}
        ends = [-1]
        self.longest = 1
        for word, cost in self.entries:
            node = 0
            for code in map(ord, word):
                key = node << _CODE_BITS | code
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            ends[node] = cost
            self.longest = max(self.longest, len(word))
        keys = np.fromiter(edges, dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order]
        self.cost = np.array(ends, dtype=np.int64)
        if self.keys.nbytes + self.child.nbytes + self.cost.nbytes > MAX_BYTES:
            raise ValueError(f"A Han dictionary may take {MAX_BYTES} bytes; this one has {len(self.entries)} words")

    @classmethod
    def read(cls, path: str) -> HanDictionary:
        """Lines of a word, a tab and a cost; without a cost 0. Lines beginning with # are comments."""
        with open(path, encoding="utf-8") as file:
            rows = (line.rstrip("\r\n").split("\t") for line in file if line.strip() and not line.startswith("#"))
            return cls((row[0], int(row[1]) if len(row) > 1 else 0) for row in rows)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(f"{w}\t{c}" for w, c in self.entries).encode()).hexdigest()

    def lattice(self, codes: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and cost of every word found in ``codes``; ``end_of``: where each position's run ends."""
        at, node = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        starts, lengths, costs = [], [], []
        alone = np.full(len(codes), UNKNOWN, dtype=np.int64)
        for depth in range(1, self.longest + 1):
            inside = at + depth <= end_of[at]
            at, node = at[inside], node[inside]
            if not len(at) or not len(self.keys):
                break
            key = node << _CODE_BITS | codes[at + depth - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            at, node = at[hit], self.child[place[hit]]
            cost = self.cost[node]
            word = cost >= 0
            if depth == 1:
                alone[at[word]] = cost[word]
            else:
                starts.append(at[word])
                lengths.append(np.full(int(word.sum()), depth))
                costs.append(cost[word])
        everywhere = np.arange(len(codes))
        return (
            np.concatenate([everywhere, *starts]), np.concatenate([np.ones(len(codes), dtype=np.int64), *lengths]), np.concatenate([alone, *costs])
        )

    def cuts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions where a word of the cheapest path ends; ``ends``: the ends of the consecutive runs in ``codes``."""
        n, out, low, at = len(codes), [], 0, 0
        while low < n:
            at = max(at + 1, int(np.searchsorted(ends, low + SLICE, side="right")))
            high = int(ends[at - 1])
            if high > low:
                out.append(low + self._cuts(codes[low:high], np.unique(ends[np.searchsorted(ends, low, side="right") : at]) - low))
            low = high
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def _cuts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(codes)
        start, length, cost = self.lattice(codes, np.repeat(ends, np.diff(ends, prepend=0)))
        end = start + length
        # No word crosses a border between blocks, so each block has its own cheapest path.
        crossed = np.cumsum(np.bincount(start + 1, minlength=n + 1) - np.bincount(end, minlength=n + 1))
        inner = crossed > 0
        inner[0], inner[ends] = False, False
        border = np.flatnonzero(~inner)
        # All blocks advance together: words in order of the step that ends them, their end, and longest first.
        step = end - border[np.cumsum(~inner)[start] - 1]
        scale = self.longest + 1
        order = np.argsort((step * (n + 1) + end) * scale - length)
        start, end, step = start[order], end[order], step[order]
        worth = cost[order] * scale + (self.longest - length[order])  # the least of equal costs is the longest word
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        stops = end[heads]
        first = np.flatnonzero(np.diff(step[heads], prepend=0))
        best, back = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        lows = np.append(heads, len(end))[np.append(first, len(heads))].tolist()
        groups = np.append(first, len(heads)).tolist()
        for k in range(len(first)):
            a, b, i, j = lows[k], lows[k + 1], groups[k], groups[k + 1]
            least = np.minimum.reduceat(best[start[a:b]] + worth[a:b], heads[i:j] - a)
            e = stops[i:j]
            back[e] = least % scale
            best[e] = (least - back[e]) * inner[e]  # a block begins with nothing spent
        back = np.arange(n + 1) - (self.longest - back)
        cut, at = np.zeros(n + 1, dtype=bool), border[1:]
        while len(at):
            cut[at] = True
            at = back[at]
            at = at[inner[at]]
        return np.flatnonzero(cut)

    def segment(self, runs: Sequence[str]) -> list[list[str]]:
        """Words of each run."""
        text = "".join(runs)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum([len(r) for r in runs], dtype=np.int64)
        filled = np.unique(ends[np.diff(ends, prepend=0) > 0]) if len(ends) else ends
        cuts = self.cuts(codes, filled).tolist()
        out, at, low = [], 0, 0
        for end in ends.tolist():
            words = []
            while at < len(cuts) and cuts[at] <= end:
                words.append(text[low : cuts[at]])
                low, at = cuts[at], at + 1
            out.append(words)
        return out

    def segment_lists(self, rows: pa.ListArray) -> pa.ListArray:
        """Words of the runs of each row, stopwords removed; words are cut out of the runs' own bytes."""
        runs = rows.flatten().cast(pa.string())
        raw = pc.cast(runs, pa.binary())
        text = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
        bounds = np.frombuffer(raw.buffers()[1] or bytes(4), dtype=np.int32)[runs.offset : runs.offset + len(runs) + 1].astype(np.int64)
        text, bounds = text[bounds[0] : bounds[-1]], bounds - bounds[0]
        codes = np.frombuffer(text.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        behind = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))  # bytes up to and with each character
        ends = np.searchsorted(behind, bounds[1:], side="right")
        cuts = self.cuts(codes, np.unique(ends[ends > 0]))
        offsets = np.concatenate(([0], behind[cuts - 1])).astype(np.int32)
        words = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(text.tobytes()))
        kept = pc.invert(pc.is_in(words, value_set=pa.array(STOPWORDS, pa.string())))
        before = np.concatenate(([0], np.cumsum(kept.to_numpy(zero_copy_only=False))))
        of_run = np.concatenate(([0], before[np.searchsorted(cuts, ends, side="right")]))
        of_row = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy())))
        return pa.ListArray.from_arrays(pa.array(of_run[of_row], pa.int32()), words.filter(kept))


def han_segments(normalized: Column, dictionary: HanDictionary) -> Column:
    """Words of the Han runs of a normalised text, stopwords removed; one array for each row."""
    shared = SparkSession.active().sparkContext.broadcast(dictionary)

    @arrow_udf(T.ArrayType(T.StringType()))
    def segmented(rows: pa.Array) -> pa.Array:
        return shared.value.segment_lists(rows)

    return segmented(F.regexp_extract_all(F.coalesce(normalized, F.lit("")), F.lit(HAN_RUN), F.lit(0)))
