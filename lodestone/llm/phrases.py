"""Phrase collocation mining by HAT-trie counting.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``. Each task
counts its words and phrases in a trie over word numbers: a node keeps its keys in one hash container, and a full
container bursts, its heaviest words getting nodes of their own. Beyond ``TRIE_KEYS`` keys the largest
subtrees leave the task as sorted runs. Runs meet by prefix partition: that of the first word, or of the whole
phrase where the first word has more than its share of all occurrences, so one frequent word is not one partition. There
Spark's aggregation merges them, outside memory if need be.

Two passes over the texts: words and pairs, then triples. A triple can only be frequent if both its pairs are,
so triples that miss a Bloom filter of the frequent pairs are not entered. The filter has at most ``FILTER_BITS`` bits: on
larger corpora it lets more through and loses none.

A candidate of ``a`` occurrences is cut after each word; the lowest floor(1000000 a a / (l r)) is its score, where l and r count
the two parts. It goes if a longer candidate around it has at least ``COVER_PERCENT`` percent of its occurrences.

Null text: no words. Null lang: ``und``, together with rows that say so. Repeated rows count each time. An empty
table gives an empty result; extra columns are not read. Words are numbered in a task by 64-bit hash; between tasks they meet
by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrays import BYTE_HASH, LOWER, _A, _BASE, _INVERSE, _power_table, as_long, mix, row_slices, text_buffer
from .shared import shared_table

MIN_COUNT = 10
COVER_PERCENT = 50
TOP = 2000
TRIE_KEYS = 1_500_000
BURST_KEYS = 1 << 15
WORDS = 1 << 20  # numbers of a task's words; 20 bits each in a key of three
FILTER_BITS = 1 << 28
SLICE = 1 << 20
_MASK = WORDS - 1

_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 32]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_APART = _GAP | _BREAK
_WORD_BYTE = np.where(_APART, np.uint64(0), BYTE_HASH)


def find_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, start and end of each word of lower-cased texts that begin at ``first``, and its piece's number."""
    n = len(data)
    inside = ~_APART[data]
    border = np.zeros(n + 1, dtype=bool)
    border[first] = True
    border[n] = True
    starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, starts
    value = _WORD_BYTE[data] * _power_table(_BASE, n)
    value = np.add.reduceat(value, starts) * _power_table(_INVERSE, n)[starts]
    value += (ends - starts).astype(np.uint64) * _A
    piece = np.cumsum(_BREAK[data] | border[:-1])[starts]
    return mix(value), starts, ends, piece


def _pieces_of(data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Ranges of a long text, about SLICE bytes each, that repeat the two words before them, and how many they repeat."""
    n, at, again = len(data), 0, 0
    while at < n:
        end, starts = at, []
        while end < n and len(starts) < 3:  # a range of fewer words could not go on behind its first
            end = min(end + SLICE, n)
            while end < n and not _APART[data[end - 1]]:
                step = np.flatnonzero(_APART[data[end : end + SLICE]])
                end = min(end + (int(step[0]) + 1 if len(step) else SLICE), n)
            inside = ~_APART[data[at:end]]
            starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        yield at, end, again
        if end == n:
            return
        at, again = at + int(starts[-2]), 2


class Words:
    """Numbers, from 1, of the words of a task by language."""

    def __init__(self) -> None:
        self.ids: dict[int, int] = {}
        self.texts: list[bytes] = [b""]
        self.langs: list[int] = [0]
        self.hashes: list[int] = [0]

    def number(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: np.ndarray) -> np.ndarray:
        known, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        ids = np.array([self.ids.get(h, 0) for h in known.tolist()], dtype=np.int64)
        for i in np.flatnonzero(ids == 0).tolist():
            k = int(at[i])
            ids[i] = self.ids[int(known[i])] = len(self.texts)
            self.texts.append(data[starts[k] : ends[k]].tobytes())
            self.langs.append(int(langs[k]))
            self.hashes.append(int(known[i]))
        return ids[back]


class Node:
    """Trie node at ``depth`` words: nodes of the words that burst out of it, one hash container for all others."""

    def __init__(self, depth: int) -> None:
        self.depth, self.pool, self.children, self.limit = depth, {}, {}, BURST_KEYS

    def __len__(self) -> int:
        return len(self.pool) + sum(map(len, self.children.values()))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct keys of three numbers."""
        if self.children:
            words = keys >> (40 - 20 * self.depth) & _MASK
            head = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            rest = np.ones(len(keys), dtype=bool)
            for a, b, word in zip(head.tolist(), [*head[1:].tolist(), len(keys)], words[head].tolist()):
                child = self.children.get(word)
                if child is not None:
                    child.add(keys[a:b], counts[a:b])
                    rest[a:b] = False
            keys, counts = keys[rest], counts[rest]
        pool = self.pool
        get = pool.get
        for k, c in zip(keys.tolist(), counts.tolist()):
            pool[k] = get(k, 0) + c
        if len(pool) > self.limit and self.depth < 2:
            self.burst()
            self.limit = max(self.limit, 2 * len(pool))  # many light words: they stay together

    def burst(self) -> None:
        """Words with more than their share of the container become nodes."""
        keys = np.fromiter(self.pool, dtype=np.int64, count=len(self.pool))
        words = keys >> (40 - 20 * self.depth) & _MASK
        known, n = np.unique(words, return_counts=True)
        heavy = known[(n > BURST_KEYS // 64) & (known > 0)]
        for k in keys[np.isin(words, heavy)].tolist():
            word = k >> (40 - 20 * self.depth) & _MASK
            child = self.children.get(word)
            if child is None:
                child = self.children[word] = Node(self.depth + 1)
            child.pool[k] = self.pool.pop(k)

    def subtrees(self) -> list[tuple[int, int | None]]:
        """Keys of the own container and of each child, largest first."""
        return sorted([(len(self.pool), None), *((len(c), w) for w, c in self.children.items())], key=lambda x: -x[0])

    def take(self, word: int | None) -> tuple[list[int], list[int]]:
        """Keys and counts of a subtree, which is emptied."""
        if word is None:
            out = list(self.pool), list(self.pool.values())
            self.pool = {}
            return out
        child = self.children.pop(word)
        keys, counts = child.take(None)
        for w in list(child.children):
            more = child.take(w)
            keys += more[0]
            counts += more[1]
        return keys, counts


RUN = "lang string, words int, prefix long, phrase string, f long"


class Counter:
    """Counts of one task; ``hot``: sorted hashes of words that are no prefix partition of their own."""

    def __init__(self, hot: np.ndarray) -> None:
        self.hot, self.langs, self.lang_ids = hot, [], {}
        self.reset()

    def reset(self) -> None:
        self.words, self.root, self.size = Words(), Node(0), 0

    def lang(self, name: str) -> int:
        if name not in self.lang_ids:
            self.lang_ids[name] = len(self.langs)
            self.langs.append(name)
        return self.lang_ids[name]

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.root.add(*np.unique(keys, return_counts=True))
        if len(self.root) > TRIE_KEYS:
            yield from self.spill(TRIE_KEYS // 2)

    def spill(self, left: int) -> Iterator[pa.RecordBatch]:
        """Largest subtrees as sorted runs until at most ``left`` keys stay."""
        size = len(self.root)
        if not size:
            return
        texts = np.array(self.words.texts, dtype=object)
        rank = np.empty(len(texts), dtype=np.int64)
        rank[np.argsort(texts, kind="stable")] = np.arange(len(texts))
        names = pa.array(self.words.texts, pa.binary()).cast(pa.string())
        langs, hashes = np.array(self.words.langs), np.array(self.words.hashes, dtype=np.uint64)
        for n, word in self.root.subtrees():
            if size <= left:
                break
            size -= n
            if n:
                keys, counts = self.root.take(word)
                yield self.run(np.array(keys, dtype=np.int64), np.array(counts, dtype=np.int64), rank, names, langs, hashes)

    def run(self, keys, counts, rank, names, langs, hashes) -> pa.RecordBatch:
        ids = [keys >> 40, keys >> 20 & _MASK, keys & _MASK]
        order = np.lexsort([rank[x] for x in reversed(ids)])
        ids, counts = [x[order] for x in ids], counts[order]
        n = 1 + (ids[1] > 0) + (ids[2] > 0)
        phrase = names.take(pa.array(ids[0]))
        for k in (1, 2):
            more = pc.if_else(pa.array(ids[k] > 0), names.take(pa.array(ids[k])), None)
            phrase = pc.binary_join_element_wise(phrase, more, " ", null_handling="skip")
        prefix = hashes[ids[0]]
        deep = np.isin(prefix, self.hot)
        prefix = np.where(deep, mix(mix(prefix ^ hashes[ids[1]] * _A) ^ hashes[ids[2]] * _A), prefix)
        lang = pa.array(self.langs, pa.string()).take(pa.array(langs[ids[0]]))
        return pa.RecordBatch.from_arrays([lang, pa.array(n.astype(np.int32)), pa.array(as_long(prefix)), phrase, pa.array(counts)], names=["lang", "words", "prefix", "phrase", "f"])


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0xD1342543DE82EF95) + right)


def _bits(pairs: np.ndarray, size: int) -> list[np.ndarray]:
    return [(mix(pairs + np.uint64(k)) % np.uint64(size)).astype(np.int64) for k in (1, 2, 3)]


def lang_hash(lang: str) -> int:
    raw = np.frombuffer(lang.encode(), dtype=np.uint8)
    return int(mix((BYTE_HASH[raw] * _power_table(_BASE, len(raw))).sum(keepdims=True))[0]) if len(raw) else 0


def _runs(texts: DataFrame, triples: bool, hot, wanted) -> DataFrame:
    """Sorted runs of words and pairs, or of triples whose pairs are in ``wanted``; broadcasts of arrays."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, totals = Counter(hot.value), {}
        filter_ = wanted.value if triples else None
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            names = batch.column("lang").to_pylist()
            own = np.array([counter.lang(x) for x in names], dtype=np.int64)
            salts = np.array([lang_hash(x) for x in counter.langs], dtype=np.uint64)
            for i, j in row_slices(offsets, SLICE):
                part, rows = LOWER[data[offsets[i] : offsets[j]]], offsets[i:j] - offsets[i]
                cuts = [(0, len(part), 0)] if j - i > 1 else _pieces_of(part)
                for a, b, again in cuts:
                    first = rows if j - i > 1 else np.zeros(1, np.int64)
                    word, starts, ends, piece = find_words(part[a:b], first[first < b - a])
                    if len(word) <= again:
                        continue
                    lang = own[i + np.searchsorted(first, starts, side="right") - 1]
                    word = mix(word ^ salts[lang])
                    if len(counter.words.texts) + len(word) > WORDS and len(counter.words.texts) > 1:
                        yield from counter.spill(0)
                        counter.reset()
                    ids = counter.words.number(part[a:b], word, starts, ends, lang)
                    joined = piece[1:] == piece[:-1]
                    pairs = pair_hash(word[:-1], word[1:])
                    if triples:
                        good = joined.copy()
                        for bit in _bits(pairs, 8 * len(filter_)):
                            good &= (filter_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        at = np.flatnonzero(good[1:] & good[:-1])
                        at = at[at + 2 >= again]
                        keys = ids[at] << 40 | ids[at + 1] << 20 | ids[at + 2]
                    else:
                        at = np.flatnonzero(joined)
                        at = at[at + 1 >= again]
                        keys = np.concatenate((ids[again:] << 40, ids[at] << 40 | ids[at + 1] << 20))
                        for k, c in zip(*(x.tolist() for x in np.unique(lang[again:], return_counts=True))):
                            totals[k] = totals.get(k, 0) + c
                    yield from counter.add(keys)
        yield from counter.spill(0)
        if totals:
            n = len(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array([counter.langs[k] for k in totals], pa.string()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()),
                 pa.array([""] * n, pa.string()), pa.array(list(totals.values()), pa.int64())],
                names=["lang", "words", "prefix", "phrase", "f"],
            )

    return texts.mapInArrow(emit, RUN)


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """Counts of at least ``least`` (and the totals): the runs of a prefix partition meet and are merged."""
    met = runs.repartition("lang", "prefix").groupBy("lang", "prefix", "words", "phrase").agg(F.sum("f").alias("f"))
    return met.where((F.col("words") == 0) | (F.col("f") >= least)).select("lang", "words", "phrase", "f")


def _hot_words(texts: DataFrame, partitions: int) -> np.ndarray:
    """Hashes of words that hold more than a quarter of a partition's share of all occurrences; at most four for each partition."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        seen = 0
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            salts = [lang_hash(x) for x in batch.column("lang").to_pylist()]
            for i, j in row_slices(offsets, SLICE):
                part = LOWER[data[offsets[i] : offsets[j]]]
                first = offsets[i:j] - offsets[i]
                word, starts, _, _ = find_words(part, first[first < len(part)])
                salt = np.array(salts[i:j], dtype=np.uint64)[np.searchsorted(first, starts, side="right") - 1]
                for k, c in zip(*(x.tolist() for x in np.unique(mix(word ^ salt), return_counts=True))):
                    counts[k] = counts.get(k, 0) + c
                seen += len(word)
                if len(counts) > 4 * 16 * partitions:  # of few occurrences here: dropping them lowers a count by less than this share
                    least = seen / (16 * partitions)
                    counts = {k: c for k, c in counts.items() if c > least}
        least = seen / (16 * partitions)
        kept = {k: c for k, c in counts.items() if c > least}
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([0, *kept], dtype=np.uint64).view(np.int64)), pa.array([seen, *kept.values()], pa.int64())], names=["word", "c"]
        )

    summed = shared_table(texts.mapInArrow(emit, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-shares")
    total = summed.where("word = 0").agg(F.max("c").alias("n")).first()["n"] or 0
    table = summed.where((F.col("word") != 0) & (F.col("c") > total / (4 * partitions))).select("word").toArrow()
    return np.sort(table.column("word").to_numpy().view(np.uint64))


def _pair_filter(pairs: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter of ``pairs`` (lang, phrase of two words) as bytes; the driver gets at most ``bits`` / 8 of them."""
    size = 1 << 10
    wanted = 24 * pairs.count()
    while size < min(wanted, bits):
        size *= 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("phrase"))
            part = data[offsets[0] : offsets[-1]]
            word, _, _, _ = find_words(part, offsets[:-1] - offsets[0])
            salt = np.array([lang_hash(x) for x in batch.column("lang").to_pylist()], dtype=np.uint64)
            word = mix(word ^ np.repeat(salt, 2))
            at = np.unique(np.concatenate(_bits(pair_hash(word[::2], word[1::2]), size)))
            block, start = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(as_long(mask))], names=["block", "mask"])

    table = pairs.select("lang", "phrase").mapInArrow(emit, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[table.column("block").to_numpy()] = table.column("mask").to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Stored tables (lang, words, phrase, f): words, pairs and totals (words = 0: all word occurrences), and triples; f >= ``least``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    hot = spark.sparkContext.broadcast(_hot_words(texts, partitions))
    short = shared_table(_merged(_runs(texts, False, hot, None), least), "words-and-pairs")
    wanted = spark.sparkContext.broadcast(_pair_filter(short.where("words = 2"), filter_bits))
    return short, shared_table(_merged(_runs(texts, True, hot, wanted), least), "triples")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    wide = a.cast("decimal(15,0)")
    return F.call_function("div", (F.lit(1000000).cast("decimal(7,0)") * wide * wide).cast("decimal(38,0)"), (l.cast("decimal(19,0)") * r.cast("decimal(18,0)")).cast("decimal(38,0)"))


def scored_candidates(short: DataFrame, triples: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of every phrase of two or three words: parts and score of its lowest cut."""
    one = short.where("words = 1").select("lang", F.col("phrase").alias("part"), F.col("f").alias("n"))
    two = short.where("words = 2").select("lang", F.col("phrase").alias("part"), F.col("f").alias("n"))

    def counted(df: DataFrame, table: DataFrame, part: Column, name: str) -> DataFrame:
        return df.withColumn("part", part).join(table, ["lang", "part"]).drop("part").withColumnRenamed("n", name)

    head, tail = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    a = F.col("f").alias("a")
    pairs = short.where("words = 2").select("lang", "words", "phrase", a)
    pairs = counted(counted(pairs, one, head, "l"), one, tail, "r").withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    cut = triples.select("lang", "words", "phrase", a)
    cut = counted(counted(cut, one, head, "l1"), two, F.substring_index("phrase", " ", -2), "r1")
    cut = counted(counted(cut, two, F.substring_index("phrase", " ", 2), "l2"), one, tail, "r2")
    best = F.least(*[F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    cut = cut.withColumn("best", best).select("lang", "words", "phrase", "a", "best.l", "best.r", "best.score")
    return pairs.select(*cut.columns).unionByName(cut)


def mine_phrases(docs: DataFrame, least: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language of ``docs`` (lang, text)."""
    short, triples = phrase_counts(docs, least, filter_bits)
    inner = [triples.select("lang", F.substring_index("phrase", " ", k).alias("phrase"), "f") for k in (2, -2)]
    cover = inner[0].unionByName(inner[1]).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    found = scored_candidates(short, triples)
    pairs = found.where("words = 2").join(cover, ["lang", "phrase"], "left")
    pairs = pairs.where(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a"))).drop("longer")
    left = pairs.unionByName(found.where("words = 3").select(*pairs.columns))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    total = short.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
