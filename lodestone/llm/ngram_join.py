"""N-gram Jaccard join by filtering under several global token orders.

A document is the set of its distinct ``n``-word shingles (lower-cased A-Z; with fewer words the whole
sequence as one). Two documents link when intersection / union >= ``percent`` / 100. Candidates must share prefix tokens
under three orders of all shingles:

1. hash order, with prefixes long enough that linked documents share several tokens of them. Every prefix token of the
   corpus is met by its like in one sorted exchange; documents without enough shared ones leave;
2. rarest first, by exact counts among the documents left: only pairs that share a token of these
   prefixes, at positions that still allow the overlap, go on;
3. a second hash order, tested for each pair on the two sets, before their intersection is counted.

Equal sets are one node, known by two hashes and their size. No group emits all its pairs: each token's nodes are compared with
the most typical one of them, linked nodes form components, and only nodes of different components that share
a token are compared further. So links inside a component may stay untested, but no component misses one.

No text is stored or shuffled: it is read for the signatures, for the prefixes, and for the sets of the nodes that the first order left, which
a Bloom filter of bounded size picks out (what it lets through besides is compared like the rest).

Null text or one without words: the empty set, linked with nothing. Rows that share a doc_id and rows without one count like any
other; a component has the smallest doc_id of its rows, null if all are null. An empty table gives an empty result, repeated rows are
one node, long texts are taken in slices, other columns are not read. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import as_long, mix, row_slices, span_hashes, text_buffer, word_arrays
from .bloom import bloom_filter, holds
from .components import connected_components
from .shared import drop_table, fixed_rows, free_name, shared_table, small_or_plain

NGRAM = 4
PERCENT = 85
SHARE_EVERY = 20  # linked documents must share one prefix token for every 20 shingles of theirs
SLICE = 1 << 20
SEEN = 200_000  # sets that a task remembers
FREQUENT = 1 << 17  # counts of the second order from here on are equal


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, _, _, first = word_arrays(data, offsets, lower=True)
    full = span_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        else:
            out.append(span_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _ceil(value: int, percent: int) -> int:
    return -(-value * percent // 100)


def _required(size, every: int):
    return np.maximum(size // every, 1)


def _hashes(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """Order-free hash of each set."""
    salt = mix(np.array([seed], dtype=np.uint64))[0]
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    total = np.zeros(len(sets), dtype=np.uint64)
    filled = np.flatnonzero(lengths)
    if len(filled):
        values = mix(np.concatenate(sets) ^ salt)
        total[filled] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[filled])
    return mix(total ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


SEEDS = (1, 2)


def signatures(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """All columns of ``docs`` but text, with n_shingles, node (a hash of the set) and check (a second one)."""
    kept = [c for c in docs.columns if c != "text"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_slices(offsets, SLICE):
                sets = shingle_sets(data, offsets[i : j + 1], n)
                columns = [batch.column(c)[i:j] for c in kept]
                columns += [pa.array([len(s) for s in sets], pa.int64()), pa.array(as_long(_hashes(sets, SEEDS[0]))), pa.array(as_long(_hashes(sets, SEEDS[1])))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_shingles", "node", "check"])

    schema = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(emit, f"{schema}{', ' if kept else ''}n_shingles long, node long, check long")


def _prefix_rows(texts: DataFrame, n: int, percent: int, every: int) -> DataFrame:
    """Prefixes under the first order: token, node, size of its set. A task passes a set that it saw before only once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_slices(offsets, SLICE):
                sets = shingle_sets(data, offsets[i : j + 1], n)
                nodes = as_long(_hashes(sets, SEEDS[0]))
                sizes = np.array([len(s) for s in sets])
                takes = np.minimum(sizes - -(-sizes * percent // 100) + _required(sizes, every), sizes)
                for k, node in enumerate(nodes.tolist()):
                    if node in seen:
                        takes[k] = 0
                    elif len(seen) < SEEN:
                        seen.add(node)
                tokens = np.concatenate([s[:t] for s, t in zip(sets, takes)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(tokens)), pa.array(np.repeat(nodes, takes)), pa.array(np.repeat(sizes, takes).astype(np.int32))],
                    names=["token", "node", "n"],
                )

    return texts.mapInArrow(emit, "token long, node long, n int")


def _met_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and node: node and size, once for each token that another node has too."""
    last: tuple[int, int, int] | None = None  # first row of the token that runs on, while it is alone
    token = node = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, v, n = (batch.column(c).to_numpy() for c in ("token", "node", "n"))
        same_token = np.concatenate(([t[0] == token], t[1:] == t[:-1]))
        same_node = same_token & np.concatenate(([v[0] == node], v[1:] == v[:-1]))
        new = ~same_node
        out_v, out_n = [], []
        if last is not None and same_token[0]:
            run = np.flatnonzero(~same_token)
            end = int(run[0]) if len(run) else len(t)
            if new[:end].any():
                out_v.append([last[1]])
                out_n.append([last[2]])
                last = None
        keep = np.flatnonzero(new)
        tk = t[keep]
        left = np.concatenate(([False], tk[1:] == tk[:-1]))
        right = np.concatenate((tk[1:] == tk[:-1], [False])) if len(tk) else left
        known = np.zeros(len(tk), dtype=bool)
        if len(tk):
            known = tk == token  # goes on from the batch before
        met = left | right | known
        out_v.append(v[keep][met])
        out_n.append(n[keep][met])
        if len(keep) and not met[-1] and tk[-1] == t[-1]:
            last = (int(t[-1]), int(v[keep][-1]), int(n[keep][-1]))
        elif t[-1] != token:
            last = None
        token, node = int(t[-1]), int(v[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_v), pa.int64()), pa.array(np.concatenate(out_n), pa.int32())], names=["node", "n"])


def _chosen_sets(docs: DataFrame, n: int, chosen: DataFrame) -> DataFrame:
    """row, size and sorted tokens (as bytes) of the rows of ``docs`` that ``chosen`` (row) has.

    A Bloom filter decides which texts are taken apart, and the row numbers of ``chosen`` what stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(chosen, "row"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(holds(shared.value, batch.column("row").to_numpy().view(np.uint64))))
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_slices(offsets, SLICE):
                sets = shingle_sets(data, offsets[i : j + 1], n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[i:j], pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["row", "n", "tokens"],
                )

    return docs.select("row", "text").mapInArrow(emit, "row long, n int, tokens binary").join(small_or_plain(chosen), "row", "left_semi")


def _with_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token: those of tokens that two rows have, with the token's count (``FREQUENT`` and more are one count)."""

    def rows(token: int, held: list[np.ndarray], sizes: list[np.ndarray], df: int) -> pa.RecordBatch:
        own = np.concatenate(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(np.concatenate(sizes)), pa.array(np.full(len(own), df, dtype=np.int64)), pa.array(np.full(len(own), token, dtype=np.int64))],
            names=["row", "n", "df", "token"],
        )

    token, held, sizes, count = None, [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t, v, n = (batch.column(c).to_numpy() for c in ("token", "row", "n"))
        heads = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        ends = np.append(heads[1:], len(t))
        first = 0
        if t[0] == token:  # the run of the batch before goes on
            first = 1
            held.append(v[: ends[0]])
            sizes.append(n[: ends[0]])
            count += int(ends[0])
            if count >= FREQUENT:
                yield rows(token, held, sizes, FREQUENT)
                held, sizes = [], []
        if first < len(heads) or t[0] != token:
            if token is not None and count > 1 and held:
                yield rows(token, held, sizes, min(count, FREQUENT))
            inner = slice(first, len(heads) - 1)
            a, b = heads[inner], ends[inner]
            lengths = b - a
            several = lengths > 1
            if several.any():
                at = np.concatenate([np.arange(x, y) for x, y in zip(a[several], b[several])])
                df = np.minimum(np.repeat(lengths[several], lengths[several]), FREQUENT)
                yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(n[at]), pa.array(df.astype(np.int64)), pa.array(t[at])], names=["row", "n", "df", "token"])
            low = int(heads[-1])
            token, held, sizes, count = int(t[-1]), [v[low:]], [n[low:]], len(t) - low
            if count >= FREQUENT:
                yield rows(token, held, sizes, FREQUENT)
                held, sizes = [], []
    if token is not None and count > 1 and held:
        yield rows(token, held, sizes, min(count, FREQUENT))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("tokens"))
        ids, sizes = batch.column("row").to_numpy(), batch.column("n").to_numpy()
        for i, j in row_slices(offsets, SLICE):
            tokens = np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.array(np.repeat(ids[i:j], sizes[i:j])), pa.array(np.repeat(sizes[i:j], sizes[i:j]))],
                names=["token", "row", "n"],
            )


def _third_order(tokens: np.ndarray, percent: int) -> np.ndarray:
    take = len(tokens) - _ceil(len(tokens), percent) + 1
    order = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D))
    return order if take >= len(order) else np.partition(order, take - 1)[:take]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Third filter, then the exact test."""
    if not np.isin(_third_order(a, percent), _third_order(b, percent)).any():
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs of ``pairs`` (a, b). The sets of b travel with their pairs; that of a, which many pairs share, goes once to where they meet."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, l), (right, r) = text_buffer(batch.column("ta")), text_buffer(batch.column("tb"))
            part = lambda data, at, i: np.frombuffer(data[at[i] : at[i + 1]].tobytes(), dtype=np.uint64)
            keep = [linked(part(left, l, i), part(right, r, i), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    members = pairs.join(sets.select(F.col("row").alias("b"), F.col("tokens").alias("tb")), "b")
    both = members.join(sets.select(F.col("row").alias("a"), F.col("tokens").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(emit, "a long, b long")


def _may_link(na: Column, ua: Column, nb: Column, ub: Column, percent: int) -> Column:
    """Sizes and tokens found nowhere else still allow the overlap."""
    small, large = F.least(na, nb), F.greatest(na, nb)
    need = F.ceil(percent * (na + nb) / (100 + percent))
    return (100 * small >= percent * large) & (F.least(na - ua, nb - ub) >= need)


def similar_components(docs: DataFrame, classes: DataFrame, n: int = NGRAM, percent: int = PERCENT, every: int = SHARE_EVERY) -> DataFrame:
    """node, component (its smallest node) for the sets that have a link; all others are alone. A set's node is the ``row`` of its class.

    ``docs``: row (a number that no other row has, the same whenever the rows are read), text; ``classes``: stored, one row for each
    set that is not empty: node (its hash), row (of one row of ``docs`` with this set). The hash only picks what the first order leaves.
    """
    met = _prefix_rows(docs.select("text"), n, percent, every).repartition("token").sortWithinPartitions("token", "node").mapInArrow(_met_tokens, "node long, n int")
    least = F.greatest(F.floor(F.ceil(F.col("n") * percent / 100) / every), F.lit(1))
    kept = shared_table(
        met.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).where(F.col("c") >= least).select("node"), "first-order"
    )
    chosen = shared_table(classes.join(small_or_plain(kept), "node", "left_semi").select("row"), "chosen")
    sets = shared_table(_chosen_sets(docs, n, chosen), "sets")

    tokens = sets.mapInArrow(_token_rows, "token long, row long, n int")
    counted = tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_with_frequency, "row long, n int, df long, token long")
    listed = counted.groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
    alone = F.col("n") - F.size("ts")
    take = F.greatest(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone"), F.lit(0)).cast("int")
    prefix = listed.withColumn("alone", alone).select("row", "n", "alone", F.slice("ts", F.lit(1), take).alias("ts"))
    prefix = shared_table(prefix.where(F.size("ts") > 0), "prefixes")
    buckets = prefix.select("row", "n", "alone", F.posexplode("ts").alias("p", "t")).select(
        "row", "n", "alone", (F.col("p") + F.col("alone")).alias("at"), F.col("t.token").alias("token")
    )

    centre = shared_table(
        buckets.groupBy("token").agg(
            F.count(F.lit(1)).alias("c"),
            F.min(F.struct((F.col("alone") / F.col("n")).alias("r"), F.col("row").alias("a"), F.col("n").alias("na"), F.col("alone").alias("ua"))).alias("x"),
        ).where("c > 1").select("token", "x.a", "x.na", "x.ua"),
        "centres",
    )
    star = buckets.join(centre, "token").where(
        (F.col("row") != F.col("a")) & _may_link(F.col("n"), F.col("alone"), F.col("na"), F.col("ua"), percent)
    )
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = shared_table(star.select("a", F.col("row").alias("b")).distinct(), "first-pairs")
    links = shared_table(_verify(first, sets, percent), "first-links")
    labels = shared_table(connected_components(links), "first-components")

    named = buckets.join(labels.select(F.col("node").alias("row"), "component"), "row", "left").withColumn(
        "component", F.coalesce("component", "row")
    )
    named = shared_table(named, "named")
    open_ = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rest = shared_table(named.join(shared_table(open_, "open-tokens"), "token", "left_semi"), "open")
    index = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    x = rest.where(F.col("at") < index).select("token", *[F.col(c).alias(c + "1") for c in ("row", "n", "alone", "at", "component")])
    y = rest.select("token", *[F.col(c).alias(c + "2") for c in ("row", "n", "alone", "at", "component")])
    need = F.ceil(percent * (F.col("n1") + F.col("n2")) / (100 + percent))
    second = x.join(y, "token").where(
        (F.col("component1") != F.col("component2"))
        & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("row1") < F.col("row2"))))
        & (F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= need)
        & _may_link(F.col("n1"), F.col("alone1"), F.col("n2"), F.col("alone2"), percent)
    )
    tested = first.select(*ordered("a", "b"))
    second = second.select(*ordered("row1", "row2")).distinct().join(tested, ["a", "b"], "left_anti")
    more = _verify(shared_table(second, "second-pairs"), sets, percent)
    labels = connected_components(shared_table(links.unionByName(more), "links"), "final")
    for table in (sets, prefix):  # the large ones; the labels no longer read them
        drop_table(table)
    return labels


def _signed(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` with row numbers, their stored signatures, and one row for each set that is not empty."""
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    known = shared_table(signatures(numbered, n), "signatures")
    classes = known.where("n_shingles > 0").groupBy(*SET).agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
    return numbered.select("row", "text"), known, shared_table(classes, "classes")


SET = ("node", "check", "n_shingles")


def _labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``classes`` with their component, which is their own row if they have no link."""
    named = classes.join(found.withColumnRenamed("node", "row"), "row", "left")
    return shared_table(named.withColumn("component", F.coalesce("component", "row")), "labels")


def jaccard_join(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) of every row of ``docs`` (doc_id, text).

    ``docs`` is read several times; if it is not a table of files, it is stored first.
    """
    docs = fixed_rows(docs, "texts").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, known, classes = _signed(docs, n)
    label = _labelled(classes, shared_table(similar_components(rows, classes, n, percent), "components"))
    # Most components are one set; only the others are summed up.
    several = label.join(label.where("component <> row").select("component").distinct(), "component", "left_semi")
    least = several.groupBy("component").agg(F.min("least").alias("component_id"))
    named = label.join(small_or_plain(shared_table(least, "least")), "component", "left").select(*SET, F.coalesce("component_id", "least").alias("component_id"))
    alone = known.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.where("n_shingles > 0").join(named, list(SET)).select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_one_per_component(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest doc_id (nulls last), and all rows without a link.

    Rows are linked and removed by a row number: repeated rows and rows with a null doc_id count like any other. Among
    rows with the same doc_id a hash of the row decides. A row leaves only if its number and hash are those of a near copy.
    ``docs`` is read several times; if it is not a table of files, it is stored first.
    """
    key, hashed = free_name(docs, "_row"), free_name(docs, "_hash")
    plain = [c for c, kind in docs.dtypes if "<" not in kind and kind != "variant"]
    docs = fixed_rows(docs, "texts")
    rows, known, classes = _signed(docs.select("doc_id", "text", F.xxhash64(*plain).alias("hash")), n)
    label = _labelled(classes, shared_table(similar_components(rows, classes, n, percent), "components"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "row").alias("rank")
    nodes = shared_table(known.where("n_shingles > 0").select(*SET, rank).join(label.select(*SET, "component"), list(SET)).select("component", "rank"), "ranked")
    groups = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.min("rank").alias("first")).where("c > 1")
    groups = shared_table(groups.select("component", F.col("first.row").alias("stays")), "groups")
    gone = nodes.join(small_or_plain(groups), "component").where(F.col("rank.row") != F.col("stays")).select(F.col("rank.row").alias(key), F.col("rank.hash").alias(hashed))
    gone = small_or_plain(shared_table(gone, "near-copies"))
    return docs.withColumns({key: F.monotonically_increasing_id(), hashed: F.xxhash64(*plain)}).join(gone, [key, hashed], "left_anti").drop(key, hashed)
