"""Mixing sources to target weights by Sainte-Laguë apportionment.

Documents are dealt to shards of about ``shard_docs`` documents by a seeded hash and laid end to end in
seeded order; each shard is cut into blocks of ``block`` words. Every source gets a target in words. Its
quota of blocks is its share of all target blocks by the highest quotients target / (2 seats + 1), and the
quota is dealt to its shards in the same way by their words. A shard takes all its blocks as often as the
quota allows, and the rest as one stretch of neighbouring blocks from a seeded one on, round the end of the shard. So a
reread of the same rows takes the same words, and only documents at the ends of a stretch are cut.

Targets: ``ratio`` times all words, shared by weight; a source's target stops at ``limit`` times its size and
the excess is shared again by weight among the others. Sizes are words ``[^\\x20\\x09-\\x0D]+``; null or blank
texts have size 0 and take nothing. A null source comes last in order and is a source of its own. Repeated
rows are documents of their own (they share one place in the seeded order). Windows run over sources, shards
of one source and documents of one shard only. Column functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import free_name, shared_table, small_or_plain, words_of

BLOCK = 32
SHARD_DOCS = 5_000


def source_targets(sizes: DataFrame, weights: Sequence[float], ratio: float, limit: int) -> DataFrame:
    """source, n_docs, words, target; input: source, words, n_docs, one row per source.

    A source is full when its limit per weight is at most the level that the others reach; full sources
    are a prefix of the order by limit per weight, found from running sums.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("words") * limit)
    by_level = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward, every = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (ratio * F.sum("words").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level)
    # The first source that is not full sets the level of all after it.
    full = F.col("most") <= F.col("level") * F.col("weight")
    final = F.min(F.when(~full, F.col("rank"))).over(every)
    ranked = ranked.withColumn("rank", F.row_number().over(by_level)).withColumn("first_open", final)
    open_level = F.max(F.when(F.col("rank") == F.col("first_open"), F.col("level"))).over(every)
    is_open = F.col("rank") >= F.coalesce(F.col("first_open"), F.lit(1 << 60))
    target = F.when(is_open, F.least(F.col("most"), open_level * F.col("weight"))).otherwise(F.col("most"))
    return ranked.select("source", "n_docs", "words", F.coalesce(target, F.lit(0.0)).alias("target"))


def sainte_lague(claims: DataFrame, seats: Column, groups: Sequence[str], claim: str, most: str, tie: Sequence[str]) -> DataFrame:
    """Adds ``quota``: seats by highest quotients claim / (2 k + 1) within each group.

    With S claimants, the seats below the divisor total / (seats - S / 2) are certain; only about S seats
    are left, for which at most 2 S quotients can compete, so no list of all seats is made. ``most``
    bounds a claimant's seats; ties go by ``tie``.
    """
    part = W.partitionBy(*groups) if groups else W.partitionBy()
    total, n = F.sum(claim).over(part), F.count(F.lit(1)).over(part)
    rows = claims.withColumn("_seats", seats).withColumn("_total", total).withColumn("_n", n)
    safe = F.when(F.col("_total") > 0, F.col(claim) / F.col("_total")).otherwise(0.0)
    down = lambda h: F.greatest(F.ceil(safe * h - 0.5), F.lit(0))
    rows = rows.withColumn("_sure", F.least(down(F.col("_seats") - F.col("_n") / 2.0), F.col(most)).cast("long"))
    rows = rows.withColumn("_high", F.least(down(F.col("_seats") + F.col("_n") / 2.0) + 1, F.col(most)).cast("long"))
    rest = F.col("_seats") - F.sum("_sure").over(part)
    rows = rows.withColumn("_rest", rest)
    steps = F.when(F.col("_high") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_high") - 1)).otherwise(F.array().cast("array<long>"))
    bids = rows.select("*", F.explode_outer(steps).alias("_k"))
    quotient = F.col(claim) / (2 * F.col("_k") + 1)
    place = F.row_number().over(part.orderBy(quotient.desc_nulls_last(), *tie, "_k"))
    bids = bids.withColumn("_won", (F.col("_k").isNotNull() & (place <= F.col("_rest"))).cast("long"))
    keys = claims.columns
    won = bids.groupBy(*keys, "_sure").agg(F.sum("_won").alias("_extra"))
    return won.select(*keys, (F.col("_sure") + F.col("_extra")).alias("quota"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, limit: int = 2, seed: int = 17,
    block: int = BLOCK, shard_docs: int = SHARD_DOCS,
) -> tuple[DataFrame, DataFrame]:
    """(documents, targets) of a mix. ``docs``: doc_id, text, source.

    documents: doc_id, source, size, start (of the document in its shard), blocks: array of (block, words of the
    document before it, words of the document in it, times taken), taken. targets: see ``source_targets``.
    """
    sizes = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"),
                        F.xxhash64(F.lit(seed), "doc_id", F.col("text")).alias("order"))
    sizes = shared_table(sizes, "sizes")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n_docs"))
    targets = shared_table(source_targets(by_source, weights, ratio, limit), "targets")
    side = small_or_plain(targets.select(F.col("source").alias("_s"), F.col("n_docs").alias("_n")))
    laid = sizes.join(side, F.col("source").eqNullSafe(F.col("_s")))
    shards = F.greatest(F.ceil(F.col("_n") / shard_docs), F.lit(1))
    laid = laid.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "order"), shards))
    run = W.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    laid = laid.withColumn("start", F.sum("size").over(run) - F.col("size")).select("doc_id", "source", "size", "order", "shard", "start")
    laid = shared_table(laid, "laid")

    per_shard = laid.groupBy("source", "shard").agg(F.sum("size").alias("shard_words"))
    blocks_of = lambda words: F.ceil(F.col(words) / block).cast("long")
    claims = targets.select("source", "target", (limit * blocks_of("words")).alias("most"))
    seats = F.round(F.sum("target").over(W.partitionBy()) / block).cast("long")
    quotas = shared_table(sainte_lague(claims, seats, (), "target", "most", ("source",)), "quotas")
    shard_claims = per_shard.join(
        small_or_plain(quotas.select(F.col("source").alias("_s"), F.col("quota").alias("source_quota"))),
        F.col("source").eqNullSafe(F.col("_s")),
    ).select("source", "shard", "shard_words", "source_quota", (limit * blocks_of("shard_words")).alias("most"))
    shard_quotas = sainte_lague(shard_claims, F.col("source_quota"), ("source",), "shard_words", "most", ("shard",))
    n = blocks_of("shard_words")
    shard_quotas = shard_quotas.withColumn("n_blocks", n).withColumn("times", F.when(n > 0, F.floor(F.col("quota") / n)).otherwise(0))
    shard_quotas = shard_quotas.withColumn("left", F.col("quota") - F.col("times") * F.col("n_blocks"))
    shard_quotas = shared_table(shard_quotas, "shard-quotas")

    # Blocks chosen once more: neighbours from a seeded one on, round the end of their shard, so only documents at the ends are cut.
    numbered = shard_quotas.where("n_blocks > 0").select("source", "shard", "times", "left", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("n_blocks"))
    drawn = numbered.withColumn("lot", F.pmod(F.col("block") - begin, F.col("n_blocks")))
    drawn = drawn.select(
        F.col("source").alias("_s"), F.col("shard").alias("_d"), F.col("block").alias("_b"),
        (F.col("times") + (F.col("lot") < F.col("left")).cast("long")).alias("times"),
    )

    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spans = laid.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    spans = spans.withColumn("before", low - F.col("start")).withColumn("inside", high - low)
    # Blocks grow with the words but come from a table of a few rows, so their size is guessed far too low: never broadcast.
    met = spans.join(
        drawn.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_d")) & (F.col("block") == F.col("_b"))
    )
    keys = ["doc_id", "source", "size", "order", "shard", "start"]
    taken = met.groupBy(*keys).agg(
        F.sum(F.col("inside") * F.col("times")).alias("taken"),
        F.array_sort(F.collect_list(F.struct("before", "inside", "times"))).alias("pieces"),
    )
    none = laid.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.array().cast("array<struct<before:bigint,inside:bigint,times:bigint>>").alias("pieces"))
    return taken.unionByName(none), targets


def apply_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, limit: int = 2, seed: int = 17) -> DataFrame:
    """Rows of ``docs`` as the mix takes them, same columns: one row for each time that some of a document is taken.

    A row that is taken whole keeps its text; of others the taken words stay, with the white space after each.
    """
    mixed, _ = mix_sources(docs, weights, ratio, limit, seed)
    id_, order_, nth_, size_, pieces_, o_, n_, copy_, own_, taken_ = (
        free_name(docs, c) for c in ("_id", "_order", "_nth", "_size", "_pieces", "_o", "_n", "_copy", "_own", "_taken")
    )
    nth = W.partitionBy("doc_id", "order").orderBy("start")
    picks = mixed.where("taken > 0").select(
        F.col("doc_id").alias(id_), F.col("order").alias(order_), F.row_number().over(nth).alias(nth_), F.col("size").alias(size_),
        F.col("pieces").alias(pieces_),
    )
    keyed = docs.withColumn(o_, F.xxhash64(F.lit(seed), "doc_id", F.col("text")))
    keyed = keyed.withColumn(n_, F.row_number().over(W.partitionBy("doc_id", o_).orderBy(F.lit(1))))
    met = keyed.join(picks, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(o_) == F.col(order_)) & (F.col(n_) == F.col(nth_)))
    copies = met.select("*", F.explode(F.sequence(F.lit(1), F.lit(limit))).alias(copy_))
    own = F.filter(pieces_, lambda p: p["times"] >= F.col(copy_))
    words = F.aggregate(own, F.lit(0).cast("long"), lambda acc, p: acc + p["inside"])
    copies = copies.withColumn(own_, own).withColumn(taken_, words).where(F.col(taken_) > 0)
    spaced = F.regexp_extract_all(F.col("text"), F.lit("[^ \\x09-\\x0D]+[ \\x09-\\x0D]*"), F.lit(0))
    # The words are bound to a lambda variable, so they are found once a row and not once a piece.
    cut_words = lambda ws: F.array_join(
        F.transform(own_, lambda p: F.array_join(F.slice(ws, (p["before"] + 1).cast("int"), p["inside"].cast("int")), "")), ""
    )
    text = F.when(F.col(taken_) == F.col(size_), F.col("text")).otherwise(F.get(F.transform(F.array(spaced), cut_words), F.lit(0)))
    cut = copies.withColumn("text", text)
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
