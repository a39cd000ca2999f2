"""Retrieval metrics, order statistics and paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import BROADCAST_ROW_LIMIT, cut_lineage, fits, small_side

DEPTHS = (1, 3, 5, 10)


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("long")


def pool_depth(pool: DataFrame, relevant: DataFrame) -> DataFrame:
    """Relevant chunks within rank bands and lanes of each query's candidate pool."""
    marked = pool.join(relevant.distinct().withColumn("rel", F.lit(True)), "chunk_id", "left")
    rel = F.coalesce("rel", F.lit(False))
    return marked.groupBy("query_id").agg(
        *[count_if(rel & (F.col("rank") <= k)).alias(f"top{k}") for k in (10, 20, 50)],
        count_if(rel).alias("pool"),
        count_if(rel & F.col("dense_rank").isNotNull()).alias("dense_pool"),
        count_if(rel & F.col("bm25_rank").isNotNull()).alias("bm25_pool"),
    )


POOL_BANDS = ("top10", "top20", "top50", "pool", "dense_pool", "bm25_pool")


def pool_recall(pool: DataFrame, relevant: DataFrame) -> DataFrame:
    """Shares of a query's relevant chunks (query_id, chunk_id) that rank bands and lanes of its pool hold; 0 for a query without a pool."""
    wanted = relevant.select("query_id", "chunk_id").distinct()
    total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    held = pool.join(wanted, ["query_id", "chunk_id"])
    found = held.groupBy("query_id").agg(
        *[count_if(F.col("rank") <= k).alias(f"top{k}") for k in (10, 20, 50)], F.count(F.lit(1)).alias("pool"),
        *[count_if(F.col(f"{lane}_rank").isNotNull()).alias(f"{lane}_pool") for lane in ("dense", "bm25")],
    )
    return total.join(found, "query_id", "left").select("query_id", "relevant", *[(F.coalesce(b, F.lit(0)) / F.col("relevant")).alias(b) for b in POOL_BANDS])


def order_statistics(
    df: DataFrame, value: str, probs: list[float], group: tuple[str, ...] = (), kind: str = "nearest", buckets: int = 64
) -> DataFrame:
    """Exact quantiles per group without gathering a group in one place.

    Equal values are counted first (map-side combined). Approximate quantiles of the distinct
    values then cut each group into buckets of similar size; bucket totals tell which bucket
    holds each wanted rank, and only those buckets are sorted. The approximation only balances
    the buckets, so the result is exact; the cut points are checkpointed because both the
    totals and the rows must use the same ones.

    ``nearest``: value number max(1, ⌈n·p⌉). ``linear``: interpolated at (n−1)·p.
    """
    keys = list(group) or ["_all"]
    base = df.filter(F.col(value).isNotNull())
    if not group:
        base = base.withColumn("_all", F.lit(0))
    counts = base.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cuts = cut_lineage(
        counts.groupBy(*keys).agg(
            F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 1000).alias("cuts"),
            F.sum("n").alias("total"),
        )
    )
    # Joining on the group alone would bring a large group together, so the cuts are broadcast
    # while small; with very many groups AQE splits a skewed one.
    few = fits(cuts, BROADCAST_ROW_LIMIT // buckets)
    bucketed = counts.join(small_side(cuts, few), keys).withColumn(
        "bucket", F.size(F.filter("cuts", lambda c: c < F.col("v")))
    ).drop("cuts")
    totals = bucketed.groupBy(*keys, "bucket", "total").agg(F.sum("n").alias("size"))
    w = W.partitionBy(*keys).orderBy("bucket")  # at most ``buckets`` rows per group
    spans = totals.withColumn("before", F.sum("size").over(w) - F.col("size"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    n = F.col("total").cast("double")
    if kind == "nearest":
        low = high = F.greatest(F.ceil(n * F.col("p")), F.lit(1))
    else:
        low, high = F.floor((n - 1) * F.col("p")) + 1, F.ceil((n - 1) * F.col("p")) + 1
    spans = spans.withColumn("p", wanted).withColumns({"low": low.cast("long"), "high": high.cast("long")})
    touched = spans.filter((F.col("before") < F.col("high")) & (F.col("before") + F.col("size") >= F.col("low")))
    inside = bucketed.join(
        small_side(touched.select(*keys, "bucket", "before").distinct(), few), [*keys, "bucket"]
    )
    running = W.partitionBy(*keys, "bucket").orderBy("v")
    placed = inside.withColumn("upto", F.col("before") + F.sum("n").over(running)).select(
        *keys, "bucket", "v", "n", "upto"
    )
    picked = placed.join(
        small_side(touched.select(*keys, "bucket", "p", "low", "high", "total"), few), [*keys, "bucket"]
    )

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("n") < F.col(rank)), F.col("v")))

    share = (F.col("total").cast("double") - 1) * F.col("p")
    out = picked.groupBy(*keys, "p", "total").agg(at("low").alias("lo"), at("high").alias("hi")).withColumn(
        "quantile",
        F.col("lo") if kind == "nearest" else F.col("lo") + (F.col("hi") - F.col("lo")) * (share - F.floor(share)),
    )
    return out.select(*group, "p", "quantile", F.col("total").alias("values"))


def ranking_metrics(run: DataFrame, qrels: DataFrame, queries: DataFrame, depth: int = 10, deep: int = 50) -> DataFrame:
    """nDCG, recall, reciprocal rank and hit per query; a query absent from the run scores 0.

    Linear gains and log2 discounts; the ideal order is the judged relevance, descending.
    """
    judged = qrels.filter(F.col("rel") > 0)
    w = W.partitionBy("query_id").orderBy(F.col("rel").desc(), "chunk_id")
    best = judged.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= depth)
    ideal = best.groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("i") + 1.0)).alias("ideal"))
    relevant = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = run.filter(F.col("rank") <= deep).join(judged, ["query_id", "chunk_id"])
    top = F.col("rank") <= depth
    found = hits.groupBy("query_id").agg(
        F.sum(F.when(top, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        count_if(top).alias("found"), F.count(F.lit(1)).alias("found_deep"),
        F.min(F.when(top, F.col("rank"))).alias("first"),
    )
    rows = queries.select("query_id").join(ideal, "query_id", "left").join(relevant, "query_id", "left").join(found, "query_id", "left")

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(a).cast("double") / F.col(b), F.lit(0.0))

    return rows.select(
        "query_id", share("dcg", "ideal").alias("ndcg"), share("found", "relevant").alias("recall"),
        share("found_deep", "relevant").alias("recall_deep"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.col("first").isNotNull().cast("int").alias("hit"),
    )


def nugget_coverage(run: DataFrame, nuggets: DataFrame, k: int) -> DataFrame:
    """Share of a query's nuggets with a relevant chunk in the first ``k`` results."""
    support = nuggets.filter(F.col("rel") > 0).join(run.filter(F.col("rank") <= k), ["query_id", "chunk_id"], "left_semi")
    covered = support.select("query_id", "nugget_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("covered"))
    total = nuggets.groupBy("query_id").agg(F.countDistinct("nugget_id").alias("nuggets"))
    return total.join(covered, "query_id", "left").select(
        "query_id", (F.coalesce("covered", F.lit(0)) / F.col("nuggets")).alias("coverage")
    )


def alpha_ndcg(run: DataFrame, nuggets: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """α-nDCG@k: each repeat of a nugget is worth (1−α) times the previous one.

    The run's gain is a window over (query, nugget). The ideal order is greedy, but chunks
    with the same nuggets are interchangeable, so k chunks per distinct nugget set suffice and
    the greedy step sees a bounded group however many chunks are judged.
    """
    import math

    import pandas as pd

    judged = nuggets.filter(F.col("rel") > 0).select("query_id", "nugget_id", "chunk_id").distinct()
    w = W.partitionBy("query_id", "nugget_id").orderBy("rank")
    gains = run.filter(F.col("rank") <= k).join(judged, ["query_id", "chunk_id"]).withColumn(
        "gain", F.pow(F.lit(1.0 - alpha), F.row_number().over(w) - 1) / F.log2(F.col("rank") + 1.0)
    )
    actual = gains.groupBy("query_id").agg(F.sum("gain").alias("gain"))
    sets = judged.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("nugget_id")).alias("nuggets"))
    alike = W.partitionBy("query_id", "nuggets").orderBy("chunk_id")
    pool = sets.withColumn("i", F.row_number().over(alike)).filter(F.col("i") <= k).drop("i")
    schema = f"query_id {nuggets.schema['query_id'].dataType.simpleString()}, ideal double"

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        left = [set(n) for n in group.sort_values("chunk_id")["nuggets"]]
        seen: dict = {}
        total = 0.0
        for rank in range(1, min(k, len(left)) + 1):
            worth = [sum((1.0 - alpha) ** seen.get(n, 0) for n in one) for one in left]
            pick = left.pop(max(range(len(left)), key=lambda i: (worth[i], -i)))
            total += max(worth) / math.log2(rank + 1)
            for n in pick:
                seen[n] = seen.get(n, 0) + 1
        return pd.DataFrame({"query_id": [group["query_id"].iloc[0]], "ideal": [total]})

    ideal = pool.groupBy("query_id").applyInPandas(greedy, schema)
    asked = nuggets.select("query_id").distinct()
    return asked.join(ideal, "query_id", "left").join(actual, "query_id", "left").select(
        "query_id", F.coalesce(F.col("gain") / F.col("ideal"), F.lit(0.0)).alias("alpha_ndcg")
    )


def single_piece_rank(pieces: DataFrame, anchors: DataFrame, source_lines: DataFrame, required: DataFrame) -> DataFrame:
    """(query_id, rank): first piece that alone covers a whole anchor of a required fact."""
    anchor_lines = (
        anchors.withColumn("line_no", F.explode(F.sequence("start_line", "end_line")))
        .join(source_lines, ["source_id", "line_no"])
        .filter(F.col("text").rlike(r"\S"))
        .select("fact_id", "source_id", "start_line", "line_no", "text")
    )
    sizes = anchor_lines.groupBy("fact_id", "source_id", "start_line").agg(F.count(F.lit(1)).alias("needed"))
    returned = pieces.select(
        "query_id", "rank", "source_id", F.col("start_line").alias("piece_start"),
        F.posexplode(F.split("text", "\n", -1)).alias("i", "text"),
    ).withColumn("line_no", (F.col("piece_start") + F.col("i")).cast("int"))
    alone = (
        required.join(anchor_lines, "fact_id")
        .join(returned, ["query_id", "source_id", "line_no", "text"])
        .groupBy("query_id", "fact_id", "source_id", "start_line", "rank")
        .agg(F.count(F.lit(1)).alias("seen"))
        .join(sizes, ["fact_id", "source_id", "start_line"])
        .filter(F.col("seen") == F.col("needed"))
    )
    return alone.groupBy("query_id").agg(F.min("rank").alias("rank"))


def question_scores(
    questions: DataFrame, fact_ranks: DataFrame, single: DataFrame, source_hits: DataFrame, depths: tuple[int, ...] = DEPTHS
) -> DataFrame:
    """One row per (question, K) from first ranks, without walking the result list.

    ``fact_ranks``: query_id, fact_id, rank (null = never covered). ``single``: first rank of
    a piece covering a fact alone. ``source_hits``: query_id, source_id, rank of the first
    piece of each relevant source (null = none).
    """
    k = F.col("k")
    per_k = questions.filter(~F.col("no_answer")).select("query_id").withColumn(
        "k", F.explode(F.array(*[F.lit(d) for d in depths]))
    )
    facts = per_k.join(fact_ranks, "query_id").groupBy("query_id", "k").agg(
        F.count(F.lit(1)).alias("facts"), count_if(F.col("rank") <= k).alias("covered"), F.min("rank").alias("first")
    )
    sources = per_k.join(source_hits, "query_id").groupBy("query_id", "k").agg(
        F.count(F.lit(1)).alias("sources"), count_if(F.col("rank") <= k).alias("sources_covered"),
        F.min("rank").alias("source_first"),
    )
    rows = facts.join(sources, ["query_id", "k"], "left").join(
        single.withColumnRenamed("rank", "single_first"), "query_id", "left"
    )

    def reciprocal(rank: str) -> Column:
        return F.when(F.col(rank) <= k, F.lit(1.0) / F.col(rank)).otherwise(0.0)

    return rows.select(
        "query_id", "k", "facts", "covered", "sources", "sources_covered",
        (F.coalesce(F.col("single_first") <= k, F.lit(False))).cast("int").alias("single_hit"),
        reciprocal("single_first").alias("single_rr"), (F.col("covered") > 0).cast("int").alias("any_hit"),
        (F.col("covered") / F.col("facts")).alias("fact_recall"),
        (F.col("covered") == F.col("facts")).cast("int").alias("complete"), reciprocal("first").alias("prefix_rr"),
        (F.col("sources_covered") > 0).cast("int").alias("source_hit"),
        (F.col("sources_covered") / F.col("sources")).alias("source_recall"),
        reciprocal("source_first").alias("source_rr"),
    )


def depth_summary(scores: DataFrame) -> DataFrame:
    """Averages over answerable questions per K; micro rates divide sums."""
    def mean(c: str) -> Column:
        return F.avg(F.col(c).cast("double"))

    return scores.groupBy("k").agg(
        F.count(F.lit(1)).alias("answerable"), F.sum("single_hit").cast("long").alias("single_hits"),
        mean("single_rr").alias("single_mrr"), F.sum("any_hit").cast("long").alias("any_hits"),
        F.sum("covered").cast("long").alias("facts_covered"),
        (F.sum("covered") / F.sum("facts")).alias("fact_recall_micro"), mean("fact_recall").alias("fact_recall_macro"),
        F.sum("complete").cast("long").alias("complete"), mean("prefix_rr").alias("prefix_mrr"),
        F.sum("source_hit").cast("long").alias("source_hits"),
        (F.sum("sources_covered") / F.sum("sources")).alias("source_recall_micro"),
        mean("source_recall").alias("source_recall_macro"), mean("source_rr").alias("source_mrr"),
    )


def run_summary(rows: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Roll-up of evaluation rows; questions without an answer stay out of quality rates.

    ``rows``: expected, covered, no_answer, status, returned, rr, chars, distinct_sources,
    max_source_occupancy.
    """
    answerable = ~F.col("no_answer")
    failed = F.col("status").isin("error", "partial_failure")
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("queries"), count_if(answerable).alias("answerable"),
        F.sum(F.when(answerable, F.col("covered")).otherwise(0)).cast("long").alias("facts_covered"),
        F.sum(F.when(answerable, F.col("expected")).otherwise(0)).cast("long").alias("facts_expected"),
        count_if(answerable & (F.col("covered") > 0)).alias("any_fact_hits"),
        count_if(answerable & (F.col("covered") == F.col("expected"))).alias("complete"),
        count_if(~answerable & (F.col("returned") > 0)).alias("no_answer_nonempty"),
        count_if(failed).alias("failures"), F.avg(F.when(answerable, F.col("rr"))).alias("mean_rr"),
        F.avg(F.col("distinct_sources").cast("double")).alias("mean_distinct_sources"),
        F.avg("max_source_occupancy").alias("mean_max_source_occupancy"),
        F.sum("chars").cast("long").alias("context_chars"),
    )


def paired_outcomes(a: DataFrame, b: DataFrame, metric: str, key: str = "query_id") -> DataFrame:
    """Mean difference and wins, losses and ties (within 1e-12) of two runs on the same queries."""
    delta = F.col("a") - F.col("b")
    both = a.select(key, F.col(metric).alias("a")).join(b.select(key, F.col(metric).alias("b")), key)
    return both.agg(
        F.count(F.lit(1)).alias("questions"), F.avg(delta).alias("delta"),
        count_if(delta > 1e-12).alias("wins"), count_if(delta < -1e-12).alias("losses"),
        count_if(F.abs(delta) <= 1e-12).alias("ties"),
    )


def evidence_f1(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Best paragraph F1 over a question's annotations.

    2·|distinct predicted ∩ gold| / (|predicted| + |gold|); 1 where both are empty.
    ``predicted``: query_id, text. ``gold``: query_id, annotation_id, text (null = none).
    """
    sizes = predicted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_predicted"))
    gold_sizes = gold.groupBy("query_id", "annotation_id").agg(F.count("text").alias("n_gold"))
    hits = (
        gold.filter(F.col("text").isNotNull()).distinct()
        .join(predicted.distinct(), ["query_id", "text"])
        .groupBy("query_id", "annotation_id").agg(F.count(F.lit(1)).alias("correct"))
    )
    rows = gold_sizes.join(sizes, "query_id", "left").join(hits, ["query_id", "annotation_id"], "left")
    both = F.coalesce("n_predicted", F.lit(0)) + F.col("n_gold")
    f1 = F.when(both == 0, 1.0).otherwise(2.0 * F.coalesce("correct", F.lit(0)) / both)
    return rows.groupBy("query_id").agg(F.max(f1).alias("evidence_f1"))
