"""Paired cluster bootstrap as one aggregation over (resample, draw) rows.

The 32-bit generator is a hash of a counter, so draw number n of the whole run depends only
on the seed and n. ``spark.range`` over all draws therefore reproduces the sequential stream
in parallel: resample = n div groups, drawn group = ⌊u·groups⌋.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import BROADCAST_ROW_LIMIT, cut_lineage, fits, small_side
from .metrics import count_if, order_statistics

# Step of the counter and the default seed and size of the resampling.
COUNTER_STEP = 0x6D2B79F5
DEFAULT_SEED = 20260916
DEFAULT_ITERATIONS = 10_000
_MASK = 0xFFFFFFFF


def _mul32(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers modulo 2^32, in 64 bits without overflow."""
    high = F.shiftrightunsigned(a, 16) * b
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + low).bitwiseAND(F.lit(_MASK))


def uniform_draw(number: Column, seed: int) -> Column:
    """The ``number``-th (from 1) uniform value in [0, 1) of the 32-bit counter generator."""
    # number·step stays below 2^63 for fewer than 2^32 draws; larger counters wrap first.
    state = (F.lit(seed) + _mul32(F.pmod(number, F.lit(1 << 32)), F.lit(COUNTER_STEP))).bitwiseAND(F.lit(_MASK))
    t = _mul32(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), state.bitwiseOR(F.lit(1)))
    inner = (t + _mul32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK))
    t = t.bitwiseXOR(inner)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)).cast("double") / F.lit(4294967296.0)


def draws(spark: SparkSession, groups: int, iterations: int, seed: int) -> DataFrame:
    """(resample, slot): which of ``groups`` numbered clusters each draw picks."""
    numbers = spark.range(0, groups * iterations)
    u = uniform_draw(F.col("id") + 1, seed)
    return numbers.select(
        F.expr(f"id div {groups}").alias("resample"), F.floor(u * groups).cast("long").alias("slot")
    )


def cluster_totals(pairs: DataFrame) -> DataFrame:
    """Sums per intent group, groups numbered by the first question of each.

    ``pairs``: ord, grp, b_covered, c_covered, expected. Groups without any answerable
    question are left out of the resampling.
    """
    answerable = F.col("expected") > 0

    def full(c: str) -> Column:
        return F.sum((answerable & (F.col(c) == F.col("expected"))).cast("long"))

    totals = pairs.groupBy("grp").agg(
        F.min("ord").alias("first"), F.sum("expected").alias("expected"), F.sum("b_covered").alias("b_covered"),
        F.sum("c_covered").alias("c_covered"), F.sum(answerable.cast("long")).alias("answerable"),
        full("b_covered").alias("b_complete"), full("c_covered").alias("c_complete"),
    )
    return totals.filter(F.col("answerable") > 0)


def number_groups(totals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Slots 0..G−1 in order of first appearance, for each value of ``keys``.

    Positions are counted per range of 2^16 ordinals and offset by a cumulative count of the
    ranges, so no single task sorts all groups.
    """
    ranged = totals.withColumn("part", F.expr("first div 65536"))
    sizes = ranged.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    # One row per 65,536 ordinals; the window over it stays small.
    offsets = sizes.select(*keys, "part", (F.sum("n").over(W.partitionBy(*keys).orderBy("part")) - F.col("n")).alias("offset"))
    inside = F.row_number().over(W.partitionBy(*keys, "part").orderBy("first")) - 1
    return ranged.withColumn("inside", inside).join(offsets, [*keys, "part"]).select(
        (F.col("offset") + F.col("inside")).cast("long").alias("slot"), *[c for c in totals.columns]
    )


def resample_deltas(pairs: DataFrame, iterations: int = DEFAULT_ITERATIONS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Candidate minus baseline per resample: fact coverage and complete evidence."""
    if not 100 <= iterations <= 100_000:
        raise ValueError("iterations must lie in [100, 100000]")
    if not 0 <= seed <= _MASK:
        raise ValueError("seed must be an unsigned 32-bit integer")
    slots = number_groups(cluster_totals(pairs))
    groups = slots.count()
    if 1 < groups <= BROADCAST_ROW_LIMIT:
        return _deltas_in_tasks(slots, groups, iterations, seed)
    small = fits(slots, BROADCAST_ROW_LIMIT)
    picked = draws(pairs.sparkSession, groups if groups > 1 else 0, iterations, seed) if groups > 1 else (
        pairs.sparkSession.range(0).select(F.col("id").alias("resample"), F.col("id").alias("slot"))
    )
    joined = picked.join(small_side(slots, small), "slot")
    return joined.groupBy("resample").agg(
        (F.sum("c_covered") / F.sum("expected") - F.sum("b_covered") / F.sum("expected")).alias("fact_delta"),
        (F.sum("c_complete") / F.sum("answerable") - F.sum("b_complete") / F.sum("answerable")).alias("complete_delta"),
    )


def paired_bootstrap(pairs: DataFrame, iterations: int = DEFAULT_ITERATIONS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Observed rates and 95 % interval per metric; no interval for fewer than two groups."""
    answerable = F.col("expected") > 0

    def rate(metric: str, side: str) -> Column:
        if metric == "fact_coverage":
            return F.try_divide(F.sum(f"{side}_covered"), F.sum("expected"))
        return F.avg(F.when(answerable, (F.col(f"{side}_covered") == F.col("expected")).cast("double")))

    # A few thousand rows read several times below: one row per resample.
    deltas = cut_lineage(resample_deltas(pairs, iterations, seed))
    out = None
    for metric, column in (("fact_coverage", "fact_delta"), ("complete_evidence", "complete_delta")):
        observed = pairs.agg(
            F.lit(metric).alias("metric"), F.count(F.lit(1)).alias("questions"),
            F.sum(answerable.cast("long")).alias("answerable"), F.countDistinct("grp").alias("groups"),
            rate(metric, "b").alias("baseline"), rate(metric, "c").alias("candidate"),
        ).withColumn("delta", F.col("candidate") - F.col("baseline"))
        bounds = order_statistics(deltas, column, [0.025, 0.975], kind="linear").agg(
            F.max(F.when(F.col("p") == 0.025, F.col("quantile"))).alias("low"),
            F.max(F.when(F.col("p") == 0.975, F.col("quantile"))).alias("high"),
            F.coalesce(F.max("values"), F.lit(0)).alias("valid_resamples"),
        )
        row = observed.join(F.broadcast(bounds))  # two single-row frames
        out = row if out is None else out.unionByName(row)
    return out


_SUMS = ("expected", "b_covered", "c_covered", "answerable", "b_complete", "c_complete")


def _deltas_in_tasks(slots: DataFrame, groups: int, iterations: int, seed: int) -> DataFrame:
    """As :func:`resample_deltas` for groups few enough to broadcast: a task draws and adds up its resamples, no draw is a row."""
    spark = slots.sparkSession
    shared = spark.sparkContext.broadcast(np.column_stack([c.to_numpy() for c in slots.orderBy("slot").select(*_SUMS).toArrow().columns]).astype(np.int64))
    step = max(1, DRAWS_AT_ONCE // groups)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = shared.value
        for batch in batches:
            for block in batch.column("id").to_pylist():
                first, last = block * step, min((block + 1) * step, iterations)
                numbers = np.arange(first * groups, last * groups)
                picked = np.floor(_uniform(numbers + 1, seed) * groups).astype(np.int64)
                sums = [totals[:, k][picked].reshape(-1, groups).sum(axis=1) for k in range(len(_SUMS))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), *map(pa.array, sums)], names=["resample", *_SUMS])

    blocks = -(-iterations // step)
    sums = spark.range(0, blocks, 1, min(blocks, 8 * spark.sparkContext.defaultParallelism)).mapInArrow(emit, ", ".join(f"{c} long" for c in ("resample", *_SUMS)))
    c = F.col
    return sums.select(
        "resample", (c("c_covered") / c("expected") - c("b_covered") / c("expected")).alias("fact_delta"),
        (c("c_complete") / c("answerable") - c("b_complete") / c("answerable")).alias("complete_delta"),
    )


# --- several scopes in one resampling -----------------------------------------------------
ITERATION_BLOCK = 256
DRAWS_AT_ONCE = 1 << 20


def _uniform(numbers: np.ndarray, seed: int) -> np.ndarray:
    """``uniform_draw`` of many numbers at once."""
    mask = np.uint64(_MASK)
    state = (np.uint64(seed) + (numbers.astype(np.uint64) & mask) * np.uint64(COUNTER_STEP)) & mask
    t = (state ^ (state >> np.uint64(15))) * (state | np.uint64(1)) & mask
    t ^= (t + ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61)) & mask)) & mask
    return (t ^ (t >> np.uint64(14))) / 4294967296.0


def _scoped_draws(sizes: DataFrame, iterations: int, seed: int) -> DataFrame:
    """(scope, resample, slot, times): the stream of ``draws`` begun anew for each scope of ``sizes`` (scope, groups)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scope, groups, block in zip(*(batch.column(c).to_pylist() for c in ("scope", "groups", "block"))):
                for first in range(block, min(block + ITERATION_BLOCK, iterations), max(1, DRAWS_AT_ONCE // groups)):
                    last = min(block + ITERATION_BLOCK, iterations, first + max(1, DRAWS_AT_ONCE // groups))
                    numbers = np.arange(first * groups, last * groups)
                    slots = np.floor(_uniform(numbers + 1, seed) * groups).astype(np.int64)
                    pairs, times = np.unique(numbers // groups * groups + slots, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([scope] * len(pairs), pa.string()), pa.array(pairs // groups), pa.array(pairs % groups), pa.array(times)],
                        names=["scope", "resample", "slot", "times"],
                    )

    blocks = sizes.select("scope", "groups", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(ITERATION_BLOCK))).alias("block"))
    # A row for each scope and block of resamples: they spread over the cluster, and each is drawn in its task.
    return blocks.repartition("scope", "block").mapInArrow(emit, "scope string, resample long, slot long, times long")


def scoped_bootstrap(pairs: DataFrame, iterations: int = DEFAULT_ITERATIONS, seed: int = DEFAULT_SEED) -> DataFrame:
    """``paired_bootstrap`` for every scope of ``pairs`` (scope, ord, grp, expected, b_covered, c_covered) in one job.

    Groups are numbered within their scope, and each scope draws from the beginning of the stream, so a scope's row equals
    that of its questions alone. A scope of fewer than two groups has no interval.
    """
    if not 100 <= iterations <= 100_000:
        raise ValueError("iterations must lie in [100, 100000]")
    if not 0 <= seed <= _MASK:
        raise ValueError("seed must be an unsigned 32-bit integer")
    answerable = F.col("expected") > 0

    def full(side: str) -> Column:
        return (answerable & (F.col(side) == F.col("expected"))).cast("long")

    totals = pairs.groupBy("scope", "grp").agg(
        F.min("ord").alias("first"), F.sum("expected").alias("expected"), F.sum(answerable.cast("long")).alias("answerable"),
        *[F.sum(f"{x}_covered").alias(f"{x}_covered") for x in "bc"], *[F.sum(full(f"{x}_covered")).alias(f"{x}_complete") for x in "bc"],
    ).filter(F.col("answerable") > 0)
    slots = cut_lineage(number_groups(totals, ("scope",)))
    sizes = slots.groupBy("scope").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    picked = _scoped_draws(sizes, iterations, seed)
    joined = picked.join(small_side(slots, fits(slots, BROADCAST_ROW_LIMIT)), ["scope", "slot"])
    total = lambda c: F.sum(F.col("times") * F.col(c))
    over = {"fact_coverage": ("covered", "expected"), "complete_evidence": ("complete", "answerable")}
    deltas = joined.groupBy("scope", "resample").agg(
        *[(total(f"c_{top}") / total(below) - total(f"b_{top}") / total(below)).alias(name) for name, (top, below) in over.items()]
    )
    deltas = cut_lineage(deltas.select("scope", F.expr(f"stack(2, {', '.join(f"'{n}', {n}" for n in over)}) as (metric, delta)")))
    bounds = order_statistics(deltas, "delta", [0.025, 0.975], ("scope", "metric"), "linear").groupBy("scope", "metric").agg(
        F.max(F.when(F.col("p") == 0.025, F.col("quantile"))).alias("low"), F.max(F.when(F.col("p") == 0.975, F.col("quantile"))).alias("high"),
        F.max("values").alias("valid_resamples"),
    )
    seen = pairs.groupBy("scope").agg(
        F.count(F.lit(1)).alias("questions"), F.sum(answerable.cast("long")).alias("answerable"), F.countDistinct("grp").alias("groups"),
        *[F.try_divide(F.sum(f"{x}_covered"), F.sum("expected")).alias(f"{x}_fact_coverage") for x in "bc"],
        *[F.avg(F.when(answerable, full(f"{x}_covered").cast("double"))).alias(f"{x}_complete_evidence") for x in "bc"],
    )
    rows = seen.select(
        "scope", "questions", "answerable", "groups",
        F.expr(f"stack(2, {', '.join(f"'{n}', b_{n}, c_{n}" for n in over)}) as (metric, baseline, candidate)"),
    )
    return rows.withColumn("delta", F.col("candidate") - F.col("baseline")).join(bounds, ["scope", "metric"], "left").fillna(0, ["valid_resamples"])


# --- resampling with the PCG64 stream -----------------------------------------------------
PCG_SEED = 20260922
RAW_BLOCK = 1 << 18


def _raw_block(seed: int, block: int) -> np.ndarray:
    """32-bit values number ``block`` · RAW_BLOCK and on of the generator, reached by jumping ahead."""
    generator = np.random.PCG64(seed)
    generator.advance(block * (RAW_BLOCK // 2))
    raw = generator.random_raw(RAW_BLOCK // 2)
    out = np.empty(RAW_BLOCK, dtype=np.uint64)
    out[0::2], out[1::2] = raw & np.uint64(_MASK), raw >> np.uint64(32)
    return out


def _bounded(raw: np.ndarray, n: int) -> np.ndarray:
    """Values below ``n`` of a raw stream: high halves of raw · n, without those whose low half would favour some values."""
    product = raw * np.uint64(n)
    return (product[(product & np.uint64(_MASK)) >= np.uint64(((1 << 32) - n) % n)] >> np.uint64(32)).astype(np.int64)


def pcg_draws(spark: SparkSession, slots: int, iterations: int, seed: int = PCG_SEED) -> DataFrame:
    """(resample, slot, times) of ``iterations`` resamples, ``slots`` draws each, as NumPy's default generator draws them one after another.

    Whether a raw value counts does not depend on its place, so blocks are counted side by side; a cumulative count
    says which draw each block begins with, and blocks are made again from there.
    """
    if not 1 <= slots < 1 << 32:
        raise ValueError("slots must lie in [1, 2^32)")
    if slots == 1:
        return spark.range(iterations).select(F.col("id").alias("resample"), F.lit(0).cast("long").alias("slot"), F.lit(1).cast("long").alias("times"))
    total = slots * iterations
    share = ((1 << 32) - slots) % slots / (1 << 32)
    blocks = int((total / (1 - share) + 1000 + 20 * (total * share) ** 0.5) // RAW_BLOCK) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([len(_bounded(_raw_block(seed, b), slots)) for b in own], pa.int64())], names=["block", "n"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, before in zip(batch.column("block").to_pylist(), batch.column("before").to_pylist()):
                values = _bounded(_raw_block(seed, block), slots)[: max(0, total - before)]
                pairs = (before + np.arange(len(values))) // slots * slots + values
                pairs, times = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs // slots), pa.array(pairs % slots), pa.array(times)], names=["resample", "slot", "times"])

    parts = max(1, min(blocks, 8 * spark.sparkContext.defaultParallelism))
    counts = cut_lineage(spark.range(0, blocks, 1, parts).mapInArrow(counted, "block long, n long"))
    starts = counts.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("before"))  # one small row for each 2^18 values
    return starts.repartition(parts, "block").mapInArrow(drawn, "resample long, slot long, times long")


def _interval(deltas: DataFrame) -> DataFrame:
    """metric, low, high of ``deltas`` (metric, value)."""
    found = order_statistics(deltas, "value", [0.025, 0.975], ("metric",), "linear")
    return found.groupBy("metric").agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in ((0.025, "low"), (0.975, "high"))])


def query_bootstrap(rows: DataFrame, metrics: Sequence[str], iterations: int = DEFAULT_ITERATIONS, seed: int = PCG_SEED) -> DataFrame:
    """Mean difference, wins, losses, ties (within 1e-12) and 95 % interval of several metrics over the same resampled queries.

    ``rows``: ord (order of the queries), and a_<metric> and b_<metric> for each metric.
    """
    values = cut_lineage(number_groups(rows.select(F.col("ord").alias("first"), *[(F.col(f"a_{m}") - F.col(f"b_{m}")).cast("double").alias(m) for m in metrics])))
    n = values.count()
    stack = F.expr(f"stack({len(metrics)}, {', '.join(f"'{m}', `{m}`" for m in metrics)}) as (metric, value)")
    observed = values.select(stack).groupBy("metric").agg(
        F.count(F.lit(1)).alias("questions"), F.avg("value").alias("delta"), count_if(F.col("value") > 1e-12).alias("wins"),
        count_if(F.col("value") < -1e-12).alias("losses"), count_if(F.abs("value") <= 1e-12).alias("ties"),
    )
    if not n:
        return observed.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    picked = pcg_draws(rows.sparkSession, n, iterations, seed).join(small_side(values, n <= BROADCAST_ROW_LIMIT), "slot")
    means = picked.groupBy("resample").agg(*[(F.sum(F.col("times") * F.col(m)) / n).alias(m) for m in metrics])
    return observed.join(_interval(cut_lineage(means.select(stack))), "metric", "left")


def ratio_bootstrap(clusters: DataFrame, ratios: dict[str, tuple[str, str]], iterations: int = DEFAULT_ITERATIONS, seed: int = PCG_SEED) -> DataFrame:
    """metric, clusters, value and 95 % interval of ratios of sums, whole clusters resampled; a resample without count has the ratio 0.

    ``clusters``: ord and the columns that ``ratios`` names as (sum, count) for each metric.
    """
    columns = sorted({c for pair in ratios.values() for c in pair})
    values = cut_lineage(number_groups(clusters.select(F.col("ord").alias("first"), *columns)))
    n = values.count()
    stack = F.expr(f"stack({len(ratios)}, {', '.join(f"'{m}', `{m}`" for m in ratios)}) as (metric, value)")

    def ratio(top: str, below: str, times: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(times * F.col(top)).cast("double"), F.sum(times * F.col(below)).cast("double")), F.lit(0.0))

    observed = values.agg(F.count(F.lit(1)).alias("clusters"), *[ratio(*pair, F.lit(1)).alias(m) for m, pair in ratios.items()]).select("clusters", stack)
    if not n:
        return observed.limit(0).withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    picked = pcg_draws(clusters.sparkSession, n, iterations, seed).join(small_side(values, n <= BROADCAST_ROW_LIMIT), "slot")
    sums = picked.groupBy("resample").agg(*[ratio(*pair, F.col("times")).alias(m) for m, pair in ratios.items()])
    return observed.join(_interval(cut_lineage(sums.select(stack))), "metric", "left")
