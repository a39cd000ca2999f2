"""Resampling against NumPy's own generator and against one scope at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bootstrap


@pytest.mark.parametrize("slots, iterations, block", [(7, 500, 1 << 10), (1, 100, 1 << 10), (1000, 40, 1 << 12), (3_000_000_000, 1, None)])
def test_draws_are_those_of_the_sequential_generator(spark, monkeypatch, slots, iterations, block):
    if block is None:
        # So many slots that many raw values are left out: compare the values themselves.
        raw = np.concatenate([bootstrap._raw_block(5, b) for b in range(2)])
        assert np.array_equal(bootstrap._bounded(raw, slots)[:10_000], np.random.default_rng(5).integers(0, slots, 10_000))
        return
    monkeypatch.setattr(bootstrap, "RAW_BLOCK", block)
    rng = np.random.default_rng(5)
    want = {}
    for i in range(iterations):
        for s in rng.integers(0, slots, slots).tolist():
            want[i, s] = want.get((i, s), 0) + 1
    got = {}
    for r in bootstrap.pcg_draws(spark, slots, iterations, 5).collect():
        got[r["resample"], r["slot"]] = got.get((r["resample"], r["slot"]), 0) + r["times"]
    if slots == 1:
        want = {(i, 0): 1 for i in range(iterations)}
    assert got == want


def test_query_bootstrap_equals_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random(23).round(2), rng.random(23).round(2)
    b[:4] = a[:4]
    rows = spark.createDataFrame([(i * 3, float(x), float(y), float(x > 0.5), float(y > 0.5)) for i, (x, y) in enumerate(zip(a, b))], "ord long, a_m double, b_m double, a_h double, b_h double")
    got = {r["metric"]: r for r in bootstrap.query_bootstrap(rows, ["m", "h"], 400, 9).collect()}
    draws = np.random.default_rng(9)
    picks = [draws.integers(0, 23, 23) for _ in range(400)]
    for name, delta in (("m", a - b), ("h", (a > 0.5).astype(float) - (b > 0.5))):
        low, high = np.quantile([delta[p].mean() for p in picks], [0.025, 0.975])
        r = got[name]
        assert (r["delta"], r["low"], r["high"]) == pytest.approx((delta.mean(), low, high))
        assert (r["wins"], r["losses"], r["ties"]) == ((delta > 1e-12).sum(), (delta < -1e-12).sum(), (abs(delta) <= 1e-12).sum())
    assert bootstrap.query_bootstrap(rows.limit(0), ["m"], 400, 9).count() == 0


def test_ratio_bootstrap_equals_numpy(spark):
    sums, counts = np.array([3, 0, 5, 1, 0]), np.array([4, 0, 9, 2, 0])
    rows = spark.createDataFrame([(i, int(s), int(c)) for i, (s, c) in enumerate(zip(sums, counts))], "ord long, s long, c long")
    row = bootstrap.ratio_bootstrap(rows, {"r": ("s", "c")}, 300, 3).first()
    draws = np.random.default_rng(3)
    values = []
    for _ in range(300):
        p = draws.integers(0, 5, 5)
        values.append(sums[p].sum() / counts[p].sum() if counts[p].sum() else 0.0)
    assert (row["value"], row["low"], row["high"], row["clusters"]) == pytest.approx((sums.sum() / counts.sum(), *np.quantile(values, [0.025, 0.975]), 5))


def test_scopes_equal_their_questions_alone(spark):
    rng = np.random.default_rng(4)
    rows = [("x" if i % 3 else "y", i, int(rng.integers(0, 9)), int(e := rng.integers(0, 4)), int(rng.integers(0, e + 1)), int(rng.integers(0, e + 1))) for i in range(60)]
    rows += [("one", 100, 3, 2, 1, 2), ("none", 101, 3, 0, 0, 0)]
    pairs = spark.createDataFrame(rows, "scope string, ord long, grp long, expected long, b_covered long, c_covered long")
    got = {(r["scope"], r["metric"]): r for r in bootstrap.scoped_bootstrap(pairs, 300, 11).collect()}
    for scope in ("x", "y", "one"):
        for r in bootstrap.paired_bootstrap(pairs.filter(F.col("scope") == scope), 300, 11).collect():
            other = got[scope, r["metric"]]
            for c in ("questions", "answerable", "groups", "baseline", "candidate", "delta", "low", "high", "valid_resamples"):
                assert other[c] == (pytest.approx(r[c]) if r[c] is not None else None), (scope, c)
    assert got["none", "fact_coverage"]["delta"] is None and got["one", "fact_coverage"]["low"] is None
    with pytest.raises(ValueError):
        bootstrap.scoped_bootstrap(pairs, 10, 11)
