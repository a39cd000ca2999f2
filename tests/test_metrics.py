"""Order statistics, ranking metrics, coverage and bootstrap against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bootstrap, coverage, maintenance, metrics


def test_order_statistics_are_exact_for_skewed_groups(spark):
    rng = random.Random(2)
    rows = [("hot", round(rng.expovariate(0.1), 2)) for _ in range(3000)] + [("one", 5.0), ("two", 1.0), ("two", 4.0)]
    rows += [("same", 7.0)] * 500 + [("same", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.025, 0.5, 0.95, 0.975, 1.0]
    for kind in ("nearest", "linear"):
        got = {(r["g"], r["p"]): r["quantile"] for r in metrics.order_statistics(df, "v", probs, ("g",), kind, 16).collect()}
        for g in ("hot", "one", "two", "same"):
            xs = sorted(v for n, v in rows if n == g and v is not None)
            for p in probs:
                want = xs[max(0, math.ceil(len(xs) * p) - 1)] if kind == "nearest" else float(np.quantile(xs, p))
                assert got[(g, p)] == pytest.approx(want, abs=1e-9), (kind, g, p)


def test_ranking_metrics(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, chunk_id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (1, "z", 1), (2, "y", 1), (3, "q", 1), (1, "a", 0)], "query_id int, chunk_id string, rel int")
    got = {r["query_id"]: r for r in metrics.ranking_metrics(run, qrels, qrels.select("query_id").distinct()).collect()}
    dcg = 2 / math.log2(3) + 1 / math.log2(4)
    ideal = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert got[1]["ndcg"] == pytest.approx(dcg / ideal) and got[1]["recall"] == pytest.approx(2 / 3)
    assert got[1]["mrr"] == 0.5 and got[1]["hit"] == 1
    assert got[2]["ndcg"] == got[3]["ndcg"] == 0 and got[3]["hit"] == 0


def alpha_dcg(order, nuggets, k=10):
    seen, total = {}, 0.0
    for rank, doc in enumerate(order[:k], 1):
        for n in nuggets.get(doc, ()):
            total += 0.5 ** seen.get(n, 0) / math.log2(rank + 1)
            seen[n] = seen.get(n, 0) + 1
    return total


def test_alpha_ndcg_against_greedy_over_all_documents(spark):
    rng = random.Random(8)
    rows, runs, want = [], [], {}
    for q in range(6):
        docs = {f"d{i:02d}": {n for n in "abcd" if rng.random() < 0.35} for i in range(25)}
        nuggets = {d: s for d, s in docs.items() if s}
        rows += [(q, n, d, 1) for d, s in docs.items() for n in s] + [(q, "e", "d00", 0)]
        order = rng.sample(sorted(docs), 12)
        runs += [(q, d, i) for i, d in enumerate(order, 1)]
        left, ideal = sorted(nuggets), []
        while left and len(ideal) < 10:
            counts = {}
            for d in ideal:
                for n in nuggets[d]:
                    counts[n] = counts.get(n, 0) + 1
            best = max(left, key=lambda d: (sum(0.5 ** counts.get(n, 0) for n in nuggets[d]), [-ord(c) for c in d]))
            ideal.append(best)
            left.remove(best)
        want[q] = alpha_dcg(order, nuggets) / alpha_dcg(ideal, nuggets)
    run = spark.createDataFrame(runs, "query_id int, chunk_id string, rank int")
    nug = spark.createDataFrame(rows, "query_id int, nugget_id string, chunk_id string, rel int")
    got = {r["query_id"]: r["alpha_ndcg"] for r in metrics.alpha_ndcg(run, nug).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def evaluation_frames(spark, pieces, anchors, lines, required):
    return (
        spark.createDataFrame(pieces, "query_id string, rank int, source_id string, start_line int, end_line int, text string"),
        spark.createDataFrame(anchors, "fact_id string, source_id string, start_line int, end_line int"),
        spark.createDataFrame(lines, "source_id string, line_no int, text string"),
        spark.createDataFrame(required, "query_id string, fact_id string"),
    )


def test_line_coverage_unions_pieces_and_requires_exact_lines(spark):
    lines = [("a", 1, "one"), ("a", 2, ""), ("a", 3, "two"), ("b", 1, "alternate"), ("z", 1, "?"), ("z", 2, "?")]
    anchors = [("f", "a", 1, 3), ("f", "b", 1, 1)]
    pieces = [
        ("split", 1, "a", 1, 1, "one"), ("split", 2, "a", 3, 3, "two"), ("alt", 1, "b", 1, 1, "alternate"),
        ("third", 1, "z", 1, 1, "?"), ("third", 2, "z", 2, 2, "?"), ("third", 3, "b", 1, 1, "alternate"),
        ("wrong", 1, "b", 1, 1, "incorrect"), ("half", 1, "a", 1, 1, "one"),
    ]
    required = [(q, "f") for q in ("split", "alt", "third", "wrong", "half", "empty")]
    p, a, l, r = evaluation_frames(spark, pieces, anchors, lines, required)
    ranks = coverage.line_coverage(p, a, l, r)
    got = {x["query_id"]: x["rank"] for x in ranks.collect()}
    assert got == {"split": 2, "alt": 1, "third": 3, "wrong": None, "half": None, "empty": None}
    single = metrics.single_piece_rank(p, a, l, r)
    assert {x["query_id"]: x["rank"] for x in single.collect()} == {"alt": 1, "third": 3}
    relevant = a.select("source_id").distinct().crossJoin(r.select("query_id"))  # tiny fixture
    seen = p.groupBy("query_id", "source_id").agg(F.min("rank").alias("rank"))
    hits = relevant.join(seen, ["query_id", "source_id"], "left")
    questions = r.select("query_id").withColumn("no_answer", F.lit(False))
    rows = {(x["query_id"], x["k"]): x for x in metrics.question_scores(questions, ranks, single, hits).collect()}
    assert rows[("split", 1)]["covered"] == 0 and rows[("split", 3)]["covered"] == 1
    assert rows[("split", 3)]["single_rr"] == 0 and rows[("split", 3)]["prefix_rr"] == 0.5
    assert rows[("alt", 10)]["fact_recall"] == 1 and rows[("alt", 10)]["source_recall"] == 0.5
    assert rows[("third", 1)]["single_hit"] == 0 and rows[("third", 3)]["single_rr"] == pytest.approx(1 / 3)
    assert rows[("wrong", 10)]["single_hit"] == 0 and rows[("wrong", 10)]["source_hit"] == 1


def test_passages_are_located_exactly(spark):
    docs = [(1, "zero one two three four five six\nseven eight nine"), (2, "xone two three four five six y"), (3, "one two three four five")]
    passages = [(7, "one two three four five six"), (8, "two three four"), (9, "six\nseven eight"), (10, "e two three four five s")]
    d = spark.createDataFrame(docs, "source_id int, text string")
    p = spark.createDataFrame(passages, "passage_id int, text string")
    found = coverage.locate_passages(d, p)
    got = {(r["passage_id"], r["source_id"]): r["offset"] for r in found.collect()}
    assert got == {(p, d): t.index(x) + 1 for p, x in passages for d, t in docs if x in t}
    anchors = {(r["passage_id"], r["source_id"]): (r["start_line"], r["end_line"]) for r in coverage.line_anchors(found).collect()}
    assert anchors[(9, 1)] == (1, 2) and anchors[(7, 2)] == (1, 1)


def test_interval_union(spark):
    spans = [("a", 0, 10, 0, 4), ("a", 0, 10, 4, 10), ("b", 0, 10, 0, 4), ("b", 0, 10, 5, 10), ("c", 2, 5, 0, 9), ("d", 0, 10, 0, 9)]
    df = spark.createDataFrame(spans, "k string, begin int, finish int, left int, right int")
    assert {r["k"]: r["covered"] for r in coverage.span_gaps(df, ("k",)).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_host_read_takes_the_longest_fitting_prefix(spark):
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(["aaaa", 'b"b', "", "cccc"], 1)], "source_id string, line_no int, text string")
    budget = lambda b: spark.createDataFrame([("k", "s", 1, 4, 10, b)], "key string, source_id string, section_start_line int, section_end_line int, fixed int, budget int")
    # cost(n) = 10 + digits + escaped text of lines 1..n joined by \n
    costs = [10 + 1 + 4, 10 + 1 + 4 + 2 + 4, 10 + 1 + 4 + 2 + 4 + 2, 10 + 1 + 4 + 2 + 4 + 2 + 2 + 4]
    for n, cost in enumerate(costs, 1):
        row = coverage.host_read(budget(cost), lines).first()
        assert (row["end_line"], row["cost"]) == (n, cost)
    assert coverage.host_read(budget(14), lines).count() == 0


def counter_stream(seed, n):
    """Sequential 32-bit generator, stepped one state at a time."""
    m, state, out = 0xFFFFFFFF, seed, []
    for _ in range(n):
        state = (state + 0x6D2B79F5) & m
        t = ((state ^ (state >> 15)) * (state | 1)) & m
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & m)) & m
        out.append((t ^ (t >> 14)) / 4294967296)
    return out


def test_draws_reproduce_the_sequential_stream(spark):
    df = spark.range(1, 501).select(bootstrap.uniform_draw(F.col("id"), 20260916).alias("u"))
    assert [r["u"] for r in df.collect()] == counter_stream(20260916, 500)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "ord long, grp string, b_covered long, c_covered long, expected long")


def test_bootstrap_hand_cases(spark):
    rows = pairs(spark, [(0, "one", 0, 1, 1), (1, "two", 0, 3, 3)])
    for r in bootstrap.paired_bootstrap(rows, 1000, 7).collect():
        assert (r["baseline"], r["candidate"], r["delta"], r["low"], r["high"], r["valid_resamples"]) == (0, 1, 1, 1, 1, 1000)
    skew = pairs(spark, [(i, "positive", 0, 1, 1) for i in range(20)] + [(20, "negative", 1, 0, 1)])
    r = {x["metric"]: x for x in bootstrap.paired_bootstrap(skew, 1000, 7).collect()}["fact_coverage"]
    assert r["delta"] == pytest.approx(19 / 21) and (r["low"], r["high"]) == (-1, 1) and r["groups"] == 2
    alone = bootstrap.paired_bootstrap(pairs(spark, [(0, "one", 0, 1, 1), (1, "none", 0, 0, 0)]), 100, 1).first()
    assert alone["low"] is None and alone["valid_resamples"] == 0


def test_bootstrap_equals_sequential_resampling(spark):
    rng = random.Random(4)
    rows = [(i, f"g{i % 7}", rng.randint(0, 2), rng.randint(0, 2), 2) for i in range(40)]
    got = {r["metric"]: r for r in bootstrap.paired_bootstrap(pairs(spark, rows), 200, 99).collect()}["fact_coverage"]
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    groups, u, deltas = list(groups.values()), iter(counter_stream(99, 1400)), []
    for _ in range(200):
        items = list(itertools.chain(*[groups[int(next(u) * 7)] for _ in range(7)]))
        deltas.append(sum(x[3] for x in items) / sum(x[4] for x in items) - sum(x[2] for x in items) / sum(x[4] for x in items))
    assert got["low"] == pytest.approx(np.quantile(deltas, 0.025)) and got["high"] == pytest.approx(np.quantile(deltas, 0.975))


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id int, v string").repartition(3)
    c = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    fp = lambda d: maintenance.fingerprint(d, "id", "v").first()["fingerprint"]
    assert fp(a) == fp(b) != fp(c)
