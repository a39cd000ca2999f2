"""Lanes of many queries: floors and group bounds leave the same chunks as all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import RetrievalOptions
from lodestone.functions import plain
from lodestone.operators import lexical as lx, matching, pruning


@pytest.mark.parametrize("engine, weight", [("bm25plus", 0.0), ("bm25plus", 2.0), ("fts", 2.0)])
def test_a_lane_of_many_queries_equals_all_pairs(spark, monkeypatch, engine, weight):
    """Blocks by length, copies that tie at the cut, titles, null keys, empty and absent queries, repeated turns, texts that are not plain."""
    for name, value in (("LEAST_HITS", 12), ("CHUNKS", 9), ("FIRST_CHUNKS", 8)):
        monkeypatch.setattr(pruning, name, value)
    monkeypatch.setattr(matching, "MANY_PAIRS", 0)
    rng, words = random.Random(3), [f"w{i}" for i in range(30)]
    pick = lambda n: " ".join(words[min(29, int(rng.expovariate(0.2)))] for _ in range(n))
    rows = [(f"c{(i * 7) % 90:02d}", pick(rng.choice((1, 3, 8, 40))), pick(1) if i % 2 else "") for i in range(60)]
    rows += [(f"d{i}", rows[5][1], "") for i in range(12)] + [("none", None, None), ("odd", "w1 数据 w2", "")]
    terms = lx.term_table(spark.createDataFrame(rows, "chunk_id string, text string, title string"), title=F.coalesce("title", F.lit("")))
    asked = [(i, 1 if i % 2 else None, pick(rng.randint(1, 12))) for i in range(40)] + [(50, 1, "absent"), (51, 1, ""), (52, 1, None)]
    asked = spark.createDataFrame(asked, "query_id int, part int, text string")
    options, keys = RetrievalOptions(lexical_engine=engine, title_weight=weight, bm25_candidates=4), ("query_id", "part")
    scores = lx.lexical_scores(terms, asked.fillna(-1, ["part"]), options, keys=keys)
    want = lx.top_candidates(scores, 4, keys)
    row = lambda r: (r["query_id"], -1 if r["part"] is None else r["part"], r["rank"], r["chunk_id"], round(r["score"], 8))
    want = sorted(map(row, want.collect()))
    for limit in (1 << 30, 40):
        monkeypatch.setattr(matching, "QUERY_TERMS", limit)
        lane = lx.lexical_lane(terms, asked, options, keys=keys)
        assert sorted(map(row, lane.collect())) == want
    assert "matched-by-length" in str(lane.inputFiles())


def test_blocks_of_queries_share_one_pass_over_the_texts(spark, monkeypatch):
    monkeypatch.setattr(matching, "QUERY_TERMS", 5)
    passes, match = [], matching.match_texts
    monkeypatch.setattr(matching, "match_texts", lambda *a, **k: passes.append(1) or match(*a, **k))
    terms = lx.term_table(spark.createDataFrame([(i, f"red w{i}") for i in range(9)], "chunk_id int, text string"))
    asked = spark.createDataFrame([(i, f"red green w{i}") for i in range(12)], "query_id int, text string")
    lane = lx.lexical_lane(terms, asked, RetrievalOptions(bm25_candidates=2), title=False)
    first = {r["query_id"]: r["chunk_id"] for r in lane.filter("rank = 1").collect()}
    assert first == {i: i if i < 9 else 0 for i in range(12)}
    assert len(passes) == 1


@pytest.mark.parametrize("group, share, own_share, room", [(1, 64, 64, 1 << 20), (4, 4, 2, 1 << 20), (2, 1 << 20, 1 << 20, 1 << 20), (4, 1, 1, 1 << 20), (8, 64, 64, 600)])
def test_a_block_finds_the_best_of_each_query(monkeypatch, group, share, own_share, room):
    """Against sums of all postings, with groups, rows for few or all ids, and copies beyond the cut."""
    for name, value in (("GROUPS", ((1 << 30, group),)), ("SHARE", share), ("OWN_SHARE", own_share), ("ROW_BYTES", room), ("CELLS", 700), ("PAIRS", 1 << 20)):
        monkeypatch.setattr(pruning, name, value)
    rng = np.random.default_rng(group)
    chunks, size, n = 203, 60, 5
    held = rng.random((chunks, size)) < np.geomspace(0.9, 0.01, size)
    held[40:60] = held[40]
    held[100:110, -8:] = True  # neighbours that share a query's rare terms: their levels must not add up
    weight = np.where(held, rng.random((chunks, size)) * np.geomspace(0.2, 9, size) + 0.01, 0)
    weight[40:60] = weight[40]
    row, ids = np.nonzero(held)
    queries = [np.sort(rng.choice(size, rng.integers(0, 12), replace=False)) for _ in range(50)] + [np.array([3, 3, 7]), np.array([59]), np.array([57, 58]), np.arange(52, 60)]
    starts = np.concatenate(([0], np.cumsum([len(q) for q in queries])))
    block = pruning.Block(chunks, row.astype(np.int32), ids.astype(np.int32), weight[row, ids], size, starts, np.concatenate(queries).astype(np.int64))
    lower = np.concatenate(list(block.lower(n, len(queries), 7)))
    total = np.round(np.array([weight[:, q].sum(axis=1) for q in queries]), 9)
    want = set()
    for q, scores in enumerate(total):
        for c in np.lexsort((np.arange(chunks), -scores))[:n]:
            if scores[c] > 0:
                want.add((q, int(c), float(scores[c])))
    nth = np.sort(total, axis=1)[:, -n]
    assert (lower.min(axis=1) <= nth).all() and (lower.min(axis=1) >= nth * 0.98 - 0.05).all()
    for floor in (np.zeros(len(queries)), lower.min(axis=1).astype(np.float64)):
        found = [set(zip(q.tolist(), c.tolist(), s.tolist())) for q, c, s in block.best(floor, n, 9)]
        got = set().union(*found)
        assert {(q, c, round(s, 8)) for q, c, s in want} == {(q, c, round(s, 8)) for q, c, s in got}


def test_hashes_of_whole_terms_are_those_of_texts(monkeypatch):
    import pyarrow as pa

    terms = ["", "a", "naïve", "数据", "w" * 50, "x1"]
    whole = plain.term_hashes(pa.array(terms))
    monkeypatch.setattr(plain, "SLICE_BYTES", 3)
    assert (plain.term_hashes(pa.array(terms)) == whole).all()
    value, row = plain.Hasher().terms(np.frombuffer(b"a x1", dtype=np.uint8), np.array([0]))[2], [1, 5]
    assert set(whole[row].tolist()) <= set((value & plain.HASH_MASK).tolist())
