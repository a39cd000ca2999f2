"""Dense lane, fusion, selection and packing against plain-Python walks."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import RetrievalOptions, SearchFilters, parse_filters, parse_request
from lodestone.errors import RetrievalError, bounded_error, classify
from lodestone.functions import preview as pv
from lodestone.functions.vectors import cosine, unit_vector
from lodestone.operators import dense, fusion, packing, selection


def brute_top(vectors, queries, n, floor):
    out = {}
    for qid, q in queries:
        sims = []
        for cid, v in vectors:
            s = round(float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v))), 9)
            if s >= floor:
                sims.append((-s, cid))
        out[qid] = [c for _, c in sorted(sims)[:n]]
    return out


@pytest.mark.parametrize("limit", [10_000, 40])
def test_dense_lane_equals_brute_force_with_ties(spark, limit):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    vectors = [(i, base[i % 30].tolist()) for i in range(200)]  # many exact copies
    queries = [(i, rng.normal(size=8).tolist()) for i in range(12)]
    schema = "{} int, embedding array<float>"
    as_float = lambda rows: [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    v = spark.createDataFrame(vectors, schema.format("chunk_id")).repartition(3)
    q = spark.createDataFrame(queries, schema.format("query_id"))
    options = RetrievalOptions(dense_candidates=10, min_dense_similarity=-0.2)
    found = dense.dense_scores(v, q, 10, -0.2, query_float_limit=limit)
    got = {}
    from lodestone.operators.lexical import top_candidates

    for r in top_candidates(found, options.dense_candidates, by="similarity").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    want = brute_top([(i, np.array(x)) for i, x in as_float(vectors)], [(i, np.array(x)) for i, x in as_float(queries)], 10, -0.2)
    assert got == {k: w for k, w in want.items() if w}


def test_unit_vectors_survive_extreme_magnitudes(spark):
    rows = [(1, [3e30, 4e30]), (2, [3e-30, 4e-30]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>").select("id", unit_vector("v", 2).alias("u"))
    got = {r["id"]: r["u"] for r in df.collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == pytest.approx([0.6, 0.8])
    assert got[3] is got[4] is got[5] is got[6] is None


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2**-0.5)


def lanes(spark):
    rows = [("q", "bm25", "x", 1, None), ("q", "bm25", "y", 2, None), ("q", "dense", "y", 1, 0.9), ("q", "dense", "z", 2, 0.8)]
    return spark.createDataFrame(rows, "query_id string, lane string, chunk_id string, rank int, similarity double")


def test_rrf_sums_and_single_lane_weight(spark):
    options = RetrievalOptions(bm25_weight=2, dense_weight=0.5, rrf_k=20)
    got = {r["chunk_id"]: r["score"] for r in fusion.fuse(lanes(spark), options).collect()}
    assert got == pytest.approx({"x": 2 / 21, "y": 2 / 22 + 0.5 / 21, "z": 0.5 / 22})
    alone = fusion.fuse(lanes(spark).filter("lane = 'bm25'"), options.override({"mode": "bm25"}))
    assert {r["chunk_id"]: r["score"] for r in alone.collect()} == pytest.approx({"x": 1 / 21, "y": 1 / 22})
    no_lex = fusion.fuse(lanes(spark), options.override({"bm25_weight": 0}))
    assert {r["chunk_id"] for r in no_lex.collect()} == {"y", "z"}


def test_reweight_and_projection_recover_lane_order(spark):
    fused = fusion.rank_fused(fusion.fuse(lanes(spark)))
    order = [r["chunk_id"] for r in fusion.lane_projection(fused, "dense").orderBy("rank").collect()]
    assert order == ["y", "z"]
    assert fusion.broken_projections(fusion.lane_projection(fused, "bm25")).count() == 0
    holes = fusion.lane_projection(fused.filter("chunk_id <> 'x'"), "bm25")
    assert fusion.broken_projections(holes).count() == 1
    swept = fusion.reweight(fused.drop("score", "rank"), [(0.0, 1.0, 10), (1.0, 0.0, 10)])
    rows = {(r["bm25_weight"], r["chunk_id"]) for r in swept.collect()}
    assert rows == {(0.0, "y"), (0.0, "z"), (1.0, "x"), (1.0, "y")}


def greedy(cands, topk, cap):
    queries = sorted({(o, q) for o, q, *_ in cands})
    pool = {(o, r): (q, c, s) for o, q, r, c, s in cands}
    taken, per, out = [], {}, {"duplicate": 0, "topk": 0, "source_limit": 0}
    for rank in range(1, 1 + max(r for _, _, r, *_ in cands)):
        for o, _ in queries:
            if (o, rank) not in pool:
                continue
            _, c, s = pool[(o, rank)]
            if c in taken:
                out["duplicate"] += 1
            elif len(taken) >= topk:
                out["topk"] += 1
            elif per.get(s, 0) >= cap:
                out["source_limit"] += 1
            else:
                taken.append(c)
                per[s] = per.get(s, 0) + 1
    return taken, out


def test_selection_equals_the_greedy_walk(spark):
    rng = random.Random(11)
    rows, cases = [], {}
    for request in range(120):
        topk, cap = 4, 2
        source = {f"c{i}": f"s{rng.randint(0, 3)}" for i in range(9)}
        cands = []
        for o in range(rng.randint(1, 4)):
            for rank, c in enumerate(rng.sample(sorted(source), rng.randint(1, 8)), 1):
                cands.append((o, f"q{o}", rank, c, source[c]))
        cases[request] = greedy(cands, topk, cap)
        rows += [(request, *c) for c in cands]
    df = spark.createDataFrame(rows, "request_id int, ordinal int, query_id string, rank int, chunk_id string, source_id string")
    outcomes = selection.select_chunks(df, 4, 2)
    got = {}
    for r in selection.selected_only(outcomes).orderBy("request_id", "position").collect():
        got.setdefault(r["request_id"], []).append(r["chunk_id"])
    counters = {r["request_id"]: r for r in selection.exclusion_counters(outcomes).collect()}
    for request, (taken, out) in cases.items():
        assert got[request] == taken
        assert {k: counters[request][k] for k in out} == out


# --- packing ------------------------------------------------------------------------------
SHELF = "request_id string, ordinal int, query_id string, rank int, chunk_id string, source_id string, score double, bm25_rank int, dense_rank int, similarity double"
PAGES = (
    "chunk_id string, text string, heading_path array<string>, start_line int, end_line int, section_start_line int, section_end_line int, "
    "source_id string, collection_id string, path string, relative_path string, source_version string"
)


class Book:
    """A page of evidence; every page has its own place, heading depth and version."""

    def __init__(self, number, text, owner=None):
        self.id, self.text, self.first = f"page{number:02d}", text, 3 + 7 * number
        self.owner = owner or f"book{number:02d}"
        bounds = (None, None) if number % 3 == 2 else (self.first - 1, self.first + 40 * number + text.count("\n"))
        place = f"shelf{number % 4}/{self.owner}/p{number}.md"
        version = hashlib.sha256(f"{number}".encode()).hexdigest()
        self.row = (
            self.id, text, [f"Part {k}" for k in range(number % 3)], self.first, self.first + text.count("\n"), *bounds,
            self.owner, f"shelf{number % 4}", f"/library/{place}", place, version,
        )


def answer(spark, books, options, asked=None, diagnostics=False):
    """Row and parsed response; ``asked``: query to its pages in rank order (one query for all pages if not given)."""
    asked = asked or {"only": range(len(books))}
    visits = [
        ("r7", place, query, rank, books[i].id, books[i].owner, 0.9 / rank, rank, None, None)
        for place, (query, order) in enumerate(asked.items()) for rank, i in enumerate(order, 1)
    ]
    reports = [("r7", place, query, "ok", None, len(order), 0) for place, (query, order) in enumerate(asked.items())]
    row = packing.pack_responses(
        spark.createDataFrame(visits, SHELF), spark.createDataFrame([b.row for b in books], PAGES),
        spark.createDataFrame(reports, "request_id string, ordinal int, query_id string, status string, error string, bm25 int, dense int"), options, diagnostics,
    ).first()
    return row, json.loads(row["response"]) if row["response"] else None


def units(text):
    return len(text.encode("utf-16-le")) // 2


def sound(books, row, body, budget):
    """What holds for every response: within its budget, texts are prefixes, and places and flags follow from them."""
    known = {b.id: b for b in books}
    assert units(row["response"]) <= budget
    for e in body["results"]:
        b = known[e["chunk_id"]]
        assert b.text.startswith(e["text"]) and e["text_truncated"] == (e["text"] != b.text)
        if e["text_truncated"]:
            assert e["preview_range"] == pv.preview_range(b.first, e["text"])
    return [e["text"] for e in body["results"]]


def test_long_pages_get_equal_room(spark):
    books = [Book(i, "long line " * 700) for i in range(13)]
    row, body = answer(spark, books, RetrievalOptions(topk=13, max_context_chars=12_345))
    sizes = [len(t) for t in sound(books, row, body, 12_345)]
    assert len(sizes) == 13 and min(sizes) > 0 and max(sizes) - min(sizes) <= 1
    assert body["limits"] == ["budget"] and body["queries"][0]["returned"] == 13


def test_what_short_pages_leave_goes_to_long_ones(spark):
    options = RetrievalOptions(max_context_chars=4_100)
    long = [Book(i, "z" * 6_000) for i in range(4)]
    mixed = [long[0], Book(1, "brief"), long[2], Book(3, "also brief")]
    equal, shared = sound(long, *answer(spark, long, options), 4_100), sound(mixed, *answer(spark, mixed, options), 4_100)
    assert shared[1] == "brief" and shared[3] == "also brief"
    assert min(len(shared[0]), len(shared[2])) > max(map(len, equal)) and abs(len(shared[0]) - len(shared[2])) <= 1


@pytest.mark.parametrize("diagnostics", [False, True])
def test_costly_characters_stay_within_any_budget(spark, diagnostics):
    books = [Book(0, "\u0007\\\\ \U0001f40d\r\n\"é" * 900), Book(1, "\U0001f40d" * 3_000), Book(2, "\t" * 5_000)]
    for budget in (2_717, 3_001, 3_350):
        row, body = answer(spark, books, RetrievalOptions(max_context_chars=budget), diagnostics=diagnostics)
        assert len(sound(books, row, body, budget)) == 3


def test_whole_pages_or_none(spark):
    options = RetrievalOptions(packing_mode="whole", max_context_chars=2_300)
    books = [Book(0, "fits well"), Book(1, "much too long " * 400), Book(2, "fits as well")]
    row, body = answer(spark, books, options)
    assert sound(books, row, body, 2_300) == ["fits well", "fits as well"]
    assert "budget" in body["limits"] and row["excluded"]["budget"] == 1
    _, nothing = answer(spark, books[1:2], options.override({"max_context_chars": 300}))
    assert nothing["results"] == [] and nothing["queries"][0]["empty_reason"] == "budget"
    # A page that does not fit takes no place of its book.
    same = [Book(0, "w" * 7_000, "one"), Book(1, "tiny", "one")]
    _, body = answer(spark, same, options.override({"max_chunks_per_source": 1, "max_context_chars": 1_200}))
    assert [e["text"] for e in body["results"]] == ["tiny"]


def test_the_smallest_budget_is_that_of_the_places_alone(spark):
    books = [Book(i, c * 5_000) for i, c in enumerate("mno")]
    _, body = answer(spark, books, RetrievalOptions(max_context_chars=20_000))
    for e, b in zip(body["results"], books):
        e.update(text="", text_truncated=True, preview_range=pv.preview_range(b.first, ""))
    body["limits"] = ["budget"]
    least = units(json.dumps(body, ensure_ascii=False, separators=(",", ":")))
    row, bare = answer(spark, books, RetrievalOptions(max_context_chars=least))
    assert sound(books, row, bare, least) == ["", "", ""]
    assert answer(spark, books, RetrievalOptions(max_context_chars=least - 1))[0]["error"] == "CONTEXT_BUDGET"


def test_queries_take_turns_before_room_is_shared(spark):
    books = [Book(0, "p" * 3_000, "left"), Book(1, "q" * 3_000, "right"), Book(2, "r" * 3_000, "left"), Book(3, "s" * 3_000, "third")]
    options = RetrievalOptions(topk=4, max_chunks_per_source=1, max_context_chars=2_900)
    row, body = answer(spark, books, options, {"first": [0, 1], "second": [0, 2, 3]})
    assert [e["chunk_id"] for e in body["results"]] == ["page00", "page01", "page03"] and all(sound(books, row, body, 2_900))
    assert body["results"][0]["matched_query_ids"] == ["first", "second"] and "source_limit" in body["limits"]


def test_text_budget_helpers():
    assert pv.text_budgets([10, 10, 10], 12) == [4, 4, 4]
    assert pv.text_budgets([5, 100, 100], 26) == [5, 11, 10]
    assert pv.text_budgets([5, 6], 100) == [5, 6] and pv.text_budgets([], 5) == []
    assert pv.text_prefix("a😀b", 2) == "a" and pv.text_prefix("a😀b", 3) == "a😀" and pv.text_prefix("\n\n", 3) == "\n"
    assert pv.escaped_cost('\\"\t\u0001😀') == 2 + 2 + 2 + 6 + 2


# --- options, requests, errors ------------------------------------------------------------
def test_options_and_requests():
    base = RetrievalOptions()
    assert base.override({"topk": 20, "minisearch_k": 2, "lexical_engine": "sqlite"}).lexical_engine == "fts"
    for bad in ({"topk": 21}, {"max_results": 30}, {"packing_mode": "bad"}, {"nope": 1}, {"bm25_weight": 0, "dense_weight": 0}, {"topk": 1.5}):
        with pytest.raises(RetrievalError):
            base.override(bad)
    assert parse_request({"query": " hi "}).queries[0].text == "hi"
    spec = parse_request({"queries": [{"query_id": "a", "text": "x", "variants": ["x", "y"]}]}).queries[0]
    assert spec.expressions == ["x", "y"]
    for bad in ({}, {"query": "a", "queries": []}, {"query": ""}, {"queries": [{"query_id": "a", "text": "x"}] * 2}, {"query": "x", "extra": 1}):
        with pytest.raises(RetrievalError):
            parse_request(bad)


def test_filters_and_scope(spark):
    with pytest.raises(RetrievalError, match="Unknown collection"):
        parse_filters({"collections": ["x"]}, {"notes"})
    for prefix in ("/abs", "C:\\x", "a/../b"):
        with pytest.raises(RetrievalError) as error:
            parse_filters({"path_prefix": prefix})
        assert error.value.code == "INVALID_PATH_PREFIX"
    assert parse_filters({"path_prefix": "a\\b"}).path_prefix == "a/b"
    df = spark.createDataFrame([("n", "s", "a%b/c.md"), ("n", "s", "axb/c.md")], "collection_id string, source_id string, relative_path string")
    assert df.filter(selection.scope(SearchFilters(path_prefix="a%"))).count() == 1
    assert df.filter(selection.scope(SearchFilters(collections=()))).count() == 0
    assert selection.scope(SearchFilters()) is None


def test_error_classes_and_bounded_text():
    assert classify("Embedding key missing: x")[0] == "MODEL_KEY_MISSING"
    assert classify("request timed out")[0] == "TIMEOUT" and classify("odd")[0] == "INVALID_REQUEST"
    text = bounded_error("😀" * 500)
    assert units(text) <= 256 and json.loads(text)["status"] == "error"
