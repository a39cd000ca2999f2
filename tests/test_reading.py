"""Host reads, spans of returned text and paragraph baselines against plain Python."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import RetrievalOptions
from lodestone.operators import baselines, coverage, dense, lexical as lx, mapping
from lodestone.operators.bootstrap import DEFAULT_SEED
from lodestone.plans import evaluate as ev
from lodestone.plans.index import EvidenceIndex, IndexProfile
from lodestone.operators import chunking
from lodestone.plans.search import SearchEngine

from .test_index import dataset, notes, scan  # noqa: F401


def cost(text):
    return len(json.dumps(text, ensure_ascii=False).encode("utf-16-le")) // 2 - 2


def test_host_reads_equal_the_walk(spark):
    rng = random.Random(2)
    sources = {s: ["".join(rng.choices('ab"\\\t é😀', k=rng.randint(0, 14))) for _ in range(rng.randint(1, 9))] for s in "stuv"}
    sections, want = [], []
    for q in range(40):
        room, left = (total := rng.randint(5, 120)), total
        for rank in sorted(rng.sample(range(1, 30), rng.randint(1, 4))):
            s = rng.choice("stuv")
            start = rng.randint(1, len(sources[s]))
            end, fixed = rng.randint(start, len(sources[s])), rng.randint(3, 25)
            sections.append((q, rank, s, start, end, fixed, room))
            best = None
            for n in range(start, end + 1):
                c = fixed + cost("\n".join(sources[s][start - 1 : n])) + len(str(n))
                if c <= left:
                    best = (n, c)
            if best:
                left -= best[1]
                want.append((q, rank, *best))
    lines = spark.createDataFrame([(s, i, t) for s, ls in sources.items() for i, t in enumerate(ls, 1)], "source_id string, line_no int, text string")
    asked = spark.createDataFrame(sections, "query_id int, rank int, source_id string, section_start_line int, section_end_line int, fixed int, room int")
    got = [tuple(r[c] for c in ("query_id", "rank", "end_line", "cost")) for r in coverage.host_reads(asked, lines).collect()]
    assert sorted(got) == sorted(want) and len(want) > 30
    assert coverage.host_reads(asked.limit(0), lines).count() == 0


def test_a_section_that_does_not_fit_leaves_room_for_the_next(spark):
    lines = spark.createDataFrame([("a", 1, "x" * 500), ("b", 1, "short"), ("b", 2, "x" * 500)], "source_id string, line_no int, text string")
    rows = [("q", "a", "a", 1, 1, 1), ("q", "b", "b", 2, 1, 2)]
    pieces = spark.createDataFrame(rows, "query_id string, source_id string, path string, rank int, start_line int, end_line int")
    pieces = pieces.withColumns({"section_start_line": F.col("start_line"), "section_end_line": F.col("end_line")})
    room = spark.createDataFrame([("q", 150)], "query_id string, room int")
    assert [(r["rank"], r["end_line"]) for r in ev.supplement_sections(pieces, lines, room).collect()] == [(2, 1)]


def test_every_strategy_runs(spark, notes, tmp_path):  # noqa: F811
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("heading-1000"))
    index.sync(scan(spark, notes))
    sources = scan(spark, notes).cache()
    lines = chunking.source_lines(sources, first_line=F.col("first_line"))
    engine = SearchEngine(index, None, RetrievalOptions(mode="bm25"))
    rows = ev.run_strategies(engine, dataset(spark, notes, tmp_path), sources, lines, 9000, lexical_only=True).collect()
    assert {r["strategy"] for r in rows} == {"bm25_default", "bm25_unrestricted", "bm25_with_host_read"} and len(rows) == 9
    read = {r["query_id"]: r for r in rows if r["strategy"] == "bm25_with_host_read"}
    assert read["q1"]["read_chars"] > 0 and all(r["chars"] <= 9000 for r in rows)
    assert all(r["read_chars"] == 0 for r in rows if r["strategy"] != "bm25_with_host_read")
    parts = {p["id"]: (p["expected"], p["covered"]) for p in read["q2"]["subquestions"]}
    assert parts == {"s1": (1, 1), "s2": (1, 1)}


def spans_of(text, source):
    """The rule in plain Python: whole text, then without its first heading lines, one by one."""
    trimmed = text.strip()
    if not trimmed:
        return "empty", []
    rows = trimmed.split("\n")
    leading = next((i for i, r in enumerate(rows) if not re.match(r"\s*#{1,6}\s", r)), len(rows))
    for cut in range(leading + 1):
        rest = "\n".join(rows[cut:]).strip()
        at = source.find(rest) if rest else -1
        if at < 0:
            continue
        if source.find(rest, at + 1) >= 0:
            return "ambiguous", []
        stack, offset, fence, spans = [], 0, None, [(at, at + len(rest))]
        for line in source.split("\n"):
            end, mark = offset + len(line), re.match(r" {0,3}(`{3,}|~{3,})", line)
            if mark:
                if fence is None:
                    fence = mark[1]
                elif mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                    fence = None
            elif fence is None and end < at and (h := re.match(r" {0,3}(#{1,6})[ \t]", line)):
                stack = [s for s in stack if s[0] < len(h[1])] + [(len(h[1]), line.strip(), (offset, end))]
            offset = end + 1
        for row in rows[:cut]:
            hit = next((s for s in stack if s[1] == row.strip()), None)
            if hit is None:
                return "unmapped-heading", []
            spans.append(hit[2])
        return "mapped", sorted(spans)
    return "unmapped", []


def test_returned_text_finds_its_spans(spark):
    source = "# A\nintro\n## B\none two\n```\n# not a heading\ncode\n```\nthree\n## C\none\nfour 😀 five\n# D\nlast"
    texts = [
        "one two", "# A\n## B\none two", "## B\none two", "## C\none two", "one", "# A\n## C\nfour", "# not a heading\ncode", "# A\n# not a heading\nthree",
        "", "  \n", "absent", "# A\nabsent", "# D\nlast", "  # A\n intro ", "## B\n# A\none two", "five\n# D", "# A", "## C\none\nfour", "# A\nlast", "# A\n## B\nthree",
    ]
    rows = [(i, "s", t) for i, t in enumerate(texts)] + [(100, "none", "x"), (101, "s", None)]
    df = spark.createDataFrame(rows, "id int, source_id string, text string")
    sources = spark.createDataFrame([("s", source), ("other", "x")], "source_id string, text string")
    got = {r["id"]: (r["status"], [tuple(s) for s in r["spans"]]) for r in mapping.map_returned_text(df, sources).collect()}
    units = lambda i: len(source[:i].encode("utf-16-le")) // 2
    for i, t in enumerate(texts):
        status, spans = spans_of(t, source)
        assert got[i] == (status, [(units(a), units(b)) for a, b in spans]), t
    assert got[100] == ("unmapped", []) and got[101] == ("empty", [])
    assert {s for s, _ in got.values()} == {"mapped", "ambiguous", "unmapped", "unmapped-heading", "empty"}


def test_paragraph_baselines(spark):
    rng = random.Random(4)
    papers = {p: [" ".join(rng.choices(["Alpha", "beta", "gamma", "x", "delta_1"], k=rng.randint(0, 8))) for _ in range(rng.randint(1, 7))] for p in "pq"}
    asked = [(i, rng.choice("pq"), i, " ".join(rng.choices(["alpha", "BETA", "none", "delta_1"], k=3))) for i in range(20)] + [(20, "p", 20, "x y"), (21, "r", 21, "alpha")]
    paragraphs = spark.createDataFrame([(p, i, t) for p, ts in papers.items() for i, t in enumerate(ts)], "paper string, place long, text string")
    questions = spark.createDataFrame(asked, "query_id int, paper string, ord long, text string")
    words = lambda t: re.findall(r"\w{2,}", t.lower())
    want = {}
    for q, paper, _, text in asked[:-1]:
        docs = [words(t) for t in papers[paper]]
        idf = lambda w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1
        known = {w for d in docs for w in d}
        vector = lambda ws: {w: ws.count(w) * idf(w) for w in set(ws) & known}
        qv, scores = vector(words(text)), []
        for d in docs:
            dv = vector(d)
            norm = math.sqrt(sum(x * x for x in dv.values())) * math.sqrt(sum(x * x for x in qv.values()))
            scores.append(round(sum(x * dv.get(w, 0) for w, x in qv.items()) / norm, 9) if norm else 0.0)
        want[q] = (int(np.argmax(scores)), max(scores))
    got = {r["query_id"]: (r["place"], r["score"]) for r in baselines.tfidf_paragraph(paragraphs, questions).collect()}
    assert {q: p for q, (p, _) in got.items()} == {q: p for q, (p, _) in want.items()}
    assert all(got[q][1] == pytest.approx(want[q][1], abs=1e-8) for q in want)
    first = {r["query_id"]: r["place"] for r in baselines.first_paragraph(paragraphs, questions).collect()}
    drawn = {r["query_id"]: r["place"] for r in baselines.random_paragraph(paragraphs, questions, DEFAULT_SEED).collect()}
    assert set(first.values()) == {0} and all(0 <= drawn[q] < len(papers[p]) for q, p, *_ in asked[:-1]) and len(set(drawn.values())) > 2


@pytest.mark.parametrize("limits", [{"tile_bytes": 4096}, {"tile_bytes": 1 << 16, "query_float_limit": 4_000, "chunk_float_limit": 9_000}])
def test_dense_tiles_equal_brute_force(spark, limits):
    rng = np.random.default_rng(6)
    vectors, queries = rng.integers(-3, 4, (2_000, 4)).astype(float), rng.integers(-3, 4, (500, 4)).astype(float)
    vectors[:, 0] += 0.5
    queries[:, 0] += 0.5
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "chunk_id int, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id int, embedding array<float>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(queries) @ unit(vectors).T, 9)
    got = {}
    found = lx.top_candidates(dense.dense_scores(v, q, 7, 0.1, **limits), 7, by="similarity")
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for i in range(500):
        order = [int(c) for c in np.lexsort((np.arange(2_000), -sims[i])) if sims[i][c] >= 0.1][:7]
        assert got.get(i, []) == order


def test_lexical_lane_has_no_exchange_of_pairs(spark):
    chunks = spark.createDataFrame([(i, f"word{i % 5} common text {i}") for i in range(60)], "chunk_id int, text string").repartition(3)
    queries = spark.createDataFrame([(i, f"common word{i}") for i in range(8)], "query_id int, text string")
    lane = lx.lexical_lane(lx.term_table(chunks), queries, RetrievalOptions(bm25_candidates=3), title=False)
    plan = lane._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not any("query_id" in e and "chunk_id" in e for e in exchanges)
    assert lane.count() == 24
