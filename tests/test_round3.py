"""Registered queries against their SQL on small tables with the rows that went wrong in round 3."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.catalog import ORACLE, QUERIES
from lodestone.config import RetrievalOptions
from lodestone.functions import plain
from lodestone.operators import baselines, coverage, lexical as lx, matching, postings
from lodestone.plans.index import EvidenceIndex, IndexProfile

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def equals_sql(spark, name, folder, tables):
    got = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in got.collect()]
    with duckdb.connect() as con:
        for t in tables:
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
        found = con.execute(ORACLE[name])
        columns = [d[0] for d in found.description]
        want = found.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, rows) == rows_of(columns, want)
    return want


def test_a_passage_at_the_start_of_its_document_maps_below_its_headings(spark, tmp_path):
    passage = "the first of seven words of a passage"
    texts = [(1, f"{passage} and the rest"), (2, f"before {passage}"), (3, f"{passage} twice {passage}"), (4, "none of it")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, passage) for i in (1, 3, 4, 6)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = equals_sql(spark, "span_mapping", str(tmp_path), ("documents", "benchmark"))
    assert (1, 1, "mapped", 10, 3) in want


@pytest.mark.parametrize("engine", ["bm25plus", "fts"])
def test_lane_in_blocks_equals_all_pairs(spark, monkeypatch, engine):
    """Blocks of chunks and of queries, copies that tie at the cut, titles, null keys: the lane is the first rows of all scores."""
    monkeypatch.setattr(matching, "BLOCK_CHUNKS", 3)
    monkeypatch.setattr(matching, "QUERY_TERMS", 9)
    words = "red green blue cyan lime".split()
    rows = [(f"c{(i * 7) % 40:02d}", " ".join(words[: 1 + i % 4]) if i % 3 else "red green", words[i % 5] if i % 2 else "") for i in range(40)] + [("none", None, None)]
    terms = lx.term_table(spark.createDataFrame(rows, "chunk_id string, text string, title string"), title=F.coalesce("title", F.lit("")))
    asked = spark.createDataFrame([(i, 1 if i % 2 else None, " ".join(words[i % 5 :])) for i in range(7)] + [(9, 1, "absent"), (10, 1, "")], "query_id int, part int, text string")
    options, keys = RetrievalOptions(lexical_engine=engine, bm25_candidates=4), ("query_id", "part")
    lane = lx.lexical_lane(terms, asked, options, keys=keys)
    plan = lane._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Join" not in plan and "HashAggregate" not in plan  # (query, chunk) pairs were rows of an aggregate
    scores = lx.lexical_scores(terms, asked.fillna(-1, ["part"]), options, keys=keys)
    want = lx.top_candidates(scores, 4, keys)
    row = lambda r: (r["query_id"], -1 if r["part"] is None else r["part"], r["rank"], r["chunk_id"], round(r["score"], 8))
    assert sorted(map(row, lane.collect())) == sorted(map(row, want.collect()))


def test_a_posting_on_disk_holds_no_chunk_id(spark, tmp_path):
    """Postings name chunks by number and are counted without a shuffle; numbers survive a merge and a replaced source."""
    rows = lambda *texts: spark.createDataFrame(
        [(str(i), False, "c", f"/{i}.md", f"{i}.md", t, 1, 1, t) for i, t in texts],
        "source_id string, has_identity boolean, collection_id string, path string, relative_path string, source_version string, first_line int, last_line int, text string",
    )
    index = EvidenceIndex(spark, str(tmp_path), IndexProfile("whole"))
    index.sync(rows((1, "red red blue"), (2, "green"), (3, "blue")))
    index.sync(rows((1, "red blue blue"), (2, "green"), (4, "red")))
    held = lambda: sorted((r["source_id"], r["term"], r["tf"]) for r in index.described_postings(index.state()).filter("field = 'body'").collect())
    want = [("1", "blue", 6), ("1", "red", 3), ("2", "green", 3), ("4", "red", 3)]
    state = index.state()
    stored = spark.read.parquet(state["segments"][0]["terms"][index.profile.term_key] + "/postings")
    assert set(stored.columns) == {"bucket", "field", "term", "number", "tf"}
    assert held() == want
    index.compact(everything=True)
    assert held() == want and len(index.state()["segments"]) == 1


def test_plain_texts_have_the_terms_of_the_expression(spark, monkeypatch):
    """Terms and lengths by array operations are those of ``tokenize``, texts of every kind of neighbour, in slices of any size."""
    rng = random.Random(5)
    signs = list("aBcDEf09_.,;'$- \n\té×÷ÀÞßÿ") + ["AB", "fooBar", "x1Y", "ABCd", "9a", "__", "a.b", "1,2", "don't", "naïve", "Ñu"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(600)] + ["", "_", "a", "É", "·a·b", "İx", "数据库", "ﬁne", None]
    rows = [(i, t, rng.choice(texts[:40])) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "chunk_id int, text string, title string").repartition(3)
    terms = lx.term_table(frame, title=F.col("title"))
    lists = terms.collect()
    made = lx.split_plain(terms)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert made.index("split(") < made.index("Filter")  # terms are split only of what the filter leaves
    vocabulary = sorted({t for r in lists for t in r["body_terms"][::2]} | {"absent"})
    wanted = spark.createDataFrame([(1, t) for t in vocabulary], "query_id int, term string")
    for size in (1, 1 << 18):
        monkeypatch.setattr(plain, "SLICE_BYTES", size)
        for title in (True, False):
            found = matching.match_terms(*lx.split_plain(terms), wanted, ("query_id",), (), title)
            order = wanted.select("term").toArrow()["term"].to_pylist()
            got = {r["chunk_id"]: (r["title_len"], r["body_len"], r["total_len"], sorted(zip(r["ids"], r["tfs"]))) for r in found.rows.collect()}
            number = {t: i for i, t in enumerate(dict.fromkeys(order))}
            want = {}
            for r in lists:
                hits = Counter(number[t] for t in r["body_terms"] if t in number)
                hits.update(number[t] + found.size for t in (r["title_terms"] if title else ()) if t in number)
                want[r["chunk_id"]] = (r["title_len"], r["body_len"], r["total_len"], sorted(hits.items()))
            assert got == want


def test_postings_of_plain_texts_are_those_of_their_lists(spark, monkeypatch):
    """Index terms cut out of the bytes are the terms and counts of ``tokenize``, in slices of any size."""
    rng = random.Random(7)
    signs = list("aBcDEf09_.,;'$- \n\té×÷ÀÞßÿ") + ["AB", "fooBar", "x1Y", "a.b", "don't", "naïve", "Ñu"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(300)] + ["", "_", "a"]
    rows = [(i, t, rng.choice(texts[:40]), i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "chunk_id int, text string, title string, number long").repartition(3)
    table = lx.term_table(frame, title=F.col("title"), keep=("number",))
    held = lambda df: sorted(map(tuple, postings.unpacked(df).collect()))
    want = held(postings.counted(table))
    for size in (1, 1 << 18):
        monkeypatch.setattr(plain, "SLICE_BYTES", size)
        assert held(postings.counted_plain(lx.split_plain(table, ("number",))[0])) == want


def test_sync_stores_texts_once_and_search_moves_numbers(spark, tmp_path, monkeypatch):
    """The copy of the sources is gone before terms are written, lengths are sums of postings, only numbers of matches are shuffled."""
    rows = [(str(i), False, "c", f"/{i}.md", f"{i}.md", t, 1, 1, t) for i, t in enumerate(["red red blue", "green 数据", "...", " "])]
    kinds = "source_id string, has_identity boolean, collection_id string, path string, relative_path string, source_version string, first_line int, last_line int, text string"
    index, seen = EvidenceIndex(spark, str(tmp_path), IndexProfile("whole")), []
    write = EvidenceIndex._write_terms
    monkeypatch.setattr(EvidenceIndex, "_write_terms", lambda self, *a: (seen.extend(self.folder.names(f"{self.home}/scans")), write(self, *a)))
    index.sync(spark.createDataFrame(rows, kinds))
    assert seen == []  # the texts lay there a second time
    state = index.state()
    lengths = {r["source_id"]: (r["title_len"] > 0, r["body_len"], r["total_len"] - r["title_len"]) for r in index.lengths(state).collect()}
    assert {k: v[:2] for k, v in lengths.items()} == {"0": (True, 2), "1": (True, 2), "2": (True, 0)}
    kept = []
    monkeypatch.setattr(matching, "stored", lambda df, label: kept.append(df) or df)
    asked = spark.createDataFrame([(1, "red green")], "query_id int, text string")
    numbered = index.numbered_lengths(state)
    lane = lx.lexical_lane(None, asked, counted=index.postings(state), numbered=numbered, stats=lx.corpus_stats(numbered))
    assert lane.count() == 2
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [number") < plan.index("Relation [field")  # postings carried ids and lengths into the exchange


@pytest.mark.parametrize("limits", [{}, {"FREQUENT": 3, "ASKED": 9}])
def test_closest_paragraph_counts_terms_within_tasks(spark, tmp_path, monkeypatch, limits):
    """Plain and other texts, copies that tie, rare terms behind a join, questions in blocks: as the SQL; no task holds a language."""
    for name, value in limits.items():
        monkeypatch.setattr(baselines, name, value)
    rng = random.Random(3)
    words = "Red green_1 BLUE x 12 cyan Été ÷ lime 数据 café a-b don't ÿÿ é".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(40)] + ["red lime"] * 4 + [None, "", "é x"]
    rows = [(i * 3, t, rng.choice(["de", "en", "es", None]), "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(i, " ".join(rng.choices(words, k=3))) for i in range(30)] + [(30, "x"), (31, "unknown words"), (32, "red red lime")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    equals_sql(spark, "tfidf_paragraph", str(tmp_path), ("documents", "benchmark"))
    plan = QUERIES["tfidf_paragraph"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_passages_are_found_by_windows_of_bytes(spark, monkeypatch):
    """Passages of every length, shared windows, rows that meet only over an edge, passages in blocks; no shingle is a row and no text is shuffled."""
    monkeypatch.setattr(coverage, "LONG_BYTES", 150)
    rng = random.Random(8)
    words = "red green blue数 cyan é lime\n and the".split(" ")
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "x" * 23, "x" * 60]
    whole = [t for t in texts if t]
    cut = lambda t, n: t[(i := rng.randint(0, max(0, len(t) - n))) : i + n]
    passages = [cut(rng.choice(whole), rng.choice([3, 23, 24, 25, 60])) for _ in range(60)] + ["x" * 24, "x" * 61, whole[0][-12:] + whole[1][:12], " " * 30]
    passages = [p for p in passages if p]
    documents = spark.createDataFrame(list(enumerate(texts)), "source_id int, text string").repartition(2)
    found = coverage.locate_passages(documents, spark.createDataFrame(list(enumerate(passages)), "passage_id long, text string"))
    got = sorted((r["passage_id"], r["source_id"], r["offset"]) for r in found.collect())
    assert got == sorted((i, j, t.index(p) + 1) for i, p in enumerate(passages) for j, t in enumerate(texts) if t and p in t)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_arms_over_the_same_matches_count_once(spark, monkeypatch):
    terms = lx.term_table(spark.createDataFrame([(i, "red " * (i % 3) + "blue") for i in range(6)], "chunk_id int, text string"))
    asked = spark.createDataFrame([(1, "red blue")], "query_id int, text string")
    matched, seen = lx.match(terms, asked, title=False), []
    counted, stats = matching.Matched._frequency, lx.corpus_stats
    monkeypatch.setattr(matching.Matched, "_frequency", lambda self, together: seen.append("df") or counted(self, together))
    monkeypatch.setattr(lx, "corpus_stats", lambda rows: seen.append("stats") or stats(rows))
    for k in (1.2, 0.8):
        lane = lx.lexical_lane(terms, asked, RetrievalOptions(title_weight=0.0, bm25_k=k, bm25_candidates=3), title=False, matched=matched)
        assert lane.count() == 3
    assert sorted(seen) == ["df", "stats"]  # each arm counted anew
