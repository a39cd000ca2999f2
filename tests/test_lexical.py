"""Scoring against closed forms on small corpora."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.config import RetrievalOptions
from lodestone.functions import text as tx
from lodestone.operators import lexical as lx

DOCS = [("a", "apple apple banana"), ("b", "apple other more words"), ("c", "banana third"), ("d", "")]


def plain_terms(spark, rows, title=None):
    """Term tables of space-separated words, without identifier expansion."""
    df = spark.createDataFrame([(i, t, (title or {}).get(i, "")) for i, t in rows], "chunk_id string, text string, title string")
    split = lambda c: F.array_remove(F.split(c, " "), "")
    return df.select(
        "chunk_id", split("title").alias("title_terms"), split("text").alias("body_terms")
    ).withColumns(
        {
            "title_len": F.size(F.array_distinct("title_terms")), "body_len": F.size(F.array_distinct("body_terms")),
            "total_len": F.size("title_terms") + F.size("body_terms"),
        }
    )


def scores(spark, terms, words, options, **kw):
    queries = spark.createDataFrame([(0, " ".join(words))], "query_id int, text string")
    found = lx.lexical_scores(terms, queries, options, title=kw.pop("title", False), **kw)
    return {r["chunk_id"]: r["score"] for r in found.collect()}


@pytest.mark.parametrize("k,b,d", [(1.2, 0.7, 0.5), (0.84, 0.7, 0.5), (1.2, 0.49, 0.5)])
def test_bm25plus_matches_closed_form(spark, k, b, d):
    options = RetrievalOptions(title_weight=0, bm25_k=k, bm25_b=b, bm25_d=d)
    got = scores(spark, plain_terms(spark, DOCS), ["apple", "banana"], options)
    want = {}
    for name, text in DOCS:
        words = text.split()
        for term in ("apple", "banana"):
            tf = words.count(term)
            if tf:
                df = sum(term in t.split() for _, t in DOCS)
                idf = math.log(1 + (len(DOCS) - df + 0.5) / (df + 0.5))
                norm = k * (1 - b + b * len(set(words)) / (8 / 4))
                want[name] = want.get(name, 0) + idf * (d + tf * (k + 1) / (tf + norm))
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == pytest.approx(want[name], abs=1e-8)


def test_fts_bm25_matches_closed_form(spark):
    rows = [("1", "common rare rare"), ("2", "common other"), ("3", "common common"), ("4", ""), ("5", "extra")]
    got = scores(spark, plain_terms(spark, rows), ["common", "rare"], RetrievalOptions(lexical_engine="fts"))
    want = {}
    for name, text in rows:
        words = text.split()
        for term in ("common", "rare"):
            tf, df = words.count(term), sum(term in t.split() for _, t in rows)
            if tf:
                idf = max(math.log((5 - df + 0.5) / (df + 0.5)), 1e-6)
                want[name] = want.get(name, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / (8 / 5)))
    assert got == pytest.approx(want, abs=1e-8)


def test_number_of_matched_terms_does_not_multiply_the_score(spark):
    rows = [(f"d{i}", "alpha beta") for i in range(60)] + [("target", " ".join(["gamma"] * 200))]
    rows += [(f"f{i}", "gamma " + " ".join(f"extra{j}" for j in range(40))) for i in range(39)]
    queries = spark.createDataFrame([(0, "alpha beta gamma")], "query_id int, text string")
    lane = lx.lexical_lane(plain_terms(spark, rows), queries, RetrievalOptions(title_weight=0), title=False)
    top = lane.orderBy("rank").collect()
    assert len(top) == 60 and top[0]["chunk_id"] == "target"


def test_filter_applies_before_cap_and_keeps_global_statistics(spark):
    rows = [(f"{i:03d}", "apple") for i in range(70)] + [("allowed", "apple many unrelated words for a longer field")]
    terms = plain_terms(spark, rows).withColumn("source_id", F.col("chunk_id"))
    queries = spark.createDataFrame([(0, "apple")], "query_id int, text string")
    options = RetrievalOptions(title_weight=0)
    kw = dict(keep=("source_id",), title=False)
    free = lx.lexical_lane(terms, queries, options, **kw)
    assert free.count() == 60 and free.filter("chunk_id = 'allowed'").count() == 0
    only = lx.lexical_lane(terms, queries, options, allowed=F.col("source_id") == "allowed", **kw).collect()
    assert [r["chunk_id"] for r in only] == ["allowed"]
    everything = scores(spark, terms, ["apple"], options, keep=("source_id",))
    assert only[0]["score"] == everything["allowed"]


def test_title_field_is_boosted_and_can_be_switched_off(spark):
    terms = plain_terms(spark, [("a", "banana"), ("b", "apple")], {"a": "apple"})
    boosted = scores(spark, terms, ["apple"], RetrievalOptions(), title=True)
    assert boosted["a"] > boosted["b"]
    assert set(scores(spark, terms, ["apple"], RetrievalOptions(title_weight=0), title=True)) == {"b"}


def tokens(spark, text, **kw):
    return spark.createDataFrame([(text,)], "t string").select(tx.tokenize("t", **kw).alias("x")).first()["x"]


def test_tokens_count_word_identifier_and_part(spark):
    found = tokens(spark, "timeout timeout HTTPServer")
    assert found.count("timeout") == 6
    assert found.count("httpserver") == 2 and found.count("http") == 1 and found.count("server") == 1


def test_tokens_of_compatibility_forms_han_runs_and_dictionary(spark):
    found = tokens(spark, "ＡＢＣ１２３ 如何配置向量数据库 max_output_tokens=100 don't 3.14", dictionary=["数据库"])
    assert "abc123" in found and "max_output_tokens" in found and "output" in found and "don't" in found and "3.14" in found
    assert "配置" in found and "向量" in found and "如何" not in found  # stopword
    assert found.count("数据库") == 1
    assert tokens(spark, "") == []


def test_query_terms_keep_order_and_cap(spark):
    text = " ".join(f"w{i}" for i in range(200))
    got = lx.query_terms(spark.createDataFrame([(0, text)], "query_id int, text string")).orderBy("pos").collect()
    assert [r["term"] for r in got] == [f"w{i}" for i in range(128)]


def test_very_long_tokens_do_not_overflow_the_regex_engine(spark):
    assert len(tokens(spark, "a1" * 50_000)) >= 2
    assert len(tokens(spark, "x." * 50_000)) >= 1


def test_encoded_terms(spark):
    row = spark.createDataFrame([("né",)], "t string").select(tx.encode_term("t").alias("e")).first()
    assert row["e"] == "t" + "né".encode().hex()


def test_utf16_and_escape_costs(spark):
    text = '\\"\t\n\u0001😀中文'
    row = spark.createDataFrame([(text,)], "t string").select(
        tx.utf16_length("t").alias("n"), tx.escape_cost("t").alias("c")
    ).first()
    assert row["n"] == len(text.encode("utf-16-le")) // 2
    assert row["c"] == 2 + 2 + 2 + 2 + 6 + 2 + 2
