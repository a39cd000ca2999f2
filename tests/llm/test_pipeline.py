"""The corpus pipeline: its stages on small tables with odd rows."""

import collections

import corpus_pipeline

from lodestone.llm import mixing, ngram_join

from .test_llm import LOW, SCHEMA, WORD, prose


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def alike(a, b, n=5):
    a, b = shingles(a, n), shingles(b, n)
    return len(a & b) / len(a | b)


def edited(text, places, mark):
    words = text.split()
    for i in places:
        words[i] = f"{mark}{i}"
    return " ".join(words)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


BASE, BLOCK = prose(61, 430), prose(62, 200)
SCATTERED = edited(BASE, range(24, 430, 48), "x")  # single words: five-word similarity 0.80 to 0.82, four-word below 0.85
TOGETHER = edited(BLOCK, range(90, 107), "y")  # one block of words


def test_near_copies_of_five_words_and_80_percent(spark):
    for a, b in ((BASE, SCATTERED), (BLOCK, TOGETHER)):
        assert 0.8 <= alike(a, b) < 0.85 and alike(a, b, 4) < 0.85
    docs = table(spark, [(1, BASE, "a"), (2, SCATTERED, "b"), (3, BLOCK, "a"), (4, TOGETHER, "a"), (5, prose(63, 100), "a")])
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 5]


def test_one_row_of_repeated_rows_and_null_ids_stays(spark, tmp_path):
    a, b, c = prose(71, 90), prose(72, 90), prose(73, 90)
    rows = [(1, a, "a"), (1, a, "a"), (2, b, "a"), (None, b, "b"), (None, c, "a"), (None, c, "b"), (4, prose(74, 90), "a"), (4, b, "a")]
    docs = table(spark, rows)
    got = collections.Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one_per_component(docs).collect())
    assert got == {(1, a): 1, (2, b): 1, (None, c): 1, (4, rows[6][1]): 1}
    docs.where("doc_id is null or doc_id <> 4").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2, None}


def test_mix_cuts_only_documents_at_the_ends_of_a_stretch(spark):
    docs = table(spark, [(i, prose(i, 150), "ab"[i % 2]) for i in range(100, 140)])
    rows = mixing.mix_sources(docs.select("doc_id", "text", "source"), ratio=0.5)[0].collect()
    for source in "ab":
        own = [r for r in rows if r["source"] == source]
        assert any(r["taken"] == r["size"] for r in own)
        assert sum(0 < r["taken"] < r["size"] for r in own) <= 2


def test_columns_named_like_those_of_operators_pass(spark):
    names = ["n_words", "kept", "failed", "n_removed", "_id", "_order", "_pieces", "_o", "_taken", "_copy"]
    docs = table(spark, [(i, prose(i, 90), "a") for i in (91, 92)])
    docs = docs.selectExpr("*", *[f"'{n}' as {n}" for n in names])
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.repeated_passages, corpus_pipeline.source_mix):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == {91, 92} and all(r[n] == n for r in rows for n in names)
