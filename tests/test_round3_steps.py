"""Steps that the second findings of round 3 name: each is done once and grows with its input."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.catalog import evaluation
from lodestone.functions.text import chunk_id
from lodestone.operators import bootstrap, chunking, lexical as lx, matching


def test_texts_are_matched_in_one_pass(spark, monkeypatch):
    """Plain and other texts come out of one pass over them; only the others are read again, and none are if all are plain."""
    rng = random.Random(11)
    signs = list("aBc09_.,'$- \né×÷ß") + ["fooBar", "1,2", "don't", "数据", "ﬁne", "İ", " ", "Ω", "😀"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 9))) for _ in range(300)] + ["", None, "é" * 9, "¿", "Ã", "数"]
    frame = spark.createDataFrame([(i, t, rng.choice(texts[:30])) for i, t in enumerate(texts)], "chunk_id int, text string, title string")
    store, kept = matching.stored, []
    monkeypatch.setattr(matching, "stored", lambda df, label: kept.append(df) or store(df, label))
    for rows, passes in ((frame, 2), (frame.filter("not rlike(concat_ws(' ', text, title), '[^\\\\x00-\\\\x7F]')"), 1)):
        kept.clear()
        terms = lx.term_table(rows.repartition(3), title=F.col("title"))
        lists = terms.collect()
        vocabulary = sorted({t for r in lists for t in r["body_terms"][::2]} | {"absent"})
        asked = spark.createDataFrame([(i, t) for i, t in enumerate(vocabulary)], "query_id int, text string")
        found = lx.match(terms, asked)[0]
        assert len(kept) == passes
        assert all("Union" not in df._jdf.queryExecution().optimizedPlan().toString() for df in kept)  # a side of it each read all texts
        order = lx.query_terms(asked).select("query_id", "term").toArrow()["term"].to_pylist()
        number = {t: i for i, t in enumerate(dict.fromkeys(order))}
        want = {}
        for r in lists:
            hits = Counter(number[t] for t in r["body_terms"] if t in number)
            hits.update(number[t] + found.size for t in r["title_terms"] if t in number)
            want[r["chunk_id"]] = (r["title_len"], r["body_len"], r["total_len"], sorted(hits.items()))
        assert {r["chunk_id"]: (r["title_len"], r["body_len"], r["total_len"], sorted(zip(r["ids"], r["tfs"]))) for r in found.rows.collect()} == want
        counted = Counter(i for *_, hits in want.values() for i, _ in hits)
        assert {int(i): int(n) for i, n in enumerate(found.frequency()) if n} == counted


def test_packed_postings_come_back():
    row = np.array([1, 1, 1, 4, 4, 5])
    ids, tfs = np.array([0, 7, 1 << 22, 3, 4, 0]), np.array([1, 300, 70_000, 1, 2, 1 << 21])
    packed = matching._pack(row, ids, tfs, 7)
    for low, high in ((0, 7), (1, 5), (2, 4), (4, 7), (3, 3)):
        own = (row >= low) & (row < high)
        got = matching._unpack(packed.slice(low, high - low))
        assert [x.tolist() for x in got] == [(row[own] - low).tolist(), ids[own].tolist(), tfs[own].tolist()]


def test_line_chunks_are_cut_without_a_shuffle(spark):
    """Headings, fences, breaks of every kind, signs that JSON escapes: as the ranges, texts and ids that column expressions give."""
    rng = random.Random(12)
    lines = ["", " ", "# A", "## B ##", "### ", "#no", "####### x", "  # C\t# ", "```", "~~~ x", "````", "~~~~", "plain", "é数😀" * 9, "y" * 70, 'q"\\\t\x08\x01', "# D ", "#  E", "``` a", "# x", "# x #\u0085"]
    texts = ["".join(x for _ in range(rng.randint(0, 25)) for x in (rng.choice(lines), rng.choice(["\n", "\r\n", "\r", "\n"]))) for _ in range(120)] + ["", None, "x" * 200]
    frame = spark.createDataFrame([(i, 3 + i % 4, t) for i, t in enumerate(texts)] + [(None, 1, "lost")], "source_id int, first_line int, text string").repartition(3)
    got = chunking.heading_line_chunks(frame, 100, F.col("first_line"))
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("MapInArrow")[0]
    assert "Exchange" not in plan and "Window" not in plan
    whole = chunking.fenced_lines(frame, F.col("first_line"))
    head = ~F.col("in_fence") & F.col("text").rlike(chunking.HEADING)
    title = chunking.strip_space(F.regexp_replace(F.regexp_extract("text", chunking.HEADING, 2), rf"[ \t]+#+[{chunking.SPACE}]*$", ""))
    level = F.when(head, F.length(F.regexp_extract("text", chunking.HEADING, 1)))
    held = {}
    for r in chunking.heading_stack(whole, level, F.when(head, title)).select("source_id", "line_no", "text", "level", "heading_path", chunking.utf16_length("text").alias("w"), chunking.is_blank("text").alias("blank")).collect():
        if r["source_id"] is not None:
            held.setdefault(r["source_id"], []).append(r)
    want = []
    for source, rows in held.items():
        rows.sort(key=lambda r: r["line_no"])
        starts = [i for i, r in enumerate(rows) if not i or r["level"] is not None] + [len(rows)]
        for a, b in zip(starts, starts[1:]):
            groups, used = [[]], 0
            for r in rows[a:b]:
                if groups[-1] and used + r["w"] + 1 > 100:
                    groups.append([])
                    used = 0
                groups[-1].append(r)
                used += r["w"] + 1
            for g in groups:
                ink = [k for k, r in enumerate(g) if not r["blank"]]
                if ink:
                    own = g[ink[0] : ink[-1] + 1]
                    want.append((source, own[0]["line_no"], own[-1]["line_no"], rows[a]["heading_path"], rows[a]["line_no"], rows[b - 1]["line_no"], "\n".join(r["text"] for r in own)))
    assert sorted(tuple(r)[:7] for r in got.collect()) == sorted(want)
    named = got.withColumn("same", F.col("chunk_id") == chunk_id(F.col("source_id").cast("string"), F.col("start_line"), F.col("end_line"), F.col("text")))
    assert named.filter("not same").isEmpty()


def test_lines_of_facts_are_looked_up_in_their_sources(spark, tmp_path, monkeypatch):
    """Only sources that hold a fact are split into lines, and no text is shuffled to be cut into chunks."""
    passage = "the first of seven words of a passage"
    texts = [(1, f"{passage}\nand the rest"), (2, f"before\n{passage}\nend"), (3, "none of it\nlines"), (4, "other\nlines")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, passage) for i in (1, 2)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _, _, lines, _ = evaluation.chunk_run(spark, str(tmp_path))
    assert {r["source_id"] for r in lines.collect()} == {1, 2}


def test_resamples_are_summed_within_tasks(spark, monkeypatch):
    """Sums of the draws of a task are those of the rows of draws; no draw is a row."""
    rng = random.Random(13)
    rows = [(i, i // 3, rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 2)) for i in range(90)]
    pairs = spark.createDataFrame([(*r[:2], min(r[2], r[4]), min(r[3], r[4]), r[4]) for r in rows], "ord long, grp long, b_covered long, c_covered long, expected long")
    order = lambda df: sorted(map(tuple, df.collect()))
    made = bootstrap.resample_deltas(pairs, 300, 7)
    assert "Join" not in made._jdf.queryExecution().toString()
    monkeypatch.setattr(bootstrap, "DRAWS_AT_ONCE", 100)
    small = bootstrap.resample_deltas(pairs, 300, 7)
    monkeypatch.setattr(bootstrap, "BROADCAST_ROW_LIMIT", 1)
    assert order(made) == order(small) == order(bootstrap.resample_deltas(pairs, 300, 7))
