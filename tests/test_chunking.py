"""Chunkers on authored Markdown: structure, fences, overlap, exact text."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.operators.structure import structure_ranges

FIRST = 10


def run(spark, chunker, docs):
    """{doc: [(start, end, headings, section, text)]} in order, lines numbered from FIRST."""
    if isinstance(docs, str):
        docs = [docs]
    rows = [(f"s{i:03d}", d) for i, d in enumerate(docs)]
    sources = spark.createDataFrame(rows, "source_id string, text string")
    ranges = chunker(sources, first_line=F.lit(FIRST))
    chunks = chunking.attach_text(ranges, chunking.source_lines(sources, first_line=F.lit(FIRST)))
    found = {r[0]: [] for r in rows}
    for r in sorted(chunks.collect(), key=lambda r: (r["start_line"], r["end_line"])):
        found[r["source_id"]].append(r)
    return list(found.values())


def structure(spark, text):
    chunks = run(spark, structure_ranges, text)[0]
    check_whole(text, chunks)
    return chunks


def check_whole(text, chunks):
    lines = text.split("\n")
    seen = set()
    for c in chunks:
        assert c["text"] == "\n".join(lines[c["start_line"] - FIRST : c["end_line"] - FIRST + 1])
        assert c["section_start_line"] <= c["start_line"] and c["section_end_line"] >= c["end_line"]
        seen.update(range(c["start_line"], c["end_line"] + 1))
        if len(c["text"].encode("utf-16-le")) // 2 > 1500:
            assert c["start_line"] == c["end_line"]
    missing = [n for n, t in enumerate(lines, FIRST) if t.strip() and n not in seen]
    assert not missing


def test_code_joins_preceding_prose_within_the_allowance(spark):
    code = "~~~js\n" + "x" * 590 + "\n~~~"
    chunks = structure(spark, "# Topic\n" + "前" * 700 + "\n\n" + code)
    assert len(chunks) == 1 and code in chunks[0]["text"] and len(chunks[0]["text"]) > 1000


def test_fitting_code_moves_intact(spark):
    code = "```js\n" + "x" * 800 + "\n```"
    chunks = structure(spark, "# Topic\n" + "前" * 900 + "\n\n" + code)
    assert len(chunks) == 2 and chunks[1]["text"] == code


@pytest.mark.parametrize("fence", ["```", "~~~~"])
def test_headings_inside_fences_do_not_count(spark, fence):
    code = f"{fence}md\n# fake\n\n## also fake\n{fence}"
    chunks = structure(spark, f"# Real\n{code}\n## Next\ntext")
    assert any(code in c["text"] for c in chunks)
    assert "fake" not in [h for c in chunks for h in c["heading_path"]]


def test_unclosed_fence_runs_to_the_end(spark):
    chunks = structure(spark, "# Real\n~~~md\n## stays code\nlast")
    assert len(chunks) == 1 and chunks[0]["heading_path"] == ["Real"]


def test_setext_headings(spark):
    chunks = structure(spark, "Title\n=====\n\nSub\n---\ncontent")
    assert len(chunks) == 1 and chunks[0]["heading_path"] == ["Title", "Sub"]
    assert "Sub\n---" in chunks[0]["text"]


def test_short_siblings_merge_only_under_an_explicit_parent(spark):
    chunks = structure(spark, "# Root\n## Benefits\n" + "a" * 80 + "\n## Costs\n" + "b" * 80)
    assert len(chunks) == 1 and chunks[0]["heading_path"] == ["Root"]
    assert len(structure(spark, "# Root A\nshort\n# Root B\nshort")) == 2


def test_long_siblings_stay_apart_and_bare_headings_fold_forward(spark):
    assert len(structure(spark, "# Root\n## A\n" + "a" * 300 + "\n## B\n" + "b" * 300)) == 2
    child = structure(spark, "# Root\n## Parent\n### Child\nbody")
    assert [c["text"] for c in child] == ["# Root\n## Parent\n### Child\nbody"]
    assert child[0]["section_start_line"] == FIRST


def test_tables_and_lists_stay_whole(spark):
    table = "| key | value |\n| --- | --- |\n" + "\n".join(f"| {i} | {'x' * 145} |" for i in range(5))
    assert any(table in c["text"] for c in structure(spark, "# Table\n" + "前" * 900 + "\n\n" + table))
    items = "\n".join(f"- item {i} {'x' * 120}" for i in range(6))
    assert any(items in c["text"] for c in structure(spark, "# List\n" + "前" * 900 + "\n\n" + items))


def test_only_oversized_blocks_overlap(spark):
    code = "~~~js\n" + "\n".join(f"line{i} {'x' * 85}" for i in range(35)) + "\n~~~"
    chunks = structure(spark, "# Code\n" + code)
    assert len(chunks) > 2
    assert any(b["start_line"] <= a["end_line"] for a, b in zip(chunks, chunks[1:]))
    assert sum("~~~js" in c["text"] for c in chunks) == 1


def test_single_long_line_title_and_empty_input(spark):
    line = "😀" * 1100
    assert any(c["text"] == line for c in structure(spark, "# Large\n" + line))
    assert len(structure(spark, "# Only title")) == 1
    assert structure(spark, "") == []


def test_long_heading_is_kept_in_text_and_bounded_in_the_path(spark):
    title = "😀" * 1100
    chunks = structure(spark, "# " + title + "\nbody")
    assert any(c["text"] == "# " + title for c in chunks)
    for heading in (h for c in chunks for h in c["heading_path"]):
        assert len(heading.encode("utf-16-le")) // 2 <= 2000 and heading.endswith("…")


def test_indented_pipes_are_code(spark):
    code = "\n".join(["    a | b " + "x" * 390, "    --- | ---", "    c | d " + "y" * 390, "    tail " + "z" * 390])
    assert any(c["text"] == code for c in structure(spark, "# R\n" + "p" * 600 + "\n\n" + code))


def test_overlap_over_blank_rows_makes_progress(spark):
    text = "# List\n\n" + "\n\n".join(f"{i + 1}. {x * 640}" for i, x in enumerate("abcd"))
    assert sum("b" * 640 in c["text"] for c in structure(spark, text)) == 1


def test_no_line_is_lost_in_mixed_documents(spark):
    rng = random.Random(71)
    docs = []
    for _ in range(60):
        parts = ["# Root"]
        for k in range(12):
            body = "文" * rng.randint(1, 2100)
            parts += rng.choice(
                [[f"## Section {k}", body], ["~~~txt", body, "", "# still code", "~~~"], ["- first", "  continuation", "- " + body], ["> " + body], [body]]
            )
            parts.append("")
        docs.append("\n".join(parts))
    for text, chunks in zip(docs, run(spark, structure_ranges, docs)):
        check_whole(text, chunks)


def greedy(lines, limit):
    """Reference walk for one section without headings."""
    out, start, used = [], 0, 0
    for i, line in enumerate(lines):
        if i > start and used + len(line) + 1 > limit:
            out.append((start, i - 1))
            start, used = i, 0
        used += len(line) + 1
    out.append((start, len(lines) - 1))
    trimmed = []
    for a, b in out:
        while a <= b and not lines[a].strip():
            a += 1
        while b >= a and not lines[b].strip():
            b -= 1
        if a <= b:
            trimmed.append((a + FIRST, b + FIRST))
    return trimmed


def test_heading_lines_chunker_fills_whole_lines(spark):
    rng = random.Random(5)
    docs = ["\n".join("x" * rng.choice([0, 3, 30, 70, 200]) for _ in range(40)) for _ in range(10)]
    got = run(spark, lambda s, first_line: chunking.heading_line_ranges(s, 100, first_line), docs)
    for text, chunks in zip(docs, got):
        assert [(c["start_line"], c["end_line"]) for c in chunks] == greedy(text.split("\n"), 100)


def test_heading_lines_stack_and_fences(spark):
    text = "intro\n# A #\n### Deep\nx\n## B\ny\n```\n# no\n```\n# C\nz"
    chunks = run(spark, lambda s, first_line: chunking.heading_line_ranges(s, 1000, first_line), text)[0]
    assert [c["heading_path"] for c in chunks] == [[], ["A"], ["A", "Deep"], ["A", "B"], ["C"]]
    assert chunks[3]["text"] == "## B\ny\n```\n# no\n```"
    assert (chunks[3]["section_start_line"], chunks[3]["section_end_line"]) == (FIRST + 4, FIRST + 8)


def test_paragraphs_and_bare_heading_filter(spark):
    text = "a\nb\n\n  \nc"
    chunks = run(spark, lambda s, first_line: chunking.paragraph_ranges(chunking.source_lines(s, first_line=first_line)), text)[0]
    assert [c["text"] for c in chunks] == ["a\nb", "c"]

    def filtered(s, first_line):
        ranges = chunking.heading_line_ranges(s, 1000, first_line)
        return chunking.drop_bare_headings(ranges, chunking.source_lines(s, first_line=first_line))

    kept = run(spark, filtered, "# A\n## B\nbody\n# Lonely")[0]
    assert [c["heading_path"] for c in kept] == [["A", "B"], ["Lonely"]]


def test_contract_violations_are_reported(spark):
    sources = spark.createDataFrame([("abc", 3, 6, "x\n\ny\nz")], "source_id string, first_line int, last_line int, text string")
    rows = [
        ("abc", 3, 3, ["fine"], 3, 6), ("abc", 5, 9, [], 3, 6), ("abc", 4, 4, [], None, None),
        ("abc", 3, 3, ["has ABC inside"], None, None), ("abc", 5, 6, [], 5, None), ("abc", 3, 5, [], 4, 6),
    ]
    ranges = spark.createDataFrame(
        rows, "source_id string, start_line int, end_line int, heading_path array<string>, section_start_line int, section_end_line int"
    ).withColumn("k", F.monotonically_increasing_id())
    lines = chunking.source_lines(sources, first_line=F.col("first_line"))
    rules = set()
    for k in [r["k"] for r in ranges.select("k").collect()]:
        one = chunking.attach_text(ranges.filter(F.col("k") == k).drop("k"), lines)
        rules |= {r["rule"] for r in chunking.invalid_ranges(one, sources).collect()}
    assert rules == {
        "Chunk crosses unavailable or frontmatter lines", "Empty chunk", "Identity in chunk headings",
        "Both section bounds are required", "Invalid section bounds",
    }
