"""Files to published index to budgeted answers to scored runs, with a stub embedder."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.config import RetrievalOptions
from lodestone.errors import RetrievalError
from lodestone.operators import chunking
from lodestone.plans import evaluate as ev
from lodestone.plans.index import EvidenceIndex, IndexProfile, register_chunker
from lodestone.plans.search import SearchEngine
from lodestone.sources import embedding, markdown as md, records
from lodestone.streaming.ingest import stream_markdown

IDS = {name: f"{i}2345678-1234-4234-8234-123456789abc" for i, name in enumerate(("a", "b", "state"), 1)}
NOTES = {
    "a": "# Vector database\n## Build\nvector index build settings\n## Query\nvector query latency",
    "b": "# Rollback\nrollback transaction failure",
    "state": "# State\nmax_output_tokens and HTTPServer identifiers",
}


class StubEmbeddings:
    """One axis per topic word, so similarity is known."""

    fingerprint, dimensions = "stub-1", 3

    def embed(self, texts, purpose):
        if any("unavailable" in t for t in texts):
            raise ValueError("Embedding API HTTP 503")
        axis = lambda t: [1.0, 0, 0] if "vector" in t.lower() else [0, 1.0, 0] if "rollback" in t.lower() else [0, 0, 1.0]
        return [axis(t) for t in texts], 7


def write(root, name, body, identity=True):
    front = f"---\nsource_id: {IDS[name]}\n---\n" if identity else ""
    with open(os.path.join(root, f"{name}.md"), "w") as out:
        out.write(front + body)


@pytest.fixture
def notes(tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    for name, body in NOTES.items():
        write(root, name, body)
    return str(root)


def scan(spark, root, **kw):
    return md.parse_sources(md.scan_markdown(spark, root, "test", **kw))


def test_scan_scope_and_lines(spark, notes):
    os.makedirs(os.path.join(notes, "deep", "node_modules"))
    for path in ("deep/UPPER.MD", "deep/skip.txt", "deep/node_modules/x.md"):
        with open(os.path.join(notes, path), "w") as out:
            out.write("text")
    names = lambda **kw: sorted(r["relative_path"] for r in md.scan_markdown(spark, notes, "c", **kw).collect())
    assert names() == ["a.md", "b.md", "deep/UPPER.MD", "state.md"]
    assert names(include=["deep/**"]) == ["deep/UPPER.MD"]
    assert names(exclude=["*.md"]) == ["deep/UPPER.MD", "deep/node_modules/x.md"]
    rows = {r["relative_path"]: r for r in scan(spark, notes).collect()}
    assert rows["a.md"]["source_id"] == IDS["a"] and rows["a.md"]["first_line"] == 4
    assert not rows["deep/UPPER.MD"]["has_identity"] and rows["deep/UPPER.MD"]["first_line"] == 1
    with open(os.path.join(notes, "bad.md"), "wb") as out:
        out.write(b"\xff\xfe")
    with pytest.raises(Exception, match="not valid UTF-8"):
        scan(spark, notes).collect()
    with pytest.raises(Exception, match="max_file_bytes"):
        scan(spark, notes, include=["a.md"], max_file_bytes=10).collect()


@pytest.mark.parametrize(
    "pattern,yes,no",
    [("*.md", "a.md", "x/a.md"), ("**/*.md", "x/y/a.md", "a.txt"), ("{a,b}?.md", "a1.md", "c1.md"), ("x/**", "x/y/z", "y/x"), ("[!a].md", "b.md", "a.md")],
)
def test_globs(pattern, yes, no):
    import re

    assert re.match(md.glob_regex(pattern), yes) and not re.match(md.glob_regex(pattern), no)


@pytest.mark.parametrize(
    "front,message",
    [("---\na: 1", "Unclosed"), ("---\n- x\n---", "mapping"), ("---\na: 1\na: 2\n---", "duplicate"), ("---\nsource_id: nope\n---", "UUID")],
)
def test_frontmatter_errors(spark, tmp_path, front, message):
    (tmp_path / "x.md").write_text(front + "\nbody")
    with pytest.raises(Exception, match=message):
        scan(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("raw", ["plain\n", "---\ntitle: x\n---\nbody", "---\n{title: x}\n---\nbody", "---\n{}\n---\nb", "﻿x\r\ny", "---\n  title: x\n  b: 2\n---\nz"])
def test_identity_is_written_once_and_keeps_the_rest(tmp_path, raw):
    path = tmp_path / "n.md"
    path.write_bytes(raw.encode())
    new = md.write_identity(str(path))
    text = path.read_bytes().decode()
    assert text.count(new) == 1 and text.endswith(raw.lstrip("﻿").split("---\n")[-1])
    assert text.startswith("﻿") == raw.startswith("﻿")
    with pytest.raises(ValueError):
        md.write_identity(str(path))


def test_jsonl_and_write_once(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"id": "1", "t": "a b"}\n\n{"id": "2", "t": null}\n')
    rows = records.read_jsonl(spark, str(path), "id string, t string")
    assert [r["t"] for r in rows.orderBy("id").collect()] == ["a b", None]
    records.write_once(rows, str(tmp_path / "out"))
    with pytest.raises(Exception):
        records.write_once(rows, str(tmp_path / "out"))
    path.write_text('{"id": oops}\n')
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(path), "id string, t string").collect()


def test_embedding_responses_and_ledger(spark):
    body = {"data": [{"index": 1, "embedding": [0.0, 1.0]}, {"index": 0, "embedding": [1.0, 0.0]}]}
    assert embedding.ordered_vectors(body, 2, 2) == [[1.0, 0.0], [0.0, 1.0]]
    for bad in ({}, {"data": [{"index": 0, "embedding": [1.0, 0.0]}] * 2}, {"data": body["data"][:1]}, {"data": [{"index": 0, "embedding": [1.0]}, body["data"][0]]}):
        with pytest.raises(ValueError):
            embedding.ordered_vectors(bad, 2, 2)
    texts = spark.createDataFrame([("vector",), ("vector",), ("rollback",)], "text string")
    done = embedding.embed_texts(texts, StubEmbeddings()).cache()
    assert done.count() == 2
    ledger = embedding.usage_ledger(done).first()
    assert ledger["texts"] == 2 and ledger["input_chars"] == 14 and ledger["reported_tokens"] == 7 * ledger["requests"]
    with pytest.raises(ValueError):
        embedding.HttpEmbeddings("http://user:pw@host/v1", "m", 3, "KEY")
    with pytest.raises(ValueError, match="key missing"):
        embedding.HttpEmbeddings("http://host/v1", "m", 3, "NO_SUCH_KEY_HERE").embed(["x"], "query")


def test_sync_lifecycle_and_search(spark, notes, tmp_path):
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("heading-1000"))
    with pytest.raises(RetrievalError) as missing:
        index.require("bm25")
    assert missing.value.code == "INDEX_REQUIRED"
    first = index.sync(scan(spark, notes), StubEmbeddings())
    assert (first["added"], first["unchanged"]) == (3, 0) and first["usage"]["texts"] > 0
    again = index.sync(scan(spark, notes), StubEmbeddings(), rescan=lambda: scan(spark, notes))
    assert (again["added"], again["updated"], again["unchanged"]) == (0, 0, 3)
    assert len(index.state()["segments"]) == 1  # nothing rewritten

    engine = SearchEngine(index, StubEmbeddings(), collections={"test"})
    rows = engine.search(
        [
            {"query": "vector index"}, {"query": "HTTPServer", "overrides": {"mode": "bm25"}},
            {"queries": [{"query_id": "r", "text": "rollback", "variants": ["transaction failure"]}, {"query_id": "v", "text": "vector query"}]},
            {"query": "vector", "filters": {"source_ids": []}}, {"query": "vector", "filters": {"path_prefix": "b"}, "overrides": {"mode": "bm25"}},
            {"query": "unavailable rollback"},
        ]
    ).collect()
    body = {r["request_id"]: json.loads(r["response"]) for r in rows}
    hits = lambda i: [(e["path"].rsplit("/", 1)[-1], e["start_line"]) for e in body[i]["results"]]
    assert {h[0] for h in hits(0)[:3]} == {"a.md"} and body[0]["status"] == "ok"
    assert [h[0] for h in hits(1)] == ["state.md"]
    assert body[2]["results"][0]["path"].endswith("b.md") and {q["query_id"] for q in body[2]["queries"]} == {"r", "v"}
    assert body[3]["results"] == [] and body[3]["queries"][0]["empty_reason"] == "no_candidates"
    assert body[4]["results"] == []
    assert body[5]["status"] == "partial_failure" and hits(5)[0][0] == "b.md"
    with pytest.raises(RetrievalError):
        engine.search([{"query": "x", "filters": {"collections": ["other"]}}])

    write(notes, "b", "# Rollback\nnow about checkpoints")
    os.unlink(os.path.join(notes, "state.md"))
    fresh = index.status(scan(spark, notes))["freshness"]
    assert (fresh["added"], fresh["modified"], fresh["removed"], fresh["state"]) == (0, 1, 1, "changed")
    changed = index.sync(scan(spark, notes), StubEmbeddings())
    assert (changed["updated"], changed["removed"], changed["unchanged"]) == (1, 1, 1)
    late = engine.search([{"query": "failure", "overrides": {"mode": "bm25"}}, {"query": "checkpoints", "overrides": {"mode": "bm25"}}])
    found = {r["request_id"]: json.loads(r["response"])["results"] for r in late.collect()}
    assert found[0] == [] and len(found[1]) == 1
    status = index.status(mode="bm25")
    assert status["ready"] and status["sources"] == 2 and status["freshness"]["state"] == "unchecked"
    with pytest.raises(RetrievalError) as stale:
        EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("heading-1000", scope="other")).require("bm25")
    assert stale.value.code == "INDEX_STALE"


def test_failed_sync_publishes_nothing(spark, notes, tmp_path):
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("paragraph"))
    index.sync(scan(spark, notes))
    before = index.state()
    write(notes, "b", "changed text")
    with pytest.raises(RetrievalError, match="changed while syncing"):
        index.sync(scan(spark, notes), rescan=lambda: scan(spark, notes, include=["a.md"]))
    assert index.state() == before
    with open(os.path.join(notes, "copy.md"), "w") as out:
        out.write(f"---\nsource_id: {IDS['a']}\n---\nx")
    with pytest.raises(RetrievalError, match="Duplicate identity"):
        index.sync(scan(spark, notes))


def test_second_writer_loses_nothing(spark, notes, tmp_path):
    root = str(tmp_path / "index")
    index, other = (EvidenceIndex(spark, root, IndexProfile("whole")) for _ in range(2))

    def meanwhile():
        other.sync(scan(spark, notes))
        return scan(spark, notes)

    with pytest.raises(RetrievalError) as busy:
        index.sync(scan(spark, notes), rescan=meanwhile)
    assert busy.value.code == "BUSY" and index.status()["sources"] == 3
    os.unlink(os.path.join(root, os.path.basename(index.home), "CURRENT.json"))  # the commits alone tell the state
    assert index.state()["revision"] == other.state()["revision"]


def test_known_texts_are_not_embedded_again(spark, notes, tmp_path):
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole"))
    assert index.sync(scan(spark, notes), StubEmbeddings())["usage"]["texts"] == 3
    with open(os.path.join(notes, "a.md"), "a") as out:
        out.write("\n")  # another version of the file, whose chunk ends in a blank line more
    write(notes, "b", NOTES["b"] + " again")
    write(notes, "b", NOTES["b"])
    usage = index.sync(scan(spark, notes), StubEmbeddings())["usage"]
    assert usage["texts"] == 1
    write(notes, "a", NOTES["a"])
    back = index.sync(scan(spark, notes), StubEmbeddings())
    assert back["updated"] == 1 and back["usage"]["texts"] == 0
    assert index.vectors(index.state(), index.profile.vector_key(StubEmbeddings())).count() == 3


def test_user_dictionary_reaches_index_and_query(spark, notes, tmp_path):
    write(notes, "state", "# State\nplain text about ＰＬＡＮ b rollout")
    found = {}
    for words in ((), ("Plan B", "在")):
        index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole", dictionary=words))
        index.sync(scan(spark, notes))
        found[words] = index.postings(index.state()).filter("term in ('plan b', '在')").select("term").distinct().collect()
        rows = SearchEngine(index, None, RetrievalOptions(mode="bm25")).search([{"query": "plan b"}]).collect()
        # b.md is found by its title.
        assert {r["path"].rsplit("/", 1)[-1] for r in json.loads(rows[0]["response"])["results"]} == {"b.md", "state.md"}
    assert [[r["term"] for r in rows] for rows in found.values()] == [[], ["plan b"]]


def test_chunker_keys_follow_code_and_parameters():
    keys = {name: IndexProfile(name).chunk_key for name in ("structure", "heading-1000", "heading-500", "paragraph", "whole")}
    assert len(set(keys.values())) == len(keys) and keys["structure"] == IndexProfile("structure").chunk_key


def test_section_without_bounds_is_the_chunk_itself(spark):
    pieces = spark.createDataFrame(
        [("q", "s", "p", 1, 2, 3, None, None)],
        "query_id string, source_id string, path string, rank int, start_line int, end_line int, section_start_line int, section_end_line int",
    )
    lines = spark.createDataFrame([("s", i, "line") for i in range(1, 6)], "source_id string, line_no int, text string")
    budget = spark.createDataFrame([("q", 1000)], "query_id string, room int")
    read = ev.supplement_sections(pieces, lines, budget).collect()
    assert [(r["rank"], r["end_line"]) for r in read] == [(1, 3)]


def test_custom_chunker_cannot_alter_text(spark, notes, tmp_path):
    def beyond(sources):
        return sources.select(
            "source_id", F.lit(1).alias("start_line"), F.col("last_line").alias("end_line"), F.array(F.lit("h")).alias("heading_path"),
            F.lit(None).cast("int").alias("section_start_line"), F.lit(None).cast("int").alias("section_end_line"),
        )

    register_chunker("whole-file", "1", beyond)
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole-file"))
    with pytest.raises(RetrievalError, match="frontmatter"):
        index.sync(scan(spark, notes))


def test_streamed_files_reach_the_index(spark, notes, tmp_path):
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("paragraph"))
    stream_markdown(index, notes, "test", str(tmp_path / "progress")).awaitTermination(120)
    assert index.status()["sources"] == 3


def dataset(spark, notes, tmp_path, name="set.json", **changes):
    rows = {r["relative_path"]: r for r in scan(spark, notes).collect()}
    anchor = lambda p, a, b, q: {"collection_id": "test", "path": p, "start_line": a, "end_line": b, "quote": q}
    body = {
        "version": 1, "name": "tiny", "split": "development", "scenario": {"id": "s", "kind": "separate"},
        "corpus": [{"collection_id": "test", "path": p, "sha256": r["source_version"]} for p, r in rows.items()],
        "facts": [
            {"id": "f1", "evidence": [anchor("b.md", 5, 5, "rollback transaction failure")]},
            {"id": "f2", "evidence": [anchor("a.md", 6, 6, "vector index build settings"), anchor("a.md", 8, 8, "vector query latency")]},
        ],
        "questions": [
            {"id": "q1", "intent_group": "g1", "type": "single", "query": "rollback transaction", "required_facts": ["f1"]},
            {"id": "q2", "intent_group": "g2", "type": "multi", "query": "vector and rollback", "required_facts": ["f1", "f2"],
             "subquestions": [{"id": "s1", "text": "vector index", "required_facts": ["f2"]}, {"id": "s2", "text": "rollback", "required_facts": ["f1"]}]},
            {"id": "q3", "intent_group": "g3", "type": "single", "query": "zzz qqq", "required_facts": [], "no_answer": True},
        ],
    }
    body.update(changes)
    path = tmp_path / name
    path.write_text(json.dumps(body))
    return ev.EvaluationDataset(spark, str(path))


def test_evaluation_end_to_end(spark, notes, tmp_path):
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("heading-1000"))
    index.sync(scan(spark, notes))
    sources = scan(spark, notes).cache()
    lines = chunking.source_lines(sources, first_line=F.col("first_line"))
    data = dataset(spark, notes, tmp_path)
    options = RetrievalOptions(mode="bm25")
    engine = SearchEngine(index, None, options)
    rows = {r["query_id"]: r for r in ev.run_evaluation(engine, data, sources, lines).collect()}
    assert (rows["q1"]["covered"], rows["q1"]["expected"], rows["q1"]["rr"]) == (1, 1, 1.0)
    assert (rows["q2"]["covered"], rows["q2"]["expected"]) == (2, 2)
    assert rows["q3"]["no_answer"] and rows["q3"]["returned"] == 0 and rows["q1"]["chars"] <= 20000
    run = ev.run_evaluation(engine, data, sources, lines)
    worse = run.withColumn("covered", F.when(F.col("query_id") == "q2", 1).otherwise(F.col("covered")))
    compared = {(r["scope"], r["metric"]): r for r in ev.compare_runs(worse, run, 100, 3).collect()}
    assert compared[("all", "fact_coverage")]["delta"] == pytest.approx(1 / 3)
    assert ("type:multi", "complete_evidence") in compared
    with pytest.raises(RetrievalError):
        ev.pair_runs(run, run.filter("query_id <> 'q1'"))


def test_label_problems_are_found(spark, notes, tmp_path):
    sources = scan(spark, notes).cache()
    lines = chunking.source_lines(sources, first_line=F.col("first_line"))
    assert ev.label_problems(dataset(spark, notes, tmp_path), sources, lines).count() == 0
    broken = dataset(
        spark, notes, tmp_path, "bad.json", corpus=[{"collection_id": "test", "path": "a.md", "sha256": "0" * 64}],
        facts=[{"id": "f1", "evidence": [{"collection_id": "test", "path": "b.md", "start_line": 5, "end_line": 5, "quote": "forged"}]}],
        questions=[
            {"id": "q", "intent_group": "g", "type": "t", "query": "x", "required_facts": ["f1", "f9"], "no_answer": True},
            {"id": "p", "intent_group": "g", "type": "t", "query": "x", "required_facts": ["f1"], "subquestions": [{"id": "s", "text": "y", "required_facts": ["f2"]}]},
        ],
    )
    kinds = {r["kind"] for r in ev.label_problems(broken, sources, lines).collect()}
    assert kinds == {
        "corpus differs from manifest", "invalid anchor", "answerability", "unknown required fact",
        "subquestion fact outside parent", "subquestions omit parent fact",
    }


def test_budgeted_requests_and_strategies():
    request = ev.budgeted_request({"query": "what"}, 1000, 20000)
    size = len(json.dumps(request, separators=(",", ":")))
    assert size + request["overrides"]["max_context_chars"] <= 1000
    with pytest.raises(RetrievalError):
        ev.budgeted_request({"query": "x" * 900}, 1000, 20000)
    names = [s["name"] for s in ev.strategy_grid(False, 6)]
    assert names == ["dense_default", "hybrid_default", "hybrid_unrestricted", "hybrid_subquestions", "hybrid_with_host_read"]
    assert [s["name"] for s in ev.strategy_grid(True, 6)] == ["bm25_default", "bm25_unrestricted", "bm25_with_host_read"]
