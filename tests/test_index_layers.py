"""Merging of segments, removal of old files, and layers bound to their corpus."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.config import RetrievalOptions
from lodestone.errors import RetrievalError
from lodestone.functions.segmentation import HanDictionary
from lodestone.plans import index as ix
from lodestone.plans.index import EvidenceIndex, IndexProfile
from lodestone.plans.search import SearchEngine

from .test_index import StubEmbeddings, scan

IDS = [f"{i:08x}-1234-4234-8234-123456789abc" for i in range(40)]


def note(root, i, body):
    with open(os.path.join(root, f"n{i}.md"), "w") as out:
        out.write(f"---\nsource_id: {IDS[i]}\n---\n# Note {i}\n{body}")


def found(index, query, provider=None):
    options = RetrievalOptions(mode="hybrid" if provider else "bm25")
    rows = SearchEngine(index, provider, options).search([{"query": query}]).collect()
    return [(r["chunk_id"], r["start_line"]) for r in json.loads(rows[0]["response"])["results"]]


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    return str(folder)


def test_five_syncs_merge_into_one_segment(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "BUCKET_CHUNKS", 4)
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole"))
    words = ["vector index", "rollback plan", "vector rollback", "state machine", "plain words"]
    for step in range(5):
        for i in range(3):
            note(root, 3 * step + i, f"{words[(step + i) % 5]} number {i}\nvector note {step}")
        if step == 2:
            note(root, 0, "vector index, rewritten")
        if step == 3:
            os.remove(os.path.join(root, "n1.md"))
        index.sync(scan(spark, root), StubEmbeddings())
    state = index.state()
    assert len(state["segments"]) == 5 and [s["dead"] for s in state["segments"]] == [True, False, False, False, False]
    fresh = EvidenceIndex(spark, str(tmp_path / "fresh"), IndexProfile("whole"))
    fresh.sync(scan(spark, root), StubEmbeddings())
    key = index.profile.vector_key(StubEmbeddings())
    before = found(index, words[0], StubEmbeddings())
    assert index.compact(factor=5)["merged"] == 5 and index.compact(factor=5)["merged"] == 0
    merged = index.require("hybrid", key)
    assert len(merged["segments"]) == 1 and not merged["segments"][0]["dead"] and merged["segments"][0]["buckets"] == fresh.state()["segments"][0]["buckets"] > 1
    assert len(before) > 3 and found(index, words[0], StubEmbeddings()) == before == found(fresh, words[0], StubEmbeddings())
    rows = lambda i, s: sorted(map(tuple, i.postings(s).drop("bucket").collect()))
    assert rows(index, merged) == rows(fresh, fresh.state())
    assert index.chunks(merged).count() == fresh.chunks(fresh.state()).count() == 14
    assert sorted(r["chunk_id"] for r in index.vectors(merged, key).collect()) == sorted(r["chunk_id"] for r in fresh.vectors(fresh.state(), key).collect())
    plan = index.postings(merged)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Scan parquet") == 1 and "Join" not in plan
    # A sync goes on from the merged segment, and vectors of its texts are not made again.
    note(root, 30, "new words")
    again = index.sync(scan(spark, root), StubEmbeddings())
    assert (again["added"], again["unchanged"], again["usage"]["texts"]) == (1, 14, 1)


def test_tiers_hold_segments_of_like_size():
    segments = [{"rows": n} for n in (1, 2, 3, 17, 18, 20, 30, 70)]
    assert [s["rows"] for s in ix._full_tier(segments, 4)] == [17, 18, 20, 30]
    assert ix._full_tier(segments[:3], 4) == []
    assert [s["rows"] for s in ix._full_tier([{"rows": 0}, *segments[:3]], 4)] == [0, 1, 2, 3]


def test_terms_prune_buckets_and_rows(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "BUCKET_CHUNKS", 1)
    for i in range(9):
        note(root, i, f"word{i} common")
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole"))
    index.sync(scan(spark, root))
    state = index.state()
    terms = [(r["t"], r["h"]) for r in spark.sql("select t, xxhash64(t) as h from values ('common'), ('word3') as v(t)").collect()]
    rows = index.postings(state, terms).collect()
    assert {r["term"] for r in rows} == {"common", "word3"} and len(rows) == 10
    plan = index.postings(state, terms)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_old_files_go_after_their_readers(spark, root, tmp_path):
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole"))
    for i in range(3):
        note(root, i, f"words {i}")
        index.sync(scan(spark, root))
    index.compact(everything=True)
    folders = lambda: sorted(os.listdir(os.path.join(index.home, "segments")))
    assert len(folders()) == 4 and index.vacuum(retain_seconds=3600) == 0 and len(folders()) == 4
    assert index.vacuum(retain_seconds=0) > 0
    assert folders() == [index.state()["segments"][0]["id"]] and len(found(index, "words")) == 3
    note(root, 4, "words more")
    assert index.sync(scan(spark, root))["added"] == 1 and len(found(index, "words")) == 4


def test_a_stale_layer_leaves_others_usable(spark, root, tmp_path):
    provider = StubEmbeddings()
    note(root, 0, "vector words")
    profile = IndexProfile("whole", scope="a")
    index = EvidenceIndex(spark, str(tmp_path / "index"), profile)
    key = profile.vector_key(provider)
    with pytest.raises(RetrievalError) as error:
        index.require("bm25")
    assert error.value.code == "INDEX_REQUIRED"
    index.sync(scan(spark, root))
    with pytest.raises(RetrievalError, match="lacks vectors") as error:
        index.require("hybrid", key)
    assert error.value.code == "INDEX_REQUIRED"
    with pytest.raises(RetrievalError) as error:
        index.require("dense")
    assert error.value.code == "MODEL_CONFIG"
    index.sync(scan(spark, root), provider)
    assert index.require("hybrid", key) and index.require("dense", key)
    layers = index.state()["layers"]
    assert layers["vectors"][key]["parent"] == profile.chunk_key and layers["chunks"][profile.chunk_key]["parent"] is None
    note(root, 1, "more words")
    index.sync(scan(spark, root))  # without the provider: vectors stay with the earlier corpus
    assert index.require("bm25")
    for mode in ("hybrid", "dense"):
        with pytest.raises(RetrievalError, match="vectors belong to an earlier corpus") as error:
            index.require(mode, key)
        assert error.value.code == "INDEX_STALE"
    assert index.status(mode="hybrid", vector_key=key)["reason"]["code"] == "INDEX_STALE"
    other = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole", scope="b"))
    with pytest.raises(RetrievalError, match="other folders") as error:
        other.require("bm25")
    assert error.value.code == "INDEX_STALE"
    # Another tokeniser is a layer of its own; its sync leaves the first one stale only if the corpus moved on.
    second = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole", scope="a", dictionary=("more words",)))
    with pytest.raises(RetrievalError) as error:
        second.require("bm25")
    assert error.value.code == "INDEX_REQUIRED"
    second.sync(scan(spark, root))
    assert second.require("bm25") and index.require("bm25")
    note(root, 2, "third")
    second.sync(scan(spark, root))
    with pytest.raises(RetrievalError) as error:
        index.require("bm25")
    assert error.value.code == "INDEX_STALE"
    index.sync(scan(spark, root), provider)
    assert index.require("hybrid", key)


def test_han_dictionary_is_part_of_the_profile(spark, root, tmp_path):
    note(root, 0, "数据库备份")
    note(root, 1, "据库 other")
    words = HanDictionary([("数据库", 5), ("备份", 5)])
    plain, cut = IndexProfile("whole"), IndexProfile("whole", han=words)
    assert plain.chunk_key == cut.chunk_key and plain.term_key != cut.term_key
    for profile, terms in ((plain, set()), (cut, {"数据库"})):
        index = EvidenceIndex(spark, str(tmp_path / "index"), profile)
        index.sync(scan(spark, root))
        assert {r["term"] for r in index.postings(index.state()).filter(F.length("term") == 3).filter("term like '%据%'").collect()} == terms
        assert len(found(index, "数据库")) == 2  # by the shared bigram


def test_two_mergers_cannot_both_publish(spark, root, tmp_path):
    index = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole"))
    for i in range(2):
        note(root, i, "words")
        index.sync(scan(spark, root))
    state = index.state()
    late = EvidenceIndex(spark, str(tmp_path / "index"), IndexProfile("whole"))
    late.state = lambda: state
    index.compact(everything=True)
    with pytest.raises(RetrievalError) as error:
        late.compact(everything=True)
    assert error.value.code == "BUSY"
    assert len(os.listdir(os.path.join(index.home, "segments"))) == 3 and len(found(index, "words")) == 2


