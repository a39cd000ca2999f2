"""Han dictionary segmentation against every way to cut a run."""

import itertools
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.segmentation import UNKNOWN, HanDictionary, han_segments
from lodestone.functions.text import tokenize

LETTERS = "天地人山水"


def cheapest(run, words):
    """All cuts of a run; of the cheapest the one whose last word is longest, then its last but one, and so on."""
    best = None
    for marks in itertools.product((0, 1), repeat=max(len(run) - 1, 0)):
        cut, low = [], 0
        for i, mark in enumerate((*marks, 1), 1):
            if mark:
                cut.append(run[low:i])
                low = i
        costs = [words.get(w, UNKNOWN if len(w) == 1 else None) for w in cut]
        if None in costs:
            continue
        key = (sum(costs), [-len(w) for w in reversed(cut)])
        best = min(best, (key, cut)) if best else (key, cut)
    return best[1]


@pytest.mark.parametrize("seed", range(4))
def test_segments_equal_all_cuts(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices(LETTERS, k=rng.choice((1, 2, 2, 3, 4)))): rng.choice((0, 5, 10, 10, 20, 300)) for _ in range(12)}
    runs = ["".join(rng.choices(LETTERS, k=rng.randint(0, 9))) for _ in range(150)] + ["天" * 9, ""]
    assert HanDictionary(words.items()).segment(runs) == [cheapest(r, words) if r else [] for r in runs]


@pytest.mark.parametrize("slice_", [1, 7, 40, 1 << 19])
def test_slices_and_lists_equal_runs(monkeypatch, slice_):
    """Runs cut a slice at a time, and out of their own bytes: the same words, null and empty rows, slices of arrays, astral characters."""
    rng = random.Random(slice_)
    letters = LETTERS + "\U00020000"
    words = HanDictionary(("".join(rng.choices(letters, k=rng.choice((1, 2, 3)))), rng.randint(0, 300)) for _ in range(20))
    rows = [["".join(rng.choices(letters, k=rng.randint(1, 20))) for _ in range(rng.randint(0, 4))] for _ in range(60)] + [None, [], ["的", "天"]]
    want = [[w for run in r or () for w in words.segment([run])[0] if w != "的"] for r in rows]
    monkeypatch.setattr("lodestone.functions.segmentation.SLICE", slice_)
    assert words.segment_lists(pa.array(rows, pa.list_(pa.string()))).to_pylist() == want
    assert words.segment_lists(pa.array(rows, pa.list_(pa.string())).slice(9)).to_pylist() == want[9:]
    assert words.segment_lists(pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_a_step_of_a_long_path_costs_nothing_for_other_runs():
    """Each word of the longest path looked through the borders of all runs together."""
    words = HanDictionary([("山水", 1), ("水山", 1)])
    begin = time.process_time()
    out = words.segment(["山水" * 8_000, "人" * 2_000_000])
    assert out[0] == ["山水"] * 8_000 and len(out[1]) == 2_000_000
    assert time.process_time() - begin < 8


def test_long_runs_and_no_dictionary():
    assert HanDictionary([]).segment(["山水", "", "人"]) == [["山", "水"], [], ["人"]]
    chain = HanDictionary([("山水", 1), ("水山", 1)])
    assert chain.segment(["山水" * 5_000]) == [["山水"] * 5_000]
    assert chain.segment(["水山" * 300 + "水"])[0][-1] in ("水", "山水") and "".join(chain.segment(["水山" * 300 + "水"])[0]) == "水山" * 300 + "水"


def test_dictionary_files_costs_and_bounds(tmp_path, monkeypatch):
    path = tmp_path / "words.txt"
    path.write_text("# comment\n天地\t7\n天地\t3\n山\n\n", encoding="utf-8")
    assert HanDictionary.read(str(path)).entries == (("天地", 3), ("山", 0))
    assert HanDictionary([("a", 1)]).fingerprint != HanDictionary([("a", 2)]).fingerprint
    with pytest.raises(ValueError, match="cost"):
        HanDictionary([("天", -1)])
    monkeypatch.setattr("lodestone.functions.segmentation.MAX_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        HanDictionary([("天地", 1)])


def test_segments_reach_the_terms(spark):
    words = HanDictionary([("数据", 10), ("数据库", 12), ("备份", 10), ("的", 1)])
    rows = [(1, "如何备份 数据库的 data"), (2, None), (3, "plain"), (4, "数据备份，库")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["w"] for r in df.select("id", han_segments(F.col("text"), words).alias("w")).collect()}
    assert got == {1: ["备份", "数据库"], 2: [], 3: [], 4: ["数据", "备份", "库"]} or got[1] == ["如", "何", "备份", "数据库"]
    terms = {r["id"]: r["t"] for r in df.select("id", tokenize("text", han=words).alias("t")).collect()}
    plain = {r["id"]: r["t"] for r in df.select("id", tokenize("text").alias("t")).collect()}
    assert terms[3] == plain[3] and "数据库" in terms[1] and "数据库" not in plain[1]
    assert terms[4][:3] == ["数据", "备份", "库"] and set(plain[4]) <= set(terms[4])
