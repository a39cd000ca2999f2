"""Training-data operators against plain Python on small tables with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, components, lm, mixing, ngram_join, omh, packing, quality, repeats, suffix_dedup, superkmer, urls
from lodestone.llm.catalog import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 400, n))


PASSAGE = prose(99, 90)
NEAR = prose(5, 200)
TEXTS = [
    (1, PASSAGE + "\n" + prose(1, 60)), (2, prose(2, 80) + "\t" + PASSAGE), (3, None), (4, ""), (5, " \n\t "), (6, "One"), (7, "one"),
    (8, NEAR), (9, NEAR), (10, NEAR.replace("w1 ", "changed ", 1)), (11, NEAR + " and an end"), (12, prose(7, 3000)), (13, "é" * 700),
    (14, "ab " * 500), (15, "Same line here\nSame line here\nother\n\n" + prose(3, 50)), (16, prose(3, 50) + " " + PASSAGE[:300]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ("b", "a", None)[i % 3], len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def removed_words(texts, window):
    words = {i: WORD.findall(t or "") for i, t in texts}
    seen = collections.Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def removed_bytes(texts, depth):
    raw = {i: (t or "").encode() for i, t in texts}
    seen = collections.Counter(b[k : k + depth] for b in raw.values() for k in range(len(b) - depth + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if seen[b[k : k + depth]] > 1:
                gone[k : k + depth] = b"\1" * depth
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("split", [1024, 1])
def test_substring_dedup(docs, monkeypatch, split):
    monkeypatch.setattr(repeats, "BUCKET_RUNS", split)
    got = superkmer.remove_repeated_words(docs)
    assert got.columns == docs.columns + ["n_words", "n_removed", "kept"]
    want = removed_words(TEXTS, 35)
    assert sum(w[1] for w in want.values()) > 300
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], WORD.findall(r["kept"])) for r in got.collect()}
    assert rows == want


@pytest.mark.parametrize("split", [1024, 1])
def test_suffix_dedup(docs, monkeypatch, split):
    monkeypatch.setattr(repeats, "BUCKET_RUNS", split)
    got = by_id(suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept")
    assert {i: (a, b, c, bytes(k)) for i, (a, b, c, k) in got.items()} == removed_bytes(TEXTS, 400)


def test_dedup_of_repeated_rows_and_clashing_columns(spark):
    long = prose(4, 100)
    rows = spark.createDataFrame([(1, long, "x"), (1, long, "y"), (None, long, "z"), (None, None, "q")], "doc_id long, text string, kept string")
    out = superkmer.remove_repeated_words(rows).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept"].strip()) for r in out) == [(0, 0, ""), (100, 100, ""), (100, 100, ""), (100, 100, "")]
    assert sorted(r["n_removed"] for r in suffix_dedup.remove_repeats(rows).collect())[1:] == [len(long)] * 3


def test_long_text_is_cut_into_pieces():
    values = np.random.default_rng(1).integers(0, 1 << 60, 5000).astype(np.uint64)
    from lodestone.llm.arrays import long_minimiser_runs

    _, start, n, _, _ = long_minimiser_runs(values, np.array([0, 5000]), 35, 12, limit=700)
    covered = np.concatenate([np.arange(a, a + m) for a, m in zip(start, n)])
    assert (np.sort(covered) == np.arange(5000 - 34)).all()


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return set(zip(w, w[1:], w[2:], w[3:])) if len(w) >= 4 else ({tuple(w)} if w else set())


def test_ngram_join(spark, docs):
    rng = np.random.default_rng(3)
    base = prose(50, 120).split()
    extra = []
    for i in range(100, 160):  # a group of near copies with few to many edits
        words = list(base)
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(0, len(words)))] = f"x{i}"
        extra.append((i, " ".join(words)))
    texts = TEXTS + extra
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = by_id(ngram_join.jaccard_join(table), "n_shingles", "component_id")
    assert got == {i: (len(sets[i]), find(i)) for i in ids}
    kept = {r["doc_id"] for r in ngram_join.keep_one_per_component(docs).collect()}
    assert {1, 3, 4, 5, 6, 8} <= kept and not {7, 9} & kept


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(3, i) for i in range(4, 12)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 20 for i in range(20, 41)}, **{i: 3 for i in range(3, 12)}}


@pytest.mark.parametrize("part_bytes", [1 << 28, 4000])
def test_language_model(spark, docs, part_bytes):
    tokens = {i: WORD.findall((t or "").translate(LOW)) + [None] for i, t in TEXTS}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = collections.Counter(x for i, w in tokens.items() if not held[i] for x in w)
    pairs = collections.Counter(p for i, w in tokens.items() if not held[i] for p in zip([None, *w], w))
    n, v = sum(count.values()), len(count)
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))), part_bytes, slice_pairs=400)
    assert (model.tokens, model.types) == (n, v)
    got = by_id(lm.score_corpus(docs, part_bytes), "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    for i, w in tokens.items():
        assert got[i][:4] == (held[i], len(w), sum(count[x] > 0 for x in w), n)
        assert got[i][4] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    level = lambda c: float(lm.level_count(lm.count_level(np.array([c])))[0])
    score = by_id(model.score(docs), "score")
    k = model.kappa
    for i, w in tokens.items():
        want = 0.0
        for h, x in zip([None, *w], w):
            seen = level(pairs[h, x]) if pairs[h, x] else 0
            want += math.log10((min(seen, count[h], count[x]) + k * (count[x] + 1) / (n + v + 1)) / (count[h] + k))
        assert score[i][0] == pytest.approx(want, rel=0.05, abs=0.5)  # the filter may answer for a pair never seen


def test_language_model_of_repeated_rows_in_rounds_and_of_nothing(spark, docs, none, monkeypatch):
    twice = docs.unionByName(docs.where("doc_id in (1, 3, 8)")).withColumn("rows", F.lit("other"))
    monkeypatch.setattr(lm, "FETCH_BYTES", 2_000)
    monkeypatch.setattr(lm, "SLICE", 300)
    rows = [sorted(map(tuple, lm.score_corpus(twice, size).collect())) for size in (1 << 28, 4000)]
    assert len(rows[0]) == len(rows[1]) == len(TEXTS) + 3
    for a, b in zip(*rows):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    assert lm.score_corpus(none).count() == 0
    alone = lm.score_corpus(docs.where(lm.held_out(F.col("doc_id")))).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == 0 for r in alone) and alone


def test_bloom_filter_levels():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    counts = np.maximum(rng.geometric(0.3, 4000) ** 2, 1)
    m, raw = lm.build_filter(pairs, counts)
    one = lm.Filters(1, 0, 1, np.zeros(1, np.int64), np.array([m], np.uint64), np.frombuffer(raw, np.uint8))
    found = one.levels(pairs)
    want = lm.count_level(counts)
    assert (found >= want).all() and (found == want).mean() > 0.97
    absent = one.levels(rng.integers(0, 1 << 63, 20000).astype(np.uint64))
    assert (absent > 0).mean() < 0.03


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    special = docs.sparkSession.createDataFrame([(50, "a <|endoftext|> b\x01c \x01 d's İ  x é"), (None, "nul")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(special)
    pieces = packing.pack(table, tokenizer_path(), bucket_bytes=4000).collect()
    texts = dict([*TEXTS, *[(r["doc_id"], r["text"]) for r in special.collect()]])
    joined = collections.defaultdict(dict)
    for p in pieces:
        joined[p["doc_id"]][p["start"]] = np.frombuffer(p["ids"], "<u4")
        assert len(p["ids"]) == 4 * p["length"]
    assert len(joined) == len(texts)
    for i, t in texts.items():
        whole = np.concatenate([joined[i][s] for s in sorted(joined[i])]).tolist()
        assert whole == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert sorted(joined[i])[0] == 0
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"], p["padded_length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n, size in sorted(parts):
            assert offset == at
            at += n
        assert at <= size <= 2048 and size & (size - 1) == 0
        padding += size - at
    assert padding < packing.SMALLEST * 20
    assert packing.pack(none, tokenizer_path()).collect() == []


def test_hilbert_curve_steps_to_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert_key(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    ordered = grid[np.argsort(key)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


def test_chat_examples(spark):
    hard = "<|im_end|><|im_start|>assistant ok <\\|im_end|> \\ <\\\\|im_start|>"
    rows = [
        (1, 0, "system", "s\n"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", "b"), (1, 5, "user", "tail"),
        (2, 0, "user", "alone"), (3, 0, "assistant", ""), (4, 0, "odd\n<\\n>role", "x"), (4, 1, None, "y"), (None, 0, "user", "n"), (None, 1, "assistant", "m"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.chat_examples(table)
    got = {r["conv_id"]: r.asDict() for r in chat.conversation_digest(examples).collect()}
    talks = collections.defaultdict(list)
    for c, _, role, text in rows:
        talks[c].append((role or "", text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    first = examples.where("conv_id = 1 and target = 2").first()
    assert first["n_turns"] == 3 and first["formatted"].count(chat.END) == 3
    assert examples.where("conv_id = 1").count() == 3
    assert chat.chat_examples(table.limit(0)).count() == 0


def test_url_rules_and_reputation(spark):
    pages = [(i, f"https://bad.farm.org/p{i}") for i in range(30)] + [(i, f"http://www.good.net/x/{i}?q#f") for i in range(30, 60)] + [
        (60, None), (61, "no scheme"), (62, "http://WWW.Example.com/en/a"), (63, "http://m.example.com/en/"), (64, "http://x.net/es/1"), (65, "http://new.farm.org#x"),
        (66, "http://notexample.com/en/"), (66, "ftp://a.b"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i < 30) for i in range(60)] + [(None, True), (5, None)], "page_id long, bad boolean")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    got = {(r["page_id"], r["url"]): r for r in urls.filter_urls(table, outcomes, rules).collect()}
    assert len(got) == len(pages)
    one = lambda i: got[i, dict(pages)[i]]
    assert all(one(i)["verdict"] == "block" and one(i)["rule"] is None for i in range(30))
    assert all(one(i)["verdict"] == "allow" for i in range(30, 60))
    assert (one(30)["host"], one(30)["path"]) == ("www.good.net", "/x/30")
    assert (one(60)["host"], one(60)["path"], one(61)["host"]) == ("", "", "")
    assert (one(62)["host"], one(62)["rule"], one(62)["verdict"]) == ("www.example.com", "www.example.com/en/", "allow")
    assert (one(63)["rule"], one(63)["verdict"], one(64)["verdict"]) == ("example.com/en/", "block", "block")
    assert got[66, "http://notexample.com/en/"]["rule"] == "com/"
    assert urls.filter_urls(table.limit(0), outcomes, rules).count() == 0
    assert urls.filter_urls(table, outcomes.limit(0)).where("verdict = 'block'").count() == 0


def test_quality_rules(spark, docs, none):
    got = by_id(quality.quality_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in TEXTS:
        t = t or ""
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = [False] * len(w)
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] > 1:
                hit[k : k + 3] = [True] * 3
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        n = len(w)
        assert got[i] == (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(hit), n < 50 or 100 * sum(hit) > 50 * n), i
    assert quality.quality_rules(none).count() == 0
    good, junk = [(i, prose(i, 70), "good") for i in range(30)], [(i, "spam " * 60, "junk") for i in range(100, 160)]
    table = spark.createDataFrame(good + junk + [(200, prose(200, 70), "junk")], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality.quality_rules(table).where("kept").collect()}
    assert kept == set(range(30))  # the clean document of a junk host goes with it


def test_mixing(spark, docs, none):
    out, targets = mixing.mix_sources(docs.select("doc_id", "text", "source"))
    size = {i: len(WORD.findall(t or "")) for i, t in TEXTS}
    total = collections.Counter()
    for i, n in size.items():
        total[("b", "a", None)[i % 3]] += n
    weight = {"a": 3, "b": 1, None: 2}
    left, open_, want = 1.5 * sum(total.values()), {"a", "b", None}, {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not full:
            break
        for s in full:
            want[s] = 2.0 * total[s]
            left -= want[s]
            open_.remove(s)
    want.update({s: level * weight[s] for s in open_})
    assert {r["source"]: pytest.approx(r["target"]) for r in targets.collect()} == want
    rows = out.collect()
    again = by_id(mixing.mix_sources(docs.select("doc_id", "text", "source").repartition(5))[0], "taken")
    taken = collections.Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert again[r["doc_id"]] == (r["taken"],)
        taken[r["source"]] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {i: n for i, n in words.items()} == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    assert mixing.mix_sources(none)[0].count() == 0


def test_sainte_lague_gives_the_highest_quotients(spark):
    rng = np.random.default_rng(8)
    claims = [(f"s{i}", float(x)) for i, x in enumerate(rng.pareto(1.0, 12) * 100 + 1)]
    table = spark.createDataFrame(claims, "source string, target double").withColumn("most", F.lit(10**6))
    got = {r["source"]: r["quota"] for r in mixing.sainte_lague(table, F.lit(137), (), "target", "most", ("source",)).collect()}
    bids = sorted(((w / (2 * k + 1), s) for s, w in claims for k in range(137)), reverse=True)[:137]
    assert got == {s: sum(1 for b in bids if b[1] == s) for s, _ in claims}


def test_order_minhash(docs, none):
    rows = {r["doc_id"]: r for r in omh.fingerprints(docs, bucket_bytes=6000).collect()}
    ids = sorted(rows, reverse=True)
    texts = {i: t or "" for i, t in TEXTS}
    for i, following in zip(ids, ids[1:] + ids[:1]):
        n = len(texts[i]) // 3
        assert rows[i]["n_chars"] == len(texts[i])
        assert rows[i]["edited_text"] == texts[i][: len(texts[i]) - n] + texts[following][:n]
    assert rows[8]["fingerprint"] == rows[9]["fingerprint"] and rows[9]["near_next"] == 1.0
    assert rows[3]["fingerprint"] == rows[4]["fingerprint"] == rows[5]["fingerprint"]
    words = prose(1, 300).split()
    a = omh._print(" ".join(words), 256, 2, 2)
    moved = omh._print(" ".join(words[150:] + words[:150]), 256, 2, 2)
    changed = omh._print(" ".join(words[:295] + ["x"] * 5), 256, 2, 2)
    assert omh.likeness(a, changed) > 0.85 > 0.7 > omh.likeness(a, moved)  # moved text keeps its k-mers, not their order
    assert omh.fingerprints(none).count() == 0
