"""Task functions of single operators against plain Python, over batches cut anywhere."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import bloom, ngram_join, omh
from lodestone.llm.arrays import as_long, span_hashes

MASK = (1 << 64) - 1


def batches(rng, columns):
    """The rows of ``columns`` (name: array) in batches of random sizes, empty ones included."""
    n, at = len(next(iter(columns.values()))), 0
    while at < n:
        size = int(rng.integers(0, 9))
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + size]) for c in columns.values()], names=list(columns))
        at += size


@pytest.mark.parametrize("seed", range(5))
def test_tokens_met_by_another_node(seed):
    rng = np.random.default_rng(seed)
    rows = sorted(zip(rng.integers(0, 40, 200).tolist(), rng.integers(0, 12, 200).tolist()))
    nodes = collections.defaultdict(set)
    for t, v in rows:
        nodes[t].add(v)
    want = collections.Counter(v for t, own in nodes.items() if len(own) > 1 for v in own)
    token, node = (np.array(x, dtype=np.int64) for x in zip(*rows))
    got = collections.Counter()
    for b in ngram_join._met_tokens(batches(rng, {"token": token, "node": node, "n": (node * 3).astype(np.int32)})):
        assert (b.column("n").to_numpy() == b.column("node").to_numpy() * 3).all()
        got.update(b.column("node").to_pylist())
    assert got == want


@pytest.mark.parametrize("frequent", [3, 10, 1 << 17])
@pytest.mark.parametrize("seed", range(3))
def test_token_counts_up_to_the_frequent_ones(monkeypatch, seed, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = np.random.default_rng(seed)
    token = np.sort(np.concatenate((rng.integers(0, 60, 150), np.full(60, 30)))).astype(np.int64)
    row = rng.integers(0, 1000, len(token)).astype(np.int64)
    count = collections.Counter(token.tolist())
    want = collections.Counter((t, r, min(count[t], frequent)) for t, r in zip(token.tolist(), row.tolist()) if count[t] > 1)
    got = collections.Counter()
    for b in ngram_join._with_frequency(batches(rng, {"token": token, "row": row, "n": (row % 7).astype(np.int32)})):
        for r in b.to_pylist():
            assert r["n"] == r["row"] % 7
            got[r["token"], r["row"], r["df"]] += 1
    assert got == want


def test_filter_loses_nothing_at_any_size(spark):
    values = np.arange(1, 4000, 3, dtype=np.int64) * 7_919
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(2)
    for most in (1 << 28, 1 << 10):
        made = bloom.bloom_filter(df, "v", most)
        assert bloom.holds(made, values.view(np.uint64)).all() and 8 * len(made) <= max(most, 1 << 10)
    absent = np.arange(2, 4000, 3, dtype=np.int64) * 7_919
    assert bloom.holds(bloom.bloom_filter(df, "v"), absent.view(np.uint64)).mean() < 0.05
    assert not bloom.holds(bloom.bloom_filter(df.limit(0), "v"), absent.view(np.uint64)).any()


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_signature(values, m, l, k):  # noqa: E741
    """Order MinHash component by component."""
    kmers = [int(x) for x in span_hashes(values, k if len(values) >= k else max(len(values), 1))]
    if not kmers:
        return [0] * m
    seen, numbered = collections.Counter(), []
    for x in kmers:
        numbered.append(plain_mix(x ^ plain_mix(seen[x] + 1)))
        seen[x] += 1
    seeds = [plain_mix(i * 0x9E3779B97F4A7C15 & MASK) for i in range(1, 2 * m + 1)]
    out = []
    for scale, shift in zip([s | 1 for s in seeds[:m]], seeds[m:]):
        key = [(x * scale + shift) & MASK for x in numbered]
        key = [x ^ x >> 32 for x in key]
        chosen = sorted(sorted(range(len(key)), key=lambda i: (key[i], i))[:l])
        h = 0x243F6A8885A308D3
        for i in chosen:
            h = plain_mix((h * 0x9E3779B97F4A7C15 & MASK) ^ kmers[i])
        out.append((h >> 32) | 1)
    return out


@pytest.mark.parametrize("words, kinds", [(0, 1), (1, 1), (2, 2), (40, 5), (300, 300), (9_000, 50)])
def test_order_minhash_equals_plain_python(words, kinds):
    rng = np.random.default_rng(words)
    values = rng.integers(1, 1 << 62, kinds).astype(np.uint64)[rng.integers(0, kinds, words)]
    assert omh.signature(values).tolist() == plain_signature(values, omh.M, omh.TUPLE, omh.KMER)
    assert as_long(values).dtype == np.int64


def test_large_buckets_are_dealt_by_longer_spans_before_digests(spark, monkeypatch):
    """Strings around a shared passage, more than a bucket takes: the windows that repeat are found, without a digest of each."""
    from collections import Counter

    from lodestone.llm import repeats, suffix_dedup

    monkeypatch.setattr(repeats, "BUCKET_RUNS", 8)
    rng = random.Random(21)
    draw = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = draw(420)
    texts = [draw(rng.randint(50, 300)) + shared[rng.randint(0, 60) : 420 - rng.randint(0, 60)] + draw(rng.randint(50, 300)) for _ in range(40)]
    texts += [texts[0], shared, shared[:400], None, "é" + shared[5:], shared[60:300] + draw(200)]
    seen = Counter(b[i : i + 400] for t in texts if t for b in [t.encode()] for i in range(len(b) - 399))
    want = {}
    for n, t in enumerate(texts):
        raw = (t or "").encode()
        gone = {j for i in range(len(raw) - 399) if seen[raw[i : i + 400]] > 1 for j in range(i, i + 400)}
        want[n] = (len(raw), len(gone))
    calls, verdicts = [], repeats._compare_buckets
    monkeypatch.setattr(repeats, "_compare_buckets", lambda s, *a: calls.append(verdicts(s, *a).where("digest is not null").count()) or verdicts(s, *a))
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in rows} == want
    assert len(calls) == 2 and calls[-1] == 0, calls  # the outer buckets, in whole groups; each window was a row of a digest before
