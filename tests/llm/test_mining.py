"""Phrase mining, WARC archives and spelling variants against plain Python and their SQL on small tables with odd rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import phrases, spelling, warc
from lodestone.llm.catalog import ORACLE, QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed, n, words=12):
    rng = np.random.default_rng(seed)
    return "".join(f"{'New' if x == 3 else 'York' if x == 4 else f'w{x}'}{rng.choice([' ', ' ', ' ', chr(9), ', ', '. ', chr(10)])}" for x in rng.integers(0, words, n))


PHRASE_DOCS = [
    (1, sentence(1, 400), "en", "a", 0), (2, sentence(2, 300), "en", "b", 0), (3, sentence(3, 500), None, "b", 0), (4, sentence(4, 200), "und", "b", 0),
    (5, None, "en", "a", 0), (6, "", "de", "a", 0), (7, " .\t,\n", "de", None, 0), (None, "é ß\x1f x " * 30, "de", "a", 0),
    (9, "one", "fr", "a", 0), (1, sentence(1, 400), "en", "a", 0), (11, "a a a a " * 20, "aa", "a", 0),
]


def mined(rows, least=10, cover=50, top=2000):
    """Contract of op11 in plain Python."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and p in [q[i : i + len(p)] for i in range(2)] for q, b in candidates.items()):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        for rank, (score, _, p, a, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), a, l, r, n[lang], -score))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrase_rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"TRIE_KEYS": 40, "BURST_KEYS": 16, "SLICE": 64}, {"WORDS": 64, "_MASK": 63}], ids=["plain", "bursts, spills, cuts", "few numbers"])
def test_phrases_equal_plain_python(spark, monkeypatch, sizes):
    if "WORDS" in sizes:
        # Numbers run out again and again; a key still has 20 bits for each.
        monkeypatch.setattr(phrases, "WORDS", 64)
    else:
        for name, value in sizes.items():
            monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame(PHRASE_DOCS, DOCS).repartition(2).withColumn("phrase", F.lit("other"))
    hot = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    # The sizes are those of this process, so the task's function runs here too.
    batches = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").toArrow().to_batches()
    emit = _function_of(phrases, docs, hot)
    here = collections.Counter()
    for batch in emit(iter(batches)):
        for r in batch.to_pylist():
            here[r["lang"], r["words"], r["phrase"]] += r["f"]
    want = collections.Counter()
    for _, text, lang, *_ in PHRASE_DOCS:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang, 0, ""] += len(w)
            for k in (1, 2):
                want.update((lang, k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    assert here == +want
    assert phrase_rows(phrases.mine_phrases(docs)) == mined(PHRASE_DOCS)


def _function_of(module, docs, hot):
    """The task function that ``_runs`` hands to Spark."""
    held = []

    class Texts:
        def mapInArrow(self, function, schema):
            held.append(function)

    module._runs(Texts(), False, hot, None)
    return held[0]


def test_phrase_thresholds_filter_and_ties(spark):
    docs = spark.createDataFrame(PHRASE_DOCS, DOCS)
    got = phrases.mine_phrases(docs, least=3, cover_percent=30, top=7, filter_bits=1 << 10)
    assert phrase_rows(got) == mined(PHRASE_DOCS, 3, 30, 7)
    assert phrases.mine_phrases(docs.limit(0)).count() == 0


def test_phrase_score_needs_more_than_64_bits(spark):
    a, l, r = 3_000_000_000_017, 5_000_000_000_003, 7_000_000_000_001  # noqa: E741
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 1000000 * a * a // (l * r)


def test_trie_keeps_every_key(monkeypatch):
    monkeypatch.setattr(phrases, "BURST_KEYS", 1024)
    rng = np.random.default_rng(1)
    keys = (rng.zipf(1.4, 60_000) % 50 + 1) << 40 | (rng.integers(1, 300, 60_000) << 20) | rng.integers(0, 300, 60_000)
    root = phrases.Node(0)
    for part in np.array_split(keys, 30):
        root.add(*np.unique(part, return_counts=True))
    assert root.children and any(c.children for c in root.children.values()) and len(root) == len(np.unique(keys))
    got = collections.Counter()
    for _, word in root.subtrees():
        for k, c in zip(*root.take(word)):
            got[k] += c
    assert got == collections.Counter(keys.tolist()) and len(root) == 0


def noisy(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def grouped(words, min_chars=6, min_count=5, ratio=5):
    n = {w: c for w, c in collections.Counter(words).items() if len(w) >= min_chars and c >= min_count}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n.get(form[w]))
    return out


def spelling_docs():
    rng = np.random.default_rng(3)
    base = ["analysis", "Gemüse", "planning", "élevées", "xxxxxx", "aaaaaaaa", "×÷×÷×÷"]
    rows = []
    for i in range(60):
        words = []
        for w in base:
            words += [w] * int(rng.integers(1, 8))
            k = int(rng.integers(0, len(w)))
            if rng.random() < 0.6:
                words.append([w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "q" + w[k + 1 :], w + w[-1]][int(rng.integers(0, 4))])
        rows.append((i if i % 9 else None, "1".join(words) + " short end", "en", "a", 0))
    return [*rows, rows[1], (77, None, "en", "a", 0), (78, "", "en", "a", 0), (79, "123 \n", "en", None, 0), (80, "Long" * 30_000, "en", "a", 0)]


def test_spelling_variants_equal_plain_python(spark):
    rows = spelling_docs()
    words = [noisy(i, run) for i, text, *_ in rows for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW))]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("word", F.lit("other"))
    got = spelling.spelling_variants(spelling.observed_words(docs))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()}
    assert got == grouped(words)
    assert sum(x[0] is not None for x in got.values()) > 10
    assert spelling.spelling_variants(spelling.observed_words(docs.limit(0))).count() == 0


def test_long_chain_and_ties_of_forms(spark):
    chain = {"abcdefgh": 5, "abcdefghi": 25, "abcdefghij": 125, "abcdefghijk": 625, "tieword1": 5, "tieword2": 25, "tieword3": 25, "weak12": 5, "weak13": 24}
    words = [w for w, c in chain.items() for _ in range(c)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df).collect()}
    assert got == grouped(words)
    assert got["abcdefgh"][1] == "abcdefghijk" and got["tieword1"][0] == "tieword2" and got["weak12"][0] is None


PAGES = [
    (5, "http://a.com/", "<p>" + "x" * 200), (2, "http://b.com/é", "<p>" + "x" * 200), (9, "http://c.com/\r\nHost: d", "<p>" + "x" * 200),
    (1, None, "small"), (3, "http://d", "small"), (4, "", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "é" * 49), (11, "v", "é" * 49),
    (5, "http://a.com/", "<p>" + "x" * 200), (None, "n", "<p>" + "x" * 200), (None, "n", "WARC/1.1\r\n\r\n\r\n" * 20), (12, "v", "WARC/1.1\r\n\r\n\r\n" * 20),
    (13, "w", " \U0001f600\n\r\n" * 40), (14, "w", "z" * 300_000),
]
PAGE = "page_id long, url string, html string"


def archived(rows):
    best = {}
    for i, _, html in rows:
        key = (i is None, i or 0)
        best[html or ""] = min(best.get(html or "", key), key)
    out, seen = [], set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        again = len(raw) >= 100 and (html or "") in seen
        seen.add(html or "")
        first = best[html or ""]
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", (None if first[0] else first[1]) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("stored", [False, True])
def test_archives_round_trip(spark, tmp_path, stored):
    spark.createDataFrame(PAGES, PAGE).repartition(3).withColumn("start", F.lit(1)).write.parquet(f"{tmp_path}/pages")
    table = spark.read.parquet(f"{tmp_path}/pages")
    got = warc.archive_round_trip(table if stored else table.repartition(2))
    rows = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(rows, key=repr) == archived(PAGES)


def test_archive_bytes_index_and_reads(spark, tmp_path):
    """Every archive is a sequence of whole records, each where the index says; selected records come back whole, with few reads."""
    pages = spark.createDataFrame(PAGES, PAGE).repartition(2)
    made = warc.write_archives(pages, f"{tmp_path}/warc")
    index = [r.asDict() for r in made.index.collect()]
    files = collections.defaultdict(list)
    for r in index:
        files[r["file"].removeprefix("file:")].append(r)
    for file, rows in files.items():
        raw, at = open(file, "rb").read(), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and raw[at:].startswith(b"WARC/1.1\r\nWARC-Type: " + r["type"].encode())
            at += r["length"]
            assert raw[at - 4 : at] == b"\r\n\r\n"
        assert at == len(raw)
    html = collections.Counter(((h or "").encode(), u if u is None else u.replace("\r", "%0D").replace("\n", "%0A")) for _, u, h in PAGES)
    got = made.read(made.index.where("type = 'response'"), max_gap=10, read_bytes=500, keep_payload=True).collect()
    assert not collections.Counter((bytes(r["payload"]), r["url"]) for r in got) - html
    assert {r["record_id"] for r in got} == {r["record_id"] for r in index if r["type"] == "response"}
    assert made.read(made.index.where("page_id = 14"), keep_payload=True).first()["payload"] == b"z" * 300_000
    assert len({r["record_id"] for r in index}) == len(PAGES)


def test_reads_are_joined_by_gap_and_size():
    records = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 60, 10), ("b", 0, 100), ("b", 100, 10)]
    assert list(warc.coalesced(iter(records), 5, 50)) == [("a", [(0, 10), (10, 10), (25, 5)]), ("a", [(60, 10)]), ("b", [(0, 100)]), ("b", [(100, 10)])]
    assert list(warc.coalesced(iter([]), 5, 50)) == []


def test_a_changed_archive_is_an_error(spark, tmp_path):
    made = warc.write_archives(spark.createDataFrame(PAGES[:4], PAGE).coalesce(1), f"{tmp_path}/warc")
    with pytest.raises(Exception, match="WARC record|stated length"):
        made.read(made.index.withColumn("start", F.col("start") + 1)).collect()


def test_empty_pages(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGE)).count() == 0


@pytest.mark.parametrize("name, table, rows, schema", [
    ("op11_phrase_mining", "documents", PHRASE_DOCS, DOCS), ("op13_spelling_variants", "documents", spelling_docs(), DOCS), ("op12_warc", "pages", PAGES, PAGE),
])
def test_query_equals_sql(spark, tmp_path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        found = con.execute(ORACLE[name])
        columns = [d[0] for d in found.description]
        want = found.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
