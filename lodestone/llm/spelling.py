"""Spelling variant grouping by asymmetric q-chunks.

Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of texts, lower-cased in A-Z only; one run in ``NOISE`` (by the crc32 of
``<doc_id>:<run>``) loses a code point. Words of at least ``MIN_CHARS`` code points and ``MIN_COUNT`` occurrences form
the vocabulary. Two words are near if one inserted, deleted or replaced code point makes them equal.

The search joins in one direction: the shorter word (of equally long ones, both) gives its two halves as disjoint chunks; one
edit leaves one of them whole. The other word gives all positional grams that can be such a chunk: a half's length, at the
half's place, or one further when the other word is a code point longer. Chunks and grams meet by equality of length class,
side and text, and each meeting is verified in the join itself, so no unverified pair leaves it. Long groups of one
chunk are split by adaptive execution, as both sides of the join are plain shuffles.

A word's form is its most frequent near word if that is at least ``FORM_RATIO`` times as frequent. Counts grow by that ratio along a
chain of forms, which bounds its length; roots are found by doubling.

Null text: no words. Null doc_id: an empty text before the colon. Repeated rows count each time. Ties go to the word that
is smaller in code-point order. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .shared import shared_table

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
NOISE = 199
MIN_CHARS = 6
MIN_COUNT = 5
FORM_RATIO = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def observed_words(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """One row (word) for each run of ``docs`` (doc_id, text), shortened where the hash says so."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({RUNS})"), F.lit(1))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % noise == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the distinct long and frequent rows of ``words``."""
    long = words.where(F.char_length("word") >= min_chars)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _part(word: Column, start: Column, length: Column) -> Column:
    return F.substring(word, (start + 1).cast("int"), length.cast("int"))


def near_pairs(words: DataFrame) -> DataFrame:
    """x, nx, y, ny: each pair of near words of ``words`` (word, n) once; x is the shorter, or the smaller of equally long ones."""
    word, size = F.col("word"), F.char_length("word")
    half = F.floor(size / 2)
    key = lambda length, side, text: F.struct(length.cast("int").alias("length"), F.lit(side).alias("side"), text.alias("text"))
    chunks = F.array(key(size, 0, _part(word, F.lit(0), half)), key(size, 1, _part(word, half, size - half)))
    grams = [key(size, 0, _part(word, F.lit(0), half)), key(size, 1, _part(word, half, size - half))]
    less = size - 1  # a word that is one shorter: its chunks may stand one further here
    short = F.floor(less / 2)
    for shift in (0, 1):
        grams += [key(less, 0, _part(word, F.lit(shift), short)), key(less, 1, _part(word, short + shift, less - short))]
    left = words.select(F.explode(chunks).alias("c"), word.alias("x"), F.col("n").alias("nx")).select("c.*", "x", "nx")
    right = words.select(F.explode(F.array_distinct(F.array(*grams))).alias("c"), word.alias("y"), F.col("n").alias("ny")).select("c.*", "y", "ny")
    near = (F.levenshtein("x", "y", 1) == 1) & ((F.char_length("x") < F.char_length("y")) | (F.col("x") < F.col("y")))
    same = ["length", "side", "text"]
    met = left.alias("l").join(right.alias("r"), (F.col("l.length") == F.col("r.length")) & (F.col("l.side") == F.col("r.side")) & (F.col("l.text") == F.col("r.text")) & near)
    return met.drop(*same).select("x", "nx", "y", "ny").distinct()


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """word, root by doubling of ``forms`` (word, form); counts up to ``most`` grow by ``ratio`` along a chain."""
    longest = 1 + math.ceil(math.log(max(most, 2)) / math.log(ratio))
    jump = forms.select("word", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(longest))):
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = shared_table(jump.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{i}")
    return jump


def spelling_variants(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of the vocabulary of ``words`` (word)."""
    known = shared_table(vocabulary(words, min_chars, min_count), "vocabulary")
    pairs = shared_table(near_pairs(known), "near-words")
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("ny").alias("m")).unionByName(
        pairs.select(F.col("y").alias("word"), F.col("x").alias("other"), F.col("nx").alias("m"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("order"), "other", "m")).alias("best"))
    joined = known.join(best, "word", "left")
    fits = F.col("best.m") >= ratio * F.col("n")
    listed = shared_table(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.other")).alias("form"), F.when(fits, F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    forms = listed.where("form is not null").select("word", "form")
    most = listed.agg(F.max("n").alias("n")).first()["n"] or 1
    return listed.join(_roots(forms, most, ratio), "word", "left").withColumn("root", F.coalesce("root", "word"))
