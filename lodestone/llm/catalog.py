"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, lm, mixing, ngram_join, omh, oracle, packing, phrases, quality, spelling, suffix_dedup, superkmer, urls, warc
from .shared import words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(_table(spark, sf_dir, "documents"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )
    return chat.conversation_digest(chat.chat_examples(turns.unionByName(extra)))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages: the labels of the document with the same id; bad if of low quality or toxic."""
    labels = _table(spark, sf_dir, "labels")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    out = urls.filter_urls(pages, page_outcomes(spark, sf_dir), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = superkmer.remove_repeated_words(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words_of(F.col("kept")), " "), 256).alias("kept_sha256"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = omh.fingerprints(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    side = mixing.small_or_plain(targets.select(F.col("source").alias("_s"), F.col("words").alias("source_size"), "target"))
    return documents.join(side, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"))


@query
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents").select("lang", "text"))


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_variants(spelling.observed_words(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


ORACLE["op3_chat_format"] = oracle.CHAT_FORMAT
ORACLE["op4_suffix_dedup"] = oracle.suffix_dedup(suffix_dedup.DEPTH)
ORACLE["op5_url_filter"] = oracle.url_filter(URL_RULES, urls.CUTOFF, urls.Z)
ORACLE["op6_substring_dedup"] = oracle.substring_dedup(superkmer.WINDOW)
ORACLE["op7_quality_rules"] = oracle.quality_rules(
    quality.MIN_WORDS, quality.MAX_REPEAT_PERCENT, quality.MAX_SYMBOLS_PER_100_WORDS, quality.MAX_DUP_LINE_PERCENT,
    quality.MEAN_WORD_CHARS, quality.HOST_CUTOFF, quality.HOST_Z,
)
ORACLE["op10_ngram_jaccard"] = oracle.jaccard_join(ngram_join.NGRAM, ngram_join.PERCENT)
ORACLE["op11_phrase_mining"] = oracle.phrase_mining(phrases.MIN_COUNT, phrases.COVER_PERCENT, phrases.TOP)
ORACLE["op12_warc"] = oracle.warc_pages(warc.MIN_REVISIT)
ORACLE["op13_spelling_variants"] = oracle.spelling_variants(spelling.NOISE, spelling.MIN_CHARS, spelling.MIN_COUNT, spelling.FORM_RATIO)
