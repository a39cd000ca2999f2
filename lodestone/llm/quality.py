"""Host-level quality rules: documents fail rules, hosts answer for their documents.

A document's failures are counted per host, each host's failure rate is shrunk towards the overall
rate by an empirical beta prior (moments over hosts), and hosts whose rate is above ``cutoff`` even at
the lower end of the posterior are rejected with all their documents. Column functions only.

Null or blank text: no words, which fails the word-count rule. A null host is a host of its own.
Repeated rows count and are judged each. An empty table gives an empty result. Input columns named
like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import free_name, shared_table, small_or_plain, without_space, words_of

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_100_WORDS = 25
MAX_DUP_LINE_PERCENT = 60
MEAN_WORD_CHARS = (2, 15)

HOST_CUTOFF = 0.6
HOST_Z = 2.0


def _repeat_words(words: str, grams: str, ordered: str) -> Column:
    """Words inside three-word windows that occur twice or more: equal windows are neighbours in
    the sorted (hash, position) array."""
    s, size = F.col(ordered), F.size(ordered)
    same = lambda a, b: a["h"] == b["h"]
    again = F.filter(
        s,
        lambda x, i: F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(False)
        | F.when(i < size - 1, same(x, F.get(s, i + 1))).otherwise(False),
    )
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.when(s.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))


def rule_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of FEATURES; nothing is shuffled, each text is read once."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in FEATURES])
    body, words, grams, ordered, lines = (free_name(docs, n) for n in ("_body", "_words", "_grams", "_ordered", "_lines"))
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(words, words_of(F.col(body)))
    w, n = F.col(words), F.size(words)
    out = out.withColumn(
        grams,
        F.when(
            n >= 4,
            F.transform(
                F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            ),
        ),
    ).withColumn(
        lines,
        F.filter(F.split(F.col(body), "\n"), lambda x: F.length(without_space(x)) > 0),
    )
    g = F.col(grams)
    out = out.withColumn(
        ordered,
        F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    features = F.struct(
        n.cast("long").alias("n_words"),
        F.length(without_space(F.col(body))).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(F.col(body), "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias(lines),
        _repeat_words(words, grams, ordered).cast("long").alias("n_repeat_words"),
    )
    # Rows made by a generator: a filter on a feature stays above it and does not compute the arrays again.
    out = out.select(*docs.columns, F.inline(F.array(features)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    other = (
        (100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col(lines))
        | (F.col("word_chars") < MEAN_WORD_CHARS[0] * F.col("n_words"))
        | (F.col("word_chars") > MEAN_WORD_CHARS[1] * F.col("n_words"))
    )
    return out.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | other).drop(lines)


def host_verdicts(
    features: DataFrame, host: str = "source", cutoff: float = HOST_CUTOFF, z: float = HOST_Z
) -> DataFrame:
    """One row per host: host, docs, failures, rate (posterior mean), low (its lower bound), rejected.

    Prior: mean m = all failures / all documents; the variance of host rates beyond binomial noise
    gives its strength s, between 1 and 10,000. Posterior: beta(m s + failures, (1 - m) s + passes).
    """
    counts = features.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures")
    )
    counts = shared_table(counts, "hosts")
    rate = F.col("failures") / F.col("docs")
    totals = counts.agg(
        F.sum("docs").alias("n"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("failures") * rate).alias("ff"),
    )
    mean = F.coalesce(F.col("f") / F.col("n"), F.lit(0.0))
    noise = mean * (1 - mean)
    # Weighted variance of rates less its binomial part.
    between = F.greatest(F.col("ff") / F.col("n") - mean * mean - noise * F.col("k") / F.col("n"), F.lit(1e-9))
    prior = totals.select(
        F.round(mean, 9).alias("m"),
        F.round(F.least(F.greatest(noise / between - 1, F.lit(1.0)), F.lit(10000.0)), 6).alias("s"),
    )
    a = F.col("m") * F.col("s") + F.col("failures")
    b = (1 - F.col("m")) * F.col("s") + F.col("docs") - F.col("failures")
    post = a / (a + b)
    low = post - z * F.sqrt(post * (1 - post) / (a + b + 1))
    return counts.join(F.broadcast(prior)).select(
        "host", "docs", "failures", post.alias("rate"), low.alias("low"), (low > cutoff).alias("rejected")
    )


def judge_documents(docs: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Documents with features joined to the verdict of their host: adds ``host_rate`` and ``kept``."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("host_rate", "kept")])
    key = free_name(docs, "_host")
    verdicts = hosts.select(F.col("host").alias(key), F.col("rate").alias("host_rate"), F.col("rejected").alias("kept"))
    joined = docs.join(small_or_plain(verdicts), F.col(host).eqNullSafe(F.col(key)), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("kept"), F.lit(False))
    return joined.drop(key).withColumn("kept", kept)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", keep_text: bool = True) -> DataFrame:
    """All documents with features, ``host_rate`` and ``kept``; hosts are judged over the whole table.

    Documents with their features (without the text unless ``keep_text``) are written once, so each text is read
    once; the host verdicts come from that table and are joined back to it.
    """
    featured = rule_features(docs, text)
    featured = shared_table(featured if keep_text else featured.drop(text), "features")
    hosts = shared_table(host_verdicts(featured, host), "host-verdicts")
    return judge_documents(featured, hosts, host)
