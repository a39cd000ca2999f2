"""Text functions as Spark column expressions (no Python in the row path; ``plain.py`` finds the same terms in plain texts)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, functions as F

if TYPE_CHECKING:
    from .segmentation import HanDictionary

# Chinese function words that are never indexed.
STOPWORDS = ("的", "了", "和", "与", "是", "在", "如何", "什么", "为什么", "怎么", "一个", "哪些", "及")

_LETTER = r"\p{L}\p{M}"
_JOIN_BOTH = "'’."
_JOIN_LETTERS = "·‧"
_JOIN_DIGITS = ",;"
_JOINERS = _JOIN_BOTH + _JOIN_LETTERS + _JOIN_DIGITS

# Word boundaries in the manner of UAX #29: a joiner survives only between two letters or
# two digits. Written as short separators for split(), so that java.util.regex never recurses
# however long a token is; the joiner itself comes first so that other characters fail fast.
WORD_SEPARATOR = (
    rf"[^{_LETTER}\p{{N}}_{_JOINERS}]+"
    rf"|[{_JOINERS}](?!(?<=[{_LETTER}][{_JOIN_BOTH}{_JOIN_LETTERS}])[{_LETTER}]"
    rf"|(?<=\p{{N}}[{_JOIN_BOTH}{_JOIN_DIGITS}])\p{{N}})"
)
CAMEL = "[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_.$-]*"
HAN_RUN = r"\p{IsHan}+"
LINE_BREAK = r"\r\n|\n|\r"
# White space as Unicode-aware trimming sees it (regex \\s alone is ASCII here).
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfkc(text: Column | str) -> Column:
    """NFKC through the ICU library that ships with Spark; ASCII rows skip the call."""
    c = _as_col(text)
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True)
    )
    return F.when(_not_ascii(c), composed).otherwise(c)


def _not_ascii(c: Column) -> Column:
    """Cheaper than a regex: more bytes than characters."""
    return F.octet_length(c) > F.char_length(c)


def _has_han(c: Column) -> Column:
    return _not_ascii(c) & c.rlike(HAN_RUN)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is made once a row and not once a use: a lambda variable stands for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(normalized: Column) -> Column:
    plain = F.when(_has_han(normalized), F.regexp_replace(normalized, HAN_RUN, " ")).otherwise(normalized)

    def cut(text: Column) -> Column:
        found = F.array_remove(F.split(F.lower(text), WORD_SEPARATOR), "")
        lettered = F.filter(found, lambda w: ~w.rlike("^_+$"))
        return F.when(F.contains(text, F.lit("_")), lettered).otherwise(found)

    return _bound(plain, cut)


def _camel_split(c: Column) -> Column:
    c = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")


def identifiers(normalized: Column) -> Column:
    """Whole identifiers followed by their camel-case and punctuation parts."""

    def cut(joined: Column) -> Column:
        whole = F.array_remove(F.split(F.lower(joined), " "), "")
        apart = F.when(joined.rlike(CAMEL), _camel_split(joined)).otherwise(joined)
        return F.concat(whole, F.regexp_extract_all(F.lower(apart), F.lit("[a-z0-9]+"), F.lit(0)))

    return _bound(F.array_join(F.regexp_extract_all(normalized, F.lit(IDENTIFIER), F.lit(0)), " "), cut)


def identifiers_in_order(normalized: Column) -> Column:
    """As :func:`identifiers`, but each identifier is directly followed by its own parts."""
    found = F.regexp_extract_all(normalized, F.lit(IDENTIFIER), F.lit(0))
    each = F.transform(
        found,
        lambda x: F.concat(
            F.array(F.lower(x)),
            F.regexp_extract_all(F.lower(_camel_split(x)), F.lit("[a-z0-9]+"), F.lit(0)),
        ),
    )
    return F.flatten(each)


def han_terms(normalized: Column) -> Column:
    """Bigrams of each Han run (a lone character stands for itself), stopwords removed."""
    runs = F.regexp_extract_all(normalized, F.lit(HAN_RUN), F.lit(0))
    grams = F.transform(
        runs,
        lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))
            )
        ),
    )
    kept = F.filter(F.flatten(grams), lambda t: ~t.isin(list(STOPWORDS)))
    return F.when(_has_han(normalized), kept).otherwise(F.array().cast("array<string>"))


def dictionary_terms(dictionary: Sequence[str]) -> list[str]:
    """Entries of a user dictionary as terms: NFKC, lower case, no empty ones and no stopwords."""
    plain = (unicodedata.normalize("NFKC", entry).lower() for entry in dictionary)
    return [entry for entry in plain if entry and entry not in STOPWORDS]


def tokenize(
    text: Column | str,
    dictionary: Sequence[str] = (),
    ordered: bool = False,
    normalized: bool = False,
    han: HanDictionary | None = None,
) -> Column:
    """Index terms of a text, duplicates kept.

    Word segments (with ``han`` also those of Han runs, by dictionary), then identifiers with their parts,
    then Han bigrams, then dictionary entries found anywhere. ``ordered`` interleaves identifiers with their
    parts, which matters only where the first N distinct query terms are kept.
    """
    c = _as_col(text)
    entries = dictionary_terms(dictionary)

    def rest(norm: Column) -> list[Column]:
        lists = [identifiers_in_order(norm) if ordered else identifiers(norm), han_terms(norm)]
        for entry in entries:
            hit = F.lower(norm).contains(entry)
            lists.append(F.when(hit, F.array(F.lit(entry))).otherwise(F.array().cast("array<string>")))
        return lists

    if han is not None:
        from .segmentation import han_segments

        norm = c if normalized else nfkc(c)
        found = F.get(F.transform(F.array(norm), lambda n: F.struct(words(n).alias("words"), F.concat(*rest(n)).alias("rest"))), F.lit(0))
        return F.concat(found["words"], han_segments(norm, han), found["rest"])
    if normalized:
        return F.concat(words(c), *rest(c))
    # Bound to a lambda variable, the normalised text is made once a row and not once a use.
    return F.get(F.transform(F.array(nfkc(c)), lambda n: F.concat(words(n), *rest(n))), F.lit(0))


def encode_term(term: Column | str) -> Column:
    """Letter ``t`` plus lower-case hex of the UTF-8 bytes: the exchange form of a term."""
    return F.concat(F.lit("t"), F.lower(F.hex(F.encode(_as_col(term), "UTF-8"))))


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: code points plus one more for each astral one."""
    c = _as_col(text)
    astral = F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(c) + F.when(_not_ascii(c), astral).otherwise(F.lit(0))


def escape_cost(text: Column | str) -> Column:
    """UTF-16 length of the text inside a JSON string: escapes cost 2, other controls 6."""
    c = _as_col(text)
    pairs = F.regexp_count(c, F.lit(r"[\x22\x5C\x08\x09\x0A\x0C\x0D]"))
    controls = F.regexp_count(c, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))
    return utf16_length(c) + pairs + controls * 5


def preview_end(start_line: Column, text: Column | str) -> tuple[Column, Column]:
    """(end line, exclusive end column in UTF-16 units) of a text beginning at ``start_line``."""
    c = _as_col(text)
    breaks = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return start_line + breaks, utf16_length(F.substring_index(c, "\n", -1)) + 1


def is_blank(text: Column | str) -> Column:
    return ~_as_col(text).rlike(f"[^{SPACE}]")


def strip_space(text: Column | str) -> Column:
    return F.regexp_replace(_as_col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_as_col(text), f"[{SPACE}]+", " "))


def is_uuid_v4(value: Column | str) -> Column:
    from ..config import UUID_V4

    return _as_col(value).rlike(UUID_V4)


def content_hash(text: Column | str) -> Column:
    return F.sha2(_as_col(text).cast("binary"), 256)


def json_quote(text: Column | str) -> Column:
    """A JSON string literal with the same escapes as a compact JSON encoder."""
    c = F.replace(_as_col(text), F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))

    def controls(text: Column) -> Column:
        for code in [*range(0x01, 0x08), 0x0B, *range(0x0E, 0x20)]:
            text = F.replace(text, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
        return text

    # Few texts hold other controls; the rest need one look instead of a replacement for each.
    quoted = _bound(c, lambda text: F.when(text.rlike("[\\x01-\\x07\\x0B\\x0E-\\x1F]"), controls(text)).otherwise(text))
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def chunk_id(source_id: Column, start: Column, end: Column, text: Column) -> Column:
    """Hash of the JSON array [source, first line, last line, text]."""
    payload = F.concat(
        F.lit("["), json_quote(source_id), F.lit(","), start.cast("string"), F.lit(","),
        end.cast("string"), F.lit(","), json_quote(text), F.lit("]"),
    )
    return F.sha2(payload.cast("binary"), 256)


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def title_text(path: Column, headings: Column) -> Column:
    return F.concat_ws("\n", base_name(path), headings)


def retrieval_text(path: Column, headings: Column, text: Column) -> Column:
    return F.concat_ws("\n", base_name(path), headings, text)
