"""Text Column functions: tokens, stop words, deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word tokens: a letter/digit/underscore followed by letters, digits,
# underscores or apostrophes (Unicode letters, so accented words stay whole).
TOKEN_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"

# FIXED VALUES — the standard English stop-word list of the word-cloud tool
# the term questions were written with, in its natural (alphabetical) order.
ENGLISH_STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any",
    "are", "aren't", "as", "at", "be", "because", "been", "before", "being", "below", "between",
    "both", "but", "by", "can", "can't", "cannot", "com", "could", "couldn't", "did", "didn't",
    "do", "does", "doesn't", "doing", "don't", "down", "during", "each", "else", "ever", "few",
    "for", "from", "further", "get", "had", "hadn't", "has", "hasn't", "have", "haven't",
    "having", "he", "he'd", "he'll", "he's", "her", "here", "here's", "hers", "herself", "him",
    "himself", "his", "how", "how's", "however", "http", "i", "i'd", "i'll", "i'm", "i've", "if",
    "in", "into", "is", "isn't", "it", "it's", "its", "itself", "just", "k", "let's", "like",
    "me", "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of", "off", "on",
    "once", "only", "or", "other", "otherwise", "ought", "our", "ours", "ourselves", "out",
    "over", "own", "r", "same", "shall", "shan't", "she", "she'd", "she'll", "she's", "should",
    "shouldn't", "since", "so", "some", "such", "than", "that", "that's", "the", "their",
    "theirs", "them", "themselves", "then", "there", "there's", "therefore", "these", "they",
    "they'd", "they'll", "they're", "they've", "this", "those", "through", "to", "too", "under",
    "until", "up", "very", "was", "wasn't", "we", "we'd", "we'll", "we're", "we've", "were",
    "weren't", "what", "what's", "when", "when's", "where", "where's", "which", "while", "who",
    "who's", "whom", "why", "why's", "with", "won't", "would", "wouldn't", "www", "you", "you'd",
    "you'll", "you're", "you've", "your", "yours", "yourself", "yourselves",
]


def tokens(c: Column | str) -> Column:
    """Lower-cased word tokens of a text, trailing ``'s`` removed, in text order."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)
    return F.transform(raw, lambda t: F.regexp_replace(t, "'s$", ""))


def is_number_token(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


# uuid5 over the DNS namespace, built from native sha1 (no Python per row).
NAMESPACE_DNS_HEX = "6ba7b8109dad11d180b400c04fd430c8"
UUID_RE = r"^\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"


def _fmt_uuid(hex32: Column) -> Column:
    return F.concat_ws("-", F.substring(hex32, 1, 8), F.substring(hex32, 9, 4), F.substring(hex32, 13, 4),
                       F.substring(hex32, 17, 4), F.substring(hex32, 21, 12))


def uuid5_dns(name: Column | str) -> Column:
    """``uuid.uuid5(NAMESPACE_DNS, name)`` as a native expression."""
    name = F.col(name) if isinstance(name, str) else name
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS_HEX)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(
        ((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)).cast("string"), 10, 16))
    hex32 = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    return _fmt_uuid(hex32)


def point_id(id_col: Column | str) -> Column:
    """A valid UUID id is kept (normalised), anything else becomes uuid5(DNS, id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    s = c.cast("string")
    norm = _fmt_uuid(F.lower(F.regexp_replace(s, "[{}-]", "")))
    return F.when(s.rlike(UUID_RE), norm).otherwise(uuid5_dns(s))
