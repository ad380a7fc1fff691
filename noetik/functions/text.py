"""Scalar functions as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def spaced(text: Column) -> Column:
    """The tokens as one string, with a space between two."""
    return F.trim(F.regexp_replace(F.lower(text), WORD, " "))


def shingles(text: Column, k: int) -> Column:
    """Distinct hashes of runs of k tokens; of all if there are fewer; none without tokens."""
    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))
        return F.when(F.size(w) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<long>"))

    # through an array of one, so that the text is cut into tokens once and not for each run
    return F.get(F.transform(F.array(tokens(text)), runs), F.lit(0))


def cjk_bigrams(text: Column) -> Column:
    """Pairs of neighbouring Han characters."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{IsHan}+)"), 1)
    pairs = F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2))))
    return F.flatten(pairs)


def normalize_name(name: Column) -> Column:
    """Case, width of ASCII and white space."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.trim(F.regexp_replace(F.lower(F.translate(name, wide + "　", "".join(map(chr, range(0x21, 0x7F))) + " ")), r"\s+", " "))


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 16))


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), 1)


def wiki_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)"), 1)


def keyword_match(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(text).contains(F.lower(w)))


def url_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#:]*)", 1)), r"^(www|m)\.", "")


def snippet(text: Column, word: str, around: int) -> Column:
    at = F.locate(word, F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(word))))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON object or array and nothing more."""
    return F.coalesce(F.json_object_keys(text).cast("string"), F.json_array_length(text).cast("string")).isNotNull()


def bigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, 2)))


def fuzzy(a: Column, b: Column) -> Column:
    """Bigram Jaccard similarity; supporting evidence only."""
    x, y = bigrams(a), bigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def provenance_rank(kind: Column) -> Column:
    return F.when(kind.isin("statement", "on_screen"), 1).when(kind == "visual_observation", 2).otherwise(3)
