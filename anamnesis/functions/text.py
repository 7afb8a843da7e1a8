"""Text functions as columns: token estimates, tokenisers, similarities, ids and cuts.

A null text stays null, except where a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[\\u4e00-\\u9fff]"


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN)).cast("bigint")


def token_estimate(text: Column) -> Column:
    """Four other characters or one and a half Chinese ones a token, cut to a whole number."""
    return ((F.length(text) - han_count(text)) / F.lit(4.0) + han_count(text) / F.lit(1.5)).cast("bigint")


def provider_tokens(text: Column, per_han: float) -> Column:
    """Tokens by a provider's coefficient, rounded up."""
    return F.ceil(han_count(text) * F.lit(per_han) + (F.length(text) - han_count(text)) / F.lit(4.0)).cast("bigint")


def length_tokens(text: Column, per: int) -> Column:
    return F.floor(F.length(text) / per).cast("bigint")


def model_tokens(text: Column, per_han: float, per_latin: float = 4.0, per_code: float = 3.5) -> Column:
    """Tokens by kinds of characters; code counts once more, on top of its letters."""
    han = han_count(text)
    latin = F.regexp_count(text, F.lit("[A-Za-z0-9]"))
    code = F.lit(0)
    for pattern in ("```[\\s\\S]*?```", "`[^`]+`", "\\{[\\s\\S]*?\\}", "def |class |function |import |from "):
        code = code + F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    other = F.length(text) - han - latin - code
    return (han / F.lit(per_han) + latin / F.lit(per_latin) + code / F.lit(per_code) + other / F.lit(4.0)).cast("bigint")


def _bigrams(text: Column) -> Column:
    """Every two neighbouring Chinese characters, overlapping."""
    runs = F.regexp_extract_all(text, F.lit(HAN + "{2,}"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(pairs)


def terms_full(text: Column) -> Column:
    """Lower-case words, digits, Chinese pairs and characters."""
    return F.concat(
        F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)),
        F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)),
        _bigrams(text),
        F.regexp_extract_all(text, F.lit(HAN), F.lit(0)),
    )


def terms_pairs(text: Column) -> Column:
    """Lower-case words and Chinese pairs."""
    return F.concat(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), _bigrams(text))


def terms_short(text: Column) -> Column:
    """Chinese characters, and words of at least two letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(HAN + "|[a-zA-Z]{2,}"), F.lit(0))


def blank_words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), "[ \\t\\n\\r\\f\\u000b]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def counts_of(terms: Column) -> Column:
    """Map of term to number of occurrences."""
    return let(terms, lambda t: F.map_from_arrays(F.array_distinct(t), F.transform(F.array_distinct(t), lambda k: F.size(F.filter(t, lambda x: x == k)))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays taken as sets; 0 if one is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def characters(text: Column, n: int = 200) -> Column:
    return F.array_distinct(F.filter(F.split(F.substring(text, 1, n), ""), lambda c: c != ""))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def short(text: Column, n: int, mark: str = "...") -> Column:
    """The first n characters, with a mark if more was there."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def looks_base64(text: Column) -> Column:
    head = F.substring(text, 1, 200)
    return (F.length(text) >= 100) & (F.regexp_count(head, F.lit("[A-Za-z0-9+/=]")) / F.length(head) > 0.95)


def looks_json(text: Column) -> Column:
    t = F.trim(text)
    return (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))


def snippet(text: Column, n: int = 80) -> Column:
    """At most n characters: up to the last sentence end past the half, else cut with dots."""
    flat = F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\u000b]+", " "))
    head = F.substring(flat, 1, n)
    last = F.length(F.regexp_extract(head, "^([\\s\\S]*[。.！!？?])", 1))
    return F.when(F.length(flat) <= n, flat).when(last - 1 > n * 0.5, F.substring(head, F.lit(1), last)).otherwise(F.concat(F.rtrim(head), F.lit("...")))


def short_id(text: Column, n: int, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, n))


def mixed_timestamp(text: Column) -> Column:
    """A time written as ISO text or as seconds since 1970; null if neither."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.timestamp_seconds(text.try_cast("double")),
    )


def match_starts(text: Column, pattern: str) -> Column:
    """Array of (start, hit): the non-overlapping matches of a pattern with their places, from 1.

    The pattern must not match an empty text.
    """
    found = F.struct(F.split(text, pattern, -1).alias("s"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))
    return let(found, lambda f: F.transform(f["m"], lambda hit, i: F.struct((size(f["s"], i + 1) + size(f["m"], i) + 1).alias("start"), hit.alias("hit"))))
