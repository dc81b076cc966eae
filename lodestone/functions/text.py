"""Text and number expressions; all stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that don't count as content.
STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "is", "are", "was", "were", "how", "what", "when", "where", "who", "which", "many", "much", "do", "does", "did", "this", "that",
    "these", "those", "with", "about", "من", "في", "على", "الى", "إلى", "عن", "ما", "كم", "هل", "و", "او", "أو", "هذا", "هذه", "التي", "الذي", "كيف", "متى", "اين", "أين",
)
# A heading's greatest length and words, and the marks that end a sentence.
HEADING_CHARS, HEADING_WORDS, TERMINAL = 64, 8, ".!?:;,،؛"
# A number as it is read from text.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def tokens(text: Column) -> Column:
    """Runs of letters and of number signs that are no digits, and runs of digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nl}\p{No}]+|\p{Nd}+"), 0)


def content_tokens(text: Column) -> Column:
    """Distinct tokens of two characters or more that are not stopwords."""
    return F.array_except(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 1)), F.array(*map(F.lit, STOPWORDS)))


def overlap(query: Column, context: Column) -> Column:
    """The share of the query's content tokens that the context has; 0 for a query without any."""
    q = content_tokens(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, content_tokens(context))) / F.size(q))


def dominant_script(text: Column) -> Column:
    arabic = F.regexp_count(text, F.lit(r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﻿]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((arabic == 0) & (latin == 0), F.lit("other")).when(arabic >= latin, F.lit("arabic")).otherwise(F.lit("latin"))


def number(value: Column) -> Column:
    """The number that a text with thousands commas holds, else null; nan and inf are no numbers."""
    plain = F.trim(F.regexp_replace(value.cast("string"), ",", ""))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def looks_like_heading(line: Column) -> Column:
    s = F.trim(line)
    first = F.regexp_extract(s, r"(\p{L})", 1)
    return (
        (s != "") & (F.length(s) <= HEADING_CHARS) & (F.size(F.split(s, r"\s+")) <= HEADING_WORDS)
        & ~F.right(s, F.lit(1)).isin(*TERMINAL) & (first != "") & (~first.rlike("[A-Za-z]") | first.rlike("[A-Z]"))
    )


def context_prefix(heading: Column, text: Column) -> Column:
    """`heading — text` unless the text begins with the heading already."""
    return F.when(blank(heading) | F.lower(text).startswith(F.lower(heading)), text).otherwise(F.concat(heading, F.lit(" — "), text))


def round_half_even(value: Column, digits: int) -> Column:
    """A double at so many decimal digits (0 to 7), by its exact binary value, ties to even.

    The product with the power of ten is split into the double nearest to it and what that leaves, which together are
    exact, so that values just beside a tie go to their own side. Doubles too large to have such digits stay.
    """
    if not 0 <= digits <= 7:
        raise ValueError(f"{digits} digits")
    x, ten = value.cast("double"), F.lit(float(10**digits))
    y = x * ten
    wide = x * F.lit(134217729.0)  # 2^27 + 1: the upper half of the digits of x, then the lower one
    high = wide - (wide - x)
    left = (high * ten - y) + (x - high) * ten
    near = F.rint(y)
    off = y - near
    exact = near + F.when((off == 0.5) & (left > 0) | (off + left > 0.5), 1.0).when((off == -0.5) & (left < 0) | (off + left < -0.5), -1.0).otherwise(0.0)
    return F.when((F.abs(y) >= F.lit(2.0**53)) | F.isnan(x), x).otherwise(exact / ten)


def token_estimate(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.greatest(F.floor(F.length(t) / 4), F.regexp_count(t, F.lit(r"\S+"))).cast("long")


def snippet(text: Column, limit: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def looks_like_url(value: Column) -> Column:
    v = F.trim(value)
    bare = ~v.contains(" ") & v.contains(".") & ~v.contains("@") & (F.length(v) > 3) & (F.length(v) <= 200)
    return F.coalesce(v.rlike("(?i)^https?://") | bare, F.lit(False))


def normalized_url(value: Column) -> Column:
    v = F.trim(value)
    return F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit("https://"), F.ltrim(v, F.lit("/"))))


def root_domain(url: Column) -> Column:
    """The host in lower case without port and leading www."""
    host = F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def good_extract(text: Column) -> Column:
    """At least 150 characters and no sign of a disambiguation page."""
    bad = "may refer to|disambiguation|versioning|can refer to"  # fixed values
    return F.coalesce((F.length(text) >= 150) & ~F.lower(text).rlike(bad), F.lit(False))


def duration_ms(message: Column) -> Column:
    """The number before ms after a dash, as log texts have it."""
    return F.regexp_extract(message, r"[—-]\s*([\d.]+)\s*ms", 1).try_cast("double")


#: The namespace of names that are URLs, as RFC 4122 gives it.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def stable_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of a name: of the SHA-1 of namespace and name, with the bits of version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def json_in_prose(text: str) -> dict:
    """The JSON object that an answer is or holds: without its fence, or its first part in balanced braces."""
    import json
    import re

    plain = re.sub(r"\A\s*(?:```(?:json)?)?\s*|\s*(?:```)?\s*\Z", "", text)
    opened, depths = plain.find("{"), 0
    candidates = [plain]
    for at, c in enumerate(plain[max(opened, 0) :], max(opened, 0)):
        depths += {"{": 1, "}": -1}.get(c, 0)
        if c == "}" and not depths:
            candidates.append(plain[opened : at + 1])
            break
    for candidate in candidates:
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    raise ValueError(f"no JSON in {text[:200]!r}")
