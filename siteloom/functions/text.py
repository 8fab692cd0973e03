"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts of web pages see it, no-break and other Unicode spaces included.
SPACES = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"

# The words of three letters or more that are no terms; shorter tokens are none anyway. A parameter of ``terms``.
STOP_WORDS: tuple[str, ...] = tuple(
    """about above after again against ain all also and any are aren because been before being below between both but can cannot could couldn did didn does doesn doing don down during each even few for from further
    get got had hadn has hasn have haven having her here hers herself him himself his how into isn its itself just let may mightn more most mustn myself need needn nor not now off once only other our ours ourselves out over own
    same shan she should shouldn some such than that the their theirs them themselves then there these they this those through too under until very was wasn were weren what when where which while who whom why will with won would wouldn
    you your yours yourself yourselves
    ago already always another anything around back come coming else everything find first follow give going good great home however include keep know last like look make many might much must new next old one part place right
    said say see set since still sure take tell thing think though three time two use used using via want way well whole within work year yet""".split()
)


def collapsed(text: Column) -> Column:
    """White space runs as one space, trimmed; null if nothing is left."""
    out = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.when(out != "", out)


def comparable(text: Column) -> Column:
    """Lower case, everything but letters a-z and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def duplicate_key(text: Column) -> Column:
    """White space runs as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, SPACES, " ")))


def truncated(text: Column, most: int = 90) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("…")))


def summarized(values: Column, most: int = 3) -> Column:
    """The first distinct values, shortened, and how many more there are; 'none' if there are none."""
    once = F.array_distinct(values)
    shown = F.array_join(F.transform(F.slice(once, 1, most), lambda v: truncated(v)), ", ")
    more = F.when(F.size(once) > most, F.concat(shown, F.lit(", +"), F.size(once) - most, F.lit(" more"))).otherwise(shown)
    return F.when(F.size(once) == 0, F.lit("none")).otherwise(more)


def occurrences(text: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences without regard to case; 0 for an empty keyword or null text."""
    low, key = F.lower(F.coalesce(text, F.lit(""))), F.lower(keyword)
    n = ((F.length(low) - F.length(F.replace(low, key, F.lit("")))) / F.length(key)).cast("int")
    return F.when(F.length(key) > 0, n).otherwise(F.lit(0))


def terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens of a-z, digits, apostrophes and hyphens, of three characters or more, without stop words."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9'\\-]+", " ")), " ")
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*stop_words))


def shingle_tokens(text: Column) -> Column:
    """Tokens for shingles: lower case, letters and digits of any script, two characters or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s]+", " "), "(?U)\\s+"), lambda t: F.length(t) >= 2)


def shingles(tokens: Column, k: int = 5) -> Column:
    """The distinct runs of ``k`` tokens."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(F.size(tokens) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def half_up(x: Column) -> Column:
    """Rounding to the nearest integer, halves upward."""
    return F.floor(x + 0.5).cast("long")
