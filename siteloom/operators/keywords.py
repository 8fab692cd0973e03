"""Keyword matches and term frequencies over titles, descriptions, headings and bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import STOP_WORDS, occurrences, terms

PLACES = (("title", "title"), ("meta_description", "meta_description"), ("h1", "h1"), ("body", "body_text"))


def _texts(pages: DataFrame) -> DataFrame:
    return pages.select("final_url", "crawl_order", "title", "meta_description", F.array_join("h1s", " ").alias("h1"), "body_text")


def keyword_matches(pages: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``final_url, keyword, ord``, the count in each place and ``total`` for every page and keyword.

    The keywords are a setting; they become a literal array in the plan, so pages aren't shuffled.
    """
    words = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("keyword")) for i, k in enumerate(dict.fromkeys(keywords))]))
    rows = _texts(pages).withColumn("k", words).select("*", "k.*")
    counted = rows.select("final_url", "crawl_order", "keyword", "ord", *[occurrences(F.col(c), F.col("keyword")).alias(f"in_{p}") for p, c in PLACES])
    return counted.withColumn("total", sum((F.col(f"in_{p}") for p, _ in PLACES[1:]), F.col("in_title")))


def keyword_summary(pages: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Per keyword: ``pages, total`` and the count in each place; keywords without match first, then by pages. ``keyword_urls`` has the pages."""
    hit = F.col("total") > 0
    matches = keyword_matches(pages, keywords)
    sums = matches.groupBy("keyword", "ord").agg(F.count_if(hit).alias("pages"), F.sum("total").alias("total"), *[F.sum(f"in_{p}").alias(f"in_{p}") for p, _ in PLACES])
    return sums.orderBy((F.col("total") > 0), "pages", "ord")


def keyword_urls(pages: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``keyword, final_url``: the distinct pages with a match, one row each."""
    return keyword_matches(pages, keywords).where("total > 0").select("keyword", "final_url").distinct()


def term_frequencies(pages: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``term, occurrences, pages``, the count in each place, and ``first``, where it is seen first, over all pages.

    Terms are counted per page before they are shuffled, so a frequent term costs one row per page.
    """
    place = lambda name, column: F.transform(terms(F.col(column), stop_words), lambda t: F.struct(t.alias("term"), F.lit(name).alias("place")))
    tokens = _texts(pages).select("final_url", "crawl_order", F.posexplode(F.concat(*[place(p, c) for p, c in PLACES])).alias("at", "t"))
    first = F.min(F.struct("crawl_order", "at"))
    per_page = tokens.groupBy("final_url", F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("n"), first.alias("first"), *[F.count_if(F.col("t.place") == p).alias(f"in_{p}") for p, _ in PLACES])
    return per_page.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("pages"), *[F.sum(f"in_{p}").alias(f"in_{p}") for p, _ in PLACES], F.min("first").alias("first"))


def top_terms(pages: DataFrame, n: int = 20, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The ``n`` most frequent terms, of equals the one seen first in crawl order."""
    return term_frequencies(pages, stop_words).orderBy(F.desc("occurrences"), "first").limit(n).drop("first")
