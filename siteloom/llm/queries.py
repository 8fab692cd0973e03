"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.pages import boilerplate_lines, main_content, repeated_site_lines, template_residue, text_quality, without_lines
from siteloom.llm.mixing import mixed, reached_shares
from siteloom.llm.packing import container_fill, packed
from siteloom.llm.spans import shared_chars, shared_passages, shared_spans
from siteloom.llm.tokens import RANKS, token_counts
from siteloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue(table(spark, sf_dir, "pages")).select("page_id", "field_name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_site_lines(table(spark, sf_dir, "pages"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return without_lines(pages, repeated_site_lines(pages))


def p3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "pages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_quality(table(spark, sf_dir, "pages"))
    kinds = F.array_compact(F.array(F.when(F.col("verdict").isin("list", "table", "junk"), F.col("verdict")), F.when(F.col("wrong_count"), F.lit("wrong_count"))))
    return found.select("page_id", F.explode(kinds).alias("kind"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate_lines(table(spark, sf_dir, "pages"))


def p4_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content(table(spark, sf_dir, "pages"))


#: The setting that names the tokenizer's rank file on the executors.
TOKENIZER_KEY = "siteloom.tokenizer.ranks"


def counted(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), keep, spark.conf.get(TOKENIZER_KEY, RANKS))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(counted(spark, sf_dir), table(spark, sf_dir, "containers"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_fill(p8_packing(spark, sf_dir), table(spark, sf_dir, "containers"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(counted(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_chars(table(spark, sf_dir, "documents"))


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_clean": p2_clean, "p3_found": p3_found, "p3_quality": p3_quality, "p4_found": p4_found, "p4_main": p4_main,
    "p8_packing": p8_packing, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_passages": p10_passages, "p10_spans": p10_spans,
}

_P2 = r"""
WITH b AS (
  SELECT page_id, body_text, regexp_extract(lower(trim(final_url)), '^[a-z][a-z0-9+.\-]*://([^/?#@]*@)?([^/?#:]*)', 2) AS host FROM pages WHERE body_text IS NOT NULL),
l AS (
  SELECT page_id, host, i - 1 AS line_no, parts[i] AS line,
         regexp_replace(lower(trim(regexp_replace(parts[i], '[\s\x0b\x85\p{Z}]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS form
  FROM (SELECT page_id, host, string_split(body_text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(body_text, chr(10))))) AS i FROM b WHERE host <> '')),
n AS (SELECT host, count(*) AS n_rows FROM b GROUP BY host),
c AS (SELECT host, form, count(DISTINCT page_id) AS n FROM l WHERE form <> '' GROUP BY host, form),
f AS (SELECT c.host, c.form FROM c JOIN n USING (host) WHERE c.n >= 5 AND c.n * 5 >= n.n_rows)
"""

ORACLES: dict[str, str] = {
    "p2_found": _P2 + "SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM l SEMI JOIN f USING (host, form)",
    "p2_clean": _P2
    + """SELECT p.page_id, CASE WHEN p.body_text IS NULL THEN NULL ELSE coalesce(k.t, '') END AS clean_text FROM pages p LEFT JOIN (
  SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM (
    SELECT l.page_id, l.line_no, l.line FROM l ANTI JOIN f USING (host, form)
    UNION ALL SELECT page_id, 0, body_text FROM b WHERE host = '')
  GROUP BY page_id) k USING (page_id)""",
    "p10_found": """WITH g AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT doc_id, i, coalesce(max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g SEMI JOIN s USING (h))
SELECT doc_id, CAST(sum(i + 200 - greatest(i, before)) AS INTEGER) AS shared_chars FROM r GROUP BY doc_id""",
}
