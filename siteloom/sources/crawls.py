"""Sources and sinks: captured pages, folders of HTML, crawl history, keyword lists, and live fetching."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.protocols import parse_robots, sitemap_entries
from siteloom.functions.url import host_key, is_asset, matches_paths, normalize, normalize_url
from siteloom.session import staged

FETCHES = "url string, final_url string, status int, content_type string, headers map<string,string>, redirect_chain array<struct<fromUrl:string,toUrl:string,status:int>>, html string, crawl_order int"
HISTORY = "host string, crawled_at string, start_url string, page_url string, status int, codes array<string>, totals struct<high:int,medium:int,low:int>"
# Fixed values of fetching.
REDIRECTS, RETRIES, TIMEOUT_S, CONCURRENCY, RETRY_STATUS = 10, 2, 10.0, 6, frozenset({408, 425, 429, 500, 502, 503, 504})
SITEMAP_FILES = 20
USER_AGENT = "Mozilla/5.0 (compatible; siteloom)"

#: A fetcher takes (url, timeout, user agent) and gives (status, headers, text), not following redirects; it raises if there is no answer.
Fetcher = Callable[[str, float, str], tuple[int, dict[str, str], str]]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_args, **_kwargs):
        return None


def http_fetch(url: str, timeout: float, agent: str) -> tuple[int, dict[str, str], str]:
    """One GET over HTTP."""
    request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8"})
    try:
        with urllib.request.build_opener(_NoRedirect).open(request, timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode("utf-8", "replace")


def fetch_page(url: str, fetch: Fetcher, retries: int = RETRIES, timeout: float = TIMEOUT_S, agent: str = USER_AGENT, pause: Callable[[float], None] = time.sleep) -> dict:
    """A page with its redirects, at most ten and without loops. Failures and busy answers are
    tried again after 250 ms, 500 ms and so on; a page that can't be had has status 0."""
    hops: list[dict] = []
    at, seen = url, {url}
    try:
        while True:
            for n in range(retries + 1):
                try:
                    status, headers, text = fetch(at, timeout, agent)
                    if n == retries or status not in RETRY_STATUS:
                        break
                except Exception:
                    if n == retries:
                        raise
                pause(0.25 * 2**n)
            to = normalize(urljoin(at, headers["location"])) if 300 <= status < 400 and headers.get("location") else None
            if to is None:
                return {"url": url, "final_url": normalize(at) or at, "status": status, "content_type": headers.get("content-type"), "headers": list(headers.items()), "redirect_chain": hops, "html": text}
            hops.append({"fromUrl": at, "toUrl": to, "status": status})
            if to in seen or len(hops) > REDIRECTS:
                raise RuntimeError("redirect loop")
            seen.add(to)
            at = to
    except Exception:
        return {"url": url, "final_url": at, "status": 0, "content_type": None, "headers": [], "redirect_chain": hops, "html": None}


def fetched(urls: DataFrame, fetch: Fetcher = http_fetch, concurrency: int = CONCURRENCY, **options) -> DataFrame:
    """Fetch a frontier ``url``: partitions in parallel, ``concurrency`` requests at a time in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("redirect_chain", pa.list_(pa.struct([("fromUrl", pa.string()), ("toUrl", pa.string()), ("status", pa.int32())]))), ("html", pa.string())]
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                rows = list(pool.map(lambda u: fetch_page(u, fetch, **options), batch.column("url").to_pylist()))
                yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    return urls.select("url").mapInArrow(run, FETCHES.rsplit(", ", 1)[0])


SITE = "site string, robots_status int, robots_blocks_all boolean, robots_sitemaps array<string>, sitemap_status int, lastmods array<string>, llms_status int, llms_text string"


def fetch_site_files(origin: str, fetch: Fetcher = http_fetch, timeout: float = TIMEOUT_S, agent: str = USER_AGENT) -> dict[str, tuple[int | None, str]]:
    """Status and text of a site's robots.txt, sitemap.xml, llms.txt and llms-full.txt; the status is None where there is no answer."""

    def one(name: str) -> tuple[int | None, str]:
        try:
            status, _, text = fetch(f"{origin.rstrip('/')}/{name}", timeout, agent)
            return status, text
        except Exception:
            return None, ""

    return {name: one(name) for name in ("robots.txt", "sitemap.xml", "llms.txt", "llms-full.txt")}


def site_row(spark: SparkSession, site: str, files: dict[str, tuple[int | None, str]]) -> DataFrame:
    """The row of ``rules.infrastructure_issues`` from the files of a site."""
    robots, sitemap, llms = (files.get(n, (None, "")) for n in ("robots.txt", "sitemap.xml", "llms.txt"))
    parsed = parse_robots(robots[1])
    return spark.createDataFrame([(site, robots[0], parsed["blocks_all"], parsed["sitemaps"], sitemap[0], [m for _, m in sitemap_entries(sitemap[1]) if m], llms[0], llms[1])], SITE)


def crawl(spark: SparkSession, start_urls: list[str], fetch_round: Callable[[DataFrame], DataFrame], links_of: Callable[[DataFrame], DataFrame], max_pages: int = 10, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Breadth-first crawl in rounds: each fetches a frontier, then links not seen before make the next.

    ``fetch_round`` maps a frontier to fetches (live, or a join with captures), ``links_of`` gives the URLs found in fetches.
    Pages and frontiers stay in Spark, each round written once; the driver holds counts only. ``crawl_order`` goes by round, then by URL.
    """
    start = spark.createDataFrame([(u,) for u in start_urls], "url string").select(normalize_url(F.col("url")).alias("url")).where("url is not null").distinct()
    frontier = visited = staged(start, "crawl-frontier")
    rounds: list[DataFrame] = []
    taken = 0
    while taken < max_pages and not frontier.isEmpty():
        got = fetch_round(frontier.orderBy("url").limit(max_pages - taken)).dropDuplicates(["final_url"])
        for earlier in rounds:
            got = got.join(earlier.select("final_url"), "final_url", "left_anti")
        got = staged(got.withColumn("depth", F.lit(len(rounds))), "crawl-round")
        rounds.append(got)
        taken += got.count()
        fresh = links_of(got).select(normalize_url(F.col("url")).alias("url")).where("url is not null").where(~is_asset(F.col("url"))).where(matches_paths(F.col("url"), include or [], exclude or [])).distinct()
        frontier = staged(fresh.join(visited, "url", "left_anti"), "crawl-frontier")
        visited = visited.unionByName(frontier)
    if not rounds:
        return spark.createDataFrame([], FETCHES)
    pages = rounds[0]
    for more in rounds[1:]:
        pages = pages.unionByName(more.select(pages.columns))
    return numbered(pages, ["depth"], "url", "crawl_order").drop("depth")


def numbered(rows: DataFrame, groups: list[str], by: str, name: str, head: int = 40) -> DataFrame:
    """``rows`` with their number from 0 in the order of ``groups`` and the string ``by``.

    In two levels: rows are numbered inside the blocks that share the groups and the leading characters of ``by``, and blocks,
    one row each, are added up, so rows are never ordered in one task.
    """
    from pyspark.sql import Window

    placed = rows.withColumn("_head", F.substring(by, 1, head))
    block = [*groups, "_head"]
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).select(*block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy(by)) - 1
    return placed.withColumn("_i", inside).join(starts, block).withColumn(name, (F.col("_start") + F.col("_i")).cast("int")).drop("_head", "_start", "_i")


def _unwrapped(loc):
    """A location without CDATA, entities and space around it."""
    loc = F.trim(F.regexp_replace(loc, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        loc = F.replace(loc, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(loc, r"^\s+|\s+$", ""))


def _locations(xml):
    """Every ``loc`` of a sitemap, in order."""
    return F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc>"), 1), _unwrapped), lambda x: x != "")


def sitemap_seeds(files: DataFrame, roots: list[str], max_urls: int | None = None, max_files: int = SITEMAP_FILES) -> tuple[DataFrame, bool]:
    """Page URLs reachable from sitemap files ``(url, xml)``, and whether a limit cut them off.

    Indexes are followed breadth first, in the order of their entries, over at most ``max_files`` files; the driver
    holds no more names than that.
    """
    spark = files.sparkSession
    todo, done, found, limited = list(dict.fromkeys(roots)), [], None, False
    while todo and len(done) < max_files:
        batch, todo = todo[: max_files - len(done)], todo[max_files - len(done) :]
        done += batch
        place = spark.createDataFrame(list(enumerate(batch)), "ord int, url string")
        rows = staged(files.join(F.broadcast(place), "url").select("ord", F.col("xml").rlike("(?i)<sitemapindex\\b").alias("index"), _locations(F.col("xml")).alias("locs")), "sitemaps")
        nested = rows.where("index").select("ord", F.posexplode("locs").alias("at", "loc")).groupBy("loc").agg(F.min(F.struct("ord", "at")).alias("first")).where(~F.col("loc").isin(done + todo))
        fresh = [r["loc"] for r in nested.orderBy("first").limit(max_files + 1).collect()]
        todo += fresh
        urls = rows.where("not index").select(F.explode("locs").alias("loc")).select(normalize_url(F.col("loc")).alias("url")).where("url is not null")
        found = urls if found is None else found.unionByName(urls)
    limited = bool(todo)
    out = (found if found is not None else spark.createDataFrame([], "url string")).distinct()
    if max_urls is not None:
        limited |= out.count() > max_urls
        out = out.orderBy("url").limit(max_urls)
    return out, limited


def sitemap_table(files: DataFrame) -> DataFrame:
    """``sitemap_url, url, lastmod`` of the entries in sitemap files ``(url, xml)``."""
    one = lambda block, tag: _unwrapped(F.regexp_extract(block, f"(?is)<{tag}>(.*?)</{tag}>", 1))
    blocks = files.select(F.col("url").alias("sitemap_url"), F.explode(F.regexp_extract_all("xml", F.lit("(?is)<url>(.*?)</url>"), 1)).alias("block"))
    return blocks.select("sitemap_url", one(F.col("block"), "loc").alias("url"), F.nullif(one(F.col("block"), "lastmod"), F.lit("")).alias("lastmod")).where("url != ''")


def html_folder(spark: SparkSession, path: str) -> DataFrame:
    """HTML files below a folder as captures.

    A page's URL is its canonical link, whatever the order of attributes; in a page with a base URL the og:url or
    else the base; otherwise its path, with index files as their folder. Only URLs that begin with http count.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path).withColumn("file", F.col("_metadata.file_path")).where(F.col("file").rlike("(?i)\\.html?$"))
    bare = lambda text: re.sub(r"^file:/+", "/", text).rstrip("/")
    relative = F.regexp_replace(F.replace(F.regexp_replace("file", "^file:/+", "/"), F.lit(bare(path)), F.lit("")), "(?i)/index\\.html?$", "/")

    def first(tag: str, needs: str, attribute: str):
        """The attribute of the first such tag, null where it is no absolute URL."""
        tags = F.filter(F.regexp_extract_all("value", F.lit(f"(?is)<{tag}\\b[^>]*>"), 0), lambda t: t.rlike(needs) if needs else F.lit(True))
        value = F.trim(F.regexp_extract(F.get(tags, F.lit(0)), f"(?is)\\b{attribute}\\s*=\\s*[\"']?([^\"'>]*)", 1))
        return F.when(value.startswith("http"), value)

    canonical, base = first("link", "(?is)\\brel\\s*=\\s*[\"']?canonical[\"'\\s/>]", "href"), first("base", "", "href")
    og = first("meta", "(?is)\\bproperty\\s*=\\s*[\"']?og:url[\"'\\s/>]", "content")
    url = F.coalesce(canonical, F.when(base.isNotNull(), F.coalesce(og, base)), relative)
    return files.select(
        url.alias("url"), url.alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.create_map().cast("map<string,string>").alias("headers"),
        F.array().cast("array<struct<fromUrl:string,toUrl:string,status:int>>").alias("redirect_chain"), F.col("value").alias("html"), F.monotonically_increasing_id().alias("crawl_order"),
    )


def keyword_file(spark: SparkSession, path: str) -> list[str]:
    """Keywords of a settings file: one per line, trimmed, distinct, in order; lines that start with # are comments."""
    lines = [r["value"].strip() for r in spark.read.text(path).collect()]
    return list(dict.fromkeys(x for x in lines if x and not x.startswith("#")))


# ---------------------------------------------------------------- crawl history


def free_stamp(stamp: str, taken: set[str], most: int = 1000) -> str:
    """The stamp, or the first millisecond after it that isn't taken."""
    at = datetime.fromisoformat(stamp.replace("Z", "+00:00"))
    for n in range(most + 1):
        text = (at + timedelta(milliseconds=n)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        if text not in taken:
            return text
    raise RuntimeError("no free time stamp")


def file_stamp(iso: str) -> str:
    """A time stamp as a file name."""
    return re.sub(r"[:.]", "-", iso)


def stamp_of(name: str) -> str:
    """The time stamp that a file name spells."""
    return re.sub(r"T(\d\d)-(\d\d)-(\d\d)-(\d{3})Z", r"T\1:\2:\3.\4Z", name)


def claimed(spark: SparkSession, path: str, site: str, stamp: str) -> bool:
    """Whether this call, and no other, took the stamp for a site: a file that can only be created once marks it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_claims/{file_stamp(site)}/{file_stamp(stamp)}")
    return bool(mark.getFileSystem(conf).createNewFile(mark))


def persist_crawl(rows: DataFrame, path: str, crawled_at: str) -> dict[str, str | None]:
    """Append a crawl's pages to the history, partitioned by site and time. Returns its stamp and the previous one, per call for one site.

    A stamp is claimed before anything is written, so of two writers with one stamp the second takes the next millisecond.
    """
    spark = rows.sparkSession
    site = rows.select(host_key(F.col("start_url")).alias("h")).first()["h"]
    earlier = {r["crawled_at"] for r in list_crawls(spark, path, site).collect()}
    stamp = free_stamp(crawled_at, earlier)
    while not claimed(spark, path, site, stamp):
        earlier.add(stamp)
        stamp = free_stamp(crawled_at, earlier)
    rows.select(F.lit(site).alias("host"), F.lit(stamp).alias("crawled_at"), "start_url", "page_url", "status", "codes", "totals").write.mode("append").partitionBy("host", "crawled_at").parquet(path)
    return {"host": site, "crawled_at": stamp, "previous": max((e for e in earlier if e < stamp), default=None)}


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """The history; sites and times prune partitions. A folder that doesn't exist is an empty history."""
    try:
        return spark.read.option("basePath", path).schema(HISTORY).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], HISTORY)
        raise


def list_crawls(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """``host, crawled_at, pages`` of each crawl, the latest first."""
    rows = load_history(spark, path)
    rows = rows.where(F.col("host") == site) if site else rows
    return rows.groupBy("host", "crawled_at").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("crawled_at"), "host")


def recent_crawls(history: DataFrame, n: int) -> DataFrame:
    """The rows of the ``n`` latest crawls of every site."""
    from pyspark.sql import Window

    keys = history.select("host", "crawled_at").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("crawled_at")))).where(F.col("rank") <= n).drop("rank")
    return history.join(keys, ["host", "crawled_at"], "left_semi")
