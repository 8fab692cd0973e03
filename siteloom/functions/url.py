"""URL functions: column expressions for whole tables, and the same rules for one string."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):(?://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?)?([^?#]*)(\?[^#]*)?(#.*)?$"
_DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
# File endings of assets, query parameters of tracking.
ASSETS = r"(?i)\.(avif|css|gif|ico|jpe?g|js|json|map|mp3|mp4|pdf|png|svg|txt|webm|webp|woff2?|xml|zip)$"
TRACKING = r"(?i)^(utm_.*|gclid|fbclid|mc_cid|mc_eid)$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def url_scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def url_host(url: Column) -> Column:
    """Host in lower case, '' if there is none."""
    return F.lower(_part(url, 3))


def url_path(url: Column) -> Column:
    """Path, '/' if empty."""
    path = _part(url, 5)
    return F.when(path == "", F.lit("/")).otherwise(path)


def _port(url: Column) -> Column:
    port, scheme = _part(url, 4), url_scheme(url)
    default = F.lit(False)
    for name, number in _DEFAULT_PORTS.items():
        default = default | ((scheme == name) & (port == number))
    return F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))


def _rebuilt(url: Column, path: Column, query: Column) -> Column:
    user = _part(url, 2)
    return F.concat(url_scheme(url), F.lit("://"), F.when(user == "", F.lit("")).otherwise(F.concat(user, F.lit("@"))), url_host(url), _port(url), path, query)


def is_web_url(url: Column) -> Column:
    return url_scheme(url).isin("http", "https") & (url_host(url) != "")


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no trailing slashes except for the root; the query stays. Null if it is no web URL."""
    path = url_path(url)
    bare = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(is_web_url(url), _rebuilt(url, bare, _part(url, 6)))


def match_url(url: Column) -> Column:
    """The key on which traffic is matched: like ``normalize_url``, but slashes stay and the query is
    sorted and freed of tracking parameters. What is no URL is trimmed only."""
    pairs = F.filter(F.split(F.substring(_part(url, 6), 2, 1_000_000), "&"), lambda p: (p != "") & ~F.regexp_replace(p, "=.*$", "").rlike(TRACKING))
    keyed = F.transform(pairs, lambda p, i: F.struct(F.regexp_replace(p, "=.*$", "").alias("k"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
    return F.when(is_web_url(url), _rebuilt(url, url_path(url), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))).otherwise(F.trim(url))


def toggled_slash(url: Column) -> Column:
    """The URL with a trailing slash added to or taken from its path; null for a root or no URL."""
    path = url_path(url)
    other = F.when(path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(F.concat(path, F.lit("/")))
    return F.when(is_web_url(url) & (path != "/"), _rebuilt(url, other, _part(url, 6)))


def is_asset(url: Column) -> Column:
    """No web URL, or one of a file that isn't a page."""
    return ~is_web_url(url) | url_path(url).rlike(ASSETS)


def path_and_query(url: Column) -> Column:
    return F.concat(url_path(url), _part(url, 6))


def matches_paths(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Path and query match some of ``include`` (or there are none) and none of ``exclude``."""
    target = path_and_query(url)
    keep = F.lit(not include)
    for pattern in include:
        keep = keep | target.rlike(pattern)
    for pattern in exclude:
        keep = keep & ~target.rlike(pattern)
    return keep


def lang_tag(tag: Column) -> Column:
    """Trimmed, lower case, hyphens; null if empty."""
    out = F.lower(F.replace(F.trim(tag), F.lit("_"), F.lit("-")))
    return F.when(out != "", out)


def primary_lang(tag: Column) -> Column:
    """The first subtag; null for x-default and empty tags."""
    norm = lang_tag(tag)
    return F.when(norm != "x-default", F.split_part(norm, F.lit("-"), F.lit(1)))


def expected_locale(url: Column) -> Column:
    """The language that the first path segment names, if it names one."""
    first = F.regexp_extract(url_path(url), "^/+([^/]+)", 1)
    return F.when(first.rlike("(?i)^[a-z]{2}(-[a-z]{2})?$"), primary_lang(first))


def host_key(url: Column) -> Column:
    """The folder name of a site: host without www., port after an underscore."""
    port = F.replace(_port(url), F.lit(":"), F.lit("_"))
    return F.concat(F.regexp_replace(url_host(url), r"^www\.", ""), port)


def bucket_key(url: Column) -> Column:
    """Language (where the path starts with one) and first segment; '/' for the root."""
    segments = F.filter(F.split(F.lower(url_path(url)), "/"), lambda s: s != "")
    local = segments[0].rlike("^[a-z]{2}(-[a-z]{2})?$")
    rest = F.coalesce(F.get(segments, F.lit(1)), F.lit("(root)"))
    return F.when(F.size(segments) == 0, F.lit("/")).when(local, F.concat(F.coalesce(primary_lang(segments[0]), segments[0]), F.lit("/"), rest)).otherwise(segments[0])


# ---------------------------------------------------------------- one string at a time, for parsers


def normalize(url: str) -> str | None:
    """``normalize_url`` of one absolute URL, dot segments resolved; None if it is none."""
    try:
        p = urlsplit(url.strip())
        port = p.port
    except ValueError:
        return None
    if p.scheme.lower() not in ("http", "https") or not p.hostname:
        return None
    host = p.hostname.lower()
    if port and str(port) != _DEFAULT_PORTS[p.scheme.lower()]:
        host += f":{port}"
    path = urlsplit(urljoin(url.strip(), p.path or "/")).path or "/"
    if path != "/":
        path = path.rstrip("/") or "/"
    return urlunsplit((p.scheme.lower(), host, quote(path, safe="/%:@!$&'()*+,;=~-._"), p.query, ""))


def resolve(base: str, ref: str) -> str | None:
    """``ref`` resolved against ``base`` and normalised."""
    try:
        return normalize(urljoin(base, ref.strip()))
    except ValueError:
        return None


def match_key(url: str) -> str:
    """``match_url`` of one string."""
    p = urlsplit(url.strip())
    if p.scheme.lower() not in ("http", "https") or not p.hostname:
        return url.strip()
    pairs = sorted((kv for kv in parse_qsl(p.query, keep_blank_values=True) if not re.match(TRACKING, kv[0])), key=lambda kv: kv[0])
    port = f":{p.port}" if p.port and str(p.port) != _DEFAULT_PORTS[p.scheme.lower()] else ""
    return urlunsplit((p.scheme.lower(), p.hostname.lower() + port, p.path or "/", urlencode(pairs), ""))
