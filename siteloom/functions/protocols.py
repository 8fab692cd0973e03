"""Small formats of the web: headers, robots rules, sitemaps, content signals, structured data."""

from __future__ import annotations

import json
import re
from typing import Any

# ---------------------------------------------------------------- Link headers


def _outside(text: str, sep: str) -> list[str]:
    """Parts of a header between separators that stand outside quotes and angle brackets."""
    parts, start, quoted, angle = [], 0, False, False
    for i, ch in enumerate(text):
        if ch == '"' and not angle:
            quoted = not quoted
        elif ch == "<" and not quoted:
            angle = True
        elif ch == ">" and not quoted:
            angle = False
        elif ch == sep and not quoted and not angle:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def parse_link_header(value: str | None) -> list[dict[str, Any]]:
    """``[{url, rel: [...], params: {...}}]`` of a Link header; parts without a target are dropped."""
    out = []
    for part in _outside(value or "", ","):
        m = re.match(r"\s*<([^>]*)>(.*)$", part, re.DOTALL)
        if not m:
            continue
        params: dict[str, str] = {}
        for piece in _outside(m[2], ";"):
            k, eq, v = piece.partition("=")
            if k.strip() and eq:
                params[k.strip().lower()] = v.strip().strip('"')
        out.append({"url": m[1].strip(), "rel": params.get("rel", "").lower().split(), "params": params})
    return out


def link_rels(value: str | None) -> list[str]:
    """The distinct relations that a Link header names, in lower case and in order."""
    return list(dict.fromkeys(rel for link in parse_link_header(value) for rel in link["rel"]))


# ---------------------------------------------------------------- robots.txt


def parse_robots(text: str | None) -> dict[str, Any]:
    """``blocks_all``, ``sitemaps`` and ``rules``: (agent, order, allow or disallow, path).

    A user-agent line starts a block of its own; agents are kept in lower case. ``blocks_all`` asks for
    ``Disallow: /`` in a block for ``*``, which a blank line ends.
    """
    sitemaps: list[str] = []
    rules: list[tuple[str, int, str, str]] = []
    agent: str | None = None
    star = blocks = False
    for raw in (text or "").splitlines():
        line = raw.split("#", 1)[0].strip()
        if not raw.strip():
            star = False
        key, colon, value = line.partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agent, star = value.lower(), value == "*"
        elif key in ("allow", "disallow") and agent is not None:
            rules.append((agent, len(rules), key, value))
            blocks |= star and key == "disallow" and value == "/"
        elif key == "sitemap" and value and value not in sitemaps:
            sitemaps.append(value)
    return {"blocks_all": blocks, "sitemaps": sitemaps, "rules": rules}


def url_allowed(path: str, agent: str, rules: list[tuple[str, int, str, str]]) -> bool:
    """The longest prefix among the rules of the agent and of ``*`` decides; of equal ones the agent's first."""
    own = [r for r in rules if r[0] == agent.lower()] + [r for r in rules if r[0] == "*"]
    fits = [r for r in own if r[3] and path.startswith(r[3])]
    return not fits or max(fits, key=lambda r: len(r[3]))[2] == "allow"


# The signals, and the words for yes and no.
SIGNALS, YES, NO = ("search", "ai-train", "ai-input"), ("yes", "allow", "true"), ("no", "disallow", "false")


def parse_content_signals(text: str | None) -> dict[str, str]:
    """The known signals of ``Content-Signal`` (or ``Content-Signals``) lines as yes or no; later lines win, other words are skipped."""
    out: dict[str, str] = {}
    for line in (text or "").splitlines():
        m = re.match(r"\s*content-signals?\s*:\s*(.*)$", line.split("#", 1)[0], re.IGNORECASE)
        for piece in (m[1] if m else "").split(","):
            k, _, v = (x.strip().lower() for x in piece.partition("="))
            if k in SIGNALS and v in YES + NO:
                out[k] = "yes" if v in YES else "no"
    return out


def evaluate_llms(text: str | None) -> dict[str, Any]:
    """Heading, sections, links and bytes of an llms.txt; headings may be indented, links may have titles."""
    body = text or ""
    return {
        "has_h1": bool(re.search(r"^\s*#\s+\S", body, re.MULTILINE)),
        "sections": len(re.findall(r"^\s*##\s+\S", body, re.MULTILINE)),
        "links": len(re.findall(r"\[[^\]]+\]\([^)]+\)", body)),
        "bytes": len(body.encode()),
    }


# ---------------------------------------------------------------- sitemaps


def _clean(loc: str) -> str:
    loc = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", loc, flags=re.DOTALL).strip()
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        loc = loc.replace(name, char)
    return loc


def sitemap_locations(xml: str | None) -> list[str]:
    """Every ``loc``, attributes allowed, distinct, in order."""
    return list(dict.fromkeys(x for x in map(_clean, re.findall(r"<loc\b[^>]*>(.*?)</loc>", xml or "", re.IGNORECASE | re.DOTALL)) if x))


def sitemap_entries(xml: str | None) -> list[tuple[str, str | None]]:
    """(loc, lastmod) of each ``url`` element."""
    out = []
    for block in re.findall(r"<url>(.*?)</url>", xml or "", re.IGNORECASE | re.DOTALL):
        loc = re.search(r"<loc>(.*?)</loc>", block, re.IGNORECASE | re.DOTALL)
        mod = re.search(r"<lastmod>(.*?)</lastmod>", block, re.IGNORECASE | re.DOTALL)
        if loc and _clean(loc[1]):
            out.append((_clean(loc[1]), _clean(mod[1]) if mod else None))
    return out


def sitemap_index(xml: str | None) -> list[str]:
    """The sitemaps an index names."""
    if not re.search(r"<sitemapindex\b", xml or "", re.IGNORECASE):
        return []
    return [_clean(m) for b in re.findall(r"<sitemap>(.*?)</sitemap>", xml or "", re.IGNORECASE | re.DOTALL) for m in re.findall(r"<loc>(.*?)</loc>", b, re.IGNORECASE | re.DOTALL)]


# ---------------------------------------------------------------- structured data


def ld_nodes(script: str | None) -> list[dict[str, Any]]:
    """All typed objects of a JSON-LD script: itself, members of arrays and of ``@graph``. Invalid JSON has none."""
    try:
        stack = [json.loads(script or "")]
    except ValueError:
        return []
    out = []
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(x[::-1])
        elif isinstance(x, dict):
            if "@type" in x:
                out.append(x)
            if "@graph" in x:
                stack.append(x["@graph"])
    return out


def ld_types(node: dict[str, Any]) -> list[str]:
    t = node.get("@type")
    return [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]


def present(value: Any) -> bool:
    """Neither null, blank, nor an empty list or object."""
    if value is None:
        return False
    if isinstance(value, str):
        return bool(value.strip())
    return len(value) > 0 if isinstance(value, (list, dict)) else True


def _items(value: Any) -> list[Any]:
    return value if isinstance(value, list) else [value]


def ld_issues(nodes: list[dict[str, Any]]) -> list[str]:
    """The codes of what the nodes lack, each once, in order."""
    found: list[str] = []
    for node in nodes:
        types = set(ld_types(node))
        lacks = lambda field, code, node=node: [] if present(node.get(field)) else [code]
        if "Product" in types:
            found += lacks("name", "SCHEMA_PRODUCT_MISSING_NAME") + lacks("image", "SCHEMA_PRODUCT_MISSING_IMAGE") + lacks("offers", "SCHEMA_PRODUCT_MISSING_OFFERS")
            offers = [o for o in _items(node.get("offers")) if isinstance(o, dict)] if present(node.get("offers")) else []
            # the first offer that lacks something is the one reported
            lacking = ("PRICE" if not present(o.get("price")) and not present(o.get("lowPrice")) else "" if present(o.get("priceCurrency")) else "CURRENCY" for o in offers)
            found += [f"SCHEMA_PRODUCT_OFFERS_MISSING_{what}" for what in [next(filter(None, lacking), "")] if what]
        if types & {"Article", "BlogPosting", "NewsArticle"}:
            for field, name in (("headline", "HEADLINE"), ("image", "IMAGE"), ("datePublished", "DATE_PUBLISHED"), ("author", "AUTHOR")):
                found += lacks(field, f"SCHEMA_ARTICLE_MISSING_{name}")
        if "FAQPage" in types:
            main = node.get("mainEntity")
            if not isinstance(main, list) or not main:
                found.append("SCHEMA_FAQ_NO_QUESTIONS")
            elif any(not (isinstance(q, dict) and present(q.get("name")) and isinstance(q.get("acceptedAnswer"), dict) and present(q["acceptedAnswer"].get("text"))) for q in main):
                found.append("SCHEMA_FAQ_QUESTION_INCOMPLETE")
        if "BreadcrumbList" in types:
            items = node.get("itemListElement")
            if not isinstance(items, list) or not items:
                found.append("SCHEMA_BREADCRUMB_NO_ITEMS")
            elif any(not (isinstance(i, dict) and all(present(i.get(k)) for k in ("position", "name", "item"))) for i in items):
                found.append("SCHEMA_BREADCRUMB_ITEM_INCOMPLETE")
        if types & {"Organization", "LocalBusiness"}:
            found += lacks("name", "SCHEMA_ORG_MISSING_NAME") + lacks("url", "SCHEMA_ORG_MISSING_URL") + lacks("logo", "SCHEMA_ORG_MISSING_LOGO")
        if "LocalBusiness" in types:
            found += lacks("address", "SCHEMA_LOCALBUSINESS_MISSING_ADDRESS")
            found += ["SCHEMA_LOCALBUSINESS_MISSING_TELEPHONE"] * (not present(node.get("telephone")) and not present(node.get("contactPoint")))
    return list(dict.fromkeys(found))
