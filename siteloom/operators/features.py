"""Pages from HTML captures: one parse in Python gives a struct of facts; the rest is Catalyst."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions.html import parse, select, squeeze
from siteloom.functions.protocols import ld_issues, ld_nodes, ld_types
from siteloom.functions.text import comparable
from siteloom.functions.url import expected_locale, is_asset, normalize, primary_lang, resolve, url_host

# Anchor texts that say nothing about their target.
GENERIC_ANCHORS = (
    "article", "check it out", "click here", "continue reading", "details", "discover", "download", "explore", "find out more", "go", "here", "learn more", "link", "more", "more info", "more information",
    "open", "page", "read more", "read this", "see details", "see more", "source", "start", "tap here", "this article", "this page", "view all", "view details", "view more", "visit", "website",
)

_RULES_TYPE = pa.map_(pa.string(), pa.list_(pa.string()))
_FACTS = pa.struct(
    [
        ("title", pa.string()), ("title_count", pa.int32()), ("meta_description", pa.string()), ("canonical", pa.string()), ("canonical_raw", pa.string()), ("html_lang", pa.string()),
        ("hreflang", pa.list_(pa.struct([("lang", pa.string()), ("url", pa.string())]))), ("hreflang_invalid", pa.list_(pa.string())), ("robots_meta", pa.string()), ("h1s", pa.list_(pa.string())),
        ("images", pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string()), ("width", pa.string()), ("height", pa.string()), ("loading", pa.string())]))),
        ("open_graph", pa.struct([("title", pa.string()), ("description", pa.string()), ("image", pa.string())])), ("viewport", pa.string()),
        ("anchors", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())]))), ("schema_types", pa.list_(pa.string())), ("schema_codes", pa.list_(pa.string())), ("body_text", pa.string()), ("extracted", _RULES_TYPE),
    ]
)
_HREFLANG = re.compile(r"^(?:x-default|[a-z]{2,3}(?:-[a-z0-9]{2,8})*)$", re.IGNORECASE)


def parse_rule(text: str) -> dict[str, Any]:
    """A rule's grammar: ``selector``, ``selector@attribute`` or ``selector#html``."""
    if text.endswith("#html"):
        return {"selector": text[:-5].strip(), "attr": None, "html": True}
    at = text.rfind("@")
    if at > text.rfind("]"):
        return {"selector": text[:at].strip(), "attr": text[at + 1 :].strip(), "html": False}
    return {"selector": text.strip(), "attr": None, "html": False}


def extraction_rules(rules: dict[str, Any] | None) -> dict[str, dict[str, Any]]:
    """Named rules with defaults: a string, or an object with selector, attr, html, all, required."""
    out = {}
    for name, rule in (rules or {}).items():
        spec = parse_rule(rule) if isinstance(rule, str) else parse_rule(rule["selector"]) | {k: v for k, v in rule.items() if k != "selector"}
        if not spec["selector"]:
            raise ValueError(f"rule {name!r} has no selector")
        out[name] = {"all": False, "required": False} | spec
    return out


def facts(html: str | None, url: str, rules: dict[str, dict[str, Any]] | None = None) -> dict[str, Any]:
    """What a page's HTML says, for one page."""
    root = parse(html)
    by: dict[str, list] = {}
    for node in root.walk():
        by.setdefault(node.tag, []).append(node)
    metas: dict[str, str] = {}
    for m in by.get("meta", []):
        name = (m.attrs.get("name") or m.attrs.get("property") or "").lower()
        metas.setdefault(name, m.attrs.get("content", ""))
    links = by.get("link", [])
    rel = lambda n, word: word in n.attrs.get("rel", "").lower().split()
    canonical = next((x.attrs.get("href", "") for x in links if rel(x, "canonical")), None)
    hreflang, invalid = [], []
    for x in links:
        if rel(x, "alternate") and "hreflang" in x.attrs:
            lang, href = x.attrs["hreflang"].strip().replace("_", "-").lower(), resolve(url, x.attrs.get("href", "")) if x.attrs.get("href") else None
            if _HREFLANG.match(lang) and href:
                hreflang.append({"lang": lang, "url": href})
            else:
                invalid.append(x.attrs["hreflang"])
    anchors = []
    for a in by.get("a", []):
        target = resolve(url, a.attrs["href"]) if a.attrs.get("href", "").strip() else None
        if target:
            alt = next((n.attrs.get("alt", "") for n in a.walk() if n.tag == "img" and n.attrs.get("alt", "").strip()), "")
            anchors.append({"url": target, "text": next((t for t in map(squeeze, (a.text(), a.attrs.get("aria-label"), alt, a.attrs.get("title"))) if t), "")})
    nodes = [n for s in by.get("script", []) if s.attrs.get("type", "").split(";")[0].strip().lower() == "application/ld+json" for n in ld_nodes(s.text())]
    titles = by.get("title", [])
    value = lambda key: squeeze(metas.get(key)) or None
    extracted = {}
    for name, rule in (rules or {}).items():
        read = lambda n, rule=rule: n.attrs.get(rule["attr"], "") if rule["attr"] else n.inner_html().strip() if rule["html"] else squeeze(n.text())
        found = [v for v in map(read, select(root, rule["selector"])) if v]
        extracted[name] = found if rule["all"] else found[:1]
    return {
        "title": (squeeze(titles[0].text()) or None) if titles else None, "title_count": len(titles), "meta_description": value("description"),
        "canonical": (resolve(url, canonical) or canonical.strip()) if canonical and canonical.strip() else None, "canonical_raw": canonical, "html_lang": (by["html"][0].attrs.get("lang", "").strip() or None) if by.get("html") else None,
        "hreflang": hreflang, "hreflang_invalid": invalid, "robots_meta": value("robots"), "h1s": [t for t in (squeeze(n.text()) for n in by.get("h1", [])) if t],
        "images": [{k: i.attrs.get(k) for k in ("src", "alt", "width", "height", "loading")} for i in by.get("img", [])],
        "open_graph": {k: value(f"og:{k}") for k in ("title", "description", "image")}, "viewport": metas.get("viewport"), "anchors": anchors,
        "schema_types": list(dict.fromkeys(t for n in nodes for t in ld_types(n))), "schema_codes": ld_issues(nodes), "body_text": squeeze(by["body"][0].text() if by.get("body") else root.text()), "extracted": list(extracted.items()),
    }


def parsed_pages(fetches: DataFrame, rules: dict[str, Any] | None = None) -> DataFrame:
    """``fetches`` without ``html`` and with the struct ``facts``. Pages are parsed where they are read, in Arrow batches."""
    specs = extraction_rules(rules)
    keep = [c for c in fetches.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [facts(h, u or "", specs) for h, u in zip(batch.column("html").to_pylist(), batch.column("final_url").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, _FACTS)], names=[*keep, "facts"])

    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    schema = StructType([*[f for f in fetches.schema if f.name != "html"], StructField("facts", from_arrow_type(_FACTS))])
    return fetches.select(*keep, "html").mapInArrow(run, schema)


def page_features(fetches: DataFrame, rules: dict[str, Any] | None = None, hosts: list[str] | None = None) -> DataFrame:
    """Audit columns of every fetched HTML page.

    Input: ``url, final_url, status, content_type, headers, redirect_chain, html, crawl_order``. A link is
    internal if its host is the page's own, or one of ``hosts``, the hosts of the crawl. Asset
    links are skipped. Null HTML gives a page without facts.
    """
    f = lambda name: F.col(f"facts.{name}")
    p = parsed_pages(fetches, rules)
    own = url_host(F.col("final_url"))
    inside = lambda a: (url_host(a["url"]) == own) | url_host(a["url"]).isin(*(hosts or [""]))
    internal = F.filter(f("anchors"), lambda a: ~is_asset(a["url"]) & inside(a))
    external = F.filter(f("anchors"), lambda a: ~is_asset(a["url"]) & ~inside(a))
    no_alt = F.filter(f("images"), lambda i: F.coalesce(F.trim(i["alt"]), F.lit("")) == "")
    generic = F.filter(internal, lambda a: comparable(a["text"]).isin(*GENERIC_ANCHORS))
    return p.select(
        "url", "final_url", "status", "content_type", "headers", "redirect_chain", "crawl_order",
        *[f(n).alias(n) for n in ("title", "title_count", "meta_description", "canonical", "html_lang", "hreflang", "hreflang_invalid", "robots_meta", "h1s", "open_graph", "viewport", "schema_types", "schema_codes", "body_text", "images", "extracted")],
        F.coalesce(F.length(f("title")), F.lit(0)).alias("title_length"), F.coalesce(F.length(f("meta_description")), F.lit(0)).alias("meta_description_length"),
        expected_locale(F.col("final_url")).alias("expected_locale"), F.when(f("body_text") == "", 0).otherwise(F.size(F.split(f("body_text"), " "))).alias("word_count"),
        F.size(f("images")).alias("images_total"), F.size(no_alt).alias("images_missing_alt"), F.size(internal).alias("internal_links"), F.size(external).alias("external_links"),
        F.size(F.filter(internal, lambda a: a["text"] == "")).alias("anchors_empty"), F.size(generic).alias("anchors_generic"), F.array_distinct(F.transform(internal, lambda a: a["url"])).alias("discovered_links"),
    )


def extraction_summary(features: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Per rule: ``field, required, pages_matched, pages_missing``."""
    specs = extraction_rules(rules)
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(bool(s["required"])).alias("required")) for n, s in specs.items()]))
    rows = features.select("final_url", "extracted", named.alias("r"))
    hit = F.size(F.coalesce(F.element_at("extracted", F.col("r.field")), F.array().cast("array<string>"))) > 0
    return rows.groupBy("r.field", "r.required").agg(F.count_if(hit).alias("pages_matched"), F.count_if(~hit).alias("pages_missing")).withColumnsRenamed({"r.field": "field", "r.required": "required"})


__all__ = ["GENERIC_ANCHORS", "extraction_rules", "extraction_summary", "facts", "normalize", "page_features", "parse_rule", "parsed_pages", "primary_lang"]
