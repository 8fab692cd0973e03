"""Reports as JSON, text and HTML, from the small frames of a report."""

from __future__ import annotations

import html
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.logs import LogReport
from siteloom.plans.audit import SiteReport

#: Rows of a table and values of a cell that a page or text shows. JSON has every row.
ROWS, URLS = 20, 50


def _rows(df: DataFrame, most: int | None = ROWS) -> list[dict[str, Any]]:
    """Rows of a frame, all of them (one partition at a time) if ``most`` is None."""
    return [r.asDict(recursive=True) for r in (df.toLocalIterator() if most is None else df.limit(most).collect())]


def _bare(value: Any) -> Any:
    """Without absent members, dates as text."""
    if isinstance(value, dict):
        return {k: _bare(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_bare(v) for v in value]
    return value if isinstance(value, (str, int, float, bool)) else str(value)


def report_dict(report: SiteReport, most: int | None = ROWS) -> dict[str, Any]:
    return {"summary": _bare((_rows(report.summary, 1) or [{}])[0]), **{name: _bare(_rows(df, most)) for name, df in report.parts.items()}}


def to_json(report: SiteReport, most: int | None = None) -> str:
    """The whole report with every row of every part, pages and issues included. For reports that don't fit the driver use ``write_json``."""
    whole = report_dict(report, most) | {"pages": _bare(_rows(report.pages, most)), "issues": _bare(_rows(report.issues, most))}
    return json.dumps(whole, indent=2, ensure_ascii=False)


def write_json(report: SiteReport, path: str) -> None:
    """Every part as JSON lines in a folder of its own below ``path``, written by the executors."""
    for name, df in {"summary": report.summary, "pages": report.pages, "issues": report.issues, **report.parts}.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def _lines(parts: dict[str, Any]) -> str:
    out = []
    for name, part in parts.items():
        out.append(name.replace("_", " ").upper())
        out += [f"  {k}: {v}" for k, v in part.items()] if isinstance(part, dict) else ["  " + ", ".join(f"{k}={v}" for k, v in row.items()) for row in part] or ["  none"]
    return "\n".join(out)


def to_text(report: SiteReport, most: int = ROWS) -> str:
    """Sections of ``name: value`` lines."""
    return _lines(report_dict(report, most))


def _cell(value: Any) -> str:
    if isinstance(value, list):
        more = f" +{len(value) - URLS} more" if len(value) > URLS else ""
        value = ", ".join(map(str, value[:URLS])) + more
    return html.escape(str(value))


def _table(part: Any) -> str:
    if isinstance(part, dict):
        return "<table>" + "".join(f"<tr><th>{_cell(k)}</th><td>{_cell(v)}</td></tr>" for k, v in part.items()) + "</table>"
    if not part:
        return "<p>none</p>"
    heads = list(dict.fromkeys(k for row in part for k in row))
    lines = "".join("<tr>" + "".join(f"<td>{_cell(row.get(h, ''))}</td>" for h in heads) + "</tr>" for row in part)
    return "<table><tr>" + "".join(f"<th>{_cell(h)}</th>" for h in heads) + f"</tr>{lines}</table>"


def _page(title: str, sections: dict[str, Any]) -> str:
    name = lambda k: html.escape(k.replace("_", " ").capitalize())
    links = "".join(f"<li><a href='#{html.escape(k)}'>{name(k)}</a></li>" for k in sections)
    body = "".join(f"<h2 id='{html.escape(k)}'>{name(k)}</h2>{_table(v)}" for k, v in sections.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{links}</ul>{body}</body></html>"


def catalog_rows(report: SiteReport, most: int = ROWS, urls: int = URLS) -> list[dict[str, Any]]:
    """The issue catalog as it is shown: per code its severity, counts and the first URLs, of which ``urls`` at most are read."""
    if "issue_catalog" not in report.parts:
        return []
    shown = _rows(report.parts["issue_catalog"], most)
    pages = report.parts["issue_urls"]
    for row in shown:
        first = [r["final_url"] for r in pages.where(F.col("code") == row["code"]).orderBy("final_url").limit(urls).collect()]
        row["urls"] = first + [f"+{row['n_urls'] - len(first)} more"] * (row["n_urls"] > len(first))
        row.pop("message", None)
    return shown


def to_html(report: SiteReport, title: str = "Site audit", most: int = ROWS) -> str:
    """One page with a list of contents, the issue catalog and a table per section; all values are escaped."""
    parts = report_dict(report, most)
    parts.pop("issue_urls", None)
    return _page(title, {"summary": parts.pop("summary"), "issue_catalog": catalog_rows(report, most), **{k: v for k, v in parts.items() if k != "issue_catalog"}})


def log_dict(report: LogReport, most: int | None = ROWS) -> dict[str, Any]:
    """All parts of a log analysis: counters and window as one table each, then bots, URLs, findings and issues."""
    one = lambda df: _bare((_rows(df, 1) or [{}])[0])
    out: dict[str, Any] = {"summary": {"layout": report.layout, **one(report.counters), **(one(report.verdicts) if report.verdicts is not None else {}), **one(report.window)}}
    for name, df in (("bots", report.bots), ("urls", report.urls.orderBy(F.desc("hits"), "url")), ("orphans", report.orphans), ("stale", report.stale), ("mismatches", report.mismatches)):
        if df is not None:
            out[name] = _bare(_rows(df, most))
    return out | {"issues": [{"code": c, "severity": s} for c, s in report.issues]}


def log_json(report: LogReport) -> str:
    """The whole log analysis, every row."""
    return json.dumps(log_dict(report, None), indent=2, ensure_ascii=False)


def log_text(report: LogReport, most: int = ROWS) -> str:
    return _lines(log_dict(report, most))


def log_html(report: LogReport, title: str = "Log analysis", most: int = ROWS) -> str:
    return _page(title, log_dict(report, most))


def diff_text(parts: dict[str, Any], most: int = ROWS) -> str:
    """The differences of two crawls as text."""
    out = []
    for name, part in parts.items():
        out.append(name.replace("_", " ").upper())
        out += [f"  {k}: {v:+d}" for k, v in part.items()] if isinstance(part, dict) else ["  " + ", ".join(f"{k}={v}" for k, v in row.items()) for row in _rows(part, most)] or ["  none"]
    return "\n".join(out)
