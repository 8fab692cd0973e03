"""Layouts of log lines, found by a fixed-depth template tree.

A line's head is cut into tokens whose variable parts are masked (``<ts>``, ``<ip>``, ``<num>``,
``<lvl>``, ``<word>``, ``<str>``, ``<key>``); spaces are no tokens, a token only remembers whether
one stands before it. The head ends where free text begins: at three words in a row, or at two
that aren't followed by a bracket or colon. The tree routes a head by its number of tokens, then by
its leading tokens, to a leaf. A leaf holds templates; a head similar enough to one is merged into
it, and positions that differ become ``<*>``. A template's positions are mapped to fields once
(``template_plan``) from the tokens that all its heads have there, and every line is read by the
positions of its template. No layout is listed; JSON and key=value lines name their fields themselves.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

#: Tokens of a head at most; free text begins long before in any common layout.
HEAD_TOKENS = 24
#: Leading tokens that route a head below its token count.
TREE_DEPTH = 4
#: Share of equal positions from which two heads share a template.
SIMILAR = 0.7

LEVELS = {
    "trace": "DEBUG", "debug": "DEBUG", "dbg": "DEBUG", "d": "DEBUG", "verbose": "DEBUG",
    "info": "INFO", "information": "INFO", "notice": "INFO", "i": "INFO", "n": "INFO",
    "warn": "WARN", "warning": "WARN", "w": "WARN",
    "error": "ERROR", "err": "ERROR", "e": "ERROR", "severe": "ERROR",
    "fatal": "FATAL", "critical": "FATAL", "crit": "FATAL", "alert": "FATAL", "emerg": "FATAL", "emergency": "FATAL", "panic": "FATAL", "f": "FATAL", "c": "FATAL",
}
NUMBER_LEVELS = {10: "DEBUG", 20: "DEBUG", 30: "INFO", 40: "WARN", 50: "ERROR", 60: "FATAL"}
SEVERITIES = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")

_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
_ZONE = r"(?:\ ?(?:[+-]\d{2}:?\d{2}|[+-]\d{2})(?![\d:])|\ ?(?:Z|UTC|GMT|[A-Z]{1,3}[SD]T)\b)?"
STAMP = "|".join(
    (
        rf"\d{{4}}[-/.]\d{{2}}[-/.]\d{{2}}[Tt ]{_CLOCK}(?:[zZ]\b|{_ZONE})",
        r"\d{8}T\d{6}(?:[.,]\d+)?Z?",
        rf"\d{{1,2}}/{_MON}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?{_ZONE}",
        rf"(?:{_DAY},?\ )?\d{{1,2}}[ -]{_MON}[ -]\d{{4}},?\ {_CLOCK}{_ZONE}",
        rf"{_DAY},?\ {_MON}\ {{1,2}}\d{{1,2}}\ {_CLOCK}(?:\ [A-Z]{{3,4}})?\ \d{{4}}",
        rf"(?:{_DAY},?\ )?{_MON}\ {{1,2}}\d{{1,2}},?\ \d{{4}},?\ {_CLOCK}(?:\ ?[AaPp][Mm])?{_ZONE}",
        rf"(?:{_DAY},?\ )?{_MON}\ {{1,2}}\d{{1,2}}\ {_CLOCK}",
        rf"\d{{1,2}}[./-]\d{{1,2}}[./-](?:\d{{4}}|\d{{2}}),?[T ]{_CLOCK}(?:\ ?[AaPp][Mm])?{_ZONE}",
    )
)
_STAMP_ALL = re.compile(rf"(?:{STAMP}|\d{{9,11}}(?:\.\d+)?|\d{{13}}|\d{{16}}|\d{{19}})$")
_TOKEN = re.compile(
    rf"""(?P<pri>^<\d{{1,3}}>)(?P<ver>1\ )?
    |(?P<glog>^[A-Z]\d{{4}}\ \d\d:\d\d:\d\d\.\d+)
    |(?P<ts>{STAMP})
    |(?P<epoch>^\d{{10}}\.\d+(?![\w.])|^(?:\d{{19}}|\d{{16}}|\d{{13}}|\d{{10}})(?![\w.]))
    |(?P<ip>\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![\w.])|[0-9a-fA-F]{{0,4}}(?::[0-9a-fA-F]{{0,4}}){{2,7}}(?![\w:]))
    |(?P<key>[A-Za-z_@][\w.@-]*=)
    |(?P<str>"(?:[^"\\]|\\.)*")
    |(?P<num>\d+(?![\w/.:-]))
    |(?P<word>[\w/@%$][\w./@%$-]*)
    |(?P<gap>\ +)
    |(?P<mark>.)""",
    re.VERBOSE | re.DOTALL,
)


Token = tuple[str, int, int]  # mask, start, end
_WORDS = ("<word>", "<word.lvl>")
_OPEN, _CLOSE = ("[", "(", "{", "<"), ("]", ")", "}", ">")
#: Signs that part cells where one follows a leading stamp at once.
_CELL_SIGNS = "|;\t"
_PATH = re.compile(r"^(?:/|[a-z][a-z0-9+.-]*://)")


def head_tokens(line: str, most: int = HEAD_TOKENS) -> list[Token]:
    """(mask, start, end) of the tokens of a line's head. A mask begins with a space where one stands before the token."""
    out: list[Token] = []
    gap, run = "", 0
    for m in _TOKEN.finditer(line):
        kind = m.lastgroup
        if kind == "gap":
            gap = " "
            continue
        if kind == "ver":
            out += [("<pri>", m.start(), m.end("pri")), ("1", m.start("ver"), m.end("ver") - 1)]
            gap = " "
            continue
        text = m.group()
        if kind == "mark":
            mask = text
        elif kind == "word":
            tail = text.rpartition(".")[2].lower()
            if text.lower() in LEVELS and (len(text) > 1 or text.isupper()):
                mask = "<lvl>"
            elif "." in text and tail in LEVELS and len(tail) > 1:
                mask = "<word.lvl>"
            else:
                mask = "-" if text == "-" else "<word>"
        else:
            mask = "<ts>" if kind == "epoch" else f"<{kind}>"
        if mask in _WORDS:
            run += 1
        else:
            if run == 2 and mask not in ("[", ":") and out[0][0] != "<pri>":
                return out[:-2]
            run = 0
        if not out and mask == "<ts>" and line[m.end() : m.end() + 1] in _CELL_SIGNS and m.end() < len(line):
            return cell_tokens(line, line[m.end()])
        out.append((gap + mask, m.start(), m.end()))
        if run == 3:
            return out[:-3]
        gap = ""
        if len(out) >= most or (len(out) == 1 and mask in ("{", "<key>")):
            break
    return out[:-2] if run == 2 and out[0][0] != "<pri>" else out


def cell_tokens(line: str, sign: str) -> list[Token]:
    """The cells of a line up to the first with free text, after a token that names their sign."""
    out: list[Token] = [(f"cells{sign}", 0, 0)]
    at = 0
    for cell in line.split(sign):
        text = cell.strip()
        if text in ("", "-"):
            mask = "-"
        elif text.lower() in LEVELS:
            mask = "<lvl>"
        elif text.isdigit():
            mask = "<ts>" if len(out) == 1 else "<num>"
        elif _STAMP_ALL.match(text):
            mask = "<ts>"
        elif _PATH.match(text):
            mask = "<path>"
        elif " " not in text:
            mask = "<word>"
        else:
            break
        out.append((mask, at, at + len(cell)))
        at += len(cell) + 1
        if len(out) >= HEAD_TOKENS:
            break
    return out


class TemplateTree:
    """Fixed-depth tree of templates: token count, then ``depth`` leading tokens, then a leaf."""

    def __init__(self, depth: int = TREE_DEPTH, similar: float = SIMILAR) -> None:
        self.depth, self.similar = depth, similar
        self.leaves: dict[tuple, list[list]] = {}

    def route(self, masks: tuple[str, ...]) -> tuple:
        return (len(masks), *masks[: self.depth])

    def add(self, masks: tuple[str, ...], n: int = 1, example: str = "") -> list:
        """Merge a masked head into the most similar template of its leaf, or start one."""
        leaf = self.leaves.setdefault(self.route(masks), [])
        best, at = -1.0, None
        for template in leaf:
            same = sum(a == b or a == "<*>" for a, b in zip(template[0], masks)) / len(masks) if masks else 1.0
            if same > best:
                best, at = same, template
        if at is None or best < self.similar:
            leaf.append([list(masks), n, example])
            return leaf[-1]
        at[0] = [a if a == b else "<*>" for a, b in zip(at[0], masks)]
        at[1] += n
        at[2] = min(x for x in (at[2], example) if x) if at[2] or example else ""
        return at

    def templates(self) -> Iterable[tuple[list[str], int, str]]:
        for leaf in self.leaves.values():
            for masks, n, example in leaf:
                yield masks, n, example


Fields = tuple[str, str, str, str, int, str]  # stamp, level, component, url, status, user agent

_REQUEST = re.compile(r"^([A-Z]+) (.*?)(?: (?:HTTP/[\d.]+))?$", re.DOTALL)
_PAIR = re.compile(r'([A-Za-z_@][\w.@-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)')
_TAIL = re.compile(r'(?:^|\s)url=("(?:[^"\\]|\\.)*"|.*?)(?=\s+[A-Za-z_]+=|\s*$)')
_TAIL_STATUS = re.compile(r'(?:^|\s)status="?(\d{3})"?(?!\S)')
_TAIL_AGENT = re.compile(r'(?:^|\s)(?:ua|user_agent|userAgent|agent)=("(?:[^"\\]|\\.)*"|\S+)')

STAMP_KEYS = ("timestamp", "@timestamp", "time", "ts", "EdgeStartTimestamp", "date", "datetime")
LEVEL_KEYS = ("level", "severity", "lvl", "log_level", "loglevel")
COMPONENT_KEYS = ("component", "logger", "name", "app", "tag", "source", "module")
URL_KEYS = ("url", "ClientRequestURI", "uri", "path", "request_url")
STATUS_KEYS = ("status", "EdgeResponseStatus", "status_code", "statusCode")
AGENT_KEYS = ("userAgent", "user_agent", "ClientRequestUserAgent", "ua", "agent")


def level_of(value: object) -> str:
    """One of DEBUG, INFO, WARN, ERROR, FATAL; '' if the value names none."""
    if value is None:
        return ""
    text = str(value).strip().strip('"')
    if text.isdigit():
        return NUMBER_LEVELS.get(int(text), "")
    return LEVELS.get(text.lower(), "")


def _text(value: object) -> str:
    return "" if value is None or value == "-" else str(value)


def _status(value: object) -> int:
    try:
        return int(str(value).strip().strip('"'))
    except ValueError:
        return -1


def _unquote(value: str) -> str:
    if len(value) > 1 and value[0] == value[-1] == '"':
        return re.sub(r"\\(.)", r"\1", value[1:-1])
    return value


def _first(keys: tuple[str, ...], *maps: dict) -> object:
    for m in maps:
        for k in keys:
            if k in m and not isinstance(m[k], (dict, list)):
                return m[k]
    return None


def _json_fields(line: str) -> Fields | None:
    try:
        o = json.loads(line)
    except ValueError:
        return None
    if not isinstance(o, dict):
        return None
    inner = [v for v in o.values() if isinstance(v, dict)]
    stamp = _first(STAMP_KEYS, o)
    level = _first(LEVEL_KEYS, o)
    if stamp is None and level is None:
        return None
    return (
        "" if stamp is None else str(stamp), level_of(level), _text(_first(COMPONENT_KEYS, o)),
        _text(_first(URL_KEYS, o, *inner)), _status(_first(STATUS_KEYS, o, *inner)), _text(_first(AGENT_KEYS, o, *inner)),
    )


def _unescape(value: str) -> str:
    return re.sub(r'\\(["\\])', r"\1", value)


def _tail(message: str) -> tuple[str, int, str]:
    """url, status and user agent that a message names by key."""
    if "=" not in message:
        return "", -1, ""
    url, status, agent = _TAIL.search(message), _TAIL_STATUS.search(message), _TAIL_AGENT.search(message)
    return _text(_unquote(url[1])) if url else "", int(status[1]) if status else -1, _text(_unquote(agent[1])) if agent else ""


def _pair_fields(line: str) -> Fields | None:
    pairs: dict[str, str] = {}
    for k, v in _PAIR.findall(line):
        pairs.setdefault(k, _unquote(v))
    stamp = _first(STAMP_KEYS, pairs)
    if stamp is None or not _STAMP_ALL.match(str(stamp)):
        return None
    url = _TAIL.search(line)
    return str(stamp), level_of(_first(LEVEL_KEYS, pairs)), _text(_first(COMPONENT_KEYS, pairs)), _text(_unquote(url[1])) if url else "", _status(_first(STATUS_KEYS, pairs)), _text(_first(AGENT_KEYS, pairs))


#: Masks of tokens that may stand before a leading stamp. Words aren't among them: text that goes on may hold a stamp.
_BEFORE = frozenset({"[", "(", "{", "<", "|", "-", "*", "#", "<lvl>", "<num>", "<pri>", "1"})


def stamp_at(masks: tuple[str, ...]) -> int | None:
    """The index of the stamp that makes a head the start of an entry, None if it has none: among the leading tokens
    behind nothing but signs, numbers and levels; or, in brackets before a quoted request, behind a client's address and user."""
    kinds = [m.lstrip() for m in masks[:9]]
    if kinds[:1] and kinds[0].startswith("cells"):
        return 1
    for i, kind in enumerate(kinds[:TREE_DEPTH]):
        if kind in ("<ts>", "<glog>"):
            return i if i + 1 < len(masks) else None
        if kind not in _BEFORE:
            break
    for i in range(3, len(kinds) - 2):
        if kinds[i] in ("<ts>",) and kinds[i - 1] == "[" and kinds[i + 1 : i + 3] == ["]", "<str>"] and kinds[0] in ("<ip>", "-", "<word>"):
            return i
    return None


def template_plan(heads: list[tuple[tuple[str, ...], int]]) -> dict[str, int] | None:
    """The positions of the fields in a template, from the masked heads merged into it and their numbers.

    Keys: s stamp, g stamp with a level's letter before it, l level, cl component and level in one word, c
    component, p priority, r quoted request, t status, a user agent, u url, e end of the head. A position
    belongs to a field where most heads have such a token. The level stands at most two words behind the
    stamp. Where a host may be named, behind a priority or before a tag with a process number, the component is the
    word after the host; else it is what stands beside the level in its brackets, then what is set off
    behind the level by brackets, a dash or colon, then what is set off anywhere so.
    """
    first = [m.lstrip() for m in heads[0][0]]
    if first[:1] in (["{"], ["<key>"]):
        return {"json" if first[0] == "{" else "pairs": 0}
    stamp = stamp_at(heads[0][0])
    if stamp is None:
        return None
    total, n = sum(k for _, k in heads), len(first)
    kinds = [[(masks[i].lstrip(), masks[i][:1] == " ", k) for masks, k in heads] for i in range(n)]
    most = lambda i, wanted, glued=None: 0 <= i < n and 2 * sum(k for kind, gap, k in kinds[i] if kind in wanted and (glued is None or gap != glued)) > total
    if first[0].startswith("cells"):
        plan = {"s": 1, "cells": 0}
        free = [i for i in range(2, n)]
        level = next((i for i in free if most(i, ("<lvl>",))), 2 if most(2, ("<num>", "<word>")) else None)
        if level is not None:
            plan["l"] = level
        component = next((i for i in free if i > (level or 1) and most(i, (*_WORDS, "<lvl>"))), None)
        if component is not None:
            plan["c"] = component
        url = next((i for i in free if any(kind == "<path>" for kind, _, _ in kinds[i])), None)
        if url is not None:
            plan["u"] = url
            if url + 1 < n:
                plan["t"] = url + 1
        plan["e"] = max(i for i in plan.values()) + 1
        return plan
    if first[stamp + 1 : stamp + 3] == ["]", "<str>"] and stamp >= 3:
        plan = {"s": stamp, "r": stamp + 2, "t": stamp + 3}
        if not most(stamp + 3, ("<num>", "-")) or not most(stamp + 4, ("<num>", "-")):
            return None
        if most(stamp + 5, ("<str>",)) and most(stamp + 6, ("<str>",)):
            plan["a"] = stamp + 6
        return plan
    plan = {"g" if first[stamp] == "<glog>" else "s": stamp}
    if first[0] == "<pri>":
        plan["p"] = 0
    behind = stamp + 1 + (stamp > 0 and most(stamp - 1, _OPEN) and most(stamp + 1, _CLOSE))
    some = (*_WORDS, "<lvl>")
    # level: a number at once behind the stamp, before a bracketed word, or a level's name
    if most(behind, ("<num>",)) and most(behind + 1, _OPEN) and most(behind + 2, some) and most(behind + 3, _CLOSE):
        plan["l"] = behind
    words = 0
    for i in range(n):
        if "g" in plan or "p" in plan or "l" in plan or words > 2:
            break
        if i > stamp and most(i - 3, _WORDS) and most(i - 2, ("[",), True) and most(i - 1, ("<num>",)) and most(i, ("]",)):
            break  # behind a tag with a process number stands the message
        if i == behind and most(i, ("<word.lvl>",)) and most(i + 1, (":",), True):
            plan |= {"cl": i}
            break
        if i != stamp and most(i, ("<lvl>",)):
            plan["l"] = i
        elif i > stamp:
            words += most(i, _WORDS)
    if not {"g", "p", "l", "cl"} & plan.keys() and most(behind, ("<num>",)) and (most(behind + 1, ("[", *_WORDS, "-", ":"))):
        plan["l"] = behind
    level = plan.get("l", -1)
    # component
    set_off = lambda i, kinds=_WORDS: most(i, kinds) and (
        (most(i - 1, _OPEN) and most(i + 1, _CLOSE))
        or most(i + 1, (":",), True)
        or (most(i + 1, ("-", "|"), False) and i + 2 < n + 1)
        or (most(i + 1, ("[",), True) and most(i + 2, ("<num>",)) and most(i + 3, ("]",)))
    )
    if "cl" in plan:
        pass
    elif "p" in plan:
        if most(behind + 1, some):
            plan["c"] = behind + 1
    elif level >= 0 and most(level - 1, (":",)) and most(level - 2, _WORDS) and level - 2 > stamp:
        plan["c"] = level - 2
    elif most(behind, _WORDS) and most(behind + 1, _WORDS) and set_off(behind + 1):
        plan["c"] = behind + 1
    elif level > stamp and ((most(level + 1, _OPEN) and set_off(level + 2, some)) or (most(level + 1, (*_CLOSE, "-", ":", "|")) and set_off(level + 2)) or set_off(level + 1)):
        plan["c"] = level + 1 if most(level + 1, _WORDS) else level + 2
    elif level > stamp and most(level + 1, _CLOSE) and most(level + 2, _OPEN) and set_off(level + 3, some):
        plan["c"] = level + 3
    else:
        seen = 0
        for i in range(stamp + 1, n):
            seen += most(i, _WORDS)
            if i != level and seen <= 3 and set_off(i):
                plan["c"] = i
                break
    plan["e"] = max(plan.values()) + 1
    return plan


def mined_plans(heads: Iterable[tuple[tuple[str, ...], int]]) -> dict[tuple[str, ...], dict[str, int]]:
    """The plan of each head that starts an entry, from the template the tree merged it into; the order of heads doesn't matter."""
    tree, merged = TemplateTree(), {}
    for masks, n in sorted(heads, key=lambda h: (-h[1], h[0])):
        merged.setdefault(id(tree.add(masks, n)), []).append((masks, n))
    out = {}
    for members in merged.values():
        if plan := template_plan(members):
            out |= dict.fromkeys((masks for masks, _ in members), plan)
    return out


class LineParser:
    """Lines to fields by the positions of their templates: those of ``mined``, or, for a head that wasn't mined, of itself alone."""

    def __init__(self, mined: dict[tuple[str, ...], dict[str, int]] | None = None) -> None:
        self.plans: dict[tuple[str, ...], dict[str, int] | None] = dict(mined or {})

    def fields(self, line: str) -> Fields | None:
        """The fields of an entry's first line, None for any other line."""
        line = line.rstrip("\r\n")
        tokens = head_tokens(line)
        masks = tuple([t[0] for t in tokens])
        if masks in self.plans:
            plan = self.plans[masks]
        else:
            plan = template_plan([(masks, 1)])
            if len(self.plans) < 50_000:
                self.plans[masks] = plan
        if plan is None:
            return None
        if "json" in plan:
            return ("", "", "", "", -1, "") if line.strip() == "{" else _json_fields(line)
        if "pairs" in plan:
            return _pair_fields(line)
        at: Callable[[str], str] = lambda k: line[tokens[plan[k]][1] : tokens[plan[k]][2]].strip() if k in plan else ""
        if "r" in plan:
            request = at("r")[1:-1]
            m = _REQUEST.match(request)
            return at("s"), "", "", _text(_unescape(m[2] if m else request)), _status(at("t")), _text(_unescape(at("a")[1:-1]))
        level, component, stamp = level_of(at("l")), _text(at("c")), at("s")
        if "cl" in plan:
            component, _, name = at("cl").rpartition(".")
            level = level_of(name)
        if "p" in plan:
            level = SEVERITIES[int(at("p").strip("<>")) % 8]
        if "g" in plan:
            level, stamp = level_of(at("g")[0]), at("g")[1:]
        if not level and re.fullmatch(r"[\d.]+", stamp):
            return None  # a number alone is no stamp
        url, status, agent = _tail(line[tokens[plan["e"]][1] if plan["e"] < len(tokens) else tokens[-1][2] :])
        if "cells" in plan:
            url, status = _text(at("u")), _status(at("t"))
        return stamp, level, component, url, status, agent


BANNER = re.compile(r"^\s*(?:([-=*#~_])\1{2,}.*\1{2,}|[-=*#~_]{3,})\s*$")
_MEMBER = re.compile(r'^\s+"([^"\\]+)"\s*:\s*(.*?)\s*,?\s*$')


def member(line: str) -> tuple[str, str] | None:
    """Name and value of a scalar member on a line of pretty-printed JSON."""
    m = _MEMBER.match(line)
    if not m or m[2][:1] in ("{", "[") or not m[2]:
        return None
    try:
        value = json.loads(m[2])
    except ValueError:
        return None
    return m[1], "" if value is None else str(value)
