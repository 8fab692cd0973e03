"""HTML to a tree, and CSS selectors on it: the part of a page's analysis that no SQL expression can do."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes open elements of the value, up to a boundary.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
    **dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"}),
}
BOUNDARY = frozenset("ul ol dl table select body html".split())
SPACE = re.compile("[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")


def squeeze(text: str | None) -> str:
    return SPACE.sub(" ", text or "").strip()


class Node:
    """An element. Text is kept as plain strings among the children."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order, without recursion."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(node.children[::-1])
        return "".join(out)

    def inner_html(self) -> str:
        return "".join(c if isinstance(c, str) else c.outer_html() for c in self.children)

    def outer_html(self) -> str:
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{self.inner_html()}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("#document", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = CLOSES.get(tag)
        if closes:
            at = self.open
            while at.parent is not None and at.tag not in BOUNDARY - closes:
                if at.tag in closes:
                    self.open = at.parent
                    break
                at = at.parent
        once: dict[str, str] = {}
        for k, v in attrs:
            once.setdefault(k, v or "")
        node = Node(tag, once, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "use", "g", "circle", "rect"):
            self.open = self.open.parent or self.open

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at.parent is not None:
            if at.tag == tag:
                self.open = at.parent
                return
            at = at.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; never raises on malformed input."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# ---------------------------------------------------------------- selectors

_SIMPLE = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*(?P<flag>[iI])?)?\s*\]
    |:(?P<pseudo>first-child|last-child|first-of-type|last-of-type|only-child|empty|nth-child|nth-of-type|not|contains)(?:\((?P<arg>[^)]*)\))?""",
    re.VERBOSE,
)


class SelectorError(ValueError):
    """A selector that isn't understood."""


def _split_top(text: str, seps: str) -> list[tuple[str, str]]:
    """(separator before, part) at the top level, outside brackets, parentheses and quotes."""
    parts, depth, quote, cur, sep = [], 0, "", "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
            cur += ch
        elif ch in "\"'":
            quote = ch
            cur += ch
        elif ch in "[(":
            depth += 1
            cur += ch
        elif ch in "])":
            depth -= 1
            cur += ch
        elif depth == 0 and ch in seps:
            if ch == " " and (not cur.strip() or sep in (">", "+", "~") and not cur.strip()):
                continue
            if cur.strip():
                parts.append((sep, cur.strip()))
                sep = ch
            elif ch != " ":
                sep = ch
            cur = ""
        else:
            cur += ch
    if cur.strip():
        parts.append((sep, cur.strip()))
    return parts


def _compound(text: str) -> list[re.Match]:
    out, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise SelectorError(f"cannot read selector at {text[at:]!r}")
        out.append(m)
        at = m.end()
    return out


def compile_selector(selector: str) -> list[list[tuple[str, list[re.Match]]]]:
    """Alternatives, each a list of (combinator before, compound)."""
    if re.search(r"^\s*[>+~,]|[>+~,]\s*$", selector):
        raise SelectorError(f"selector {selector!r} has nothing on one side of a combinator")
    groups = [[(sep if sep != "," else "", _compound(part)) for sep, part in _split_top(re.sub(r"\s+", " ", alt.strip()), " >+~")] for _, alt in _split_top(selector, ",")]
    if not groups or any(not g for g in groups):
        raise SelectorError("empty selector")
    return groups


def _nth(arg: str, index: int) -> bool:
    arg = arg.replace(" ", "").lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", arg)
    if not m:
        return arg.lstrip("+").isdigit() and int(arg) == index
    a, b = int({"": "1", "+": "1", "-": "-1"}.get(m[1], m[1])), int(m[2] or 0)
    return index == b if a == 0 else (index - b) % a == 0 and (index - b) // a >= 0


def _fits(node: Node, compound: list[re.Match]) -> bool:
    for m in compound:
        if m["tag"]:
            if m["tag"] != "*" and node.tag != m["tag"].lower():
                return False
        elif m["id"]:
            if node.attrs.get("id") != m["id"]:
                return False
        elif m["cls"]:
            if m["cls"] not in node.attrs.get("class", "").split():
                return False
        elif m["attr"]:
            have = node.attrs.get(m["attr"].lower())
            if have is None:
                return False
            if m["op"]:
                want = m["val"].strip("\"'")
                if m["flag"]:
                    have, want = have.lower(), want.lower()
                ok = {
                    "=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"),
                    "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have,
                }[m["op"]]
                if not ok:
                    return False
        elif not _pseudo(node, m["pseudo"], m["arg"] or ""):
            return False
    return True


def _pseudo(node: Node, name: str, arg: str) -> bool:
    peers = node.parent.elements() if node.parent else [node]
    same = [p for p in peers if p.tag == node.tag]
    if name == "not":
        return not any(matches(node, alt) for alt in compile_selector(arg))
    return {
        "first-child": lambda: peers[0] is node, "last-child": lambda: peers[-1] is node, "only-child": lambda: len(peers) == 1,
        "first-of-type": lambda: same[0] is node, "last-of-type": lambda: same[-1] is node, "empty": lambda: not node.children,
        "nth-child": lambda: _nth(arg, peers.index(node) + 1), "nth-of-type": lambda: _nth(arg, same.index(node) + 1), "contains": lambda: arg.strip("\"'") in node.text(),
    }[name]()


def matches(node: Node, steps: list[tuple[str, list[re.Match]]]) -> bool:
    """Whether an element is selected by the steps of one alternative."""
    if not _fits(node, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    how, rest = steps[-1][0], steps[:-1]
    if how == ">":
        return node.parent is not None and node.parent.tag != "#document" and matches(node.parent, rest)
    if how in ("+", "~"):
        peers = node.parent.elements() if node.parent else []
        before = peers[: next(i for i, p in enumerate(peers) if p is node)]
        return bool(before) and (matches(before[-1], rest) if how == "+" else any(matches(p, rest) for p in before))
    up = node.parent
    while up is not None and up.tag != "#document":
        if matches(up, rest):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that a selector list selects, in document order."""
    groups = compile_selector(selector)
    return [n for n in root.walk() if any(matches(n, g) for g in groups)]
