"""Main content and boilerplate among the lines of a page.

Two passes. The first decides a line by itself, from its length, its density of stop words and
its link density. A page's text has lost its links, so link density comes from the site: a line
that the site repeats on many of its pages is navigation or a notice (``llm.pages.site_lines``
counts them), and so is a line that is cut into three or more labels without stop words. Long
prose, rows of cells and groups of items with stop words are content. Lines with the form of a
byline, date, tag line, breadcrumb, pointer or copyright notice are boilerplate by that form.

The second pass decides what is left, short lines and single sentences, from the nearest decided
lines above and below, whatever the length of the run: where both agree, their label; a page's
edge counts as boilerplate; where they differ, a sentence and a line above content are
content, a line below content only if it is nearer to it and has five or more words. Bylines, dates and tags decide
no neighbour. Lines below the head of a teaser box, up to a blank line, are boilerplate.

All rules hold for lines of any length.
"""

from __future__ import annotations

import re
from collections.abc import Set
from functools import lru_cache
from zlib import crc32

#: Final labels, then the undecided ones of the first pass.
BAD, GOOD, NEAR, SHORT, META, BOX, SAID, LABEL, ROW, LINKS = range(10)
#: Least stop-word density of prose; characters from which prose is content by itself; and from which a block is.
PROSE_DENSITY, LONG, BLOCK = 0.15, 130, 70

#: Common words of each language; their density tells prose from lists of names.
STOP_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("the a an and or but of to in on for with from by at as is are was were be been it its this that these those each every another our your his her their we you they he she i not no never when why how what which who than then so if because after before during without near beside behind next instead across also often rarely usually quietly still only one single same".split()),
    "es": frozenset("el la los las un una unos unas y o pero de del al a en con por para sin sobre tras desde hasta que se su sus lo le les es son fue era ha han no si como cómo cuando porque qué este esta esto estos estas ese esa más muy ya cada antes después hemos".split()),
    "de": frozenset("der die das den dem des ein eine einen einem einer eines und oder aber von zu zum zur in im an am auf für mit aus bei nach vor über unter ohne um als wie ist sind war waren wird werden hat haben nicht kein keine sich es sie er wir ihr ich man dass weil wenn warum was auch nur noch schon bis seit galt".split()),
    "fr": frozenset("le la les l un une des du de d et ou mais à au aux en dans sur sous pour par avec sans chez que qui quoi dont où se sa son ses ce cette ces cet il elle ils elles nous vous je on est sont était ont a ne pas plus comme comment pourquoi quand si y après avant depuis malgré puis".split()),
}
ALL_STOP = frozenset().union(*STOP_WORDS.values())

_MONTH = (
    "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december"
    "|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
    "|januar|februar|märz|mai|juni|juli|oktober|dezember"
    "|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre)"
)
_DATE = re.compile(rf"(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}}|\d{{1,2}}(?:\.|st|nd|rd|th)?(?: de)? {_MONTH}\.?,?(?: de)? \d{{4}}|{_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})(?:,? \d{{1,2}}:\d{{2}})?")
_DATE_HINT = re.compile(r"\d{4}|\d[./]\d|\d\s*m")
_READING = re.compile(r"\d+\s*(?:min\b\.?|minutes?\b|minuten\b|minutos?\b)")
_NAME = r"[A-ZÀ-Þ][\w'’\-]+(?: (?:[A-ZÀ-Þ]\.|van|von|de|del|la|le|du))*(?: [A-ZÀ-Þ][\w'’\-]+){1,2}"
#: A byline: at most four words that end in the word for "by" or a colon and then a name, or a name, a comma and one to three words.
_BYLINE = re.compile(rf"^(?:(?:[\wÀ-ÿ]+ ){{0,3}}(?i:by|von|por|par|de|del)|[\wÀ-ÿ]+(?: [\wÀ-ÿ]+){{0,2}}\s?:) {_NAME}$|^{_NAME}, [\wÀ-ÿ]+(?: [\wÀ-ÿ]+){{0,3}}$")
#: Stems of the words that label a list of tags.
_TAGS = re.compile(r"^(?:[\wÀ-ÿ]+ ){0,2}(?:tag|topic|categor|keyword|filed|label|etiquet|tema|clave|categoría|schlag|thema|themen|stichw|kategor|mots|étiquet|thème|catégor|rubri)[\wÀ-ÿ-]*(?: [\wÀ-ÿ]+)?\s*:\s*\S")
#: The last of at most four words before the sign that points to another page.
POINTERS = frozenset("see read more also related reading next this site vea ver lea leer más también además relacionado interesar tema esto siehe lesen mehr auch dazu thema interessant voir lire aussi savoir plus sujet".split())
_MARK = re.compile(r"\s*[:→»>]\s*(?=\S)")
#: Stems of the words that head a box of teasers; such a head is a line of at most seven words.
_BOX = re.compile(
    r"\b(?:related|similar|recommended|suggested|popular|trending|most[ -](?:read|viewed|shared)|may also|might also|more from|read next|recent (?:posts|articles)|latest (?:news|posts|stories)"
    r"|relacionad|similares|recomendad|populares|tendencias|lo más|le puede interesar|también le|más de|últimas"
    r"|ähnliche|verwandte|empfohlen|beliebt|meistgelesen|auch interessieren|mehr von|neueste"
    r"|similaires|recommandé|populaires|les plus|à lire|sur le même|plus de|aimerez|tendances)"
)
#: Stems of what share bars and subscription forms ask for; such a line counts as one the site repeats.
_ACTION = re.compile(
    r"^[\W_]*(?:share (?!of\b)|tweet|pin it|print\b|copy (?:the )?link|(?:e-?mail|send) (?:this|to)\b|subscribe|sign (?:up|in)\b|comparte|compartir|imprimir|copiar|enviar a|suscr|teilen|drucken|abonnieren|weitersagen|partager|imprimer|copier|envoyer à|s.abonner|s.inscrire)"
    r"|\b(?:newsletter|your e-?mail|e-?mail address|su correo|boletín|e-?mail-adresse|(?:seite|artikel|link) (?:teilen|kopieren|empfehlen|drucken)|votre (?:e-?mail|adresse)|la lettre)\b"
)
_ADVERT = re.compile(r"^[\W_]*(?:advertis\w+|sponsor\w*|promot\w+|publicidad|patrocinado|anzeige|werbung|publicité|annonce)[\W_]*$")
_RIGHTS_FIRST, _RIGHTS = ("©", "(c)", "copyright", "℗"), ("rights reserved", "derechos reservados", "rechte vorbehalten", "droits réservés")
#: An offer: a percentage with the word for a reduction, or for what it is taken off.
_OFFER = re.compile(r"\d\s?%(?:\s\S+){0,2}\s(?:off|discount|descuento|dto|rabatt|nachlass|remise|réduction)\b")
_COOKIE = re.compile(r"\b(?:cookies|cookie-\w+)\b")
_SELF = re.compile(r"\b(?:site|website|page|we|us|you|your|sitio|web|página|usamos|utilizamos|navegar|su|webseite|seite|wir|sie|ihre?n?|nous|vous|votre|vos)\b")
_COUNT = re.compile(r"\s*\(\d+\)$")
_SPLIT = re.compile(r"\s*(?:\s{2,}|\t|\||·|•|/|›|»|>|–|—)\s*")
_PARTING = ("  ", "|", "/", "•", "·", ">", "›", "»", "–", "—", "\t")
_CELLS = re.compile(r"\t|;|\||\s{2,}|,(?=\S)")
_CODE = re.compile(r"[{}()=<>\[\];]")
_COMMA = re.compile(r",\S")
_RULE = re.compile(r"^[|\s:+-]{3,}$")
_BULLET = re.compile(r"^(?:[-–—•*·»›▪◦+]|\d{1,3}[.)]|[a-z][.)])\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_STOPS = re.compile(r"[.!?…][\"'”»)\]]*(?:\s|$)")
_CRUMB = re.compile(r"^(?:[-–]|[\wÀ-ÿ][\wÀ-ÿ' -]{0,24})\s(?P<s>>|›|/|»|::)\s\S")
_DIGITS = re.compile(r"\d+")
#: Signs that end a sentence or announce what follows, and those that may stand behind them.
ENDINGS, CLOSERS = (".", "!", "?", "…", ":"), "\"'”»)]"


def form_of(line: str, brand: str) -> str:
    """What two lines of a site must share to be one line: lower case, no bullet, no count behind, digit runs
    and the site's own name as one sign each."""
    low = line.strip().lower()
    if "  " in low or "\t" in low or "\xa0" in low or "\u3000" in low:
        low = " ".join(low.split())
    if low and not low[0].isalpha() or low[1:2] in (".", ")"):
        low = _BULLET.sub("", low)
    if low.endswith(")"):
        low = _COUNT.sub("", low)
    if brand:
        low = low.replace(brand, "§")
    return _DIGITS.sub("#", low)


def brand_of(host: str | None) -> str:
    """The site's own name, as its host gives it: the leading letters of the label before the last."""
    label = ([""] + (host or "").split(".")[:-1])[-1]
    m = re.match(r"[^\W\d_]{4,}", label)
    return m[0] if m else ""


@lru_cache(maxsize=200_000)
def form_key(line: str, brand: str) -> int:
    """The form of a line as a number (its checksum and its length), 0 if it is blank."""
    form = form_of(line, brand).encode("utf-8", "surrogatepass")
    return crc32(form) | (len(form) & 0x7FFFFFFF) << 32 if form else 0


@lru_cache(maxsize=100_000)
def is_row(line: str) -> bool:
    """Whether a line is a row of cells: a rule, or three or more cells of which one has a digit or sign alone."""
    if not ("|" in line or ";" in line or "\t" in line or "  " in line or _COMMA.search(line)):
        return False
    if _RULE.match(line) and line.count("|") >= 2:
        return True
    if line.count("{") + line.count("(") + line.count("=") >= 1 and is_code(line):
        return False
    cells = [c for c in _CELLS.split(line.strip("| ")) if c.strip()]
    if len(cells) < 3 or max(len(c.split()) for c in cells) > 4:
        return False
    return line[0] == "|" or sum([bool(_DIGITS.search(c)) or not _WORD.search(c) or c.strip().lower() in ("n/a", "ok") for c in cells]) * 3 >= len(cells)


def is_code(line: str) -> bool:
    """Whether a line holds four or more brackets, braces or signs of comparison, one in twenty characters or more."""
    marks = len(_CODE.findall(line))
    return marks >= 4 and 20 * marks >= len(line)


def is_label(text: str) -> bool:
    """One to three words without stop words, digits and the end of a sentence, as the entries of menus have them."""
    words = text.split()
    return 1 <= len(words) <= 3 and len(text) <= 40 and not _DIGITS.search(text) and (len(words) == 1 or (words[0].lower() not in ALL_STOP and sum(w in ALL_STOP for w in words) * 2 <= len(words))) and not text.endswith((".", "!", "?", ":"))


def link_density(low: str) -> float:
    """The share of a line's characters in labels, where it is cut into three or more pieces; else 0."""
    if not any([x in low for x in _PARTING]):
        return 0.0
    pieces = [_COUNT.sub("", p) for p in _SPLIT.split(_BULLET.sub("", low)) if p.strip(" -,;")]
    if len(pieces) < 2:
        return 0.0
    labels = sum(len(p) for p in pieces if is_label(p))
    return labels / sum(map(len, pieces)) if len(pieces) >= 3 or (labels == sum(map(len, pieces)) and "  " in low.strip()) else 0.0


def is_crumb(line: str) -> bool:
    """Short sections with one separator throughout, then the place of the page; no end of a sentence."""
    m = _CRUMB.match(line)
    if not m or line.rstrip(CLOSERS).endswith(ENDINGS):
        return False
    items = [x.strip() for x in line.split(f" {m['s']} ")]
    return len(items) >= (2 if m["s"] in ">›" else 3) and all(len(x.split()) <= 3 and len(x) <= 30 for x in items[:-1])


def is_pointer(low: str) -> bool:
    """Whether a line is a pointer to another page: one to four words that end in a word for more, a sign, a title."""
    m = _MARK.search(low)
    if not m:
        return False
    before = low[: m.start()].split()
    return 1 <= len(before) <= 4 and before[-1] in POINTERS


def is_dated(low: str) -> bool:
    """Whether a line is a date or a reading time, with at most three words beside it."""
    if not _DATE_HINT.search(low):
        return False
    rest, found = _DATE.subn(" ", low)
    rest, more = _READING.subn(" ", rest)
    return bool(found or more) and len(_WORD.findall(rest)) <= 3 and not _DIGITS.search(rest)


@lru_cache(maxsize=200_000)
def first_pass(line: str, repeated: bool) -> int:
    """The label a trimmed line gets by itself; ``repeated`` says whether its site repeats it."""
    low = line.lower()
    ends = line.rstrip(CLOSERS).endswith(ENDINGS)
    if ends and len(line) >= LONG and not repeated and "cookie" not in low:
        # most text is long prose, for which words need no parsing
        tokens = low.split()
        if len(tokens) > 14 and sum(map(ALL_STOP.__contains__, tokens)) >= PROSE_DENSITY * len(tokens):
            return GOOD
    words = _WORD.findall(low)
    n = len(words)
    prose = n >= 9 and sum(map(ALL_STOP.__contains__, words)) >= PROSE_DENSITY * n
    if not (prose and ends and n > 14):  # a long sentence has none of these forms
        if is_row(line) or is_code(line):
            return ROW
        if (n <= 9 and is_dated(low)) or is_pointer(low) or _TAGS.match(low) or _ADVERT.match(low):
            return META
        if n <= 7 and not _STOPS.search(low) and _BOX.search(low) and not _DIGITS.search(low):
            return BOX
        if n <= 8 and _BYLINE.match(line):
            return META
        if is_crumb(line) or low.startswith(_RIGHTS_FIRST) or any([x in low for x in _RIGHTS]) or (n <= 14 and _OFFER.search(low)):
            return BAD
    if repeated:
        return SAID if n <= 6 and not ends else BAD
    if not (prose and ends):
        if link_density(low) >= 0.7:
            return LINKS
        if n <= 6 and not line.endswith(".") and _ACTION.search(low):
            return SAID
    if "cookie" in low and _COOKIE.search(low) and len(_SELF.findall(low)) >= 0.05 * n:
        return NEAR  # a notice about the site's own cookies is content only among content
    if prose:
        if ends:
            return GOOD if len(line) >= LONG or len(_STOPS.findall(line)) >= 3 else NEAR
        return GOOD if len(line) >= 2 * LONG else SHORT
    if n >= 9 or len(line) >= BLOCK:
        # rows, code and text of an unknown language: no links, so content where long enough
        return NEAR if ends and len(line) < LONG else GOOD
    if ends and n >= 4:
        return NEAR
    return LABEL if is_label(_COUNT.sub("", _BULLET.sub("", low))) else SHORT


def content_lines(body: str | None, title: str | None = None, repeated: Set[int] = frozenset(), brand: str = "") -> tuple[list[str], list[int]]:
    """The trimmed lines of a text and, for each, 1 if it is main content, 0 if it is boilerplate, -1 if blank.

    ``repeated`` holds the keys of the forms that the page's site repeats, ``brand`` the site's own name.
    """
    if body is None:
        return [], []
    lines = [x.strip() for x in body.split("\n")]
    labels = [first_pass(x, bool(repeated) and form_key(x, brand) in repeated) if x else -1 for x in lines]
    head = headline_of(lines, labels, title)
    if head is not None:
        labels[head] = GOOD
    rows(labels)
    boxes(lines, labels, head)
    menus(lines, labels)
    groups(lines, labels)
    subheads(labels)
    message(lines, labels, head)
    inherit(lines, labels)
    return lines, labels


def headline_of(lines: list[str], labels: list[int], title: str | None) -> int | None:
    """The index of the page's own headline: the line that begins the title, or else the first short line
    of four or more words above content that isn't boilerplate."""
    key = (title or "").strip().lower()
    first = None
    for i, (line, label) in enumerate(zip(lines, labels)):
        if label == -1:
            continue
        if key and len(line) >= 8 and key.startswith(line.lower()):
            return i
        if first is None:
            if label == SHORT and not _BULLET.match(line):
                first = i
            elif label in (GOOD, NEAR, ROW, BOX) and i and any(x in (BAD, META, LABEL, SAID) for x in labels[:i]):
                first = -1
    return first if first is not None and first >= 0 else None


def rows(labels: list[int]) -> None:
    """Rows of cells are content in groups of two or more; what was taken for links right above them is their heading."""
    n = len(labels)
    for i, label in enumerate(labels):
        if label == ROW:
            near = [labels[k] for k in (i - 1, i + 1) if 0 <= k < n]
            if not any(x == ROW or x == GOOD for x in near):
                labels[i] = SHORT
    for i, label in enumerate(labels):
        if label == ROW:
            labels[i] = GOOD
            if i and labels[i - 1] in (LINKS, LABEL, SHORT, SAID) and (i < 2 or labels[i - 2] != ROW):
                labels[i - 1] = GOOD


def boxes(lines: list[str], labels: list[int], head: int | None) -> None:
    """A teaser box runs from its head over short lines up to a blank line or a decided one. A short line that
    the site repeats heads a box as well, where two or more bulleted lines follow it at once."""
    n, i = len(labels), 0
    while i < n:
        bulleted = lambda k: k < n and labels[k] in (SHORT, NEAR) and bool(_BULLET.match(lines[k])) and not lines[k][0].isdigit()
        if labels[i] == BOX or (labels[i] == SAID and bulleted(i + 1) and bulleted(i + 2) and not lines[i].rstrip(CLOSERS).endswith(ENDINGS)):
            labels[i] = BAD
            i += 1
            while i < n and i != head and (labels[i] in (SHORT, LABEL, SAID) or (labels[i] in (NEAR, GOOD) and bool(_BULLET.match(lines[i])) and not _STOPS.search(lines[i]))):
                labels[i] = BAD
                i += 1
        else:
            i += 1


def menus(lines: list[str], labels: list[int]) -> None:
    """Three or more labels in lines one after another, or a line of labels, are links where no content stands on
    both sides; beside a repeated line one is enough."""
    n, i = len(labels), 0
    for k, label in enumerate(labels):
        if label == LINKS:
            inside = 0 < k < n - 1 and labels[k - 1] in (GOOD, NEAR, SHORT) and labels[k + 1] in (GOOD, NEAR, SHORT, LINKS)
            labels[k] = SHORT if inside else BAD
    while i < n:
        if labels[i] not in (LABEL, SAID):
            i += 1
            continue
        j = i
        while j < n and labels[j] in (LABEL, SAID):
            j += 1
        above = next((labels[k] for k in range(i - 1, -1, -1) if labels[k] not in (-1, META)), BAD)
        below = next((labels[k] for k in range(j, n) if labels[k] not in (-1, META)), BAD)
        inside = above in (GOOD, NEAR, SHORT) and below in (GOOD, NEAR, SHORT)
        said = sum(labels[k] == SAID for k in range(i, j))
        if (j - i >= 3 and not inside) or (said and 2 * said >= j - i and (j - i >= 2 or not inside)):
            labels[i:j] = [BAD] * (j - i)
        i = j


def groups(lines: list[str], labels: list[int]) -> None:
    """Short lines of one shape, one after another, are a block; with the stop words of prose it is content."""
    n, i = len(labels), 0
    while i < n:
        if labels[i] not in (SHORT, LABEL):
            i += 1
            continue
        j, shape = i, bool(_BULLET.match(lines[i]))
        while j < n and labels[j] in (SHORT, LABEL) and bool(_BULLET.match(lines[j])) == shape:
            j += 1
        if j - i >= 2:
            words = [w for k in range(i, j) for w in _WORD.findall(lines[k].lower())]
            if (j - i >= 3 or sum(len(lines[k]) for k in range(i, j)) >= BLOCK) and sum(w in ALL_STOP for w in words) >= PROSE_DENSITY * len(words):
                labels[i:j] = [GOOD] * (j - i)
        i = max(j, i + 1)


def subheads(labels: list[int]) -> None:
    """A short line that a site repeats is a heading of the content where content stands next to it on both
    sides, and boilerplate elsewhere."""
    for i, label in enumerate(labels):
        if label == SAID:
            above = next((labels[k] for k in range(i - 1, -1, -1) if labels[k] not in (-1, META)), BAD)
            below = next((labels[k] for k in range(i + 1, len(labels)) if labels[k] not in (-1, META)), BAD)
            labels[i] = GOOD if above in (GOOD, NEAR, SHORT) and below in (GOOD, NEAR, SHORT) else BAD


def message(lines: list[str], labels: list[int], head: int | None) -> None:
    """Where a page has no content but its headline, the first sentences behind that are its content: the
    message of an error page. Without a headline, the first that aren't the page's very first line, or else that line."""
    if any(label == GOOD and i != head for i, label in enumerate(labels)):
        return
    at = head + 1 if head is not None else next((i for i, x in enumerate(labels) if x in (BAD, META)), -1) + 1
    while at < len(labels) and labels[at] not in ((NEAR, SHORT) if head is not None else (NEAR,)):
        if head is not None and labels[at] == BAD and not lines[at].rstrip(CLOSERS).endswith(ENDINGS):
            return
        at += 1
    if at >= len(labels) and head is None:
        at = next((i for i, x in enumerate(labels) if x != -1), at)
    while at < len(labels) and labels[at] in (NEAR, SHORT):
        labels[at] = GOOD
        at += 1


def inherit(lines: list[str], labels: list[int]) -> None:
    """The second pass: undecided lines take the label of the nearest decided ones."""
    n = len(labels)
    decided = [x if x in (GOOD, BAD) else None for x in labels]
    up: list[tuple[int, int]] = []
    last = (BAD, -1)
    for i in range(n):
        up.append(last)
        if decided[i] is not None:
            last = (decided[i], i)
    last = (BAD, n)
    for i in range(n - 1, -1, -1):
        label = labels[i]
        if label in (NEAR, SHORT, LABEL, ROW):
            (a, above), (b, below) = up[i], last
            if a == b:
                labels[i] = a
            elif label == NEAR:
                labels[i] = GOOD
            elif b == GOOD:
                labels[i] = GOOD if label == SHORT or below - i <= i - above else BAD
            else:
                close = i - above <= below - i or _BULLET.match(lines[i])
                labels[i] = GOOD if label == SHORT and close and len(lines[i].split()) >= 5 else BAD
        elif label in (META, BOX, SAID):
            labels[i] = BAD
        if decided[i] is not None:
            last = (decided[i], i)
