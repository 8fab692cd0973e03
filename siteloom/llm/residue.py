"""Template residue, filler, error messages and demands for scripts in place of content.

A multi-pattern automaton holds the parts of which such messages are made, in several languages:
what failed, the thing that failed, what the reader is asked to do, scripts and cookies and the
need for them, and what templates say about text still to be written. Messages are recognised by
how parts combine (a failure with a thing, a request or a code; scripts with a need; text with an
order to write it), so their wording needn't be known as a whole. A field is a case where the
parts of one kind combine and cover much of it, or where it leaks a template variable; messages
that are quoted in, or stand beside, real content cover little of it and don't count.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from operator import mul

import ahocorasick

from siteloom.llm.blocks import ALL_STOP, GOOD, content_lines

#: Share of a field that parts must cover.
COVERAGE = 0.6

#: Parts in lower case, digit runs as one "#"; a star stands for any end of the word.
PARTS: dict[str, str] = {
    # what failed: predicates, never an adjective alone
    "cause": """
not found|not be found|can't find|cannot find|couldn't find|could not find|can not be found|cannot be found|can't be found|nothing was found|nothing here|nothing to see|doesn't exist|does not exist|didn't exist|no longer exist*|no longer available|no longer here|isn't here|is not here|any more|anymore|is gone|was gone|has gone|gone|went missing|wandered off|has moved|have moved|was moved|been moved|been removed|been deleted|was deleted|was removed|moved or|renamed|new address|may have been
unavailable|not available|isn't available|temporarily|out of service|out of order|down for|is down|are down|offline|under maintenance|maintenance|being updated|back soon|be back|be right back|under construction
went wrong|gone wrong|goes wrong|oops|whoops|uh oh|unexpected|error|errors|http #|fatal|exception|stack trace|traceback|crashed|failed|failure|fails|could not|couldn't|cannot|can't|unable|is not working|not working|unhandled|undefined method|undefined function|syntax|parse|internal error|bad gateway|gateway timeout|bad request|timed out|time out|timeout|too long to respond|no response|no answer|no valid|invalid response|invalid answer|empty response|did not answer|didn't answer|not respond*|isn't responding|overloaded|too busy|too many|limit exceeded|rate limit*|slow down
forbidden|denied|refused|not allowed|not permitted|no permission|have permission|permission|permissions|not authori*|unauthori*|is blocked|was blocked|been blocked|request blocked|banned|expired|has ended|logged out|invalid|conflict
no encontrad*|no se encuentra|no se encontró|no encontramos|no podemos encontrar|no pudimos encontrar|no hemos podido|no pudo|no puede|no se pudo|no se puede|no existe|ya no existe|ya no está|ha cambiado|se ha movido|ha sido movida|ha sido eliminad*|fue eliminad*|no disponible|no está disponible|fuera de servicio|temporalmente|en mantenimiento|mantenimiento|mantenimiento programado|en construcción|volveremos|vuelta pronto|ha ocurrido|se ha producido|se produjo|ocurrió|algo salió mal|algo ha salido mal|salió mal|inesperado|error interno|errores|fallo|falló|ha fallado|acceso denegado|denegad*|prohibid*|no autorizad*|no tiene permiso*|no tienes permiso*|permisos|caducad*|ha caducado|expirad*|demasiadas|demasiado|bloquead*
nicht gefunden|nicht finden|existiert nicht|existiert nicht mehr|gibt es nicht|nicht mehr|nicht vorhanden|verschoben|gelöscht|entfernt|umgezogen|nicht verfügbar|nicht erreichbar|vorübergehend|außer betrieb|wartung*|in wartung|warten gerade|im aufbau|gleich zurück|bald zurück|bald wieder|schiefgelaufen|schief gelaufen|schief gegangen|fehler|unerwartet*|aufgetreten|ist aufgetreten|fehlgeschlagen|gescheitert|konnte nicht|konnten nicht|kann nicht|können nicht|verweigert|verboten|gesperrt|keine berechtigung|nicht berechtigt|nicht erlaubt|unzulässig*|abgelaufen|zu viele|überlastet|hoppla|ups
introuvable*|n'a pas été trouvé*|pas trouvé*|n'existe pas|n'existe plus|plus disponible|n'est plus|a été déplacé*|été supprimé*|a été supprimé*|déplacé*|supprimé*|indisponible*|pas disponible|temporairement|hors service|en maintenance|maintenance|en construction|de retour|s'est produit*|est survenue|survenu*|mal passé*|mal tourné|inattendu*|erreur*|a échoué|échec|impossible|refusé*|interdit*|pas le droit|pas autorisé*|non autorisé*|n'êtes pas autorisé*|expiré*|trop de|bloqué*|oups
niet gevonden|niet vinden|bestaat niet|bestaat niet meer|niet meer|niet beschikbaar|verplaatst|verwijderd|ging mis|misgegaan|fout|fouten|onverwachte|geweigerd|verlopen|onderhoud|tijdelijk|te veel|non trovat*|non esiste|non è stata trovata|non disponibile|non è disponibile|si è verificato|errore|negato|scadut*|manutenzione|não encontrad*|não existe|não foi encontrad*|não está disponível|indisponível|ocorreu|erro|negado|expirou|manutenção
""",
    # the thing that failed
    "thing": """
page|pages|site|website|web site|server|servers|upstream server|resource|document|file|url|address|link|item|article|content|request|service|gateway|host|database|connection|connections|session|application|app|system|account|portal|view|owner|internal server|area|section|answer|reply|access|something|things
página|páginas|sitio|servidor|recurso|documento|archivo|dirección|enlace|artículo|contenido|solicitud|solicitudes|servicio|conexión|sesión|base de datos|aplicación|sistema|cuenta|acceso|algo
seite|seiten|website|webseite|server|dokument|datei|adresse|artikel|inhalt|inhalte|anfrage|anfragen|dienst|verbindung|sitzung|datenbank|anwendung|system|konto|zugriff|zugang|interner|bereich|etwas|da ist was
serveur|ressource|fichier|adresse|lien|contenu|requête|requêtes|service|connexion|session|base de données|application|système|compte|accès|quelque chose
pagina|adres|bestand|verzoek|dienst|sessie|toegang|risorsa|indirizzo|richiesta|servizio|accesso|sessione|endereço|ficheiro|arquivo|acesso|sessão|serviço|iets|qualcosa|algo
""",
    # what is asked of the reader, and what stands around
    "request": """
please|try again|retry|come back|check back|visit us|later|later on|reload|refresh|go back|go ahead|return to|start page|home page|homepage|check the|check that|contact|administrator|admin|webmaster|support team|in # minutes|# minutes|# seconds|minutes|seconds|moment|shortly|soon|reference|incident|incident number|error code|code #|code: #|http|line #|sorry|apologi*|thank you for your patience|patience|looking for|looked for|requested|you wanted|you want|tried to|log in|sign in|to view|this takes|about #
por favor|inténtelo|inténtalo|vuelva|vuelve|de nuevo|más tarde|intentarlo|recargue|recarga|contacte|administrador|lo sentimos|perdone|disculpe|solicitad*|busca|buscaba|código #|código: #|minutos|segundos|ver este|inicie sesión
bitte|versuchen|erneut|noch einmal|später|laden sie|neu laden|zurück|kontaktieren|administrator|leider|entschuldigung|tut uns leid|angefordert*|gesucht*|suchen|gesuchte|kennung|code #|minuten|sekunden|moment|augenblick|zu sehen|anmelden
veuillez|réessayer|réessayez|plus tard|rechargez|revenez|retournez|contactez|administrateur|désolé*|demandé*|recherchez|recherchée|cherchez|code #|minutes|secondes|instant|patienter|voir cette
alstublieft|probeer|opnieuw|later|helaas|gevraagde|gezochte|riprova|riprovare|più tardi|spiacenti|richiest*|tente novamente|mais tarde|desculpe|solicitada
""",
    # scripts, cookies, browsers, checks
    "script": """
javascript|java script|script|scripts|scripting|cookie|cookies|browser|browsers|captcha|human|robot|puzzle|security check|ad blocker|adblocker|one more step|checking your browser|just a moment|just a second
navegador|guiones|humano|un momento|comprobación de seguridad|comprobando|verificando|skripte*|skript|mensch|sicherheitsprüfung|sicherheitsüberprüfung|einen moment|wird geprüft|navigateur|humain|un instant|vérification|vérifions|contrôle de sécurité
navegadores|browserversie|browsercontrole|mens|beveiligingscontrole|umano|un attimo
""",
    "need": """
enable*|turn on|turn it on|switch on|switch it on|switched on|turned on|activate*|allow|allows|allowed|permit*|accept|require*|needed|needs|need|must|must be|have to|has to|disabled|switched off|turned off|is off|are off|is blocked|not supported|doesn't support|without|to continue|to proceed|to use|to run|run|to see|to display|displayed|be shown|show anything|anything|nothing|doesn't work|won't work|work without|can start|load|reload|refresh|verify*|checking|confirm|prove|solving|below|complete|before you|enter|safe|ahead|wait
se requiere|requier*|necesita*|necesario*|habilit*|activ*|desactivad*|deshabilitad*|permit*|para continuar|para usar|no funciona|funciona|no ejecuta|ejecuta|demuestre|verifique|usar|sin
erforderlich|benötig*|aktivier*|einschalt*|eingeschaltet|ausgeschaltet|deaktiviert|erlaub*|zulassen|unterstützt|führt keine|führt|nutzen|zu nutzen|verwenden|anzeigen|angezeigt|fortzufahren|fortfahren|geprüft|bestätigen|ohne|funktioniert|werden
requis*|nécessaire*|nécessite*|activer|activez|activé*|désactivé*|autoris*|accepter|pour continuer|pour utiliser|utiliser|fonctionne|ne fonctionne pas|n'exécute pas|exécute|prouvez|vérifi*|sans|afficher|affiché
vereist|nodig|inschakel*|ingeschakeld|zet|schakel|uitgeschakeld|werkt niet|werkt|zonder|toestaan|doorgaan|abilita*|attiva*|richiesto|necessari*|disabilitat*|ativ*|necessário|habilite|desativad*
""",
    # what templates say about text that is still to be written
    "filler": """
lorem ipsum|dolor sit amet|consectetur adipiscing|dummy|placeholder|sample text|filler text|sample content|sample page|sample|example page|example text|only an example|is an example|untitled|no title|new page|new post|new document|default title|default page|just another|demo site|demo page|hello world|test test|test page|test post|this is a test|testing #|asdf*|qwer*|asdf|qwerty|foo bar|foobar|xxx|xxxx|blah|blah blah|todo|to do:|tbd|tba|fixme|to be written|to be added|to follow|coming soon|copy goes|goes here|text here|title here|headline here|description here|name here
de ejemplo|texto de relleno|texto de prueba|de muestra|sin título|página nueva|hola mundo|próximamente|texto aquí|va el texto|título aquí|inserte|aquí va
platzhalter*|beispieltext|beispielseite|blindtext|mustertext|musterseite|fülltext|ohne titel|neue seite|hallo welt|ihr text|text einfügen|titel einfügen|überschrift einfügen|hier steht|in kürze|kommt bald|folgt in kürze|einfügen
texte d'exemple|texte provisoire|texte de remplissage|faux texte|à remplacer|provisoire|sans titre|nouvelle page|bonjour tout le monde|votre texte|texte ici|titre ici|à venir|bientôt disponible|exemple de page|page d'exemple
voorbeeldtekst|voorbeeldpagina|zonder titel|uw tekst hier|tekst hier|testo segnaposto|senza titolo|il tuo testo|texto de exemplo|sem título|seu texto aqui
""",
    # an order to write it, and what is to be written
    "order": "enter|insert|add|write|edit|replace|click|describe|type|put|fill in|change|delete|publish|escriba|inserte|añada|edite|sustituya|reemplace|haga clic|geben sie|schreiben sie|fügen sie|ersetzen|bearbeiten|klicken|saisissez|écrivez|insérez|ajoutez|modifiez|remplacez|cliquez|voer|schrijf|vul|inserisci|scrivi|insira|escreva",
    "text": "your text|your own|your title|your headline|your description|your product|your company|your name|your content|text|title|headline|heading|subheading|description|caption|paragraph|copy|words|sentence|sentences|section|block|here|max|characters|product|short|page|content|own words|su texto|texto|título|descripción|aquí|titel|text|überschrift|beschreibung|hier|später|texte|titre|ici|tekst|hier|testo|titolo|qui|aqui",
}
#: The classes whose parts count for a kind, and the combinations that make it one. A class named alone suffices.
KINDS: dict[str, tuple[frozenset[str], tuple[frozenset[str], ...]]] = {
    "error": (frozenset({"cause", "thing", "request"}), (frozenset({"cause", "thing"}), frozenset({"cause", "request"}), frozenset({"cause", "code"}))),
    "scripts": (frozenset({"script", "need", "thing", "request"}), (frozenset({"script", "need"}), frozenset({"script", "request"}), frozenset({"check"}))),
    "filler": (frozenset({"filler", "order", "text", "thing"}), (frozenset({"filler"}), frozenset({"order", "text", "here"}))),
}
#: Parts of class "script" that are a whole notice.
CHECKS = frozenset("one more step|checking your browser|just a moment|just a second|un momento|einen moment|un instant|security check|comprobación de seguridad|sicherheitsprüfung|sicherheitsüberprüfung|contrôle de sécurité|beveiligingscontrole|un attimo".split("|"))
#: Parts of class "text" that point to the place to write at.
PLACES = frozenset("here|your own|your text|your title|your product|your headline|own words|aquí|hier|ici|su texto|your description|your company|qui|aqui|max|block|section".split("|"))
#: Words that count neither way, besides the stop words.
NEUTRAL = ALL_STOP | frozenset("has have had can could will would may might do does did be been being me my us there here's it's you're we're i'm let's all any some just only yet about into out up off ya nos me está están hay sido ser este esta cette ces cet été être suis sommes ihren ihre ihr ihrem diese dieser dieses dieser wird wurde wurden worden uns mich mir het een de van op te voor wij u uw je jouw is zijn wordt il lo la gli una per del di o da do os as um uma por".split())

#: Words of the customary Latin filler; they count where a field has several.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum massa cursus eros pharetra porta sodales rutrum fusce ornare tortor vestibulum donec blandit pretium congue aliquam ligula mauris viverra vel nunc ac nec at vitae a pellentesque morbi tristique senectus netus fames turpis egestas praesent semper feugiat nibh pulvinar proin gravida hendrerit lectus arcu bibendum varius vel orci dapibus ultrices purus libero justo laoreet risus suspendisse potenti metus vulputate diam phasellus quam lacus sapien faucibus molestie mattis aenean euismod elementum nisl maecenas integer cras leo auctor augue neque urna tellus felis habitant malesuada condimentum".split()
)

_SIGNS = ("{", "<", "[", "%", "__", "@@", ":")
_MARKERS = re.compile(r"[{<]|\[[\[*+~!A-Zo]|%[\w%]|__|@@|(?<!\S):[a-z]")
_VARIABLE = re.compile(
    r"\{\{[-~#/]?\s*[\w.|:' -]{1,60}?\s*[-~]?\}\}|\$\{\s*[\w.]{1,60}\s*\}|<%[=-]?\s*[\w.@]{1,60}\s*%>|<\?(?:php|=)?\s*(?:echo )?\$[\w>.\[\]'-]{1,60};?\s*\?>|\[\[[+*~!]?[\w.-]{1,60}\]\]|#\{\s*[\w.]{1,60}\s*\}|\{%-?\s*\w[\w ._'\"-]{0,60}-?%\}"
    r"|\{![\w.]{1,60}!?\}|\[\*[\w.-]{1,60}\*\]|@@[A-Za-z][A-Za-z_]{1,40}@@|(?<![\w:]):[a-z]{4,}(?:_[a-z]+)*:(?![\w:/])|<(?:insert|enter|add|put|your|type) [\w ]{1,40}>"
    r"|%%[A-Za-z][A-Za-z_]{1,40}%%|(?<![\w%])%[a-z][a-z_]{2,40}%(?![\w%])|(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)|(?<![\w){}$#&])&?\{[a-z][a-z_]{2,}(?:\.[a-z_]+)?\}(?![\w{}])|\[[A-Z][\w ]{0,40} here\]|\[(?:Your|Insert|Enter) [\w ]{1,40}\]|\[object Object\]"
)
#: Quoted code is an example, not residue.
_QUOTED = re.compile(r"`[^`\n]{1,200}`|<code>.*?</code>|“[^”\n]{1,120}”|«[^»\n]{1,120}»", re.DOTALL)
_VOID = re.compile(r"^(?:undefined|null|nan|none|\[object object\])(?:[\s,;/|–:-]+(?:undefined|null|nan|none|\[object object\]))*$")
_SUFFIX = re.compile(r"\s+(?:\||–|—|::|-|·|•|»)\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|#")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """The automaton over all parts and Latin words; values are the length and, per class, whether any end of the word may follow."""
    parts: dict[str, dict[str, bool]] = {}
    for word in LATIN:
        if len(word) > 3:
            parts.setdefault(word, {})["latin"] = False
    for kind, listed in PARTS.items():
        for part in listed.replace("\n", "|").split("|"):
            if part.strip():
                parts.setdefault(part.strip().rstrip("*"), {})[kind] = part.strip().endswith("*")
    for part in CHECKS:
        parts.setdefault(part, {})["check"] = False
    for part in PLACES:
        parts.setdefault(part, {})["here"] = False
    auto = ahocorasick.Automaton()
    for part, kinds in parts.items():
        auto.add_word(part, (len(part), tuple(kinds.items())))
    auto.make_automaton()
    return auto


def normal(text: str) -> str:
    """Lower case, white space as one space, digit runs as ``#``, straight apostrophes."""
    return _DIGITS.sub("#", " ".join(text.lower().split()).replace("’", "'"))


def matches(low: str) -> dict[str, list[tuple[int, int]]]:
    """Per class the stretches of a normalised text that its parts match, at word boundaries."""
    out: dict[str, list[tuple[int, int]]] = {}
    n = len(low)
    for last, (size, kinds) in automaton().iter(low):
        start, end = last - size + 1, last + 1
        if start and low[start - 1].isalnum() and low[start].isalnum():
            continue
        open_end = end < n and low[end].isalnum() and low[last].isalnum()
        for kind, stem in kinds:
            if open_end and not stem:
                continue
            stop = end
            while open_end and stop < n and low[stop].isalnum():
                stop += 1
            out.setdefault(kind, []).append((start, stop))
    return out


def coverage(text: str) -> tuple[float, str]:
    """The share of a text's words, counted in characters, that the parts of one kind cover, and that kind; 0 where
    its parts don't combine to a message.

    Stop words, and words with digits, slashes or dots inside (paths, hosts, identifiers), count neither way.
    """
    # what no part can match bounds the share from above, so most texts end here
    tokens = Counter(text.lower().split())
    if sum(map(mul, map(outside, tokens), tokens.values())) > (1 - COVERAGE) * sum(map(mul, map(len, tokens), tokens.values())):
        return 0.0, ""
    low = normal(text)
    found = matches(low)
    if len(found.get("latin", ())) >= 4:
        found.setdefault("filler", []).extend(found["latin"])
    if _CODE.search(low):
        found["code"] = []
    best, most = 0.0, ""
    for kind, (classes, combinations) in KINDS.items():
        if not any(all(c in found for c in combination) for combination in combinations):
            continue
        spans = sorted(x for c in classes for x in found.get(c, ()))
        merged: list[list[int]] = []
        for start, end in spans:
            if merged and start <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        hit = sum(letters(low[start:end]) for start, end in merged)
        ends = [0, *(end for _, end in merged)]
        between = " ".join([low[at:start] for at, (start, _) in zip(ends, [*merged, (len(low), 0)])])
        rest = sum(n * weight(t) for t, n in Counter(between.split()).items())
        share = hit / (hit + rest) if hit else 0.0
        if share > best:
            best, most = share, kind
    return best, most


@lru_cache(maxsize=100_000)
def weight(token: str) -> int:
    """The letters of a token that count against coverage: none of stop words, numbers, paths and hosts."""
    core = token.strip(".,;:!?()[]\"'“”«»¡¿")
    return 0 if "#" in core or "/" in core or "." in core or core in NEUTRAL else letters(token)


@lru_cache(maxsize=1)
def vocabulary() -> tuple[frozenset[str], tuple[str, ...], frozenset[str]]:
    """The words that stand in parts, the stems, and the stems' first two letters."""
    words, stems = set(LATIN), set()
    for listed in (*PARTS.values(), "|".join(CHECKS | PLACES)):
        for part in listed.replace("\n", "|").split("|"):
            words |= set(_PIECE.findall(part))
            if part.strip().endswith("*"):
                stems.add(_PIECE.findall(part)[-1])
    return frozenset(words), tuple(stems), frozenset(s[:2] for s in stems)


@lru_cache(maxsize=100_000)
def outside(token: str) -> int:
    """The weight of a token in lower case that no part can match."""
    own = weight(_DIGITS.sub("#", token.replace("’", "'")))
    if not own:
        return 0
    words, stems, heads = vocabulary()
    return 0 if any(p in words or (p[:2] in heads and p.startswith(stems)) for p in _PIECE.findall(token)) else own


_PIECE, _DIGITS = re.compile(r"\w+"), re.compile(r"\d+")
_CODE = re.compile(r"(?:^|[^\w.,])(?:http )?#(?=$|[^\w.,%])")


@lru_cache(maxsize=100_000)
def letters(text: str) -> int:
    """Characters without spaces, digit marks and plain punctuation."""
    return len(text.translate(_DROP))


_DROP = str.maketrans("", "", " #.,;:!?()[]\"'-–…|¡¿“”«»")


def leaks_variable(text: str) -> bool:
    """Whether a text holds a template variable that isn't quoted as an example."""
    if not _MARKERS.search(text):
        return False
    bare = _QUOTED.sub(" ", text)
    return any(not bracketed(bare, m.start(), m.end()) for m in _VARIABLE.finditer(bare))


def bracketed(text: str, start: int, end: int) -> bool:
    """Whether straight quotes enclose exactly this stretch."""
    return start > 0 and end < len(text) and text[start - 1] == text[end] and text[end] in "\"'"


def without_brand(text: str) -> list[str]:
    """A title as it is, and without what follows or precedes its last separator."""
    out = [text]
    cuts = list(_SUFFIX.finditer(text))
    if cuts:
        last = cuts[-1]
        if len(text[last.end() :].split()) <= 4:
            out.append(text[: last.start()])
    return out


def short_field(text: str | None, title: bool) -> str:
    """The kind of residue in a title or description, '' if it is none."""
    if text is None or not text.strip():
        return ""
    if leaks_variable(text):
        return "variable"
    for part in without_brand(text) if title else (text,):
        if _VOID.match(part.strip().lower()):
            return "variable"
        share, kind = coverage(part)
        if share >= COVERAGE:
            return kind
    return ""


def body_field(body: str | None, title: str | None = None) -> str:
    """The kind of residue that makes up the main part of a body, '' if it is none."""
    if body is None or not body.strip():
        return ""
    lines, labels = content_lines(body, title)
    return body_kind(lines, labels, title)


def body_kind(lines: list[str], labels: list[int], title: str | None) -> str:
    """``body_field`` over lines that are classified already."""
    content = [i for i, label in enumerate(labels) if label == GOOD]
    if any([x in lines[i] for i in content for x in _SIGNS]) and any(leaks_variable(lines[i]) and not is_code(lines[i]) for i in content):
        return "variable"
    if len(content) > 1:
        head = content[0] if own_headline(lines, labels, title, content[0]) else None
        content = [i for i in content if i != head]
    main = " ".join(lines[i] for i in content)
    if not main:
        return ""
    if _VOID.match(main.strip().lower()):
        return "variable"
    share, kind = coverage(main)
    return kind if share >= COVERAGE else ""


def is_code(line: str) -> bool:
    """Lines of code and rows of cells hold braces and percent signs of their own."""
    return line.count("{") + line.count("}") + line.count(";") + line.count("(") >= 4 and not re.search(r"\w+ \w+ \w+ \w+ \w+", line)


def own_headline(lines: list[str], labels: list[int], title: str | None, i: int) -> bool:
    """Whether content line ``i``, the first, is a headline: short and without a sentence's end."""
    line = lines[i]
    return len(line) <= 140 and not re.search(r"[.!?;:]$", line)


__all__ = ["COVERAGE", "automaton", "body_field", "body_kind", "coverage", "leaks_variable", "short_field"]
