"""Invented sites and messages that no list of the library was written from."""

import random

# menu, notices at the top, what stands around the content, share bar, box head, foot
SITES = {
    ("en", "fellhiker.test"): (
        ["Trails", "Huts", "Gear reviews", "Maps", "Weather", "Membership"], ["Our pages keep small files on your device to remember your route.", "That's fine", "Choose what to keep"], "Words and pictures: Ann Leigh",
        ["Pass this route on", "Save for later"], "Walks nearby", ["Ridge rescue fund", "Press desk", "Trail etiquette", "Fellhiker is run by volunteers and takes no liability for your route.", "Become a member for 12 pounds a year."],
    ),
    ("en", "breadshelf.test"): (
        ["Sourdough", "Rye", "Equipment", "Workshops", "Questions"], ["Fresh recipes in your inbox every Friday", "Yes please"], "Recipe by Tomas Arden",
        ["Print recipe", "Rate this loaf"], "Bakers also loved", ["Stockists", "Flour guide", "Wholesale", "Breadshelf earns a small commission from some shops.", "Built in a cold kitchen."],
    ),
    ("de", "gartenblick.test"): (
        ["Beete", "Gehölze", "Rasen", "Werkzeug", "Gartenkalender"], ["Damit die Seite funktioniert, legen wir kleine Dateien auf Ihrem Gerät ab.", "In Ordnung", "Auswahl treffen"], "Text und Fotos: Jana Reuter",
        ["Merken", "Weitererzählen"], "Leser mochten außerdem", ["Bezugsquellen", "Mediadaten", "Lesertelefon", "Gartenblick übernimmt keine Haftung für Ernteausfälle.", "Abo kündigen"],
    ),
    ("fr", "veloville.test"): (
        ["Itinéraires", "Ateliers", "Entretien", "Sécurité", "Agenda"], ["Pour fonctionner, nos pages déposent de petits fichiers sur votre appareil.", "Entendu", "Choisir"], "Reportage de Luc Martel",
        ["Garder pour plus tard", "Signaler une erreur"], "Nos lecteurs ont aimé", ["Bénévolat", "Adhésion", "Espace presse", "Veloville ne répond pas des horaires indiqués.", "Faire un don"],
    ),
    ("es", "costamar.test"): (
        ["Playas", "Mareas", "Rutas", "Buceo", "Alojamiento"], ["Dejamos pequeños archivos en su dispositivo para recordar su costa.", "Conforme", "Elegir"], "Crónica de Inés Robles",
        ["Guardar ruta", "Avisar de un error"], "Otros viajeros leyeron", ["Voluntariado", "Tablón", "Sala de prensa", "Costamar no responde de los horarios publicados.", "Hágase socio"],
    ),
}
WORDS = {
    "en": (["the old path", "a wet saddle", "our guide", "the smaller lake", "this stretch of wall", "a warm oven", "the second dough", "the shepherd", "every third bend", "a long thread of fog"], ["climbs away from", "was built beside", "leads us towards", "holds more than", "is often hidden by", "was left to rest near", "turns slowly into"], ["the quarry that closed in {n}", "a gate which sticks after rain", "the mill and its {n} steps", "a field with sheep in it", "the stones of the upper ford", "the last house of the valley"]),
    "de": (["der alte Weg", "die junge Birke", "das erste Beet", "ein feuchter Boden", "die Nachbarin", "der späte Frost", "eine Schicht Laub"], ["steht seit Jahren neben", "braucht mehr als", "liegt im Schatten von", "wächst langsam über", "verträgt sich nicht mit", "wird im Herbst zu"], ["dem Zaun aus dem Jahr {n}", "der Mauer hinter dem Haus", "den {n} Stauden am Rand", "einer Bank, die niemand mehr nutzt", "dem Kompost in der Ecke"]),
    "fr": (["le vieux pont", "la piste du canal", "un frein usé", "la roue arrière", "notre mécanicien", "une pente douce", "le marché du samedi"], ["mène à", "est plus large que", "se trouve derrière", "a été réparé avant", "passe trop près de", "ressemble à"], ["la place où il y a {n} arbres", "une rue qui descend vers le port", "la gare et ses {n} quais", "un atelier que tout le monde connaît", "la maison du garde"]),
    "es": (["la cala pequeña", "el viejo faro", "una barca azul", "la marea baja", "el guarda del puerto", "un sendero de arena"], ["está muy cerca de", "llega hasta", "se ve mejor desde", "fue construido sobre", "queda detrás de", "no tiene más que"], ["la roca que cayó en {n}", "una casa con {n} ventanas", "el muelle donde se vende pescado", "la curva que da al norte", "un pinar que nadie cuida"]),
}


def phrase(rng: random.Random, lang: str) -> str:
    a, b, c = WORDS[lang]
    return f"{rng.choice(a)} {rng.choice(b)} {rng.choice(c)}".format(n=rng.randrange(3, 1990))


def sentence(rng: random.Random, lang: str) -> str:
    text = f"{phrase(rng, lang)} {({'en': 'and', 'de': 'und', 'fr': 'et', 'es': 'y'})[lang]} {phrase(rng, lang)}."
    return text[0].upper() + text[1:]


def site_pages(per_site: int = 12, seed: int = 11) -> tuple[list[dict], dict[tuple[int, int], bool]]:
    """Pages of the invented sites, and whether each non-blank line is boilerplate."""
    rng, rows, truth = random.Random(seed), [], {}
    for (lang, host), (menu, notice, byline, share, box, foot) in SITES.items():
        for k in range(per_site):
            page = len(rows)
            title = phrase(rng, lang).capitalize()
            lines: list[tuple[str, bool]] = [(x, True) for x in notice]
            lines += [(x, True) for x in menu] if k % 2 else [(" | ".join(menu), True)]
            lines += [("", True), (title, False), (byline, True)]
            for _ in range(rng.randrange(3, 6)):
                lines.append((" ".join(sentence(rng, lang) for _ in range(rng.randrange(1, 4))), False))
            if k % 3 == 0:
                lines += [(f"- {phrase(rng, lang)}", False) for _ in range(4)] + [(sentence(rng, lang), False)]
            lines += [(x, True) for x in share] + [(box, True)] + [(f"» {phrase(rng, lang)}", True) for _ in range(3)] + [("", True)]
            lines += [(x, True) for x in foot]
            rows.append({"page_id": page, "final_url": f"https://{host}/p/{k}", "title": title, "body": "\n".join(x for x, _ in lines)})
            truth |= {(page, i): bad for i, (x, bad) in enumerate(lines) if x}
    return rows, truth


#: Messages in place of content, none of which stands in the library or the test tables as a whole.
MESSAGES = {
    "error": [
        "The document you are looking for has been removed or renamed.", "This listing has expired and is no longer available.", "Whoops, the server couldn't handle your request. Please retry shortly.", "Our site is down for scheduled maintenance. We'll be back soon.",
        "Your session timed out. Please log in again.", "You are not authorized to access this resource.", "Service overloaded, please try again in 5 minutes.", "Uh oh, we couldn't find that article.", "410 Gone", "502 Bad Gateway", "Error establishing a connection to the server",
        "The requested file does not exist on this server.", "Connection refused by the database host.", "This account has been suspended. Contact support.", "We can't reach this page right now, please come back later.", "HTTP error 429: too many requests", "Sorry, something has gone wrong on our server.",
        "No hemos podido encontrar el recurso solicitado.", "El servicio está temporalmente fuera de servicio.", "Su sesión ha expirado, inicie sesión de nuevo.", "Algo ha salido mal en el servidor.", "Lo sentimos, el artículo ya no existe.", "Error 500 del servidor",
        "Die gesuchte Datei wurde verschoben oder gelöscht.", "Der Server ist derzeit nicht erreichbar. Bitte versuchen Sie es erneut.", "Ihre Sitzung ist leider abgelaufen.", "Hoppla, da ist etwas schiefgelaufen.", "Wegen Wartungsarbeiten vorübergehend offline", "Fehler 403: Zugriff verboten",
        "La ressource recherchée est introuvable.", "Le service est temporairement hors service.", "Désolé, ce document a été supprimé.", "Votre session a expiré, veuillez réessayer.", "Erreur 502 du serveur", "Oups, quelque chose s'est mal passé.",
        "De pagina bestaat niet meer.", "Sorry, deze pagina is niet gevonden.", "Er is een onverwachte fout opgetreden, probeer het later opnieuw.", "La pagina richiesta non è stata trovata.", "A página solicitada não foi encontrada.",
    ],
    "scripts": [
        "This application requires JavaScript to run.", "Please enable cookies in your browser to proceed.", "Your browser does not allow scripts; switch them on to view this page.", "Complete the captcha to confirm that you are human.", "You must activate JavaScript before this content can be displayed.",
        "Se necesitan cookies para continuar.", "Habilite los scripts de su navegador para ver esta página.", "Diese Anwendung benötigt JavaScript.", "Bitte erlauben Sie Cookies in Ihrem Browser.", "Ihr Browser wird geprüft, bitte warten.",
        "Cette application nécessite JavaScript.", "Activez les cookies de votre navigateur pour continuer.", "Zet JavaScript aan in je browser om deze pagina te zien.", "Per continuare è necessario abilitare JavaScript.",
    ],
    "filler": [
        "Enter your headline here", "This is a sample page.", "Placeholder text for the heading", "Replace this text with your own words.", "Blah blah blah", "Write your company description here.", "Dummy title", "Lorem ipsum dolor amet", "TBD",
        "Texto de relleno para la página", "Inserte aquí su título", "Platzhaltertext", "Geben Sie hier Ihren Text ein", "Mustertext für die Überschrift", "Écrivez votre texte ici", "Texte de remplissage", "Voer hier uw tekst in", "Untitled draft page",
    ],
}
#: Titles and descriptions about such things.
CONTENT = [
    "Why a 404 page needs a search box and three good links", "How we cut server errors by half during the sale", "A history of the captcha and its many critics", "Cookies with oats and dark chocolate", "What the placeholder attribute does in forms", "Maintenance windows for small clinics",
    "JavaScript frameworks compared by bundle size", "Lorem ipsum: where the text comes from", "Ten mistakes in error messages and how to write better ones", "Session length and bounce rate in online banking", "Access control lists for hospital networks", "The forbidden city in winter",
    "Denied boarding: what travellers can claim", "Gone fishing: a week on the Tay", "The missing link between rainfall and yield", "Broken bridges of the old railway", "Permission marketing after twenty years", "How to renew an expired passport", "Unexpected guests: dinner in thirty minutes",
    "Service roads of the northern harbour", "Los errores más comunes al podar un olivo", "Por qué caducan las cookies de sesión y qué hacer", "Mantenimiento de bicicletas de carga", "Fehlerkultur in Krankenhäusern", "Warum Wartung billiger ist als Reparatur", "Die verbotene Stadt im Schnee",
    "Erreurs de traduction dans les modes d'emploi", "Comment fonctionne la maintenance d'un tramway", "Les cookies du goûter, recette de famille", "Robots in the orchard: picking without people", "Please and thank you: manners across Europe", "The page that changed cartography", "Retry queues in message brokers", "Testing hypotheses with small samples",
    "Sample sizes for clinical trials", "A title for every lord: ranks explained", "Text and image in medieval books", "Click beetles of the upper meadow", "Hello from the lighthouse keeper", "New pages of an old diary",
]
