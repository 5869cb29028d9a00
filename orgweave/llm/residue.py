"""Template residue and error-page text: what a line shows, and which pages it rules out.

Lines are counted by host in normalised form (case, digits and marks taken off) where the host's expression is
inferred; what recurs there is boilerplate. The residual is searched sentence by sentence with a small grammar of
word classes instead of fixed messages:

* message      something of the page (THING) in a state of failure (FAIL), a demand for scripts, cookies, a
               sign-in or a human, a status line, or the trace of a program
* filler       Latin dummy text by its share of words, words or sentences said again and again, and an order to
               the author (EDIT) about the text that is to stand there (CONTENT)
* placeholder  template syntax, or a value no template meant to show

A sentence that *mentions* such a thing is no evidence: the thing is indefinite or plural ("a page", "its pages",
"error pages"), stands in a conditional about others, is an example ("such as"), a named kind of syntax ("the
{{x}} token"), or is quoted. Classes hold words of English, French, German and Spanish.

Defined results: lines and texts of any length are searched whole; NULL and empty texts have no lines.
"""

from __future__ import annotations

import re
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.operators.skew import spread_join

NONE, MESSAGE, FILLER, PLACEHOLDER = 0, 2, 3, 4


def _any(*words: str) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


# Things of a page that can fail, in the singular.
THING = _any(
    "page", "site", "webpage", "url", "link", "address", "resource", "request", "requests", "account", "server", "service", "content", "document",
    "file", "folder", "directory", "connection", "gateway", "domain(?: name)?", "browser", "application", "app", "host", "access", "session",
    "article", "product", "profile", "database", "bandwidth", "what you",
    "(?:web)?seite", "website", "adresse", "inhalt", "anfrage", "dienst", "konto", "zugriff", "verbindung", "datei", "browser", "server",
    "contenu", "ressource", "requ[êe]te", "compte", "acc[èe]s", "connexion", "serveur", "fichier", "navigateur", "domaine", "lien",
    "p[áa]gina", "sitio", "direcci[óo]n", "contenido", "recurso", "solicitud", "servicio", "cuenta", "acceso", "conexi[óo]n", "servidor",
    "archivo", "navegador", "dominio", "enlace",
)
# States of failure.
FAIL = _any(
    "not (?:be )?found", "(?:can.?t|cannot|can not|could(?: not|n.t)|unable to|failed to) (?:\\w+ ){0,2}?(?:find|found|reach|reached|load|loaded|display|displayed|"
    "connect|process|processed|open|opened|finish|complete|completed|access|locate|located|serve|served)", "no longer (?:\\w+ )?(?:exists?|available|here)",
    "(?:does(?: not|n.t)|never|do not) exist(?:ed)?", "not (?:currently |yet |publicly )?(?:available|accessible|published|allowed|permitted|authori[sz]ed)",
    "unavailable", "denied", "forbidden", "refused", "rejected", "blocked", "suspended", "disabled", "expired", "parked", "for sale", "timed out",
    "time-?out", "too many", "(?:limit|quota) (?:exceeded|reached)", "out of date", "not supported", "(?:has|have|was) (?:been )?(?:moved|removed|renamed|deleted)",
    "went wrong", "technical (?:difficulties|problems?|issues?)", "(?:unexpected|internal|fatal) (?:\\w+ )?(?:condition|error)", "down for maintenance",
    "under (?:construction|maintenance)", "don.t have permission", "nothing (?:\\w+ )?(?:lives|exists|found|here|at this)", "bad (?:gateway|request)",
    "nicht (?:mehr )?(?:gefunden|verf[üu]gbar|erreichbar|erlaubt|geladen|existier\\w+)", "existiert nicht", "verweigert", "gesperrt", "abgelaufen", "im aufbau",
    "wartungsarbeiten", "fehlgeschlagen", "zu verkaufen", "steht zum verkauf", "introuvable", "n.existe (?:plus|pas)", "(?:n.a )?pas (?:[ée]t[ée] )?trouv[ée]+", "n.est (?:plus|pas) (?:disponible|accessible)",
    "indisponible", "refus[ée]e?", "interdit", "suspendue?", "expir[ée]e?", "en (?:construction|maintenance)", "[àa] vendre",
    "no (?:se )?(?:ha |pudo )?(?:sido )?(?:encontr\\w+|cargar)", "no existe", "no (?:est[áa] )?disponible", "denegad[oa]", "prohibid[oa]", "suspendid[oa]",
    "caducad[oa]", "en (?:construcci[óo]n|mantenimiento)", "en venta", "demasiadas",
)
SCRIPT = _any("javascript", "scripts?", "scripting", "cookies")
ENABLE = _any(
    "enabled?", "activated?", "turn(?:ed)? (?:it )?(?:on|off)", "switch(?:ed)? (?:it )?(?:on|off)", "disabled", "requires?", "required", "needs?", "must",
    "unterst[üu]tz\\w+", "aktivier\\w+", "ben[öo]tigt?", "erforder\\w+", "einschalten", "deaktiviert", "activer", "activez", "n[ée]cessite", "requiert", "requise?",
    "d[ée]sactiv[ée]e?", "active", "activar", "habilit\\w+", "requiere", "necesita", "necesari[oa]", "desactivad[oa]",
)
# A thing named so is meant in general or belongs to others.
_VAGUE = r"(?:\b(?:an?|any|every|each|some|many|most|few|its|their|his|her|whose|no|one|old|other|ein|eine|einer|jede|jeder|viele|une?|des|chaque|leurs?|ses|una?|cada|sus?|muchas|muchos)\s+(?:\w+\s+){0,2})$"
_POINTED = re.compile(r"\b(?:this|that|the requested|your|you|we|sorry|oops|please|diese[rsm]?|leider|bitte|sie|cette|cet|d[ée]sol[ée]e?|vous|veuillez|est[ea]|lo sentimos|por favor|error)\b", re.I)
_OTHERS = re.compile(r"^(?:if|when|whenever|while|because|since|where|wenn|falls|weil|si|quand|lorsque|cuando|porque)\b", re.I)
_YOU = re.compile(r"\b(?:you|your|sie|ihr\w*|vous|votre|usted|su|please|bitte)\b", re.I)
_PEOPLE = re.compile(r"(?<=[a-zà-ÿ,:] )[A-Z][a-z]+ [A-Z][a-z]+")  # a name of two words inside the sentence
#: A failure is said of a thing not far from it.
_NEAR = 60
_FAIL = re.compile(rf"\b{FAIL}(?!\w)", re.I)
_THING = re.compile(rf"\b{THING}\b", re.I)
_BARE = re.compile(r"^(?:this|it|that|that.s|it.s)\b", re.I)
_SCRIPTED = re.compile(rf"\b{SCRIPT}\b[^.!?]{{0,{_NEAR}}}?\b{ENABLE}(?!\w)|\b{ENABLE}[^.!?]{{0,{_NEAR}}}?\b{SCRIPT}\b", re.I)
# Demands, refusals and traces that name no failing thing.
_PLAIN = re.compile(
    "|".join(
        (
            r"^(?:error |http )?[45]\d\d\b(?:\W+|$)(?:.*\b(?:error|found|forbidden|unauthori[sz]ed|gone|gateway|unavailable|request|timeout|denied|introuvable|gefunden|encontrad\w)\b.*)?$",
            r"^(?:page |seite |p[áa]gina )?(?:not found|nicht gefunden|no encontrad[oa]|introuvable)\W*$|^(?:access denied|forbidden|unauthori[sz]ed|bad gateway|coming soon)\b",
            r"^(?:please )?(?:log|sign) ?in to (?:see|view|continue|access|read)\b",
            r"\b(?:verify|confirm|prove|check)\w*\b.{0,30}\b(?:human|robot|browser)\b|\bcaptcha\b.{0,40}\b(?:complete|solve|below)|^just a moment\W*$|^(?:loading|please wait)(?:\W+(?:loading|please wait))?\W*$",
            r"^(?:traceback \(most recent|stack trace)|^\s*file \"[^\"]+\", line \d+|^\w*(?:error|exception): |^(?:fatal|parse|syntax|uncaught) error\b|^warning: \w+\(|\bon line \d+$|\buncaught \w*error\b|^error (?:establishing|connecting|loading)\b",
            r"\b(?:default|test) (?:web ?)?page\b.*\bserver\b|\bserver\b.*\b(?:installed|working|running)\b.*\b(?:default|page|successfully)\b|^it works!?$",
            r"\bdomain\b.{0,40}\bregist(?:rar|ered|er)\b|\bbuy (?:this|the) domain\b",
        )
    ),
    re.I,
)
# Latin dummy text, public since the typesetters' sheets.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nunc eget vestibulum porta "
    "nec vitae nibh eros lacus vel mauris donec pellentesque vivamus fusce cras integer praesent".split()
)
_LATIN_SURE = frozenset("lorem ipsum amet consectetur adipiscing eiusmod vestibulum nibh incididunt".split())
CONTENT = _any("text", "paragraph", "headline", "heading", "title", "words", "content", "copy", "description", "post", "site", "website", "page", "service", "image", "caption", "sentences?", "bio", "tagline",
               "texte", "titre", "contenu", "überschrift", "inhalt", "absatz", "texto", "t[íi]tulo", "contenido")
_EDIT = r"(?:click|edit|replace|change|delete|insert|add|enter|type|write|describe|customi[sz]e|double-?click|cliquez|remplacez|modifiez|ajoutez|klicken|ersetzen|f[üu]gen|haga|reemplace|escriba|edite)"
_ORDER = re.compile(
    rf"^(?:please |then |or |to )?{_EDIT}\b(?=.*\b{CONTENT}\b)(?=.*\b(?:your|you|here|this|own|edit|ici|votre|hier|ihren?|aqu[íi]|su)\b)|^(?:your|the|add|some|ihre?|votre|su|tu) (?:\w+ )?{CONTENT} (?:goes |comes |here|hier|ici|aqu[íi])+(?:here)?\W*$"
    rf"|^{CONTENT} (?:goes|comes) here\W*$|\b(?:sample|dummy|placeholder|example) {CONTENT}\W*$|\bthis is (?:a|your|the) (?:sample|dummy|placeholder|first|example|new) {CONTENT}\b|^welcome to your new {CONTENT}",
    re.I,
)
# Where an order to the author may begin.
_ORDERED = re.compile(rf"(?:^|[.!?…]\s+|^[#*->•· ]+)(?:please |then |or |to )?{_EDIT}\b|(?:^|[.!?…]\s+)\w+ (?:\w+ )?(?:\w+ )?(?:here|hier|ici|aqu[íi])\W|\b(?:here|sample|dummy|placeholder|example|first|new)\b", re.I)
_FIELD = "(?:name|company|client|customer|city|date|year|month|phone|title|address|e-?mail|state|street|service|brand|number|amount|price|url|website|location|role|position|testimonial|quote|text|headline|image|logo|industry|product|agency|author|business)"
_PLACEHOLDER = re.compile(
    "|".join(
        (
            r"\{\{[^{}]{0,60}\}\}|\$\{[^{}]{1,60}\}|<%=?[^%]{0,60}%>|\{%[^%]{0,60}%\}|%%\w+%%|\*\|\w+\|\*|@@\w+@@|\[\[\w[^\]]{0,40}\]\]",
            r"(?<![\w#])#[A-Z][A-Z_]+#|(?<!\w)__[A-Z][A-Z_]*__(?!\w)|\{(?:[A-Za-z]+(?:[_. ][A-Za-z]+)*|\d)\}|%[A-Z][A-Z_]+%|(?<=\s)%s(?!\w)|^%s |\{%\w\}",
            rf"\[(?:insert\b[^\]]{{0,40}}|(?:(?:your|client|company|first|last|full|the|our|business|street|phone|contact|agency|job) )?{_FIELD}(?: (?:name|here|number|address|title))?)\]",
            rf"\[(?:INSERT\b[^\]]{{0,40}}|[A-Z]+ (?:NAME|HERE|TITLE))\]|<(?:Your|Company|Client|First|Last|Insert) ?[A-Z]?\w*>|\bYOUR (?:COMPANY|NAME|CITY|BRAND)\b",
            r"\bXX+(?:%|\b)|\[object \w+\]|\bundefined\b|\bNaN\b|\bnull\b(?! and void| hypothes| result)",
        )
    ),
    re.I,
)
# Patterns above that mean something only as capitals or as written.
_CASED = re.compile(r"^(?:XX+%?|#[A-Z_]+#|__[A-Z_]+__|%[A-Z_]+%|YOUR [A-Z]+|NaN|null|undefined|\[[^\]]+\]|<[A-Z]\w+ ?\w*>|[{$%*@<\[].*|%s ?)$")
_SYNTAX = r"(?:tags?|tokens?|placeholders?|variables?|fields?|snippets?|syntax|codes?|strings?|merge \w+|templates?|marker|markers|shortcodes?)"
_NAMED_BEFORE = re.compile(rf"\b{_SYNTAX}\b(?:\s+(?:such as|like|called|named|use[sd]?|using|contain\w*|with|of the form|hold|holds|need|needs|are|is|as))?[\s:,(\"'`]*$|[\"'`“]$|\b(?:such as|e\.g\.|for example)\s+\w*\s*[\"'`]?$", re.I)
_NAMED_AFTER = re.compile(rf"^[\"'`”]?\s+{_SYNTAX}\b", re.I)
_DETERMINED = re.compile(r"\b(?:the|an?|this|that|each|every|our|their|le|la|der|die|das|el)\s+[\"'`]?$", re.I)
_GERMAN = re.compile(r"\b(?:der|die|das|und|mit|auf|für|wir|von|nicht)\b")

# Literals of the classes above: a line without those of a class needn't be searched for it.
_HINTS = {
    1: (
        "not found", "not be found", "can't", "can’t", "cannot", "can not", "couldn", "could not", "unable to", "failed to", "no longer", "exist", "available", "accessible", "not published", "not yet", "allowed",
        "permi", "authori", "denied", "forbid", "refus", "reject", "blocked", "suspend", "disabled", "expir", "parked", "for sale", "timed out", "timeout", "time-out", "too many", "exceeded",
        "quota", "limit reached", "out of date", "not supported", "moved", "renamed", "removed", "deleted", "went wrong", "technical", "unexpected", "internal", "fatal", "maintenance", "under construction", "en construc", "nothing ",
        "bad gateway", "bad request", "gefunden", "verfügbar", "verfugbar", "erreichbar", "erlaubt", "geladen", "existier", "verweigert", "gesperrt", "abgelaufen", "im aufbau", "wartungs", "fehlgeschlagen",
        "verkauf", "introuvable", "trouv", "indisponible", "interdit", "à vendre", "a vendre", "encontr", "cargar", "disponible", "denegad", "prohibid", "caducad", "manteni", "en venta", "demasiadas",
        "maintenance", "publicly", "currently",
    ),
    2: ("javascript", "script", "cookies"),
    4: (" here", " hier", " ici", " aquí", " aqui", "sample ", "dummy ", "placeholder", "example ", "this is a", "this is your", "this is the", "your new "),
    32: (
        "click", "edit", "replace", "change", "delete", "insert", "add ", "enter ", "type ", "write", "describe", "customi", "cliquez", "remplac", "modifi", "ajout", "klick", "ersetz", "füg", "fug",
        "haga", "reempla", "escrib",
    ),
    64: (
        "{", "[", "<", "@@", "%%", "*|", "__", "undefined", "nan", "null", "your company", "your name", "your city", "your brand", "xx", *[m + c for m in "%#" for c in "abcdefghijklmnopqrstuvwxyz"],
    ),
    8: (
        "found", "gefunden", "encontrad", "introuvable", "access denied", "forbidden", "unauthor", "bad gateway", "coming soon", "log in", "sign in", "login", "human", "robot", "browser", "captcha",
        "moment", "loading", *[e + c for e in (". ", "! ", "? ", "error ", "http ") for c in "45"], "please wait", "traceback", "stack trace", 'file "', "error", "exception", "warning:", "on line", "server", "it works", "domain",
    ),
    16: ("lorem", "ipsum", "amet", "consectetur", "adipiscing", "eiusmod", "vestibulum", "nibh", "incididunt"),
}
_MARKS = re.compile(r"[{\[<]|@@|%%|\*\||__|%s|%[A-Z]|#[A-Z]|undefined|NaN|null|YOUR |XX")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[a-zà-ÿ]+")
_CODED = re.compile(r"(?:^|[.!?…]\s+)(?:error |http )?[45]\d\d\b", re.I)



def _thrice(low: str) -> bool:
    """A word stands three times running."""
    words = low.split()
    if True not in map(eq, words, words[1:]):
        return False
    return any(a == b == c.rstrip(".,!?…") for a, b, c in zip(words, words[1:], words[2:]) if len(a) > 1)


try:
    import ahocorasick

    _AUTOMATON = ahocorasick.Automaton()
    for _bit, _words in _HINTS.items():
        for _w in _words:
            _AUTOMATON.add_word(_w, _bit | _AUTOMATON.get(_w, 0))
    _AUTOMATON.make_automaton()

    def _hints(low: str) -> int:
        got = 0
        for _, bit in _AUTOMATON.iter(low):
            got |= bit
        return got
except ImportError:

    def _hints(low: str) -> int:
        return sum(bit for bit, words in _HINTS.items() if any(w in low for w in words))


def _unfilled(text: str, start: int) -> bool:
    """Whether a placeholder beginning at or after ``start`` was left in the text, and isn't what it is about."""
    for m in _PLACEHOLDER.finditer(text):
        if m.end() <= start or not _CASED.match(m.group()):
            continue
        before, after = text[: m.start()], text[m.end() :]
        if m.group() in ("null", "undefined") and _GERMAN.search(text):
            continue
        if _NAMED_BEFORE.search(before) or (_NAMED_AFTER.match(after) and _DETERMINED.search(before)):
            continue
        return True
    return False


def _vague(sentence: str, at: int) -> bool:
    return re.search(_VAGUE, sentence[:at], re.I) is not None


#: Characters of a sentence that belongs to the message it stands beside.
BESIDE = 80


def _failed(s: str) -> bool:
    """A thing of the page is said to have failed."""
    for m in _FAIL.finditer(s):
        left = s[max(0, m.start() - _NEAR) : m.start()]
        things = list(_THING.finditer(left))
        if things:
            vague = _vague(left, things[-1].start())
        else:
            t = _THING.search(s, m.end(), m.end() + _NEAR)
            if t is None and not (_BARE.match(s) and m.start() < 24):
                continue
            vague = t is not None and _vague(s[m.end() :], t.start() - m.end())
        if vague or (_PEOPLE.search(s) and not _POINTED.search(s)):
            continue
        # a short remark, or one that points at what the visitor asked for
        if len(s) <= 80 or _POINTED.search(s):
            return True
    return False


def _message(s: str, hints: int) -> bool:
    """Whether a sentence is a message to the visitor, not about one."""
    s = s.strip().lstrip("#*->•· ")
    if (hints & 8 or s[:1] in "45") and _PLAIN.search(s):
        return True
    if _OTHERS.match(s) and not _YOU.search(s):
        return False
    if hints & 2:
        m = _SCRIPTED.search(s)
        if m and (len(s) <= 40 or not _vague(s, m.start())) and (not _PEOPLE.search(s) or _POINTED.search(s)):
            return True
    return bool(hints & 1) and _failed(s)


def _filler(s: str, hints: int) -> bool:
    if hints & 16:
        words = _WORD.findall(s.lower())
        if sum(w in _LATIN for w in words) * 2 >= len(words):
            return True
    return _thrice(s.lower()) or (bool(hints & 36) and _ORDER.search(s.strip()) is not None)


def weighed(text: str, before: str = "") -> tuple[int, int, int]:
    """(kind, size, weight) of a line: the kind of residue, the characters that show it, those of running text
    beside them. ``before`` is the line this one goes on from, where a sentence was wrapped; it only helps to
    tell what is mentioned."""
    low = text.lower()
    hints = _hints(low)
    if hints & 64 and _MARKS.search(text):
        lead = before[-60:] + " " if before else ""
        if _unfilled(lead + text, len(lead)):
            return PLACEHOLDER, len(text), weight(text)
    if not hints & 27 and text[:1] not in "45" and not (hints & 36 and _ORDERED.search(text)) and not _thrice(low):
        return NONE, len(text), weight(text)
    kinds = []
    latin = False
    sentences = _SENTENCE.split(text)
    for k, s in enumerate(sentences):
        whole = before[-60:] + " " + s if k == 0 and before else s
        hints = _hints(whole.lower()) if len(sentences) > 1 or before else hints
        # what follows lorem ipsum in its line belongs to it
        latin = latin or "lorem ipsum" in s.lower()
        kinds.append(FILLER if latin else MESSAGE if _message(whole, hints) else FILLER if _filler(whole, hints) else NONE)
    sizes = {MESSAGE: 0, FILLER: 0}
    for k, s in enumerate(sentences):
        kind = kinds[k]
        if not kind and len(s) <= BESIDE:  # a greeting before it, what to do now after it
            kind = max(kinds[max(k - 2, 0) : k + 2])
        if kind:
            sizes[kind] += len(s)
    bad = sum(sizes.values())
    if not bad:
        return NONE, len(text), weight(text)
    rest = len(text) - bad - (len(sentences) - 1)
    return max(sizes, key=sizes.get), bad, rest if rest > 20 else 0


def evidence(text: str) -> int:
    """Kind of residue in a line, 0 for none."""
    return weighed(text)[0]


def weight(text: str) -> int:
    """Characters of running text; headings and labels, short and without a full stop, weigh nothing."""
    return len(text) if len(text) > 50 or text[-1:] in ".!?…”\"" else 0


#: Share of a page's running main text that must be messages or filler.
RESIDUE = 0.5


def residue_pages(lines: DataFrame) -> DataFrame:
    """Pages to exclude, from their lines (page_id, framed, size, weight, kind, hash); weight is beside what shows residue.

    A page goes when a placeholder was left unfilled in its main text, or when messages and filler make at least
    ``RESIDUE`` of its running text. Boilerplate has been subtracted by host; a recurrent line that shows residue is
    taken back where most of its pages hold no other running text: then it is what the host has to say (a parked
    site, a refusal), while a footer or cookie bar stands beside real text.
    """
    bare = lines.filter("NOT framed").groupBy("page_id").agg(F.sum("weight").alias("_good"))
    again = lines.filter("framed AND kind > 0").join(bare, "page_id", "left").withColumn("_alone", F.coalesce("_good", F.lit(0)) == 0)
    own = again.groupBy("hash").agg(F.avg(F.col("_alone").cast("double")).alias("_a")).filter("_a > 0.5").select("hash")
    taken = spread_join(again.filter("_alone"), own, ["hash"], "inner")
    cols = ["page_id", "size", "weight", "kind"]
    every = lines.filter("NOT framed").select(cols).unionByName(taken.select(cols))
    is_bad = F.col("kind").isin(MESSAGE, FILLER)
    per = every.groupBy("page_id").agg(
        F.sum(F.when(is_bad, F.col("size")).otherwise(0)).alias("bad"), F.sum("weight").alias("good"),
        F.max(F.col("kind") == PLACEHOLDER).alias("unfilled"),
        F.max(F.col("kind") == MESSAGE).alias("message"), F.max(F.col("kind") == FILLER).alias("filler"),
    )
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    return per.filter(F.col("unfilled") | ((F.col("bad") > 0) & (share >= RESIDUE))).select("page_id", "unfilled", "message", "filler")
