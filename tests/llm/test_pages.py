from orgweave.llm import residue as R
from orgweave.llm import wrappers as W

FRAME_TOP, FRAME_END = ["Home", "About > Work > {slug}", "We use cookies. Accept all."], ["© 2024 Elm. All rights reserved.", "Follow us: A B"]


def page(i, body, site="a.test", url=None):
    slug = f"story{i}"
    top = [x.format(slug=slug) for x in FRAME_TOP]
    return (i, site, url or f"https://{site}/{slug}", "\n".join([*top, *body, *FRAME_END]))


BODIES = [[f"Story number {i} has its own words about subject {chr(97 + i) * 5}.", f"Another line that only page {chr(97 + i) * 4} has."] for i in range(12)]


def lines_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, domain string, url string, text string")
    lines = W.page_lines(df)
    bad = {r.page_id for r in R.residue_pages(lines).collect()}
    got = {}
    for r in W.main_lines(lines, R.residue_pages(lines)).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    return got, bad


def test_frames_are_taken_off(spark):
    rows = [page(i, b) for i, b in enumerate(BODIES)]
    rows += [page(50, ["Too many requests. Slow down and retry later."]), page(51, ["Lorem ipsum dolor sit amet, consectetur."]), page(52, ["Hi {{city}}, thanks for reading."])]
    rows += [page(53, BODIES[0]), (54, "a.test", "https://a.test/n", None), (55, "a.test", "https://a.test/e", "")]
    got, bad = lines_of(spark, rows)
    assert bad == {50, 51, 52}
    assert all(got[i] == {4, 5} for i in range(12)) and not {50, 54, 55} & set(got)


def test_markup(spark):
    html = lambda i, t: (i, "b.test", f"https://b.test/p{i}", f'<html><head><title>b</title></head><body>\n<nav><a href="/">Home</a></nav>\n<main>\n<p>{t}</p>\n</main>\n<footer>Bye</footer>\n</body></html>')
    got, _ = lines_of(spark, [html(i, BODIES[i][0]) for i in range(6)] + [html(9, "A lone page on the matter.")])
    assert all(v == {4} for v in got.values()) and len(got) == 7


def test_small_sites_learn_from_large_ones(spark):
    rows = [page(s * 100 + i, [f"{b[0]} {s}", f"{b[1]} {s}"], f"s{s}.test") for s in range(4) for i, b in enumerate(BODIES[:6])]
    rows.append(page(999, ["Only page of its site, with some text."], "tiny.test"))
    got, _ = lines_of(spark, rows)
    assert got[999] == {4}


def test_one_site_however_it_is_cut(spark, monkeypatch):
    """Sections with frames of their own; equal rows whole, by blocks of 8 pages, and read again for its length."""
    rows = []
    for i in range(90):
        section = ["Shop", "Basket"] if i % 2 else ["Journal", "Archive"]
        body = [f"Line {chr(97 + i % 26) * 3} of page {chr(97 + i // 26) * 4} alone, number {i}.", *(["Services"] if i == 40 else [])]
        rows.append((i, "a.test", f"https://a.test/{i % 2}/{i}", "\n".join(["Home", "Services", *section, *body, "Terms", "Imprint"])))
    rows += [(1000 + i, *rows[i][1:]) for i in range(10)]
    whole, _ = lines_of(spark, rows)
    assert all(5 in v and not {1, 2, 3, 4} & v for v in whole.values())
    monkeypatch.setattr(W, "BLOCK", 8)
    cut, _ = lines_of(spark, rows)
    monkeypatch.setattr(W, "BLOCK", 512)
    monkeypatch.setattr(W, "HOLD", 300)
    again, _ = lines_of(spark, rows)
    assert whole == cut == again


def test_the_tree_is_fixed_by_the_pages():
    import random

    rng = random.Random(5)
    pages = sorted((rng.getrandbits(64) - (1 << 63), [t for t in "abcdefgh" if rng.random() < 0.6] + [f"x{i}"]) for i in range(200))
    whole = W.infer(pages)
    for bits in (1, 3, 6):
        tree, part = W.Tree(), {}
        for h, tokens in pages:
            part.setdefault(h >> (64 - bits), []).append((h, tokens))
        for _, own in sorted(part.items()):
            tree.add(own[0][0], W.infer(own))
        got = tree.done()
        assert (got.tokens, got.support, got.pages) == (whole.tokens, whole.support, whole.pages)


def parsed(rows):
    """What the workers make of whole hosts: {page: lines that are no frame by their host alone}."""
    import pyarrow as pa

    rows = sorted((site, 0, True, hash(url), i, url, text) for i, site, url, text in rows)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=list("abcdefg"))
    got = {}
    for b in W._infer(W.HOLD)(iter([batch])):
        for r in b.to_pylist():
            if r["page_id"] is not None and not r["framed"]:
                got.setdefault(r["page_id"], set()).add(r["line_no"])
    return got


def test_alignment_decides(monkeypatch):
    """A heading that equals a menu entry lies in the slot, not at the entry's place: a count of equal lines drops it."""
    rows = [page(i, ["Work", *b] if i == 3 else b) for i, b in enumerate(BODIES)]
    rows = [(i, s, u, t.replace("Home", "Home\nWork\nPrices")) for i, s, u, t in rows]
    got = parsed(rows)
    assert got[3] == {6, 7, 8} and got[4] == {6, 7}
    monkeypatch.setattr(W.Reader, "supports", lambda self, kept, at: [self.total.get(kept[k], 1) for k in at])
    assert parsed(rows)[3] == {7, 8}


def test_expressions():
    w = W.infer((k, p) for k, p in enumerate([["a", "x1", "z"], ["a", "b", "x2", "z"], ["a", "b", "x3", "z", "z"], ["b", "a", "z"]]))
    assert w.pages == 4 and sum(s for t, s in zip(w.tokens, w.support) if t == "a") == 4 == sum(s for t, s in zip(w.tokens, w.support) if t == "z")
    r = W.Reader(w)
    read = lambda tokens: r.supports(*W.squares(tokens))
    assert read(["a", "q", "z", "z"]) == [4, 1, 4, 4]  # optional b is missing, z repeats
    assert read(["a", "q", "a", "z"])[2] == 1  # a second "a" lies in the slot
    assert W.squares(["m", "n", "m", "n", "o"]) == (["m", "n", "o"], [0, 1, 0, 1, 2])
    assert W.align(list("abcxd"), list("abdxc")) == [(0, 0), (1, 1), (3, 3)] or len(W.align(list("abcxd"), list("abdxc"))) == 3
    long = W.infer((k << 50, ["a", f"y{k}", "z"]) for k in range(100))
    assert long.tokens == ["a", "z"] and long.support == [100, 100]


def test_evidence():
    e = R.evidence
    assert e("Access denied. Your request was blocked by a security rule.") == R.MESSAGE
    assert e("404 - Page not found") == R.MESSAGE and e("Please enable JavaScript to view this page.") == R.MESSAGE
    assert e("Bitte aktivieren Sie JavaScript, um fortzufahren.") == R.MESSAGE and e("Désolé, cette page n'existe plus.") == R.MESSAGE
    assert e("TBD TBD TBD") == R.FILLER and e("Your headline here") == R.FILLER
    assert e("Welcome to [object Object], your partner.") == R.PLACEHOLDER and e("Meet the team at <Your Name>.") == R.PLACEHOLDER
    assert e("We use %CITY% tags such as {{first_name}} sparingly, since [object Object] fails.") == R.PLACEHOLDER
    assert R.weighed("as {{first_name}} sparingly, since a greeting", "We have long been using merge tags such")[0] == R.NONE
    for text in (
        "We use merge tags such as {{first_name}} sparingly, since a greeting that fails looks worse than none.",
        "Good error pages matter: Elm turned its 404 page into a search box and saved 3 visits a day.",
        "40% of calls came after closing time.", "There were 20 tags on the page and only three of them sent anything useful.", "",
        "If a site shows nothing without scripts, our reader sees an empty grid.",
        "Our templates use {{first_name}} only when the list is clean.", "Explaining the {{first_name}} token to clients takes five minutes.",
    ):
        assert e(text) == R.NONE, text


# Written after the grammar, none of it used in building it.
HELD_OUT = (
    "Sorry, we can’t find that page.", "You need to switch on JavaScript before continuing.", "Oups, la page demandée est introuvable.", "Ce site nécessite JavaScript.",
    "Hello [First Name],", "Dear {FirstName},", "This link has expired.", "Your session has timed out.", "The server is down for maintenance.", "Diese Domain steht zum Verkauf.",
    "Cette page n'existe plus.", "El sitio está en mantenimiento.", "Necesita activar JavaScript para usar este sitio.", "Der Dienst ist zurzeit nicht erreichbar.",
    "Your account has been disabled.", "HTTP 502 Bad Gateway", "No se ha encontrado la página solicitada.", "Zugriff verweigert.", "Accès refusé.", "Something went wrong while loading this page.",
    "Lorem ipsum dolor", "Add your headline here", "Insert a short description of your business here.", "Thank you, [Customer Name], for your order.", "Starting at ${price} a month.",
    "Veuillez activer JavaScript dans votre navigateur.", "Please confirm you are not a robot.", "The file you requested could not be located.", "Remplacez ce texte par le vôtre.", "Hier steht Ihr Text. Ersetzen Sie diesen Absatz.",
)
HELD_OUT_TEXT = (
    "We found that the landing page was slow.", "Cookies are baked fresh every morning.", "Nothing beats a clear headline.", "Elm Partners blocked three placements last year.",
    "The team could not find a cheaper channel, so it kept print.", "Nous avons trouvé une page plus simple pour les clients.", "Wir haben die Seite neu gebaut.", "La página de inicio pesa más que un anuncio.",
    "Her site was down for a day in March and nobody called.", "A page that cannot be found costs a sale.", "Most sites require JavaScript today.", "How to write a description that sells.",
    "Click rates rose by half.", "Our service is available in four cities.", "He removed the link from the footer.", "Access to the account was given to Elm Media in May.", "They replaced the title of every page.", "Write short sentences.",
)


def test_held_out_wording():
    found = [x for x in HELD_OUT if R.evidence(x)]
    wrong = [x for x in HELD_OUT_TEXT if R.evidence(x)]
    print("missed", [x for x in HELD_OUT if x not in found], "wrong", wrong)
    assert len(found) >= 0.9 * len(HELD_OUT) and len(found) >= 0.9 * (len(found) + len(wrong))


def test_recurrent_evidence(spark):
    """A footer that failed is boilerplate beside text; the one line of a parked host is what it says."""
    rows = [(i, "f.test", f"https://f.test/{i}", "\n".join(["Home", *b, "© {{year}} Elm", "This site requires cookies."])) for i, b in enumerate(BODIES)]
    rows += [(100 + i, "p.test", f"https://p.test/{i}", "Home\nThis domain is parked.") for i in range(6)]
    got, bad = lines_of(spark, rows)
    assert bad == {100 + i for i in range(6)} and all(got[i] == {2, 3} for i in range(12))


def test_long_lines_are_searched_and_judged(spark):
    talk = "Our team of Elm wrote about the matter at length and with care for each reader of it. "
    assert R.evidence("Lorem ipsum dolor sit amet. " + "Consectetur adipiscing elit sed do eiusmod. " * 8) == R.FILLER
    assert R.evidence(talk * 4 + "The request was blocked.") == R.MESSAGE and R.evidence("Sorry, your request was blocked") == R.MESSAGE
    assert R.evidence(talk * 4) == R.NONE
    cookie = "We and our partners keep small files on your device to measure visits and to show what you may like. " * 3
    rows = [page(i, [cookie, *b]) for i, b in enumerate(BODIES[:6])]
    rows += [page(70, ["Lorem ipsum dolor sit amet. " + "Consectetur adipiscing elit sed do eiusmod. " * 8]), page(71, [talk * 8 + "The request was blocked."])]
    got, bad = lines_of(spark, rows)
    assert bad == {70} and all(got[i] == {5, 6} for i in range(6)) and got[71] == {4}


def test_copies_of_expressions_are_not_broadcast(spark, monkeypatch):
    rows = [page(s * 10 + i, BODIES[i], f"s{s}.test") for s in range(4) for i in range(3)]
    monkeypatch.setattr(W, "BLOCK", 2)
    plans, keep = [], W.stage
    monkeypatch.setattr(W, "stage", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if name == "parsed" else None, keep(df, name))[1])
    got = []
    for most in (1 << 22, 0):  # all expressions sent once, and none
        monkeypatch.setattr(W, "SENT", most, raising=False)
        got.append(lines_of(spark, rows))
    sent, joined = plans
    assert "_salt" not in sent and "SortMergeJoin" in joined and got[0] == got[1] and len(got[0][0]) == 12
