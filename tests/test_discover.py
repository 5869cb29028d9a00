"""Discovery on small pages."""

from pyspark.sql import functions as F

from orgweave.operators import discover as D

PROSE = "<p>First. We run TikTok ads for shops. Last.</p><a href='https://www.tiktok.com/@x'>us</a>"


def test_evidence(spark):
    rows = [(1, PROSE), (2, "<a href='https://tiktok.com/business'>b</a>"), (3, "<i class='icon-tiktok'></i>"), (4, "<p>none</p>"), (5, None)]
    df = spark.createDataFrame(rows, "i int, h string")
    got = {r.i: [(e.kind, e.term, e.context) for e in r.e] for r in df.select("i", D.by_strength(D.find_evidence(F.col("h"), F.lit("u"))).alias("e")).collect()}
    assert got[1] == [("service_copy", "tiktok", "We run TikTok ads for shops"), ("social_link", "tiktok", "link -> https://www.tiktok.com/@x")]
    assert got[2] == [("service_copy", "tiktok", "link -> https://tiktok.com/business")]
    assert got[3][0][0] == "markup_only" and got[4] == got[5] == []


def test_status_is_unknown_when_nothing_was_read(spark):
    rows = [("a", 1, 200, None, PROSE), ("b", 2, 0, "SSLError", None), ("c", 3, 200, None, "x"), ("d", 4, 200, None, "x"), ("d", 5, 200, None, "y")]
    df = spark.createDataFrame(rows, "agency string, page_id int, status int, error string, text string").withColumn("url", F.lit("u"))
    got = {r.agency: (r.status, r.mentions) for r in D.platform_status(df).collect()}
    assert got == {"a": ("checked", "yes"), "b": ("unreachable", None), "c": ("needs_manual_review", "no"), "d": ("checked", "no")}


def test_listings(spark):
    serp = '<a class="result__a" href="https://r.test/l/?uddg=https%3A%2F%2Felm.test%2F">Elm <b>Co</b></a><a href="https://elm.test/x"><h3>again</h3></a><a href="https://oak.test/"><h2>Oak</h2></a>'
    bare = 'see <span>href="https://fir.test/a"</span> href="https://facebook.com/"'
    df = spark.createDataFrame([(serp,), (bare,), (None,)], "h string")
    got = [[(x.domain, x.label) for x in r[0]] if r[0] is not None else None for r in df.select(D.search_results(F.col("h"))).collect()]
    assert got == [[("elm.test", "Elm Co"), ("oak.test", "Oak")], [("fir.test", "")], None]
    prof = '<title>Elm Digital | Dir</title><p>10 to 49 employees</p><a href="https://elm.test/">Visit website</a>'
    net = '<h1>Publicis</h1><a href="https://p.test/">Visit website</a>'
    df = spark.createDataFrame([(prof,), (net,), ("<p>no site</p>",)], "h string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(D.profile(F.col("h"))).collect()]
    assert got == [("elm.test", "Elm Digital", "10 to 49 employees"), None, None]
    df = spark.createDataFrame([("<a href='https://elm.test/'>Elm <i>x</i></a><a href='https://x.com/'>X</a><a href='/y'>y</a>",)], "h string")
    assert [tuple(x) for x in df.select(D.anchor_pairs(F.col("h"))).first()[0]] == [("Elm x", "elm.test")]


def test_guesses(spark):
    pages = spark.createDataFrame([(200, None, "<p>Dune Bakery of Elm</p>", "https://dunebakery.com/"), (200, None, "nothing", "https://oakco.com/")], "status int, error string, text string, url string")
    names = spark.createDataFrame([("Dune Bakery",), ("Oak Co",), ("X",), (None,)], "n string")
    assert {r.n: r.guess for r in D.verify_guesses(names, "n", pages).collect()} == {"Dune Bakery": "dunebakery.com", "Oak Co": None, "X": None, None: None}


def test_candidates_and_names(spark):
    home = "<title>Elm Digital - Home</title><a href='/our-work/big/one'>w</a><a href='/clients'>c</a><a href='/about'>a</a>"
    pages = spark.createDataFrame([("elm.test", 1, 200, None, home, "https://elm.test/"), ("elm.test", 2, 404, None, "x", "https://elm.test/z")], "agency string, page_id int, status int, error string, text string, url string")
    got = [r.url for r in D.candidate_pages(pages, most=3).orderBy("depth").collect()]
    assert "https://elm.test/clients" in got and len(got) == 3
    a = spark.createDataFrame([("elm.test", None, "candidate"), ("oak.test", "Oak", "candidate")], "agency_domain string, agency_name string, status string")
    assert {(r.agency_domain, r.agency_name, r.status) for r in D.enrich_names(a, pages).collect()} == {("elm.test", "Elm Digital", "candidate"), ("oak.test", "Oak", "candidate")}
    df = spark.createDataFrame([(["a"], [("G1", ["b", "a"])])], "own array<string>, c array<struct<id:string,labels:array<string>>>")
    assert df.select(D.merge_evidence(F.col("own"), F.col("c"))).first()[0] == "a; b (GTM:G1); a (GTM:G1)"


def test_annotations(spark):
    rows = [(["social_link"], ["meta"], "WEAK"), ([], ["reels"], "TARGET"), ([], [], None), (["service_copy", "markup_only"], [], None)]
    df = spark.createDataFrame(rows, "k array<string>, c array<string>, want string")
    assert all(r.want == r.got for r in df.withColumn("got", D.annotations(F.col("k"), F.col("c"))).collect())
