"""Upserts, merges, resolution and feedback on small fixtures."""

import random

from pyspark.sql import functions as F

from orgweave.operators import extract, feedback, health, resolve, upsert
from orgweave.functions.names import name_key


def test_coalescing_upsert(spark):
    rows = [(1, "A", "x", None), (2, "a ", "", "p"), (3, None, "z", "z"), (4, "a", "y", " "), (5, "b", None, None)]
    df = spark.createDataFrame(rows, "seq int, k string, f string, g string")
    once = upsert.coalescing_upsert(df, ["k"], ["f", "g"], "seq")
    got = {r.key: (r.first_seq, r.f, r.g, r.puts) for r in once.collect()}
    assert got == {"a": (1, "y", "p", 3), "b": (5, None, None, 1)}
    again = upsert.coalescing_upsert(once.drop("puts").withColumnRenamed("key", "k"), ["k"], ["f", "g"], "first_seq")
    assert {(r.key, r.f, r.g) for r in again.collect()} == {(k, v[1], v[2]) for k, v in got.items()}


def test_order_does_not_matter(spark):
    rows = [(i, random.Random(i).choice("abc"), random.Random(i * 7).choice(["", "x", "y", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "seq int, k string, f string")
    one = {r.key: r.f for r in upsert.coalescing_upsert(df, ["k"], ["f"], "seq").collect()}
    two = {r.key: r.f for r in upsert.coalescing_upsert(df.repartition(7).orderBy(F.rand(3)), ["k"], ["f"], "seq").collect()}
    assert one == two


def test_merge(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, s int, v string")
    new = spark.createDataFrame([("a", 5, "n1"), ("a", 6, "n2"), ("b", 7, "m"), (None, 8, "q")], "k string, s int, v string")
    got = {(r.k, r.s, r.v, r.action) for r in upsert.merge_last_wins(old, new, "k", "s").collect()}
    assert got == {("a", 1, "n2", "updated"), ("a", 2, "y", "kept"), (None, 3, "z", "kept"), ("b", 7, "m", "appended"), (None, 8, "q", "appended")}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, s int, v string")
    assert upsert.merge_last_wins(e, e, "k", "s").count() == 0
    assert upsert.first_wins(e, ["k"], "s").count() == 0


RECORDS = [
    # agency, seq, name, domain, source, confidence, method, derived
    ("g.test", 1, "Lakesidederm", "lakesidederm.test", "l", "high", "outbound_link", True),
    ("g.test", 2, "Lakeside Dermatology", None, "t", "low", "case_study_title", False),
    ("g.test", 3, "Canyon Plumbing", None, "f", "medium", "image_filename", False),
    ("g.test", 4, "Canyon Plumbing Co.", None, "a", "medium", "alt_text", False),
    ("g.test", 5, "Oak Elm", "oak-elm.test", "l", "high", "outbound_link", False),
    ("h.test", 6, "Lakeside Dermatology", None, "t", "low", "case_study_title", False),
    ("g.test", 7, "The", None, "x", "low", "alt_text", False),
]
SCHEMA = "agency string, seq bigint, client_name string, client_domain string, source string, confidence string, method string, derived boolean"


def test_resolution(spark):
    got = {(r.agency, r.client_name): r for r in resolve.fold_pages(spark.createDataFrame(RECORDS, SCHEMA)).collect()}
    lake = got["g.test", "Lakeside Dermatology"]
    assert (lake.client_domain, lake.methods, lake["rank"]) == ("lakesidederm.test", ["case_study_title", "outbound_link"], 0)
    assert got["h.test", "Lakeside Dermatology"].client_domain is None
    canyon = got["g.test", "Canyon Plumbing Co."]
    assert (canyon["rank"], canyon.source.split(" | ")[0]) == (0, "alt_text+image_filename")
    assert len(got) == 5


def test_rules(spark):
    c = resolve.fold_pages(spark.createDataFrame(RECORDS, SCHEMA))
    key = lambda s: spark.range(1).select(name_key(F.lit(s))).first()[0]
    names = spark.createDataFrame([(key("Oak Elm"), "Oak & Elm")], "key string, correct string")
    domains = spark.createDataFrame([(key("Oak & Elm"), "oakelm.test")], "key string, correct string")
    junk = spark.createDataFrame([("canyonplumbing", "g.test"), ("lakeside dermatology", "other.test")], "form string, agency string")
    levels = spark.createDataFrame([("case_study_title", "medium")], "method string, level string")
    got = {(r.agency, r.client_name): r for r in resolve.final(resolve.apply_rules(c, names, domains, junk, levels)).collect()}
    assert got["g.test", "Oak & Elm"].client_domain == "oakelm.test" and got["g.test", "Oak & Elm"].confidence == "high"
    assert ("g.test", "Canyon Plumbing Co.") not in got
    assert got["h.test", "Lakeside Dermatology"].confidence == "medium"


HTML = """<title>Case Study: Fir Solar</title>
<img alt="Dune Bakery logo" src="data:x" data-lazy-src="/uploads/dune.png"><img alt="icon" src="/icons/a.png">
<img alt="" src="/uploads/ridge-dental-logo-2x.png"><a href="https://oak.test/x">Shop Oak Furniture</a>
<a href="https://facebook.com/a">Facebook</a><a href="/about">About</a><p>Site by <a href="https://maker.test">Maker</a></p>
<a href="https://elm.test/"><img alt="Elm Dental" src="/uploads/e.png"></a>"""


def test_extractors(spark):
    page = spark.createDataFrame(
        [(1, "https://alpine.test/clients", HTML, "Alpine", "alpine.test"), (2, "https://alpine.test/x", None, "Alpine", "alpine.test")],
        "page_id bigint, page_url string, html string, agency_name string, agency_domain string",
    )
    got = {m: {(r.client_name, r.client_domain) for r in f(page).collect()} for m, f in extract.EXTRACTORS.items()}
    assert got["alt_text"] == {("Dune Bakery", None), ("Elm Dental", None)}
    assert got["image_filename"] == {("Dune", None), ("Ridge Dental", None)}
    assert got["outbound_link"] == {("Oak Furniture", "oak.test"), ("Elm Dental", "elm.test")}
    assert got["case_study_title"] == {("Fir Solar", None)}


def test_feedback(spark):
    rows = [(i, "good" if i < 19 else "bad", "n", "alt_text", "client", "a.test", None) for i in range(20)]
    rows += [(50, "rename", "x", "title", "client", "a.test", "y"), (51, "nope", "x", "", "client", None, None), (52, "bad", "", "", "client", None, None),
             (53, "wrong_domain", "x", "title", "client", "a.test", "not a domain"), (54, "missed", "", "", "client", None, "z"), (55, "bad", "bad.test", "", "client", None, None)]
    v = spark.createDataFrame(rows, "seq bigint, verdict string, entity_key string, method string, entity_type string, agency_domain string, correct_value string")
    checked = feedback.validate(v)
    assert checked.filter("reason IS NOT NULL").count() == 3
    stats = feedback.method_stats(checked)
    assert {r.method: (r.good, r.bad) for r in stats.collect()} == {"alt_text": (19, 1), "title": (0, 2), "(unrecorded)": (0, 1)}
    assert [tuple(r) for r in feedback.retune(stats).collect()] == [("alt_text", "high")]
    assert feedback.fold_rules(checked).count() == feedback.fold_rules(feedback.validate(v.union(v))).count()  # replay


def test_health(spark):
    runs = [("a", i, 0, i == 3) for i in range(6)] + [("b", i, 5, i > 3) for i in range(6)] + [("c", i, 0, False) for i in range(2)]
    df = spark.createDataFrame(runs, "source string, run int, found int, blocked boolean")
    assert {r.source: r.finding for r in health.health(df).collect()} == {"a": "dead: blocked", "b": "unreliable", "c": "dead: layout changed"}
