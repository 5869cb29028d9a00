"""Scalar functions against values stated here."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orgweave.functions import html as H
from orgweave.functions import names as N
from orgweave.functions import urls as U


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column("x").alias("y")).collect()]


ROOTS = {
    "https://WWW.Acme-Plumbing.test/services/?utm=x": "acme-plumbing.test",
    "blog.acme.co.uk": "acme.co.uk",
    "co.uk": "co.uk",
    "not a domain": None,
    "": None,
    None: None,
    " <acme.test> ": "acme.test",
    "http://user:pass@shop.acme.test:8080/x": "acme.test",
    "mailto:a@acme.test": "acme.test",
    "//x.acme.test/y": "acme.test",
    "acme.test.": "acme.test",
    "a..com": ".com",
    "192.168.0.1": None,
    "coming soon": None,
}


def test_root_domain(spark):
    assert values(spark, U.root_domain, list(ROOTS)) == list(ROOTS.values())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=30))
def test_root_of_root(spark, texts):
    once = values(spark, U.root_domain, texts)
    assert values(spark, U.root_domain, once) == once


def test_urls(spark):
    got = values(spark, U.canonical_url, ["HTTPS://A.Test//x//y/?q=1#f", "https://a.test", "http://a.test/x;p", None])
    assert got == ["https://a.test/x/y?q=1", "https://a.test/", "http://a.test/x", None]
    assert values(spark, U.url_key, ["http://www.a.test/x/", "https://a.test/x"]) == ["a.test/x", "a.test/x"]
    joins = lambda x: U.url_join(F.lit("https://a.test/b/c?q"), x)
    assert values(spark, joins, ["d", "/d", "//e.test/f", "?z", "#h", "https://g.test/", ""]) == [
        "https://a.test/b/d", "https://a.test/d", "https://e.test/f", "https://a.test/b/c?z", "https://a.test/b/c?q#h", "https://g.test/",
        "https://a.test/b/c?q",
    ]
    assert values(spark, U.unwrap_redirect, ["https://r.test/?uddg=https%3A%2F%2Fa.test%2F", "https://b.test/"]) == ["https://a.test/", "https://b.test/"]


def test_labels(spark):
    assert values(spark, N.clean_label, ["Summit Roofing logo", "logo of <b>Dune &amp; Co</b>", "Elm - client", None, "|"]) == [
        "Summit Roofing", "of Dune & Co", "Elm", "", "",
    ]
    assert values(spark, N.strip_cta, ["Shop the Dune", "Visit Elm website", "go to X"]) == ["Dune", "Elm", "go to X"]
    assert values(spark, N.file_name, ["/uploads/summit-roofing-logo-300x120.png", "/a/elm@2x.png", "/a/ABC-widgets_white.svg", "/a/9f86d081884c7d65.png", "/a/logo-dark.png"]) == [
        "Summit Roofing", "Elm", "ABC Widgets", "", "",
    ]
    assert values(spark, N.domain_name, ["acme-plumbing.test", "abc.test", None]) == ["Acme Plumbing", "ABC", ""]
    assert values(spark, N.title_name, ["How we grew Dune Bakery 300%", "Case Study: Elm Dental", "Scaling Oak to 4 Locations", "Fir: 312% More Leads", "Hello"]) == [
        "Dune Bakery", "Elm Dental", "Oak", "Fir", "",
    ]
    assert values(spark, N.name_key, ["Canyon Plumbing Co.", "canyon plumbing co", "The Group", None]) == ["canyon plumbing", "canyon plumbing", "the group", None]


@pytest.mark.parametrize(
    ("name", "ok"),
    [("Dune Bakery", True), ("logo", False), ("x", False), ("12 345", False), ("a@b.test", False), ("one two three four five six seven", False), ("Alpine Digital", False), ("photo.png", False), ("", False), (None, False)],
)
def test_plausible(spark, name, ok):
    got = values(spark, lambda x: N.plausible_name(x, F.lit("Alpine Digital Group"), F.lit("alpinedigital.test")), [name])
    assert got == [ok]


def test_same_brand(spark):
    df = spark.createDataFrame(
        [("Lakeside Dermatology", "lakesidederm.test", True), ("Summit Roofing", "mesa.test", False), ("Air", "airbnb.test", False), (None, "a.test", False), ("Oak Elm Fir", "oak-elm.test", True)],
        "n string, d string, want boolean",
    )
    assert all(r.want == r.got for r in df.withColumn("got", N.same_brand("n", "d")).collect())


def test_html(spark):
    page = "<html><script>var a='<p>x</p>'</script><p>One&nbsp;two<br>three</p><svg><text>no</text></svg><div>end</div></html>"
    assert values(spark, H.visible_text, [page, None, ""]) == ["One two . three . end .", None, ""]
    assert values(spark, H.js_rendered, ["<div id=\"root\"></div>", "<p>plain</p>", None]) == [True, False, False]
    assert values(spark, H.bot_wall, ["Just a moment...", "hello"]) == [True, False]
    assert values(spark, H.site_name, ["<title>Home: Elm Digital | Top agency</title>", "<h1>Oak</h1><title>x</title>", None]) == ["Elm Digital", "Oak", None]
    link = "<a href='/x'>1</a><a href=\"https://a.test/x\">2</a><a href='https://b.test/'>3</a><a href='#t'>4</a>"
    assert values(spark, lambda x: H.nav_links(x, F.lit("https://a.test/"), F.lit("a.test")), [link]) == [["https://a.test/x"]]
    assert values(spark, H.is_list, ["a.test\nb.test\n", "some words here", "<p>a.test</p>", "", None]) == [True, False, False, False, False]
    assert values(spark, lambda x: H.sentence_around(x, r"(?i)\btiktok\b"), ["First one. We run TikTok ads. Last.", "none"]) == ["We run TikTok ads", None]
