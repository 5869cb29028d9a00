"""Directories and search engines as data: where they list organisations, and how their pages name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.html import first_of
from orgweave.functions.urls import let, slug, url_join
from orgweave.sources.captured import plausible_root

# Key, name, listing address with {term}, {geo} and {geo_slug}, base, pattern of profile links, patterns of
# the link to the organisation's own site.
DIRECTORIES = (
    (
        "clutch", "Clutch", "https://clutch.co/agencies/digital-marketing?keyword={term}&location={geo}", "https://clutch.co",
        r'(?i)href="(/profile/[^"#?]+)"',
        (r'(?i)href="https?://clutch\.co/go/[^"]*?u=([^"&]+)"', r'(?i)class="[^"]*website-link[^"]*"[^>]*>\s*<a[^>]+href="([^"]+)"', r'(?i)<a[^>]+href="([^"]+)"[^>]*>\s*Visit [Ww]ebsite'),
    ),
    (
        "sortlist", "Sortlist", "https://www.sortlist.com/s/{term}-agencies/{geo_slug}", "https://www.sortlist.com",
        r'(?i)href="(/agency/[^"#?]+)"', (r'(?i)<a[^>]+href="(https?://(?!www\.sortlist)[^"]+)"[^>]*>\s*(?:Visit|Website)',),
    ),
    (
        "designrush", "DesignRush", "https://www.designrush.com/agency/digital-marketing/{geo_slug}?keyword={term}", "https://www.designrush.com",
        r'(?i)href="(/agency/profile/[^"#?]+)"', (r'(?i)<a[^>]+href="([^"]+)"[^>]*(?:rel="[^"]*nofollow[^"]*")?[^>]*>\s*Visit [Ww]ebsite',),
    ),
    (
        "upcity", "UpCity", "https://upcity.com/marketing-agencies/{geo_slug}?q={term}", "https://upcity.com",
        r'(?i)href="(/profiles/[^"#?]+)"', (r'(?i)<a[^>]+href="([^"]+)"[^>]*>\s*(?:Visit )?[Ww]ebsite',),
    ),
    (
        "agencyspotter", "Agency Spotter", "https://www.agencyspotter.com/search?q={term}%20{geo}", "https://www.agencyspotter.com",
        r'(?i)href="(/[a-z0-9\-]+/?)"\s*class="[^"]*agency', (r'(?i)<a[^>]+href="(https?://(?!www\.agencyspotter)[^"]+)"[^>]*>\s*(?:Visit|Website)',),
    ),
    (
        "google_partners", "Google Partners", "https://www.google.com/partners/agency-search?q={term}%20{geo}", "https://www.google.com",
        r'(?i)href="(/partners/agency\?id=[^"#]+)"', (r'(?i)<a[^>]+href="(https?://(?!\w+\.google\.com)[^"]+)"[^>]*>\s*(?:Visit|Website)',),
    ),
)
# Result pages of search engines.
SEARCH_ENGINES = (
    ("duckduckgo", "https://html.duckduckgo.com/html/?q={q}"), ("google", "https://www.google.com/search?q={q}&num=30"), ("bing", "https://www.bing.com/search?q={q}&count=30"),
)
#: Segment of listings that name no place.
ANYWHERE = "united-states"


def _filled(template: str, **slots: Column) -> Column:
    got = F.lit(template)
    for name, value in slots.items():
        got = F.replace(got, F.lit("{" + name + "}"), value)
    return got


def listing_urls(wanted: DataFrame) -> DataFrame:
    """(source, term, geo, url) of each wanted (term, geo), which may have no geo, in every directory and engine."""
    geo = F.coalesce("geo", F.lit(""))
    place = F.coalesce(F.nullif(slug(geo), F.lit("")), F.lit(ANYWHERE))
    query = F.url_encode(F.trim(F.concat(F.lit('"'), "term", F.lit(' marketing agency" '), geo)))
    term, where = F.url_encode("term"), F.url_encode(geo)
    urls = [F.struct(F.lit(k).alias("source"), _filled(t, term=term, geo=where, geo_slug=place).alias("url")) for k, _, t, *_ in DIRECTORIES]
    urls += [F.struct(F.lit(f"search:{k}").alias("source"), _filled(t, q=query).alias("url")) for k, t in SEARCH_ENGINES]
    return wanted.select("term", "geo", F.explode(F.array(*urls)).alias("_u")).select("_u.source", "term", "geo", "_u.url")


def profile_urls(html: Column, directory: Column) -> Column:
    """Addresses of the profiles a captured listing links to, in order, once each; NULL for unknown directories."""

    def joined(base: str, links: str) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(links), F.lit(1)), lambda p: url_join(F.lit(base), p)))

    got = F.lit(None).cast("array<string>")
    for key, _, _, base, links, _ in DIRECTORIES:
        got = F.when(directory == key, joined(base, links)).otherwise(got)
    return got


def profile_site(html: Column, directory: Column) -> Column:
    """Root of the site a captured profile names as its own; NULL where it names none or a platform."""
    got = F.lit(None).cast("string")
    for key, *_, sites in DIRECTORIES:
        got = F.when(directory == key, let(first_of(html, *sites), lambda x: plausible_root(F.try_url_decode(x)))).otherwise(got)
    return got
