"""Captured pages and pasted text: page caches, saved HTML, sitemaps, JSON trees, lists of addresses."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgweave.functions.html import HREF, is_list, strip_tags
from orgweave.functions.urls import canonical_url, root_domain, same_site, unwrap_redirect
from orgweave.operators.upsert import row_number_over
from orgweave.shipping import ship
from orgweave.staging import stage

PAGE_SCHEMA = "url string, status int, text string, error string, from_cache boolean, final_url string, content_type string"
# Domains that stand on listings and that no agency has.
NON_AGENCY = (
    "clutch.co", "sortlist.com", "designrush.com", "upcity.com", "agencyspotter.com",
    "google.com", "facebook.com", "instagram.com", "linkedin.com", "twitter.com",
    "x.com", "youtube.com", "tiktok.com", "pinterest.com", "vimeo.com",
    "wordpress.org", "wordpress.com", "wix.com", "squarespace.com", "godaddy.com",
    "hubspot.com", "shopify.com", "mailchimp.com", "semrush.com", "ahrefs.com",
    "gstatic.com", "googleapis.com", "cloudflare.com", "amazonaws.com",
    "bing.com", "duckduckgo.com", "yelp.com", "glassdoor.com", "indeed.com",
    "crunchbase.com", "medium.com", "github.com", "apple.com", "microsoft.com",
    "adobe.com", "salesforce.com", "trustpilot.com", "g2.com", "capterra.com",
    "partners.tiktok.com", "business.tiktok.com", "goodfirms.co", "themanifest.com",
    "expertise.com", "agencyvista.com", "wadline.com",
    "jsdelivr.net", "unpkg.com", "bootstrapcdn.com", "fontawesome.com",
    "cloudfront.net", "akamaized.net", "typekit.net", "imgix.net", "gravatar.com",
    "googletagmanager.com", "google-analytics.com", "googleadservices.com",
    "doubleclick.net", "recaptcha.net", "youtu.be", "youtube-nocookie.com",
    "w3.org", "schema.org", "creativecommons.org",
    "wpengine.com", "kinsta.com", "siteground.com", "webflow.io", "myshopify.com",
    "vercel.app", "netlify.app", "herokuapp.com", "wp.com",
    "klaviyo.com", "calendly.com", "hotjar.com", "intercom.com", "zendesk.com",
    "typeform.com", "stripe.com", "paypal.com", "zoom.us", "reddit.com",
    "threads.net", "snapchat.com", "tumblr.com", "substack.com", "houzz.com",
    "angi.com", "thumbtack.com", "bbb.org", "nextdoor.com",
)
STRICT_TLDS = "com|net|org|co|io|agency|marketing|digital|media|us|biz|studio|group"


def cache_key(url: Column) -> Column:
    return F.sha1(url)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Pages cached as JSON: files whose name ends in .jsonl hold one a line, all others one a file (over several lines
    or not). Entries that can't be read are left out; refusals stay."""
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("_file"))
    lines = F.when(F.lower("_file").endswith(".jsonl"), F.split("value", r"\r?\n")).otherwise(F.array("value"))
    one = raw.select(F.explode(lines).alias("_j")).filter(F.trim("_j") != "")
    schema = PAGE_SCHEMA + ", _corrupt_record string"
    read = one.select(F.from_json("_j", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("p")).select("p.*")
    return read.filter("_corrupt_record IS NULL AND url IS NOT NULL").drop("_corrupt_record").withColumn("key", cache_key(F.col("url")))


def write_cache(pages: DataFrame, path: str) -> None:
    pages.withColumn("key", cache_key(F.col("url"))).write.mode("append").parquet(path)


def read_saved_html(spark: SparkSession, glob: str) -> DataFrame:
    """(file, html) of saved pages."""
    return spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("html"))


#: Character sets by the names pages give them, and the decoder each needs.
CHARSETS = {
    "ISO-8859-1": ("iso-8859-1", "latin-1", "latin1", "iso_8859-1", "windows-1252", "cp1252", "us-ascii", "ascii"),
    "UTF-16": ("utf-16", "unicode"), "UTF-16LE": ("utf-16le",), "UTF-16BE": ("utf-16be",), "UTF-32": ("utf-32",),
}
#: Sets of one byte a character beyond these: the characters of bytes 128 to 255, made by their public tables.
SINGLE_BYTE = {
    "windows-1250": "cp1250", "iso-8859-2": "iso8859-2", "windows-1251": "cp1251", "koi8-r": "koi8-r", "iso-8859-5": "iso8859-5", "windows-1253": "cp1253",
    "iso-8859-7": "iso8859-7", "windows-1254": "cp1254", "iso-8859-9": "iso8859-9", "iso-8859-15": "iso8859-15", "windows-1257": "cp1257",
}


def _high(codec: str) -> str:
    return "".join(bytes([b]).decode(codec, "replace") for b in range(128, 256))


def decode_page(body: Column, content_type: Column) -> Column:
    """Text of a binary body: by its byte-order mark, else the header's character set, else the one its head declares,
    else UTF-8 where that reads without fault, else Latin-1. NULL for types that are no text."""
    latin = F.decode(body, "ISO-8859-1")
    head = F.substring(latin, 1, 4096)
    named = F.nullif(F.lower(F.regexp_extract(content_type, r"(?i)charset=[\"']?([\w-]+)", 1)), F.lit(""))
    meta = F.nullif(F.lower(F.regexp_extract(head, r"(?i)<(?:meta[^>]+charset|\?xml[^>]+encoding)=[\"']?([\w-]+)", 1)), F.lit(""))
    mark = F.when(head.startswith("\u00ef\u00bb\u00bf"), "utf-8").when(head.startswith("\u00ff\u00fe") | head.startswith("\u00fe\u00ff"), "utf-16")
    cs = F.coalesce(mark, named, meta)
    utf8 = F.try_validate_utf8(body.cast("string"))
    text = F.when(cs == "utf-8", F.decode(body, "UTF-8"))
    for decoder, names in CHARSETS.items():
        text = text.when(cs.isin(*names), F.decode(body, decoder))
    low = "".join(map(chr, range(128, 256)))
    for name, codec in SINGLE_BYTE.items():
        text = text.when(cs == name, F.translate(latin, low, _high(codec)))
    texty = content_type.isNull() | F.lower(content_type).rlike("text|html|xml|json|javascript")
    return F.when(texty, F.regexp_replace(text.otherwise(F.coalesce(utf8, latin)), "^\ufeff", ""))


def outbound_domains(html: Column, base: Column) -> Column:
    """Roots that markup links to, in order, once each, without the base's own and those no agency has."""
    roots = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)href=["'](https?://[^"'<>]+)["']"""), F.lit(1)), lambda h: plausible_root(h))
    return F.array_distinct(F.filter(roots, lambda r: r.isNotNull() & ~r.eqNullSafe(root_domain(base))))


def plausible_root(raw: Column) -> Column:
    """Root an agency could have: no platform, no authority, no content network."""
    r = root_domain(raw)
    bad = r.isin(*NON_AGENCY) | r.rlike(r"\.(gov|edu|mil)$") | r.rlike(r"(?:cdn|static|assets|img|images|fonts|track|analytics)\.")
    return F.when(~bad, r)


def pasted_domains(text: Column) -> Column:
    """Roots in pasted text, in order, once each: redirects opened; any ending in a list, known ones in prose."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(r"""(?i)https?://[^\s"'<>)\]}]+"""), F.lit(0)), unwrap_redirect)
    name = r"(?i)\b(?:www\.)?([a-z0-9][a-z0-9-]{0,61}(?:\.[a-z0-9][a-z0-9-]{0,61})*\.(?:%s))\b"
    loose = F.regexp_extract_all(text, F.lit(name % "[a-z]{2,24}"), F.lit(1))
    strict = F.regexp_extract_all(text, F.lit(name % STRICT_TLDS), F.lit(1))
    roots = F.transform(F.concat(urls, F.when(is_list(text), loose).otherwise(strict)), plausible_root)
    return F.array_distinct(F.filter(roots, lambda r: r.isNotNull()))


def sitemap_urls(pages: DataFrame, most: int = 3000, indexes: int = 8, levels: int = 8) -> DataFrame:
    """(site, url) from captured sitemaps (site, url, text): a map that says ``<sitemapindex`` is opened, the first
    ``indexes`` of a site with four times as many entries each, level by level; one beyond that is read as a map of
    pages. Addresses are canonical, of the site, once each, at most ``most`` of them."""
    loc = F.regexp_extract_all("text", F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    maps = pages.select("site", "url", F.lower("text").contains("<sitemapindex").alias("_index"), loc.alias("_locs")).filter(F.size("_locs") > 0)
    maps = stage(maps, "sitemaps")
    w = Window.partitionBy("site").orderBy("url")
    front = maps.filter(F.col("url").rlike(r"/sitemap[^/]*\.xml(?:\.gz)?$|/sitemap/?$")).withColumn("_left", F.lit(indexes)).withColumn("_level", F.lit(0))
    found, done = None, front.select("site", "url")
    for _ in range(levels):
        nth = F.sum(F.col("_index").cast("int")).over(w)
        front = front.withColumn("_open", F.col("_index") & (nth <= F.col("_left")))
        leaf = front.filter("NOT _open").select("site", "_level", F.col("url").alias("at"), F.posexplode("_locs").alias("ord", "loc"))
        found = leaf if found is None else found.unionByName(leaf)
        used = F.sum(F.col("_open").cast("int")).over(Window.partitionBy("site"))
        nxt = front.withColumn("_left", F.col("_left") - used).filter("_open")
        nxt = nxt.select("site", F.explode(F.slice("_locs", 1, indexes * 4)).alias("url"), "_left", (F.col("_level") + 1).alias("_level"))
        nxt = nxt.groupBy("site", "url").agg(F.min("_left").alias("_left"), F.min("_level").alias("_level")).join(done, ["site", "url"], "left_anti")
        front = stage(nxt.join(maps, ["site", "url"]), "sitemaps")
        if front.isEmpty():
            break
        done = done.unionByName(front.select("site", "url"))
    own = found.select("site", canonical_url("loc").alias("url"), F.struct("_level", "at", "ord").alias("_o")).filter(same_site("url", "site"))
    own = own.groupBy("site", "url").agg(F.min("_o").alias("_o"))
    return row_number_over(own, ["site"], [F.col("_o"), F.col("url")], most).select("site", "url")


# Keys that hold addresses and names in captured JSON, at any depth.
URL_KEYS = ("website", "web_site", "site", "url", "company_url", "homepage", "company_website", "partner_url", "link")
NAME_KEYS = ("name", "company_name", "partner_name", "title", "display_name", "companyName", "partnerName", "displayName")


# Domains of such pages that are no record.
JSON_NOISE = (
    "tiktok.com", "bytedance.com", "byteoversea.com", "tiktokglobalshop.com",
    "facebook.com", "twitter.com", "linkedin.com", "instagram.com", "youtube.com",
    "google.com", "apple.com", "microsoft.com",
)


def _nodes(tree: object) -> Iterator[tuple[str, list[str]]]:
    """(name, addresses) of every object of a tree that has a key for addresses, in document order."""
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if any(k in x for k in URL_KEYS):
                said = lambda keys: [x[k].strip() for k in keys if isinstance(x.get(k), str) and x[k].strip()]  # noqa: B023, E731
                yield (said(NAME_KEYS) or [""])[0], said(URL_KEYS)
            stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))


def json_pairs(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, ord, name, domain) anywhere in JSON trees of any depth: the first address of an object that is a domain, or
    its name alone if short; texts that are no JSON give none.

    Trees of unknown shape need a walk, which SQL's recursion bounds by rows; this walks each text alone.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ords, names, urls = [], [], [], []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    tree = json.loads(t or "")
                except (ValueError, RecursionError):
                    continue
                for i, (n, u) in enumerate(_nodes(tree)):
                    rows.append(r), ords.append(i), names.append(n), urls.append(u)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ords, pa.int32()), pa.array(names, pa.string()), pa.array(urls, pa.list_(pa.string()))],
                names=["row", "ord", "name", "urls"],
            )

    found = df.select(F.col(row).cast("bigint").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(run, "row bigint, ord int, name string, urls array<string>")
    domain = F.get(F.filter(F.transform("urls", lambda u: root_domain(u)), lambda d: d.isNotNull() & ~d.isin(*JSON_NOISE)), 0)
    found = found.select("row", "ord", "name", domain.alias("domain"))
    return found.filter("domain IS NOT NULL OR (name <> '' AND length(name) < 80)")


# Scripts that carry a page's data, and variables it is assigned to.
_BLOB = r"""(?is)<script[^>]*(?:id=["'](?:__NEXT_DATA__|__INITIAL_STATE__)["']|type=["']application/json["'])[^>]*>(.*?)</script>"""
_ASSIGNED = r"(?s)window\.(?:__INITIAL_STATE__|__NUXT__|__DATA__)\s*=\s*(\{.*?\})\s*[;<]"


def embedded_json(html: Column) -> Column:
    """JSON that a page carries in its scripts."""
    return F.concat(F.regexp_extract_all(html, F.lit(_BLOB), F.lit(1)), F.regexp_extract_all(html, F.lit(_ASSIGNED), F.lit(1)))


def captured_pairs(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, name, domain), once each, of captures that are JSON, or else markup with JSON in its scripts and anchors."""
    src = df.select(F.col(row).cast("bigint").alias("row"), F.col(text).alias("text"))
    is_json = F.ltrim("text").rlike(r"^[\[{]")
    trees = src.select("row", F.explode(F.when(is_json, F.array("text")).otherwise(embedded_json(F.col("text")))).alias("text"))
    walked = json_pairs(trees, "row", "text").select("row", "name", "domain")
    anchors = F.regexp_extract_all("text", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    a = src.filter(~is_json).select("row", F.explode(anchors).alias("a"))
    domain = root_domain(F.regexp_extract("a", HREF, 1))
    a = a.select("row", F.substring(strip_tags("a"), 1, 80).alias("name"), domain.alias("domain")).filter(F.col("domain").isNotNull() & ~F.col("domain").isin(*JSON_NOISE))
    return walked.unionByName(a).distinct()
