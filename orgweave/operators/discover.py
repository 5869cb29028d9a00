"""Finding organisations and evidence on captured pages: mentions, listings, profiles, page selection.

The platform looked for is a parameter (terms and its domain). A page that could not be read leaves its
flag unknown; only read pages can say no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions import lists
from orgweave.functions.html import (
    HREF, OG_NAME, TITLE, clean_title, employee_range, first_of, hrefs, nav_links, plain_text, sentence_around, site_name, squeeze, strip_tags,
    visible_text,
)
from orgweave.functions.names import is_network, tokens
from orgweave.functions.urls import blank_to_null, canonical_url, let, path_depth, root_domain, slug, unwrap_redirect, url_key, url_part
from orgweave.operators.health import page_failure
from orgweave.operators.upsert import first_wins, row_number_over
from orgweave.sources.captured import plausible_root

# How the platform is named in prose, where its own pages are, and strength of evidence.
TERMS = (("tiktok", r"(?i)tik\s?tok"), ("ttq", r"(?i)\bttq\b"), ("spark ads", r"(?i)\bspark\s+ads?\b"))
PLATFORM = "tiktok.com"
STRENGTH = ("pixel", "service_copy", "social_link", "markup_only")
# Paths where client lists are looked for.
CLIENT_PATHS = (
    "/clients", "/our-clients", "/work", "/our-work", "/case-studies",
    "/case-study", "/portfolio", "/results", "/who-we-work-with", "/projects",
    "/success-stories", "/customers", "/partners", "/testimonials",
)

# Words of addresses that describe services, and paths where such pages are looked for.
SERVICE_URL_WORDS = (
    "service", "what-we-do", "whatwedo", "capabilit", "solution", "paid-media",
    "paidmedia", "social", "advertis", "media-buying", "mediabuying", "ppc",
    "paid-search", "paid-social", "expertise", "channel", "offering", "marketing",
)
SERVICE_PATHS = (
    "/services", "/what-we-do", "/capabilities", "/solutions", "/paid-media",
    "/social", "/social-media", "/services/paid-media", "/services/social-media",
    "/what-we-do/paid-media", "/expertise", "/our-services", "/advertising",
    "/paid-social", "/media-buying", "/digital-marketing",
)


def service_url(url: Column | str) -> Column:
    """Whether an address is shaped like a page that describes services."""
    return F.lower(url_part(url, 3)).rlike("|".join(SERVICE_URL_WORDS))


def find_evidence(html: Column, url: Column, terms=TERMS, platform: str = PLATFORM) -> Column:
    """Array of (kind, term, url, context): one mention a term in prose, the first link to the platform, and
    only if there is neither the first tag that names it."""

    def item(kind: Column, term: str, context: Column) -> Column:
        return F.struct(kind.alias("kind"), F.lit(term).alias("term"), url.alias("url"), context.alias("context"))

    def prose(text: Column) -> Column:
        def mention(term: str, pattern: str) -> Column:
            return let(sentence_around(text, pattern), lambda c: F.when(c.isNotNull(), item(F.lit("service_copy"), term, c)))

        return F.array_compact(F.array(*[mention(n, p) for n, p in terms]))

    name, pattern = terms[0]
    link = F.get(F.filter(hrefs(html), lambda h: F.lower(h).contains(platform)), 0)
    business = platform.replace(".", r"\.") + "/(business|ads|partners)"
    linked = let(
        link,
        lambda h: F.when(
            h.isNotNull(),
            item(F.when(F.lower(h).rlike(business), "service_copy").otherwise("social_link"), name, F.concat(F.lit("link -> "), F.substring(F.trim(h), 1, 160))),
        ),
    )
    tag = F.get(F.filter(F.regexp_extract_all(html, F.lit(r"<[^>]+>"), F.lit(0)), lambda t: t.rlike(pattern)), 0)
    traced = let(tag, lambda t: F.when(t.isNotNull(), item(F.lit("markup_only"), name, F.substring(squeeze(t), 1, 200))))
    strong = F.concat(let(visible_text(html), prose), F.array_compact(F.array(linked)))
    both = let(strong, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array_compact(F.array(traced))))
    return F.coalesce(both, F.array().cast("array<struct<kind:string,term:string,url:string,context:string>>"))


def by_strength(evidence: Column, most: int = 6) -> Column:
    """The strongest first, in the order found; at most ``most``."""
    ranked = F.transform(
        evidence,
        lambda e, i: F.struct(F.array_position(F.array(*[F.lit(k) for k in STRENGTH]), e["kind"]).alias("r"), i.alias("i"), e.alias("e")),
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda x: x["e"])


def platform_status(pages: DataFrame) -> DataFrame:
    """(agency, status, mentions, kinds, evidence, pages_read) of each site's pages (agency, page_id, url,
    status, error, text): unreachable with an unknown flag when none was read; one read page without
    evidence needs a person, though its flag is no."""
    read = page_failure(F.col("status"), F.col("error"), F.col("text")) == ""
    p = pages.withColumn("_e", F.when(read, by_strength(find_evidence(F.col("text"), F.col("url")))))
    per = p.groupBy("agency").agg(
        F.count(F.when(F.col("_e").isNotNull(), 1)).alias("pages_read"),
        F.min_by(F.when(F.size("_e") > 0, F.col("_e")), F.when(F.size("_e") > 0, F.col("page_id"))).alias("evidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("_e", lambda e: e["kind"]))))).alias("kinds"),
    )
    found = F.size("kinds") > 0
    status = F.when(F.col("pages_read") == 0, "unreachable").when((F.col("pages_read") < 2) & ~found, "needs_manual_review").otherwise("checked")
    mentions = F.when(F.col("pages_read") > 0, F.when(found, "yes").otherwise("no"))
    text = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("["), e["kind"], F.lit("] "), e["url"], F.lit(" :: "), e["context"])), " || ")
    return per.select("agency", status.alias("status"), mentions.alias("mentions"), "kinds", text.alias("evidence"), "pages_read")


def annotations(kinds: Column, mentioned: Column) -> Column:
    """WEAK when all evidence is a link or markup; TARGET when there is none but other video channels are named."""
    weak = (F.size(kinds) > 0) & F.forall(kinds, lambda k: k.isin("social_link", "markup_only"))
    target = (F.size(kinds) == 0) & F.arrays_overlap(mentioned, F.array(F.lit("meta"), F.lit("youtube"), F.lit("reels")))
    return F.when(weak, "WEAK").when(target, "TARGET")


def parse_status(pages_read: Column, clients: Column, drawn: Column) -> Column:
    """unreachable and needs_manual_review leave the count unknown; no_clients_found is a real zero."""
    return (
        F.when(pages_read == 0, "unreachable").when((clients == 0) & drawn, "needs_manual_review").when(clients == 0, "no_clients_found").otherwise("clients_parsed")
    )


def search_results(html: Column) -> Column:
    """Array of (domain, label) of a result page: result links and headed links, else every link; redirects
    opened, each domain once."""
    result = r"""(?is)<a[^>]+class="[^"]*result__a[^"]*"[^>]+href="[^"]+"[^>]*>.*?</a>"""
    headed = r"""(?is)<a[^>]+href="https?://[^"]+"[^>]*>\s*<h[23][^>]*>.*?</h[23]>"""
    named = F.concat(F.regexp_extract_all(html, F.lit(result), F.lit(0)), F.regexp_extract_all(html, F.lit(headed), F.lit(0)))
    bare = F.regexp_extract_all(html, F.lit(r"""(?i)href="https?://[^"]+\""""), F.lit(0))
    links = let(named, lambda n: F.when(F.size(n) > 0, n).otherwise(bare))

    def read(a: Column) -> Column:
        href = unwrap_redirect(F.regexp_extract(a, r"""(?i)href="([^"]+)\"""", 1))
        return F.struct(plausible_root(href).alias("domain"), F.when(a.startswith("<"), strip_tags(a)).otherwise("").alias("label"))

    def once(rows: Column) -> Column:
        return F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, 1, i), lambda q: q["domain"] == r["domain"]))

    return let(F.filter(F.transform(links, read), lambda r: r["domain"].isNotNull()), once)


# Shapes of a profile's link to the organisation's own site, in this order.
WEBSITE_LINKS = (
    r"""(?i)href="https?://[^"/]+/go/[^"]*?u=([^"&]+)\"""",
    r"""(?i)class="[^"]*website-link[^"]*"[^>]*>\s*<a[^>]+href="([^"]+)\"""",
    r"""(?i)<a[^>]+href="([^"]+)"[^>]*>\s*Visit website""",
)


def profile(html: Column) -> Column:
    """(domain, name, staff) of a directory profile; NULL without a site of its own or for a network."""
    site = F.try_url_decode(first_of(html, *WEBSITE_LINKS))
    row = F.struct(plausible_root(site).alias("domain"), site_name(html).alias("name"), employee_range(plain_text(html)).alias("staff"))
    return let(row, lambda r: F.when(r["domain"].isNotNull() & ~is_network(r["name"]), r))


def anchor_pairs(html: Column, noise: tuple[str, ...] = lists.BOILERPLATE_DOMAINS) -> Column:
    """Array of (name, domain) of a page's anchors, without the noise."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    read = lambda a: F.struct(F.substring(strip_tags(a), 1, 80).alias("name"), root_domain(F.regexp_extract(a, HREF, 1)).alias("domain"))
    return F.filter(F.transform(anchors, read), lambda r: r["domain"].isNotNull() & ~r["domain"].isin(*noise))


def enrich_names(agencies: DataFrame, pages: DataFrame, domain: str = "agency_domain") -> DataFrame:
    """Agencies with blank names filled from the first page of their site; networks and unread pages marked."""
    home = pages.select(root_domain("url").alias("_root"), "page_id", page_failure(F.col("status"), F.col("error"), F.col("text")).alias("_fail"), "text")
    home = home.filter("_root IS NOT NULL").groupBy("_root").agg(F.min_by(F.struct("_fail", "text"), "page_id").alias("_p"))
    a = agencies.withColumn("_key", root_domain(domain)).join(home, F.col("_key") == F.col("_root"), "left")
    blank = blank_to_null(F.col("agency_name")).isNull()
    named = clean_title(F.coalesce(first_of(F.col("_p.text"), OG_NAME), first_of(F.col("_p.text"), TITLE)))
    a = a.withColumn("_n", F.when(blank & (F.col("_p._fail") == ""), named))
    state = F.when(blank & (F.col("_p._fail") != ""), "unreachable").when(is_network(F.col("_n")), "excluded_network").otherwise(F.col("status"))
    a = a.withColumn("status", state).withColumn("agency_name", F.coalesce(blank_to_null(F.col("agency_name")), F.col("_n")))
    return a.select(*agencies.columns)


def verify_guesses(names: DataFrame, name: str, pages: DataFrame, tlds: tuple[str, ...] = ("com",)) -> DataFrame:
    """names with ``guess``: the domain made of a name, if a captured page of it names all its words; else NULL.

    A page is compared only with names that made its own domain.
    """
    s = F.regexp_replace(F.lower(F.col(name)), r"[^a-z0-9]+", "")
    made = F.array(*[F.concat(x, F.lit(f".{t}")) for t in tlds for x in (s, slug(name))])
    rows = names.withColumn("_id", F.monotonically_increasing_id())
    tries = rows.filter(F.length(s) >= 4).select("_id", F.col(name).alias("_name"), F.posexplode(F.array_distinct(made)).alias("_i", "_guess"))
    text = pages.filter(page_failure(F.col("status"), F.col("error"), F.col("text")) == "").select(
        root_domain("url").alias("_guess"), F.lower(plain_text("text")).alias("_text")
    )
    wanted = F.filter(tokens("_name"), lambda t: ~t.isin("the", "and"))
    hit = tries.join(text, "_guess").filter((F.size(wanted) > 0) & F.forall(wanted, lambda t: F.contains(F.col("_text"), t)))
    best = hit.groupBy("_id").agg(F.min_by("_guess", "_i").alias("guess"))
    return rows.join(best, "_id", "left").drop("_id")


def candidate_pages(pages: DataFrame, sitemaps: DataFrame | None = None, paths: tuple[str, ...] = CLIENT_PATHS, most: int = 12) -> DataFrame:
    """(agency, url, place): client-shaped addresses of sitemaps and of the first page's links, and the usual
    paths; once an address, shallow ones first."""
    shaped = F.lower(url_part("url", 3)).rlike("|".join(lists.CLIENT_URL_WORDS))
    home = first_wins(pages.filter("agency IS NOT NULL").select("agency", "page_id", F.col("url").alias("at"), "text"), ["agency"], "page_id")
    nav = home.select("agency", F.posexplode(nav_links("text", "at", "agency")).alias("o", "url")).filter(shaped).withColumn("part", F.lit(1))
    usual = home.select("agency", F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("o", "p"))
    usual = usual.select("agency", "o", canonical_url(F.concat(F.lit("https://"), "agency", "p")).alias("url"), F.lit(2).alias("part"))
    every = nav.select("agency", "o", "url", "part").unionByName(usual)
    if sitemaps is not None:
        every = every.unionByName(sitemaps.filter(shaped).select(F.col("site").alias("agency"), F.lit(0).alias("o"), "url", F.lit(0).alias("part")))
    order = F.struct(path_depth("url").alias("depth"), "part", "o", "url")
    once = every.groupBy("agency", url_key("url").alias("_k")).agg(F.min(order).alias("b"))
    top = row_number_over(once, ["agency"], [F.col("b")], most)
    return top.select("agency", F.col("b.url").alias("url"), F.col("b.depth").alias("depth"))


def service_candidates(pages: DataFrame, sitemaps: DataFrame | None = None, most: int = 14) -> DataFrame:
    """(agency, url, place): the front page, service-shaped addresses of sitemaps, then of the front page's links, then
    the usual paths; once an address, at most ``most`` an agency."""
    home = first_wins(pages.filter("agency IS NOT NULL").select("agency", "page_id", F.col("url").alias("at"), "text"), ["agency"], "page_id")
    origin = F.concat(F.lit("https://"), "agency")
    front = home.select("agency", F.lit(0).alias("part"), F.lit(0).alias("o"), canonical_url(origin).alias("url"))
    nav = home.select("agency", F.lit(2).alias("part"), F.posexplode(nav_links("text", "at", "agency")).alias("o", "url")).filter(service_url("url"))
    usual = home.select("agency", F.lit(3).alias("part"), F.posexplode(F.array(*[F.lit(p) for p in SERVICE_PATHS])).alias("o", "p"))
    usual = usual.select("agency", "part", "o", canonical_url(F.concat(origin, "p")).alias("url"))
    every = front.unionByName(nav).unionByName(usual)
    if sitemaps is not None:
        every = every.unionByName(sitemaps.filter(service_url("url")).select(F.col("site").alias("agency"), F.lit(1).alias("part"), F.lit(0).alias("o"), canonical_url("url").alias("url")))
    once = every.groupBy("agency", url_key("url").alias("_k")).agg(F.min(F.struct("part", "o", "url")).alias("b"))
    top = row_number_over(once, ["agency"], [F.col("b")], most)
    return top.select("agency", F.col("b.url").alias("url"), F.col("b.part").alias("place"))


def search_links(verticals: DataFrame, metros: DataFrame) -> DataFrame:
    """A search address for each term and place, for people to open: (term, geo, query, url)."""
    pairs = verticals.crossJoin(metros)  # two short lists; their product is the result
    q = F.concat(F.lit('"'), "term", F.lit(' marketing agency" '), "geo")
    return pairs.select("term", "geo", q.alias("query"), F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(q)).alias("url"))


def merge_evidence(own: Column, containers: Column) -> Column:
    """Labels of a page, then those of its containers (array of (id, labels)) tagged with the container; once each."""
    tagged = F.flatten(F.transform(containers, lambda c: F.transform(c["labels"], lambda x: F.concat(x, F.lit(" (GTM:"), c["id"], F.lit(")")))))
    none = F.array().cast("array<string>")
    return F.array_join(F.array_distinct(F.concat(F.coalesce(own, none), F.coalesce(tagged, none))), "; ")


def newest(events: DataFrame, order: str, most: int = 600, since: int | None = None) -> DataFrame:
    """The newest ``most`` events (the ring's size is its feature), of them those after ``since``."""
    ring = events.orderBy(F.desc(order)).limit(most)
    return ring if since is None else ring.filter(F.col(order) > since)


def is_partner(df: DataFrame, domain: Column, partners: DataFrame) -> DataFrame:
    """Rows whose root is on the partner list."""
    p = partners.select(root_domain("domain").alias("_p"))
    return df.withColumn("_d", domain).join(p, F.col("_d") == F.col("_p"), "left_semi").drop("_d")
