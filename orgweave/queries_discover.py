"""Queries of discovery on captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions import lists
from orgweave.functions.html import channels, visible_text
from orgweave.functions.urls import root_domain
from orgweave.operators import discover
from orgweave.operators.health import page_failure
from orgweave.queries_data import _root
from orgweave.queries_extract import _NAME, _SITE, client_markup
from orgweave.queries_scalar import _LONG, _NETS, _PLAIN, _VISIBLE, _clean_title, _sentence, _sq, _toks
from orgweave.queries_tables import _FAIL
from orgweave.sources import captured
from orgweave.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_TERM = " || ".join(f"CASE WHEN regexp_matches(v, '{p[4:]}', 'i') THEN 'service_copy:{n};' ELSE '' END" for n, p in discover.TERMS)


@query(
    f"""SELECT page_id, CASE WHEN found <> '' THEN found WHEN regexp_matches(text, '<[^>]*tik\\s?tok[^>]*>', 'i') THEN 'markup_only:tiktok;' ELSE '' END AS found FROM (
SELECT page_id, text, {_TERM} AS found FROM (SELECT page_id, text, {_VISIBLE} AS v FROM pages WHERE text IS NOT NULL))"""
)
def evidence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and terms of the evidence on each page."""
    p = table(spark, sf_dir, "pages").filter("text IS NOT NULL")
    found = discover.by_strength(discover.find_evidence(F.col("text"), F.col("url")))
    text = F.array_join(F.transform(found, lambda e: F.concat(e["kind"], F.lit(":"), e["term"], F.lit(";"))), "")
    return p.select("page_id", text.alias("found"))


_HIT = {"tiktok": "tik\\s?tok", "ttq": "\\bttq\\b", "spark ads": "\\bspark\\s+ads?\\b"}


def _evidence_sql() -> str:
    said = ", ".join(
        f"CASE WHEN regexp_matches(v, '{x}', 'i') THEN {{'kind': 'service_copy', 'term': '{n}', 'context': {_sentence('v', x, f"length(regexp_extract(v, '({x})', 1, 'i'))")}}} END" for n, x in _HIT.items()
    )
    href = "list_filter(regexp_extract_all(text, '<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"''>]+)[\"'']', 1, 'i'), lambda h: contains(lower(h), 'tiktok.com'))[1]"
    tag = "list_filter(regexp_extract_all(text, '<[^>]+>'), lambda t: regexp_matches(t, 'tik\\s?tok', 'i'))[1]"
    return f"""SELECT page_id, (generate_subscripts(e, 1) - 1)::INT AS pos, unnest(e, max_depth := 2) FROM (SELECT page_id,
list_transform(list_sort(list_transform(CASE WHEN len(s) > 0 THEN s ELSE w END, lambda x, i: {{'r': list_position(['pixel', 'service_copy', 'social_link', 'markup_only'], x.kind), 'i': i,
'e': {{'kind': x.kind, 'term': x.term, 'url': url, 'context': x.context}}}}))[1:6], lambda y: y.e) AS e FROM (SELECT page_id, url,
list_filter([{said}, CASE WHEN h IS NOT NULL THEN {{'kind': CASE WHEN regexp_matches(lower(h), 'tiktok\\.com/(business|ads|partners)') THEN 'service_copy' ELSE 'social_link' END, 'term': 'tiktok', 'context': 'link -> ' || substr(trim(h), 1, 160)}} END], lambda x: x IS NOT NULL) AS s,
list_filter([CASE WHEN t IS NOT NULL THEN {{'kind': 'markup_only', 'term': 'tiktok', 'context': substr({_sq('t')}, 1, 200)}} END], lambda x: x IS NOT NULL) AS w
FROM (SELECT page_id, url, {_VISIBLE} AS v, {href} AS h, {tag} AS t FROM (SELECT page_id, url, {_MENTION} AS text FROM pages))))"""


#: Pages of which some name the platform in prose, by a link, or in markup alone.
_MENTION = """CASE page_id % 7 WHEN 0 THEN text || ' We run TikTok for shops. More on ttq here.' WHEN 1 THEN text || '<a href="https://www.tiktok.com/@elm">x</a>'
WHEN 2 THEN text || '<a href="https://tiktok.com/business/x">x</a>' WHEN 3 THEN text || '<div class="icon-tiktok">x</div>' ELSE text END"""
_EVIDENCE = _evidence_sql()


@query(_EVIDENCE)
def evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence itself, strongest first."""
    p = table(spark, sf_dir, "pages").withColumn("text", F.expr(_MENTION))
    found = discover.by_strength(discover.find_evidence(F.col("text"), F.col("url")))
    return p.select("page_id", F.posexplode(found).alias("pos", "e")).select("page_id", "pos", "e.*")


@query(
    f"""WITH p AS (SELECT {_root('url')} AS agency, page_id, {_FAIL} = '' AS readable FROM (SELECT page_id, url, status, error, {_MENTION} AS text FROM pages)), ev AS ({_EVIDENCE}),
k AS (SELECT agency, array_to_string(list_sort(list_distinct(list(kind))), '|') AS kinds, min(p.page_id) AS first FROM p JOIN ev USING (page_id) WHERE readable GROUP BY agency),
x AS (SELECT page_id, string_agg('[' || kind || '] ' || url || ' :: ' || context, ' || ' ORDER BY pos) AS evidence FROM ev GROUP BY page_id),
a AS (SELECT agency, count(*) FILTER (WHERE readable) AS pages_read FROM p WHERE agency IS NOT NULL GROUP BY agency)
SELECT agency, CASE WHEN pages_read = 0 THEN 'unreachable' WHEN pages_read < 2 AND k.kinds IS NULL THEN 'needs_manual_review' ELSE 'checked' END AS status,
CASE WHEN pages_read > 0 THEN CASE WHEN k.kinds IS NOT NULL THEN 'yes' ELSE 'no' END END AS mentions, coalesce(k.kinds, '') AS kinds, x.evidence, pages_read
FROM a LEFT JOIN k USING (agency) LEFT JOIN x ON x.page_id = k.first"""
)
def platform_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("text", F.expr(_MENTION)).withColumn("agency", root_domain("url")).filter("agency IS NOT NULL")
    return discover.platform_status(p).select("agency", "status", "mentions", F.array_join("kinds", "|").alias("kinds"), "evidence", "pages_read")


_VIDEO = " OR ".join(f"regexp_matches(v, '{p.removeprefix('(?i)')}', 'i')" for n, p in lists.CHANNELS if n in ("meta", "youtube", "reels"))
_WEAK = "len(list_filter(k, lambda x: x NOT IN ('social_link', 'markup_only'))) = 0"


@query(
    f"""SELECT page_id, CASE WHEN len(k) > 0 AND {_WEAK} THEN 'WEAK' WHEN len(k) = 0 AND ({_VIDEO}) THEN 'TARGET' END AS note
FROM (SELECT p.page_id, {_VISIBLE} AS v, coalesce(e.k, []) AS k FROM (SELECT page_id, {_MENTION} || CASE WHEN page_id % 7 = 4 THEN ' We plan YouTube and Reels.' ELSE '' END AS text FROM pages) p
LEFT JOIN (SELECT page_id, list(kind) AS k FROM ({_EVIDENCE}) GROUP BY page_id) e USING (page_id) WHERE p.text IS NOT NULL)"""
)
def page_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WEAK where all evidence is a link or markup, TARGET where other video channels are named instead."""
    p = table(spark, sf_dir, "pages").filter("text IS NOT NULL").withColumn("text", F.expr(_MENTION))
    p = p.withColumn("text", F.concat("text", F.when(F.col("page_id") % 7 == 4, " We plan YouTube and Reels.").otherwise("")))
    kinds = F.transform(discover.find_evidence(F.col("text"), F.col("url")), lambda e: e["kind"])
    return p.select("page_id", discover.annotations(kinds, channels(visible_text("text"))).alias("note"))


@query(
    f"""SELECT DISTINCT page_id, root FROM (SELECT client_row AS page_id, {_root("'https://' || " + _SITE + " || '/x'")} AS root, {_root('agency_domain')} AS own FROM clients
UNION ALL SELECT client_row, 'vendor.test', {_root('agency_domain')} FROM clients) WHERE root IS NOT NULL AND root IS DISTINCT FROM coalesce(own, 'host.test')
AND NOT regexp_matches(root, '(?:cdn|static|assets|img|images|fonts|track|analytics)\\.')"""
)
def listing_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = client_markup(spark, sf_dir)
    return m.select("page_id", F.explode(captured.outbound_domains(F.col("html"), F.col("page_url"))).alias("root"))


_SERP = f"""concat('<a class="result__a" href="https://r.test/l/?uddg=', url_encode(concat('https://', {_SITE}, '/x')), '">', {_NAME}, '</a><a class="result__a" href="https://facebook.com/p">F</a><a href="https://other.test/"><h3>Other</h3></a>')"""


@query(
    f"""SELECT page_id, domain, label FROM (SELECT client_row AS page_id, {_root("'https://' || " + _SITE + " || '/x'")} AS domain, {_sq(_NAME)} AS label FROM clients) WHERE domain IS NOT NULL
AND NOT regexp_matches(domain, '(?:cdn|static|assets|img|images|fonts|track|analytics)\\.') UNION ALL SELECT client_row, 'other.test', 'Other' FROM clients"""
)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clients").select(F.col("client_row").alias("page_id"), F.explode(discover.search_results(F.expr(_SERP))).alias("r"))
    return c.select("page_id", "r.domain", "r.label")


_PROFILE = f"""concat('<meta property="og:site_name" content="', {_NAME}, ' | Directory"><p>Team: 11-50 employees</p><div class="website-link x"> <a rel="n" href="https://', {_SITE}, '/">site</a></div>')"""


@query(
    f"""SELECT client_row, domain, name, '11-50 employees' AS staff FROM (SELECT client_row, {_root("'https://' || " + _SITE + " || '/'")} AS domain, {_clean_title(_NAME + " || ' | Directory'")} AS name FROM clients)
WHERE domain IS NOT NULL AND NOT regexp_matches(domain, '(?:cdn|static|assets|img|images|fonts|track|analytics)\\.')"""
)
def profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clients").select("client_row", discover.profile(F.expr(_PROFILE)).alias("p"))
    return c.filter("p IS NOT NULL").select("client_row", "p.*")


@query(
    f"""SELECT page_id, name, domain FROM (SELECT client_row AS page_id, substr({_sq("'Visit ' || " + _NAME)}, 1, 80) AS name, {_root("'https://' || " + _SITE + " || '/x'")} AS domain FROM clients) WHERE domain IS NOT NULL
UNION ALL SELECT client_row, 'Vendor', 'vendor.test' FROM clients"""
)
def anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = client_markup(spark, sf_dir)
    return m.select("page_id", F.explode(discover.anchor_pairs(F.col("html"))).alias("r")).select("page_id", "r.*")


_OG, _TI = "regexp_extract(text, '<meta[^>]+property=[\"'']og:site_name[\"''][^>]+content=[\"'']([^\"'']+)[\"'']', 1, 'i')", "regexp_extract(text, '<title[^>]*>(.*?)</title>', 1, 'is')"
_OWN_NAME = _clean_title(f"coalesce(CASE WHEN trim({_OG}) <> '' THEN {_OG} END, CASE WHEN trim({_TI}) <> '' THEN {_TI} END)")


@query(
    f"""WITH h AS (SELECT DISTINCT ON (root) root, fail, text FROM (SELECT {_root('url')} AS root, page_id, {_FAIL} AS fail, text FROM pages) WHERE root IS NOT NULL ORDER BY root, page_id),
j AS (SELECT agency_row, status, h.fail, CASE WHEN length(trim(agency_name)) > 0 THEN agency_name END AS own, CASE WHEN length(trim(coalesce(agency_name, ''))) = 0 AND fail = '' THEN {_OWN_NAME} END AS n
FROM (SELECT agency_row, status, CASE WHEN agency_row % 2 = 0 THEN agency_name END AS agency_name, {_root('agency_domain')} AS root FROM agencies) a LEFT JOIN h ON a.root = h.root)
SELECT agency_row, CASE WHEN own IS NULL AND fail <> '' THEN 'unreachable' WHEN lower(trim(n)) IN ({_NETS}) OR regexp_matches(lower(trim(n)), '\b(?:{_LONG})\b') THEN 'excluded_network' ELSE status END AS status, coalesce(own, n) AS agency_name FROM j"""
)
def enrich_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second agency loses its name and gets it back from its site."""
    a = table(spark, sf_dir, "agencies").select("agency_row", "agency_domain", "status", F.when(F.col("agency_row") % 2 == 0, F.col("agency_name")).alias("agency_name"))
    return discover.enrich_names(a, table(spark, sf_dir, "pages")).select("agency_row", "status", "agency_name")


_GUESSES = "list_distinct(flatten([[" + "], [".join(f"regexp_replace(name, '[^a-z0-9]+', '', 'g') || '.{t}', regexp_replace(regexp_replace(name, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.{t}'" for t in ("example", "test", "invalid")) + "]]))"
_ORDER = "CASE split_part(guess, '.', 2) WHEN 'example' THEN 0 WHEN 'test' THEN 2 ELSE 4 END + CASE WHEN contains(guess, '-') THEN 1 ELSE 0 END"


@query(
    f"""WITH n AS (SELECT DISTINCT {_root('url')} AS root, lower(split_part({_root('url')}, '.', 1)) AS name FROM pages WHERE {_root('url')} IS NOT NULL),
t AS (SELECT {_root('url')} AS guess, lower({_PLAIN}) AS text FROM pages WHERE {_FAIL} = ''),
g AS (SELECT root, name, unnest({_GUESSES}) AS guess FROM n WHERE length(regexp_replace(name, '[^a-z0-9]+', '', 'g')) >= 4),
w AS (SELECT root, guess, list_filter({_toks('name')}, lambda x: x NOT IN ('the', 'and')) AS wanted FROM g),
h AS (SELECT w.root, arg_min(w.guess, {_ORDER.replace('guess', 'w.guess')}) AS guess FROM w JOIN t ON t.guess = w.guess WHERE len(wanted) > 0 AND len(list_filter(wanted, lambda x: contains(t.text, x))) = len(wanted) GROUP BY w.root)
SELECT n.root, n.name, h.guess FROM n LEFT JOIN h USING (root)"""
)
def verify_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read from site labels, guessed back and held against the pages of the guessed sites."""
    p = table(spark, sf_dir, "pages")
    names = p.select(root_domain("url").alias("root")).dropna().distinct().select("root", F.substring_index("root", ".", 1).alias("name"))
    return discover.verify_guesses(names, "name", p, ("example", "test", "invalid"))


@query()
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("agency", root_domain("url"))
    maps = p.filter("agency IS NOT NULL").select(F.col("agency").alias("site"), "url").distinct()
    return discover.candidate_pages(p, maps)


_TERM_QUERY = "'\"' || r_name || ' marketing agency\" ' || n_name"


@query(f"SELECT n_name AS geo, r_name AS term, {_TERM_QUERY} AS query, 'https://www.google.com/search?q=' || replace(url_encode({_TERM_QUERY}), '%20', '+') AS url FROM nation, region")
def search_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "region").select(F.col("r_name").alias("term"))
    m = table(spark, sf_dir, "nation").select(F.col("n_name").alias("geo"))
    return discover.search_links(v, m).select("geo", "term", "query", "url")


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 600) WHERE event_id > (SELECT max(event_id) FROM events) - 400")
def event_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ring = discover.newest(e, "event_id")
    return ring.filter(F.col("event_id") > e.agg(F.max("event_id")).scalar() - 400).select("event_id", "event_type")


@query(f"SELECT result_row FROM results WHERE {_root('domain')} IN (SELECT {_root('domain')} FROM removals WHERE {_root('domain')} IS NOT NULL)")
def partner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.is_partner(table(spark, sf_dir, "results"), root_domain("domain"), table(spark, sf_dir, "removals")).select("result_row")


@query(
    """SELECT result_row, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') AS evidence FROM (SELECT result_row, list_concat(coalesce(string_split(tiktok_evidence, '; '), []),
list_transform(regexp_extract_all(coalesce(gtm_ids, ''), '\\bGTM-[A-Z0-9]{4,9}\\b'), lambda g: 'ttq.load (GTM:' || g || ')')) AS l FROM results)"""
)
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan's labels with those of its containers."""
    ids = F.regexp_extract_all(F.coalesce("gtm_ids", F.lit("")), F.lit(r"\bGTM-[A-Z0-9]{4,9}\b"), F.lit(0))
    inside = F.transform(ids, lambda g: F.struct(g.alias("id"), F.array(F.lit("ttq.load")).alias("labels")))
    return table(spark, sf_dir, "results").select("result_row", discover.merge_evidence(F.split("tiktok_evidence", "; "), inside).alias("evidence"))


@query(
    f"""SELECT agency_row, CASE WHEN n IS NULL OR n = 0 THEN 'unreachable' WHEN c = 0 AND agency_row % 2 = 0 THEN 'needs_manual_review' WHEN c = 0 THEN 'no_clients_found' ELSE 'clients_parsed' END AS state FROM (
SELECT a.agency_row, p.n, CASE WHEN a.agency_row % 5 < 2 THEN 0 ELSE coalesce(a.clients_found, 0) END AS c FROM agencies a LEFT JOIN (SELECT {_root('url')} AS root, count(*) FILTER (WHERE {_FAIL} = '') AS n FROM pages GROUP BY 1) p ON {_root('a.agency_domain')} = p.root)"""
)
def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each agency from its read pages and clients; two in five have none here, every second is drawn by scripts."""
    read = page_failure(F.col("status"), F.col("error"), F.col("text")) == ""
    p = table(spark, sf_dir, "pages").groupBy(root_domain("url").alias("root")).agg(F.count(F.when(read, 1)).alias("n")).dropna()
    a = table(spark, sf_dir, "agencies").withColumn("root", root_domain("agency_domain")).join(p, "root", "left")
    return a.select("agency_row", discover.parse_status(F.coalesce("n", F.lit(0)), F.when(F.col("agency_row") % 5 < 2, 0).otherwise(F.coalesce("clients_found", F.lit(0))), F.col("agency_row") % 2 == 0).alias("state"))


