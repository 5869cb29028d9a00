"""Queries of the registry, of checks of chosen organisations, and of small projections; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions.urls import root_domain
from orgweave.operators import discover, scoring
from orgweave.plans import checks
from orgweave.queries_data import _root
from orgweave.queries_discover import _EVIDENCE, _MENTION
from orgweave.queries_tables import _FAIL
from orgweave.sources import registry
from orgweave.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_GEO = "CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END"
_QUOTED = "replace(url_encode({}), '%20', '+')"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(g), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'united-states')"


def _url_sql(template: str) -> str:
    parts = {"{term}": _QUOTED.format("term"), "{geo}": _QUOTED.format("g"), "{geo_slug}": _SLUG, "{q}": _QUOTED.format("trim('\"' || term || ' marketing agency\" ' || g)")}
    out = f"'{template}'"
    for slot, value in parts.items():
        out = f"replace({out}, '{slot}', {value})"
    return out


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS source, term, geo, {_url_sql(t)} AS url FROM (SELECT r_name AS term, {_GEO} AS geo, coalesce({_GEO}, '') AS g FROM nation JOIN region ON n_regionkey = r_regionkey)"
        for k, t in [*((d[0], d[2]) for d in registry.DIRECTORIES), *((f"search:{k}", t) for k, t in registry.SEARCH_ENGINES)]
    )
)
def listing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing addresses of every nation's region name, in every directory and engine."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    wanted = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("term"), F.expr(_GEO).alias("geo"))
    return registry.listing_urls(wanted)


_KEYS = "['clutch', 'sortlist', 'designrush', 'upcity', 'agencyspotter', 'google_partners', 'unknown']"
_LISTING = "concat('<a href=\"/profile/p', client_row, '\">A</a><a href=\"/agency/q', client_row, '\">B</a><a href=\"/agency/profile/r\">C</a><a href=\"/profiles/s#x\">D</a><a href=\"/profiles/s\">D</a><a href=\"/t/\" class=\"an agency\">E</a><a href=\"/partners/agency?id=7\">F</a>')"
_PROFILE = "concat('<a rel=\"n\" href=\"https://', translate(trim(coalesce(client_domain, '')), '<>\"', ''), '/\">', CASE WHEN client_row % 2 = 0 THEN 'Visit website' ELSE 'Website' END, '</a>')"
_OWN_SITE = _root("'https://' || translate(trim(coalesce(client_domain, '')), '<>\"', '') || '/'")


@query(
    f"""SELECT client_row, dir, CASE dir WHEN 'clutch' THEN 'https://clutch.co/profile/p' || client_row WHEN 'sortlist' THEN 'https://www.sortlist.com/agency/q' || client_row || ' https://www.sortlist.com/agency/profile/r'
WHEN 'designrush' THEN 'https://www.designrush.com/agency/profile/r' WHEN 'upcity' THEN 'https://upcity.com/profiles/s' WHEN 'agencyspotter' THEN 'https://www.agencyspotter.com/t/'
WHEN 'google_partners' THEN 'https://www.google.com/partners/agency?id=7' END AS profiles,
CASE WHEN dir = 'unknown' OR (dir IN ('clutch', 'designrush') AND client_row % 2 = 1) OR NOT regexp_matches(h, '^https://[^"]') OR regexp_matches(own, '(?:cdn|static|assets|img|images|fonts|track|analytics)\\.') THEN NULL ELSE own END AS site
FROM (SELECT client_row, {_KEYS}[client_row % 7 + 1] AS dir, {_OWN_SITE} AS own, 'https://' || translate(trim(coalesce(client_domain, '')), '<>\"', '') || '/' AS h FROM clients)"""
)
def directory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles a listing links to and the site a profile names, by each directory's patterns."""
    keys = F.array(*[F.lit(k) for k in (*(d[0] for d in registry.DIRECTORIES), "unknown")])
    c = table(spark, sf_dir, "clients").withColumn("dir", F.get(keys, (F.col("client_row") % 7).cast("int")))
    links = F.array_join(registry.profile_urls(F.expr(_LISTING), F.col("dir")), " ")
    return c.select("client_row", "dir", links.alias("profiles"), registry.profile_site(F.expr(_PROFILE), F.col("dir")).alias("site"))


_SEEN = f"""p AS (SELECT {_root('url')} AS agency, page_id, {_FAIL} = '' AS readable FROM (SELECT page_id, url, status, error, {_MENTION} AS text FROM pages)), ev AS ({_EVIDENCE}),
e AS (SELECT agency, count(DISTINCT p.page_id) AS hits FROM p JOIN ev USING (page_id) WHERE readable GROUP BY agency),
n AS (SELECT agency, count(*) FILTER (WHERE readable) AS pages_read FROM p WHERE agency IS NOT NULL GROUP BY agency)"""


@query(
    f"""WITH {_SEEN}, t AS (SELECT {_root('agency_domain')} AS agency, min(agency_name) AS agency_name FROM agencies WHERE {_root('agency_domain')} IS NOT NULL AND (mentions_tiktok IS NULL OR trim(mentions_tiktok) = '') GROUP BY 1)
SELECT t.agency, t.agency_name, CASE WHEN coalesce(n.pages_read, 0) = 0 THEN 'unreachable' WHEN n.pages_read < 2 AND e.hits IS NULL THEN 'needs_manual_review' ELSE 'checked' END AS status,
CASE WHEN n.pages_read > 0 THEN CASE WHEN e.hits > 0 THEN 'yes' ELSE 'no' END END AS mentions FROM t LEFT JOIN n USING (agency) LEFT JOIN e USING (agency)"""
)
def recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agencies without an answer, looked at again on captured pages."""
    pages = table(spark, sf_dir, "pages").withColumn("text", F.expr(_MENTION))
    return checks.recheck(table(spark, sf_dir, "agencies"), pages, table(spark, sf_dir, "results"))[0]


_BRANDS = f"SELECT DISTINCT {_root('agency_domain')} AS root FROM agency_scorecard WHERE {_root('agency_domain')} IS NOT NULL AND {_root('agency_domain')} NOT IN (SELECT {_root('domain')} FROM results WHERE {_root('domain')} IS NOT NULL)"


@query(
    f"""SELECT root AS domain, CASE WHEN f.r IS NULL THEN 'fetch_failed:not_captured' WHEN trim(coalesce(error, '')) <> '' THEN 'fetch_failed:' || error WHEN coalesce(status, 0) >= 400 OR coalesce(length(text), 0) = 0 THEN 'unreachable' ELSE 'ok' END AS status
FROM ({_BRANDS}) b LEFT JOIN (SELECT DISTINCT ON (r) r, status, error, text FROM (SELECT {_root('url')} AS r, * FROM pages) WHERE r IS NOT NULL ORDER BY r, page_id) f ON b.root = f.r"""
)
def check_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of listed sites that no scan has seen."""
    brands = table(spark, sf_dir, "agency_scorecard").select(F.col("agency_domain").alias("domain"))
    return checks.check_brands(brands, table(spark, sf_dir, "results"), table(spark, sf_dir, "pages"))[0].select("domain", "status")


@query(f"SELECT root AS client_name, root AS client_domain, 'elm.test' AS agency_name, 'elm.test' AS agency_domain, 'you provided this list' AS source, 'high' AS confidence FROM ({_BRANDS})")
def brand_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sites as client rows, so that scorecards count them."""
    brands = table(spark, sf_dir, "agency_scorecard").select(F.col("agency_domain").alias("domain"))
    return checks.check_brands(brands, table(spark, sf_dir, "results"), table(spark, sf_dir, "pages"), "elm.test")[1]


@query(
    """SELECT agency_row, CASE lower(trim(mentions_tiktok)) WHEN 'yes' THEN 'already there' WHEN 'no' THEN 'not there: a target' ELSE 'could not tell (' || coalesce(nullif(trim(status), ''), 'unknown') || ')' END AS label FROM agencies"""
)
def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "agencies").select("agency_row", scoring.target_label(F.col("mentions_tiktok"), F.col("status")).alias("label"))


@query(
    """SELECT result_row, CASE WHEN lower(trim(coalesce(status, ''))) <> 'ok' THEN 'could not read (' || coalesce(nullif(trim(status), ''), 'unknown') || ')' WHEN lower(trim(tiktok)) = 'yes' THEN 'there'
WHEN lower(trim(qualifies)) = 'yes' THEN 'not there, others are: qualifies' ELSE 'not there, nor others' END AS label FROM results"""
)
def scan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "results").select("result_row", scoring.scan_label(F.col("status"), F.col("tiktok"), F.col("qualifies")).alias("label"))


@query("SELECT coalesce(lower(trim(status)), '') AS status, count(*) AS n FROM agencies GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.counts_by(table(spark, sf_dir, "agencies"), "status")


_RAW = "CASE WHEN score_row % 6 = 0 THEN 'many' WHEN score_row % 6 = 1 THEN NULL ELSE CAST(qualifying AS VARCHAR) END"


@query(
    f"""SELECT score_row, q AS qualifying, tiktok_free, coverage_pct FROM (SELECT score_row, coalesce(try_cast({_RAW} AS BIGINT), 0) AS q, coalesce(tiktok_free, 0)::BIGINT AS tiktok_free, coalesce(coverage_pct, 0)::BIGINT AS coverage_pct FROM agency_scorecard)
ORDER BY q DESC, tiktok_free DESC, coverage_pct DESC, score_row LIMIT 50"""
)
def stored_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard read back from a stored scorecard of strings: what is no number counts as 0."""
    s = table(spark, sf_dir, "agency_scorecard").select("score_row", F.expr(_RAW.replace("VARCHAR", "STRING")).alias("qualifying"), *[F.col(c).cast("string").alias(c) for c in ("tiktok_free", "coverage_pct")])
    return scoring.leaderboard(s, "score_row", 50).select("score_row", "qualifying", "tiktok_free", "coverage_pct")


_PATH = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1))"


@query(f"SELECT page_id, regexp_matches({_PATH}, '{'|'.join(discover.SERVICE_URL_WORDS)}') AS service FROM pages WHERE url IS NOT NULL")
def service_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses shaped like pages that describe services."""
    return table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", discover.service_url("url").alias("service"))
