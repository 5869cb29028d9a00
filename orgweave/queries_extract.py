"""Queries of extraction, tag scanning and resolution. Markup is derived from the business tables in the same
way for both engines, so that every extractor meets what it is for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions import lists
from orgweave.functions import names as N
from orgweave.functions.urls import root_domain
from orgweave.operators import extract, resolve
from orgweave.plans import pipeline
from orgweave.queries_data import _root
from orgweave.queries_scalar import _brand, _cta, _domain_name, _file_sql, _label, _namekey, _plausible_sql, _title_of, _toks
from orgweave.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Markup of a client row, in SQL that both engines run; names are stripped of characters that end attributes.
_NAME = "translate(coalesce(client_name, ''), '<>\"', '')"
_SITE = "translate(trim(coalesce(client_domain, '')), '<>\"', '')"
_HTML = (
    f"concat('<html><head><title>Case Study: ', {_NAME}, '</title></head><body><img class=\"l\" alt=\"', {_NAME}, ' logo\" src=\"data:x\" data-src=\"/uploads/', "
    f"replace({_NAME}, ' ', '-'), '-logo-300x120.png\"><img alt=\"icon\" src=\"/themes/a/icon.png\"><a href=\"https://', {_SITE}, '/x\">Visit ', {_NAME}, '</a>"
    f"<a href=\"/contact\">Contact</a><p>Site by <a href=\"https://vendor.test/\">Vendor</a></p><h2>How we grew ', {_NAME}, ' 30%</h2></body></html>')"
)


def client_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clients").select(
        F.col("client_row").alias("page_id"), F.concat(F.lit("https://"), F.coalesce(root_domain("agency_domain"), F.lit("host.test")), F.lit("/work/a")).alias("page_url"), F.expr(_HTML).alias("html"), "agency_name",
        root_domain("agency_domain").alias("agency_domain"),
    )


_COLS = ["page_id", "client_name", "client_domain", "confidence", "method"]
_BASE = f"SELECT client_row AS page_id, {_NAME} AS n, {_SITE} AS d, coalesce(agency_name, '') AS a, coalesce({_root('agency_domain')}, '') AS ad FROM clients"


@query(
    f"""SELECT page_id, l AS client_name, NULL::VARCHAR AS client_domain, 'high' AS confidence, 'alt_text' AS method FROM (SELECT *, {_label("n || ' logo'")} AS l FROM ({_BASE}))
WHERE {_plausible_sql('l', 'a', 'ad')}"""
)
def alt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.alt_texts(client_markup(spark, sf_dir)).select(*_COLS)


_SRC = f"'/uploads/' || replace({_NAME}, ' ', '-') || '-logo-300x120.png'"
_PAGE = f"SELECT page_id, n, d, a, ad, {_root("'https://' || d || '/x'")} AS root FROM ({_BASE})"
_BADGE = " OR ".join(f"contains(lower(src), '{w}')" for w in lists.BADGE_WORDS)


@query(
    f"""SELECT page_id, l AS client_name, NULL::VARCHAR AS client_domain, 'medium' AS confidence, 'image_filename' AS method, src FROM (
SELECT b.page_id, b.a, b.ad, {_label('f.name')} AS l, f.src FROM ({_BASE}) b JOIN (SELECT g.client_row, g.name, {_SRC} AS src FROM ({_file_sql(_SRC)}) g JOIN clients c ON c.client_row = g.client_row) f ON f.client_row = b.page_id)
WHERE {_plausible_sql('l', 'a', 'ad')} AND NOT ({_BADGE})"""
)
def image_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.image_filenames(client_markup(spark, sf_dir)).select(*_COLS, "src")


def _links_sql(text: str, root: str, where: str) -> str:
    return f"""SELECT page_id, CASE WHEN ok THEN l ELSE dn END AS client_name, root AS client_domain, 'high' AS confidence, 'outbound_link' AS method, NOT ok AS derived FROM (
SELECT page_id, l, dn, root, a, ad, {_plausible_sql('l', 'a', 'ad')} AS ok, {_plausible_sql('dn', 'a', 'ad')} AS ok2 FROM (
SELECT page_id, {_cta(_label(text))} AS l, {_domain_name(root)} AS dn, {root} AS root, a, ad FROM ({_PAGE}) WHERE {where})) WHERE ok OR ok2"""


_PLATFORMS = ", ".join(f"'{x}'" for x in lists.BOILERPLATE_DOMAINS)


@query(
    _links_sql("'Visit ' || n", "root", f"root IS NOT NULL AND root <> ad AND root <> 'vendor.test' AND root NOT IN ({_PLATFORMS})")
    + " UNION ALL " + _links_sql("'Contact'", "coalesce(nullif(ad, ''), 'host.test')", "ad = ''")
)
def outbound_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.outbound_links(client_markup(spark, sf_dir)).select(*_COLS, "derived")


_HEAD, _TITLE_ = _title_of("'How we grew ' || n || ' 30%'"), _title_of("'Case Study: ' || n")


@query(
    f"""WITH t AS (SELECT page_id, a, ad, {_HEAD} AS h, {_TITLE_} AS t FROM ({_BASE})), k AS (SELECT page_id, h, t, h <> '' AND {_plausible_sql('h', 'a', 'ad')} AS ok, t <> '' AND {_plausible_sql('t', 'a', 'ad')} AS okt FROM t)
SELECT page_id, n AS client_name, NULL::VARCHAR AS client_domain, 'low' AS confidence, 'case_study_title' AS method FROM (
SELECT page_id, h AS n FROM k WHERE ok UNION ALL SELECT page_id, t FROM k WHERE okt AND NOT (ok AND lower(h) = lower(t)))"""
)
def case_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.case_titles(client_markup(spark, sf_dir)).select(*_COLS)


_TAG_HTML = """concat('<html><script>', CASE WHEN result_row % 3 = 0 THEN 'ttq.load(''X''); analytics.tiktok.com/i18n/pixel/events.js' ELSE '' END,
CASE WHEN result_row % 2 = 0 THEN ' fbq(''init'', ''123456789012345'');' ELSE '' END, CASE WHEN result_row % 5 = 0 THEN ' AW-123456789 ' ELSE '' END,
CASE WHEN result_row % 7 = 0 THEN ' snaptr(''init'')' ELSE '' END, ' ', coalesce(gtm_ids, ''), ' ', coalesce(ga4_ids, ''), '</script></html>')"""


def _tag_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "results").select(
        F.col("result_row").alias("page_id"), "domain", F.coalesce("http_status", F.lit(0)).alias("status"),
        F.when(F.col("http_status").isNull(), "ConnectTimeout").alias("error"), F.expr(_TAG_HTML).alias("html"),
    )


_STATE = f"CASE WHEN {_root('domain')} IS NULL THEN 'bad_input' WHEN http_status IS NULL THEN 'fetch_failed:ConnectTimeout' WHEN http_status >= 400 THEN 'unreachable' ELSE 'ok' END"


def _ids(pattern: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(html, '{pattern}'))), '|')"


@query(
    f"""SELECT page_id, status, tiktok, meta, google_ads, gtm_ids, ga4_ids, evidence, coalesce(status = 'ok' AND NOT tiktok AND (meta OR google_ads), false) AS qualifies FROM (
SELECT page_id, status, CASE WHEN ok THEN page_id % 3 = 0 END AS tiktok, CASE WHEN ok THEN page_id % 2 = 0 END AS meta, CASE WHEN ok THEN page_id % 5 = 0 END AS google_ads,
CASE WHEN ok THEN {_ids(r'\bGTM-[A-Z0-9]{4,9}\b')} END AS gtm_ids, CASE WHEN ok THEN {_ids(r'\bG-[A-Z0-9]{8,12}\b')} END AS ga4_ids,
CASE WHEN ok AND page_id % 3 = 0 THEN 'events.js loader; ttq.load' END AS evidence
FROM (SELECT result_row AS page_id, {_STATE} AS status, {_STATE} = 'ok' AS ok, {_TAG_HTML} AS html FROM results))"""
)
def signature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.tag_rows(_tag_pages(spark, sf_dir), "status", "error", "html", "domain")
    return rows.select(
        "page_id", "status", "tiktok", "meta", "google_ads", "gtm_ids", "ga4_ids", F.col("target_evidence").alias("evidence"), "qualifies"
    )


def client_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client rows as extraction records of their agency, in row order."""
    c = table(spark, sf_dir, "clients").filter("client_name IS NOT NULL")
    return c.select(
        root_domain("agency_domain").alias("agency"), F.col("client_row").alias("seq"), "client_name", root_domain("client_domain").alias("client_domain"),
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("confidence", F.lit("low")).alias("confidence"),
        F.element_at(F.array(*[F.lit(m) for m in ("alt_text", "image_filename", "outbound_link")]), (F.col("client_row") % 3 + 1).cast("int")).alias("method"),
        (F.col("client_row") % 5 == 0).alias("derived"),
    ).filter("agency IS NOT NULL")


_REC = f"""SELECT {_root('agency_domain')} AS agency, client_row AS seq, client_name, {_root('client_domain')} AS client_domain, coalesce(source, '') AS source, {_namekey('client_name')} AS key,
CASE lower(trim(coalesce(confidence, 'low'))) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank, ['alt_text', 'image_filename', 'outbound_link'][client_row % 3 + 1] AS method, client_row % 5 = 0 AS derived
FROM clients WHERE client_name IS NOT NULL AND {_root('agency_domain')} IS NOT NULL"""


@query(
    f"""SELECT agency, key, min(seq) AS seq, coalesce((list(client_name ORDER BY length(client_name) DESC, seq) FILTER (WHERE NOT derived))[1], arg_min(client_name, seq)) AS client_name,
arg_min(client_domain, seq) FILTER (WHERE client_domain IS NOT NULL) AS client_domain, min(rank) AS rank, (list(source ORDER BY rank, seq))[1] AS source, list_sort(list_distinct(list(method))) AS methods,
bool_and(derived) AS derived FROM ({_REC}) WHERE key <> '' GROUP BY agency, key"""
)
def merge_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_records(client_records(spark, sf_dir))


_M = f"""m AS ({ORACLE['merge_clients']})"""


@query(
    f"""WITH {_M} SELECT agency, n.seq AS seq, min(l.seq) AS into_seq FROM m n JOIN m l USING (agency) WHERE n.client_domain IS NULL AND l.client_domain IS NOT NULL
AND {_brand('n.client_name', 'l.client_domain')} GROUP BY agency, n.seq"""
)
def brand_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which linked client each name-only client of an agency folds into: the theta join, by blocking keys."""
    m = merge_clients(spark, sf_dir)
    stem = F.substring_index(F.col("client_domain"), ".", 1)
    a = m.filter("client_domain IS NULL").select("agency", "seq", "client_name", F.explode(resolve._blocks(F.col("client_name"), None)).alias("_b"))
    b = m.filter("client_domain IS NOT NULL").select("agency", F.col("seq").alias("l"), "client_domain", F.explode(resolve._blocks(stem, stem)).alias("_b"))
    hits = a.join(b, ["agency", "_b"]).filter(N.same_brand("client_name", "client_domain"))
    return hits.groupBy("agency", "seq").agg(F.min("l").alias("into_seq"))


def _squash(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


def _reconciled(m: str) -> str:
    """SQL of the fold of name-only clients into linked ones, over the merged clients of ``m``."""
    fuller = f"starts_with({_squash('x.name')}, {_squash('a.name')}) AND length(x.name) > length(a.name)"
    return f"""(WITH rm AS (SELECT * FROM {m}), bj AS (SELECT agency, n.seq AS n_seq, min(l.seq) AS seq FROM rm n JOIN rm l USING (agency)
WHERE n.client_domain IS NULL AND l.client_domain IS NOT NULL AND {_brand('n.client_name', 'l.client_domain')} GROUP BY agency, n.seq),
fo AS (SELECT b.agency, b.seq, min(n.rank) AS rank, flatten(list(n.methods)) AS methods, list({{'name': n.client_name, 'derived': false}} ORDER BY n.seq) AS names
FROM bj b JOIN rm n ON n.agency = b.agency AND n.seq = b.n_seq GROUP BY b.agency, b.seq)
SELECT agency, key, seq, f.name AS client_name, client_domain, rank, source, methods, f.derived AS derived FROM (SELECT l.agency, l.key, l.seq, l.client_domain, least(l.rank, coalesce(fo.rank, l.rank)) AS rank, l.source,
list_sort(list_distinct(list_concat(l.methods, coalesce(fo.methods, [])))) AS methods, list_reduce(list_prepend({{'name': l.client_name, 'derived': l.derived}}, coalesce(fo.names, [])),
lambda a, x: CASE WHEN a.derived OR ({fuller}) THEN {{'name': x.name, 'derived': false}} ELSE a END) AS f FROM rm l LEFT JOIN fo USING (agency, seq) WHERE l.client_domain IS NOT NULL)
UNION ALL SELECT agency, key, seq, client_name, client_domain, rank, source, methods, derived FROM rm n WHERE client_domain IS NULL AND NOT EXISTS (SELECT 1 FROM bj WHERE bj.agency = n.agency AND bj.n_seq = n.seq))"""


def _attached(r: str) -> str:
    """SQL of promotion by two methods, then of the first fitting domain of the agency for clients without one."""
    key = f"list_sort(list_distinct(string_split({_namekey('client_name')}, ' ')))"
    fits = "(len(list_intersect(n.k, l.t)) > 0 AND len(list_intersect(n.k, l.t)) >= least(2, len(n.k))) OR n.k = l.k"
    return f"""(WITH pr AS (SELECT agency, key, seq, client_name, client_domain, CASE WHEN len(methods) > 1 AND rank = 1 THEN 0 ELSE rank END AS rank,
array_to_string(methods, '+') || ' | ' || source AS source, methods, derived, {key} AS k, list_distinct({_toks("split_part(client_domain, '.', 1)")}) AS t FROM {r}),
hit AS (SELECT n.agency, n.seq, arg_min(l.client_domain, l.seq) AS d FROM pr n JOIN pr l ON n.agency = l.agency WHERE n.client_domain IS NULL AND l.client_domain IS NOT NULL AND ({fits}) GROUP BY ALL)
SELECT agency, key, seq, client_name, coalesce(client_domain, d) AS client_domain, rank, CASE WHEN d IS NOT NULL THEN source || ' | domain matched to ' || d ELSE source END AS source, methods, derived
FROM pr LEFT JOIN hit USING (agency, seq))"""


_RECONCILED = _reconciled(f"({ORACLE['merge_clients']})")
_ATTACHED = _attached(_RECONCILED)


@query(f"SELECT * FROM {_RECONCILED}")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.reconcile(merge_clients(spark, sf_dir))


@query(f"SELECT * FROM {_ATTACHED}")
def attach_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.fold_pages(client_records(spark, sf_dir))


def _forms(k: str) -> str:
    return f"CASE WHEN {k} <> '' THEN list_distinct([{k}, replace({k}, ' ', '')]) ELSE [] END"


@query(
    f"""WITH rec AS ({_REC}), c AS (SELECT * FROM {_ATTACHED}),
n AS (SELECT key, max(client_name || ' Renamed') AS correct FROM rec WHERE seq % 50 = 1 AND key <> '' GROUP BY key),
d AS (SELECT key, max('fixed-' || client_domain) AS correct FROM rec WHERE seq % 60 = 1 AND key <> '' GROUP BY key HAVING max('fixed-' || client_domain) IS NOT NULL),
j AS (SELECT DISTINCT unnest({_forms('key')}) AS form, agency FROM rec WHERE seq % 70 = 1),
r AS (SELECT c.agency, c.seq, coalesce(n.correct, client_name) AS client_name, client_domain, methods, rank, coalesce(n.correct <> client_name, false) AS renamed,
  CASE WHEN n.correct <> client_name THEN source || ' | renamed from ''' || client_name || ''' (your correction)' ELSE source END AS source FROM c LEFT JOIN n ON {_namekey('client_name')} = n.key),
m AS (SELECT agency, seq, client_name, coalesce(d.correct, client_domain) AS client_domain, methods, rank, renamed, d.correct IS NOT NULL AND d.correct IS DISTINCT FROM client_domain AS moved,
  CASE WHEN d.correct IS NOT NULL AND d.correct IS DISTINCT FROM client_domain THEN source || ' | domain corrected from ''' || coalesce(CASE WHEN trim(client_domain) <> '' THEN client_domain END, 'blank') || ''' (your correction)' ELSE source END AS source
  FROM r LEFT JOIN d ON {_namekey('client_name')} = d.key),
k AS (SELECT *, list_concat({_forms(_namekey('client_name'))}, {_forms(_namekey("split_part(coalesce(client_domain, ''), '.', 1)"))}) AS forms FROM m)
SELECT agency, client_name, client_domain, source, CASE WHEN renamed OR moved THEN 'high' WHEN list_contains(methods, 'alt_text') THEN 'low' ELSE ['high', 'medium', 'low'][rank + 1] END AS confidence, seq
FROM k WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.agency = k.agency AND list_contains(k.forms, j.form))"""
)
def apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold with rules learned from the rows themselves."""
    c = client_records(spark, sf_dir)
    key = N.name_key("client_name").alias("key")
    names = c.filter("seq % 50 = 1").groupBy(key).agg(F.max(F.concat("client_name", F.lit(" Renamed"))).alias("correct")).filter("key <> ''")
    domains = c.filter("seq % 60 = 1").groupBy(key).agg(F.max(F.concat(F.lit("fixed-"), "client_domain")).alias("correct")).filter("key <> ''").dropna()
    junk = c.filter("seq % 70 = 1").select(F.explode(N.match_forms("client_name")).alias("form"), "agency").distinct()
    levels = spark.range(1).select(F.lit("alt_text").alias("method"), F.lit("low").alias("level"))  # one rule
    return resolve.final(resolve.apply_rules(resolve.fold_pages(c), names, domains, junk, levels))


@query()
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup to scorecard in one plan."""
    return pipeline.run(client_markup(spark, sf_dir), table(spark, sf_dir, "results"), table(spark, sf_dir, "agencies"))


@query()
def best_client_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clients").select(root_domain("agency_domain").alias("agency"), F.regexp_extract("source", r":(https?://\S+)$", 1).alias("page_url"), "client_name", "client_row")
    return resolve.best_page(c.filter("agency IS NOT NULL AND page_url <> ''").withColumn("page_ord", F.col("client_row")))


ORACLE["best_client_page"] = f"""SELECT agency, (list(CASE WHEN n > 0 THEN page_url END ORDER BY n DESC, o))[1] AS page_url FROM (SELECT agency, page_url, count(client_name) AS n, min(client_row) AS o FROM (
SELECT {_root('agency_domain')} AS agency, regexp_extract(source, ':(https?://\\S+)$', 1) AS page_url, client_name, client_row FROM clients) WHERE agency IS NOT NULL AND page_url <> '' GROUP BY ALL) GROUP BY agency"""
