"""Queries of the scalar functions and predicates, each over a whole table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions import html as H
from orgweave.functions import lists
from orgweave.functions import names as N
from orgweave.functions import urls as U
from orgweave.operators.resolve import path_depth_top
from orgweave.operators.upsert import first_wins
from orgweave.queries_data import _root
from orgweave.tables import table

QUERIES, ORACLE = {}, {}


def _simple(name: str, tab: str, row: str, sql: str, /, **columns):
    """A query that projects columns of one table, one row a row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, tab).select(row, *[c().alias(n) for n, c in columns.items()])

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, sql


def _sq(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\s\x{{00a0}}]+', ' ', 'g'), '^ | $', '', 'g')"


def _re(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', '{flags}')"


def _path(c: str) -> str:
    return rf"regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _canonical(c: str) -> str:
    scheme = rf"lower(regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    host = rf"lower(regexp_extract({c}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
    path = _re(_re(_re(_path(c), ";[^/]*$"), "/{2,}", "/"), "(.)/+$", r"\1", "")
    query = rf"regexp_extract({c}, '^[^?#]*\?([^#]*)', 1)"
    return (
        f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END || CASE WHEN {host} <> '' THEN '//' || {host} ELSE '' END || "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"
    )


def _key(c: str) -> str:
    return _re(_re(_canonical(c), "^[a-z][a-z0-9+.-]*:", "", ""), r"^//(?:www\.)?", "", "")


_simple("root_domain", "clients", "client_row", f"SELECT client_row, {_root('client_domain')} AS root FROM clients", root=lambda: U.root_domain("client_domain"))
_simple(
    "base_url", "results", "result_row",
    f"SELECT result_row, coalesce(nullif(lower(regexp_extract(trim(domain), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), ''), 'https') || '://' || {_root('domain')} AS base FROM results",
    base=lambda: U.base_url("domain"),
)
_simple("canonical_url", "pages", "page_id", f"SELECT page_id, {_canonical('url')} AS canonical FROM pages", canonical=lambda: U.canonical_url("url"))
_simple(
    "same_site", "pages", "page_id", f"SELECT page_id, coalesce({_root('url')} = {_root('domain')}, false) AS own FROM pages",
    own=lambda: U.same_site("url", "domain"),
)
_simple(
    "normalize_host", "results", "result_row",
    r"SELECT result_row, CASE WHEN contains(h, '.') THEN regexp_replace(h, '^www\.', '') END AS host FROM (SELECT result_row, "
    r"lower(rtrim(trim(split_part(regexp_extract(regexp_replace(regexp_replace(trim(domain, ' <>\"''' || chr(9) || chr(10)), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^//', ''), '^[^/?#]*'), '@', -1)), '.')) AS h FROM results)",
    host=lambda: U.normalize_host("domain"),
)
_simple(
    "slug", "clients", "client_row", r"SELECT client_row, regexp_replace(regexp_replace(lower(client_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM clients",
    slug=lambda: U.slug("client_name"),
)
_simple(
    "redirect_unwrap", "pages", "page_id", "SELECT page_id, url AS target FROM pages",
    target=lambda: U.unwrap_redirect(F.concat(F.lit("https://r.test/l/?kl=x&uddg="), F.url_encode("url"), F.lit("&rut=1"))),
)
_simple(
    "client_urls", "pages", "page_id", f"SELECT page_id, regexp_matches(lower({_path('url')}), '{'|'.join(lists.CLIENT_URL_WORDS)}') AS about_clients FROM pages",
    about_clients=lambda: H.client_url("url"),
)

_TAGS = _re("coalesce({c}, '')", "<[^>]+>", " ")


def _entities(x: str) -> str:
    for name, ch in (("&nbsp;", " "), ("&amp;", "&"), ("&#39;", "''"), ("&quot;", '"')):
        x = f"replace({x}, '{name}', '{ch}')"
    return x


_DROP = "|".join(rf"<{t}\b.*?</{t}>" for t in ("script", "style", "noscript", "svg"))
_VISIBLE = _sq(_entities(_re(_re(_re("text", _DROP, " ", "gis"), r"<br\s*/?>|</(p|div|li|h[1-6]|td)>", " . ", "gi"), "<[^>]+>", " ")))
_simple("visible_text", "pages", "page_id", f"SELECT page_id, {_VISIBLE} AS visible FROM pages", visible=lambda: H.visible_text("text"))
_PLAIN = _sq(_re(_re("text", "|".join(rf"<{t}\b.*?</{t}>" for t in ("script", "style", "noscript")), " ", "gis"), "<[^>]+>", " "))
_marks = lambda words, c: " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words)
_simple(
    "js_rendered", "pages", "page_id",
    f"SELECT page_id, coalesce({_marks(lists.JS_MARKERS, 'lower(text)')} OR (length(text) > 2000 AND length({_PLAIN}) < 400), false) AS drawn FROM pages",
    drawn=lambda: H.js_rendered("text"),
)
_simple(
    "bot_wall", "pages", "page_id", f"SELECT page_id, coalesce({_marks(lists.WALL_MARKERS, 'lower(substr(text, 1, 6000))')}, false) AS wall FROM pages",
    wall=lambda: H.bot_wall("text"),
)


def _first(pattern: str, flags: str) -> str:
    got = f"regexp_extract(text, '{pattern.replace(chr(39), chr(39) * 2)}', 1, '{flags}')"
    return f"(CASE WHEN trim({got}) <> '' THEN {got} END)"


_RAW = f"coalesce({_first(H.OG_NAME[4:], 'i')}, {_first('<h1[^>]*>(.*?)</h1>', 'is')}, {_first('<title[^>]*>(.*?)</title>', 'is')})"


def _clean_title(raw: str) -> str:
    amp = f"replace({_re(raw, '<[^>]+>', ' ')}, '&amp;', '&')"
    cut = f"trim(regexp_split_to_array({_sq(amp)}, '\\s*[|–—>·•]\\s*|\\s+-\\s+')[1])"
    return rf"substr(trim(regexp_replace({cut}, '^(?:home|welcome to|about)\s*[:\-]?\s*', '', 'i')), 1, 80)"


_simple(
    "page_title", "pages", "page_id", f"SELECT page_id, {_clean_title(_RAW)} AS title FROM pages",
    title=lambda: H.site_name("text"),
)
_simple(
    "channels", "documents", "doc_id",
    "SELECT doc_id, list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p[4:]}', 'i') THEN '{n}' END" for n, p in lists.CHANNELS) + "], lambda x: x IS NOT NULL)) AS channels FROM documents",
    channels=lambda: H.channels("text"),
)
_simple(
    "employee_range", "agencies", "agency_row",
    r"SELECT agency_row, coalesce(nullif(regexp_extract(employee_count || ' employees', '(\d{1,3})\s*(?:-|–|—|to)\s*(\d{1,4})\s*(?:employees|people|staff|team members)', 0, 'i'), ''), "
    r"nullif(regexp_extract(employee_count || ' employees', '\b(\d{1,4})\+?\s*(?:employees|people on staff)\b', 0, 'i'), '')) AS staff FROM agencies",
    staff=lambda: H.employee_range(F.concat("employee_count", F.lit(" employees"))),
)

_E, _ED = r"[ \t\n\r\-–—|·•:,]", r"[ \t\n\r\-–—|·•:,.]"


def _label(c: str) -> str:
    x = _sq(_TAGS.replace("{c}", c))
    for name, ch in (("&amp;", "&"), ("&#38;", "&"), ("&#39;", "''"), ("&rsquo;", "''"), ("&quot;", '"'), ("&nbsp;", " ")):
        x = f"replace({x}, '{name}', '{ch}')"
    x = _re(_sq(x), f"^{_E}+|{_E}+$")
    x = _re(x, r"\b(?:company\s+)?logos?\b", " ", "gi")
    x = _re(x, r"^\s*(?:logo of|image of|photo of|client[:\-]?)\s*", "", "gi")
    x = _re(x, r"\s*[-–—|·•]\s*(?:client|customer|partner|case study)\s*$", "", "gi")
    return _re(_sq(x), f"^{_ED}+|{_ED}+$")


_simple(
    "clean_label", "clients", "client_row", f"SELECT client_row, {_label(chr(39) + 'Logo of <b>' + chr(39) + ' || client_name || ' + chr(39) + '</b> - client' + chr(39))} AS label FROM clients",
    label=lambda: N.clean_label(F.concat(F.lit("Logo of <b>"), "client_name", F.lit("</b> - client"))),
)


def _toks(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda t: length(t) > 1)"


_NOISE = "[" + ", ".join(f"'{w}'" for w in lists.KEY_NOISE) + "]"


def _namekey(c: str) -> str:
    core = f"list_filter({_toks(c)}, lambda t: NOT list_contains({_NOISE}, t))"
    return f"(CASE WHEN {c} IS NOT NULL THEN coalesce(array_to_string(CASE WHEN len({core}) > 0 THEN {core} ELSE {_toks(c)} END, ' '), '') END)"


_simple("name_key", "clients", "client_row", f"SELECT client_row, {_namekey('client_name')} AS key FROM clients", key=lambda: N.name_key("client_name"))


def _cta(c: str) -> str:
    s = _re(c, r"^(?:shop|visit|view|see|explore|discover|browse|read|check\s+out|go\s+to|learn\s+about|meet)\s+(?:the\s+)?", "", "i")
    s = _re(_re(s, r"\s+(?:website|site|online|now|here|case\s+study|story|project|work)$", "", "i"), r"^[ .,:\-–—]+|[ .,:\-–—]+$")
    return f"(CASE WHEN length({s}) >= 2 THEN {s} ELSE {c} END)"


def _domain_name(root: str) -> str:
    return f"""coalesce(array_to_string(list_transform(list_filter(regexp_split_to_array(split_part(coalesce({root}, ''), '.', 1), '[-_]+'), lambda p: p <> ''),
lambda p: CASE WHEN length(p) <= 3 AND regexp_full_match(p, '[A-Za-z]+') THEN upper(p) ELSE upper(substr(p, 1, 1)) || lower(substr(p, 2)) END), ' '), '')"""


_simple(
    "strip_cta", "clients", "client_row", f"SELECT client_row, {_cta('l')} AS brand FROM (SELECT client_row, 'Visit the ' || client_name || ' website' AS l FROM clients)",
    brand=lambda: N.strip_cta(F.concat(F.lit("Visit the "), "client_name", F.lit(" website"))),
)
_FILE = "'/uploads/2024/' || replace(client_name, ' ', '-') || '-logo-300x120@2x.png'"


def _file_sql(src: str = _FILE) -> str:
    """(client_row, name) of the file name in an expression over clients."""
    stem = _re("regexp_extract(src, '([^/]*)$', 1)", r"\.(png|jpe?g|svg|webp|gif|avif)$", "", "i")
    stem = _re(stem, r"(?:[-_]\d{2,4}x\d{2,4}|[-_@]\d+x|[-_]\d{3,4})+$", "", "i")
    noise = "[" + ", ".join(f"'{w}'" for w in lists.FILENAME_NOISE) + "]"
    return f"""WITH f AS (SELECT client_row, {_path(src)} AS src FROM clients),
p AS (SELECT client_row, list_filter(regexp_split_to_array({_re(stem, '[%_+]', '-')}, '[-\\s.]+'), lambda x: x <> '') AS parts FROM f)
SELECT client_row, CASE WHEN len(parts) = 1 AND (length(parts[1]) > 24 OR regexp_full_match(lower(parts[1]), '[0-9a-f]{{8,}}')) THEN '' ELSE
coalesce(array_to_string(list_transform(list_filter(parts, lambda x: NOT list_contains({noise}, lower(x)) AND NOT regexp_full_match(x, '\\d{{1,4}}') AND NOT regexp_full_match(lower(x), '[0-9a-f]{{8,}}')),
lambda w: CASE WHEN upper(w) = w AND regexp_matches(w, '[A-Z]') AND length(w) <= 4 THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' '), CASE WHEN parts IS NOT NULL THEN '' END) END AS name FROM p"""


_simple(
    "filename_name", "clients", "client_row", _file_sql(),
    name=lambda: N.file_name(F.concat(F.lit("/uploads/2024/"), F.replace(F.col("client_name"), F.lit(" "), F.lit("-")), F.lit("-logo-300x120@2x.png"))),
)
_simple(
    "domain_name", "clients", "client_row",
    f"SELECT client_row, {_domain_name(_root('client_domain'))} AS name FROM clients",
    name=lambda: N.domain_name(U.root_domain("client_domain")),
)


def _title_of(title: str) -> str:
    t = _label(title)
    found = []
    for shape in N.TITLE_SHAPES:
        c = f"regexp_extract({t}, '{shape[4:]}', 1, 'i')"
        c = _re(c, r"\s+(?:by\s+)?\d[\d.,]*\s*(?:%|x|percent)?(?:\s+(?:in|on|with|over|across)\b.*)?$", "", "i")
        c = f"trim({_re(_re(c, r'^[ .,:\-–—]+|[ .,:\-–—]+$'), r'^(?:the|our|a)\s+', '', 'i')})"
        found.append(f"nullif({c}, '')")
    return f"coalesce({', '.join(found)}, '')"


def _title_sql() -> str:
    kinds = "CASE client_row % 4 WHEN 0 THEN 'How we grew ' || client_name || ' 300%' WHEN 1 THEN 'Case Study: ' || client_name WHEN 2 THEN 'Scaling ' || client_name || ' to 4 Locations' ELSE client_name || ': 312% More Leads' END"
    return f"SELECT client_row, {_title_of('t')} AS name FROM (SELECT client_row, {kinds} AS t FROM clients)"


_simple(
    "title_name", "clients", "client_row", _title_sql(),
    name=lambda: N.title_name(
        F.expr(
            "CASE client_row % 4 WHEN 0 THEN concat('How we grew ', client_name, ' 300%') WHEN 1 THEN concat('Case Study: ', client_name) "
            "WHEN 2 THEN concat('Scaling ', client_name, ' to 4 Locations') ELSE concat(client_name, ': 312% More Leads') END"
        )
    ),
)


def _brand(n: str, d: str) -> str:
    stem = f"split_part({d}, '.', 1)"
    a, b = f"regexp_replace(lower({n}), '[^a-z0-9]+', '', 'g')", f"regexp_replace(lower({stem}), '[^a-z0-9]+', '', 'g')"
    return (
        f"coalesce({a} <> '' AND {b} <> '' AND ({a} = {b} OR (length({a}) <= length({b}) AND length({a}) >= 6 AND starts_with({b}, {a})) OR "
        f"(length({a}) > length({b}) AND length({b}) >= 6 AND starts_with({a}, {b})) OR len(list_intersect({_toks(n)}, {_toks(stem)})) >= 2), false)"
    )


_simple(
    "same_brand", "clients", "client_row", f"SELECT client_row, {_brand('client_name', _root('client_domain'))} AS same FROM clients",
    same=lambda: N.same_brand("client_name", U.root_domain("client_domain")),
)


def _plausible_sql(name: str, agency: str, dom: str) -> str:
    low = f"lower(trim({name}))"
    junk = ", ".join(f"'{w}'" for w in lists.JUNK_LABELS)
    own = f"list_concat({_toks(agency)}, {_toks('split_part(' + dom + chr(44) + chr(39) + '.' + chr(39) + ', 1)')})"
    mine = _toks(name)
    sq = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
    return (
        f"({low} NOT IN ({junk}) AND length({name}) BETWEEN 2 AND 60 AND regexp_matches({name}, '[A-Za-z]') AND "
        f"len(list_filter(regexp_split_to_array({_sq(name)}, ' '), lambda w: w <> '')) <= 6 AND NOT regexp_matches({low}, '^[\\d\\s%$.,+-]+$') AND "
        f"NOT contains({name}, '@') AND NOT regexp_matches({low}, '^(http|www\\.|/)') AND NOT regexp_matches({low}, '\\.(com|net|org|png|jpe?g|svg|webp|gif)$') "
        f"AND NOT ({dom} <> '' AND {_brand(name, dom)}) AND NOT ({agency} <> '' AND {sq(name)} = {sq(agency)}) AND "
        f"NOT (len({mine}) > 0 AND len({own}) > 0 AND len(list_filter({mine}, lambda t: NOT list_contains({own}, t))) = 0))"
    )


_simple(
    "plausible_name", "clients", "client_row",
    f"SELECT client_row, {_plausible_sql('n', 'a', 'd')} AS plausible FROM (SELECT client_row, coalesce(client_name, '') AS n, coalesce(agency_name, '') AS a, coalesce({_root('agency_domain')}, '') AS d FROM clients)",
    plausible=lambda: N.plausible_name("client_name", "agency_name", U.root_domain("agency_domain")),
)
_NETS = ", ".join(f"'{w}'" for w in lists.NETWORK_NAMES)
_LONG = "|".join(w for w in lists.NETWORK_NAMES if len(w) > 5)
_NET = "CASE WHEN agency_row % 7 = 0 THEN 'Publicis ' || agency_name WHEN agency_row % 7 = 1 THEN ' WPP ' ELSE agency_name END"
_simple(
    "network_name", "agencies", "agency_row",
    rf"SELECT agency_row, coalesce(n IN ({_NETS}) OR regexp_matches(n, '\b(?:{_LONG})\b'), false) AS network FROM (SELECT agency_row, lower(trim({_NET})) AS n FROM agencies)",
    network=lambda: N.is_network(F.expr("CASE WHEN agency_row % 7 = 0 THEN concat('Publicis ', agency_name) WHEN agency_row % 7 = 1 THEN ' WPP ' ELSE agency_name END")),
)


def _sentence(text: str, pattern: str, hit: int) -> str:
    """SQL of the sentence around the first match of a pattern that is ``hit`` characters long."""
    at = f"length(regexp_extract({text}, '^(.*?){pattern}', 1, 'is'))"
    left = f"greatest({at} - 180, 0)"
    window = f"substr({text}, {left} + 1, {at} - {left} + {hit} + 180)"
    parts = rf"string_split(regexp_replace({window}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    best = f"coalesce(list_filter({parts}, lambda p: regexp_matches(p, '{pattern}', 'i'))[1], {window})"
    return f"CASE WHEN regexp_matches({text}, '{pattern}', 'i') THEN substr(regexp_replace({_sq(best)}, '^[ .]+|[ .]+$', '', 'g'), 1, 240) END"


_simple("sentence_context", "documents", "doc_id", rf"SELECT doc_id, {_sentence('text', r'\bclient', 6)} AS context FROM documents", context=lambda: H.sentence_around("text", r"(?i)\bclient"))
_LISTED = "regexp_replace(CASE WHEN score_row % 3 = 0 THEN qualifying_client_domains || ' and a line of prose; more prose; still more' ELSE qualifying_client_domains END, '[|;, ]+', chr(10), 'g')"
_LINES = rf"list_filter(list_transform(regexp_split_to_array(coalesce(t, ''), '\r\n|\n|\r'), lambda x: {_sq('x')}), lambda x: x <> '')"
_FIRST = "lower(regexp_replace(regexp_replace(trim(regexp_split_to_array(x, '[,\t]')[1]), '^[\"'']+|[\"'']+$', '', 'g'), '^https?://', '', 'i'))"
_simple(
    "pasted_list", "agency_scorecard", "score_row",
    rf"""SELECT score_row, len(l) > 0 AND len(l) <= 2000 AND NOT (contains(coalesce(t, ''), '<') AND contains(coalesce(t, ''), '>'))
AND len(list_filter(l, lambda x: regexp_matches({_FIRST}, '^(?:[a-z0-9][a-z0-9-]*\.)+[a-z]{{2,24}}(?:[/:?#].*)?$'))) >= greatest(1, floor(len(l) * 0.6)) AS listed
FROM (SELECT score_row, t, {_LINES} AS l FROM (SELECT score_row, {_LISTED} AS t FROM agency_scorecard))""",
    listed=lambda: H.is_list(F.expr(_LISTED.replace(", 'g')", ")").replace("chr(10)", "'\\n'"))),
)


def url_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of each address, whatever its scheme and www."""
    pages = table(spark, sf_dir, "pages").select("page_id", U.url_key("url").alias("key"))
    return first_wins(pages, ["key"], "page_id")


def path_depth_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", U.root_domain("url").alias("agency"), "url", F.col("page_id").alias("ord"))
    return path_depth_top(pages.filter("agency IS NOT NULL"), U.path_depth("url")).select("agency", "page_id")


def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(H.nav_links("text", "url", U.root_domain("url"))).alias("link"))


QUERIES |= {f.__name__: f for f in (url_key_dedupe, path_depth_topk, nav_links)}
ORACLE |= {
    "url_key_dedupe": f"SELECT min(page_id) AS page_id, {_key('url')} AS key FROM pages GROUP BY 2",
    "path_depth_topk": f"""SELECT agency, page_id FROM (SELECT page_id, {_root('url')} AS agency, row_number() OVER (PARTITION BY {_root('url')}
ORDER BY len(list_filter(string_split({_path('url')}, '/'), lambda x: x <> '')), page_id) AS rn FROM pages WHERE {_root('url')} IS NOT NULL) WHERE rn <= 12""",
    "nav_links": f"""SELECT DISTINCT page_id, {_canonical("h")} AS link FROM (SELECT page_id, url, CASE WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN r
ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || r END AS h FROM (SELECT page_id, url, trim(unnest(regexp_extract_all(text, '<a\\b[^>]*?href\\s*=\\s*["'']([^"''>]+)["'']', 1, 'i'))) AS r FROM pages)
WHERE r <> '' AND NOT regexp_matches(r, '^(#|mailto:|tel:|javascript:|data:)', 'i')) WHERE {_root('h')} = {_root('url')}""",
}
