"""Queries of the table operators: upserts, joins, scorecards, verdicts, health; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions import lists
from orgweave.functions.html import channels
from orgweave.functions.urls import blank_to_null, root_domain
from orgweave.operators import feedback, health, resolve, scoring, upsert
from orgweave.queries_data import _root
from orgweave.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _b(c: str) -> str:
    return f"CASE WHEN length(trim({c})) > 0 THEN {c} END"


# --- scorecards -----------------------------------------------------------------------------------------

_OUT = f"""t AS (SELECT site, arg_max(status, result_row) AS status, arg_max(coalesce(tiktok, '~'), result_row) AS tiktok, arg_max(coalesce(qualifies, '~'), result_row) AS qualifies
  FROM (SELECT {_root('domain')} AS site, coalesce(status, '') AS status, tiktok, qualifies, result_row FROM results) WHERE site IS NOT NULL GROUP BY site),
c AS (SELECT *, {_root('agency_domain')} AS agency, {_root('client_domain')} AS csite FROM clients),
o AS (SELECT c.*, CASE WHEN t.site IS NULL OR trim(t.status) = '' THEN 'unchecked' WHEN lower(trim(t.status)) <> 'ok' THEN 'unreachable'
  WHEN lower(trim(t.tiktok)) = 'yes' THEN 'has_tiktok' WHEN lower(trim(t.qualifies)) = 'yes' THEN 'qualifying' ELSE 'tiktok_free' END AS outcome FROM c LEFT JOIN t ON c.csite = t.site)"""


def _score_sql(floor: int) -> str:
    n = lambda k: f"coalesce(s.n_{k}, 0)"
    return f"""WITH {_OUT},
s AS (SELECT agency, min(client_row) AS first_seq, arg_min({_b('agency_name')}, client_row) FILTER (WHERE length(trim(agency_name)) > 0) AS agency_name, (list(vertical ORDER BY client_row))[1] AS vertical,
  count(*) AS found, {', '.join(f"count(*) FILTER (WHERE outcome = '{k}') AS n_{k}" for k in scoring.OUTCOMES)},
  array_to_string((list(csite ORDER BY csite) FILTER (WHERE outcome = 'qualifying'))[1:20], ' ') AS sites
  FROM o WHERE agency IS NOT NULL AND CASE lower(trim(confidence)) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END <= {floor} GROUP BY agency),
m AS (SELECT DISTINCT ON (agency) agency, agency_name, vertical, mentions_tiktok, status, notes, agency_seq FROM (
  SELECT *, {_root('agency_domain')} AS agency, min(agency_row) OVER (PARTITION BY {_root('agency_domain')}) AS agency_seq FROM agencies) WHERE agency IS NOT NULL ORDER BY agency, agency_row DESC)
SELECT coalesce(s.agency_name, m.agency_name) AS agency_name, coalesce(s.agency, m.agency) AS agency_domain, coalesce({_b('s.vertical')}, m.vertical) AS vertical, m.mentions_tiktok,
  coalesce(s.found, 0) AS clients_found, {n('qualifying')} + {n('tiktok_free')} + {n('has_tiktok')} AS clients_checked, {n('qualifying')} AS qualifying,
  {n('qualifying')} + {n('tiktok_free')} AS tiktok_free, {n('has_tiktok')} AS has_tiktok, {n('unreachable')} AS unreachable, {n('unchecked')} AS unchecked,
  CASE WHEN s.found > 0 THEN round_even(100.0 * ({n('qualifying')} + {n('tiktok_free')} + {n('has_tiktok')}) / s.found, 0)::INT ELSE 0 END AS coverage_pct,
  coalesce(s.sites, '') AS qualifying_client_domains, m.status AS agency_status, m.notes, s.first_seq, m.agency_seq FROM s FULL JOIN m ON s.agency = m.agency"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "clients"), table(spark, sf_dir, "results"), table(spark, sf_dir, "agencies")


@query(_score_sql(2))
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scorecard(*_tables(spark, sf_dir))


@query(_score_sql(1))
def scorecard_min_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scorecard(*_tables(spark, sf_dir), min_confidence="medium")


@query(f"WITH {_OUT} SELECT client_row, outcome FROM o")
def outcome_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t, _ = _tables(spark, sf_dir)
    return scoring.client_outcomes(c, t).select("client_row", "outcome")


@query(
    f"""SELECT agency_domain, qualifying, tiktok_free, coverage_pct FROM ({_score_sql(2)})
ORDER BY qualifying DESC, tiktok_free DESC, coverage_pct DESC, clients_found DESC, first_seq NULLS LAST, agency_seq NULLS LAST LIMIT 50"""
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 of the scorecard; the limit is the report's feature."""
    cols = ["agency_domain", "qualifying", "tiktok_free", "coverage_pct"]
    return scoring.ranked(scorecard(spark, sf_dir)).limit(50).select(*cols)


@query(f"SELECT count(*) AS agencies, sum(clients_found) AS clients, sum(qualifying) AS qualifying, sum(tiktok_free) AS tiktok_free, sum(unchecked) AS unchecked FROM ({_score_sql(2)})")
def scorecard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.sum(c)
    return scorecard(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("agencies"), s("clients_found").alias("clients"), s("qualifying").alias("qualifying"),
        s("tiktok_free").alias("tiktok_free"), s("unchecked").alias("unchecked"),
    )


@query(f"SELECT agency_domain, clients_checked FROM ({_score_sql(2)}) WHERE clients_checked >= 3")
def min_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard(spark, sf_dir).filter("clients_checked >= 3").select("agency_domain", "clients_checked")


@query(
    """SELECT (SELECT count(*) FROM agencies) AS agencies, (SELECT count(*) FROM agencies WHERE mentions_tiktok = 'no') AS target_agencies,
(SELECT count(*) FROM agencies WHERE status = 'needs_manual_review') AS needs_review, (SELECT count(*) FROM clients) AS clients,
(SELECT count(*) FROM clients WHERE length(trim(client_domain)) > 0) AS clients_with_domain, (SELECT count(*) FROM results) AS sites_checked,
(SELECT count(*) FROM results WHERE qualifies = 'yes') AS qualifying_clients, (SELECT count(*) FROM results WHERE tiktok = 'yes') AS clients_with_tiktok,
(SELECT count(*) FROM results WHERE length(trim(status)) > 0 AND status <> 'ok') AS unreachable"""
)
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t, a = _tables(spark, sf_dir)
    return scoring.summary_totals(a, c, t)


@query(
    """SELECT score_row, array_to_string(list_concat(list_filter(string_split(coalesce(notes, ''), ' | '), lambda p: NOT starts_with(p, 'SCORE ') AND p <> ''),
['SCORE qualifying=' || qualifying || ' checked=' || clients_checked || '/' || clients_found]), ' | ') AS notes FROM agency_scorecard"""
)
def notes_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("SCORE qualifying="), "qualifying", F.lit(" checked="), "clients_checked", F.lit("/"), "clients_found")
    return table(spark, sf_dir, "agency_scorecard").select("score_row", scoring.score_notes(F.col("notes"), s).alias("notes"))


@query("SELECT status, confidence, count(*) AS n FROM (SELECT 'client' AS status, coalesce(lower(trim(confidence)), '') AS confidence FROM clients) GROUP BY ALL")
def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clients").select(F.lit("client").alias("status"), F.coalesce(F.lower(F.trim("confidence")), F.lit("")).alias("confidence"))
    return c.groupBy("status", "confidence").agg(F.count(F.lit(1)).alias("n"))


# --- upserts and dedupes --------------------------------------------------------------------------------

_FIELDS = ["client_domain", "vertical", "source", "confidence"]
_CK = "CASE WHEN length(trim(coalesce(agency_domain, ''))) > 0 OR length(trim(coalesce(client_name, ''))) > 0 THEN lower(trim(coalesce(agency_domain, ''))) || '::' || lower(trim(coalesce(client_name, ''))) END"


def _last(c: str, row: str) -> str:
    return f"arg_max({c}, {row}) FILTER (WHERE length(trim({c})) > 0) AS {c}"


def _first(c: str, row: str) -> str:
    return f"arg_min({c}, {row}) FILTER (WHERE length(trim({c})) > 0) AS {c}"


@query(f"SELECT {_CK} AS key, min(client_row) AS first_seq, count(*) AS puts, {', '.join(_last(c, 'client_row') for c in _FIELDS)} FROM clients WHERE {_CK} IS NOT NULL GROUP BY 1")
def coalescing_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.coalescing_upsert(table(spark, sf_dir, "clients"), ["agency_domain", "client_name"], _FIELDS, "client_row")


@query(
    f"""SELECT {_root('agency_domain')} AS key, min(agency_row) AS first_seq, array_to_string(list_sort(list_distinct(list(status) FILTER (WHERE length(trim(status)) > 0))), ' + ') AS sources,
{', '.join(_first(c, 'agency_row') for c in ('agency_name', 'vertical', 'hq_location', 'employee_count'))} FROM agencies WHERE {_root('agency_domain')} IS NOT NULL GROUP BY 1"""
)
def fill_blank_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["agency_name", "vertical", "hq_location", "employee_count"]
    return upsert.fill_blanks(table(spark, sf_dir, "agencies"), root_domain("agency_domain"), fields, "status", "agency_row")


@query(
    f"""WITH r AS (SELECT trim(coalesce(client_name, '')) AS name, coalesce({_root('client_domain')}, '') AS domain, client_row FROM clients)
SELECT domain, coalesce(arg_min(name, client_row) FILTER (WHERE name <> ''), '') AS name FROM r WHERE domain <> '' GROUP BY domain
UNION ALL SELECT '', arg_min(name, client_row) FROM r WHERE domain = '' AND name <> '' GROUP BY lower(name)"""
)
def partner_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clients").select("client_name", root_domain("client_domain").alias("root"), "client_row")
    return upsert.partner_dedupe(c, "client_name", "root", "client_row")


_MCOLS = ["client_name", "status", "qualifies"]


@query(
    f"""WITH a AS (SELECT {_root('domain')} AS k, result_row, {', '.join(_MCOLS)} FROM results),
ex AS (SELECT * FROM a WHERE result_row % 3 <> 0), ba AS (SELECT * FROM a WHERE result_row % 3 = 0),
b AS (SELECT DISTINCT ON (k) * FROM ba WHERE k IS NOT NULL ORDER BY k, result_row DESC), f AS (SELECT k, min(result_row) AS first FROM ex WHERE k IS NOT NULL GROUP BY k)
SELECT ex.k AS root, ex.result_row, {', '.join(f"CASE WHEN b.k IS NOT NULL AND ex.result_row = f.first THEN b.{c} ELSE ex.{c} END AS {c}" for c in _MCOLS)},
CASE WHEN b.k IS NOT NULL AND ex.result_row = f.first THEN 'updated' ELSE 'kept' END AS action FROM ex LEFT JOIN f ON ex.k = f.k LEFT JOIN b ON ex.k = b.k
UNION ALL SELECT k, result_row, {', '.join(_MCOLS)}, 'appended' FROM b WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT k, result_row, {', '.join(_MCOLS)}, 'appended' FROM ba WHERE k IS NULL"""
)
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "results").select(root_domain("domain").alias("root"), "result_row", *_MCOLS)
    late = F.col("result_row") % 3 == 0  # every third row is the batch, the rest the table
    return upsert.merge_last_wins(r.filter(~late), r.filter(late), "root", "result_row")


@query(
    """WITH a AS (SELECT agency_domain, client_name, confidence, client_row FROM clients WHERE client_row % 4 <> 0), n AS (SELECT agency_domain, client_name, confidence, client_row FROM clients WHERE client_row % 4 = 0)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.agency_domain IS NOT DISTINCT FROM a.agency_domain AND n.client_name IS NOT DISTINCT FROM a.client_name)
UNION ALL (SELECT DISTINCT ON (agency_domain, client_name) * FROM n ORDER BY agency_domain, client_name, client_row DESC)"""
)
def verdict_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clients").select("agency_domain", "client_name", "confidence", "client_row")
    new = F.col("client_row") % 4 == 0
    return upsert.replace_rows(c.filter(~new), c.filter(new), ["agency_domain", "client_name"], "client_row")


@query(
    f"""WITH i AS (SELECT {_root('domain')} AS domain, result_row AS seq FROM results), k AS (SELECT DISTINCT {_root('client_domain')} AS domain FROM clients),
p AS (SELECT DISTINCT {_root('domain')} AS domain FROM removals)
SELECT domain, seq, CASE WHEN domain IN (SELECT domain FROM k WHERE domain IS NOT NULL) THEN 'known' WHEN domain IN (SELECT domain FROM p WHERE domain IS NOT NULL) THEN 'partner'
WHEN seq > min(seq) OVER (PARTITION BY domain) THEN 'known' ELSE 'added' END AS outcome FROM i WHERE domain IS NOT NULL"""
)
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "clients").select(root_domain("client_domain").alias("domain"))
    partners = table(spark, sf_dir, "removals").select(root_domain("domain").alias("domain"))
    return upsert.import_outcomes(table(spark, sf_dir, "results"), root_domain("domain"), "result_row", known, partners)


# --- joins ----------------------------------------------------------------------------------------------


@query(
    f"""SELECT agency_row FROM agencies WHERE {_root('agency_domain')} IS NOT NULL AND {_root('agency_domain')} NOT IN (SELECT {_root('domain')} FROM removals WHERE table_name = 'agencies' AND {_root('domain')} IS NOT NULL)"""
)
def suppression_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "removals").filter("table_name = 'agencies'").select(root_domain("domain").alias("root"))
    a = table(spark, sf_dir, "agencies").select("agency_row", root_domain("agency_domain").alias("root")).filter("root IS NOT NULL")
    return a.join(gone, "root", "left_anti").select("agency_row")


@query(
    f"""SELECT agency_row, CASE WHEN {_root('agency_domain')} IN (SELECT {_root('domain')} FROM removals WHERE table_name = 'agencies' AND {_root('domain')} IS NOT NULL) THEN 'suppressed' ELSE status END AS status FROM agencies"""
)
def suppression_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "removals").filter("table_name = 'agencies'").select(root_domain("domain").alias("root")).dropna().distinct()
    a = table(spark, sf_dir, "agencies").select("agency_row", "status", root_domain("agency_domain").alias("root"))
    return a.join(gone.withColumn("_hit", F.lit(True)), "root", "left").select(
        "agency_row", F.when(F.col("_hit"), "suppressed").otherwise(F.col("status")).alias("status")
    )


@query(
    """SELECT n_name AS metro, r_name AS vertical FROM nation, region WHERE NOT EXISTS (SELECT 1 FROM nation n2 JOIN region r2 ON n2.n_regionkey = r2.r_regionkey
WHERE n2.n_name = nation.n_name AND r2.r_name = region.r_name)"""
)
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of two small fixed lists minus those already done."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = n.select(F.col("n_name").alias("metro")).crossJoin(F.broadcast(r.select(F.col("r_name").alias("vertical"))))  # 25 x 5, fixed lists
    done = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("metro"), F.col("r_name").alias("vertical"))
    return pairs.join(done, ["metro", "vertical"], "left_anti")


@query(
    f"""SELECT min(client_row) AS client_row, root FROM (SELECT client_row, {_root('client_domain')} AS root FROM clients) WHERE root IS NOT NULL
AND root NOT IN (SELECT {_root('domain')} FROM results WHERE {_root('domain')} IS NOT NULL) GROUP BY root"""
)
def unchecked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "results").select(root_domain("domain").alias("root"))
    c = table(spark, sf_dir, "clients").select("client_row", root_domain("client_domain").alias("root")).filter("root IS NOT NULL")
    return c.join(seen, "root", "left_anti").groupBy("root").agg(F.min("client_row").alias("client_row"))


@query(
    f"""WITH c AS (SELECT DISTINCT ON (root) root, client_name, agency_name FROM (SELECT {_root('client_domain')} AS root, client_name, agency_name, client_row FROM clients) WHERE root IS NOT NULL ORDER BY root, client_row)
SELECT result_row, coalesce({_b('r.client_name')}, c.client_name) AS client_name, coalesce({_b('r.agency_name')}, c.agency_name) AS agency_name FROM results r LEFT JOIN c ON {_root('r.domain')} = c.root"""
)
def carry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t, _ = _tables(spark, sf_dir)
    return resolve.carry_names(t, c).select("result_row", "client_name", "agency_name")


@query(f"SELECT agency_row FROM agencies WHERE mentions_tiktok IS NULL OR trim(mentions_tiktok) = ''")
def recheck_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "agencies").filter(blank_to_null("mentions_tiktok").isNull()).select("agency_row")


@query(
    f"""SELECT root, min(score_row) AS score_row FROM (SELECT {_root('agency_domain')} AS root, score_row FROM agency_scorecard) WHERE root IS NOT NULL
AND root NOT IN (SELECT {_root('domain')} FROM results WHERE {_root('domain')} IS NOT NULL) GROUP BY root"""
)
def brand_only_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "results").select(root_domain("domain").alias("root"))
    s = table(spark, sf_dir, "agency_scorecard").select(root_domain("agency_domain").alias("root"), "score_row").filter("root IS NOT NULL")
    return s.join(seen, "root", "left_anti").groupBy("root").agg(F.min("score_row").alias("score_row"))


# --- verdicts -------------------------------------------------------------------------------------------

# Client rows read as verdicts: the kinds and the methods follow from columns, so every case occurs.
_VERDICTS = """SELECT client_row AS seq, CASE client_row % 9 WHEN 0 THEN 'bad' WHEN 1 THEN 'rename' WHEN 2 THEN 'wrong_domain' WHEN 3 THEN 'missed' WHEN 4 THEN 'nonsense' WHEN 5 THEN '' ELSE 'good' END AS verdict,
CASE WHEN client_row % 27 = 0 THEN client_domain ELSE client_name END AS entity_key, regexp_replace(split_part(source, ':', 1), '.*[|] ', '') AS method,
CASE WHEN client_row % 11 = 0 THEN 'agency' ELSE 'client' END AS entity_type, agency_domain, CASE WHEN client_row % 2 = 0 THEN client_domain ELSE vertical END AS correct_value, confidence, client_name FROM clients"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clients")
    m = F.col("client_row") % 9
    kind = F.when(m == 0, "bad").when(m == 1, "rename").when(m == 2, "wrong_domain").when(m == 3, "missed").when(m == 4, "nonsense").when(m == 5, "")
    return c.select(
        F.col("client_row").alias("seq"), kind.otherwise("good").alias("verdict"),
        F.when(F.col("client_row") % 27 == 0, F.col("client_domain")).otherwise(F.col("client_name")).alias("entity_key"),
        F.regexp_replace(F.split_part("source", F.lit(":"), F.lit(1)), r".*[|] ", "").alias("method"),
        F.when(F.col("client_row") % 11 == 0, "agency").otherwise("client").alias("entity_type"), "agency_domain",
        F.when(F.col("client_row") % 2 == 0, F.col("client_domain")).otherwise(F.col("vertical")).alias("correct_value"), "confidence", "client_name",
    )


_CHECKED = f"""SELECT seq, verdict, entity, method, entity_type, agency, correct, CASE WHEN verdict NOT IN ('good', 'bad', 'rename', 'wrong_domain', 'missed') THEN 'unknown verdict'
WHEN entity = '' AND verdict <> 'missed' THEN 'no entity_key' WHEN verdict IN ('rename', 'wrong_domain', 'missed') AND correct = '' THEN 'needs a correct_value'
WHEN entity_type = 'client' AND verdict = 'wrong_domain' AND {_root('correct')} IS NULL THEN 'correct_value is not a domain' END AS reason
FROM (SELECT seq, lower(trim(verdict)) AS verdict, trim(coalesce(entity_key, '')) AS entity, lower(trim(coalesce(method, ''))) AS method, entity_type, {_root('agency_domain')} AS agency,
trim(coalesce(correct_value, '')) AS correct FROM ({_VERDICTS})) WHERE verdict <> ''"""
_STATS = f"""SELECT method, good, bad, good + bad AS samples, round(good / (good + bad), 3) AS precision FROM (
SELECT coalesce(nullif(CASE WHEN entity_type = 'client' THEN method ELSE coalesce(nullif(method, ''), entity_type) END, ''), '(unrecorded)') AS method,
count(*) FILTER (WHERE verdict = 'good') AS good, count(*) FILTER (WHERE verdict <> 'good') AS bad FROM ({_CHECKED})
WHERE (reason IS NULL OR reason = 'correct_value is not a domain') AND NOT (entity_type = 'client' AND verdict = 'missed') GROUP BY 1)"""


@query(_CHECKED)
def verdict_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.validate(_verdicts(spark, sf_dir))


@query(_STATS)
def method_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.method_stats(verdict_validate(spark, sf_dir))


@query(
    f"""SELECT method, CASE WHEN precision >= 0.9 THEN 'high' WHEN precision >= 0.7 THEN 'medium' ELSE 'low' END AS level FROM ({_STATS})
WHERE samples >= 20 AND method NOT IN ('(unrecorded)', 'agency_tiktok', 'agency')"""
)
def retune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.retune(method_precision(spark, sf_dir))


_ISDOM = f"({_root('entity')} IS NOT NULL AND NOT contains(entity, ' '))"


@query(
    f"""WITH c AS (SELECT * FROM ({_CHECKED}) WHERE reason IS NULL AND entity_type = 'client')
SELECT DISTINCT CASE WHEN {_ISDOM} THEN 'junk_domain' WHEN agency IS NOT NULL THEN 'agency_junk' ELSE 'junk_label' END AS kind, CASE WHEN NOT {_ISDOM} THEN agency END AS scope,
CASE WHEN {_ISDOM} THEN {_root('entity')} ELSE entity END AS key, NULL::VARCHAR AS value FROM c WHERE verdict = 'bad'
UNION ALL SELECT CASE WHEN verdict = 'rename' THEN 'name' ELSE 'domain' END, NULL, entity, arg_max(CASE WHEN verdict = 'rename' THEN correct ELSE {_root('correct')} END, seq) FROM c WHERE verdict IN ('rename', 'wrong_domain') GROUP BY verdict, entity
UNION ALL SELECT DISTINCT 'miss', coalesce(agency, '(unknown agency)'), correct, NULL FROM c WHERE verdict = 'missed'"""
)
def fold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.fold_rules(verdict_validate(spark, sf_dir))


@query(
    f"""WITH v AS ({_VERDICTS}), d AS (SELECT DISTINCT coalesce(agency_domain, '') AS a, coalesce(entity_key, '') AS e FROM v WHERE seq % 2 = 0)
SELECT client_row, r AS rank FROM (SELECT client_row, coalesce(agency_domain, '') AS a, coalesce(client_name, '') AS e, CASE coalesce({_b('confidence')}, 'low') WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 0 END AS r FROM clients) q
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.a = q.a AND d.e = q.e) ORDER BY r, a, client_row LIMIT 200"""
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _verdicts(spark, sf_dir).filter("seq % 2 = 0")  # half of the rows have been judged
    return feedback.review_queue(table(spark, sf_dir, "clients"), done).select("client_row", "rank")


# --- health ---------------------------------------------------------------------------------------------

_RUNS = """SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS run, count(*) FILTER (WHERE value > 20 AND event_type <> 'error') AS found, bool_or(value > 200) AS blocked FROM events GROUP BY ALL"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(
        F.count(F.when((F.col("value") > 20) & (F.col("event_type") != "error"), 1)).alias("found"), F.bool_or(F.col("value") > 200).alias("blocked")
    )


@query(f"SELECT source, run, found, blocked FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS rn FROM ({_RUNS})) WHERE rn <= 20")
def health_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.keep_runs(_runs(spark, sf_dir))


@query(
    f"""SELECT source, runs, found, blocked, CASE WHEN found = 0 AND blocked > 0 THEN 'dead: blocked' WHEN found = 0 THEN 'dead: layout changed' WHEN blocked >= greatest(2, runs // 2) THEN 'unreliable' END AS finding
FROM (SELECT source, count(*) AS runs, sum(found) AS found, count(*) FILTER (WHERE blocked) AS blocked FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS rn FROM ({_RUNS})) WHERE rn <= 5 GROUP BY source)"""
)
def health_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.health(_runs(spark, sf_dir))


_FAIL = f"CASE WHEN length(trim(error)) > 0 THEN error WHEN status IS NULL OR status = 0 THEN 'no_response' WHEN status <> 200 THEN 'http_' || status WHEN text IS NULL OR trim(text) = '' THEN 'empty_body' ELSE '' END"


@query(f"SELECT {_FAIL} AS reason, count(*) AS n FROM pages GROUP BY 1")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.histogram(table(spark, sf_dir, "pages"), health.page_failure(F.col("status"), F.col("error"), F.col("text")))


_WALL = " OR ".join(f"contains(lower(substr(text, 1, 6000)), '{w}')" for w in lists.WALL_MARKERS)
_DIAG = f"""SELECT site, CASE WHEN error = 'robots_disallowed' THEN 'robots' WHEN {_FAIL} <> '' THEN 'fetch' WHEN coalesce({_WALL}, false) THEN 'challenge' WHEN NOT contains(text, 'href=') THEN 'parse' ELSE 'ok' END AS verdict, {_FAIL} AS detail
FROM (SELECT *, {_root('url')} AS site, row_number() OVER (PARTITION BY {_root('url')} ORDER BY page_id DESC) AS rn FROM pages) WHERE rn = 1"""


@query(_DIAG)
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.diagnose(table(spark, sf_dir, "pages").withColumn("site", root_domain("url")))


@query(
    f"""SELECT *, CASE WHEN "fetch" = sites THEN 'offline' WHEN ok > 0 THEN 'working' WHEN robots >= sites - 2 THEN 'robots' ELSE 'generic' END AS verdict FROM (
SELECT count(*) AS sites, count(*) FILTER (WHERE verdict = 'ok') AS ok, count(*) FILTER (WHERE verdict = 'robots') AS robots, count(*) FILTER (WHERE verdict = 'fetch') AS "fetch" FROM ({_DIAG}))"""
)
def diagnose_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.overall(diagnose(spark, sf_dir))


@query(
    """SELECT count(*) FILTER (WHERE from_cache) AS cached, count(*) FILTER (WHERE error = 'robots_disallowed') AS robots_blocked,
count(*) FILTER (WHERE NOT coalesce(from_cache, false) AND error IS NULL AND status > 0) AS fetched,
count(*) FILTER (WHERE coalesce(error, '') <> 'robots_disallowed' AND (error IS NOT NULL OR status = 0)) AS failed FROM pages"""
)
def fetch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.fetch_counters(table(spark, sf_dir, "pages"))


@query(
    """SELECT agency_row, CASE WHEN len(kinds) > 0 AND list_bool_and(list_transform(kinds, lambda k: k IN ('social_link', 'markup_only'))) THEN 'WEAK' END AS note, kinds
FROM (SELECT agency_row, list_sort(list_distinct(regexp_extract_all(tiktok_evidence, '\\[([a-z_]+)\\] http', 1))) AS kinds FROM agencies)"""
)
def evidence_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of evidence of each agency; WEAK when there is some and none is more than a link or markup."""
    kinds = F.array_sort(F.array_distinct(F.regexp_extract_all("tiktok_evidence", F.lit(r"\[([a-z_]+)\] http"), F.lit(1))))
    weak = (F.size("kinds") > 0) & F.forall("kinds", lambda k: k.isin("social_link", "markup_only"))
    return table(spark, sf_dir, "agencies").select("agency_row", kinds.alias("kinds")).withColumn("note", F.when(weak, "WEAK"))


@query()
def document_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by channel they name."""
    d = table(spark, sf_dir, "documents").select(F.explode(channels("text")).alias("channel"))
    return d.groupBy("channel").agg(F.count(F.lit(1)).alias("documents"))


ORACLE["document_channels"] = (
    "SELECT channel, count(*) AS documents FROM (SELECT unnest(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p[4:]}', 'i') THEN '{n}' END" for n, p in lists.CHANNELS)
    + "]) AS channel FROM documents) WHERE channel IS NOT NULL GROUP BY channel"
)
