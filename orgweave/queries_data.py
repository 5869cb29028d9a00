"""Queries of the general data problems: dangling references (1) and packed fields (2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions.urls import root_domain
from orgweave.operators.packed import split_packed
from orgweave.operators.references import dangling_references, domain_references
from orgweave.tables import table

PACKED = (
    ("agencies", "tiktok_evidence", "agency_row", "evidence"),
    ("agencies", "notes", "agency_row", "notes"),
    ("agency_scorecard", "qualifying_client_domains", "score_row", "tokens"),
    ("results", "gtm_ids", "result_row", "tokens"),
)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("clients", "agencies", "results", "removals")}
    return domain_references(**t).select("ref_field", "period", "row_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references per field and month."""
    return p1_found(spark, sf_dir).groupBy("ref_field", "period").agg(F.count(F.lit(1)).alias("dangling"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans whose (site root, agency name), either of them possibly NULL, no client row has: MATCH PARTIAL."""
    name = F.nullif(F.lower(F.trim("agency_name")), F.lit(""))
    refs = table(spark, sf_dir, "results").select("result_row", root_domain("domain").alias("root"), name.alias("agency"))
    targets = table(spark, sf_dir, "clients").select(root_domain("client_domain").alias("root"), name.alias("agency"))
    return dangling_references(refs, targets, ["root", "agency"], match="partial").select("result_row", "null_mask")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_values(spark, sf_dir).select("field_name", "row_id", "pos", "item")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed value with its error flag."""
    parts = [
        split_packed(table(spark, sf_dir, t), field, row, style, f"{t}.{field}") for t, field, row, style in PACKED
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two fields of ids and domains, whose lists SQL can split too."""
    return p2_values(spark, sf_dir).filter("field_name IN ('results.gtm_ids', 'agency_scorecard.qualifying_client_domains')").drop("malformed")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the split of each field: positions count from 1 without gaps, no empty value, no blank or lone mark."""
    v = p2_values(spark, sf_dir).groupBy("field_name", "row_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_if(F.trim("item") == "").alias("empty"),
        F.count_if(F.col("item") != F.trim("item")).alias("padded"),
    )
    return v.groupBy("field_name").agg(
        F.count(F.lit(1)).alias("strings"), F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n"))).alias("gaps"), F.sum("empty").alias("empty"), F.sum("padded").alias("padded")
    )


QUERIES = {"p2_values": p2_values, "p2_tokens": p2_tokens, "p2_counts": p2_counts, "p1_found": p1_found, "p1_report": p1_report, "p1_pairs": p1_pairs, "p2_found": p2_found}


def _root(c: str) -> str:
    host = rf"rtrim(lower(split_part(split_part(regexp_extract(regexp_replace(regexp_replace(trim({c}, ' <>\"''' || chr(9) || chr(10)), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^//', ''), '^[^/?#]*'), '@', -1), ':', 1)), '. ')"
    return rf"(CASE WHEN regexp_matches({host}, '^[a-z0-9.-]*[.][a-z]{{2,}}$') THEN split_part({host}, '.', -2) || '.' || split_part({host}, '.', -1) END)"


_P1 = f"""
WITH refs AS (
  SELECT 'clients.client_domain' AS ref_field, 'results' AS target, {_root('client_domain')} AS root, ingested_at, client_row AS row_id FROM clients
  UNION ALL SELECT 'clients.agency_domain', 'agencies', {_root('agency_domain')}, ingested_at, client_row FROM clients
  UNION ALL SELECT 'results.domain', 'clients', {_root('domain')}, ingested_at, result_row FROM results),
targets AS (
  SELECT 'results' AS target, {_root('domain')} AS root, ingested_at AS t FROM results
  UNION ALL SELECT 'agencies', {_root('agency_domain')}, ingested_at FROM agencies
  UNION ALL SELECT 'clients', {_root('client_domain')}, ingested_at FROM clients),
spans AS (
  SELECT target, root, t, (SELECT min(removed_at) FROM removals r WHERE r.table_name = target AND {_root('r.domain')} = root AND r.removed_at >= t) AS gone
  FROM targets WHERE root IS NOT NULL)
SELECT ref_field, strftime(ingested_at, '%Y-%m') AS period, row_id FROM refs
WHERE root IS NOT NULL AND ingested_at IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM spans s WHERE s.target = refs.target AND s.root = refs.root
  AND s.t < date_trunc('month', refs.ingested_at) + INTERVAL 1 MONTH
  AND (s.gone IS NULL OR s.gone >= date_trunc('month', refs.ingested_at) + INTERVAL 1 MONTH))"""

def _tokens(tab: str, row: str, col: str) -> str:
    items = rf"regexp_extract_all(v, '\"(?:[^\"]|\"\")*\"|\[[^\[\]]*\]|[^\s|,;\[\]]+')"
    plain = f"list_filter(list_transform({items}, lambda x: trim(trim(x, '[]\"'), ' ')), lambda x: x NOT IN ('', '/'))"
    return rf"""SELECT '{tab}.{col}' AS field_name, row_id, generate_subscripts(l, 1)::INT AS pos, unnest(l) AS item FROM (SELECT row_id, {plain} AS l FROM (
SELECT {row} AS row_id, CASE WHEN regexp_full_match({col}, '\s*\[[^\[\]]*\]\s*') THEN trim(trim({col}), '[]') ELSE {col} END AS v FROM {tab} WHERE trim({col}) <> ''))"""


def _strings(tab: str, col: str) -> str:
    return f"SELECT '{tab}.{col}' AS field_name, count(*) AS strings, 0 AS gaps, 0 AS empty, 0 AS padded FROM {tab} WHERE regexp_matches({col}, '[^\\s\\[\\]|,;/\"]')"


ORACLE = {
    "p2_tokens": " UNION ALL ".join([_tokens("results", "result_row", "gtm_ids"), _tokens("agency_scorecard", "score_row", "qualifying_client_domains")]),
    "p2_counts": " UNION ALL ".join(_strings(t, c) for t, c, _, _ in PACKED),
    "p1_found": _P1,
    "p1_report": f"SELECT ref_field, period, count(*) AS dangling FROM ({_P1}) GROUP BY ALL",
    "p1_pairs": f"""
WITH r AS (SELECT result_row, {_root('domain')} AS root, nullif(lower(trim(agency_name)), '') AS agency FROM results),
c AS (SELECT DISTINCT {_root('client_domain')} AS root, nullif(lower(trim(agency_name)), '') AS agency FROM clients)
SELECT result_row, CASE WHEN root IS NULL THEN 1 ELSE 0 END + CASE WHEN agency IS NULL THEN 2 ELSE 0 END AS null_mask
FROM r WHERE (root IS NOT NULL OR agency IS NOT NULL) AND NOT EXISTS (
  SELECT 1 FROM c WHERE (r.root IS NULL OR r.root = c.root) AND (r.agency IS NULL OR r.agency = c.agency))""",
}
