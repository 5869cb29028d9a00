"""Per-organisation scorecards that keep what is unknown apart from what is zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.urls import blank_to_null, root_domain
from orgweave.operators.upsert import earliest_value, row_number_over

OUTCOMES = ("qualifying", "tiktok_free", "has_tiktok", "unreachable", "unchecked")


def level_rank(confidence: Column) -> Column:
    """high 0, medium 1, everything else 2."""
    c = F.lower(F.trim(confidence))
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def outcome(status: Column, target: Column, qualifies: Column) -> Column:
    """What one scan says; no scan or no status is unchecked, a failed look is unreachable."""
    low = lambda c: F.lower(F.trim(c))
    return (
        F.when(blank_to_null(status).isNull(), "unchecked")
        .when(low(status) != "ok", "unreachable")
        .when(low(target) == "yes", "has_tiktok")
        .when(low(qualifies) == "yes", "qualifying")
        .otherwise("tiktok_free")
    )


def client_outcomes(clients: DataFrame, tags: DataFrame, tag_seq: str = "result_row") -> DataFrame:
    """clients with agency root, site root and outcome; the last scan of a root counts."""
    t = tags.select(root_domain("domain").alias("site"), F.struct("status", "tiktok", "qualifies").alias("_t"), F.col(tag_seq).alias("_s"))
    t = t.filter("site IS NOT NULL").groupBy("site").agg(F.max_by("_t", "_s").alias("_t"))
    c = clients.withColumn("agency", root_domain("agency_domain")).withColumn("site", root_domain("client_domain"))
    j = c.join(t, "site", "left")
    return j.withColumn("outcome", outcome(F.col("_t.status"), F.col("_t.tiktok"), F.col("_t.qualifies"))).drop("_t")


def scorecard(
    clients: DataFrame, tags: DataFrame, agencies: DataFrame, min_confidence: str | None = None, shown: int = 20,
    client_seq: str = "client_row", agency_seq: str = "agency_row",
) -> DataFrame:
    """One row an agency root, also for agencies without clients; counts by outcome, coverage in percent
    (half to even, 0 without clients), the first ``shown`` qualifying sites sorted, first names and vertical."""
    floor = {"high": 0, "medium": 1}.get(min_confidence or "low", 2)
    rows = client_outcomes(clients, tags).filter(F.col("agency").isNotNull() & (level_rank(F.col("confidence")) <= floor))
    seq = F.col(client_seq)
    one = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    # the first sites of an agency are picked before the shuffle and only these are collected
    counts = rows.groupBy("agency").agg(
        F.min(seq).alias("first_seq"), earliest_value(F.col("agency_name"), seq).alias("agency_name"),
        F.min_by(F.col("vertical"), seq).alias("vertical"), F.count(F.lit(1)).alias("clients_found"),
        *[one(o).alias(f"n_{o}") for o in OUTCOMES],
    )
    sites = rows.filter("outcome = 'qualifying'").groupBy("agency", "site").agg(F.count(F.lit(1)).alias("n"))
    sites = row_number_over(sites, ["agency"], [F.col("site")], shown)
    few = F.array_sort(F.collect_list(F.struct("site", "n")))
    opened = F.flatten(F.transform(few, lambda s: F.array_repeat(s["site"], F.least(s["n"], F.lit(shown)).cast("int"))))
    sites = sites.groupBy("agency").agg(F.array_join(F.slice(opened, 1, shown), " ").alias("qualifying_client_domains"))
    meta = agencies.withColumn("agency", root_domain("agency_domain")).filter("agency IS NOT NULL")
    meta = meta.groupBy("agency").agg(
        F.max_by(F.struct("agency_name", "vertical", "mentions_tiktok", "status", "notes"), agency_seq).alias("m"),
        F.min(agency_seq).alias("agency_seq"),
    )
    j = counts.join(sites, "agency", "left").join(meta, "agency", "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    checked = n("n_qualifying") + n("n_tiktok_free") + n("n_has_tiktok")
    coverage = F.when(n("clients_found") > 0, F.bround(100.0 * checked / n("clients_found"), 0).cast("int")).otherwise(0)
    return j.select(
        F.coalesce(blank_to_null(F.col("agency_name")), F.col("m.agency_name")).alias("agency_name"), F.col("agency").alias("agency_domain"),
        F.coalesce(blank_to_null(F.col("vertical")), F.col("m.vertical")).alias("vertical"), F.col("m.mentions_tiktok").alias("mentions_tiktok"),
        n("clients_found").alias("clients_found"), checked.alias("clients_checked"), n("n_qualifying").alias("qualifying"),
        (n("n_qualifying") + n("n_tiktok_free")).alias("tiktok_free"), n("n_has_tiktok").alias("has_tiktok"),
        n("n_unreachable").alias("unreachable"), n("n_unchecked").alias("unchecked"), coverage.alias("coverage_pct"),
        F.coalesce("qualifying_client_domains", F.lit("")).alias("qualifying_client_domains"), F.col("m.status").alias("agency_status"),
        F.col("m.notes").alias("notes"), "first_seq", "agency_seq",
    )


def ranked(scores: DataFrame) -> DataFrame:
    """Scorecard order; ties stand in the order of first appearance, agencies without clients last."""
    return scores.orderBy(
        F.desc("qualifying"), F.desc("tiktok_free"), F.desc("coverage_pct"), F.desc("clients_found"), F.asc_nulls_last("first_seq"),
        F.asc_nulls_last("agency_seq"),
    )


def leaderboard(stored: DataFrame, row: str, most: int) -> DataFrame:
    """The first rows of a stored scorecard, whose counts may be text; what is no number is 0."""
    whole = lambda c: F.coalesce(F.expr(f"try_cast(trim(`{c}`) AS BIGINT)"), F.lit(0).cast("bigint"))
    counts = ("qualifying", "tiktok_free", "coverage_pct")
    rows = stored.select(*[c for c in stored.columns if c not in counts], *[whole(c).alias(c) for c in counts])
    return rows.orderBy(*[F.desc(c) for c in counts], row).limit(most)


def target_label(mentions: Column, status: Column) -> Column:
    """What a look at an agency says, in words."""
    low = F.lower(F.trim(mentions))
    unknown = F.concat(F.lit("could not tell ("), F.coalesce(blank_to_null(F.trim(status)), F.lit("unknown")), F.lit(")"))
    return F.when(low == "yes", "already there").when(low == "no", "not there: a target").otherwise(unknown)


def scan_label(status: Column, target: Column, qualifies: Column) -> Column:
    """What a scan says, in words."""
    low = lambda c: F.lower(F.trim(c))
    unread = F.concat(F.lit("could not read ("), F.coalesce(blank_to_null(F.trim(status)), F.lit("unknown")), F.lit(")"))
    return (
        F.when(~F.coalesce(low(status) == "ok", F.lit(False)), unread).when(low(target) == "yes", "there")
        .when(low(qualifies) == "yes", "not there, others are: qualifies").otherwise("not there, nor others")
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows by the value of a column, case and blanks ignored; '' for none."""
    return df.groupBy(F.coalesce(F.lower(F.trim(column)), F.lit("")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def score_notes(notes: Column, summary: Column) -> Column:
    """Notes with a former SCORE segment dropped and the new one at the end."""
    old = F.filter(F.split(F.coalesce(notes, F.lit("")), r" \| "), lambda p: ~p.startswith("SCORE ") & (p != ""))
    return F.array_join(F.concat(old, F.array(summary)), " | ")


def summary_totals(agencies: DataFrame, clients: DataFrame, tags: DataFrame) -> DataFrame:
    """One row of totals over the three tables; a scan without status is neither ok nor unreachable."""
    yes = lambda c, v="yes": F.count(F.when(F.col(c) == v, 1))
    a = agencies.agg(
        F.count(F.lit(1)).alias("agencies"), yes("mentions_tiktok", "no").alias("target_agencies"), yes("status", "needs_manual_review").alias("needs_review")
    )
    c = clients.agg(F.count(F.lit(1)).alias("clients"), F.count(blank_to_null(F.col("client_domain"))).alias("clients_with_domain"))
    t = tags.agg(
        F.count(F.lit(1)).alias("sites_checked"), yes("qualifies").alias("qualifying_clients"), yes("tiktok").alias("clients_with_tiktok"),
        F.count(F.when(blank_to_null(F.col("status")).isNotNull() & (F.col("status") != "ok"), 1)).alias("unreachable"),
    )
    one = lambda df: df.select(F.struct("*")).scalar()
    return a.withColumn("_c", one(c)).withColumn("_t", one(t)).select(*a.columns, "_c.*", "_t.*")
