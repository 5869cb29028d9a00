"""Health of sources over their runs, failures, and what blocks a source first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.functions.html import bot_wall
from orgweave.functions.urls import blank_to_null


def keep_runs(runs: DataFrame, most: int = 20) -> DataFrame:
    """The newest ``most`` runs of each source (run, found, blocked)."""
    w = Window.partitionBy("source").orderBy(F.desc("run"))
    return runs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")


def health(runs: DataFrame, window: int = 5) -> DataFrame:
    """(source, runs, found, blocked, finding) over the last runs; finding NULL for a healthy source."""
    per = keep_runs(runs, window).groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("found").alias("found"), F.count(F.when(F.col("blocked"), 1)).alias("blocked")
    )
    finding = (
        F.when((F.col("found") == 0) & (F.col("blocked") > 0), "dead: blocked")
        .when(F.col("found") == 0, "dead: layout changed")
        .when(F.col("blocked") >= F.greatest(F.lit(2), F.floor(F.col("runs") / 2)), "unreliable")
    )
    return per.withColumn("finding", finding)


def page_failure(status: Column, error: Column, text: Column) -> Column:
    """Why a page can't be used: its error, no response, an HTTP status, an empty body; '' if it can."""
    return (
        F.when(blank_to_null(error).isNotNull(), error)
        .when(status.isNull() | (status == 0), "no_response")
        .when(status != 200, F.concat(F.lit("http_"), status.cast("string")))
        .when(blank_to_null(text).isNull(), "empty_body")
        .otherwise("")
    )


def histogram(df: DataFrame, reason: Column) -> DataFrame:
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def diagnose(pages: DataFrame) -> DataFrame:
    """Per site the first blocker of its last page: robots, fetch, challenge, parse, else ok."""
    w = Window.partitionBy("site").orderBy(F.desc("page_id"))
    last = pages.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    fail = page_failure(F.col("status"), F.col("error"), F.col("text"))
    verdict = (
        F.when(F.col("error") == "robots_disallowed", "robots")
        .when(fail != "", "fetch")
        .when(bot_wall("text"), "challenge")
        .when(~F.col("text").contains("href="), "parse")
        .otherwise("ok")
    )
    return last.select("site", verdict.alias("verdict"), fail.alias("detail"))


def overall(diagnosis: DataFrame) -> DataFrame:
    """One row: offline, working, robots or generic, from the sites' verdicts."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    a = diagnosis.agg(F.count(F.lit(1)).alias("sites"), n("ok").alias("ok"), n("robots").alias("robots"), n("fetch").alias("fetch"))
    v = (
        F.when(F.col("fetch") == F.col("sites"), "offline").when(F.col("ok") > 0, "working")
        .when(F.col("robots") >= F.col("sites") - 2, "robots").otherwise("generic")
    )
    return a.withColumn("verdict", v)


def fetch_counters(pages: DataFrame) -> DataFrame:
    yes = lambda c: F.count(F.when(c, 1))
    robots = F.coalesce(F.col("error") == "robots_disallowed", F.lit(False))
    return pages.agg(
        yes(F.col("from_cache")).alias("cached"), yes(robots).alias("robots_blocked"),
        yes(~F.coalesce("from_cache", F.lit(False)) & ~robots & F.col("error").isNull() & (F.col("status") > 0)).alias("fetched"),
        yes(~robots & (F.col("error").isNotNull() | (F.col("status") == 0))).alias("failed"),
    )
