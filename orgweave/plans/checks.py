"""Checks of chosen organisations on captured pages: the same operators as the whole run, over fewer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.functions.urls import blank_to_null, root_domain
from orgweave.operators.discover import platform_status
from orgweave.operators.extract import tag_rows
from orgweave.operators.resolve import final, fold_pages
from orgweave.plans.pipeline import extract_records
from orgweave.staging import stage


def scans_of(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Tag rows of sites (root) by the first captured page of each; a site without one is a failed fetch."""
    front = pages.withColumn("root", root_domain("url")).filter("root IS NOT NULL").groupBy("root").agg(
        F.min_by(F.struct("status", "error", "text"), "page_id").alias("_p")
    )
    rows = sites.join(front, "root", "left").select(
        F.xxhash64("root").alias("page_id"), "root", F.coalesce("_p.status", F.lit(0)).alias("_status"),
        F.when(F.col("_p").isNull(), "not_captured").otherwise(blank_to_null(F.col("_p.error"))).alias("_error"), F.col("_p.text").alias("_html"),
    )
    return tag_rows(rows, "_status", "_error", "_html", "root").drop("page_id")


def recheck(agencies: DataFrame, pages: DataFrame, tags: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checked agencies, their clients, scans of the clients' sites not scanned before).

    The agencies wanted (domain), or those without an answer so far, are looked at for the platform; clients are read
    from the pages of those that don't name it, or of all if every one does.
    """
    a = agencies.withColumn("agency", root_domain("agency_domain")).filter("agency IS NOT NULL")
    if wanted is None:
        a = a.filter(blank_to_null(F.col("mentions_tiktok")).isNull())
    else:
        a = a.join(wanted.select(root_domain("domain").alias("agency")).dropna().distinct(), "agency", "left_semi")
    todo = a.groupBy("agency").agg(F.min("agency_name").alias("agency_name"))
    own = pages.withColumn("agency", root_domain("url")).join(todo.select("agency"), "agency", "left_semi")
    seen = platform_status(own).select("agency", "status", "mentions")
    checked = todo.join(seen, "agency", "left").withColumn("status", F.coalesce("status", F.lit("unreachable")))
    checked = stage(checked, "checked")
    targets = checked.filter("NOT mentions <=> 'yes'")
    chosen = checked if targets.isEmpty() else targets
    src = own.join(chosen.select("agency", "agency_name"), "agency").select(
        "page_id", F.col("url").alias("page_url"), F.col("text").alias("html"), "agency_name", F.col("agency").alias("agency_domain")
    )
    clients = stage(final(fold_pages(extract_records(src))), "clients")
    done = tags.select(root_domain("domain").alias("root")).dropna().distinct()
    sites = clients.select(root_domain("client_domain").alias("root")).dropna().distinct().join(done, "root", "left_anti")
    return checked, clients, scans_of(sites, pages)


def check_brands(domains: DataFrame, tags: DataFrame, pages: DataFrame, agency_name: str = "") -> tuple[DataFrame, DataFrame]:
    """(scans, client rows) of listed sites not scanned before, once each; the list is their source, and sure."""
    done = tags.select(root_domain("domain").alias("root")).dropna().distinct()
    sites = domains.select(root_domain("domain").alias("root")).dropna().distinct().join(done, "root", "left_anti")
    scans = scans_of(sites, pages)
    clients = sites.select(
        F.col("root").alias("client_name"), F.col("root").alias("client_domain"), F.lit(agency_name).alias("agency_name"),
        F.coalesce(root_domain(F.lit(agency_name)), F.lit("")).alias("agency_domain"), F.lit("you provided this list").alias("source"), F.lit("high").alias("confidence"),
    )
    return scans, clients
