"""The whole run as one lazy plan: captured pages to clients, scans to outcomes, both to a scorecard; and the
same by micro-batches, rescored over everything that has arrived."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.operators.extract import EXTRACTORS
from orgweave.operators.resolve import final, fold_pages
from orgweave.operators.scoring import scorecard


def extract_records(pages: DataFrame) -> DataFrame:
    """Records of all extractors, ordered within an agency by page, extractor and place."""
    methods = list(EXTRACTORS)
    parts = [EXTRACTORS[m](pages).withColumn("_m", F.lit(i)) for i, m in enumerate(methods)]
    every = reduce(DataFrame.unionByName, parts)
    own = pages.select("page_id", F.col("agency_domain").alias("agency"))
    seq = F.struct("page_id", F.col("_m").alias("method"), "ord")  # no place on a page can meet another's
    return every.join(own, "page_id").filter("agency IS NOT NULL").select(
        "agency", seq.alias("seq"), "client_name", "client_domain", "source", "confidence", "method", "derived"
    )


def run(pages: DataFrame, tags: DataFrame, agencies: DataFrame) -> DataFrame:
    """Scorecard of captured pages (page_id, page_url, html, agency_name, agency_domain)."""
    clients = final(fold_pages(extract_records(pages)))
    return scorecard(as_clients(clients), tags, agencies)


def as_clients(clients: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return clients.select(
        F.col("seq").alias("client_row"), "client_name", "client_domain", none.alias("agency_name"), F.col("agency").alias("agency_domain"),
        none.alias("vertical"), "source", "confidence",
    )


def run_batches(clients: DataFrame, tags: DataFrame, agencies: DataFrame, out: str, checkpoint: str) -> None:
    """Score a stream of client rows: each micro-batch is kept, then all kept rows are scored again.

    Batches and scorecards are written under their number, so a replayed batch replaces itself; a stopped
    run goes on where it stopped, and a run over nothing new does nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/clients/b={number}")
        every = batch.sparkSession.read.parquet(f"{out}/clients")
        scorecard(every.filter(F.col("b") <= number).drop("b"), tags, agencies).write.mode("overwrite").parquet(f"{out}/scorecard/b={number}")

    stream = clients.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
