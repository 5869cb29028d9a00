"""Stopping a stream, tables in parts, verdict sources, stamps, service pages, and what a re-check hands on."""

import os
import shutil

import pyarrow.parquet as pq
import pytest
from orgweave import queries_stream
from orgweave.operators.discover import service_candidates
from orgweave.plans import checks
from orgweave.sources import tabular
from orgweave.streaming import batches
from pyspark.sql import functions as F


def test_stop_and_go_on(spark, sf, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "check")
    seen = []

    def one(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/b={number}")
        seen.append(number)

    stream = lambda: batches.event_stream(spark, sf).writeStream.foreachBatch(one).option("checkpointLocation", at)
    assert batches.run_until(stream(), lambda: bool(seen), every="0 seconds") >= 1
    rows = spark.read.parquet(out).count()
    assert rows == spark.read.parquet(f"{sf}/events.parquet").count()
    assert batches.run_until(stream(), lambda: True, every="0 seconds") >= 0 and spark.read.parquet(out).count() == rows


def test_a_failing_batch_is_an_error(spark, sf, tmp_path):
    def one(batch, number):
        raise ValueError("no")

    writer = batches.event_stream(spark, sf).writeStream.foreachBatch(one).option("checkpointLocation", str(tmp_path / "c"))
    with pytest.raises(Exception, match="no"):
        batches.run_until(writer, lambda: False, every="0 seconds")


@pytest.mark.parametrize("name", ["stream_scorecard", "stream_resume", "stream_upsert", "stream_state"])
def test_streams_of_tables_in_parts(spark, sf, tmp_path, name):
    for f in os.listdir(sf):
        if f in ("clients.parquet", "events.parquet"):
            (tmp_path / f).mkdir()
            rows = pq.read_table(f"{sf}/{f}")
            third = rows.num_rows // 3 + 1
            for i in range(3):
                pq.write_table(rows.slice(i * third, third), tmp_path / f / f"part-{i}.parquet")
            (tmp_path / f / "_SUCCESS").touch()
        else:
            shutil.copy(f"{sf}/{f}", tmp_path / f)
    run = queries_stream.QUERIES[name]
    got, due = (sorted(map(str, run(spark, at).collect())) for at in (str(tmp_path), sf))
    assert got == due and got


def test_verdicts_and_stamps(spark, tmp_path):
    (tmp_path / "v.csv").write_text("client_name,verdict\nElm,good\n")
    assert [tuple(r) for r in tabular.read_verdicts(spark, str(tmp_path / "v.csv"), ["client_name", "verdict", "note"]).collect()] == [("Elm", "good", None)]
    with pytest.raises(Exception):
        tabular.read_verdicts(spark, str(tmp_path / "none.csv"), ["x"]).collect()
    one = spark.sql("SELECT TIMESTAMP '2024-03-01 12:34:56' AS t").select(tabular.stamp(F.col("t"))).first()[0]
    assert one == "2024-03-01 12:34"


def test_service_candidates(spark):
    html = '<a href="/what-we-do/x">X</a><a href="/team">T</a><a href="../services/">S</a>'
    pages = spark.createDataFrame([(1, "a.test", "https://a.test/", html)], "page_id bigint, agency string, url string, text string")
    maps = spark.createDataFrame([("a.test", "https://a.test/paid-media/one"), ("a.test", "https://a.test/blog")], "site string, url string")
    got = [r.url for r in service_candidates(pages, maps).orderBy("place").collect()]
    assert got[0] == "https://a.test/" and got[1] == "https://a.test/paid-media/one" and "https://a.test/what-we-do/x" in got[2:4]
    assert len(got) == 14 and "https://a.test/team" not in got and got.count("https://a.test/services") == 1


def test_recheck_hands_on_clients(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.test/work", 200, None, '<p>Our work for clients in town.</p><a href="https://elmbakery.test/">Elm Bakery</a>'), (2, "https://b.test/", 200, None, "<p>We run TikTok.</p>")],
        "page_id bigint, url string, status int, error string, text string",
    )
    agencies = spark.createDataFrame([("A", "a.test", None), ("B", "b.test", ""), ("C", "c.test", "no")], "agency_name string, agency_domain string, mentions_tiktok string")
    tags = spark.createDataFrame([], "domain string")
    checked, clients, scans = checks.recheck(agencies, pages, tags)
    assert {(r.agency, r.status, r.mentions) for r in checked.collect()} == {("a.test", "needs_manual_review", "no"), ("b.test", "checked", "yes")}
    assert [(r.agency, r.client_name, r.client_domain) for r in clients.collect()] == [("a.test", "Elm Bakery", "elmbakery.test")]
    assert [(r.domain, r.status) for r in scans.collect()] == [("elmbakery.test", "fetch_failed:not_captured")]
