"""Queries of sources and streams; the streams run to the end of what is there and return what they left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.plans import pipeline
from orgweave.queries_data import _root
from orgweave.queries_scalar import _canonical
from orgweave.queries_tables import _score_sql
from orgweave.sources import captured
from orgweave.staging import shared_dir
from orgweave.streaming import batches
from orgweave.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/orgweave/stream-{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY event_type")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended by a stream that is started twice: the second start adds nothing."""
    at = _place(spark)
    for _ in range(2):
        batches.append_available(batches.event_stream(spark, sf_dir), f"{at}/out", f"{at}/checkpoint")
    out = spark.read.schema(batches.EVENTS).parquet(f"{at}/out")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    """SELECT user_id, min(event_id) AS first_seq, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props, count(*) AS puts FROM events GROUP BY user_id"""
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events folded into one row a user by micro-batches."""
    at = _place(spark)
    s = batches.event_stream(spark, sf_dir).filter("user_id IS NOT NULL")
    batches.upsert_available(s, f"{at}/table", f"{at}/checkpoint", ["user_id"], ["event_type", "props"], "event_id")
    return batches.latest_version(spark, f"{at}/table").select(F.col("user_id").cast("bigint"), "first_seq", "event_type", "props", "puts")


@query(f"SELECT agency_domain, clients_found, qualifying, tiktok_free, has_tiktok, unreachable, unchecked, coverage_pct FROM ({_score_sql(2)})")
def stream_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard after the last micro-batch of client rows, the run started twice."""
    at = _place(spark)
    schema = table(spark, sf_dir, "clients").schema
    for _ in range(2):
        c = batches.event_stream(spark, sf_dir, "clients.parquet", schema)
        pipeline.run_batches(c, table(spark, sf_dir, "results"), table(spark, sf_dir, "agencies"), f"{at}/run", f"{at}/checkpoint")
    last = batches.latest_version(spark, f"{at}/run/scorecard", "b")
    return last.select("agency_domain", "clients_found", "qualifying", "tiktok_free", "has_tiktok", "unreachable", "unchecked", "coverage_pct")


@query("SELECT user_id, count(*) AS events, max(event_id) FILTER (WHERE value IS NOT NULL) AS last_id, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS last_value FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state by user over the stream; the last update of each."""
    at = _place(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/b={number}")

    s = batches.latest_by_user(batches.event_stream(spark, sf_dir).select("user_id", "event_id", "value"))
    s.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("events", "last_id", "last_value"), "b").alias("r")).select("user_id", "r.*")


@query(
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"""
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: event-time windows, here over the table at rest."""
    w = batches.windowed(table(spark, sf_dir, "events"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    f"""WITH c AS (SELECT client_row AS row, trim(coalesce(client_name, '')) AS name, {_root('client_domain')} AS own, {_root('agency_domain')} AS agency, client_domain, agency_domain, trim(coalesce(agency_name, '')) AS an FROM clients),
v AS (SELECT row, 0 AS ord, name, coalesce(own, CASE WHEN row % 4 = 0 THEN 'spare.test' END) AS domain FROM c WHERE client_domain IS NOT NULL OR row % 4 = 0
UNION ALL SELECT row, CASE WHEN client_domain IS NOT NULL OR row % 4 = 0 THEN 1 ELSE 0 END, an, agency FROM c WHERE agency_domain IS NOT NULL)
SELECT * FROM v WHERE domain IS NOT NULL OR (name <> '' AND length(name) < 80)"""
)
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and domains anywhere in JSON trees derived from client rows."""
    item = F.struct(
        F.col("client_name").alias("company_name"), F.col("client_domain").alias("website"),
        F.when(F.col("client_row") % 4 == 0, "https://spare.test/x").alias("link"), F.array(F.lit(1), F.lit(2)).alias("counts"),
    )
    agency = F.array(F.struct(F.struct(F.col("agency_name").alias("displayName"), F.col("agency_domain").alias("partner_url")).alias("node")))
    c = table(spark, sf_dir, "clients").select("client_row", F.to_json(F.struct(F.struct(item.alias("item")).alias("a"), agency.alias("edges"))).alias("js"))
    return captured.json_pairs(c, "client_row", "js")


@query(
    f"""WITH t AS (SELECT score_row, regexp_split_to_array(qualifying_client_domains, '[^A-Za-z0-9.-]+') AS d FROM agency_scorecard WHERE qualifying_client_domains IS NOT NULL),
u AS (SELECT score_row, unnest(d) AS d, generate_subscripts(d, 1) AS i FROM t), r AS (SELECT score_row, {_root('d')} AS root, min(i) AS i FROM u WHERE {_root('d')} IS NOT NULL GROUP BY ALL)
SELECT score_row, (row_number() OVER (PARTITION BY score_row ORDER BY i) - 1)::INT AS pos, root FROM r"""
)
def pasted_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains in lists as they are pasted, one a line, in order."""
    lines = F.regexp_replace("qualifying_client_domains", r"""[\s,;|\[\]"]+""", "\n")
    return table(spark, sf_dir, "agency_scorecard").select("score_row", F.posexplode(captured.pasted_domains(lines)).alias("pos", "root"))


@query("SELECT sha1(url) AS key, min(page_id) AS page_id FROM pages GROUP BY 1")
def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache key of each address and the first page under it."""
    return table(spark, sf_dir, "pages").groupBy(captured.cache_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"))


@query(
    f"""SELECT DISTINCT site, {_canonical('url')} AS url FROM (SELECT {_root('url')} AS site, url FROM pages) WHERE site IS NOT NULL"""
)
def sitemap_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each site from sitemaps made of its pages: one index, one map of pages."""
    from orgweave.functions.urls import root_domain

    p = table(spark, sf_dir, "pages").select(root_domain("url").alias("site"), "url").dropna().distinct()
    maps = p.groupBy("site").agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_set("url")), lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))), ""), F.lit("</urlset>")).alias("text"))
    leaf = maps.select("site", F.concat(F.lit("https://"), "site", F.lit("/pages-of-site")).alias("url"), "text")
    index = leaf.select("site", F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<sitemapindex><loc>"), "url", F.lit("</loc></sitemapindex>")).alias("text"))
    return captured.sitemap_urls(leaf.unionByName(index))
