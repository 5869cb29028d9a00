"""Queries of the training-data problems and their SQL, where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgweave.functions.urls import root_domain
from orgweave.llm.canonical import canonical_text, lookalike_classes, lookalike_pairs
from orgweave.llm.mixing import mix, shares
from orgweave.llm.names import entities, variant_pairs
from orgweave.llm.packing import pack
from orgweave.llm.residue import residue_pages
from orgweave.llm.survivors import discover
from orgweave.llm.tokens import with_tokens
from orgweave.llm.wrappers import main_lines, page_lines
from orgweave.staging import stage
from orgweave.tables import table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text or piece, for every pack size."""
    return pack(_sized(spark, sf_dir), table(spark, sf_dir, "pack_sizes"), "doc_id", "tokens")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and fill of each pack size."""
    per = p7_containers(spark, sf_dir).groupBy("pack_name", "container", "capacity").agg(F.sum("tokens").alias("tokens"))
    return per.groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / F.sum("capacity")).alias("fill"), F.max(F.col("tokens") / F.col("capacity")).alias("fullest"),
    )


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in each plan."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that each plan reaches."""
    return shares(p8_copies(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of looks that are stored in more than one way, by class and form."""
    return lookalike_classes(table(spark, sf_dir, "documents"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of each pack: containers over capacity, pieces of texts that would have fitted whole, tokens lost, and
    whether the containers are at most a hundredth more than a lower bound."""
    docs = stage(_sized(spark, sf_dir).select("doc_id", "tokens"), "sized")
    sizes = table(spark, sf_dir, "pack_sizes")
    got = stage(pack(docs, sizes, "doc_id", "tokens"), "packed")
    per = got.groupBy("pack_name", "container", "capacity").agg(F.sum("tokens").alias("tokens"))
    per = per.groupBy("pack_name").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"), F.count(F.lit(1)).alias("used"), F.sum("tokens").alias("packed"), F.max("capacity").alias("capacity"))
    pieces = got.groupBy("pack_name", "doc_id", "capacity").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    pieces = pieces.groupBy("pack_name").agg(F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut"))
    total = docs.agg(F.sum("tokens")).scalar()
    return per.join(pieces, "pack_name").select(
        "pack_name", F.col("overfull").cast("bigint").alias("overfull"), F.col("cut").cast("bigint").alias("cut"), (total - F.col("packed")).cast("bigint").alias("lost"),
        (F.col("used") <= F.ceil(F.ceil(F.col("packed") / F.col("capacity")) * 1.01 + 1)).alias("tight"),
    )


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of each plan: documents used too often, documents of other sources, sources whose share is further from
    its target than one document of the plan is of the total."""
    targets = table(spark, sf_dir, "mix_targets")
    got = stage(p8_copies(spark, sf_dir), "mixed")
    over = got.join(F.broadcast(targets.select("plan_name", "source", "max_repeats")), ["plan_name", "source"], "left")
    over = over.groupBy("plan_name").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("max_repeats").isNull()).alias("foreign"), F.max("tokens").alias("most"), F.sum(F.col("tokens") * F.col("copies")).alias("total"))
    have = got.select("plan_name", "source").distinct().join(targets, ["plan_name", "source"])
    due = have.withColumn("due", F.col("target_share") / F.sum("target_share").over(Window.partitionBy("plan_name"))).select("plan_name", "source", "due")
    off = due.join(shares(got, targets), ["plan_name", "source"]).join(over, "plan_name")
    off = off.groupBy("plan_name", "too_often", "foreign").agg(F.count_if(F.abs(F.col("share") - F.col("due")) > 2.0 * F.col("most") / F.col("total")).alias("off"))
    return off.select("plan_name", F.col("too_often").cast("bigint").alias("too_often"), F.col("foreign").cast("bigint").alias("foreign"), F.col("off").cast("bigint").alias("off"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the forms: pairs in the wrong order, forms that change when made again, null forms of texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    once = canonical_text(docs)
    twice = canonical_text(once.select("doc_id", "text", "canonical"), "canonical", "again")
    bad = twice.agg(F.count_if(F.col("again") != F.col("canonical")).alias("unstable"), F.count_if(F.col("text").isNotNull() & F.col("canonical").isNull()).alias("lost"))
    return bad.select(F.col("unstable").cast("bigint").alias("unstable"), F.col("lost").cast("bigint").alias("lost"))


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's consistent form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return canonical_text(docs).select("doc_id", "canonical")


NAMED = {
    "clients": ("client_row", "client_name", "client_domain"),
    "agencies": ("agency_row", "agency_name", "agency_domain"),
}
FIELDS = {f"clients.{c}": c for c in ("client_name", "client_domain", "confidence", "source")}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        variant_pairs(entities(table(spark, sf_dir, t), *cols)).select(F.lit(t).alias("table_name"), "row_a", "row_b")
        for t, cols in NAMED.items()
    ]
    return parts[0].unionByName(parts[1])


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organisation of each client row."""
    return entities(table(spark, sf_dir, "clients"), *NAMED["clients"]).select("row", "entity")


def _client_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client rows with their agency and organisation."""
    # the name is a result of its own, NULL where it is a stand-in, which votes for nothing
    keep = ["agency", *[c for c in FIELDS.values() if c != "client_name"], "last_checked"]
    clients = table(spark, sf_dir, "clients").withColumn("agency", root_domain("agency_domain"))
    return entities(clients, *NAMED["clients"], keep=keep).filter("agency IS NOT NULL").withColumnsRenamed({"row": "client_row", "name": "client_name"})


#: Microseconds of a time without zone, whatever the session's zone.
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(last_checked AS TIMESTAMP_NTZ))"


# A source is a way of finding clients; rows record it with its address.
METHOD = "coalesce(nullif(regexp_extract(source, '^[a-z_]+(?:[+][a-z_]+)*', 0), ''), '(unrecorded)')"


def _survivors(spark: SparkSession, sf_dir: str, declared: bool) -> tuple[DataFrame, DataFrame]:
    """Truth discovery over the client groups, with the declared trust order of rows or without."""
    level = F.lower(F.trim("confidence"))
    rank = F.coalesce((F.find_in_set(level, F.lit("high,medium,low")) + 3) % 4, F.lit(3))  # 0, 1, 2; others 3
    trust = [rank, -F.expr(_MICROS), F.col("client_row")] if declared else []
    group = {"group_row": F.min("client_row"), "n": F.count(F.lit(1))}
    rows = _client_groups(spark, sf_dir).withColumn("method", F.expr(METHOD))
    return discover(rows, ["agency", "entity"], FIELDS, "method", trust, group, report="n > 1")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors under the declared trust order."""
    kept, _ = _survivors(spark, sf_dir, True)
    return kept.select("group_row", "field_name", "kept")


def p4_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that estimated source reliabilities support best."""
    kept, _ = _survivors(spark, sf_dir, False)
    return kept.select("group_row", "field_name", "kept", "support")


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How reliable each finding method was, measured by the survivors of the declared order."""
    return _survivors(spark, sf_dir, True)[1]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = page_lines(table(spark, sf_dir, "pages"))
    return main_lines(lines, residue_pages(lines))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_kinds(spark, sf_dir).select("page_id")


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to exclude, with the kinds of evidence."""
    return residue_pages(page_lines(table(spark, sf_dir, "pages")))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_entities, p4_found, p4_truth, p4_sources, p5_found, p6_found, p6_kinds, p7_containers, p7_fill, p8_copies, p8_shares,
        p9_found, p9_canonical, p9_classes, p7_check, p8_check, p9_check,
    )
}
ORACLE = {
    "p7_check": "SELECT pack_name, 0::BIGINT AS overfull, 0::BIGINT AS cut, 0::BIGINT AS lost, true AS tight FROM pack_sizes",
    "p8_check": "SELECT DISTINCT plan_name, 0::BIGINT AS too_often, 0::BIGINT AS foreign, 0::BIGINT AS off FROM mix_targets",
    "p9_check": "SELECT 0::BIGINT AS unstable, 0::BIGINT AS lost",
}
