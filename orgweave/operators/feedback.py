"""Human verdicts: checked, counted by method, folded into exact-match rules.

Counts are a pure aggregate over the verdict table, so replaying it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.urls import blank_to_null, root_domain

VERDICTS = ("good", "bad", "rename", "wrong_domain", "missed")
MIN_SAMPLES, HIGH, MEDIUM = 20, 0.90, 0.70
PSEUDO = ("(unrecorded)", "agency_tiktok", "agency")


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def validate(verdicts: DataFrame) -> DataFrame:
    """Verdicts with ``reason`` (NULL: applied) and their normal forms; blank verdicts are left out."""
    v = verdicts.select(
        "seq", F.lower(_text("verdict")).alias("verdict"), _text("entity_key").alias("entity"), F.lower(_text("method")).alias("method"),
        F.coalesce(F.nullif(F.lower(_text("entity_type")), F.lit("")), F.lit("client")).alias("entity_type"),
        root_domain("agency_domain").alias("agency"), _text("correct_value").alias("correct"),
    ).filter("verdict <> ''")
    reason = (
        F.when(~F.col("verdict").isin(*VERDICTS), "unknown verdict")
        .when((F.col("entity") == "") & (F.col("verdict") != "missed"), "no entity_key")
        .when(F.col("verdict").isin("rename", "wrong_domain", "missed") & (F.col("correct") == ""), "needs a correct_value")
        .when(
            (F.col("entity_type") == "client") & (F.col("verdict") == "wrong_domain") & root_domain("correct").isNull(),
            "correct_value is not a domain",
        )
    )
    return v.withColumn("reason", reason)


def method_stats(checked: DataFrame) -> DataFrame:
    """(method, good, bad, samples, precision): renames and wrong domains are bad, misses count nowhere; a
    wrong domain that isn't one has still been counted."""
    c = checked.filter("reason IS NULL OR reason = 'correct_value is not a domain'")
    client = F.col("entity_type") == "client"
    counted = c.filter(~(client & (F.col("verdict") == "missed")))
    method = F.when(client, F.col("method")).otherwise(F.coalesce(F.nullif(F.col("method"), F.lit("")), F.col("entity_type")))
    per = counted.groupBy(F.coalesce(F.nullif(method, F.lit("")), F.lit("(unrecorded)")).alias("method")).agg(
        F.count(F.when(F.col("verdict") == "good", 1)).alias("good"), F.count(F.when(F.col("verdict") != "good", 1)).alias("bad")
    )
    n = F.col("good") + F.col("bad")
    return per.select("method", "good", "bad", n.alias("samples"), F.round(F.col("good") / n, 3).alias("precision"))


def retune(stats: DataFrame) -> DataFrame:
    """(method, level) of methods with enough samples."""
    p = F.col("precision")
    level = F.when(p >= HIGH, "high").when(p >= MEDIUM, "medium").otherwise("low")
    return stats.filter((F.col("samples") >= MIN_SAMPLES) & ~F.col("method").isin(*PSEUDO)).select("method", level.alias("level"))


def fold_rules(checked: DataFrame) -> DataFrame:
    """(kind, scope, key, value): distinct rules, the last correction of a name winning.

    Kinds: junk_domain, junk_label, agency_junk (scope: agency), name, domain, miss (scope: agency).
    """
    c = checked.filter("reason IS NULL AND entity_type = 'client'")
    is_domain = root_domain("entity").isNotNull() & ~F.col("entity").contains(" ")
    bad = c.filter("verdict = 'bad'").select(
        F.when(is_domain, "junk_domain").when(F.col("agency").isNotNull(), "agency_junk").otherwise("junk_label").alias("kind"),
        F.when(~is_domain, F.col("agency")).alias("scope"), F.when(is_domain, root_domain("entity")).otherwise(F.col("entity")).alias("key"),
        F.lit(None).cast("string").alias("value"),
    ).distinct()
    fixes = c.filter("verdict IN ('rename', 'wrong_domain')").withColumn(
        "value", F.when(F.col("verdict") == "rename", F.col("correct")).otherwise(root_domain("correct"))
    )
    fixes = fixes.groupBy(F.when(F.col("verdict") == "rename", "name").otherwise("domain").alias("kind"), F.col("entity").alias("key")).agg(
        F.max_by("value", "seq").alias("value")
    )
    missed = c.filter("verdict = 'missed'").select(
        F.lit("miss").alias("kind"), F.coalesce("agency", F.lit("(unknown agency)")).alias("scope"), F.col("correct").alias("key"),
        F.lit(None).cast("string").alias("value"),
    ).distinct()
    fixes = fixes.select("kind", F.lit(None).cast("string").alias("scope"), "key", "value")
    return bad.unionByName(fixes).unionByName(missed)


def review_queue(clients: DataFrame, verdicts: DataFrame, most: int = 200) -> DataFrame:
    """Client rows nobody has judged, least trusted first."""
    done = verdicts.select(F.coalesce("agency_domain", F.lit("")).alias("_a"), F.coalesce("entity_key", F.lit("")).alias("_e")).distinct()
    c = clients.withColumn("_a", F.coalesce("agency_domain", F.lit(""))).withColumn("_e", F.coalesce("client_name", F.lit("")))
    level = F.coalesce(blank_to_null(F.col("confidence")), F.lit("low"))
    rank = F.when(level == "medium", 1).when(level == "high", 2).otherwise(0)
    rest = c.join(done, ["_a", "_e"], "left_anti").withColumn("rank", rank)
    return rest.orderBy("rank", "_a", "client_row").limit(most).drop("_a", "_e")  # top-k, the queue's length is its feature
