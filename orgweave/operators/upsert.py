"""Keyed dedupes, upserts and merges. Order is a column (``seq``), never the order of arrival of rows.

Blank means NULL, empty or all blanks. All of them are one or two hash aggregations or joins by key with
partial results, so a hot key costs no more than any other. Rows without a key are refused where stated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.functions.urls import blank_to_null


def store_key(*cols: str) -> Column:
    """Lower-case trimmed key columns joined by '::'; NULL when all are blank."""
    parts = [F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in cols]
    some = F.greatest(*[F.length(p) for p in parts]) > 0 if len(parts) > 1 else F.length(parts[0]) > 0
    return F.when(some, F.concat_ws("::", *parts))


def latest_value(value: Column, seq: Column) -> Column:
    """Last non-blank value; blanks neither win nor erase."""
    v = blank_to_null(value)
    return F.max_by(v, F.when(v.isNotNull(), seq))


def earliest_value(value: Column, seq: Column) -> Column:
    v = blank_to_null(value)
    return F.min_by(v, F.when(v.isNotNull(), seq))


def coalescing_upsert(df: DataFrame, key: Sequence[str], fields: Sequence[str], seq: str) -> DataFrame:
    """One row a key: each field's last non-blank value, in the order of first appearance (``first_seq``).

    Keyless rows are refused. Applying it to its own result with ``first_seq`` as order changes nothing.
    """
    keyed = df.withColumn("_key", store_key(*key)).filter("_key IS NOT NULL")
    return keyed.groupBy(F.col("_key").alias("key")).agg(
        F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("puts"), *[latest_value(F.col(f), F.col(seq)).alias(f) for f in fields]
    )


def fill_blanks(df: DataFrame, key: Column, fields: Sequence[str], source: str, seq: str) -> DataFrame:
    """One row a key: the first non-blank value of each field; sources as a sorted set joined by ' + '."""
    keyed = df.withColumn("_key", key).filter("_key IS NOT NULL")
    sources = F.array_join(F.array_sort(F.collect_set(blank_to_null(F.col(source)))), " + ")
    return keyed.groupBy(F.col("_key").alias("key")).agg(
        F.min(seq).alias("first_seq"), sources.alias("sources"), *[earliest_value(F.col(f), F.col(seq)).alias(f) for f in fields]
    )


def first_wins(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """First row a key, as it stands (NULL keys are a key)."""
    cols = df.columns
    best = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct(*cols), seq).alias("_r"))
    return best.select(*[F.col("_r").getField(c).alias(c) for c in cols])


def last_wins(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Last row a key, as it stands."""
    cols = df.columns
    best = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(F.struct(*cols), seq).alias("_r"))
    return best.select(*[F.col("_r").getField(c).alias(c) for c in cols])


def partner_dedupe(df: DataFrame, name: str, domain: str, seq: str) -> DataFrame:
    """(domain, name): by domain the first record with a name, or the first; without one by lower-case name."""
    n, d = F.trim(F.coalesce(F.col(name), F.lit(""))), F.lower(F.trim(F.coalesce(F.col(domain), F.lit(""))))
    rows = df.select(n.alias("name"), d.alias("domain"), F.col(seq).alias("_s"))
    by_domain = rows.filter("domain <> ''").groupBy("domain").agg(F.min_by("name", F.struct(F.col("name") == "", "_s")).alias("name"))
    nameless = rows.filter("domain = '' AND name <> ''").groupBy(F.lower("name").alias("_n")).agg(F.min_by("name", "_s").alias("name"))
    return by_domain.select("domain", "name").unionByName(nameless.select(F.lit("").alias("domain"), "name"))


def merge_last_wins(existing: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """MERGE of a batch into a table: per key the batch's last row replaces the whole row at the key's first
    place; new keys and rows without a key are appended. ``action`` says what happened to each row."""
    cols = [c for c in existing.columns if c not in (key, seq)]
    b = last_wins(batch.filter(F.col(key).isNotNull()), [key], seq)
    first = existing.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_fk")).agg(F.min(seq).alias("_first"))
    old = existing.join(first, existing[key] == first["_fk"], "left").drop("_fk")
    new = b.select(F.col(key).alias("_k"), F.col(seq).alias("_s"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    hit = F.col("_k").isNotNull() & (F.col(seq) == F.col("_first"))
    kept = old.join(new, old[key] == new["_k"], "left").select(
        key, seq, *[F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        F.when(hit, "updated").otherwise("kept").alias("action"),
    )
    fresh = b.join(first, b[key] == first["_fk"], "left_anti")
    keyless = batch.filter(F.col(key).isNull())
    added = fresh.unionByName(keyless).select(key, seq, *cols, F.lit("appended").alias("action"))
    return kept.unionByName(added)


def replace_rows(old: DataFrame, new: DataFrame, on: Sequence[str], seq: str) -> DataFrame:
    """old without rows whose ``on`` columns occur in new, then new's last row of each (NULLs match NULLs)."""
    cond = None
    keys = new.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    for c in on:
        eq = old[c].eqNullSafe(keys[f"_{c}"])
        cond = eq if cond is None else cond & eq
    return old.join(keys, cond, "left_anti").unionByName(last_wins(new, on, seq))


def import_outcomes(incoming: DataFrame, domain: Column, seq: str, known: DataFrame, partners: DataFrame) -> DataFrame:
    """(domain, seq, outcome) of each incoming root: known (also a repeat), partner, or added; no root, no row."""
    rows = incoming.select(domain.alias("domain"), F.col(seq).alias("seq")).filter("domain IS NOT NULL")
    k = known.select(F.col("domain").alias("_k")).dropna().distinct()
    p = partners.select(F.col("domain").alias("_p")).dropna().distinct()
    first = rows.groupBy("domain").agg(F.min("seq").alias("_first"))
    j = rows.join(k, rows["domain"] == k["_k"], "left").join(p, rows["domain"] == p["_p"], "left").join(first, "domain")
    outcome = (
        F.when(F.col("_k").isNotNull(), "known").when(F.col("_p").isNotNull(), "partner").when(F.col("seq") > F.col("_first"), "known")
    )
    return j.select("domain", "seq", outcome.otherwise("added").alias("outcome"))


def row_number_over(df: DataFrame, key: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most ``most`` rows a key, in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")
