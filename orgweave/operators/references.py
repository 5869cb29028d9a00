"""References to records that do not exist.

A reference is a tuple of key columns; some of them may be NULL. References are grouped by their null
mask, and each mask is anti-joined with the targets on its non-null columns, under a declared match:

* ``simple``  a reference with any NULL is no reference; else all columns must match one target;
* ``partial`` the non-null columns must match one target; all NULL is no reference;
* ``full``    a mix of NULL and non-NULL is itself dangling; all NULL is no reference.

Defined results: empty references give an empty result; with no targets every reference that counts is
dangling; repeated references are all reported, repeated targets count once; the columns of ``refs`` come
back unchanged and in order, whatever their names, plus ``null_mask`` (bit i set: key column i is NULL).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.urls import root_domain
from orgweave.operators.skew import salted_join


def null_mask(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)])


def dangling_references(
    refs: DataFrame, targets: DataFrame, keys: Sequence[str], match: str = "simple", state: str | None = None
) -> DataFrame:
    """Rows of refs without a target. ``keys`` name the columns in both tables.

    With ``state``, targets carry an array of (at, alive) by that name, ordered by ``at``, and refs a
    column ``at``: the target counts when its last state at or before the reference's is alive.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match {match!r}")
    keys, cols = list(keys), refs.columns
    inner = [f"_k{i}" for i in range(len(keys))]
    kept = {c: f"_c{i}" for i, c in enumerate(cols) if c not in keys}
    whole = (1 << len(keys)) - 1
    packed = refs.select(
        *[refs[c].alias(i) for c, i in zip(keys, inner)], *[refs[c].alias(i) for c, i in kept.items()]
    ).withColumn("_mask", null_mask(inner))
    parts = []
    for mask in range(whole):  # the last mask, all NULL, is never a reference
        if mask and match == "simple":
            continue
        own = packed.filter(F.col("_mask") == mask)
        if mask and match == "full":
            parts.append(own)
            continue
        on = [i for n, i in enumerate(inner) if not mask >> n & 1]
        t = targets.select(
            *[F.col(keys[inner.index(i)]).alias(i) for i in on], *([F.col(state).alias("_state")] if state else [])
        ).dropna(subset=on)
        # one row a key, so that the hot keys of the references can be salted against it
        if state is None:
            t = t.groupBy(*on).agg(F.lit(True).alias("_found"))
            ok = F.col("_found").isNotNull()
        elif on == inner:
            before = F.filter("_state", lambda s: s["at"] <= F.col(kept["at"]))
            ok = F.get(before, F.size(before) - 1)["alive"]
        else:
            raise ValueError("state needs whole keys")
        nulls = [F.lit(None).cast(packed.schema[i].dataType).alias(i) for i in inner if i not in on]
        joined = salted_join(own.drop(*[i for i in inner if i not in on]), t, on).filter(~F.coalesce(ok, F.lit(False)))
        parts.append(joined.select("*", *nulls).select(*packed.columns))
    names = dict(zip(keys, inner)) | kept
    return reduce(DataFrame.unionByName, parts).select(
        *[F.col(names[c]).alias(c) for c in cols], F.col("_mask").alias("null_mask")
    )


def month_states(ingests: DataFrame, removals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the state after each month in which anything happened: array of (at, alive) by month.

    ingests and removals hold keys and ``ts``. A removal ends all rows ingested at or before it. Only the
    last ingest and the last removal of a month count for the state at its end, so each key is reduced to
    one row a month before anything is collected: the arrays are bounded by the calendar.
    """
    at = (F.year("ts") * 12 + F.month("ts") - 1).alias("at")
    ev = ingests.select(*keys, at, F.col("ts").alias("_in"), F.lit(None).cast("timestamp_ntz").alias("_out")).unionByName(
        removals.select(*keys, at, F.lit(None).cast("timestamp_ntz").alias("_in"), F.col("ts").alias("_out"))
    )
    monthly = ev.dropna(subset=[*keys, "at"]).groupBy(*keys, "at").agg(F.max("_in").alias("i"), F.max("_out").alias("o"))
    alive = F.col("i").isNotNull() & (F.col("o").isNull() | (F.col("o") < F.col("i")))
    return monthly.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", alive.alias("alive")))).alias("states"))


def domain_references(clients: DataFrame, agencies: DataFrame, results: DataFrame, removals: DataFrame) -> DataFrame:
    """Dangling references of the business tables by field, month of ingestion and row.

    References are domain-shaped values compared by root; ``period`` is the month of the row's
    ingested_at, at whose end the target must be there. Rows without ingested_at have no period and are
    no references.
    """
    ntz = "timestamp_ntz"

    def refs(df: DataFrame, column: str, row: str, target: str) -> DataFrame:
        return df.filter("ingested_at IS NOT NULL").select(
            F.lit(target).alias("target"), root_domain(column).alias("root"), F.col(row).alias("row_id"),
            (F.year("ingested_at") * 12 + F.month("ingested_at") - 1).alias("at"),
        )

    every = reduce(
        DataFrame.unionByName,
        [
            refs(clients, "client_domain", "client_row", "results"),
            refs(clients, "agency_domain", "client_row", "agencies"),
            refs(results, "domain", "result_row", "clients"),
        ],
    )

    def targets(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.select(F.lit(name).alias("target"), root_domain(column).alias("root"), F.col("ingested_at").cast(ntz).alias("ts"))

    ingests = reduce(
        DataFrame.unionByName,
        [
            targets(results, "results", "domain"),
            targets(agencies, "agencies", "agency_domain"),
            targets(clients, "clients", "client_domain"),
        ],
    )
    gone = removals.select(
        F.col("table_name").alias("target"), root_domain("domain").alias("root"), F.col("removed_at").cast(ntz).alias("ts")
    )
    states = month_states(ingests, gone, ["target", "root"])
    lost = dangling_references(every, states, ["target", "root"], state="states")
    field = F.when(F.col("target") == "results", "clients.client_domain").when(
        F.col("target") == "agencies", "clients.agency_domain"
    )
    month = F.lpad((F.col("at") % 12 + 1).cast("string"), 2, "0")
    return lost.select(
        field.otherwise("results.domain").alias("ref_field"),
        F.concat_ws("-", F.lpad(F.floor(F.col("at") / 12).cast("string"), 4, "0"), month).alias("period"),
        "row_id",
    )
