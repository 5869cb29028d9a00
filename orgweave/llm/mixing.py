"""Mixing sources to target shares: pivotal dependent rounding of copies.

The total is the largest at which every source can give its share: a source with ``a`` tokens, share ``s``
and at most ``m`` repeats allows m*a/s. Each document of a source is then due the same fractional number of
copies, total*s/a <= m. Its whole part is given outright; the fractions are settled by pivotal rounding:
two open documents are paired and one passes tokens to the other, the direction drawn so that every
expectation holds, until one of them is 0 or 1. Tokens are only moved, so the source's sum stays.

Documents are settled within blocks in parallel, the largest first, so that what stays open is small; each block leaves at most one open document, and the
open ones are combined by a tree of fan-in ``FAN``, one level a pass, until one a (plan, source) is left,
which is drawn. The sum of a source's tokens thus misses its share by less than one document.

Defined results: documents without a source or tokens, and sources a plan doesn't name, take no part; a
plan's sources without documents are reported with share 0 and the others keep their proportions; draws
depend on ``seed`` and the ids alone; no documents give no copies.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.shipping import ship
from orgweave.staging import stage

BLOCK, FAN = 20_000, 64
_EPS = 1e-9


def pivot(docs: list[list], rng: random.Random) -> list[list]:
    """Settle [id, tokens, p] rows in place; returns those still open, at most one."""
    held = None
    for d in docs:
        if d[2] < _EPS or d[2] > 1 - _EPS:
            d[2] = float(round(d[2]))
            continue
        if held is None:
            held = d
            continue
        # most that can pass from d to held, and back, in tokens
        give = min(d[2] * d[1], (1 - held[2]) * held[1])
        take = min(held[2] * held[1], (1 - d[2]) * d[1])
        if rng.random() < take / (give + take):
            d[2] -= give / d[1]
            held[2] += give / held[1]
        else:
            d[2] += take / d[1]
            held[2] -= take / held[1]
        for x in (d, held):
            if x[2] < _EPS or x[2] > 1 - _EPS:
                x[2] = float(round(x[2]))
        if held[2] in (0.0, 1.0):
            held = d if d[2] not in (0.0, 1.0) else None
    return [held] if held else []


_SCHEMA = "plan_name string, source string, block bigint, id bigint, tokens bigint, p double, open boolean"
_ARROW = pa.schema(
    [("plan_name", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("id", pa.int64()), ("tokens", pa.int64()),
     ("p", pa.float64()), ("open", pa.bool_())]
)


def _settle(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs = None, []

        def done() -> pa.RecordBatch:
            left = {id(d) for d in pivot(docs, random.Random(f"{seed}|{key}"))}
            n = len(docs)
            cols = [
                [key[0]] * n, [key[1]] * n, [key[2]] * n, [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs],
                [id(d) in left for d in docs],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)

        for b in batches:
            for plan, source, block, i, tokens, p in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (plan, source, block) != key:
                    if docs:
                        yield done()
                    key, docs = (plan, source, block), []
                docs.append([i, tokens, p])
        if docs:
            yield done()

    return run


def _pass(rows: DataFrame, seed: int) -> DataFrame:
    keys = ["plan_name", "source", "block"]
    rows = rows.select(*keys, "id", "tokens", "p").repartition(*keys).sortWithinPartitions(*keys, F.desc("tokens"), "id")
    return stage(rows.mapInArrow(_settle(seed), _SCHEMA), "pivot")


def due_copies(docs: DataFrame, targets: DataFrame, source: str, tokens: str) -> DataFrame:
    """(plan_name, source, share, max_repeats, available, docs, due): copies due to each document of a source."""
    have = docs.filter(F.col(source).isNotNull() & (F.col(tokens) > 0)).groupBy(F.col(source).alias("source")).agg(
        F.sum(tokens).alias("available"), F.count(F.lit(1)).alias("docs")
    )
    t = targets.select("plan_name", "source", F.col("target_share").alias("share"), "max_repeats").filter("share > 0")
    t = t.join(have, "source")
    room = t.groupBy("plan_name").agg(F.min(F.col("max_repeats") * F.col("available") / F.col("share")).alias("total"))
    return t.join(room, "plan_name").withColumn("due", F.least(F.col("total") * F.col("share") / F.col("available"), F.col("max_repeats")))


def mix(docs: DataFrame, targets: DataFrame, doc_id: str, source: str, tokens: str, seed: int = 7) -> DataFrame:
    """(plan_name, doc_id, source, tokens, copies) for every document of the plan's sources."""
    ship(docs.sparkSession)
    d = docs.filter(F.col(source).isNotNull() & (F.col(tokens) > 0)).select(
        F.col(doc_id).cast("bigint").alias("id"), F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens")
    )
    d = stage(d, "sized")  # sizes cost more than all that follows
    due = due_copies(d, targets, "source", "tokens")  # a row a plan and source
    each = d.join(F.broadcast(due.select("plan_name", "source", "due", "docs")), "source")
    each = each.withColumn("base", F.floor("due")).withColumn("p", F.col("due") - F.floor("due"))
    blocks = F.ceil(F.col("docs") / BLOCK)
    each = stage(each.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), blocks)), "due")
    first = _pass(each, seed)
    settled, open_ = first.filter("NOT open"), first.filter("open")
    level = 0
    most = open_.groupBy("plan_name", "source").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        level += 1
        nxt = _pass(open_.withColumn("block", F.floor(F.col("block") / FAN).cast("bigint")), seed + level)
        settled, open_ = settled.unionByName(nxt.filter("NOT open")), nxt.filter("open")
        most = open_.groupBy("plan_name", "source").count().agg(F.max("count")).first()[0] or 0
    # the last of a source is drawn with the probability it kept
    draw = F.pmod(F.xxhash64("plan_name", "source", "id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    last = open_.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0))
    extra = settled.unionByName(last).select("plan_name", "source", "id", F.round("p").cast("int").alias("extra"))
    base = each.select("plan_name", "source", "id", "tokens", "base").join(extra, ["plan_name", "source", "id"])
    return base.select(
        "plan_name", F.col("id").alias(doc_id), "source", "tokens", (F.col("base") + F.col("extra")).cast("int").alias("copies")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_name, source, target_share, tokens, docs_used, most_copies, share) actually reached."""
    per = mixed.groupBy("plan_name", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.when(F.col("copies") > 0, 1)).alias("docs_used"),
        F.max("copies").alias("most_copies"),
    )
    total = per.groupBy("plan_name").agg(F.sum("tokens").alias("total"))
    out = targets.select("plan_name", "source", "target_share").join(per, ["plan_name", "source"], "left").join(total, "plan_name", "left")
    zero = {"tokens": 0, "docs_used": 0, "most_copies": 0}
    return out.fillna(zero).withColumn("share", F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0))).drop("total")
