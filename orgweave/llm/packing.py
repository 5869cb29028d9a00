"""Filling containers of fixed capacity: minimum bin slack over the histogram of lengths.

Lengths are small integers, so all that a packing needs to know is how many items there are of each. That
histogram, at most ``capacity`` rows however many items, goes to one task a pack. There each window takes
the longest remaining item and, by a bitset subset-sum over the remaining lengths with their counts, the
multiset that comes closest to the capacity; the counts are read back from the bitsets before each length.
A multiset is used as often as the counts allow before another is looked for, so the number of windows
computed is bounded by the lengths, not by the items. The plan maps (length, rank range) to containers;
items get their rank by length in two steps (blocks, then within blocks), so no length is gathered in one
task, and join the plan.

An item longer than the capacity is cut into full containers and a remainder; no other item is cut.
Defined results: items without a length, or of length 0, take no room and are left out; equal lengths fill
places in the order of (block, id); no items give no containers; repeated ids are separate items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgweave.shipping import ship
from orgweave.staging import stage

BLOCKS = 64


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """Multiset of the remaining lengths (descending list) with the largest sum <= room."""
    bits, full, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        most = min(counts[n], room // n)
        if not most:
            continue
        steps.append((n, bits))
        k = 1
        while most:  # copies by binary parts
            take = min(k, most)
            bits |= bits << (n * take)
            most -= take
            k *= 2
        bits &= full
        if bits >> room & 1:
            break
    total = bits.bit_length() - 1
    out: dict[int, int] = {}
    for n, before in reversed(steps):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
        if k:
            out[n] = k
    return out


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(multiset, times) until nothing remains."""
    counts = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    plan = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        fill = best_fill(counts, lengths, capacity - first)
        counts[first] += 1
        fill[first] = fill.get(first, 0) + 1
        times = min(counts[n] // k for n, k in fill.items())
        for n, k in fill.items():
            counts[n] -= k * times
        plan.append((fill, times))
        if any(not counts[n] for n in fill):
            lengths = [n for n in lengths if counts[n]]
    return plan


def _plan(hist: pd.DataFrame) -> pd.DataFrame:
    """Rows (pack, length, from_rank, to_rank, first_container, per): ranks [from, to) fill containers in turn."""
    pack, capacity = hist["pack_name"].iloc[0], int(hist["capacity"].iloc[0])
    used = dict.fromkeys(hist["length"].tolist(), 0)
    rows, container = [], 0
    for fill, times in plan_windows(dict(zip(hist["length"].tolist(), hist["items"].tolist())), capacity):
        for n, k in fill.items():
            rows.append((pack, n, used[n], used[n] + k * times, container, k))
            used[n] += k * times
        container += times
    cols = ["pack_name", "length", "from_rank", "to_rank", "first_container", "per"]
    return pd.DataFrame(rows, columns=cols).astype({c: np.int64 for c in cols[1:]})


def pack(items: DataFrame, packs: DataFrame, item_id: str, size: str) -> DataFrame:
    """(pack_name, container, item_id, piece, tokens, capacity) of every piece of every item.

    ``packs`` holds pack_name and capacity_tokens, a few rows; pieces count from 0.
    """
    ship(items.sparkSession)
    sizes = packs.select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).filter("capacity > 0").distinct()
    its = items.select(F.col(item_id).alias("_id"), F.col(size).cast("bigint").alias("_n")).filter("_n > 0")
    # the packs, a few rows, come as one array
    few = sizes.agg(F.collect_list(F.struct("pack_name", "capacity"))).scalar()
    each = its.withColumn("_p", F.explode(few)).select("_id", "_n", "_p.pack_name", "_p.capacity")
    each = each.withColumn("whole", F.floor(F.col("_n") / F.col("capacity"))).withColumn("length", F.col("_n") % F.col("capacity"))
    each = each.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(BLOCKS)).cast("int"))
    each = stage(each, "items")
    rest = each.filter("length > 0")
    by_block = rest.groupBy("pack_name", "capacity", "length", "block").agg(F.count(F.lit(1)).alias("items"))
    hist = by_block.groupBy("pack_name", "capacity", "length").agg(F.sum("items").alias("items"))
    plan = stage(
        hist.groupBy("pack_name").applyInPandas(
            _plan, "pack_name string, length bigint, from_rank bigint, to_rank bigint, first_container bigint, per bigint"
        ),
        "plan",
    )
    w = Window.partitionBy("pack_name", "length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = by_block.select("pack_name", "length", "block", F.coalesce(F.sum("items").over(w), F.lit(0)).alias("base"))
    own = Window.partitionBy("pack_name", "length", "block").orderBy("_id")
    ranked = rest.withColumn("r", F.row_number().over(own) - 1).join(base, ["pack_name", "length", "block"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("r")).drop("base", "r", "block")
    # the windows of one length follow each other: the rank's window is found by buckets of ranks
    step = 1024
    spans = plan.withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("from_rank") / step), F.floor((F.col("to_rank") - 1) / step)))
    )
    placed = ranked.withColumn("bucket", F.floor(F.col("rank") / step)).join(spans, ["pack_name", "length", "bucket"])
    placed = placed.filter("rank >= from_rank AND rank < to_rank").select(
        "pack_name",
        (F.col("first_container") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("per"))).cast("string").alias("container"),
        "_id", F.col("whole").cast("int").alias("piece"), F.col("length").alias("tokens"), "capacity",
    )
    # full pieces have containers of their own, named by item and piece
    cut = each.filter("whole > 0").select("pack_name", "_id", "capacity", F.posexplode(F.sequence(F.lit(1), "whole")).alias("piece", "_w"))
    cut = cut.select(
        "pack_name", F.concat_ws(":", F.lit("full"), "_id", "piece").alias("container"), "_id", F.col("piece").cast("int"),
        F.col("capacity").alias("tokens"), "capacity",
    )
    return placed.unionByName(cut).withColumnRenamed("_id", item_id)
