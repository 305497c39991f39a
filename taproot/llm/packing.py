"""Filling containers of fixed capacity by sum of squares.

With N(g) the number of open containers that have room for g more tokens, each document goes where the sum of the N(g)
squared becomes smallest.  Blocks of documents are packed side by side; the containers that a block leaves with room
are packed again as wholes, so that the number of blocks hardly shows in the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.plans.lineage import cut

#: Tasks that blocks are spread over, at most.
MOST_TASKS = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, numbered from 0; sizes run from 0 to ``capacity`` and are placed in the given order.

    Ties go to the fullest container, a new one comes last.  Items of size 0 go into container 0.
    """
    count = np.zeros(capacity + 1, np.int64)  # open containers by room
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    home = np.zeros(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        if s == capacity:
            home[i] = made
            made += 1
            continue
        rooms = np.flatnonzero(count[s:capacity]) + s
        best, cost = -1, 2 * int(count[capacity - s]) + 1
        if len(rooms):
            change = 2 * (count[rooms - s] - count[rooms]) + 2
            if rooms[0] == s:
                change[0] = 1 - 2 * count[s]
            at = int(change.argmin())
            if change[at] <= cost:
                best = int(rooms[at])
        if best < 0:
            best, bin_ = capacity, made
            made += 1
        else:
            bin_ = open_[best].pop()
            count[best] -= 1
        home[i] = bin_
        if best > s:
            open_[best - s].append(bin_)
            count[best - s] += 1
    return home


def _round(items: DataFrame, keys: list[str], capacity: int, block_items: int, n: int) -> DataFrame:
    """``keys`` with ``block`` and ``bin``; items have ``size``."""
    blocks = max(1, math.ceil(n / block_items))
    schema = ", ".join([*(f"`{k}` {t}" for k, t in items.select(*keys).dtypes), "block long", "bin long"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        # Large items first; equal ones by key, so that the result is the same in every run.
        rows = rows.sort_values(["size", *keys], ascending=[False, *[True] * len(keys)], kind="stable")
        return rows[[*keys, "block"]].assign(bin=sum_of_squares(rows["size"].to_numpy(np.int64), capacity))

    # A number of partitions of our own is left as it is; else small blocks would be put into one task.
    spread = items.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks))).repartition(min(blocks, MOST_TASKS), "block")
    return spread.groupBy("block").applyInPandas(pack, schema)


def pack(df: DataFrame, key: str, size: str, capacity: int, *, block_items: int = 20_000, full: float = 0.995) -> DataFrame:
    """Containers of ``capacity`` for the rows of ``df``, one row for each piece of an item.

    Columns: ``container`` (string), the key, ``piece`` (from 0), ``start`` (offset of the piece in its item) and
    ``size``.  Only an item larger than the capacity is cut: into full containers of its own and a rest that is packed
    like any item.  An item of size 0 goes into some container as a piece of size 0; an item of null or negative size,
    or null key, isn't packed.  A key may come only once; of repeated keys the row with the greatest size counts.  An
    empty table gives an empty table.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = dict(df.dtypes)[key]
    items = cut(
        df.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("key is not null and size >= 0").groupBy("key").agg(F.max("size").alias("size"))
    )
    whole = (F.col("size") / capacity).cast("long")
    own = items.where(F.col("size") > capacity).select("key", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    own = own.select(
        F.concat_ws("-", F.lit("own"), F.col("key").cast("string"), "piece").alias("container"), "key", F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("size"),
    )
    cutting = F.col("size") > capacity
    rest = items.select(
        "key", F.when(cutting, whole).otherwise(0).cast("int").alias("piece"), F.when(cutting, whole * capacity).otherwise(0).cast("long").alias("start"),
        F.when(cutting, F.col("size") - whole * capacity).otherwise(F.col("size")).alias("size"),
    ).where("start = 0 or size > 0")
    first = cut(_round(rest.select("key", "size"), ["key"], capacity, block_items, items.count()).join(rest, "key"))
    bins = first.groupBy("block", "bin").agg(F.sum("size").alias("size"))
    loose = cut(bins.where(F.col("size") < full * capacity).select(F.concat_ws("-", "block", "bin").alias("name"), "size"))
    again = _round(loose, ["name"], capacity, block_items, loose.count()).select("name", F.concat_ws("-", F.lit("b"), "block", "bin").alias("joined"))
    packed = first.withColumn("name", F.concat_ws("-", "block", "bin")).join(again, "name", "left")
    packed = packed.select(F.coalesce("joined", F.concat(F.lit("a-"), "name")).alias("container"), "key", "piece", "start", "size")
    return own.unionByName(packed).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row on containers made by :func:`pack`: ``containers``, ``tokens``, ``least`` (containers that so many tokens take
    in any case), ``unused`` (share of the space left over) and ``fullest`` (tokens of the fullest)."""
    used = packed.groupBy("container").agg(F.sum("size").alias("used"))
    total = F.coalesce(F.sum("used"), F.lit(0))
    unused = F.when(F.count("*") > 0, 1 - total / (F.count("*") * capacity)).otherwise(0.0)
    return used.agg(F.count("*").alias("containers"), total.alias("tokens"), F.ceil(total / capacity).alias("least"), unused.alias("unused"), F.coalesce(F.max("used"), F.lit(0)).alias("fullest"))
