"""Filling containers of fixed capacity by optimal length buckets.

A histogram of the sizes (at most `capacity` different ones, whatever the number of rows) goes to
the driver. Dynamic programming over it chooses the bucket boundaries of least padding. Batches
under the token budget are then planned over the bucket counts: each is led by the largest bucket
that still has items, and a subset sum over the other buckets fills what is left. A plan says how
often a batch repeats, so it is as short for a billion items as for a thousand; every item finds
its container from its rank within its bucket. Ranks are counted in shards of a bounded number of
rows, as many as a bucket's count asks for, so that one bucket may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import checked_broadcast, staged

CAPACITY, BUCKETS = 2048, 128
#: Rows of a shard, in which ranks are counted by one task.
SHARD_ROWS = 100_000


def choose_boundaries(histogram: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most `buckets` ranges of sizes whose padding is least; histogram[s] counts size s."""
    sizes = np.flatnonzero(histogram)
    if not len(sizes):
        return np.zeros(0, np.int64)
    weight = histogram[sizes].astype(np.float64)
    count = np.r_[0, np.cumsum(weight)]
    total = np.r_[0, np.cumsum(weight * sizes)]
    # cost[i, j]: the padding of sizes i..j-1 in one bucket
    cost = sizes[None, :] * (count[None, 1:] - count[:-1, None]) - (total[None, 1:] - total[:-1, None])
    cost[np.tril_indices(len(sizes), -1)] = np.inf
    best, cuts = cost[0], []
    for _ in range(1, min(buckets, len(sizes))):
        through = np.r_[np.inf, best[:-1]][:, None] + cost
        start = through.argmin(0)
        cuts.append(start)
        best = np.minimum(through[start, np.arange(len(sizes))], best)
        cuts[-1] = np.where(through[start, np.arange(len(sizes))] <= best, start, -1)
    bounds, j = [], len(sizes) - 1
    for start in reversed(cuts):
        if start[j] < 0:
            continue
        bounds.append(sizes[j])
        j = start[j] - 1
        if j < 0:
            break
    if j >= 0:
        bounds.append(sizes[j])
    return np.array(sorted(bounds), np.int64)


def _fill(space: int, sizes: list[int], left: list[int]) -> dict[int, int]:
    """How many items of each bucket fill `space` best; larger ones are preferred."""
    reach, trail = 1, []
    mask = (1 << (space + 1)) - 1
    for b in range(len(sizes) - 1, -1, -1):
        many = min(left[b], space // sizes[b])
        step = 1
        while many > 0:
            n = min(step, many)
            trail.append((reach, b, n))
            reach |= (reach << (n * sizes[b])) & mask
            many -= n
            step *= 2
    at, taken = reach.bit_length() - 1, {}
    for before, b, n in reversed(trail):
        if not (before >> at) & 1:
            taken[b] = taken.get(b, 0) + n
            at -= n * sizes[b]
    return taken


def plan_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Rows (bucket, first_rank, end_rank, per, first_container): the items of those ranks go `per` to a container."""
    sizes, left = [int(x) for x in bounds], [int(x) for x in counts]
    rank, rows, container = [0] * len(sizes), [], 0
    for lead in range(len(sizes) - 1, -1, -1):
        while left[lead]:
            left[lead] -= 1
            batch = _fill(capacity - sizes[lead], sizes[: lead + 1], left)
            left[lead] += 1
            batch[lead] = batch.get(lead, 0) + 1
            times = min(left[b] // n for b, n in batch.items())
            for b, n in batch.items():
                rows.append((b, rank[b], rank[b] + n * times, n, container))
                rank[b] += n * times
                left[b] -= n * times
            container += times
    return pd.DataFrame(rows, columns=["bucket", "first_rank", "end_rank", "per", "first_container"])


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, buckets: int = BUCKETS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, piece, n_tokens, container_id): every item in one container, oversized ones in several.

    An item is split only if it is larger than the capacity: its full pieces fill containers of their
    own and the rest is packed like an item. Null sizes and sizes below 1 get no container. Repeated
    keys are separate items, and may be any share of the rows. Ties are ordered by key, those of one key by
    their place in the input. An empty input gives no rows.
    """
    spark = sizes.sparkSession
    items = sizes.select(F.col(key).alias(key), F.col(size).cast("bigint").alias("_n")).filter("_n >= 1")
    whole = F.floor((F.col("_n") - 1) / capacity)  # pieces besides the last one; an exact multiple has a full last one
    items = staged(items.withColumns({"_whole": whole, "_rest": F.col("_n") - whole * capacity, "_row": F.monotonically_increasing_id()}), "sizes")
    seen = {r["_rest"]: r["n"] for r in items.groupBy("_rest").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for s, n in seen.items():
        histogram[s] = n
    bounds = choose_boundaries(histogram, buckets)
    within = np.searchsorted(bounds, np.arange(capacity + 1))
    counts = np.bincount(within, weights=histogram, minlength=len(bounds))[: len(bounds)].astype(np.int64)
    plan = plan_batches(bounds, counts, capacity).sort_values(["bucket", "first_rank"], ignore_index=True)
    packed = int(((plan.end_rank - plan.first_rank) // plan.per + plan.first_container).max()) if len(plan) else 0
    # The rank of an item within its bucket: its place in a shard plus what the shards before hold.
    bucket_of = F.element_at(F.array(*[F.lit(int(b)) for b in within]), (F.col("_rest") + 1).cast("int"))
    shards = F.element_at(F.array(*[F.lit(max(1, -(-int(c) // shard_rows))) for c in counts]), F.col("_bucket") + 1) if len(counts) else F.lit(1)
    ranked = items.withColumn("_bucket", bucket_of).withColumn("_shard", F.pmod(F.xxhash64(key, "_n", "_row"), shards))
    before = (
        ranked.groupBy("_bucket", "_shard").agg(F.count("*").alias("_c"))
        .withColumn("_before", F.sum("_c").over(Window.partitionBy("_bucket").orderBy("_shard")) - F.col("_c"))
        .drop("_c")
    )  # a row for each shard_rows items and one more for each bucket
    ranked = ranked.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket", "_shard").orderBy(key, "_n", "_row")) - 1)
    ranked = ranked.join(checked_broadcast(before), ["_bucket", "_shard"]).withColumn("_rank", F.col("_at") + F.col("_before"))
    width = int(plan.end_rank.max()) + 1 if len(plan) else 1
    starts = (plan.bucket * width + plan.first_rank).to_numpy(np.int64)
    first, per, container = (plan[c].to_numpy(np.int64) for c in ("first_rank", "per", "first_container"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.searchsorted(starts, (b["_bucket"] * width + b["_rank"]).to_numpy(np.int64), side="right") - 1
            b["container_id"] = container[at] + (b["_rank"].to_numpy(np.int64) - first[at]) // per[at]
            yield b[[key, "_whole", "_rest", "container_id"]]

    kind = sizes.schema[key].dataType.simpleString()
    last = ranked.select(key, "_whole", "_rest", "_bucket", "_rank").mapInPandas(place, f"`{key}` {kind}, _whole bigint, _rest bigint, container_id bigint")
    rest = last.select(key, F.col("_whole").alias("piece"), F.col("_rest").alias("n_tokens"), "container_id")
    # Full pieces: their containers are numbered behind the packed ones, shard by shard of the oversized items.
    large = items.filter("_whole > 0")
    slices = max(1, -(-large.count() // shard_rows))
    large = large.withColumn("_shard", F.pmod(F.xxhash64(key, "_n", "_row"), F.lit(slices)))
    held = large.groupBy("_shard").agg(F.sum("_whole").alias("_c"))
    held = held.withColumn("_before", F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_shard")) - F.col("_c")).drop("_c")  # a row for each shard_rows items
    in_shard = Window.partitionBy("_shard").orderBy(key, "_n", "_row")
    full = (
        large.withColumn("_at", F.sum("_whole").over(in_shard) - F.col("_whole")).join(checked_broadcast(held), "_shard")
        .select(key, "_at", "_before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_whole") - 1)).alias("piece"))
        .select(key, "piece", F.lit(capacity).cast("bigint").alias("n_tokens"), (F.lit(packed) + F.col("_before") + F.col("_at") + F.col("piece")).alias("container_id"))
    )
    return rest.unionByName(full)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the share of space used, and the fewest containers there could be."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
    ).withColumns({
        "fill": F.round(F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0)), 6),
        "least_containers": F.ceil(F.col("tokens") / capacity),
    })
