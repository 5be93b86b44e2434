"""The k most similar vectors of every vector by shifted space-filling curves.

Each curve projects the unit vectors onto a few random directions, shifts the grid by a random
offset and orders the rows by their Hilbert key. Rows are range-partitioned by (key, id), so equal
keys may hold any share of the rows. Windows of neighbouring keys are scored exactly, block against
block, and across the borders of the ranges once more, so that no window ends at one; the best of all
curves are merged and ranked again. Rows that share one of their best so far then meet once more: as
vectors lie denser, two close ones are parted on every curve more often, but seldom from all that is
close to both. The work grows with the rows, not with their square: every row meets `window` rows on
each side per curve, and `SHARED` on each side per neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import staged

DIMENSIONS = 64
CURVES, PROJECTED, BITS = 6, 8, 7
WINDOW, BLOCK = 1024, 512
#: Rows on each side that a row meets among those with one neighbour in common, and the rows scored at a time.
SHARED, SHARED_BLOCK = 128, 128
#: Rows of a range partition. A tenth of them lies at its ends and travels twice; the size has no effect on what is found.
PART_ROWS = 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of grid cells (rows of integers below 2**bits); at most 63 bits in all."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # from cells to the transposed index, axis by axis
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, projected: int = PROJECTED, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors on one of the shifted curves; the directions depend on the curve's number alone."""
    rng = np.random.default_rng([curve, unit.shape[1]])
    axes = np.linalg.qr(rng.standard_normal((unit.shape[1], projected)))[0]
    reach = 3.0 / np.sqrt(unit.shape[1])  # most coordinates of unit vectors lie within it; those beyond share the edge cells
    at = (unit @ axes.astype(np.float32) + reach) / (2 * reach) * 0.5 + rng.uniform(0, 0.5, projected)
    return hilbert_keys(np.clip(at * (1 << bits), 0, (1 << bits) - 1), bits)


def window_best(vectors: np.ndarray, k: int, window: int = WINDOW, block: int = BLOCK, start: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, similarity) of the k best within the window of each row from start to end, in the given order."""
    n, end = len(vectors), len(vectors) if end is None else end
    rows, others, sims = [], [], []
    for a in range(start, end, block):
        b = min(a + block, end)
        lo, hi = max(0, a - window), min(n, b + window)
        s = vectors[a:b] @ vectors[lo:hi].T
        s[np.arange(b - a), np.arange(a - lo, b - lo)] = -2
        m = min(k, hi - lo - 1)
        if m < 1:
            continue
        best = np.argpartition(-s, m - 1, axis=1)[:, :m]
        rows.append(np.repeat(np.arange(a, b), m))
        others.append((best + lo).ravel())
        sims.append(np.take_along_axis(s, best, 1).ravel())
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(others), np.concatenate(sims)


def pack_vector(x: np.ndarray) -> bytes:
    """A vector's bytes: half precision where that loses nothing, else single precision."""
    half = x.astype(np.float16)
    return half.tobytes() if np.array_equal(half.astype(np.float32), x) else x.tobytes()


def unpack_units(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    """Unit vectors of packed ones."""
    packed = column.to_pylist()
    out = np.empty((len(packed), dimensions), np.float32)
    for i, b in enumerate(packed):
        out[i] = np.frombuffer(b, np.float16 if len(b) == 2 * dimensions else np.float32)
    # Scaled first, so that very long and very short vectors neither overflow nor vanish.
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def usable_vectors(df: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, v): packed vectors of the right length that are finite and not all zero, one per key.

    Null keys, null vectors and vectors with null elements are left out. Of differing vectors under one
    key the first in order of bytes counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dimensions)
            packed = [pack_vector(x) if np.isfinite(x).all() and x.any() else None for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "v"])

    full = df.filter((F.size(vector) == dimensions) & F.col(key).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    rows = full.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, "id string, v binary").filter("v is not null").groupBy("id").agg(F.min("v").alias("v"))


def neighbours(df: DataFrame, key: str, vector: str, k: int = 5, dimensions: int = DIMENSIONS, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """(id, others): for each usable vector the k others of highest cosine, best first; ties by id.

    Fewer than k where there are fewer others in reach. See usable_vectors for what is left out.
    """
    units = staged(usable_vectors(df, key, vector, dimensions), "vectors")
    parts = -(-units.count() // PART_ROWS) or 1

    def with_key(curve: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = curve_keys(unpack_units(b.column(1), dimensions), curve) if len(b) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0), b.column(1)], ["key", "id", "v"])

        return run

    def in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str] = []
        vectors = np.zeros((0, dimensions), np.float32)
        done = 0  # rows of the buffer that have had their window

        def emit(end: int) -> pa.RecordBatch:
            rows, others, sims = window_best(vectors, k, window, BLOCK, done, end)
            names = np.array(ids, dtype=object)
            cuts = np.searchsorted(rows, np.arange(done, end + 1)).astype(np.int32)
            order = np.argsort(rows, kind="stable")
            pairs = pa.StructArray.from_arrays([pa.array(-np.round(sims[order], 6).astype(np.float32), pa.float32()), pa.array(names[others[order]], pa.string())], ["far", "other"])
            return pa.RecordBatch.from_arrays([pa.array(ids[done:end], pa.string()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)], ["id", "near"])

        for batch in batches:
            ids.extend(batch.column(1).to_pylist())
            vectors = np.concatenate([vectors, unpack_units(batch.column(2), dimensions)]) if len(batch) else vectors
            end = len(ids) - window
            if end - done >= 4 * BLOCK:
                yield emit(end)
                drop = max(0, end - window)
                ids, vectors, done = ids[drop:], vectors[drop:], end - drop
        if done < len(ids):
            yield emit(len(ids))

    def at_ends(curve: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A range's first rows for the border before it, its last rows for the border behind it; tasks are numbered in the ranges' order."""
            part, first, last = (curve << 40) + TaskContext.get().partitionId(), 0, None
            for batch in batches:
                if first < window:
                    head = batch.slice(0, window - first)
                    first += len(head)
                    yield with_border(head, part)
                if len(batch):
                    last = batch if last is None or len(batch) >= window else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
                    last = last.slice(max(0, len(last) - window))
            if last is not None:
                yield with_border(last, part + 1)

        return run

    def with_border(batch: pa.RecordBatch, border: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), border), pa.int64()), *batch.columns], ["border", "key", "id", "v"])

    def over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of one border: a window from each side

        def scored() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            names = np.array(t.column("id").to_pylist(), dtype=object)
            rows, others, sims = window_best(unpack_units(t.column("v"), dimensions), k, window)
            order = np.argsort(rows, kind="stable")
            pairs = pa.StructArray.from_arrays([pa.array(-np.round(sims[order], 6).astype(np.float32), pa.float32()), pa.array(names[others[order]], pa.string())], ["far", "other"])
            cuts = np.searchsorted(rows[order], np.arange(len(names) + 1)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)], ["id", "near"])

        for batch in batches:
            borders = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, borders[1:] != borders[:-1], True]) if len(borders) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1].column(0)[0].as_py() != borders[a]:
                    yield scored()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield scored()

    found, ends = None, None
    for curve in range(curves):
        keyed = units.mapInArrow(with_key(curve), "key bigint, id string, v binary")
        sorted_ = keyed.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
        one = sorted_.mapInArrow(in_windows, "id string, near array<struct<far:float,other:string>>")
        found = one if found is None else found.unionByName(one)
        own = sorted_.mapInArrow(at_ends(curve), "border bigint, key bigint, id string, v binary")
        ends = own if ends is None else ends.unionByName(own)
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, near) of rows (met, id, v, own, known, least) that come sorted by met: others with the same met that beat the least similarity and are not known."""
        rest: pa.Table | None = None
        done = 0  # rows of the rest that have been scored

        def scored(t: pa.Table, start: int, end: int) -> pa.RecordBatch:
            met = t.column("met").to_numpy()
            units, ids, known, least = unpack_units(t.column("v"), dimensions), t.column("id").to_pylist(), t.column("known").to_pylist(), t.column("least").to_numpy()
            own = t.column("own").to_pylist()
            out_ids, out_near = [], []
            for a in range(start, end, SHARED_BLOCK):
                b = min(a + SHARED_BLOCK, end)
                lo, hi = max(0, a - SHARED), min(len(ids), b + SHARED)
                s = units[a:b] @ units[lo:hi].T
                s[(met[a:b, None] != met[None, lo:hi]) | (s < least[a:b, None])] = -2
                s[np.arange(b - a), np.arange(a - lo, b - lo)] = -2
                at, other = np.nonzero(s > -2)
                for i, j in zip(at.tolist(), other.tolist()):
                    if own[lo + j] not in known[a + i]:
                        out_ids.append(ids[a + i])
                        out_near.append([{"far": -round(float(s[i, j]), 6), "other": ids[lo + j]}])
            kind = pa.list_(pa.struct([("far", pa.float32()), ("other", pa.string())]))
            return pa.RecordBatch.from_arrays([pa.array(out_ids, pa.string()), pa.array(out_near, kind)], ["id", "near"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            end = len(rest) - SHARED
            if end - done >= 16 * SHARED_BLOCK:
                yield scored(rest, done, end)
                drop = max(0, end - SHARED)
                rest, done = rest.slice(drop), end - drop
        if rest is not None and done < len(rest):
            yield scored(rest, done, len(rest))

    near = "id string, near array<struct<far:float,other:string>>"
    found = found.unionByName(ends.repartition("border").sortWithinPartitions("border", "key", "id").mapInArrow(over_borders, near))
    best = staged(found.groupBy("id").agg(_best(k).alias("near")), "near")
    # Each row goes to the buckets of its neighbours with its vector and hashes of what it has already.
    least = F.when(F.size("near") < k, F.lit(-1.0)).otherwise(-F.array_max("near")["far"] - 1e-6).cast("float")
    known = F.transform("near", lambda x: F.xxhash64(x["other"]))
    to = units.join(best, "id").select(F.explode(known).alias("met"), "id", "v", F.xxhash64("id").alias("own"), known.alias("known"), least.alias("least"))
    more = to.repartition(parts, "met").sortWithinPartitions("met", "id").mapInArrow(shared, near)
    return best.unionByName(more).groupBy("id").agg(_best(k).alias("near")).select("id", F.col("near.other").alias("others"))


def _best(k: int) -> Column:
    """The k nearest of all lists of a group, each other once, the nearest first; ties by id."""
    every = F.array_sort(F.flatten(F.collect_list("near")))
    return F.transform(F.slice(F.array_distinct(F.transform(every, lambda x: x["other"])), 1, k), lambda o: F.array_min(F.filter(every, lambda x: x["other"] == o)))
