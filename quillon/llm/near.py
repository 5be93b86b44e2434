"""Near-duplicate records by fingerprints, shards and vantage points.

Every record gets the set of its shingles (runs of words or of characters), a 256-bit fingerprint
with one bit per minwise hash, and the keys of its shards (bands of three minwise hashes). Records of
equal sets form a class and are represented once. A shard is searched as a vantage-point tree: the
fingerprints are split at the median Hamming distance to a vantage point, both sides are searched on
their own, and across the border only those pairs are compared whose distances to the vantage point
differ by no more than the search radius (triangle inequality). Shards that hold too many records
are cut into blocks, and every two blocks meet in a task of their own. What is within the radius is
checked exactly against the texts.

A single tree over all fingerprints would not prune: distances between unrelated records lie close
around half the bits while the radius for a similarity of 0.6 is near a third of them, so no branch
falls to the triangle bound. The shards bring alike records together first; the trees then prune
where a shard holds clusters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import checked_broadcast, staged

BITS, BANDS, ROWS = 256, 24, 3
#: Records up to which a group is compared directly, rows of a block of comparisons, records from which a shard is cut.
LEAF, BLOCK, HOT = 64, 1024, 20_000
_RNG = np.random.default_rng(20_240_607)
_MULTIPLY = (_RNG.integers(1, 1 << 32, BITS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, BITS, dtype=np.uint64).astype(np.uint32)
_WORD = re.compile(r"[^\W_]+")


def radius(threshold: float, bits: int = BITS) -> int:
    """The fingerprint distance that a pair at the threshold exceeds about once in a million."""
    p = (1 - threshold) / 2
    return int(np.ceil(bits * p + 4.75 * np.sqrt(bits * p * (1 - p))))


class Shingler:
    """Sets of 64-bit shingle hashes. kind: words3, words5, ... or name3 (characters of a file name)."""

    def __init__(self, kind: str):
        self.words, self.n = kind.startswith("words"), int(kind[-1])
        self.known: dict[str, int] = {}

    @staticmethod
    def name(text: str) -> str:
        """A file name in lower case without extension and without everything but a-z and 0-9."""
        return re.sub("[^a-z0-9]", "", re.sub(r"\.[A-Za-z]{1,5}$", "", text).lower())

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        if not text:
            return np.zeros(0, np.uint64)
        if not self.words:
            name, n = self.name(text), self.n
            parts = {name[i : i + n] for i in range(len(name) - n + 1)} or ({name} if name else set())
            return np.unique(np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64))
        if len(self.known) > 500_000:
            self.known.clear()
        known, hashes = self.known, []
        for w in _WORD.findall(text.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        if len(hashes) < self.n:
            return np.zeros(0, np.uint64)
        w = np.array(hashes, np.uint64)
        m = len(w) - self.n + 1
        with np.errstate(over="ignore"):
            h = np.zeros(m, np.uint64)
            for i in range(self.n):
                h = (h ^ w[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return np.unique(h)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    with np.errstate(over="ignore"):
        x = low[:, None] * _MULTIPLY + _ADD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
    return x.min(0)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all fingerprints of a to all of b (rows of 64-bit words)."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _between(fp: np.ndarray, left: np.ndarray, right: np.ndarray | None, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within r of two groups of rows, or within one; block by block, only hits are kept."""
    for i in range(0, len(left), BLOCK):
        a = left[i : i + BLOCK]
        other = left[i:] if right is None else right
        for j in range(0, len(other), BLOCK):
            b = other[j : j + BLOCK]
            x, y = np.nonzero(_hamming(fp[a], fp[b]) <= r)
            if right is None and j == 0:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield a[x], b[y]


def vantage_pairs(fp: np.ndarray, r: int, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of fingerprints within r of each other, by a vantage-point tree that is searched while it is built."""
    todo = [np.arange(len(fp)) if rows is None else rows]
    while todo:
        group = todo.pop()
        if len(group) <= LEAF:
            if len(group) > 1:
                yield from _between(fp, group, None, r)
            continue
        d = _hamming(fp[group[:1]], fp[group])[0].astype(np.int64)
        middle = int(np.median(d))
        inside = d <= middle
        if inside.all() or not inside.any():
            yield from _between(fp, group, None, r)  # all at one distance: nothing to split by
            continue
        todo += [group[inside], group[~inside]]
        # Across the border: distances to the vantage point may differ by r at most.
        near_in, near_out = inside & (d >= d[~inside].min() - r), ~inside & (d <= middle + r)
        if near_in.any() and near_out.any():
            i, o = group[near_in][np.argsort(d[near_in], kind="stable")], group[near_out][np.argsort(d[near_out], kind="stable")]
            di, do = np.sort(d[near_in]), np.sort(d[near_out])
            for a in range(0, len(i), BLOCK):
                part = i[a : a + BLOCK]
                reach = np.searchsorted(do, di[min(a + BLOCK, len(i)) - 1] + r, side="right")
                yield from _between(fp, part, o[:reach], r)


def signatures(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(id, class, n, fp, keys): class identifies the set of shingles; rows without shingles are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler(kind)
        for batch in batches:
            ids, classes, sizes, fps, keys = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle(t)
                if not len(s):
                    continue
                m = minwise(s)
                ids.append(i)
                classes.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                sizes.append(len(s))
                fps.append(np.packbits((m >> np.uint32(7)).astype(np.uint8) & 1).tobytes())
                keys.append(m[: BANDS * ROWS])
            if not ids:
                continue
            bands = np.array(keys, np.uint64).reshape(len(ids), BANDS, ROWS)
            with np.errstate(over="ignore"):
                h = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                h = np.broadcast_to(h, (len(ids), BANDS)).copy()
                for c in range(ROWS):
                    h = (h ^ bands[:, :, c]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    h ^= h >> np.uint64(31)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * BANDS + 1, BANDS), pa.int32()), pa.array(h.ravel().view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(np.array(classes, np.uint64).view(np.int64), pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), lists], ["id", "class", "n", "fp", "keys"]
            )

    return df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).filter("id is not null and t is not null").mapInArrow(run, "id string, class bigint, n int, fp binary, keys array<bigint>")


def _search_shards(r: int):
    """A function over rows (key, left, right, class, fp) sorted by key, left, right: emits (a, b) class pairs within r."""

    def shard(classes: np.ndarray, sides: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.unique(np.stack([classes, sides]), axis=1, return_index=True)[1]
        classes, sides, fp = classes[first], sides[first], fp[first]
        if (sides == 0).all():
            found = vantage_pairs(fp, r)
        else:
            found = _between(fp, np.flatnonzero(sides == 1), np.flatnonzero(sides == 2), r)
        for a, b in found:
            yield np.minimum(classes[a], classes[b]), np.maximum(classes[a], classes[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def search(keys, blocks, classes, sides, fps) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1]), True])
            many = np.flatnonzero(np.diff(cuts) > 1)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for m in many:
                at = slice(cuts[m], cuts[m + 1])
                if cuts[m + 1] - cuts[m] == 2 and sides[at.start] == sides[at.start + 1] == 0:
                    continue
                out.extend(shard(classes[at], sides[at], fps[at]))
            # Shards of two, the most frequent kind, all at once.
            two = cuts[:-1][(np.diff(cuts) == 2)]
            two = two[(sides[two] == 0) & (sides[two + 1] == 0) & (classes[two] != classes[two + 1])] if len(two) else two
            if len(two):
                d = np.bitwise_count(fps[two] ^ fps[two + 1]).sum(1)
                two = two[d <= r]
                out.append((np.minimum(classes[two], classes[two + 1]), np.maximum(classes[two], classes[two + 1])))
            if out:
                pairs = np.unique(np.stack([np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            fps = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(len(batch), BITS // 64)
            return (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)), fps)

        for batch in batches:
            if not len(batch):
                continue
            now = columns(batch)
            if held and held[0][0][-1] == now[0][-1] and held[0][1][-1] == now[1][-1]:
                held.append(now)  # still within one shard
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held, now)) if held else now
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(last))
            if cut:
                yield from search(*(x[:cut] for x in rows))
            held = [tuple(x[cut:] for x in rows)]
        if held:
            yield from search(*(np.concatenate(x) for x in zip(*held)))

    return run


def similar_classes(sigs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes a < b whose fingerprints are within the radius in some shard."""
    reps = sigs.groupBy("class").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    entries = staged(reps, "shards").select(F.explode("keys").alias("key"), "class", "fp")
    # Shards of more than HOT records are cut into k parts, and every two parts meet in a task of their own.
    hot = entries.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key", (F.ceil(F.col("n") / HOT) + 1).cast("int").alias("k"))
    split = entries.join(checked_broadcast(staged(hot, "hot")), "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    mine = F.pmod(F.xxhash64("class", F.lit(7)), F.col("k")).cast("int")
    cut = split.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    entries = cut.select(
        "key", (F.least("mine", "other") * F.col("k") + F.greatest("mine", "other")).cast("bigint").alias("block"), "class",
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"), "fp",
    )
    placed = entries.repartition("key", "block").sortWithinPartitions("key", "block")
    return placed.mapInArrow(_search_shards(radius(threshold)), "a bigint, b bigint").distinct()


def near_pairs(df: DataFrame, key: str, text: str, kind: str = "words5", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (rep_a, rep_b, similarity) of class representatives, members (id, rep).

    Null and empty texts and texts with fewer words than a shingle are in no class. Rows repeated under
    one id count once if their text is the same. The representative is the class's least id.
    """
    sigs = staged(signatures(df, key, text, kind), "signatures")
    close = similar_classes(sigs, threshold)
    reps = sigs.groupBy("class").agg(F.min("id").alias("rep"))
    members = sigs.select("id", "class").distinct().join(reps, "class").select("id", "rep")
    named = close.join(reps.select(F.col("class").alias("a"), F.col("rep").alias("rep_a")), "a").join(reps.select(F.col("class").alias("b"), F.col("rep").alias("rep_b")), "b").select("rep_a", "rep_b")
    named = staged(named, "close")
    needed = named.select(F.col("rep_a").alias("id")).union(named.select(F.col("rep_b"))).distinct()
    texts = staged(
        df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).join(checked_broadcast(needed), "id", "left_semi").groupBy("id").agg(F.max("t").alias("t")), "texts"
    )
    both = named.join(texts.select(F.col("id").alias("rep_a"), F.col("t").alias("ta")), "rep_a").join(texts.select(F.col("id").alias("rep_b"), F.col("t").alias("tb")), "rep_b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(kind)
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            share = []
            for x, y in zip(ta, tb):
                p, q = shingle(x), shingle(y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                share.append(common / max(len(p) + len(q) - common, 1))
            kept = np.flatnonzero(np.array(share) >= threshold - 1e-9) if share else []
            yield pa.RecordBatch.from_arrays([pa.array([min(a[i], b[i]) for i in kept], pa.string()), pa.array([max(a[i], b[i]) for i in kept], pa.string()), pa.array([share[i] for i in kept], pa.float64())], ["rep_a", "rep_b", "similarity"])

    pairs = both.select("rep_a", "rep_b", "ta", "tb").mapInArrow(exact, "rep_a string, rep_b string, similarity double")
    return pairs, members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a smaller: pairs of records, copies of one class included."""
    copies = members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1")
    # The output is quadratic in a class's copies; its rows come from as many tasks as the class has thousands.
    several = members.join(copies, "rep").withColumn("salts", F.ceil(F.col("n") / 1000).cast("int"))
    left = several.select(F.col("id").alias("x"), "rep", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    right = several.select(F.col("id").alias("y"), "rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    within = left.join(right, ["rep", "salt"]).filter("x < y").select("x", "y")
    one = lambda c, to: members.select(F.col("rep").alias(c), F.col("id").alias(to))
    across = pairs.select("rep_a", "rep_b").join(one("rep_a", "x"), "rep_a").join(one("rep_b", "y"), "rep_b").select("x", "y")
    both = within.unionByName(across)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).filter("id_a < id_b").distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id, copies, links): every record with its connected group, its class's copies and its class's links.

    Groups come from label propagation with pointer jumping between class representatives; each round is
    a written table, and the number of rounds is about the logarithm of the longest chain.
    """
    edges = pairs.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))
    edges = staged(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = staged(edges.select("u").distinct().select(F.col("u"), F.col("u").alias("label")), "labels")
    while True:
        spread = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("seen"))
        step = labels.join(spread, "u").select("u", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        jump = step.select("u", F.col("label").alias("via"), "was").join(step.select(F.col("u").alias("via"), F.col("label").alias("further")), "via", "left")
        new = staged(jump.select("u", F.least("via", F.coalesce("further", "via")).alias("label"), "was"), "labels")
        changed = not new.filter("label <> was").isEmpty()
        labels = new.select("u", "label")
        if not changed:
            break
    links = edges.groupBy("u").agg(F.count("*").alias("links"))
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    return (
        members.join(copies, "rep").join(labels.withColumnRenamed("u", "rep"), "rep", "left").join(links.withColumnRenamed("u", "rep"), "rep", "left")
        .select("id", F.coalesce("label", "rep").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
