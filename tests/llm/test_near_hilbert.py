"""Near duplicates against brute force, nearest vectors against exact search."""

import itertools

import numpy as np
import pytest

from quillon.llm import hilbert, near


def jaccard(a, b, kind):
    s = near.Shingler(kind)
    x, y = set(s(a).tolist()), set(s(b).tolist())
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus(seed, n=160, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"mot{i}" for i in range(300)]
    texts = []
    for i in range(n):
        if i and rng.random() < 0.6:
            w = texts[rng.integers(len(texts))].split()
            for _ in range(rng.integers(0, 5)):
                w[rng.integers(len(w))] = vocabulary[rng.integers(300)]
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocabulary, words)))
    return texts


@pytest.mark.parametrize(("kind", "threshold"), [("words3", 0.6), ("words5", 0.8)])
def test_pairs_match_brute_force(spark, kind, threshold):
    texts = corpus(1)
    rows = [(f"p{i:03d}", t, "clash") for i, t in enumerate(texts)] + [("n", None, ""), ("e", "", ""), ("s", "deux mots", "")]
    pairs, members = near.near_pairs(spark.createDataFrame(rows, "id string, t string, rep string"), "id", "t", kind, threshold)
    got = {(r["id_a"], r["id_b"]) for r in near.expand(pairs, members).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows[: len(texts)], 2) if jaccard(a[1], b[1], kind) >= threshold}
    assert not got - want
    assert len(want - got) <= 0.005 * len(want) + 1


def test_repeated_rows_and_copies(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("a", text), ("a", text), ("b", text.upper()), ("c", text)]
    pairs, members = near.near_pairs(spark.createDataFrame(rows, "id string, t string"), "id", "t", "words3", 0.6)
    assert {(r["id_a"], r["id_b"]) for r in near.expand(pairs, members).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    got = {r["id"]: (r["group_id"], r["copies"], r["links"]) for r in near.groups(pairs, members).collect()}
    assert got == {i: ("a", 3, 0) for i in "abc"}


def test_empty_table(spark):
    pairs, members = near.near_pairs(spark.createDataFrame([], "id string, t string"), "id", "t")
    assert pairs.count() == 0 and near.expand(pairs, members).count() == 0 and near.groups(pairs, members).count() == 0


def test_file_names():
    s = near.Shingler("name3")
    assert near.Shingler.name("Dossier-A 12.PDF") == "dossiera12"
    assert (s("ab.pdf") == s("AB")).all() and len(s("日本.pdf")) == 0


def test_hot_shards_are_cut_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(near, "HOT", 20)
    base = [f"w{i}" for i in range(80)]
    rows = [(f"p{i:03d}", " ".join([*base[: i % 80], f"x{i}", *base[i % 80 :]])) for i in range(60)]
    pairs, members = near.near_pairs(spark.createDataFrame(rows, "id string, t string"), "id", "t", "words3", 0.6)
    got = {(r["id_a"], r["id_b"]) for r in near.expand(pairs, members).collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if jaccard(a[1], b[1], "words3") >= 0.6}


def test_vantage_tree_is_exact():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, (12, 4), dtype=np.uint64)
    fp = centres[rng.integers(0, 12, 700)].copy()
    for row in fp:
        for _ in range(rng.integers(0, 40)):
            row[rng.integers(4)] ^= np.uint64(1 << int(rng.integers(63)))
    r = 50
    got = {(min(a, b), max(a, b)) for x, y in near.vantage_pairs(fp, r) for a, b in zip(x.tolist(), y.tolist())}
    d = near._hamming(fp, fp)
    assert got == {(i, j) for i in range(700) for j in range(i + 1, 700) if d[i, j] <= r}


def test_groups_of_long_chains(spark):
    pairs = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)], "rep_a string, rep_b string")
    members = spark.createDataFrame([(f"n{i:03d}", f"n{i:03d}") for i in range(72)], "id string, rep string")
    got = {r["id"]: r["group_id"] for r in near.groups(pairs, members).collect()}
    assert {got[f"n{i:03d}"] for i in range(71)} == {"n000"} and got["n071"] == "n071"


def test_hilbert_keys_are_a_walk():
    """Every cell has a key of its own, and neighbouring keys are neighbouring cells."""
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours_against_exact_search(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 64))
    x = (centres[rng.integers(0, 60, 1500)] + 0.3 * rng.standard_normal((1500, 64))) * rng.uniform(0.1, 9, (1500, 1))
    rows = [(f"v{i:04d}", v.tolist(), "clash") for i, v in enumerate(x)] + [("n", None, ""), ("z", [0.0] * 64, ""), ("s", [1.0] * 3, ""), ("h", [None, *[1.0] * 63], ""), ("v0000", x[0].tolist(), "")]
    got = {r["id"]: r["others"] for r in hilbert.neighbours(spark.createDataFrame(rows, "id string, e array<double>, key string"), "id", "e").collect()}
    assert len(got) == 1500 and all(len(v) == 5 and k not in v for k, v in got.items())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    recall = np.mean([len({f"v{j:04d}" for j in b} & set(got[f"v{i:04d}"])) / 5 for i, b in enumerate(best)])
    assert recall >= 0.95


def test_range_borders_cut_no_window(spark, monkeypatch):
    """Small ranges find what one range finds, but for the two ends of the curve."""
    x = np.random.default_rng(11).standard_normal((1200, 64))
    df = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, e array<double>")
    found = []
    monkeypatch.setattr(hilbert, "BLOCK", 16)  # rows of a block share their windows
    for rows in (10_000, 250):
        monkeypatch.setattr(hilbert, "PART_ROWS", rows)
        found.append({r["id"]: set(r["others"]) for r in hilbert.neighbours(df, "id", "e", window=64).collect()})
    assert all(i not in v and len(v) == 5 for i, v in found[1].items())
    same = np.mean([len(v & found[1][i]) / 5 for i, v in found[0].items()])
    assert same > 0.97


def test_what_curves_part_meets_through_a_shared_neighbour(spark):
    """Windows so narrow that the curves alone find a part only."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((100, 64))
    x = centres[rng.integers(0, 100, 3000)] + 0.35 * rng.standard_normal((3000, 64))
    rows = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, e array<double>")
    got = {r["id"]: set(r["others"]) for r in hilbert.neighbours(rows, "id", "e", window=24).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    recall = np.mean([len({f"v{j:04d}" for j in b} & got[f"v{i:04d}"]) / 5 for i, b in enumerate(np.argsort(-s, axis=1)[:, :5])])
    assert recall >= 0.99


def test_equal_vectors_and_few_rows(spark):
    rows = [(f"v{i}", [1.0, *[0.0] * 63]) for i in range(4)]
    got = {r["id"]: r["others"] for r in hilbert.neighbours(spark.createDataFrame(rows, "id string, e array<double>"), "id", "e").collect()}
    assert {k: len(v) for k, v in got.items()} == {f"v{i}": 3 for i in range(4)}
    assert hilbert.neighbours(spark.createDataFrame([], "id string, e array<double>"), "id", "e").count() == 0
