"""Encoding against the public library, packing against its invariants."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


HARD = ["", "a", "aaaaaaaaa aaaa", "L'été à Œuvre…", "日本語 😀‍", "  \n\n x\t", "it's we'll", "x" * 70_000, "ab" * 9_000, "<|endoftext|>", "­‐ don’t", "١٢٣ ½ ²"]


def test_hard_texts(library):
    e = bpe.Encoder(bpe.vocabulary_path())
    ids, at = e.encode([*HARD, None])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library(x) for x in HARD] + [[]]
    assert e.lengths([*HARD, None]).tolist() == [len(library(x)) for x in HARD] + [0]


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_any_text(library, texts):
    ids, at = bpe.encoder(bpe.vocabulary_path()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library(x) for x in texts]


def test_words_forgotten_and_learned_again(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    e = bpe.Encoder(bpe.vocabulary_path())
    for text in ("un deux trois quatre", "cinq six un", "trois un"):
        assert e.encode([text])[0].tolist() == library(text)


def test_column(spark, library):
    df = spark.createDataFrame([(1, "bonjour", "x"), (2, None, "y"), (3, "", None), (1, "bonjour", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_column(df, "doc_id", "text").collect())
    assert got == [(1, library("bonjour"))] * 2 + [(2, []), (3, [])]
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        h = np.zeros(13, np.int64)
        h[1:] = rng.integers(0, 5, 12)
        sizes = np.flatnonzero(h)
        if not len(sizes):
            continue
        from itertools import combinations

        for k in (1, 2, 3):
            pad = lambda bounds: sum(h[s] * (min(b for b in bounds if b >= s) - s) for s in sizes)
            best = min(pad((*c, sizes[-1])) for c in combinations(sizes[:-1], min(k, len(sizes)) - 1))
            got = packing.choose_boundaries(h, k)
            assert len(got) <= k and pad(tuple(got)) == best


@pytest.mark.parametrize("sizes", [[], [1], [2048], [2049, 4096, 5000, None, 0, -3], [700] * 500, list(range(1, 1200))])
def test_packing(spark, sizes):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint, container_id string")
    rows = packing.pack(df, "doc_id", "n_tokens").collect()
    held, pieces = {}, {}
    for r in rows:
        held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
    want = {i: s for i, s in enumerate(sizes) if s and s > 0}
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == want
    assert all(v <= 2048 for v in held.values())
    for i, s in want.items():
        assert len(pieces[i]) == -(-s // 2048)  # split only if larger than a container
        assert sorted(p for p, _ in pieces[i]) == list(range(len(pieces[i])))
    if len(want) > 100:
        assert len(held) <= 1.08 * -(-sum(want.values()) // 2048) + 260  # 700 fits twice only


def test_packing_in_many_shards_and_partitions(spark):
    """Shards from counts, one key for a third of the rows, and oversized items in more partitions than a thousand."""
    df = spark.range(0, 2400, 1, 1200).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), (F.lit(2049) + F.col("id") % 5000).alias("n"))
    rows = packing.pack(df, "k", "n", shard_rows=50).groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    r = rows.agg(F.max("t").alias("most"), F.sum("t").alias("all"), F.count("*").alias("n"), F.max("container_id").alias("last")).head()
    assert r["most"] <= 2048 and r["all"] == sum(2049 + i % 5000 for i in range(2400)) and r["last"] == r["n"] - 1


def test_fill_on_the_tables(spark, data):
    from quillon.llm import queries

    r = queries.p9_fill(spark, data).head()
    assert r["fullest"] <= 2048 and r["fill"] > 0.9


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "container_id bigint, n_tokens bigint")
    r = packing.fill_report(empty).head()
    assert (r["containers"], r["tokens"], r["fill"]) == (0, 0, None)
    assert packing.pack(spark.createDataFrame([], "k string, n int").withColumn("x", F.lit(1)), "k", "n").count() == 0
