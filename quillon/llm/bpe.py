"""Byte-level BPE of whole columns by a pair occurrence index.

The words of a chunk of rows are laid out as one array of symbols. An index maps each pair of
neighbouring symbols that the vocabulary can merge to all positions where it stands. The active
ranks are applied in ascending order, each to all its positions at once, and only the lists of the
pairs that arise at the changed places are updated. Each distinct word is merged once per Python
worker; texts are then assembled from the words' ids without a loop over tokens.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; another one can be passed to every operator.
TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the published pre-tokenisation of this vocabulary.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters per chunk and distinct words kept by a worker: they bound its memory.
CHUNK_CHARS, KEPT_WORDS = 2_000_000, 400_000


class Vocabulary:
    """Ranks of a .tiktoken file: a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    values.append(rank)
        order = np.argsort(keys)
        self.size = size
        self.keys = np.array(keys, np.int64)[order]
        self.values = np.array(values, np.int64)[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token of each pair, -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], -1)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _greedy(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of ascending positions, those kept when overlapping occurrences (aaa) are taken from the left."""
    touches = np.zeros(len(at), bool)
    touches[1:] = following[at[:-1]] == at[1:]
    if not touches.any():
        return at
    start = np.maximum.accumulate(np.where(touches, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - start) % 2 == 0]


def merge_words(words: list[bytes], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and the number of ids of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not sizes.sum():
        return np.zeros(0, np.int32), sizes
    # A separator of -1 behind each word keeps its symbols from meeting the next word's.
    ends = np.cumsum(sizes + 1) - 1
    sym = np.full(int(ends[-1]) + 1, -1, np.int64)
    inside = np.ones(len(sym), bool)
    inside[ends] = False
    sym[inside] = voc.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    following = np.arange(1, len(sym) + 1)
    before = np.arange(-1, len(sym) - 1)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the index."""
        rank = voc.rank_of(sym[at], sym[following[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    enter(np.flatnonzero(sym[:-1] >= 0))
    last = len(sym) - 1
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        live = at[sym[at] >= 0]
        live = live[voc.rank_of(sym[live], sym[following[live]]) == rank]
        if not len(live):
            continue
        live = _greedy(np.sort(live), following)
        gone = following[live]
        sym[live] = rank
        sym[gone] = -2
        after = following[gone]
        following[live] = after
        before[after] = live
        left = before[live]
        enter(np.unique(np.concatenate([left[left >= 0], live[after <= last]])))
    kept = np.flatnonzero(sym > -2)
    is_end = sym[kept] == -1
    counts = np.diff(np.r_[-1, np.flatnonzero(is_end)]) - 1
    return sym[kept[~is_end]].astype(np.int32), counts


def appended(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """held with new values behind the used ones; twice as long where they do not fit."""
    if used + len(new) > len(held):
        held = np.concatenate([held[:used], np.zeros(max(used, len(new)) + len(new), held.dtype)])
    held[used : used + len(new)] = new
    return held


class Encoder:
    """Encodes lists of texts; keeps the ids of the words it has met."""

    def __init__(self, path: str):
        import regex

        self.voc = vocabulary(path)
        self.find = regex.compile(WORD_PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)  # the three grow by doubling; what is used of them is counted
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.used_flat = self.used = 0

    def _learn(self, new: list[str]) -> None:
        flat, count = merge_words([w.encode("utf-8", "surrogatepass") for w in new], self.voc)
        self.start = appended(self.start, self.used, self.used_flat + np.cumsum(count) - count)
        self.count = appended(self.count, self.used, count)
        self.flat = appended(self.flat, self.used_flat, flat)
        self.used, self.used_flat = self.used + len(count), self.used_flat + len(flat)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and how many each text has."""
        if len(self.known) > KEPT_WORDS:
            self.clear()
        known, numbers, per = self.known, [], []
        seen = len(known)

        class Number(dict):
            def __missing__(self, word: str) -> int:
                self[word] = n = len(self)
                return n

        if not isinstance(known, Number):
            known = self.known = Number(known)
        for text in texts:
            found = self.find(text) if text else []
            per.append(len(found))
            numbers.extend(map(known.__getitem__, found))
        if len(known) > seen:
            import itertools

            self._learn(list(itertools.islice(known, seen, None)))
        return np.array(numbers, np.int64), np.array(per, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's ids."""
        numbers, per = self.words(texts)
        count = self.count[numbers]
        total = np.r_[0, np.cumsum(count)]
        where = np.repeat(self.start[numbers] - total[:-1], count) + np.arange(total[-1])
        return self.flat[where], total[np.r_[0, np.cumsum(per)]]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        numbers, per = self.words(texts)
        total = np.r_[0, np.cumsum(self.count[numbers])]
        return np.diff(total[np.r_[0, np.cumsum(per)]])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK_CHARS; a longer text has a slice for itself."""
    sizes = np.array([len(x) if x else 0 for x in batch.column(text).to_pylist()], np.int64)
    group = (np.cumsum(sizes) - sizes) // CHUNK_CHARS
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        yield batch.slice(int(at[0]), len(at))


def vocabulary_path(tokenizers: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(tokenizers or TOKENIZERS, f"{name}.tiktoken")


def encode_column(df: DataFrame, key: str, text: str, tokenizers: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """(key, ids) of each row; ids is empty for a null and for an empty text. Rows keep their multiplicity."""
    path = vocabulary_path(tokenizers, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 1):
                ids, offsets = encoder(path).encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    source = df.select(F.col(key), F.col(text).alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, tokenizers: str | None = None, name: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each row, 0 for null and empty texts."""
    path = vocabulary_path(tokenizers, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 1):
                n = encoder(path).lengths(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    source = df.select(F.col(key), F.col(text).alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
