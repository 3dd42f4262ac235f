"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit distance, over words.

A document leaks an item if some run of its words is within ``1 - SIMILARITY`` of the item's length
in edits (insert, drop or change a word; words lower-cased). The CGK walk reads a sequence and at
each step stays or goes on by a random bit that depends on the step and on the word, which maps edit
distance to Hamming distance of the walks' outputs. Repeated samples of output places are the LSH
keys. Windows as long as an item are embedded at every start from which they cover a seed, a run of
words that any window so near the item must share with it (with d edits an item of n words keeps one
of (n - d) / (d + 1) words at least), so leaving the other windows out loses nothing. Windows that
share a key with an item are verified by dynamic programming.

Items go to the executors in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters;
further items take further passes. Recall of the LSH on copies at the limit of edits is measured in
the tests; copies without edits always share all keys.

Defined results: null or blank items and texts match nothing; equal items are each reported; a row
for each document row that leaks, so repeated rows repeat.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.ids import id_columns, ids_of

SIMILARITY = 0.8
BLOCK_ITEMS, BLOCK_CHARS = 4_000, 2 << 20
#: Independent walks, samples of each, places in a sample: 64 keys a window.
WALKS, SAMPLES, PLACES = 16, 4, 5
STRETCH = 3
SEED_WORDS = 3
#: Words that are looked through at a time.
PIECE = 2_000_000
#: Windows that are embedded at a time.
WINDOWS = 4000
PAD = np.uint32(0xFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def edits_allowed(n: int) -> int:
    return int(n * (1 - SIMILARITY) + 1e-9)


def nearest(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(least edits between the item and any run of the region, end of such a run)."""
    m = len(region)
    row = np.zeros(m + 1, dtype=np.int32)
    steps = np.arange(m + 1, dtype=np.int32)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (region != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32, copy=True)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


class Items:
    """A block of items: words, seeds and LSH keys."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.names, self.texts = [r[0] for r in rows], [words_of(r[1]) for r in rows]
        ids: dict[bytes, int] = {}
        self.items = [np.array([ids.setdefault(w, len(ids) + 1) for w in t], dtype=np.uint32) for t in self.texts]
        self.ids = ids
        #: Per seed length, the lengths of the items that a seed stands for.
        self.seeds: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for x in self.items:
            n, d = len(x), edits_allowed(len(x))
            q = min(SEED_WORDS, -(-(n - d) // (d + 1)))
            own = self.seeds.setdefault(q, defaultdict(set))
            for i in range(n - q + 1):
                own[tuple(x[i : i + q].tolist())].add(n)
        #: The seeds packed into one number each; ids beyond 21 bits only make it match more often.
        self.codes = {}
        for q, own in self.seeds.items():
            packed = np.zeros(len(own), dtype=np.uint64)
            for column in np.array(list(own), dtype=np.uint64).reshape(-1, q).T:
                packed = packed << np.uint64(21) | column
            self.codes[q] = np.unique(packed)
        rng = np.random.default_rng(7)
        self.salts = rng.integers(1, 1 << 32, WALKS, dtype=np.uint32)
        self.places = {}
        self.keys: dict[int, np.ndarray] = {}
        self.owners: dict[int, np.ndarray] = {}
        for n in sorted({len(x) for x in self.items}):
            self.places[n] = np.random.default_rng(n).integers(0, STRETCH * n, (WALKS, SAMPLES, PLACES))
            own = [k for k, x in enumerate(self.items) if len(x) == n]
            keys = self.embed(np.concatenate([self.items[k] for k in own]), np.arange(len(own)) * n, n, n)
            order = np.argsort(keys.ravel(), kind="stable")
            self.keys[n] = keys.ravel()[order]
            self.owners[n] = np.repeat(np.array(own), keys.shape[1])[order]

    def embed(self, words: np.ndarray, starts: np.ndarray, n: int, size: np.ndarray | int) -> np.ndarray:
        """LSH keys (windows, walks * samples) of the windows of n words at the starts, padded after ``size`` words."""
        steps = STRETCH * n
        seen = np.empty((steps, WALKS, len(starts)), dtype=np.uint32)
        at = np.zeros((WALKS, len(starts)), dtype=np.int64)
        for j in range(steps):
            symbol = np.where(at < size, words[starts + np.minimum(at, size - 1)], PAD)
            seen[j] = symbol
            at += _mix(symbol ^ (self.salts + np.uint32((j * 0x9E3779B9) & 0xFFFFFFFF))[:, None]) & np.uint32(1)
        key = np.broadcast_to(np.arange(1, WALKS * SAMPLES + 1, dtype=np.uint64).reshape(WALKS, SAMPLES, 1), (WALKS, SAMPLES, len(starts))).copy()
        walk = np.arange(WALKS)[:, None]
        for p in range(PLACES):
            key = (key ^ seen[self.places[n][:, :, p], walk]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.reshape(WALKS * SAMPLES, len(starts)).T

    def find(self, words: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, end) of each item's best place in each text of a batch.

        words: ids of all texts' words in a row; owner: the text of each word; ends: each text's end.
        """
        begins = np.concatenate([[0], ends[:-1]])
        wanted: dict[int, list[np.ndarray]] = defaultdict(list)
        for q, seeds in self.seeds.items():
            run = words[: len(words) - q + 1] > 0
            for k in range(1, q):
                run = run & (words[k : len(words) - q + 1 + k] > 0)
            places = np.flatnonzero(run)
            code = np.zeros(len(places), dtype=np.uint64)
            for k in range(q):
                code = code << np.uint64(21) | words[places + k]
            known = self.codes[q]
            places = places[known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code]
            for p in places.tolist():
                lengths = seeds.get(tuple(words[p : p + q].tolist()))
                if lengths and owner[p] == owner[p + q - 1]:
                    lo, hi = begins[owner[p]], ends[owner[p]]
                    for n in lengths:
                        # all starts whose window covers the seed; in a short text, the text's start
                        wanted[n].append(np.arange(max(lo, p + q - n), max(lo, min(p, hi - n)) + 1))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, parts in wanted.items():
            starts = np.unique(np.concatenate(parts))
            for a in range(0, len(starts), WINDOWS):
                own = starts[a : a + WINDOWS]
                # a text shorter than the item is padded, whatever follows it in the batch
                keys = self.embed(words, own, n, np.minimum(n, ends[owner[own]] - own))
                left = np.searchsorted(self.keys[n], keys, "left")
                count = np.searchsorted(self.keys[n], keys, "right") - left
                rows, cols = np.nonzero(count)
                pairs = {(int(own[r]), int(k)) for r, c in zip(rows.tolist(), cols.tolist(), strict=True) for k in self.owners[n][left[r, c] : left[r, c] + count[r, c]]}
                self._verify(sorted(pairs), words, owner, begins, ends, best)
        return [(t, k, d, e) for (t, k), (d, e) in sorted(best.items())]

    def _verify(self, pairs: list, words: np.ndarray, owner: np.ndarray, begins: np.ndarray, ends: np.ndarray, best: dict) -> None:
        seen: dict[tuple[int, int], int] = {}
        for start, k in pairs:
            text, item = int(owner[start]), self.items[k]
            n, d = len(item), edits_allowed(len(item))
            if best.get((text, k), (n, 0))[0] == 0 or start <= seen.get((text, k), -1):
                continue
            # one region serves all starts near this one
            lo, hi = max(int(begins[text]), start - d), min(int(ends[text]), start + 2 * n + d)
            seen[text, k] = start + n
            # words of the item that the region lacks are edits at least
            around = set(words[lo:hi].tolist())
            if sum(w not in around for w in item.tolist()) > d:
                continue
            got, end = nearest(item, words[lo:hi])
            if got <= d and got < best.get((text, k), (n + 1, 0))[0]:
                best[text, k] = (got, lo + end - int(begins[text]))

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(place of the text, item, distance, end in words)."""
        out, held, owners, first = [], [], [], 0
        size, get = 0, self.ids.get

        def run() -> None:
            if size:
                lens = np.array([len(h) for h in held])
                words = np.array([x for h in held for x in h], dtype=np.uint32)
                for t, k, d, e in self.find(words, np.repeat(np.arange(len(held)), lens), np.cumsum(lens)):
                    out.append((owners[t], k, d, e))

        for i, text in enumerate(texts):
            own = [get(w, 0) for w in words_of(text)]
            if own:
                held.append(own)
                owners.append(i)
                size += len(own)
            if size >= PIECE:
                run()
                held, owners, size = [], [], 0
        run()
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size, in the order of their ids."""
    rows: list[tuple[int, str]] = []
    chars = 0
    for r in benchmark.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if words_of(r["text"]):
            rows.append((r["item_id"], r["text"]))
            chars += len(r["text"])
        if len(rows) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield Items(rows)
            rows, chars = [], 0
    if rows:
        yield Items(rows)


LEAKS = "doc_id long, item_id long, distance long, item_words long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each item that a document leaks, at the place with the fewest edits."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            items = held.value
            for df in batches:
                found = items.leaks(df["text"].tolist())
                yield pd.DataFrame({
                    "doc_id": ids_of(df, np.array([f[0] for f in found], dtype=np.intp)), "item_id": [items.names[f[1]] for f in found], "distance": [f[2] for f in found],
                    "item_words": [len(items.items[f[1]]) for f in found], "end_word": [f[3] for f in found],
                }, columns=["doc_id", "item_id", "distance", "item_words", "end_word"])

        found = docs.select(*id_columns(), "text").mapInPandas(run, LEAKS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], LEAKS) if out is None else out


def _clean(held):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            keep = np.ones(len(texts), dtype=bool)
            keep[[f[0] for f in held.value.leaks(texts.tolist())]] = False
            yield pd.Series(keep)

    return F.pandas_udf(run, "boolean")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their own columns, that leak no item."""
    for block in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(block)

        docs = docs.filter(_clean(held)(F.col("text")))
    return docs


def decontam_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
