"""Substring dedup: words covered by a window that starts elsewhere too, found by phrase automata.

1. Anchors. Each window of ``WINDOW`` words is named by the smallest hash of its ``GRAM``-word
   phrases; equal windows have equal anchors. Neighbouring windows with one anchor make a run. About
   one row for 15 words leaves a document here. Anchors that occur once end here: they are counted
   with partial sums and joined back.
2. Passages. Runs with the same words are one passage with a count; one of its places is kept, and
   its words are read there.
3. Automata. Passages are dealt by anchor, and so in bounded shards all windows that could be equal
   are together. An anchor of more than ``CROWD`` different passages is dealt on by the hashes of
   their windows: each part holds the passages with a window of its own, and looks at these windows.
   A shard confirms the windows that recur, word for word, compiles stretches of them into an
   Aho-Corasick automaton over word numbers and streams all documents' passages through it, equal
   ones once.
4. Documents. What was found goes from the passages to all their places, and each document is read
   once more to drop the covered words.

A passage of a third of all documents is one row in steps 2 and 3; in steps 1 and 4 its rows are in
joins, which Spark splits. Nothing is capped.

Defined results: a null text has no words; windows don't cross documents; a window that occurs twice
in one document counts; of repeated rows every word in a window is removed; fewer words than a
window are all kept. Rows are known by doc_id and a hash of the text, whatever other columns hold.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.ids import ID, NONE, id_columns, ids_of
from tarnlake.session import discard, near, stored

WINDOW, GRAM = 35, 8
#: Windows in a run; longer runs, as of a word said over and over, are cut.
RUN = 256
#: Words of passages in a shard's automaton.
SHARD_WORDS = 1_500_000
#: Different passages of an anchor from which on it is dealt on, and that a part holds about.
CROWD = 512
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as texts need them."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 4096)
            for name, x in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, x, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def runs_of(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """(anchor, passage hash, first window, windows, whether a window recurs in the text) of each run of a text."""
    n = len(words)
    if n < WINDOW:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    own = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words]), ">u8").astype(np.uint64)
    gram = np.zeros(n - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        gram = gram * BASE + own[k : n - GRAM + 1 + k]
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    low, reach, wide = gram, 1, WINDOW - GRAM + 1
    while reach < wide:
        step = min(reach, wide - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    cuts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]])
    if (np.diff(cuts) > RUN).any():
        cuts = np.unique(np.concatenate([np.arange(a, b, RUN) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [[len(low)]]))
    first, count = cuts[:-1], np.diff(cuts)
    Powers.grow(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * Powers.up[:n], dtype=np.uint64)])
    passage = (sums[first + count + WINDOW - 1] - sums[first]) * Powers.down[first]
    passage ^= passage >> np.uint64(32)
    # a run may hold a window twice, as a phrase said over and over does
    windows = (sums[WINDOW:] - sums[:-WINDOW]) * Powers.down[: n - WINDOW + 1]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(windows), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return low[first].view(np.int64), passage.view(np.int64), first, count, np.logical_or.reduceat(again, first)


def _key(docs: DataFrame) -> DataFrame:
    """The id, text and key of a row; rows of one key have one text."""
    return docs.select(*id_columns(), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.col(ID)).withColumn("h", F.xxhash64("text"))


def _runs(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for a in range(0, len(df), 500):
                part = df.iloc[a : a + 500]
                found = [runs_of(words_of(t)) for t in part["text"]]
                sizes = [len(f[0]) for f in found]
                cols = [np.concatenate([f[i] for f in found]) for i in range(5)]
                yield pd.DataFrame({"anchor": cols[0], "passage": cols[1], "k": np.repeat(part["k"].to_numpy(), sizes), "h": np.repeat(part["h"].to_numpy(), sizes), "first": cols[2].astype(np.int32), "n": cols[3].astype(np.int32), "again": cols[4].astype(bool)})

    return keyed.select("k", "h", "text").mapInPandas(run, "anchor long, passage long, k long, h long, first int, n int, again boolean")


def part_of(window: list[bytes], parts: int) -> int:
    return xxhash.xxh64_intdigest(b" ".join(window), 1) % parts


def covered(passages: list[tuple[tuple, int, list[bytes]]]) -> list[list[tuple[int, int]]]:
    """For passages (anchor, count, words) of whole anchors, the spans of words that recurring windows cover.

    An anchor is (hash, part, parts); of several parts, only windows of that part are looked at.

    A pattern is a stretch of a passage in which every window recurs, as long as can be: a passage
    of several places as a whole, else what windows counted word for word leave. Whatever recurs in
    a passage lies in a stretch of its own, so the automaton of all stretches finds every occurrence.
    """
    numbers: dict[bytes, int] = {}
    coded = [tuple([numbers.setdefault(w, len(numbers) + 1) for w in words]) for _, _, words in passages]
    alone = Counter(a for a, _, _ in passages)
    single = {a for a, n, _ in passages if n == 1}
    windows: Counter = Counter()
    packed: list[list[bytes] | None] = []
    for (anchor, count, words), ids in zip(passages, coded, strict=True):
        if anchor in single and (alone[anchor] > 1 or count == 1):
            raw = np.array(ids, dtype=np.int32).tobytes()
            own = [raw[4 * i : 4 * (i + WINDOW)] for i in range(len(ids) - WINDOW + 1)]
            if anchor[2] > 1:
                own = [w if part_of(words[i : i + WINDOW], anchor[2]) == anchor[1] else b"" for i, w in enumerate(own)]
            packed.append(own)
            for w in own:
                if w:
                    windows[w] += count
        else:
            packed.append(None)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for (_, count, _), ids, own in zip(passages, coded, packed, strict=True):
        if count > 1:
            automaton.add_word(ids, len(ids))
        elif own is not None:
            begin = None
            for i, w in enumerate([*own, b""]):
                if windows.get(w, 0) > 1:
                    begin = i if begin is None else begin
                elif begin is not None:
                    automaton.add_word(ids[begin : i + WINDOW - 1], i + WINDOW - 1 - begin)
                    begin = None
    if not len(automaton):
        return [[] for _ in passages]
    automaton.make_automaton()
    out = []
    for ids in coded:
        spans: list[tuple[int, int]] = []
        for end, size in automaton.iter(ids):
            a, b = end - size + 1, end + 1
            while spans and a <= spans[-1][1]:
                a = min(a, spans.pop()[0])
            spans.append((a, b))
        out.append(spans)
    return out


def _located(passages: DataFrame) -> DataFrame:
    """(anchor, passage, spans) of passages (anchor, part, parts, passage, count, words), where there are spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def shard(rows: list[tuple]) -> pd.DataFrame:
            spans = covered([(r[0], r[2], r[3].split()) for r in rows])
            found = [(r[0][0], r[1], [x for s in own for x in s]) for r, own in zip(rows, spans, strict=True) if own]
            return pd.DataFrame(found, columns=["anchor", "passage", "spans"])

        for df in batches:
            anchors = zip(df["anchor"], df["part"], df["parts"], strict=True)
            for r in zip(anchors, df["passage"], df["count"], df["words"], strict=True):
                if held and r[:2] == held[-1][:2]:
                    continue  # read from rows of one key, which are alike
                if size >= SHARD_WORDS and r[0] != held[-1][0]:
                    yield shard(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3]) // 6
        if held:
            yield shard(held)

    return passages.select("anchor", "part", "parts", "passage", "count", "words").repartition("anchor", "part").sortWithinPartitions("anchor", "part", "passage").mapInPandas(run, "anchor long, passage long, spans array<int>")


def _read_passages(rows: DataFrame) -> DataFrame:
    """The words of the passages whose kept place is in a row, once for each part: (text, places)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for text, places in zip(df["text"], df["places"], strict=True):
                words = words_of(text)
                for p in places:
                    own = words[p["first"] : p["first"] + p["n"] + WINDOW - 1]
                    parts = {0} if p["parts"] == 1 else {part_of(own[i : i + WINDOW], p["parts"]) for i in range(p["n"])}
                    for part in sorted(parts):
                        out.append((p["anchor"], part, p["parts"], p["passage"], p["count"], b" ".join(own)))
            yield pd.DataFrame(out, columns=["anchor", "part", "parts", "passage", "count", "words"])

    return rows.mapInPandas(run, "anchor long, part int, parts int, passage long, count long, words binary")


def recurring_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, spans of removed words by key)."""
    keyed = _key(docs)
    every = stored(_runs(keyed), "substring-runs")
    again = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.max("again").alias("again")).filter("c > 1 OR again").select("anchor")
    runs = stored(every.join(again, "anchor"), "substring-again")
    discard(every)
    place = F.struct("k", "h", "first", "n")
    passages = stored(runs.groupBy("anchor", "passage").agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("at")), "substring-passages")
    crowds = stored(passages.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts")).filter("parts > 1"), "substring-crowds")
    parted = passages.join(near(crowds), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    by_row = parted.groupBy(F.col("at.k").alias("k"), F.col("at.h").alias("h")).agg(F.collect_list(F.struct("anchor", "parts", "passage", "count", F.col("at.first").alias("first"), F.col("at.n").alias("n"))).alias("places"))
    read = _read_passages(keyed.select("k", "h", "text").join(by_row, ["k", "h"]).select("text", "places"))
    spans = stored(_located(read), "substring-spans")
    discard(passages, crowds)
    found = runs.select("anchor", "passage", "k", "h", "first").join(spans, ["anchor", "passage"])
    moved = F.transform("spans", lambda x: x + F.col("first"))
    return keyed, found.select("k", "h", moved.alias("spans")).groupBy("k", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_words(words: list[bytes], spans: np.ndarray | None) -> list[bytes]:
    if spans is None or not len(spans):
        return words
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    pairs = np.asarray(spans).reshape(-1, 2)
    np.add.at(marks, pairs[:, 0], 1)
    np.add.at(marks, pairs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for text, spans in zip(df["text"], df["spans"], strict=True):
                words = words_of(text)
                kept = kept_words(words, spans)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"]).assign(doc_id=ids_of(df))

    keyed, spans = recurring_spans(docs)
    return keyed.join(spans, ["k", "h"], "left").select(ID, NONE, "text", "spans").mapInPandas(run, "n_words long, n_removed long, kept_sha256 string, doc_id long").select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left, its words joined by one space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            texts = [b" ".join(kept_words(words_of(t), s)).decode("utf-8", "surrogatepass") for t, s in zip(df["text"], df["spans"], strict=True)]
            yield pd.DataFrame({"doc_id": ids_of(df), "text": texts})

    keyed, spans = recurring_spans(docs)
    return keyed.join(spans, ["k", "h"], "left").select(ID, NONE, "text", "spans").mapInPandas(run, "doc_id long, text string")
