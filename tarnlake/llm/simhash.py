"""SimHash near-duplicates, linked exactly through pivot distance tables.

A table holds each distinct fingerprint's Hamming distances to reference fingerprints. By the
triangle inequality two fingerprints within k bits of each other differ by k at most in every
coordinate. Distances to random references lie within a few bits of 32 and so can't block by
themselves; the blocking is banding. One family of references is an origin and the origin with one
bit turned: the difference of two such coordinates tells one bit of a fingerprint, and bands of
these bits are the cells. Of more than k bands, a close pair agrees on at least one (on several,
with more of them), and so meets in a cell. Inside a cell, pairs whose largest coordinate difference
to the other, random references is over k are discarded; the survivors are verified.

Cells are compared in tasks of bounded size: a cell over ``CELL_ROWS`` is dealt into chunks, and
each pair of chunks is one task. A task hands on a spanning forest of its links, not its pairs.

Defined results: a null text has no words, like an empty one; texts without words have fingerprint
zero and link with each other; equal rows are linked; the id of a component is its smallest
doc_id, null if it has none. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.ids import id_columns, ids_of
from tarnlake.operators.components import star_forest
from tarnlake.session import stored

BITS = 64
SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: References whose distances are compared inside a cell.
PIVOTS = 16
CELL_ROWS = 2048
#: Shingles that are counted at a time.
PIECE = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < SHINGLE:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    digest = xxhash.xxh64_digest
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(starts), PIECE):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + PIECE].tolist(), ends[i : i + PIECE].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns (longs without nulls) and fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            own = np.array([fingerprint(t) for t in df["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": ids_of(df), **{c: df[c] for c in carried}, "fp": own})

    return docs.select(*id_columns(), *carried, "text").mapInPandas(run, "doc_id long, " + "".join(f"{n} {docs.schema[n].dataType.simpleString()}, " for n in carried) + "fp long")


def references() -> tuple[np.ndarray, np.ndarray]:
    """(origin and its one-bit neighbours, random references); the same in every task."""
    rng = np.random.default_rng(2026)
    origin = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = np.concatenate([[origin], origin ^ (np.uint64(1) << np.arange(BITS, dtype=np.uint64))])
    return near, rng.integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, PIVOTS, dtype=np.uint64)


def distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def bands_for(fingerprints: int, most_bits: int = MOST_BITS) -> tuple[int, int]:
    """(bands, bands that a pair surely shares) that keep a cell of even data under about CELL_ROWS."""
    for bands in range(most_bits + 1, 17):
        shared = bands - most_bits
        if fingerprints / 2 ** (BITS * shared / bands) <= CELL_ROWS:
            return bands, shared
    return 16, 16 - most_bits


def cells(fps: DataFrame, bands: int, shared: int) -> DataFrame:
    """(cell, fp, coords) of every distinct fingerprint: a row for each choice of shared bands."""
    edges = np.linspace(0, BITS, bands + 1).round().astype(int)
    choices = list(combinations(range(bands), shared))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, far = references()
        for df in batches:
            own = df["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(own), 8192):
                fp = own[at : at + 8192]
                table = distances(fp, near)
                # one further from the turned bit than from the origin, or one nearer
                steps = (table[:, 1:] - table[:, :1] > 0).astype(np.uint8)
                coords = [r.tobytes() for r in distances(fp, far)]
                for c, choice in enumerate(choices):
                    where = np.concatenate([np.arange(edges[b], edges[b + 1]) for b in choice])
                    packed = np.packbits(steps[:, where], axis=1)
                    cell = [xxhash.xxh64_intdigest(r.tobytes(), c) for r in packed]
                    yield pd.DataFrame({"cell": np.array(cell, dtype=np.uint64).view(np.int64), "fp": fp.view(np.int64), "coords": coords})

    return fps.select("fp").mapInPandas(run, "cell long, fp long, coords binary")


def _forest(fp: np.ndarray, coords: np.ndarray, side: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task as (fingerprint, fingerprint) of a spanning forest.

    side: the chunk of each row; rows of one chunk are compared with the other chunk only, if there is one.
    """
    order = np.argsort(coords[:, 0], kind="stable")
    fp, coords, side = fp[order], coords[order], side[order]
    two = side.min() != side.max()
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = coords[:, 0].astype(np.int16)
    until = np.searchsorted(first, first + most_bits, side="right")
    for a in range(0, len(fp), 256):
        b = min(a + 256, len(fp))
        n = until[a:b] - np.arange(a, b) - 1
        i = np.repeat(np.arange(a, b), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + i + 1
        if two:
            keep = side[i] != side[j]
            i, j = i[keep], j[keep]
        for k in range(1, coords.shape[1]):
            if not len(i):
                break
            keep = np.abs(coords[i, k] - coords[j, k]) <= most_bits
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= most_bits
        i, j = i[keep], j[keep]
        if len(i):
            roots = np.array([root(x) for x in range(len(fp))]) if len(i) > len(fp) else None
            pairs = np.unique(np.stack([roots[i], roots[j]], 1), axis=0) if roots is not None else np.stack([i, j], 1)
            for x, y in pairs.tolist():
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    tops = np.array([root(x) for x in range(len(fp))])
    linked = tops != np.arange(len(fp))
    return fp[linked], fp[tops[linked]]


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(src, dst) fingerprints whose components are those of all pairs within most_bits."""
    bands, shared = bands_for(fps.count(), most_bits)
    table = cells(fps, bands, shared)
    sizes = table.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    dealt = table.join(sizes, "cell").withColumn("chunks", F.ceil(F.col("rows") / CELL_ROWS).cast("int")).withColumn("side", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.select("cell", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "fp", "coords")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            keys = df[["cell", "a", "b"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if not len(cuts):
                rest = df
                continue
            rest = df.iloc[cuts[-1] :]
            yield compare(df.iloc[: cuts[-1]], [0, *cuts[:-1].tolist(), int(cuts[-1])])
        if rest is not None and len(rest):
            yield compare(rest, [0, len(rest)])

    def compare(df: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        fp = df["fp"].to_numpy().view(np.uint64)
        coords = np.frombuffer(b"".join(df["coords"]), np.int8).reshape(-1, PIVOTS)
        side = df["side"].to_numpy()
        found = [_forest(fp[x:y], coords[x:y], side[x:y], most_bits) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1]
        src = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
        dst = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return dealt.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b").mapInPandas(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, fp, top (the component's fingerprint) and component_id (its smallest doc_id) of every row."""
    slim = stored(fingerprints(docs, carried), "simhash")
    classes = slim.groupBy("fp").agg(F.min("doc_id").alias("least"))
    forest = star_forest(links(classes.select("fp"), most_bits))
    named = classes.join(forest, classes["fp"] == forest["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("top"))
    named = stored(named, "simhash-classes")
    least = named.groupBy("top").agg(F.min("least").alias("component_id"))
    return slim.join(named.join(least, "top").select("fp", "top", "component_id"), "fp")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id of every row."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: the one with the smallest doc_id, null only if none has one.

    Of rows that share that id, the one whose columns' hash is smallest stays; equal rows are one.
    """
    key, columns = "simhash_row_key", docs.columns
    while any(c.startswith(key) for c in columns):
        key += "_"
    # a hash passes over nulls, so the second one, by which rows of one hash are told apart, takes the null marks too
    keys = (f"{key}1", f"{key}2")
    keyed = docs.select("*", F.xxhash64(*columns).alias(keys[0]), F.xxhash64(*[F.col(c).isNull() for c in columns], *columns).alias(keys[1]))
    report = near_duplicates(keyed, carried=keys)
    keep = report.groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("row")).select(*[F.col(f"row.{k}").alias(k) for k in keys])
    kept = keyed.join(keep, list(keys), "left_semi")
    return kept.groupBy(*keys).agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
