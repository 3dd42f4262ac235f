"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams of 1 to 4 characters are taken per language over the training rows in one
pass; each task sums its own rows, so what is shuffled is bounded by languages times buckets. The
table of log probabilities goes to the executors by broadcast, and a batch of texts is scored by
sparse look-ups in numpy.

``max_rows`` bounds the sample of training rows (chosen by a hash of id and text). Each language has
an equal share of it; what a rare one, kept whole, can't fill goes to the rest. Prediction reads every
text whole. Language, source and id are no inputs of a prediction.

Defined results: ``und`` with score 0 for a null text and for one without a letter, and for every
text where nothing could be learned; a null language teaches nothing; ties go to the first language
in code point order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.ids import id_columns, ids_of

MAX_ROWS = 20_000
SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 14
SMOOTH = 0.5
#: Characters that are scored at a time; longer texts are scored in pieces.
PIECE = 1 << 19
SPACE = np.uint32(32)


def _mixed(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
    return (x ^ (x >> np.uint64(32))) & np.uint64(BUCKETS - 1)


def ngram_buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each n, the bucket of the n-gram that ends at each position (shorter at the start)."""
    code = np.zeros(len(points), dtype=np.uint64)
    wide = points.astype(np.uint64)
    for n in SIZES:
        shifted = np.zeros_like(wide)
        shifted[n - 1 :] = wide[: len(wide) - n + 1] if n > 1 else wide
        code = code * np.uint64(0x9E3779B97F4A7C15) + shifted
        yield _mixed(code, n)


def code_points(text: str) -> np.ndarray:
    """The lower-cased text, runs of other than letters made one space."""
    low = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pieces_of(text: str) -> Iterator[np.ndarray]:
    for i in range(0, len(text), PIECE):
        yield code_points(text[i : i + PIECE])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, rows: np.ndarray) -> None:
        self.langs = langs
        if langs:
            likely = counts + SMOOTH
            self.table = np.log(likely / likely.sum(0, keepdims=True)).astype(np.float32)
            self.prior = np.log(rows / rows.sum())

    def sums(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.prior, (len(texts), 1))
        held: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def score() -> None:
            starts = np.cumsum([0, *map(len, held)][:-1])
            points = np.concatenate(held)
            for b in ngram_buckets(points):
                for k in range(len(self.langs)):
                    np.add.at(out[:, k], owner, np.add.reduceat(self.table[:, k][b], starts, dtype=np.float64))

        for i, text in enumerate(texts):
            for p in pieces_of(text):
                held.append(p)
                owner.append(i)
                size += len(p)
                if size >= PIECE:
                    score()
                    held, owner, size = [], [], 0
        if held:
            score()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        if known:
            z = self.sums([texts[i] for i in known])
            best = z.argmax(1)
            scores[known] = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
            for i, k in zip(known, best, strict=True):
                names[i] = self.langs[k]
        return names, scores


def held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))


def shares(found: dict[str, int], max_rows: int) -> dict[str, float]:
    """The part of each language's rows that is kept: all of the rare ones, equal numbers of the others."""
    out, left = {}, max_rows
    for i, (n, lang) in enumerate(sorted((n, lang) for lang, n in found.items())):
        quota = min(n, left / (len(found) - i))
        out[lang], left = quota / n, left - quota
    return out


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    rows = held_out(docs.select("doc_id", "text", "lang")).filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, total = sorted(found), sum(found.values())
    if total > max_rows:
        kept = F.create_map(*[F.lit(x) for lang, part in shares(found, max_rows).items() for x in (lang, math.ceil(1_000_000 * part))])
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < kept[F.col("lang")])
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        for df in batches:
            for text, lang in zip(df["text"], df["lang"], strict=True):
                for p in pieces_of(text):
                    for b in ngram_buckets(p):
                        sums[place[lang]] += np.bincount(b.astype(np.int64), minlength=BUCKETS)
        k, b = np.nonzero(sums)
        yield pd.DataFrame({"k": k, "b": b, "n": sums[k, b]})

    counts = np.zeros((BUCKETS, len(langs)))
    for r in rows.select("text", "lang").mapInPandas(count, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[r.b, r.k] = r.n
    return Model(langs, counts, np.array([found[x] for x in langs], dtype=np.float64))


def langid_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            names, scores = held.value.predict(df["text"].tolist())
            yield pd.DataFrame({"doc_id": ids_of(df), "lang_pred": names, "score": scores})

    return held_out(docs.select(*id_columns(), "text").mapInPandas(score, "doc_id long, lang_pred string, score double")).select("doc_id", "held_out", "lang_pred", "score")
