"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two compressors share a dictionary trained on ordinary text; one of them has, after it, a second
dictionary trained on what is typical of toxic text. A window that is shorter under that one is
more like toxic text. The gains of a document's windows give a few figures, and a logistic curve
over them, fitted on the training rows, turns these into a score from 0 to 1.

The fit reads a sample of labelled rows, bounded by ``max_toxic`` and ``max_ordinary``; scoring
reads every document whole. Labels, language, source and id are no inputs of a score.

Defined results: a null or empty text, or one of white space only, gets the score of a document
whose one window gains nothing; without labels of both kinds every score is the share of label 1
(0 without labels); labels that repeat or are null count once or not at all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOXIC, MAX_ORDINARY = 1500, 3000
#: Words in a window, and between two windows' starts.
WINDOW, STEP = 8, 6
#: Bytes of a piece that is counted to tell toxic from ordinary text.
PIECE = 5
BASE_BYTES, TOXIC_BYTES = 65536, 4096
MIN_MATCH = 6


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def windows_of(words: list[bytes]) -> Iterator[bytes]:
    for i in range(0, max(1, len(words) - (WINDOW - STEP)), STEP):
        yield b" ".join(words[i : i + WINDOW])


def _typical(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Per toxic text, its spans of pieces that are far more common among toxic texts."""
    pieces = lambda b: {b[i : i + PIECE] for i in range(len(b) - PIECE + 1)}
    seen: Counter = Counter()
    for b in toxic:
        seen.update(pieces(b))
    least = max(3, min(12, len(toxic) // 12))
    common = {p for p, n in seen.items() if n >= least}
    plain: Counter = Counter()
    for b in ordinary:
        plain.update(pieces(b) & common)
    typical = {p for p in common if seen[p] / len(toxic) >= 20 * (plain[p] + 0.5) / max(1, len(ordinary))}
    out = []
    for b in toxic:
        spans, i = [], 0
        while i <= len(b) - PIECE:
            j = i
            while j <= len(b) - PIECE and b[j : j + PIECE] in typical:
                j += 1
            if j > i:
                spans.append(b[i : j + PIECE - 1])
                i = j + PIECE - 1
            else:
                i += 1
        out.append(b" ".join(spans))
    return out


def _trained(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """The content of a dictionary; of few samples, for which the trainer gives none, the samples."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        counts = Counter(samples)
        return b" ".join(sorted(counts, key=lambda s: (counts[s], s)))[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=MIN_MATCH, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


class Distance:
    """The two compressors; gives the figures of a text."""

    def __init__(self, base: bytes, toxic: bytes) -> None:
        self.toxic, self.plain = _compressor(base + toxic), _compressor(base)

    def figures(self, text: str | None) -> tuple[float, ...]:
        plain, toxic = self.plain.compress, self.toxic.compress
        gains = np.array([len(plain(w)) - len(toxic(w)) for w in windows_of(words_of(text))], dtype=np.float64)
        over = np.maximum(gains - 2, 0)
        return (
            min(gains.max(), 12.0), min(np.sort(gains)[::-1][:3].sum(), 30.0), gains.mean(), np.log1p(over.sum()),
            np.log1p(10 * over.sum() / len(gains)), np.log1p(over.sum() / np.sqrt(len(gains))), (gains >= 4).mean(), np.log(len(gains)),
        )


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method; the last is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


class Model:
    """Dictionaries and curve. Fitted by halves: the curve sees texts that the dictionaries don't."""

    def __init__(self, toxic: list[str], ordinary: list[str], prior: float | None = None) -> None:
        """prior: the share of label 1 among all training rows; the sample's own if None."""
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        self.prior = share if prior is None else prior
        self.base = self.extra = b""
        self.weights = None
        if len(toxic) < 4 or len(ordinary) < 4:
            return
        part = lambda t, k, n: [x for i, x in enumerate(t) if i % n != k]
        rows, labels, folds = [], [], 3
        for k in range(folds):
            d = Distance(*self._dictionaries(part(toxic, k, folds), part(ordinary, k, folds)))
            for texts, label in ((toxic, 1.0), (ordinary, 0.0)):
                own = texts[k::folds]
                rows += [d.figures(t) for t in own]
                labels += [label] * len(own)
        x, y = np.array(rows), np.array(labels)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.weights = _logistic((x - self.mean) / self.scale, y)
        odds = lambda p: np.log(p / (1 - p))
        self.weights[-1] += odds(min(max(self.prior, 1e-6), 1 - 1e-6)) - odds(share)
        self.base, self.extra = self._dictionaries(toxic, ordinary)

    @staticmethod
    def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
        joined = lambda texts: [b" " + b" ".join(words_of(t)) + b" " for t in texts]
        bad, good = joined(toxic), joined(ordinary)
        return _trained(BASE_BYTES, good, 48, 8), _trained(TOXIC_BYTES, _typical(bad, good), 16, 6)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        if getattr(self, "distance", None) is None:
            self.distance = Distance(self.base, self.extra)
        x = (np.array([self.distance.figures(t) for t in texts]).reshape(len(texts), -1) - self.mean) / self.scale
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "distance"}


def held_out(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Model:
    """Learn from labelled rows that are not held out, at most so many of each label, by a hash of the id."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("mark"))
    known = held_out(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()).filter("NOT held_out").join(marks, "doc_id")
    counts = {r["mark"]: r["n"] for r in known.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = lambda mark, n: known.filter(F.col("mark") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # at most max_toxic + max_ordinary ids, so that no text is shuffled to find the sample
    ids = F.broadcast(pick(1, max_toxic).unionByName(pick(0, max_ordinary)))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "mark", F.coalesce("text", F.lit("")).alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r["doc_id"])))
    texts = lambda mark, n: [r["text"] for r in rows if r["mark"] == mark][:n]
    return Model(texts(1, max_toxic), texts(0, max_ordinary), counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with a column score after their own; a score column that is there is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    score = F.pandas_udf(lambda s: pd.Series(held.value.scores(s.tolist()), dtype="float64"), "double")
    return docs.withColumn("score", score(F.col("text")))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return held_out(out).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their own columns, that score under 0.5."""
    columns = docs.columns
    if "score" in columns:
        docs = docs.withColumnRenamed("score", "score_of_input")
    kept = scored(docs, fit(docs, labels)).filter("score < 0.5").drop("score")
    return kept.toDF(*columns)
