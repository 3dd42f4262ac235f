"""Token ids as files: byte-level BPE, then Re-Pair grammar compression of each block.

Documents are range-partitioned and sorted by id and a hash of the text, so that blocks of whole
documents follow one another in ascending order of id. In a block, frequent pairs of symbols are
replaced by nonterminals, round after round, until no pair occurs ``LEAST`` times: each round counts
the adjacent pairs, takes the most frequent ones and replaces their occurrences where they don't
overlap, the more frequent pair first. A pair never spans two documents.

File format: a Parquet data set, one row a block, written and committed by Spark's writer and so
readable by any executor. ``part`` and ``seq`` order the blocks, ``before`` is the number of ids in
the part before the block, ``payload`` is, little-endian: magic ``RPG1``, then uint32 counts of
documents, rules and symbols, then int64 document ids, a uint8 null mark each, uint32 ends in
symbols of each document, uint32 pairs of the rules (symbol 65536 + r for rule r), uint32 expansion
lengths of the rules, uint32 symbols. A document is decoded by itself from its symbols; the
expansion lengths tell where its n-th id lies without expanding what comes before.

Defined results: a null text is an empty one and has the end id alone; repeated rows are written as
often as they come; rows of one id are in the order of a hash of their text; an id of null comes first.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.ids import ID, NONE, id_columns
from tarnlake.session import own_path

VOCABULARY = "byte_bpe_50k.json"
END = 0
BLOCK_IDS = 1 << 18
#: Pairs replaced in a round, and occurrences from which a pair is worth a rule.
RULES_A_ROUND, LEAST = 2048, 8
FIRST_RULE = 1 << 16
MAGIC = b"RPG1"

#: Texts whose characters are all of the sets below are split by these patterns, which there equal the
#: vocabulary's own pre-tokenizer; other texts go to the library whole.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SPLIT = r" ?[{0}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{0}]+|\s+(?!\S)|\s+"
SPLIT_ASCII, SPLIT = re.compile(_SPLIT.format("A-Za-z")), re.compile(_SPLIT.format(LETTERS))
UNUSUAL_ASCII = "\x1c\x1d\x1e\x1f\x7f"
UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x7e\xa1\xa3-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
SPECIAL = "<|endoftext|>"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable, else the next letter from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Remembered(dict):
    """Ids as bytes by string; the last one or two times ``bound`` are kept."""

    def __init__(self, bound: int) -> None:
        super().__init__()
        self.bound = bound
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.find(key)
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


class Words(Remembered):
    """Words as the pre-tokenizer makes them, by the library's model."""

    def __init__(self, tokenizer, bound: int = 150_000) -> None:
        super().__init__(bound)
        self.model, self.letters = tokenizer.model, _byte_letters()

    def find(self, key: str) -> bytes:
        plain = key.replace(" ", "Ġ") if key.isascii() and key.isprintable() else key.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()


class Pieces(Remembered):
    """What stands between two single spaces, with the space before it."""

    def __init__(self, words: Words, bound: int = 500_000) -> None:
        super().__init__(bound)
        self.words = words

    def find(self, key: str) -> bytes:
        # most pieces are one word of letters, or one and a mark; a word alone is remembered here, so not there too
        if key.isalpha():
            return self.words.get(f" {key}") or self.words.find(f" {key}")
        if key[:-1].isalpha() and key[-1] in ".,;:!?":
            return self[key[:-1]] + self.words[key[-1]]
        return b"".join(map(self.words.__getitem__, split_words(f" {key}")))


def split_words(text: str) -> list[str]:
    return (SPLIT_ASCII if text.isascii() else SPLIT).findall(text)


class Encoder:
    def __init__(self, name: str = VOCABULARY) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.words = Words(self.tokenizer)
        self.pieces = Pieces(self.words)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text with the end id."""
        plain = text.isascii()
        odd = any(c in text for c in UNUSUAL_ASCII) if plain else UNUSUAL.search(text)
        if odd or SPECIAL in text:
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], dtype=np.uint32)
        if "  " in text:
            raw = b"".join(map(self.words.__getitem__, split_words(text)))
        else:
            # a word begins at every single space, so pieces between spaces are split one by one
            first, *rest = text.split(" ")
            raw = b"".join([*map(self.words.__getitem__, split_words(first)), *map(self.pieces.__getitem__, rest)])
        return np.frombuffer(raw + bytes(4), dtype=np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each worker process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


BINS = 1 << 16


def _round(symbols: np.ndarray, last: np.ndarray, live: np.ndarray, first: int) -> tuple[np.ndarray, ...] | None:
    """One round: (pairs, symbols, last marks, live marks) with the most frequent pairs replaced.

    Pairs meet in bins of a hash; a bin stands for one of its pairs, whose count is exact, and another
    pair of the bin waits for a later round. Where occurrences overlap, the more frequent goes first.
    Places whose pair was counted under ``LEAST`` are no longer live: a count never grows again.
    """
    at = np.flatnonzero(live[:-1] & ~last[:-1])
    left, right = symbols[at], symbols[at + 1]
    bins = (((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA6B) + (right >> np.uint32(7)))) >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.intp)
    code = (left.astype(np.uint64) << np.uint64(32)) | right
    own = np.zeros(BINS, dtype=np.uint64)
    own[bins] = code
    same = own[bins] == code
    counts = np.bincount(bins[same], minlength=BINS)
    top = np.argpartition(counts, -RULES_A_ROUND)[-RULES_A_ROUND:]
    top = top[np.argsort(-counts[top], kind="stable")]
    top = top[counts[top] >= LEAST]
    if not len(top):
        # only pairs that a more frequent one's bin hid may be left
        return None if same.all() else (np.zeros((0, 2), np.uint32), symbols, last, _marked(len(symbols), at[~same]))
    none = len(top)
    rank = np.full(BINS, none, dtype=np.int32)
    rank[top] = np.arange(none)
    found = np.where(same, rank[bins], none)
    chosen = np.flatnonzero(found < none)
    place, value = at[chosen], found[chosen]
    follows = place[1:] == place[:-1] + 1
    before, after = np.full(len(place), none), np.full(len(place), none)
    before[1:][follows] = value[:-1][follows]
    after[:-1][follows] = value[1:][follows]
    mine = np.flatnonzero((value < before) & (value <= after))
    # a symbol said over and over makes one pair at neighbouring places: every other one of them
    again = np.flatnonzero(value == before)
    if len(again):
        begins = np.flatnonzero(np.diff(again, prepend=-2) != 1)
        offset = np.arange(len(again)) - np.repeat(begins, np.diff(np.append(begins, len(again)))) + 1
        again = again[(offset % 2 == 0) & (value[again] <= after[again])]
        mine = np.sort(np.concatenate([mine, again]))
    taken = place[mine]
    live = _marked(len(symbols), at[~same | (counts[bins] >= LEAST)])
    live[taken] = True
    live[np.maximum(taken - 1, 0)] = True
    keep = np.ones(len(symbols), dtype=bool)
    keep[taken + 1] = False
    symbols = symbols.copy()
    symbols[taken] = value[mine].astype(np.uint32) + np.uint32(first)
    last = last.copy()
    last[taken] = last[taken + 1]
    pairs = own[top]
    return np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32), symbols[keep], last[keep], live[keep]


def _marked(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[at] = True
    return out


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as pairs, symbols, ends in symbols) of ids whose documents end before ``ends``."""
    symbols = ids.astype(np.uint32)
    last = _marked(len(symbols), ends - 1)
    live = np.ones(len(symbols), dtype=bool)
    rules: list[np.ndarray] = []
    while len(symbols) > 1:
        done = _round(symbols, last, live, FIRST_RULE + sum(map(len, rules)))
        if done is None:
            break
        rules.append(done[0])
        symbols, last, live = done[1:]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)
    return table, symbols, np.flatnonzero(last) + 1


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, start, length) of every rule; a rule's parts are ids or rules of earlier rounds."""
    flat, starts, length = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    highest = np.maximum.accumulate(rules.max(axis=1)) if len(rules) else rules
    while len(length) < len(rules):
        done = len(length)
        until = int(np.searchsorted(highest, FIRST_RULE + done, side="left"))
        parts = rules[done:until].ravel()
        size = np.ones(len(parts), dtype=np.int64)
        rule = parts >= FIRST_RULE
        size[rule] = length[parts[rule].astype(np.int64) - FIRST_RULE]
        more = size.reshape(-1, 2).sum(1)
        ids = expand(parts, flat, starts, length)
        starts = np.concatenate([starts, len(flat) + np.cumsum(more) - more])
        flat, length = np.concatenate([flat, ids]), np.concatenate([length, more])
    return flat, starts, length


def expand(symbols: np.ndarray, flat: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    rule = symbols >= FIRST_RULE
    if not rule.any():
        return symbols.astype(np.uint32)
    index = np.where(rule, symbols.astype(np.int64) - FIRST_RULE, 0)
    n = np.where(rule, length[index], 1)
    ends = np.cumsum(n)
    table = np.concatenate([flat, symbols[~rule]])
    origin = np.empty(len(symbols), dtype=np.int64)
    origin[rule] = starts[index[rule]]
    origin[~rule] = len(flat) + np.arange((~rule).sum())
    return table[np.repeat(origin - (ends - n), n) + np.arange(ends[-1])]


def pack(docs: list[int | None], rules: np.ndarray, symbols: np.ndarray, ends: np.ndarray) -> bytes:
    length = expansions(rules)[2]
    parts = [
        np.array([len(docs), len(rules), len(symbols)], "<u4"), np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "u1"),
        ends.astype("<u4"), rules.astype("<u4"), length.astype("<u4"), symbols.astype("<u4"),
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Block:
    """A block read back; documents can be decoded one by one."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a block of this format")
        docs, rules, symbols = np.frombuffer(payload, "<u4", 3, 4)
        at = 16
        ids = np.frombuffer(payload, "<i8", docs, at)
        null = np.frombuffer(payload, "u1", docs, at + 8 * docs)
        self.docs = [None if n else int(d) for d, n in zip(ids, null, strict=True)]
        at += 9 * int(docs)
        self.ends = np.frombuffer(payload, "<u4", docs, at).astype(np.int64)
        at += 4 * int(docs)
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, at).reshape(-1, 2)
        at += 8 * int(rules)
        self.lengths = np.frombuffer(payload, "<u4", rules, at).astype(np.int64)
        at += 4 * int(rules)
        self.symbols = np.frombuffer(payload, "<u4", symbols, at)
        self.tables = expansions(self.rules)

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]], *self.tables)

    def token(self, i: int, n: int) -> int:
        """The n-th id of a document, by the expansion lengths, with one symbol expanded."""
        own = self.symbols[self.ends[i - 1] if i else 0 : self.ends[i]]
        size = np.where(own >= FIRST_RULE, self.lengths[np.maximum(own.astype(np.int64) - FIRST_RULE, 0)] if len(self.lengths) else 1, 1)
        before = np.concatenate([[0], np.cumsum(size)])
        k = int(np.searchsorted(before, n, side="right")) - 1
        return int(expand(own[k : k + 1], *self.tables)[n - before[k]])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends in ids) of the whole block."""
        size = np.ones(len(self.symbols), dtype=np.int64)
        rule = self.symbols >= FIRST_RULE
        size[rule] = self.lengths[self.symbols[rule].astype(np.int64) - FIRST_RULE]
        return expand(self.symbols, *self.tables), np.cumsum(size)[self.ends - 1]


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, block_ids: int = BLOCK_IDS) -> None:
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, seq, before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def block() -> pd.DataFrame:
            nonlocal held, names, size, seq, before
            rules, symbols, ends = compress(np.concatenate(held), np.cumsum([len(x) for x in held]))
            out = pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "n_ids": [size], "payload": [pack(names, rules, symbols, ends)]})
            held, names, seq, before, size = [], [], seq + 1, before + size, 0
            return out

        for df in batches:
            for doc, none, text in zip(df[ID].tolist(), df[NONE].tolist(), df["text"], strict=True):
                ids = enc.ids(text or "")
                held.append(ids)
                names.append(None if none else doc)
                size += len(ids)
                if size >= block_ids:
                    yield block()
        if held:
            yield block()

    # an id that many rows share, or null, may span partitions; rows that are equal are told apart by nothing and needn't be
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*id_columns(), "text")
    ordered.mapInPandas(blocks, "part long, seq long, before long, n_ids long, payload binary").write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    stored = spark.read.parquet(path)
    # one row a part of the write
    sums = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")
    offsets = spark.sparkContext.broadcast(dict(zip(sums["part"], sums["n"].cumsum() - sums["n"], strict=True)))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples():
                block = Block(r.payload)
                ids, ends = block.all()
                starts = np.concatenate([[0], ends[:-1]])
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                yield pd.DataFrame({
                    "doc_id": pd.array(block.docs, dtype="Int64"), "start": starts + (offsets.value[r.part] + r.before), "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
                })

    return stored.select("part", "before", "payload").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame) -> DataFrame:
    """Write the documents' ids to the shared folder and report each document from the files."""
    spark = docs.sparkSession
    path = own_path(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path)
