"""Mixing against its SQL, token files by exact round trips, and the pipeline end to end."""

import zlib

import duckdb
import numpy as np
import pytest

from tarnlake.llm import mixing, tokens

from .conftest import frame


def by_rounds(sizes):
    """Targets by resharing until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, texts):
    sources = [("a", "b", "c", "d", None, "é")[min(i % 7, 5)] for i in range(len(texts))]
    docs = frame(spark, texts, sources=sources)
    rows = mixing.mix_report(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").encode().split()) and r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    want = by_rounds(sizes)
    for s, n in sizes.items():
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(r.size for r in rows if sources[r.doc_id] == s) / 2 + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(docs).collect()))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    assert sorted(con.execute(mixing.mix_sql()).fetchall(), key=str) == sorted(map(tuple, rows), key=str)
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {r.doc_id: r.taken // r.size for r in rows if r.taken}


def test_mixing_edges(spark):
    docs = frame(spark, [None, "", "a b", "a b"], sources=["x", None, "x", "x"], ids=[None, 1, 2, 2])
    assert mixing.mix_report(docs).count() == 4 and mixing.mix_report(docs.limit(0)).count() == 0
    assert mixing.curriculum(docs).count() == 2 and mixing.curriculum(docs.limit(0)).count() == 0


def test_curriculum_follows_its_schedule(spark):
    """A falling source is asked for early: half of its words before time (3 - sqrt 5) / 2, or 0.382."""
    docs = frame(spark, ["w " * 20] * 400, sources=["a"] * 400)
    at = sorted(r.position for r in mixing.mix_report(docs).collect())
    assert abs(at[200] / 1e6 - 0.382) < 0.01


def test_tokens(spark, texts, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    odd = ["don't  stop\n\n now", "a <|endoftext|> b", "日本語 text", "x² ½ a b", "퟿ ok", "  lead", "trail  ", "été ÀÉ 12345 a_b __"]
    texts = texts + odd
    reference = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = [np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for t in texts]
    rows = sorted(tokens.token_report(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, own in zip(rows, ids, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    repeated = tokens.token_report(frame(spark, ["a b", "a b", None], ids=[4, 4, None])).collect()
    assert sorted((r.doc_id or -1, r.start) for r in repeated) == [(-1, 0), (4, 1), (4, 4)]
    assert tokens.token_report(frame(spark, texts).limit(0)).count() == 0


def test_encoder_like_the_library():
    """Random strings over every character that the word patterns admit, and blanks of all kinds."""
    import random

    rnd = random.Random(6)
    enc = tokens.Encoder()
    admitted = [chr(c) for c in range(0x250) if not tokens.UNUSUAL.search(chr(c))]
    common = [" ", " ", " ", "\n", "\t", "\r", "'s", "'re", "a", "B", "é", "1", "22", ".", "-", "_", "word", "Straße"]
    for i in range(20_000):
        text = "".join(rnd.choice(admitted if rnd.random() < 0.4 else common) for _ in range(rnd.randint(0, 14)))
        if i % 50 == 0:
            text += rnd.choice(["日本", "<|endoftext|>", "\x1d x", "½", "  "])
        want = [*enc.tokenizer.encode(text, add_special_tokens=False).ids, tokens.END]
        assert enc.ids(text).tolist() == want, repr(text)


def test_remembered_words_are_bounded():
    enc = tokens.Encoder()
    enc.words.bound = enc.pieces.bound = 10
    text = " ".join(f"w{i % 37}x" for i in range(500))
    assert enc.ids(text).tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, tokens.END]
    assert len(enc.pieces) <= 10 and len(enc.pieces.older) <= 10


def test_tokens_of_long_texts(spark):
    """A text of several blocks stays one document."""
    text = "one two three, four\n" * 150_000
    rows = {r.doc_id: r for r in tokens.token_report(frame(spark, [text, "x"], ids=[1, 2])).collect()}
    enc = tokens.Encoder()
    own = enc.ids(text)
    assert (rows[1].start, rows[1].n_tokens, rows[1].ids_crc32) == (0, len(own), zlib.crc32(own.astype("<u4").tobytes())) and rows[2].start == len(own)


def test_no_pair_is_left_that_recurs():
    rng = np.random.default_rng(4)
    ids = rng.zipf(1.3, 60_000).clip(max=5000).astype(np.uint32)
    rules, symbols, ends = tokens.compress(ids, np.array([len(ids)]))
    pairs = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
    values, counts = np.unique(pairs, return_counts=True)
    # of a symbol that follows itself, neighbouring places overlap
    alone = (values >> np.uint64(32)) != (values & np.uint64(0xFFFFFFFF))
    assert len(rules) > 100 and counts[alone].max() < 2 * tokens.LEAST


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    for size, kinds in ((1, 3), (50, 2), (20_000, 5), (60_000, 400)):
        ids = rng.integers(0, kinds, size).astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, size + 1, max(1, size // 100)), size))
        rules, symbols, at = tokens.compress(ids, ends)
        block = tokens.Block(tokens.pack(list(range(len(ends))), rules, symbols, at))
        back, back_ends = block.all()
        assert (back == ids).all() and (back_ends == ends).all()
        for i in range(0, len(ends), 7):
            own = ids[ends[i - 1] if i else 0 : ends[i]]
            assert (block.document(i) == own).all() and block.token(i, len(own) // 2) == own[len(own) // 2]
    assert len(symbols) <= size and (tokens.compress(np.zeros(5000, np.uint32), np.array([5000]))[1]).size < 1000
    with pytest.raises(ValueError):
        tokens.Block(b"nope")


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from tarnlake.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").limit(150)
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    seen = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns, name
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2] and all(texts[r.doc_id] == r.text for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.count() == docs.count() and corpus_pipeline.STAGES[0][0] == "toxicity"
