"""SimHash, line dedup and substring dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tarnlake.llm import line_dedup, simhash, substring

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_report(frame(spark, texts)).collect()}
    fps = [fingerprint(t) for t in texts]
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(enumerate(fps), components(fps), strict=True)}


@pytest.mark.parametrize("limit", [2048, 4])
def test_links_of_random_fingerprints(spark, monkeypatch, limit):
    """Also with cells so small that they are dealt into chunks."""
    monkeypatch.setattr(simhash, "CELL_ROWS", limit)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(4)]]))
    signed = [int(x) for x in fps.view(np.int64)]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    place = {x: i for i, x in enumerate(signed)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        a, b = root(place[r.src]), root(place[r.dst])
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == components([int(x) for x in fps])


def test_one_of_each_keeps_columns_and_equal_rows_once(spark, texts):
    docs = frame(spark, texts)
    kept = simhash.one_of_each(docs.unionByName(docs))
    assert kept.columns == docs.columns
    fps = [fingerprint(t) for t in texts]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(fps)))


def test_null_ids_and_empty_tables(spark, texts):
    docs = frame(spark, ["a b c d e", "a b c d e", None], ids=[None, 5, None])
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_report(docs).collect()} == {(None, 5), (5, 5), (None, None)}
    empty = docs.limit(0)
    for f in (simhash.simhash_report, simhash.one_of_each, substring.substring_report, line_dedup.line_report):
        assert f(empty).count() == 0
    assert substring.substring_report(docs).count() == 3 and line_dedup.line_report(docs).count() == 3


@pytest.mark.parametrize("crowd", [512, 1])
def test_substring(spark, texts, monkeypatch, crowd):
    """Also with anchors so crowded that they are dealt on by window."""
    monkeypatch.setattr(substring, "CROWD", crowd)
    # passages that differ around one phrase
    phrase = [f"p{i}" for i in range(45)]
    texts = [*texts, *[" ".join([f"a{i}", *phrase[i % 3 :], f"b{i}", f"c{i}"] * 2) for i in range(9)]]
    docs = [WORD.findall(t or "") for t in texts]
    n = substring.WINDOW
    windows = Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1))
    want = {}
    for i, w in enumerate(docs):
        gone = set()
        for s in range(len(w) - n + 1):
            if windows[tuple(w[s : s + n])] > 1:
                gone |= set(range(s, s + n))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_report(frame(spark, texts)).collect()}
    assert got == want
    left = {r.doc_id: r.text for r in substring.without_repeats(frame(spark, texts)).collect()}
    assert all(hashlib.sha256(left[i].encode()).hexdigest() == w[2] for i, w in want.items())


def test_substring_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = frame(spark, [text, text, text + " x"], ids=[1, 1, 2])
    assert sorted((r.doc_id, r.n_removed) for r in substring.substring_report(docs).collect()) == [(1, 50), (1, 50), (2, 50)]


@pytest.mark.parametrize("crowd", [32, 2])
def test_lines(spark, texts, monkeypatch, crowd):
    """Also with every shared word crowded, so that the first round has work."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "TASK_ROWS", 1 << 17 if crowd > 2 else 8)
    texts = ["\n".join([t or "", "the of and in a line that many hold", "x y", ""]) if i % 3 == 0 else t for i, t in enumerate(texts)]
    seen, want = [], {}
    inverted = defaultdict(list)
    for i, t in enumerate(texts):
        gone = []
        lines = (t or "").split("\n")
        for n, line in enumerate(lines):
            w = frozenset(WORD.findall(line))
            if not w:
                continue
            shared = Counter(j for x in w for j in inverted[x])
            if any(o * 10 >= 8 * (len(w) + len(seen[j]) - o) for j, o in shared.items()):
                gone.append(n)
            for x in w:
                inverted[x].append(len(seen))
            seen.append(w)
        want[i] = (len(lines), len(gone), ",".join(map(str, gone)))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed_lines) for r in line_dedup.line_report(frame(spark, texts)).collect()}
    assert got == want
    if crowd == 2:
        return
    left = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame(spark, texts)).collect()}
    assert all(len(left[i].split("\n")) == max(1, n - m) for i, (n, m, _) in want.items())


def test_one_of_each_component_without_or_with_shared_ids(spark, texts):
    """Each component keeps one row, of its smallest id, where ids are null or stand on different texts."""
    texts = [*texts, "xx yy", None]
    ids = [None if i % 3 == 0 else 5 if i % 3 == 1 else i for i in range(len(texts))]
    comps = components([fingerprint(t) for t in texts])
    # rows that differ only in where a null stands
    langs = ["en"] * (len(texts) - 2) + [None, "xx yy"]
    ids[-2:] = [7, 7]
    least = {}
    for c, i in zip(comps, ids, strict=True):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    kept = simhash.one_of_each(frame(spark, texts, langs, ids=ids)).collect()
    of_text = dict(zip(texts, comps, strict=True))
    assert sorted(of_text[r.text] for r in kept) == sorted(set(comps))
    assert all(r.doc_id == least[of_text[r.text]] for r in kept)


def test_repeated_rows_are_later_lines(spark):
    """Equal rows keep their lines once; equal sets in another order or with other blanks are equal."""
    texts = ["a b c d\n\nx y z", "a b c d\n\nx y z", "a b c d\n\nx y z", "new line here now\nd  c b\ta", None, "\r\n\x0b", "z y x x"]
    docs = frame(spark, texts, ids=[1, 1, 1, 2, 3, None, 9])
    got = sorted((r.doc_id or -1, r.n_lines, r.removed_lines) for r in line_dedup.line_report(docs).collect())
    assert got == [(-1, 2, ""), (1, 3, ""), (1, 3, "0,2"), (1, 3, "0,2"), (2, 2, "1"), (3, 1, ""), (9, 1, "0")]
    left = sorted((r.doc_id or -1, r.text) for r in line_dedup.without_repeated_lines(docs).collect())
    assert left == [(-1, "\r\n\x0b"), (1, ""), (1, ""), (1, "a b c d\n\nx y z"), (2, "new line here now"), (3, ""), (9, "")]


def test_very_long_line(spark):
    words = [f"w{i}" for i in range(30_000)]
    near = ["x" if i % 50 == 7 else w for i, w in enumerate(words)]
    docs = frame(spark, [" ".join(words), " ".join(near), " ".join(words[:15_000])], ids=[1, 2, 3])
    assert [(r.doc_id, r.n_removed) for r in line_dedup.line_report(docs).orderBy("doc_id").collect()] == [(1, 0), (2, 1), (3, 0)]


def test_first_round_writes_no_row_for_each_crowded_word_of_a_line(spark, monkeypatch):
    """Its tables have a row a crowded word, with the earliest class also where ids are equal or null."""
    monkeypatch.setattr(line_dedup, "CROWD", 3)
    words = [f"word{i}" for i in range(12)]
    texts = ["\n".join(" ".join([*words[:j], f"x{i}y{j}", *words[j + 1 :]]) for j in range(5)) for i in range(12)]
    docs = frame(spark, texts, ids=[None, None, 5, 5, 5, 3, 2, 9, 8, 7, 7, 6])
    classes = line_dedup.line_classes(line_dedup.numbered(line_dedup.lines_of(docs), line_dedup.rarity_table(docs))).persist()
    rows = line_dedup.prefixes(classes).collect()
    crowds = defaultdict(list)
    for r in rows:
        crowds[r.token].append((r.k, r.h, r.n))
    firsts = {t: min(found) for t, found in crowds.items() if len(found) > 3}
    held = {}
    keep = line_dedup.stored

    def noted(df, label):
        out = keep(df, label)
        held[label] = out.collect()
        return out

    monkeypatch.setattr(line_dedup, "stored", noted)
    line_dedup.led(classes)
    assert {r.token: (r.lk, r.lh, r.ln) for r in held["line-firsts"]} == firsts
    assert len(rows) > 3 * len(firsts) > 0 and all(len(found) <= len(firsts) for label, found in held.items() if label != "line-led")
    assert held["line-led"]
    classes.unpersist()
