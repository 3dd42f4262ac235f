"""Personal data, toxicity, language, benchmark leaks and nearest neighbours."""

import random
import re

import numpy as np

from tarnlake.llm import ann, decontam, langid, pii, toxicity

from .conftest import frame

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_like_the_patterns():
    rnd = random.Random(9)
    pieces = ["a@b.c", "x.y+z@mail.example.com.", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "+1", "é", " ", "..", "12", "-", "a@b", "a@b@c.d", "\n", "5500005555555559", "0001.02.3.4"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 8)))
        assert pii.base_spans(text) == plain_spans(text), text
    long = "a" * 200_000 + "1" * 200_000 + "." * 1000
    assert pii.base_spans(long) == []


def test_field_learns_its_table():
    field = pii.Field()
    lines = pii.labelled_lines()
    tags = field.decode([w for w, _ in lines])
    right = sum(a == b for (_, want), got in zip(lines, tags, strict=True) for a, b in zip(want, got, strict=True))
    assert right >= 0.98 * sum(len(w) for w, _ in lines)
    found = pii.field_spans(field, ["We saw Dr. Mark Olson, and went.", "plain text and nothing more", "", "token = 5f9a8b7c6d5e4f3a2b1c0d9e8f7a6b5c ok"])
    assert [[pii.KINDS[k] for _, k, _ in f] for f in found] == [["person"], [], [], ["secret"]]


#: Sentences that the field has not seen, [words|kind] as in its table.
UNSEEN = """
The report by [Dr. Susan Clark|person] came out in spring.
Call [Mr. Henry Adams|person] before you leave the house.
[Mrs. Olga Brandt|person] has taught here for ten years.
Wir warten auf [Herr Jonas Vogel|person] seit einer Stunde.
Heute spricht [Frau Lena Fuchs|person] über das Wetter.
Nous avons vu [Mme. Alice Morel|person] au marché.
Ayer llamó [Sr. Pablo Reyes|person] desde la oficina.
The parcel for [27 Maple Street|address] was lost.
They opened a bakery at [310 River Road|address] in June.
His flat at [6 Hill Avenue|address] is too small.
password: [Qw7rT9zLp2Xc4Vb8|secret] must be changed soon
token: [ghp_Zk3mV8sQ1tR6yN0bC5xW2aE7|secret] was found in a log
secret = [5ebe2294ecd0e0f08eab7690d2a6ee69|secret] in plain view
We walked along the river until the sun went down.
Nothing in the box was worth more than a coin.
The Street where I grew up had no name. Nobody cared.
Am Abend gingen alle nach Hause. Es war schon dunkel.
Le matin, tout est calme. Personne ne parle.
Por la noche hace frío. Nadie sale de casa.
In 2004 there were 31 members and 12 guests at the table.
Version 3.2 of the tool needs 64 MB. Older ones need less.
"""


def test_field_on_sentences_that_it_has_not_seen():
    field = pii.Field()
    right = wrong = missed = 0
    for line in UNSEEN.strip().split("\n"):
        text, want = "", set()
        for part in re.split(r"(\[[^\]|]+\|[a-z]+\])", line):
            m = re.fullmatch(r"\[([^\]|]+)\|([a-z]+)\]", part)
            if m:
                want.add((len(text), pii.KINDS.index(m[2]), len(text) + len(m[1])))
            text += m[1] if m else part
        (found,) = pii.field_spans(field, [text])
        right, wrong, missed = right + len(want & set(found)), wrong + len(set(found) - want), missed + len(want - set(found))
    assert right / (right + wrong) >= 0.85 and right / (right + missed) >= 0.85, (right, wrong, missed)


def test_viterbi_like_all_paths():
    field = pii.Field(epochs=5)
    words = "Ask Mr. Tom Hill".split()
    (got,) = field.decode([words])
    ids = np.array([field.place(w) for w in words])
    e, t = field._emissions(ids), field.trans + field.barred
    k, best = len(pii.TAGS), None
    for code in range(k ** len(words)):
        path = [code // k**i % k for i in range(len(words))]
        score = field.first[path[0]] + field.barred_first[path[0]] + sum(e[i, p] for i, p in enumerate(path)) + sum(t[a, b] for a, b in zip(path[:-1], path[1:], strict=True))
        best = max(best or (score, path), (score, path))
    assert got.tolist() == best[1]


def test_pii_report(spark):
    docs = frame(spark, ["mail a.b@c.de now", None, "", "mail a.b@c.de now"], ids=[1, 2, None, 1])
    rows = pii.pii_report(docs).collect()
    assert sorted((r.doc_id or -1, r.n_email) for r in rows) == [(-1, 0), (1, 1), (1, 1), (2, 0)]
    assert {r.spans for r in rows} == {"", "email:5:13"}
    assert pii.pii_report(docs.limit(0)).count() == 0


def test_language(spark):
    rnd = random.Random(1)
    bags = {"en": "the of and house water with from that".split(), "de": "der und ist haus wasser mit von dass".split()}
    langs = [rnd.choice(["en", "de"]) for _ in range(120)] + ["en", None, "de", "en"]
    texts = [" ".join(rnd.choice(bags[x]) for _ in range(30)) for x in langs[:120]] + [None, "der und ist", "123 !!", ""]
    got = {r.doc_id: r for r in langid.langid_report(frame(spark, texts, langs)).collect()}
    held = [i for i in range(120) if got[i].held_out]
    assert held and sum(got[i].lang_pred == langs[i] for i in held) >= 0.98 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (120, 122, 123)] == [("und", 0.0)] * 3 and got[121].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.langid_report(frame(spark, ["some text"], [None])).first()
    assert none.lang_pred == "und" and langid.langid_report(frame(spark, texts).limit(0)).count() == 0


def test_toxicity(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    texts, marks = [], []
    for i in range(240):
        w = make(80)
        if i % 3 == 0:
            for _ in range(5):
                w[rnd.randrange(80)] = rnd.choice(["wretched", "rotten"])
        texts.append(" ".join(w))
        marks.append(int(i % 3 == 0))
    texts += [None, "", "   "]
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    held = [i for i in range(240) if got[i].held_out]
    assert len(got) == 243 and sum(got[i].predicted == marks[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.toxicity_report(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_leaks(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [make(n) for n in (3, 5, 9, 14, 22, 40, 65)]
    texts, want = [], set()
    for k, item in enumerate(items):
        for d in range(decontam.edits_allowed(len(item)) + 1):
            w = list(item)
            for _ in range(d):
                p = rnd.randrange(len(w))
                w[p : p + 1] = rnd.choice([[], ["zzz"], [w[p], "zzz"]])
            want.add((len(texts), k))
            texts.append(" ".join(make(30) + w + make(30)))
    texts += [" ".join(make(200)), None, "", " ".join(items[3]), " ".join(items[4]).upper()]
    want |= {(len(texts) - 2, 3), (len(texts) - 1, 4)}
    bench = spark.createDataFrame([(k, " ".join(x), "x") for k, x in enumerate(items)] + [(90, None, "x"), (91, " ", "x"), (None, "a b c", "x")], "item_id long, text string, extra string")
    docs = frame(spark, texts)
    rows = decontam.decontam_report(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got & want) >= 0.95 * len(want)
    for r in rows:  # what is found holds
        w, item = decontam.words_of(texts[r.doc_id]), decontam.words_of(" ".join(items[r.item_id]))
        assert min(edits(item, w[s : r.end_word]) for s in range(r.end_word + 1)) <= r.distance <= decontam.edits_allowed(len(item))
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontam.decontam_report(docs, bench.limit(0)).count() == 0 and decontam.decontam_report(docs.limit(0), bench).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    x[200:260] = x[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] + [1.0] * 15, 0), (1060, [None] + [1.0] * 15, 0), (1080, [1.0] * 3, 0), (None, [1.0] * 16, 0), (7, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 900, 20))
    full, hits = x.astype(np.float64), 0
    for q, found in got.items():
        score = full @ full[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(score, 9)))[:20]
        assert sorted(found) == list(range(1, 21))
        hits += len(set(best.tolist()) & {v for v, _ in found.values()})
        assert all(abs(score[v] - s) < 1e-9 for v, s in found.values())
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(df.limit(0)).count() == 0
    few = {r.vec_id for r in ann.nearest(df.filter("vec_id IN (0, 1, 2)")).collect()}
    assert few == {1, 2}


def test_langid_keeps_rare_languages_whole(spark, monkeypatch):
    """A bounded sample learns every row of a rare language; rows without an id stay within the bound."""
    sizes = {"aa": 3000, "bb": 3000, "cc": 12}
    langs = [x for x, n in sizes.items() for _ in range(n)]
    docs = frame(spark, [f"{x} {i}" for i, x in enumerate(langs)], langs, ids=list(range(len(langs))))
    rows = []
    monkeypatch.setattr(langid, "Model", lambda langs, counts, n: rows.append({x: round(counts[:, k].sum()) for k, x in enumerate(langs)}))
    langid.fit(docs)
    langid.fit(docs, 600)
    langid.fit(docs.withColumn("doc_id", langid.F.lit(None).cast("long")), 600)
    # each text is one word of the same length, so n-grams tell the rows
    per = rows[0]["aa"] / langid.held_out(docs).filter("NOT held_out AND lang = 'aa'").count()
    for found in rows[1:]:
        assert 450 <= sum(found.values()) / per <= 750
    assert rows[1]["cc"] == rows[0]["cc"]
    assert rows[2]["cc"] / per == 12


BIG = (1 << 53) + 1


def test_ids_beyond_doubles_stay_exact_beside_null_ones(spark):
    from tarnlake.llm import simhash, substring, tokens

    docs = frame(spark, ["one two three four five six", "mail a@b.cd now please", "one two three four five six"], ids=[BIG, None, BIG + 2])
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    reports = [simhash.simhash_report(docs), substring.substring_report(docs), substring.without_repeats(docs), pii.pii_report(docs), langid.langid_report(docs), tokens.token_report(docs)]
    for report in reports:
        assert {r.doc_id for r in report.select("doc_id").collect()} == {BIG, None, BIG + 2}
    assert {r.doc_id for r in decontam.decontam_report(docs, bench).collect()} == {BIG, BIG + 2}


def test_no_letter_is_undetermined(spark):
    texts, langs = ["the house and the water", "das haus und der tag", "½ ²", "Ⅷ ① 12", "日"], ["en", "de", "en", "en", "en"]
    got = {r.doc_id: r.lang_pred for r in langid.langid_report(frame(spark, texts, langs, ids=[0, 3, 4, 6, 8])).collect()}
    assert got[4] == got[6] == "und" and got[8] != "und"


def test_naive_bayes_like_its_definition(spark):
    """Log probabilities from n-grams counted one by one; the first of equal languages wins."""
    from collections import Counter, defaultdict

    texts = ["a red fox", "the red hen", "ein roter hahn", "der rote fuchs", "red hahn"]
    langs = ["en", "en", "de", "de", "de"]
    model = langid.fit(frame(spark, texts, langs, ids=[0, 3, 4, 6, 8]))
    learned = [i for i, d in enumerate([0, 3, 4, 6, 8]) if __import__("zlib").crc32(str(d).encode()) % 3 != 1]
    grams = lambda t: [(n, g) for n, b in zip(langid.SIZES, langid.ngram_buckets(langid.code_points(t)), strict=True) for g in b.tolist()]
    counts, rows = defaultdict(Counter), Counter()
    for i in learned:
        rows[langs[i]] += 1
        counts[langs[i]].update(g for _, g in grams(texts[i]))
    for text in ("a red hahn", "fuchs", "zzz"):
        score = {}
        for x in sorted(rows):
            total = sum(counts[x].values()) + langid.SMOOTH * langid.BUCKETS
            score[x] = np.log(rows[x] / sum(rows.values())) + sum(np.log((counts[x][g] + langid.SMOOTH) / total) for _, g in grams(text))
        (name,), (p,) = model.predict([text])
        best = max(sorted(score), key=score.get)
        assert name == best and abs(p - 1 / sum(np.exp(v - score[best]) for v in score.values())) < 1e-4
    tied = langid.Model(["aa", "bb"], np.ones((langid.BUCKETS, 2)), np.array([2.0, 2.0]))
    assert tied.predict(["x"])[0] == ["aa"]


def test_long_texts_and_repeated_rows(spark):
    """A text of many pieces is read whole; repeated rows are judged each for itself."""
    long = "the water and the house " * 60_000
    docs = frame(spark, [long, long, "der tag und das haus", "the water"], ["en", "en", "de", "en"], ids=[0, 0, 1, 7])
    got = langid.langid_report(docs).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.doc_id != 7) == [(0, "en"), (0, "en"), (1, "de")]
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontam.decontam_report(frame(spark, [long + item, long + item, long], ids=[1, 1, 2]), bench).collect()
    assert [(r.doc_id, r.distance) for r in found] == [(1, 0), (1, 0)]
    (spans,) = {r.spans for r in pii.pii_report(frame(spark, [long + " a@b.cd"])).collect()}
    assert spans == f"email:{len(long) + 1}:{len(long) + 7}"


def test_leaks_of_a_short_text_don_t_depend_on_its_neighbours():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = decontam.Items([(k, " ".join(rnd.choice(words) for _ in range(12))) for k in range(40)])
    texts = []
    for k in range(200):
        w = [x.decode() for x in items.texts[k % 40]]
        for _ in range(rnd.randint(1, 3)):
            del w[rnd.randrange(len(w))]
        texts.append(" ".join(w))
    together = {(t, k, d) for t, k, d, _ in items.leaks(texts)}
    alone = {(i, k, d) for i, t in enumerate(texts) for _, k, d, _ in items.leaks([t])}
    assert together == alone


def test_toxicity_scores_like_their_definition():
    """Lengths of every window under both dictionaries, compressed one by one, and the curve over their figures."""
    import zstandard

    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    texts = [" ".join([*[rnd.choice(words) for _ in range(60)], *(["wretched", "rotten"] if i % 3 == 0 else [])]) for i in range(150)]
    model = toxicity.Model(texts[::3], [t for i, t in enumerate(texts) if i % 3])

    def length(content, window):
        params = zstandard.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=toxicity.MIN_MATCH, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(window))

    for text in [texts[0], texts[1], "one", "", None, "Wretched ROTTEN " * 9]:
        own = (text or "").lower().encode().split()
        starts = [i for i in range(0, max(1, len(own)), toxicity.STEP) if i == 0 or len(own) - i > toxicity.WINDOW - toxicity.STEP]
        gains = [length(model.base, w) - length(model.base + model.extra, w) for w in (b" ".join(own[i : i + toxicity.WINDOW]) for i in starts)]
        over, n = sum(max(g - 2, 0) for g in gains), len(gains)
        top = sorted(gains, reverse=True)
        figures = [min(top[0], 12), min(sum(top[:3]), 30), sum(gains) / n, np.log1p(over), np.log1p(10 * over / n), np.log1p(over / np.sqrt(n)), sum(g >= 4 for g in gains) / n, np.log(n)]
        z = ((np.array(figures) - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
        assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-z))) < 1e-9
