from pyspark.sql import functions as F

from tarnlake.functions import tables as T
from tarnlake.functions import text as X
from tarnlake.operators import evaluate as E
from tarnlake.operators import graph as G
from tarnlake.operators import lake as L
from tarnlake.operators import search as S
from tarnlake.sources import readers, writers
from tarnlake.streaming.ingest import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlap_example(spark):
    refs = spark.createDataFrame([("P1", x) for x in "abc"] + [("P2", x) for x in "bcde"] + [("P4", "x")], "paper string, ref string")
    (r,) = G.overlap_scores(refs).collect()
    assert (r.a, r.b, r.inter, round(r.jaccard, 6), round(r.dice, 6), round(r.max_pr, 6)) == ("P1", "P2", 2, 0.4, 0.571429, 0.666667)


def test_lift_example(spark):
    inc = spark.createDataFrame([("P1", "t1"), ("P1", "t2"), ("P2", "t3")], "node string, table string")
    adj = spark.createDataFrame([("P1", "P2")], "src string, dst string")
    assert rows(G.lift_edges(inc, adj)) == [("t1", "t2"), ("t1", "t3"), ("t2", "t3")]


def _exchanges_above_a_join(df):
    """Shuffles that read a join's rows in the plan."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    first = min(i for i, line in enumerate(lines) if "Join" in line)
    return [line for line in lines[:first] if "Aggregate" in line and depth(line) < depth(lines[first])]


def test_shared_targets_stream_from_the_join(spark, monkeypatch):
    monkeypatch.setattr(G, "DEALT", 4, raising=False)
    monkeypatch.setattr(G, "PAIRS_A_TASK", 64, raising=False)
    single = spark.range(60).selectExpr("id AS model", "id % 2 AS target")
    out = G.shared_target_edges(single)
    assert not _exchanges_above_a_join(out)
    want = sorted((a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2)
    assert rows(out) == want
    # models of several targets, nulls and repeated rows: each pair once
    links = [(m, t) for m in range(40) for t in {m % 3, m % 5 if m % 4 else None, m % 7 + 3}] + [(None, 1), (7, 1), (7, 1)]
    held = {m: {t for n, t in links if n == m and t is not None} for m in range(40)}
    got = rows(G.shared_target_edges(spark.createDataFrame(links, "model long, target long")))
    assert got == sorted((a, b) for a in range(40) for b in range(a + 1, 40) if held[a] & held[b])


def test_pairs_of_a_target_take_little_room(spark, tmp_path):
    links = spark.range(3000).selectExpr("concat('m', id) AS model", "'org' AS target")
    G.shared_target_edges(links).write.parquet(f"{tmp_path}/out")
    out, size = spark.read.parquet(f"{tmp_path}/out"), sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert out.count() == out.filter("src < dst").distinct().count() == 3000 * 2999 // 2
    assert size < 0.4 * out.count()
    # several runs and chunks, of models that have one target or more
    held = {m: {m % 2, 2 if m % 700 == 0 else m % 2} for m in range(5000)}
    pairs = G.shared_target_edges(spark.createDataFrame([(m, t) for m, ts in held.items() for t in ts], "model long, target long"))
    twos, several = 2 * (2500 * 2499 // 2), [m for m in held if 2 in held[m]]
    want = twos + sum((a + b) % 2 for i, a in enumerate(several) for b in several[:i])
    assert pairs.count() == pairs.filter("src < dst").distinct().count() == want


def test_known_targets_stream_from_the_join(spark):
    # m1 and m2 link each other, share x, and m2 is known; m3 links the known X in another case and itself
    links = spark.createDataFrame([("m1", "m2"), ("m2", "m1"), ("m1", "x"), ("m2", "X"), ("m3", "x"), ("m3", "M3"), (None, "x"), ("m4", None)], "model string, target string")
    known = spark.createDataFrame([("X",), ("m2",), ("m3",), (None,)], "model string")
    out = G.shared_target_edges(links, known, fold_case=True)
    assert rows(out) == [("X", "m1"), ("X", "m2"), ("X", "m3"), ("m1", "m2"), ("m1", "m3"), ("m2", "m3")]
    plain = spark.range(30).selectExpr("concat('m', id) AS model", "'org' AS target")
    out = G.shared_target_edges(plain, spark.createDataFrame([("org",)], "model string"))
    assert not _exchanges_above_a_join(out)
    assert out.count() == out.distinct().count() == 30 * 29 // 2 + 30


def test_overlap_by_intent_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIRS_A_ROUND", 100, raising=False)
    made = [(p, (p * 7 + r * r) % 23 if r else None, [None, "x", "x_infl", "overall"][(p + r) % 4], [True, False, None][r % 3]) for p in range(30) for r in range(p % 12 + 1)] + [(None, 1, "x", True)]
    df = spark.createDataFrame(made, "paper long, ref long, intent string, influential boolean")
    sets = {}
    for p, ref, intent, infl in made:
        for v in {"overall", intent} | ({"overall_infl", intent and f"{intent}_infl"} if infl else set()):
            if v and p is not None:
                sets.setdefault((v, p), set()).add(ref)
    for least in (0.0, 0.3):
        want = []
        for (v, a), x in sets.items():
            for (w, b), y in sets.items():
                n = len((x & y) - {None})
                if v == w and a < b and n and max(n / len(x), n / len(y)) >= least:
                    want.append((v, a, b, n, len(x), len(y)))
        seen = []
        monkeypatch.setattr(G, "stored", lambda df, label, f=G.stored: seen.append(label) or f(df, label))
        got = G.overlap_by_intent(df, least)
        assert rows(got.select("variant", "a", "b", "inter", "len_a", "len_b")) == sorted(want)
        assert seen.count("overlaps") > 1
        assert got.columns[6:] == ["jaccard", "dice", "max_pr"]


def test_components_example(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (None, 7)], "src long, dst long")
    nodes = spark.range(1, 7).toDF("n")
    assert rows(G.connected_components(edges, nodes)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    assert rows(G.connected_components(edges.limit(0))) == []


def test_long_chain_is_one_component(spark):
    edges = spark.range(0, 300).selectExpr("id AS src", "id + 1 AS dst")
    assert G.connected_components(edges).select("component").distinct().count() == 1


def test_snapshot_example(spark):
    base = spark.createDataFrame([("a", "x"), ("b", "y"), ("n", None)], "id string, card string")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "w"), ("n", "q")], "id string, card string")
    done = base.select("id")
    assert rows(L.snapshot_delta(new, base, done)) == [("a", "unchanged"), ("b", "updated"), ("c", "new"), ("n", "updated")]
    assert ("n", "updated") not in rows(L.snapshot_delta(new, base, done, compat=True))
    assert {r[1] for r in rows(L.snapshot_delta(new, None, None))} == {"new"}


def test_dedup_example(spark):
    data = [("t1", "github", 2, "h1"), ("t2", "hugging", 7, "h1"), ("t3", "html", 1, "h2"), ("t4", "html", 4, "h2"), ("t5", "llm", 1, "h3"), ("t6", "llm", 2, None)]
    tables = spark.createDataFrame(data, "table_id string, source string, ord long, hash string")
    canonical, mapping, matrix = L.deduplicate(tables)
    assert {r.canonical for r in canonical.collect()} == {"t2", "t3", "t5"}
    assert rows(mapping) == [("t1", "t2"), ("t4", "t3")]
    got = {(r.a, r.b): r.n for r in matrix.collect()}
    assert got[("hugging", "github")] == got[("github", "hugging")] == 1 and got[("html", "html")] == 1 and got[("llm", "llm")] == 0


def test_status(spark):
    data = [(["a"], [["1"], ["2"]]), ([], []), (["a"], []), (["a"], [["---"], [None]]), (["a"], [["1"]]), (None, None)]
    df = spark.createDataFrame(data, "header array<string>, rows array<array<string>>")
    assert [r[0] for r in df.select(T.qc_status(F.col("header"), F.col("rows"), F.lit(False))).collect()] == ["valid", "zero_col", "zero_row", "empty_after_clean", "one_row", "error"]


def test_augment_example(spark):
    df = spark.createDataFrame([(["A", "B"], [["1", "2"]])], "h array<string>, r array<array<string>>")
    r = df.select(T.transposed(F.col("h"), F.col("r")).alias("t"), T.named_cells(F.col("h"), F.col("r")).alias("s"), T.named_cells_transposed(F.col("h"), F.col("r")).alias("st")).first()
    assert r.t == [["A", "1"], ["B", "2"]] and r.s == [["A-1", "B-2"]] and r.st == [["A", "A-1"], ["B", "B-2"]]


def test_kappa_example(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)], "a int, b int")
    assert tuple(E.cohen_kappa(df, "a", "b").first()) == (0.75, 0.5, 0.5)


def test_intents_of_null(spark):
    df = spark.createDataFrame([(1, None), (2, "broken")], "id int, j string")
    for r in L.citation_intents(df, "j").collect():
        assert all(r[c] == [] for c in r.asDict() if c.endswith("_ids"))


def test_metrics_of_perfect_ranking(spark):
    edges = spark.createDataFrame([(1, 2)], "src int, dst int")
    results = spark.createDataFrame([(1, 1, 2), (2, 1, 1)], "query_id int, rank int, doc_id int")
    assert rows(S.retrieval_metrics(results, edges, (1,))) == [(1, 1.0, 1.0, 1.0)]


def test_front_matter(spark):
    df = spark.createDataFrame([("---\na: 1\n---\nbody",), ("---\nopen",), ("plain",), (None,)], "c string")
    tags, readme = X.split_front_matter(F.col("c"))
    assert [tuple(r) for r in df.select(tags, readme).collect()] == [("a: 1\n", "body"), (None, "open"), (None, "plain"), (None, None)]


def test_csv_of_unknown_form():
    assert readers.parse_csv(b"a;b\n1;2\n") == [["a", "b"], ["1", "2"]]
    assert readers.parse_csv("é,x\n1,\n".encode("latin-1")) == [["é", "x"], ["1", None]]
    assert readers.parse_csv(b"") == [] and readers.parse_csv(b"word\nmore\n") == [["line"], ["word"], ["more"]]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("m1", ["x"]), ("m2", None)], "modelId string, l array<string>")
    writers.write_parquet(df, f"{tmp_path}/p")
    assert rows(spark.read.parquet(f"{tmp_path}/p")) == [("m1", ["x"]), ("m2", [])]
    writers.write_partitioned(df.select("modelId"), f"{tmp_path}/q")
    assert (tmp_path / "q" / "partition=m").is_dir()
    (tmp_path / "t.tsv").write_text("1\ta b\n2\t\nbad\n3\tx\ty\n")
    assert rows(readers.scan_tsv_queries(spark, f"{tmp_path}/t.tsv")) == [("1", "a b")]
    assert rows(readers.scan_tsv_queries(spark, f"{tmp_path}/t.tsv", strict=False)) == [("1", "a b"), ("3", "x\ty")]
    (tmp_path / "c.json").write_text('{"citationid":1,"citingcorpusid":2,"citedcorpusid":3}\nbroken\n{"citationid":4}\n')
    assert readers.scan_citations(spark, f"{tmp_path}/c.json").count() == 1
    (tmp_path / "a.csv").write_bytes(b"h1;h2\n1;2\n")
    assert readers.scan_csv_tables(spark, f"{tmp_path}/a.csv").first().header == ["h1", "h2"]
    got = readers.fetched(spark.createDataFrame([("u",), ("v",)], "url string"), spark.createDataFrame([("u", "old")], "url string, body string"), lambda u: "got")
    assert rows(got) == [("u", "old"), ("v", "got")]
    (tmp_path / "raw_1").mkdir()
    df.write.parquet(f"{tmp_path}/x")
    next((tmp_path / "x").glob("part-*")).rename(tmp_path / "raw_1" / "train-0.parquet")
    assert readers.list_snapshots(spark, str(tmp_path)) == ["1"] and readers.scan_snapshot(spark, str(tmp_path), "1", columns=["modelId"]).columns == ["modelId", "tag"]


def test_incremental(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", "id long")
    assert ingest(*args) == 3 and ingest(*args) == 0
    spark.range(3, 5).write.mode("append").parquet(f"{tmp_path}/in")
    ingest(*args)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_fuzzy_titles_of_all_rows(spark, sf_dir):
    """Every title asks, and its hits are those of brute force over every other."""
    from tarnlake.plans import catalog
    from tarnlake.sources.tables import read_table

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    titles = {r.p_partkey: r.p_name.lower() for r in read_table(spark, sf_dir, "part").select("p_partkey", "p_name").collect()}
    score = {}
    for q in set(titles.values()):
        for d in set(titles.values()):
            own, other = set(q.split()), set(d.split())
            if own & other:
                near = sum(any(edits(a, b) <= 2 for b in other) for a in own)
                score[q, d] = 5.0 * (q == d) + 3.0 * (q in d) + 2.0 * near / len(own)
    want = set()
    for i, q in titles.items():
        found = sorted((-round(score[q, d], 9), j) for j, d in titles.items() if (q, d) in score)[:5]
        want |= {(i, n, j, -s) for n, (s, j) in enumerate(found, 1)}
    got = {tuple(r) for r in catalog.queries()["q7_fuzzy_titles"](spark, sf_dir).collect()}
    assert got == want


def test_sampled_pairs_serve_rare_combinations_first(spark):
    from tarnlake.operators import evaluate as E

    rows = [(i, i + 1000, int(i < 3), int(i % 2), f"{int(i < 3)}{i % 2}") for i in range(100)]
    got = E.sample_pairs_8way(spark.createDataFrame(rows, "a long, b long, x int, y int, combination string"), 40).collect()
    count = {}
    for r in got:
        count[r.combination] = count.get(r.combination, 0) + 1
    assert count["11"] == 1 and count["10"] == 2 and sum(count.values()) == 40 and abs(count["01"] - count["00"]) <= 1


def test_packed_chunks_are_balanced(spark):
    from pyspark.sql import functions as F

    from tarnlake.functions import text as T

    row = spark.range(1).select(T.packed_chunks(F.array(*[F.lit(x) for x in (30, 30, 30, 30, 200, 10)]), 110, 10).alias("c")).first()
    assert row.c[0] == 0 and row.c == sorted(row.c) and row.c[4] > row.c[3]


def test_running_sums_and_ranks(spark):
    """Over several ranges, with ties, against plain sums."""
    from pyspark.sql import functions as F

    from tarnlake.operators import order as O

    rows = [(i, (i * 7) % 5, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, value long, w long").repartition(7)
    want, total = {}, 0
    for place, (i, _, w) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += w
        want[i] = (place, total)
    got = O.running_sums(df, [F.col("value"), F.col("id")], {"place": F.lit(1), "sum": F.col("w")})
    assert {r.id: (r.place, r["sum"]) for r in got.collect()} == want
    assert O.numbered(df.limit(0), [F.col("id")]).count() == 0
    assert O.ecdf(df.filter("id = 3"), "value", "id").first().ecdf == 0.0


def test_list_match_of_lists_and_values(spark):
    from tarnlake.operators import predicates as P

    lists = spark.createDataFrame([(1, ["Org/Bert"]), (2, ["x"]), (3, None), (4, ["org/BERT-large", "y"])], "id int, l array<string>")
    assert [r.id for r in lists.filter(P.list_match(lists, "l", "/bert")).collect()] == [1]
    values = spark.createDataFrame([(1, "Org/Bert"), (2, None), (3, "bert/x")], "id int, l string")
    assert [r.id for r in values.filter(P.list_match(values, "l", "BERT")).collect()] == [1]


def test_unknown_intent_is_an_error(spark):
    import pytest

    from tarnlake.operators import lake as L

    doc = '{"data":[{"id":1,"isInfluential":true,"intents":[["odd"]],"contexts":["c"]}]}'
    with pytest.raises(Exception, match="unknown intent: odd"):
        L.citation_contexts(spark.createDataFrame([(doc,)], "j string"), "j").collect()


def test_title_gate(spark):
    from tarnlake.operators import search as S

    results = spark.createDataFrame([(1, 1, 10, 9.0), (2, 1, 20, 7.0), (3, 1, 30, 5.0)], "query_id long, rank int, doc_id long, score double")
    asked = spark.createDataFrame([(1, "Same"), (2, "Other"), (3, "Third")], "id long, title string")
    titles = spark.createDataFrame([(10, "same"), (20, "x"), (30, "y")], "id long, title string")
    assert [r.query_id for r in S.title_gate(results, asked, titles).collect()] == [1]


def test_carried_over_and_upserts(spark):
    from tarnlake.operators import lake as L

    base = spark.createDataFrame([(1, "a", 0)], "id long, card string, extra int")
    redone = spark.createDataFrame([("b", 2)], "card string, id long")
    assert sorted(map(tuple, L.carried_over(base, redone).collect())) == [(1, "a"), (2, "b")]
