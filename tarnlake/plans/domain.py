"""Queries over the domain operators: snapshots, dedup, graphs, search, evaluation, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import evaluate as E
from tarnlake.operators import graph as G
from tarnlake.operators import lake as L
from tarnlake.operators import search as S
from tarnlake.registry import query
from tarnlake.sources import readers, writers
from tarnlake.sources.tables import TABLES, read_table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


@query("g1_snapshot_delta", """SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'updated' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS status FROM documents""")
def snapshot_delta(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("card"))
    raw = docs.filter("id % 11 <> 0").withColumn("card", F.when(F.col("id") % 7 == 0, F.concat("card", F.lit("!"))).otherwise(F.col("card")))
    return L.snapshot_delta(docs, raw, docs.filter("id % 10 <> 0").select("id"))


def _tables(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    source = F.array(*[F.lit(s) for s in L.SOURCES])[(F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 4)]
    return docs.select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("table_id"), source.alias("source"), F.col("doc_id").alias("ord"), F.array(F.lit("h")).alias("header"), F.array(F.array("text"), F.array(F.lit("x"))).alias("rows"))


_TABLES = "t AS (SELECT 't' || doc_id AS table_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 4 + 1 AS p, doc_id AS ord, md5(text) AS hash FROM documents)"


@query("g3_canonical", f"WITH {_TABLES} SELECT (min_by(table_id, p * 1000000000 + ord)) AS canonical, count(*) AS copies FROM t GROUP BY hash")
def canonical(spark, sf_dir):
    return L.deduplicate(L.quality_control(_tables(spark, sf_dir)))[0].select("canonical", "copies")


@query("g3_mapping", f"WITH {_TABLES}, c AS (SELECT hash, min_by(table_id, p * 1000000000 + ord) AS canonical FROM t GROUP BY hash) SELECT table_id, canonical FROM t JOIN c ON t.hash = c.hash WHERE table_id <> canonical")
def mapping(spark, sf_dir):
    return L.deduplicate(L.quality_control(_tables(spark, sf_dir)))[1]


@query("g3_status", "SELECT 'valid' AS status, count(*) AS n FROM documents")
def statuses(spark, sf_dir):
    return L.quality_control(_tables(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("g4_linked_tables", "SELECT DISTINCT o_custkey AS model_id, CASE WHEN l_linenumber % 2 = 0 THEN 'html' ELSE 'llm' END AS source, l_suppkey AS table_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def linked(spark, sf_dir):
    models = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("model_id")).agg(F.collect_list("o_orderkey").alias("titles"))
    tables = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("title"), F.when(F.col("l_linenumber") % 2 == 0, "html").otherwise("llm").alias("source")).agg(F.collect_set("l_suppkey").alias("tables"))
    return L.link_tables(models, tables)


@query("g5_citation_intents", """SELECT event_id, '[' || event_id || ',' || (event_id + 1) || ']' AS overall, CASE WHEN event_id % 2 = 0 THEN '[' || event_id || ']' ELSE '[]' END AS methodology, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN '[' || event_id || ']' ELSE '[]' END AS methodology_infl FROM events""")
def intents(spark, sf_dir):
    n = F.col("event_id").cast("string")
    first = F.concat(F.lit('{"id":'), n, F.lit(',"isInfluential":'), (F.col("event_id") % 3 == 0).cast("string"), F.lit(',"intents":[["'), F.when(F.col("event_id") % 2 == 0, "methodology").otherwise("background"), F.lit('"]],"contexts":["c"]}'))
    doc = F.concat(F.lit('{"data":['), first, F.lit(',{"id":'), (F.col("event_id") + 1).cast("string"), F.lit(',"intents":null},'), first, F.lit("]}"))
    out = L.citation_intents(_t(spark, sf_dir, "events").select("event_id", doc.alias("j")), "j")
    return out.select("event_id", *[F.to_json(f"{c}_ids").alias(c) for c in ("overall", "methodology", "methodology_infl")])


def _refs(spark, sf_dir):
    return _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.expr("o_orderkey = l_orderkey")).select(F.col("o_custkey").alias("paper"), F.col("l_partkey").alias("ref"))


_REFS = "r AS (SELECT DISTINCT o_custkey AS paper, l_partkey AS ref FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT paper, count(*) AS n FROM r GROUP BY paper), s AS (SELECT x.paper AS a, y.paper AS b, count(*) AS i FROM r x JOIN r y ON x.ref = y.ref AND x.paper < y.paper GROUP BY 1, 2)"


@query("g6_overlap", f"WITH {_REFS} SELECT a, b, i AS inter, round(i / CAST(na.n + nb.n - i AS DOUBLE), 6) AS jaccard, round(2 * i / CAST(na.n + nb.n AS DOUBLE), 6) AS dice, round(greatest(i / CAST(na.n AS DOUBLE), i / CAST(nb.n AS DOUBLE)), 6) AS max_pr FROM s JOIN n na ON a = na.paper JOIN n nb ON b = nb.paper WHERE greatest(i / CAST(na.n AS DOUBLE), i / CAST(nb.n AS DOUBLE)) >= 0.1")
def overlap(spark, sf_dir):
    out = G.overlap_scores(_refs(spark, sf_dir), 0.1)
    return out.select("a", "b", "inter", *[F.round(c, 6).alias(c) for c in ("jaccard", "dice", "max_pr")])


@query("g6b_direct", "WITH r AS (SELECT DISTINCT o_custkey AS p, o_orderkey % 1500 AS q FROM orders) SELECT DISTINCT least(p, q) AS src, greatest(p, q) AS dst FROM r WHERE p <> q AND q IN (SELECT p FROM r)")
def direct(spark, sf_dir):
    return G.direct_edges(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper"), (F.col("o_orderkey") % 1500).alias("ref")))


_INC = "inc AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS t FROM lineitem), adj AS (SELECT DISTINCT a.o_orderkey AS p, b.o_orderkey AS q FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority)"


@query("g7_lifted", f"WITH {_INC} SELECT DISTINCT least(x.t, y.t) AS src, greatest(x.t, y.t) AS dst FROM inc x JOIN adj ON x.node = adj.p JOIN inc y ON adj.q = y.node WHERE x.t <> y.t")
def lifted(spark, sf_dir):
    near = G.shared_target_edges(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("model"), F.concat_ws("/", "o_custkey", "o_orderpriority").alias("target")))
    inc = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("table"))
    return G.lift_edges(inc, near)


@query("g8_shared_target", "SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey")
def shared_target(spark, sf_dir):
    return G.shared_target_edges(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model"), F.concat_ws("/", F.col("c_nationkey"), F.col("c_mktsegment")).alias("target")))


def _edges(spark, sf_dir, line=1):
    return G.edges_of(_t(spark, sf_dir, "lineitem").filter(f"l_linenumber = {line}"), "l_suppkey", "l_partkey")


def _e(line=1):
    return f"SELECT DISTINCT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst FROM lineitem WHERE l_linenumber = {line} AND l_suppkey <> l_partkey"


@query("g9_union", f"SELECT src, dst FROM ({_e(1)} UNION {_e(2)}) WHERE src % 2 = 0 AND dst % 2 = 0")
def graph_union(spark, sf_dir):
    evens = _t(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select("p_partkey")
    return G.union_edges(_edges(spark, sf_dir, 1), _edges(spark, sf_dir, 2), restrict_to=evens)


@query("g10_variants", f"SELECT src || '_s' AS src, dst || '_s' AS dst FROM ({_e()})")
def variants(spark, sf_dir):
    return G.variant(_edges(spark, sf_dir), "_s")


@query("g11_pair_lookup", f"WITH e AS ({_e()}) SELECT p_partkey AS a, p_size AS b, EXISTS (SELECT 1 FROM e WHERE src = least(p_partkey, p_size) AND dst = greatest(p_partkey, p_size)) AS related FROM part")
def pairs(spark, sf_dir):
    return G.pair_lookup(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_size").cast("long").alias("b")), _edges(spark, sf_dir)).withColumn("b", F.col("b").cast("int"))


@query("g11_coverage", f"WITH e AS ({_e()}) SELECT p_partkey AS q, p_partkey IN (SELECT src FROM e) AS as_src, p_partkey IN (SELECT dst FROM e) AS as_dst, p_partkey IN (SELECT src FROM e UNION SELECT dst FROM e) AS covered FROM part")
def covered(spark, sf_dir):
    return G.coverage(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("q")), _edges(spark, sf_dir))


@query("g11_neighbors", f"WITH e AS ({_e()}), m AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT src AS node, dst AS neighbor FROM m WHERE src IN (SELECT p_partkey FROM part)")
def near(spark, sf_dir):
    return G.neighbors(_edges(spark, sf_dir), _t(spark, sf_dir, "part").select("p_partkey"))


@query("a22_components", """WITH RECURSIVE e AS (SELECT DISTINCT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey), m AS (SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders) SELECT node, component FROM m""")
def components(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    chain = orders.selectExpr("o_orderkey AS a", "lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY md5(CAST(o_orderkey AS STRING))) AS b")
    return G.connected_components(G.edges_of(chain, "a", "b"), orders.select("o_orderkey"))


@query("q1_dense_topk", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT query_id, rank, doc_id FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS INTEGER) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= 10")
def dense(spark, sf_dir):
    return S.dense_topk(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 10).select("query_id", "rank", "doc_id")


_BM = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents), a AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM t), x AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM x GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 q AS (SELECT item_id + 1000000 AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark), qt AS (SELECT query_id, term, count(*) AS qf FROM q GROUP BY 1, 2),
 s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))), 9) AS score FROM qt JOIN df USING (term) CROSS JOIN a JOIN tf USING (term) GROUP BY 1, 2)"""


def _bm25(spark, sf_dir, k=10):
    q = _t(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000).alias("id"), F.col("text").alias("contents"))
    return S.bm25_topk(q, _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("contents")), k)


@query("q2_bm25_topk", f"WITH {_BM} SELECT query_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def bm25(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", "rank", F.round("score", 4).alias("score"))


@query("q3_hybrid_interpolated", f"""WITH {_BM}, sp AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), b AS (SELECT query_id, doc_id, score AS sc, rank / CAST(20 AS DOUBLE) AS d FROM sp WHERE rank <= 20)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY v DESC, doc_id) AS INTEGER) AS rank, round(v, 3) AS score FROM (SELECT query_id, doc_id, round(0.45 * sc + d, 9) AS v FROM b) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, doc_id) <= 10""")
def hybrid(spark, sf_dir):
    sparse = _bm25(spark, sf_dir, 20)
    other = sparse.select("query_id", (21 - F.col("rank")).alias("rank"), "doc_id", (F.col("rank") / 20).alias("score"))
    return S.hybrid_interpolate(other, sparse, 0.45, 10).select("query_id", "rank", F.round("score", 3).alias("score"))


def _results(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("score")).selectExpr("l_suppkey AS query_id", "CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_partkey) AS INT) AS rank", "l_partkey AS doc_id", "score").filter("rank <= 20")


_RES = "res AS (SELECT * FROM (SELECT l_suppkey AS query_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS INTEGER) AS rank, l_partkey AS doc_id FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE rank <= 20)"


@query("q5_postprocessed", f"WITH {_RES} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, doc_id FROM res WHERE NOT (rank = 1 AND query_id = doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10")
def postprocessed(spark, sf_dir):
    return S.without_self_at_top(_results(spark, sf_dir), 10).select("query_id", "rank", "doc_id")


@query("q4_hybrid_reranked", f"WITH {_RES}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT query_id, CAST(new AS INTEGER) AS rank, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC NULLS LAST, rank, doc_id) AS new FROM res LEFT JOIN e a ON a.vec_id = query_id LEFT JOIN e b ON b.vec_id = doc_id WHERE query_id <> doc_id) WHERE new <= 5")
def reranked(spark, sf_dir):
    return S.hybrid_rerank(_results(spark, sf_dir), _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 5).select("query_id", "rank", "doc_id")


@query("q6_model_search", f"WITH {_RES}, m AS (SELECT DISTINCT c_custkey AS model, c_custkey % 100 AS t FROM customer) SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.model AS query_id, b.model AS doc_id, CAST(count(*) AS DOUBLE) AS score FROM m a JOIN res ON a.t = res.query_id JOIN m b ON b.t = res.doc_id WHERE a.model <> b.model GROUP BY 1, 2)) WHERE rank <= 5")
def models_found(spark, sf_dir):
    m = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model"), (F.col("c_custkey") % 100).alias("table"))
    return S.model_search(m, _results(spark, sf_dir), 5)


@query("q7_fuzzy_titles")
def fuzzy(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return S.fuzzy_titles(parts, parts, 5)


@query("q9_metrics", f"WITH {_RES}, e AS ({_e()}), t AS (SELECT src AS q, dst AS d FROM e UNION SELECT dst, src FROM e), w AS (SELECT q, count(*) AS n FROM t GROUP BY q), h AS (SELECT query_id, rank, n, CASE WHEN t.d IS NULL THEN 0 ELSE 1 END AS hit FROM res JOIN w ON query_id = w.q LEFT JOIN t ON query_id = t.q AND doc_id = t.d), f AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM h), k AS (SELECT unnest([1, 5, 10]) AS k) SELECT k, round(sum(hit) / CAST(k AS DOUBLE) / (SELECT count(*) FROM w), 6) AS precision, round(sum(hit / CAST(n AS DOUBLE)) / (SELECT count(*) FROM w), 6) AS recall, round(sum(hit * found / CAST(rank AS DOUBLE) / least(n, k)) / (SELECT count(*) FROM w), 6) AS map FROM f JOIN k ON rank <= k GROUP BY k")
def metrics(spark, sf_dir):
    return S.retrieval_metrics(_results(spark, sf_dir), _edges(spark, sf_dir))


def _pairs(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).filter("a <> b").distinct()
    return E.labelled_pairs(p, {"paper": _edges(spark, sf_dir, 1), "model": G.edges_of(_t(spark, sf_dir, "lineitem").filter("l_linenumber = 2"), "l_suppkey", "l_partkey")})


@query("e1_sampled_pairs")
def sampled(spark, sf_dir):
    return E.sample_pairs_8way(_pairs(spark, sf_dir), 200)


@query("e2_balanced_pairs", f"""WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_linenumber = 1 AND l_suppkey <> l_partkey), e AS ({_e()}),
 f AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst FROM lineitem WHERE l_linenumber = 2 AND l_suppkey <> l_partkey),
 l AS (SELECT a, b, CASE WHEN EXISTS (SELECT 1 FROM e WHERE src = least(a, b) AND dst = greatest(a, b)) THEN 1 ELSE 0 END AS paper, CASE WHEN EXISTS (SELECT 1 FROM f WHERE src = least(a, b) AND dst = greatest(a, b)) THEN 1 ELSE 0 END AS model FROM p)
 SELECT a, b, paper, model, CAST(paper AS VARCHAR) || CAST(model AS VARCHAR) AS combination FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY md5('42-' || a || '-' || b), a, b) AS r FROM l) WHERE r <= 50""")
def balanced(spark, sf_dir):
    return E.balanced_pairs(_pairs(spark, sf_dir), "paper", 100)


def _votes(spark, sf_dir):
    return _t(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("pair"), F.col("event_id").alias("judge"), F.when(F.col("value") > 60, "YES").when(F.col("value") < 30, "NO").otherwise("UNSURE").alias("vote"))


_VOTES = "v AS (SELECT event_id % 500 AS pair, event_id AS judge, CASE WHEN value > 60 THEN 'YES' WHEN value < 30 THEN 'NO' ELSE 'UNSURE' END AS vote FROM events), m AS (SELECT pair, vote, count(*) AS c, min(judge) AS first FROM v GROUP BY 1, 2), b AS (SELECT pair, vote, c, sum(c) OVER (PARTITION BY pair) AS n, row_number() OVER (PARTITION BY pair ORDER BY c DESC, first) AS r FROM m)"


@query("e3_majority", f"WITH {_VOTES} SELECT pair, vote, round(c / CAST(n AS DOUBLE), 6) AS consistency, c = n AS unanimous, CAST(n AS BIGINT) AS n FROM b WHERE r = 1")
def votes(spark, sf_dir):
    return E.majority(_votes(spark, sf_dir))


@query("e3b_confusion", f"WITH {_VOTES}, j AS (SELECT pair % 2 AS truth, vote FROM b WHERE r = 1) SELECT count(*) FILTER (WHERE vote = 'YES' AND truth = 1) AS tp, count(*) FILTER (WHERE vote = 'YES' AND truth = 0) AS fp, count(*) FILTER (WHERE vote = 'NO' AND truth = 0) AS tn, count(*) FILTER (WHERE vote = 'NO' AND truth = 1) AS fn, count(*) FILTER (WHERE vote = 'UNSURE') AS unsure, round((tp + tn) / CAST(count(*) AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision_yes, round(tn / CAST(tn + fn AS DOUBLE), 6) AS precision_no FROM j")
def confused(spark, sf_dir):
    return E.confusion(E.majority(_votes(spark, sf_dir)).withColumn("truth", F.col("pair") % 2))


@query("e4_cohen_kappa", "WITH r AS (SELECT quality AS a, toxic AS b FROM labels), p AS (SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, count(*) AS n FROM r), e AS (SELECT sum(x.c * y.c) / CAST(max(n) * max(n) AS DOUBLE) AS pe FROM (SELECT a, count(*) AS c FROM r GROUP BY a) x JOIN (SELECT b, count(*) AS c FROM r GROUP BY b) y ON x.a = y.b CROSS JOIN p) SELECT round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM p, e")
def cohen(spark, sf_dir):
    return E.cohen_kappa(_t(spark, sf_dir, "labels"), "quality", "toxic")


@query("e4b_fleiss_kappa", "WITH v AS (SELECT doc_id AS pair, unnest([quality, toxic, CAST(doc_id % 2 AS INTEGER)]) AS vote FROM labels), c AS (SELECT pair, vote, CAST(count(*) AS DOUBLE) AS c FROM v GROUP BY 1, 2), p AS (SELECT pair, sum(c) AS n, sum(c * c) AS s FROM c GROUP BY pair), q AS (SELECT avg((s - n) / (n * (n - 1))) AS p, sum(n) AS t FROM p), e AS (SELECT sum((x / t) * (x / t)) AS pe FROM (SELECT vote, sum(c) AS x FROM c GROUP BY vote), q) SELECT round((p - pe) / (1 - pe), 6) AS kappa FROM q, e")
def fleiss(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("pair"), F.posexplode(F.array("quality", "toxic", (F.col("doc_id") % 2).cast("int"))).alias("judge", "vote"))
    return E.fleiss_kappa(rows)


@query("e5_merged_responses", "SELECT doc_id AS pair, CASE WHEN doc_id % 3 = 0 THEN 'again' WHEN doc_id % 2 = 0 THEN 'first' END AS response FROM documents")
def merged(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair"))
    return E.merged_responses(d.withColumn("response", F.when(F.col("pair") % 2 == 0, "first")), d.filter("pair % 3 = 0").withColumn("response", F.lit("again")))


_GRID = """s AS (SELECT value AS score, user_id % 2 AS label FROM events), e AS (SELECT min(score) AS lo, max(score) AS hi FROM s),
 c AS (SELECT least({n} - 1, CAST(floor((score - lo) / greatest(hi - lo, 1e-300) * {n}) AS INTEGER)) AS cell, any_value(lo) AS lo, any_value(hi) AS hi, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS q FROM s, e GROUP BY 1)"""
_RATES = "CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS tpr, CASE WHEN neg > 0 THEN (neg - fp) / neg ELSE 0 END AS tnr, CASE WHEN (tp + fp) * pos * neg * (neg - fp + pos - tp) > 0 THEN (tp * (neg - fp) - fp * (pos - tp)) / sqrt((tp + fp) * pos * neg * (neg - fp + pos - tp)) ELSE 0 END AS mcc, CASE WHEN tp + fp + pos > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0 END AS f1"


@query("e6_threshold_sweep", f"""WITH {_GRID.format(n=100)}, r AS (SELECT lo + cell * (hi - lo) / 100 AS threshold, CAST(sum(p) OVER (ORDER BY cell DESC) AS DOUBLE) AS tp, CAST(sum(q) OVER (ORDER BY cell DESC) AS DOUBLE) AS fp, CAST(sum(p) OVER () AS DOUBLE) AS pos, CAST(sum(q) OVER () AS DOUBLE) AS neg FROM c), m AS (SELECT *, {_RATES} FROM r)
 SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(f1, 6) AS f1, round(tpr + tnr - 1, 6) AS youden, round((tpr + tnr) / 2, 6) AS balanced_accuracy, round(mcc, 6) AS mcc, round(sqrt(tpr * tnr), 6) AS g_mean, round((tpr + tnr) / 2 * (1 + abs(tpr - tnr)), 6) AS iba FROM m""")
def sweep(spark, sf_dir):
    return E.threshold_sweep(_t(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("user_id") % 2).alias("label")))


@query("e6b_otsu", f"""WITH {_GRID.format(n=256)}, w AS (SELECT cell, lo, hi, CAST(p + q AS DOUBLE) AS n FROM c), r AS (SELECT cell, lo, hi, sum(n) OVER (ORDER BY cell) AS w0, sum(n * cell) OVER (ORDER BY cell) AS s0, sum(n) OVER () AS w, sum(n * cell) OVER () AS s FROM w),
 g AS (SELECT *, CASE WHEN w - w0 > 0 THEN w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) ELSE -1 END AS b FROM r) SELECT round(lo + (cell + 1) * (hi - lo) / 256, 6) AS threshold FROM g ORDER BY b DESC, cell LIMIT 1""")
def otsu(spark, sf_dir):
    return E.otsu(_t(spark, sf_dir, "events").select(F.col("value").alias("score")))


@query("s16_catalog", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE SELECT * FROM {t})) AS n_columns FROM {t}" for t in TABLES))
def catalog(spark, sf_dir):
    found = readers.schema_catalog(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TABLES})
    return found.select("name", "n_rows", F.size("columns").alias("n_columns"))


@query("k3_corpus_lines", "SELECT CAST(item_id AS VARCHAR) AS id, text AS contents FROM benchmark WHERE trim(text) <> ''")
def corpus(spark, sf_dir):
    lines = writers.corpus_lines(_t(spark, sf_dir, "benchmark"), "item_id", "text")
    return lines.select(F.from_json("value", "id string, contents string").alias("x")).select("x.*")


@query("k5_graph_nodes", "SELECT DISTINCT x AS node FROM (SELECT l_suppkey AS x FROM lineitem UNION ALL SELECT l_partkey FROM lineitem)")
def nodes(spark, sf_dir):
    return writers.graph_tables(_t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")[0]


@query("k7_inverted_index", "SELECT term, item_id AS doc_id, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY 1, 2")
def inverted(spark, sf_dir):
    return writers.inverted_index(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("contents")))


@query("k9_sorted_layout", "SELECT c_custkey AS modelId, 'c' AS _table_type, c_name AS name, NULL::VARCHAR AS extra FROM customer UNION ALL SELECT s_suppkey, 's', NULL, s_name FROM supplier")
def sorted_rows(spark, sf_dir):
    return writers.sorted_layout({"c": _t(spark, sf_dir, "customer").selectExpr("c_custkey AS modelId", "c_name AS name"), "s": _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS modelId", "s_name AS extra")})


@query("k10_wide_layout", "SELECT coalesce(c_custkey, s_suppkey) AS modelId, c_name AS c, s_name AS s FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey")
def wide(spark, sf_dir):
    w = writers.wide_layout({"c": _t(spark, sf_dir, "customer").selectExpr("c_custkey AS modelId", "c_name AS name"), "s": _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS modelId", "s_name AS name")})
    return w.select("modelId", F.col("c.name").alias("c"), F.col("s.name").alias("s"))


@query("k11_normalized_layout", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS model_key FROM orders")
def normalized(spark, sf_dir):
    return writers.normalized_layout({"o": _t(spark, sf_dir, "orders").selectExpr("o_custkey AS modelId", "o_orderkey")})[1]["o"].select("o_orderkey", "model_key")


@query("k13_selected", "SELECT p_partkey AS table_id, p_partkey || '_t' AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def chosen(spark, sf_dir):
    return writers.selected(_t(spark, sf_dir, "part").selectExpr("p_partkey AS table_id"), _t(spark, sf_dir, "lineitem").filter("l_linenumber = 1").selectExpr("l_partkey AS table_id"), "_t")


@query("s8_s15_semi_seek", "SELECT l_orderkey AS filename, l_linenumber AS line_index, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_custkey % 3 = 0)")
def seek(spark, sf_dir):
    records = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS filename", "l_linenumber AS line_index", "l_quantity")
    return readers.seek_lines(_t(spark, sf_dir, "orders").filter("o_custkey % 3 = 0").selectExpr("o_orderkey AS filename", "1 AS line_index"), records)


_SCORES = "s AS (SELECT value AS score, user_id % 2 AS label FROM events)"


def _scores(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("user_id") % 2).alias("label"))


@query("e6c_welch_t", f"WITH {_SCORES}, a AS (SELECT avg(score) FILTER (WHERE label = 1) AS m1, var_samp(score) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 1) AS s1, count(*) FILTER (WHERE label = 1) AS n1, avg(score) FILTER (WHERE label <> 1) AS m0, var_samp(score) FILTER (WHERE label <> 1) / count(*) FILTER (WHERE label <> 1) AS s0, count(*) FILTER (WHERE label <> 1) AS n0 FROM s) SELECT round((m1 - m0) / sqrt(s1 + s0), 6) AS t, round((s1 + s0) * (s1 + s0) / (s1 * s1 / (n1 - 1) + s0 * s0 / (n0 - 1)), 6) AS df FROM a")
def welch(spark, sf_dir):
    return E.welch_t(_scores(spark, sf_dir))


@query("e6d_rank_tests", f"WITH {_SCORES}, c AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS q FROM s GROUP BY score), r AS (SELECT p, q, sum(p) OVER (ORDER BY score) AS cp, sum(q) OVER (ORDER BY score) AS cq, CAST(sum(p) OVER () AS DOUBLE) AS n1, CAST(sum(q) OVER () AS DOUBLE) AS n0 FROM c), t AS (SELECT max(abs(cp / n1 - cq / n0)) AS ks, CAST(sum(p * (cq - q + q / CAST(2 AS DOUBLE))) AS DOUBLE) AS u, any_value(n1) AS n1, any_value(n0) AS n0 FROM r) SELECT round(ks, 6) AS ks, round(u, 1) AS u, round((u - n1 * n0 / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 6) AS z FROM t")
def ranks(spark, sf_dir):
    return E.rank_tests(_scores(spark, sf_dir))


@query("e6e_p95", f"WITH {_SCORES} SELECT round(quantile_cont(score, 0.95), 6) AS threshold FROM s WHERE label <> 1")
def p95(spark, sf_dir):
    return E.non_direct_p95(_scores(spark, sf_dir))


@query("e6f_folds", "SELECT event_id, CAST(('0x' || substr(md5('42-' || event_id), 1, 8)) AS BIGINT) % 5 AS fold FROM events")
def fold_numbers(spark, sf_dir):
    return E.folds(_t(spark, sf_dir, "events").select("event_id"), "event_id")


def _many(spark, sf_dir):
    return _votes(spark, sf_dir).withColumn("level", F.col("judge") % 5)


@query("e3c_vote_splits", f"WITH v AS (SELECT event_id % 500 AS pair, event_id AS judge, CASE WHEN value > 60 THEN 'YES' WHEN value < 30 THEN 'NO' ELSE 'UNSURE' END AS vote FROM events), p AS (SELECT pair, count(*) FILTER (WHERE vote = 'YES') AS yes, count(*) FILTER (WHERE vote = 'NO') AS no, count(*) FILTER (WHERE vote = 'UNSURE') AS unsure, count(*) AS n FROM v GROUP BY pair) SELECT yes, no, unsure, count(*) AS pairs FROM p WHERE n = (SELECT max(n) FROM p) GROUP BY 1, 2, 3")
def splits(spark, sf_dir):
    votes = _votes(spark, sf_dir)
    most = votes.groupBy("pair").count().agg(F.max("count")).first()[0]
    return E.vote_splits(votes, most)


@query("e3d_unsure_rate", "WITH v AS (SELECT event_id % 5 AS level, CASE WHEN value > 60 THEN 'YES' WHEN value < 30 THEN 'NO' ELSE 'UNSURE' END AS vote FROM events) SELECT level, count(*) AS n, count(*) FILTER (WHERE vote = 'UNSURE') AS unsure, round(count(*) FILTER (WHERE vote = 'UNSURE') / CAST(count(*) AS DOUBLE), 6) AS rate FROM v GROUP BY 1")
def unsure(spark, sf_dir):
    return E.unsure_rate(_many(spark, sf_dir), "level")


@query("e3e_confusion_by_level", f"WITH {_VOTES}, j AS (SELECT pair % 3 AS level, pair % 2 AS truth, vote FROM b WHERE r = 1) SELECT level, count(*) FILTER (WHERE vote = 'YES' AND truth = 1) AS tp, count(*) FILTER (WHERE vote = 'YES' AND truth = 0) AS fp, count(*) FILTER (WHERE vote = 'NO' AND truth = 0) AS tn, count(*) FILTER (WHERE vote = 'NO' AND truth = 1) AS fn, count(*) FILTER (WHERE vote = 'UNSURE') AS unsure, round((tp + tn) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM j GROUP BY level")
def confused_by(spark, sf_dir):
    return E.confusion_by(E.majority(_votes(spark, sf_dir)).withColumns({"truth": F.col("pair") % 2, "level": F.col("pair") % 3}), "level")


@query("e3f_signal_agreement", "SELECT 'long' AS signal, count(*) AS n, count(*) FILTER (WHERE CAST(n_chars > 500 AS INTEGER) = quality) AS agree, round(count(*) FILTER (WHERE CAST(n_chars > 500 AS INTEGER) = quality) / CAST(count(*) AS DOUBLE), 6) AS rate FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'english', count(*), count(*) FILTER (WHERE CAST(lang = 'en' AS INTEGER) = quality), round(count(*) FILTER (WHERE CAST(lang = 'en' AS INTEGER) = quality) / CAST(count(*) AS DOUBLE), 6) FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL")
def signals(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("quality", (F.col("n_chars") > 500).alias("long"), (F.col("lang") == "en").alias("english"))
    return E.signal_agreement(rows, "quality", "long", "english")


@query("e4c_graph_agreement", f"WITH a AS ({_e(1)}), b AS ({_e(2)}), c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either) SELECT 'first' AS a, 'second' AS b, shared, either, round(shared / CAST(either AS DOUBLE), 6) AS agreement FROM c")
def graphs_agree(spark, sf_dir):
    return E.graph_agreement({"first": _edges(spark, sf_dir, 1), "second": _edges(spark, sf_dir, 2)})


@query("e6g_hybrid_threshold", f"WITH {_SCORES} SELECT round(least(min(score) FILTER (WHERE label = 1), quantile_cont(score, 0.95) FILTER (WHERE label <> 1)), 6) AS threshold FROM s")
def hybrid_min(spark, sf_dir):
    return E.hybrid_threshold(_scores(spark, sf_dir))


@query("g5b_citation_contexts", "SELECT event_id, 'c1' AS methodology, CASE WHEN event_id % 2 = 0 THEN 'c2' ELSE 'x y z' END AS background FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'x y z', 'x y z' FROM events WHERE event_id % 2 = 1")
def cited_contexts(spark, sf_dir):
    """Two intents with two contexts in even rows, with three in odd ones."""
    contexts = F.when(F.col("event_id") % 2 == 0, F.lit('["c1","c2"]')).otherwise(F.lit('["x","y","z"]'))
    doc = F.concat(F.lit('{"data":[{"id":1,"isInfluential":true,"intents":[["methodology"],["background"]],"contexts":'), contexts, F.lit("}]}"))
    out = L.citation_contexts(_t(spark, sf_dir, "events").select("event_id", doc.alias("j")), "j")
    return out.select("event_id", F.array_join("methodology_contexts", "|").alias("methodology"), F.array_join("background_contexts", "|").alias("background"))


@query("g6c_overlap_by_intent", """WITH r AS (SELECT DISTINCT o_custkey AS paper, l_partkey AS ref, l_returnflag AS intent, l_quantity > 40 AS infl FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
 x AS (SELECT DISTINCT paper, ref, unnest(CASE WHEN infl THEN ['overall', intent, 'overall_infl', intent || '_infl'] ELSE ['overall', intent] END) AS variant FROM r), n AS (SELECT variant, paper, count(*) AS n FROM x GROUP BY 1, 2),
 s AS (SELECT a.variant, a.paper AS a, b.paper AS b, count(*) AS i FROM x a JOIN x b ON a.variant = b.variant AND a.ref = b.ref AND a.paper < b.paper GROUP BY 1, 2, 3)
 SELECT s.variant, a, b, i AS inter, round(i / CAST(na.n + nb.n - i AS DOUBLE), 6) AS jaccard FROM s JOIN n na ON na.variant = s.variant AND na.paper = a JOIN n nb ON nb.variant = s.variant AND nb.paper = b WHERE greatest(i / CAST(na.n AS DOUBLE), i / CAST(nb.n AS DOUBLE)) >= 0.1""")
def overlap_variants(spark, sf_dir):
    refs = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.expr("o_orderkey = l_orderkey")).select(F.col("o_custkey").alias("paper"), F.col("l_partkey").alias("ref"), F.col("l_returnflag").alias("intent"), (F.col("l_quantity") > 40).alias("influential"))
    return G.overlap_by_intent(refs, 0.1).select("variant", "a", "b", "inter", F.round("jaccard", 6).alias("jaccard"))


@query("g3_links", """WITH l AS (SELECT DISTINCT o_custkey AS model_id, CASE l_linenumber % 2 WHEN 0 THEN 'html' ELSE 'github' END AS source, l_partkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
 SELECT model_id, t - t % 10 AS table_id, CASE WHEN bool_or(source = 'github') THEN 'github' ELSE 'html' END AS source FROM l GROUP BY 1, 2""")
def led_links(spark, sf_dir):
    links = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.expr("o_orderkey = l_orderkey")).select(F.col("o_custkey").alias("model_id"), F.when(F.col("l_linenumber") % 2 == 0, "html").otherwise("github").alias("source"), F.col("l_partkey").alias("table_id"))
    mapping = links.select("table_id").distinct().filter("table_id % 10 <> 0").withColumn("canonical", F.col("table_id") - F.col("table_id") % 10)
    return L.canonical_links(links, mapping)


@query("g8b_known_targets", "WITH l AS (SELECT c_custkey AS m, 'ORG/' || c_nationkey AS t FROM customer), p AS (SELECT 'm' || a.m AS a, 'm' || b.m AS b FROM l a JOIN l b ON a.t = b.t AND a.m <> b.m UNION ALL SELECT 'm' || m, 'Org/' || substr(t, 5) FROM l) SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM p")
def known_targets(spark, sf_dir):
    """Targets in two spellings, and the nations' own models known by name."""
    links = _t(spark, sf_dir, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("model"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "ORG/").otherwise("org/"), F.col("c_nationkey").cast("string")).alias("target"))
    known = _t(spark, sf_dir, "nation").select(F.concat(F.lit("Org/"), F.col("n_nationkey").cast("string")).alias("model"))
    return G.shared_target_edges(links, known, fold_case=True)
