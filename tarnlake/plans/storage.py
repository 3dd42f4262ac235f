"""Queries that write to the shared folder and read back, and the rest of the scalar pack."""

from __future__ import annotations


from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators import graph as G
from tarnlake.operators import search as S
from tarnlake.plans.dialect import both
from tarnlake.registry import query
from tarnlake.session import own_path
from tarnlake.sources import readers, writers
from tarnlake.sources.tables import TABLES, read_table
from tarnlake.streaming import ingest as I


def _place(spark, name):
    return own_path(spark, name)


def _part(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("contents"))


PART = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS contents FROM part"


@query("s1_snapshot", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'v1' AS tag FROM part")
def snapshot(spark, sf_dir):
    root = _place(spark, "snapshot")
    _part(spark, sf_dir).write.parquet(f"{root}/raw_v1/train-0.parquet")
    assert readers.list_snapshots(spark, root) == ["v1"]
    return readers.scan_snapshot(spark, root, "v1", columns=["id"])


both("s3_scan_parquet_sql", "SELECT count(*) AS n, count(DISTINCT source) AS n_sources FROM documents", ("documents",))


@query("s4_csv_unknown_form", "SELECT 'id' AS a, 'contents' AS b, count(*) AS n FROM part")
def csv_unknown(spark, sf_dir):
    path = _place(spark, "csv")
    writers.write_csv(_part(spark, sf_dir).coalesce(1), path)
    found = readers.scan_csv_tables(spark, f"{path}/part-*.csv")
    return found.select(F.col("header")[0].alias("a"), F.col("header")[1].alias("b"), F.size("rows").cast("long").alias("n"))


@query("s6_csv_native", PART)
def csv_native(spark, sf_dir):
    path = _place(spark, "csv")
    writers.write_csv(_part(spark, sf_dir), path)
    return readers.scan_csv(spark, path).select("id", "contents")


@query("s9_ndjson", "SELECT p_partkey AS citingcorpusid, CAST(p_size AS BIGINT) AS citedcorpusid FROM part WHERE p_partkey % 5 <> 0")
def ndjson(spark, sf_dir):
    path = _place(spark, "ndjson")
    p = read_table(spark, sf_dir, "part")
    p.select(F.when(F.col("p_partkey") % 5 == 0, "broken {").otherwise(F.to_json(F.struct(F.col("p_partkey").alias("citationid"), F.col("p_partkey").alias("citingcorpusid"), F.col("p_size").alias("citedcorpusid")))).alias("value")).write.text(path)
    return readers.scan_citations(spark, path).select("citingcorpusid", "citedcorpusid")


@query("s10_jsonl_k3", PART)
def jsonl(spark, sf_dir):
    path = _place(spark, "jsonl")
    writers.write_jsonl(_part(spark, sf_dir), path)
    return readers.scan_ndjson(spark, path, "id STRING, contents STRING", ("id",))


@query("s11_tsv_queries", "SELECT CAST(p_partkey AS VARCHAR) AS qid, p_brand AS text FROM part WHERE p_partkey % 3 <> 0")
def tsv(spark, sf_dir):
    path = _place(spark, "tsv")
    _part(spark, sf_dir).select(F.concat("id", F.when(F.col("id").cast("int") % 3 == 0, "").otherwise("\t"), "contents").alias("value")).write.text(path)
    return readers.scan_tsv_queries(spark, path)


@query("k1_parquet_lists", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS n FROM part")
def parquet_lists(spark, sf_dir):
    path = _place(spark, "lists")
    p = read_table(spark, sf_dir, "part")
    writers.write_parquet(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 1, F.array("p_brand")).alias("l")), path)
    return spark.read.parquet(path).select("id", F.size("l").alias("n"))


@query("k8_partitioned", "SELECT substr(CAST(p_partkey AS VARCHAR), 1, 1) AS partition, count(*) AS n FROM part GROUP BY 1")
def partitioned(spark, sf_dir):
    path = _place(spark, "partitioned")
    writers.write_partitioned(_part(spark, sf_dir), path, "id")
    return spark.read.parquet(path).groupBy(F.col("partition").cast("string").alias("partition")).agg(F.count(F.lit(1)).alias("n"))


@query("k6_graph_files", "SELECT 'nodes' AS kind, count(*) AS n FROM (SELECT l_suppkey FROM lineitem UNION SELECT l_partkey FROM lineitem) UNION ALL SELECT 'edges', count(*) FROM lineitem")
def graph_files(spark, sf_dir):
    path = _place(spark, "graph")
    writers.write_graph(read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), path, "l_suppkey", "l_partkey")
    count = lambda k: spark.read.parquet(f"{path}/{k}").agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("nodes").unionByName(count("edges"))


@query("stream_incremental_load", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def incremental(spark, sf_dir):
    root = _place(spark, "stream")
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    for k in (0, 1):  # what a second run finds is what came since
        events.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{root}/in")
        I.ingest(spark, f"{root}/in", f"{root}/out", f"{root}/check", "event_id long, user_id long")
    return spark.read.parquet(f"{root}/out").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))


@query("j16_join_path", "SELECT 'lineitem' AS name, 11 AS n UNION ALL SELECT 'x', 0 WHERE false")
def join_path(spark, sf_dir):
    catalog = readers.schema_catalog(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TABLES})
    return readers.holding(catalog, "l_partkey", "l_suppkey").select("name", F.size("columns").alias("n"))


@query("x20_dataset_ids", "SELECT p_partkey AS id, 'org' || p_size || '/set-' || p_partkey AS value FROM part")
def dataset_ids(spark, sf_dir):
    text = F.concat(F.lit("see https://huggingface.co/datasets/Org"), F.col("p_size").cast("string"), F.lit("/Set-"), F.col("p_partkey").cast("string"), F.lit(". Fine"))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.dataset_ids(text), ",").alias("value"))


both("r2_parallel_unnest", "WITH m AS (SELECT o_custkey % 50 AS g, array_agg(DISTINCT o_orderstatus) AS a, array_agg(DISTINCT o_orderpriority) AS b FROM orders GROUP BY 1) SELECT DISTINCT 'a' AS list, g, $UNNEST(a) AS v FROM m UNION ALL SELECT DISTINCT 'b', g, $UNNEST(b) FROM m", ("orders",))


@query("n2_annotation_slices", "SELECT doc_id, substr(text, 3, 5) AS first, 1 AS n FROM documents WHERE length(text) >= 8")
def slices(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").filter("length(text) >= 8")
    found = T.annotation_slices(F.col("text"), F.lit('[{"start": 2, "end": 7}, {"start": 5, "end": 1}]'))
    return docs.select("doc_id", found[0]["extracted_text"].alias("first"), F.size(found).alias("n"))


@query("n4_json_lists", "SELECT p_partkey AS id, 'q' AS query, i AS rank, CASE i WHEN 0 THEN p_brand ELSE 'x' END AS hit FROM part, (SELECT unnest([0, 1]) AS i)")
def json_lists(spark, sf_dir):
    json = F.to_json(F.create_map(F.lit("q"), F.array("p_brand", F.lit("x"))))
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(T.json_lists(json)).alias("query", "hits"))
    return rows.select("id", "query", F.posexplode("hits").alias("rank", "hit"))


@query("g9b_title_association", "WITH t AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS t FROM lineitem) SELECT a.r AS a, b.r AS b, count(*) AS shared FROM t a JOIN t b ON a.t = b.t AND a.r < b.r GROUP BY 1, 2")
def association(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("title"))
    return G.title_association(rows)


@query("q8_quick_retrieval", "WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst FROM lineitem WHERE l_suppkey <> l_partkey) SELECT CAST(7 AS BIGINT) AS \"table\", CASE WHEN src = 7 THEN dst ELSE src END AS neighbor, 'graph' AS origin FROM e WHERE src = 7 OR dst = 7")
def quick(spark, sf_dir):
    names = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table"), F.concat(F.lit("org/m"), F.col("p_partkey").cast("string")).alias("model"), F.lit("2101.00001").alias("paper"))
    edges = G.edges_of(read_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    return S.quick_retrieval("org/m7", names, edges, edges.select(F.col("src").alias("query_id"), F.col("dst").alias("doc_id")))


@query("q5b_by_variant", "SELECT 'p' || a.p_partkey || '_s.csv' AS query_id, 'p' || b.p_partkey || '_s.csv' AS doc_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def by_variant(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    name = lambda k, s: F.concat(F.lit("p"), k.cast("string"), F.lit(s))
    pairs = p.join(p.select(F.col("k").alias("j")), F.expr("j = k + 1"))
    rows = pairs.select(name(F.col("k"), "_s.csv").alias("query_id"), name(F.col("j"), "_s.csv").alias("doc_id")).unionByName(pairs.select(name(F.col("k"), "_s.csv").alias("query_id"), name(F.col("k"), "_t.csv").alias("doc_id"))).unionByName(pairs.select(name(F.col("k"), ".csv").alias("query_id"), name(F.col("j"), "_s.csv").alias("doc_id")))
    return S.by_variant(rows, "_s", "_s")


@query("q5c_contained", "SELECT l_suppkey AS query_id, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_partkey END) AS shared, count(DISTINCT l_partkey) AS total FROM lineitem GROUP BY 1")
def contained(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), "l_quantity")
    return S.contained(rows.filter("l_quantity > 25").select("query_id", "doc_id").distinct(), rows.select("query_id", "doc_id").distinct())
