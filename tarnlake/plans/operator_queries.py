"""Queries through the operators that take any table: predicates, ranks, profiles, further sources and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import order as O
from tarnlake.operators import predicates as P
from tarnlake.operators import profile as R
from tarnlake.plans.dialect import translate
from tarnlake.plans.relational import CARDS, LONG
from tarnlake.registry import query
from tarnlake.session import own_path
from tarnlake.sources import readers, writers
from tarnlake.sources.tables import TABLES, read_table, register_views


def _rows(spark: SparkSession, sf_dir: str, relation: str, name: str, tables: tuple[str, ...]) -> DataFrame:
    register_views(spark, sf_dir, tables)
    return spark.sql(translate(f"WITH {relation} SELECT * FROM {name}")[0])


def _cards(spark, sf_dir):
    return _rows(spark, sf_dir, CARDS, "cards", ("documents",))


def _links(spark, sf_dir):
    return _rows(spark, sf_dir, LONG, "links", ("orders", "lineitem"))


# -- predicates


@query("p1_valid_card", f"WITH {CARDS} SELECT model_id, author FROM cards WHERE card IS NOT NULL AND card <> '' AND card <> 'Entry not found'")
def valid(spark, sf_dir):
    return _cards(spark, sf_dir).filter(P.valid_card(F.col("card"))).select("model_id", "author")


@query("p2_strict_valid_card", f"""WITH {CARDS} SELECT model_id, length(card) AS n FROM cards WHERE card IS NOT NULL AND trim(card) <> ''
  AND trim(card) NOT IN ('None', 'none', 'Null', 'null', 'N/A', 'n/a', 'Entry not found') AND length(card) > 10 AND card <> 'Invalid username or password.'""")
def strictly_valid(spark, sf_dir):
    return _cards(spark, sf_dir).filter(P.strictly_valid_card(F.col("card"))).select("model_id", F.length("card").alias("n"))


@query("p3_empty_pattern", f"""WITH {CARDS} SELECT CASE WHEN card IS NULL THEN 'null' WHEN card = '' THEN 'empty' WHEN trim(card) = 'N/A' THEN 'na' WHEN card = 'Entry not found' THEN 'not_found' ELSE 'other' END AS pattern,
  count(*) AS n FROM cards GROUP BY 1""")
def patterns(spark, sf_dir):
    return _cards(spark, sf_dir).groupBy(P.empty_pattern(F.col("card")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("p10_list_match", f"""WITH {translate(LONG)[1]}, m AS (SELECT model_id, list_transform(array_agg(table_id), lambda x: 'Org/Set-' || x) AS l FROM links GROUP BY model_id)
  SELECT model_id FROM m WHERE len(list_filter(l, lambda x: x = 'Org/Set-7' OR lower(x) LIKE '%/set-42')) > 0""")
def matched(spark, sf_dir):
    m = _links(spark, sf_dir).groupBy("model_id").agg(F.collect_list(F.concat(F.lit("Org/Set-"), F.col("table_id").cast("string"))).alias("l"))
    return m.filter(P.list_match(m, "l", "Org/Set-7", "/SET-42")).select("model_id")


@query("p11_template_score", """SELECT score, count(*) AS n FROM (SELECT CASE WHEN text LIKE '%license%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%token%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%http%' THEN 1 ELSE 0 END
  + CASE WHEN text LIKE '%@%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%|%' THEN 1 ELSE 0 END AS score FROM documents) GROUP BY score""")
def scores(spark, sf_dir):
    score = P.template_score(F.col("text"), "license", "token", "http", "@", "|")
    return read_table(spark, sf_dir, "documents").groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"))


# -- ranks


@query("w1_best_of_card", f"WITH {CARDS} SELECT model_id, likes FROM (SELECT model_id, likes, row_number() OVER (PARTITION BY card ORDER BY likes DESC, model_id) AS r FROM cards) WHERE r = 1")
def best(spark, sf_dir):
    rows = _cards(spark, sf_dir).select("card", "likes", "model_id")
    return O.best_of(rows, "card", [-F.col("likes"), F.col("model_id")]).select("model_id", "likes")


@query("w8_ecdf", "SELECT event_id, round((row_number() OVER (ORDER BY value, event_id) - 1) / (CAST((SELECT count(*) FROM events) AS DOUBLE) - 1), 9) AS ecdf FROM events")
def ecdf(spark, sf_dir):
    return O.ecdf(read_table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id").select("event_id", F.round("ecdf", 9).alias("ecdf"))


@query("w8b_log_bins", "SELECT CAST(floor(log10(value) * 5 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value > 0 GROUP BY 1")
def bins(spark, sf_dir):
    return R.log_bins(read_table(spark, sf_dir, "events"), "value")


@query("w8c_iqr_band", "WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents), b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q) SELECT CAST(q1 AS DOUBLE) AS q1, CAST(q3 AS DOUBLE) AS q3, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CAST(sum(CASE WHEN n_chars < low OR n_chars > high THEN 1 ELSE 0 END) AS BIGINT) AS n_outside FROM documents, b GROUP BY q1, q3, low, high")
def band(spark, sf_dir):
    return R.iqr_band(read_table(spark, sf_dir, "documents"), "n_chars")


@query("w9_rank_frequency", f"WITH {LONG} SELECT table_id, n, row_number() OVER (ORDER BY n DESC, table_id) AS rank FROM (SELECT table_id, count(*) AS n FROM links GROUP BY 1)")
def frequencies(spark, sf_dir):
    return O.rank_frequency(_links(spark, sf_dir), "table_id")


@query("w10b_last_known", "SELECT event_id, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events")
def last_known(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return O.carried_forward(rows, "user_id", ["value"], "event_id").select("event_id", "value")


# -- profiles


@query("a15_column_profile", f"""WITH {CARDS} SELECT 'card' AS col, 'string' AS type, count(*) AS n, count(*) - count(card) AS n_null, round((count(*) - count(card)) * 100.0::DOUBLE / count(*), 4) AS pct_null, round(avg(length(card)), 6) AS avg_length, CAST(sum(octet_length(encode(card))) AS BIGINT) AS bytes FROM cards
  UNION ALL SELECT 'author', 'string', count(*), count(*) - count(author), round((count(*) - count(author)) * 100.0::DOUBLE / count(*), 4), round(avg(length(author)), 6), CAST(sum(octet_length(encode(author))) AS BIGINT) FROM cards
  UNION ALL SELECT 'words', 'array<string>', count(*), count(*) - count(card), round((count(*) - count(card)) * 100.0::DOUBLE / count(*), 4), round(avg(len(string_split(card, ' '))), 6), NULL FROM cards""")
def profiled(spark, sf_dir):
    rows = _cards(spark, sf_dir).select("card", "author", F.split("card", " ").alias("words"))
    out = R.column_profile(rows)
    # the bytes of a list are those of its JSON text, which the checking engine writes otherwise
    return out.select("col", "type", "n", "n_null", F.round("pct_null", 4).alias("pct_null"), F.round("avg_length", 6).alias("avg_length"), F.when(F.col("type") == "string", F.col("bytes")).alias("bytes"))


@query("a19_table_frequency", f"WITH {LONG}, f AS (SELECT table_id, count(*) AS n, count(DISTINCT model_id) AS models FROM links GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS n_tables, max(models) AS most_models, round(avg(n), 6) AS mean FROM f")
def frequency(spark, sf_dir):
    return R.table_frequency(_links(spark, sf_dir), "table_id", "model_id").withColumn("mean", F.round("mean", 6))


@query("a19b_most_frequent", f"WITH {LONG} SELECT table_id, count(*) AS n FROM links GROUP BY 1 ORDER BY n DESC, table_id LIMIT 10")
def most_frequent(spark, sf_dir):
    return R.most_frequent(_links(spark, sf_dir), "table_id")


@query("a20b_neighbor_histogram", "WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS src, greatest(l_suppkey, l_partkey) AS dst FROM lineitem WHERE l_suppkey <> l_partkey), d AS (SELECT x, count(*) AS degree FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) GROUP BY x) SELECT degree, count(*) AS n FROM d GROUP BY degree")
def degrees(spark, sf_dir):
    from tarnlake.operators.graph import edges_of

    return R.neighbor_histogram(edges_of(read_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey"))


_GROWTH = "SELECT CAST(row_number() OVER (ORDER BY m) AS DOUBLE) AS x, CAST(sum(n) OVER (ORDER BY m) AS DOUBLE) AS y FROM (SELECT date_trunc('month', CAST(o_orderdate AS DATE)) AS m, count(*) AS n FROM orders GROUP BY 1)"


@query("m4b_exponential_fit", f"SELECT round(exp(regr_intercept(ln(y), x)), 5) AS scale, round(regr_slope(ln(y), x), 8) AS rate FROM ({_GROWTH})")
def exponential(spark, sf_dir):
    register_views(spark, sf_dir, ("orders",))
    return R.exponential_fit(spark.sql(_GROWTH), "x", "y").select(F.round("scale", 5).alias("scale"), F.round("rate", 8).alias("rate"))


# -- sources and sinks

_PART = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS contents FROM part"


def _bytes(spark: SparkSession, path: str, name: str, content: bytes) -> str:
    """A file in the shared folder, written through Hadoop so that all executors see it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()
    return f"{path}/{name}"


def _npz(**arrays) -> bytes:
    import io

    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


@query("s5_csv_encodings", "SELECT * FROM (VALUES ('latin.csv', 'café', '\u0081x'), ('utf.csv', 'café', '€'), ('windows.csv', 'café', '€')) AS t(file, a, b)")
def encodings(spark, sf_dir):
    path = own_path(spark, "encodings")
    for name, text, code in (("utf.csv", "a,b\ncafé,€\n", "utf-8"), ("windows.csv", "a,b\ncafé,€\n", "cp1252"), ("latin.csv", "a,b\ncafé,\x81x\n", "latin-1")):
        _bytes(spark, path, name, text.encode(code))
    found = readers.scan_csv_tables(spark, f"{path}/*.csv")
    return found.select(F.regexp_extract("table_id", "([^/]+)$", 1).alias("file"), F.col("rows")[0][0].alias("a"), F.col("rows")[0][1].alias("b"))


@query("s7_csv_analysis", "SELECT 'display' AS kind, p_partkey AS id, 'NA' AS a, '' AS b, 4 AS n_cols FROM part UNION ALL SELECT 'analysis', p_partkey, 'NA', p_brand, 3 FROM part")
def analysis(spark, sf_dir):
    path = own_path(spark, "analysis")
    part = read_table(spark, sf_dir, "part")
    # an empty column, a word that readers take for null, a blank row after each
    lines = part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(",NA,,"), F.col("p_brand"), F.lit("\n,,,")).alias("value"))
    header = spark.createDataFrame([("id,a,,brand",)], "value string")
    header.unionByName(lines).coalesce(1).write.text(path)
    out = []
    for kind, df in (("display", readers.scan_csv_display(spark, f"{path}/part-*")), ("analysis", readers.scan_csv_analysis(spark, f"{path}/part-*"))):
        rows = df.select(F.explode("rows").alias("r")).filter(F.col("r")[0] != "")
        out.append(rows.select(F.lit(kind).alias("kind"), F.col("r")[0].cast("long").alias("id"), F.col("r")[1].alias("a"), F.col("r")[2].alias("b"), F.size("r").alias("n_cols")))
    return out[0].unionByName(out[1])


@query("s12_embeddings", "SELECT CAST(r_regionkey AS VARCHAR) AS id, CAST(r_regionkey * 1.5 AS DOUBLE) AS first, 3 AS dims FROM region")
def embeddings(spark, sf_dir):
    path = own_path(spark, "npz")
    ids = [r[0] for r in read_table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    _bytes(spark, path, "vectors.npz", _npz(ids=np.array(ids), embeddings=np.array([[i * 1.5, 0, 1] for i in ids], dtype=np.float32)))
    return readers.scan_embeddings(spark, f"{path}/*.npz").select("id", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("dims"))


@query("s13_sparse_graph", "SELECT n_name AS src, r_name AS dst, CAST(1 AS DOUBLE) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey")
def sparse_graph(spark, sf_dir):
    path = own_path(spark, "csr")
    nations = read_table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    regions = read_table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    place = {r["r_regionkey"]: len(nations) + i for i, r in enumerate(regions)}
    columns = np.array([place[n["n_regionkey"]] for n in nations])
    size = len(nations) + len(regions)
    ends = np.minimum(np.arange(size + 1), len(nations))
    _bytes(spark, path, "graph.npz", _npz(data=np.ones(len(columns)), indices=columns, indptr=ends, shape=np.array([size, size])))
    names = spark.createDataFrame([(i, x) for i, x in enumerate([*[n["n_name"] for n in nations], *[r["r_name"] for r in regions]])], "place long, name string")
    return readers.scan_sparse_graph(spark, f"{path}/*.npz", names)


@query("s14_table_on_miss", "SELECT n_nationkey, n_name FROM nation")
def on_miss(spark, sf_dir):
    name = f"tarnlake_nation_{own_path(spark, 'x')[-12:]}"
    readers.scan_table(spark, name, f"{sf_dir.rstrip('/')}/nation.parquet")
    rows = readers.scan_table(spark, name).select("n_nationkey", "n_name").collect()
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(rows, read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name").schema)


@query("k4_append_table", "SELECT r_regionkey, count(*) AS n FROM (SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region) GROUP BY 1")
def appended(spark, sf_dir):
    name = f"tarnlake_region_{own_path(spark, 'x')[-12:]}"
    region = read_table(spark, sf_dir, "region").select("r_regionkey")
    for _ in (0, 1):
        writers.append_table(region, name)
    rows = spark.table(name).groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("n")).collect()
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(rows, f"r_regionkey {region.schema[0].dataType.simpleString()}, n long")


@query("k14_markdown_report", "SELECT '## regions' AS first, 12 AS n_lines")
def report(spark, sf_dir):
    """Five regions against their first nations: two blocks of a heading and a table."""
    rows = lambda t, c: [[str(x) for x in r] for r in read_table(spark, sf_dir, t).select(*c).orderBy(c[0]).limit(5).collect()]
    query_table = {"table_id": "regions", "header": ["key", "name"], "rows": rows("region", ["r_regionkey", "r_name"])[:2]}
    hit = {"table_id": "nations", "header": ["key", "name"], "rows": rows("nation", ["n_nationkey", "n_name"])[:1]}
    text = writers.markdown_report(query_table, [hit]).split("\n")
    return spark.createDataFrame([(text[0], len(text))], "first string, n_lines int")


@query("s17_fetched", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'held ' || p_brand ELSE 'got u' || p_partkey END AS body FROM part")
def fetched(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    url = F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url")
    cache = part.filter("p_partkey % 3 = 0").select(url, F.concat(F.lit("held "), F.col("p_brand")).alias("body"))
    found = readers.fetched(part.select(url), cache, lambda u: f"got {u}")
    return found.select(F.substring("url", 2, 20).cast("long").alias("id"), "body")


@query("j16b_join_path", "SELECT * FROM (VALUES ('customer>orders>lineitem')) AS t(way)")
def ways(spark, sf_dir):
    """From a customer's name to a line's part, through the attributes that tables share."""
    shared = {"customer": ["c_name", "custkey"], "orders": ["custkey", "orderkey"], "lineitem": ["orderkey", "l_partkey"], "region": ["r_name"]}
    catalog = spark.createDataFrame([(t, [f"{c}:x" for c in shared.get(t, [f"{t}_key"])]) for t in TABLES], "name string, columns array<string>")
    return spark.createDataFrame([(">".join(w),) for w in readers.join_path(catalog, "c_name", "l_partkey")], "way string")
