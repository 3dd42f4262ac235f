"""Predicates, joins, aggregates, windows, top-k and set operations over the lake's relations.

Documents stand for model cards (source: author, n_chars: likes), orders for models, the parts of an
order for its tables, dealt to four sources by line number. A null list and an empty one are alike.
"""

from __future__ import annotations

from tarnlake.plans.dialect import both

DOCS, LINKED, LABELS = ("documents",), ("orders", "lineitem"), ("documents", "labels")

#: Models with four lists of tables; null where a source has none.
LISTS = """lists AS (SELECT l_orderkey AS model_id, CAST(min(o_orderdate) AS DATE) AS created,
  array_sort(array_agg(CASE WHEN l_linenumber % 4 = 1 THEN l_partkey END)) AS x1, count(CASE WHEN l_linenumber % 4 = 1 THEN 1 END) AS hugging,
  count(CASE WHEN l_linenumber % 4 = 2 THEN 1 END) AS github, count(CASE WHEN l_linenumber % 4 = 3 THEN 1 END) AS html, count(CASE WHEN l_linenumber % 4 = 0 THEN 1 END) AS llm
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)"""
LONG = """links AS (SELECT l_orderkey AS model_id, l_partkey AS table_id, CAST(o_orderdate AS DATE) AS created,
  CASE l_linenumber % 4 WHEN 1 THEN 'hugging' WHEN 2 THEN 'github' WHEN 3 THEN 'html' ELSE 'llm' END AS source,
  CASE l_linenumber % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS priority, l_linenumber AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CARDS = """cards AS (SELECT doc_id AS model_id, source AS author, n_chars AS likes, lang, text AS raw,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'Entry not found' WHEN doc_id % 19 = 0 THEN ' N/A ' ELSE text END AS card FROM documents)"""

# -- predicates
both("p4_has_any_table", f"WITH {LISTS} SELECT model_id FROM lists WHERE hugging > 0 OR github > 0 OR html > 0 OR llm > 0", LINKED)
both("p5_only_hugging", f"WITH {LISTS} SELECT model_id, hugging FROM lists WHERE hugging > 0 AND github = 0 AND html = 0 AND llm = 0", LINKED)
both("p6_generic_exclude", f"WITH {LONG} SELECT model_id, table_id FROM links WHERE CAST(table_id AS $STR) NOT LIKE '%99%' AND CAST(table_id AS $STR) NOT LIKE '%17'", LINKED)
both("p7_size_filter", f"""WITH {LONG}, shape AS (SELECT table_id, count(*) AS n_rows, count(DISTINCT model_id) AS n_cols FROM links GROUP BY table_id)
  SELECT * FROM shape WHERE NOT (n_cols >= 40 OR n_rows >= 35)""", LINKED)
both("p8_flag_sums", f"""WITH {CARDS} SELECT author, sum(CASE WHEN card IS NULL THEN 1 ELSE 0 END) AS n_null, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS n_en,
  round(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS pct_en FROM cards GROUP BY author""".replace("100.0", "CAST(100 AS DOUBLE)"), DOCS)
both("p9_membership", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", LABELS)
both("p12_template_equality", """WITH t AS (SELECT text AS template FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)),
  c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat('  ', template, ' ') WHEN doc_id % 7 = 1 THEN concat('---~a: 1~---~', template) WHEN doc_id % 7 = 2 THEN template ELSE text END AS card, template FROM documents CROSS JOIN t)
  SELECT doc_id, card = template AS exact, trim(card) = trim(template) AS normalized,
    CASE WHEN substr(card, 1, 4) = '---~' THEN substr(card, instr(substr(card, 5), '---~') + 8) ELSE card END = template AS body FROM c""", DOCS)

# -- joins
both("j1_three_way", "SELECT d.doc_id, d.source, l.quality, b.item_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id JOIN benchmark b ON b.item_id = d.doc_id", ("documents", "labels", "benchmark"))
both("j2_left", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", LABELS)
both("j3_left_null_check", "SELECT count(*) AS n_docs, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS n_unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", LABELS)
both("j4_array_join", f"""WITH {LONG}, m AS (SELECT model_id, array_agg(DISTINCT table_id) AS titles FROM links GROUP BY model_id), e AS (SELECT model_id, $UNNEST(titles) AS title FROM m),
  r AS (SELECT p_partkey AS title, p_brand AS path FROM part) SELECT model_id, $JOIN(array_sort(array_agg(DISTINCT path)), ',') AS paths FROM e JOIN r ON e.title = r.title GROUP BY model_id""", (*LINKED, "part"))
both("j5_staged_fallback", """WITH q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE concat(p_name, '-x') END AS title FROM part),
  r AS (SELECT p_name AS title, min(p_partkey) AS corpus FROM part GROUP BY p_name), n AS (SELECT lower(p_name) AS title, min(p_partkey) AS corpus FROM part GROUP BY lower(p_name))
  SELECT q.id, coalesce(r.corpus, n.corpus, p.corpus) AS corpus FROM q LEFT JOIN r ON q.title = r.title LEFT JOIN n ON lower(q.title) = n.title LEFT JOIN n p ON replace(lower(q.title), '-x', '') = p.title""", ("part",))
both("j6_composite", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", ("lineitem",))
both("j7_in_list", "SELECT p_partkey, lower(trim(p_name)) AS title FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45)", ("part", "lineitem"))
both("j8_semi_whitelist", """WITH w AS (SELECT p_partkey AS id FROM part WHERE p_size = 7) SELECT w.id, count(l_orderkey) AS n, coalesce($JOIN(array_sort(array_agg(DISTINCT l_orderkey)), ','), '') AS orders
  FROM w LEFT JOIN lineitem ON l_partkey = w.id GROUP BY w.id""", ("part", "lineitem"))
both("j9_anti", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)", LABELS)
both("j10_full_outer_diff", """WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_linenumber = 2)
  SELECT CASE WHEN a.id IS NULL THEN 'only_b' WHEN b.id IS NULL THEN 'only_a' ELSE 'both' END AS side, count(*) AS n FROM a FULL OUTER JOIN b ON a.id = b.id GROUP BY 1""", ("lineitem",))
both("j10b_full_outer_date", """WITH a AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1)
  SELECT coalesce(a.d, b.d) AS d, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM a FULL OUTER JOIN b ON a.d = b.d""", ("events",))
both("j10c_left_chain", """WITH c AS (SELECT o_custkey AS id, count(*) AS n_citations FROM orders GROUP BY 1), r AS (SELECT o_custkey AS id, count(DISTINCT l_partkey) AS n_references FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
  SELECT c_custkey AS id, n_citations, n_references FROM customer LEFT JOIN c ON c.id = c_custkey LEFT JOIN r ON r.id = c_custkey""", ("customer", *LINKED))
both("j10d_anti_then_inner", """WITH local AS (SELECT c_custkey AS id, lower(c_name) AS t FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)), api AS (SELECT c_custkey AS api_id, lower(c_name) AS t FROM customer)
  SELECT DISTINCT id, api_id FROM local JOIN api ON local.t = api.t""", ("customer", "orders"))
both("j11_shared_key", """WITH refs AS (SELECT DISTINCT o_custkey AS paper, l_partkey AS ref FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
  SELECT a.paper AS a, b.paper AS b, count(*) AS shared FROM refs a JOIN refs b ON a.ref = b.ref AND a.paper < b.paper GROUP BY 1, 2""", LINKED)
both("j12_matrix_product", """WITH inc AS (SELECT DISTINCT l_orderkey AS paper, l_partkey AS t FROM lineitem), adj AS (SELECT DISTINCT a.o_orderkey AS p, b.o_orderkey AS q FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate),
  pt AS (SELECT DISTINCT inc.t, adj.q FROM inc JOIN adj ON inc.paper = adj.p) SELECT DISTINCT pt.t AS src, inc.t AS dst FROM pt JOIN inc ON pt.q = inc.paper WHERE pt.t < inc.t""", LINKED)
both("j13_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", ("customer", "nation", "region"))
both("j14_occurrence", """WITH a AS (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS occ FROM orders), b AS (SELECT user_id AS k, event_id AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS occ FROM events)
  SELECT a.k, a.occ, a.v AS order_id, b.v AS event_id FROM a JOIN b ON a.k = b.k AND a.occ = b.occ""", ("orders", "events"))
both("j15_neighborhood", """WITH e AS (SELECT DISTINCT l_suppkey AS citing, l_partkey AS cited FROM lineitem) SELECT 'cites' AS direction, citing, cited FROM e WHERE citing = 7 UNION ALL SELECT 'cited_by', citing, cited FROM e WHERE cited = 7""", ("lineitem",))

# -- aggregates
both("a1_counts", f"WITH {CARDS} SELECT count(*) AS n, count(DISTINCT card) AS n_cards, count(DISTINCT author) AS n_authors FROM cards", DOCS)
both("a2_top_values", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5", ("events",))
both("a3_sum_by_key", f"WITH {CARDS} SELECT author, sum(likes) AS likes FROM cards GROUP BY author ORDER BY likes DESC, author LIMIT 10", DOCS)
both("a4_daily_ratio", "SELECT CAST(ts AS DATE) AS d, round(count(CASE WHEN event_type = 'click' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM events GROUP BY 1", ("events",))
both("a5_joined_ids", f"WITH {LONG} SELECT table_id, $JOIN(array_sort(array_agg(DISTINCT CAST(model_id AS $STR))), '; ') AS models FROM links GROUP BY table_id", LINKED)
both("a6_query_candidates", "SELECT c_nationkey AS query, $JOIN(array_sort(array_agg(DISTINCT c_mktsegment)), ',') AS candidates FROM customer GROUP BY c_nationkey", ("customer",))
both("a7_list_union", f"""WITH {LONG}, m AS (SELECT model_id % 100 AS g, array_agg(DISTINCT table_id) AS l FROM links GROUP BY model_id) SELECT g, $JOIN(array_sort($DISTINCTLIST($FLAT(array_agg(l)))), ',') AS ids FROM m GROUP BY g""", LINKED)
both("a8_group_texts", """SELECT source, $JOIN(array_agg_ordered, '|') AS texts, best FROM (SELECT source, array_sort(array_agg(concat(lang, ':', text))) AS array_agg_ordered, min_by(doc_id, n_chars * 1000000 + doc_id) AS best FROM documents WHERE text IS NOT NULL GROUP BY source)""", DOCS)
both("a9_arg_max", f"WITH {CARDS} SELECT author, max_by(model_id, likes * 1000000 + model_id) AS model_id, max(likes) AS likes FROM cards GROUP BY author", DOCS)
both("a10_first_appearance", f"WITH {LONG} SELECT table_id, min(created) AS first_seen FROM links GROUP BY table_id", LINKED)
both("a11_canonical", f"""WITH {LONG}, t AS (SELECT *, $SHA(CAST(table_id % 500 AS $STR)) AS hash FROM links) SELECT hash, min(priority * 10000000000 + model_id * 100 + ord) AS canonical, count(*) AS n FROM t GROUP BY hash""", LINKED)
both("a12_dup_matrix", f"""WITH {LONG}, s AS (SELECT DISTINCT table_id % 3000 AS hash, source FROM links), c AS (SELECT table_id % 3000 AS hash, source, count(*) AS n FROM links GROUP BY 1, 2)
  SELECT a.source AS a, b.source AS b, count(*) AS n FROM s a JOIN s b ON a.hash = b.hash AND a.source <> b.source GROUP BY 1, 2 UNION ALL SELECT source, source, count(CASE WHEN n > 1 THEN 1 END) FROM c GROUP BY source""", LINKED)
both("a13_contribution", f"WITH {LISTS} SELECT count(CASE WHEN hugging > 0 THEN 1 END) AS hugging, count(CASE WHEN github > 0 THEN 1 END) AS github, count(CASE WHEN html > 0 THEN 1 END) AS html, count(CASE WHEN llm > 0 THEN 1 END) AS llm FROM lists", LINKED)
both("a14_duplication_histogram", "SELECT n, count(*) AS n_contents, min(example) AS example FROM (SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS example FROM documents GROUP BY 1) WHERE n > 1 GROUP BY n", DOCS)
both("a16_size_metrics", f"""WITH {LONG}, t AS (SELECT source, table_id, count(*) AS n_rows, count(DISTINCT model_id) AS n_cols FROM links GROUP BY 1, 2), g AS (SELECT source, 'dup' AS stage, n_rows, n_cols FROM t UNION ALL SELECT source, 'dedup', n_rows, n_cols FROM t WHERE table_id % 7 <> 0 UNION ALL SELECT source, 'valid', n_rows, n_cols FROM t WHERE table_id % 3 = 0)
  SELECT source, stage, count(*) AS n_tables, CAST(sum(n_cols) AS BIGINT) AS n_cols, round(avg(n_rows), 6) AS avg_rows FROM g GROUP BY 1, 2""", LINKED)
both("a17_intent_counts", """SELECT event_type AS intent, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS n_influential FROM events GROUP BY 1""", ("events",))
both("a18_key_stats", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, count(*) - count(DISTINCT o_custkey) AS n_dups FROM orders", ("orders",))
both("a20_suffix_distribution", """WITH n AS (SELECT concat(CAST(p_partkey AS $STR), CASE p_partkey % 4 WHEN 0 THEN '_s' WHEN 1 THEN '_t' WHEN 2 THEN '_s_t' ELSE '' END) AS name FROM part)
  SELECT CASE WHEN name LIKE '%\\_s\\_t' ESCAPE '\\' THEN 's_t' ELSE 'x' END AS suffix, count(*) AS n FROM n GROUP BY 1""".replace("name LIKE '%\\_s\\_t' ESCAPE '\\' THEN 's_t'", "$LIKE(name, '_s_t$') THEN 's_t' WHEN $LIKE(name, '_s$') THEN 's' WHEN $LIKE(name, '_t$') THEN 't'"), ("part",))
both("a21_degree_stats", """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey), s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d AS (SELECT src, count(*) AS deg FROM s GROUP BY src)
  SELECT CAST(sum(deg) AS BIGINT) AS nnz, count(*) AS n_rows, max(deg) AS top, min(deg) AS low, round(avg(deg), 6) AS mean, round(sum(deg) / (CAST(count(*) AS DOUBLE) * count(*)), 9) AS density FROM d""", ("lineitem",))
both("a23_content_hash", "SELECT doc_id, $SHA(text) AS sha, md5(text) AS md5 FROM documents", DOCS)
both("a24_card_stats", f"SELECT count(*) AS n, count(o_orderdate) AS n_dates, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders", ("orders",))
both("a25_score_summary", "SELECT count(*) AS n, round(max(value), 6) AS top, round(avg(value), 6) AS mean FROM events WHERE value > 0", ("events",))
both("a26_percentiles", "SELECT event_type, round($PERCENTILE(value, 0.25), 6) AS q1, round($PERCENTILE(value, 0.5), 6) AS q2, round($PERCENTILE(value, 0.75), 6) AS q3 FROM events GROUP BY 1", ("events",))
both("a26b_histogram", "SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1", ("events",))
both("a27_majority", """WITH v AS (SELECT user_id, event_type AS vote, count(*) AS n, min(event_id) AS seen FROM events GROUP BY 1, 2) SELECT user_id, vote, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS r FROM v) WHERE r = 1""", ("events",))

# -- windows
both("w2_cumulative", "SELECT d, CAST(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)", ("events",))
both("w3_latest_version", "SELECT pure, version FROM (SELECT l_orderkey AS pure, l_linenumber AS version, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS r FROM lineitem) WHERE r = 1", ("lineitem",))
both("w4_occurrence", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS occ FROM orders", ("orders",))
both("w5_keep_first_last", "SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders) WHERE a = 1 OR z = 1 GROUP BY o_custkey", ("orders",))
both("w6_renumber", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem WHERE l_quantity > 25", ("lineitem",))
both("w7_order_in_directory", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS $STR)) - 1 AS ord FROM documents", DOCS)
both("w10_carry_forward", """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
  ca AS (SELECT d, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) AS t FROM a), cb AS (SELECT d, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) AS t FROM b), m AS (SELECT coalesce(ca.d, cb.d) AS d, ca.t AS ta, cb.t AS tb FROM ca FULL OUTER JOIN cb ON ca.d = cb.d)
  SELECT d, coalesce(max(ta) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS n_tables, coalesce(max(tb) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS n_models FROM m""", ("orders",))

# -- top-k
both("l1_order_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20", DOCS)
both("l2_top_per_query", "SELECT l_suppkey, l_partkey, r FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS r FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE r <= 5", ("lineitem",))
both("l3_top_per_year", "SELECT y, o_custkey, n FROM (SELECT y, o_custkey, n, row_number() OVER (PARTITION BY y ORDER BY n DESC, o_custkey) AS r FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r <= 3", ("orders",))
both("l4_head_of_table", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 3", ("lineitem",))
both("l5_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(concat('42-', CAST(doc_id AS $STR))), doc_id LIMIT 50", DOCS)

# -- sets
both("u1_union_all", f"WITH {LONG} SELECT model_id, table_id FROM links WHERE source = 'hugging' UNION ALL SELECT model_id, table_id FROM links WHERE source = 'github' UNION ALL SELECT model_id, table_id FROM links WHERE source = 'html' UNION ALL SELECT model_id, table_id FROM links WHERE source = 'llm'", LINKED)
both("u2_distinct_union", f"WITH {LONG} SELECT DISTINCT 'hugging' AS source, table_id FROM links WHERE source = 'hugging' UNION ALL SELECT DISTINCT 'html', table_id FROM links WHERE source = 'html'", LINKED)
both("u3_node_set", "SELECT l_suppkey AS node FROM lineitem UNION SELECT l_partkey FROM lineitem", ("lineitem",))
both("u4_common_columns", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier", ("customer", "supplier"))
both("u5_intersect_except", "SELECT 'both' AS side, id FROM (SELECT l_partkey AS id FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT 'first', id FROM (SELECT l_partkey AS id FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)", ("lineitem",))
both("u6_graph_union", "SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2) WHERE a <> b", ("lineitem",))
both("u7_concat_augmented", "SELECT concat(CAST(doc_id AS $STR), '_t') AS id, lang FROM documents UNION ALL SELECT concat(CAST(doc_id AS $STR), '_s'), lang FROM documents UNION ALL SELECT CAST(doc_id AS $STR), lang FROM documents", DOCS)

# -- dates, arithmetic, arrays, JSON
both("d1_dates", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, count(*) AS n FROM orders GROUP BY 1", ("orders",))
both("m1_rounding", "SELECT l_returnflag, round(count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM lineitem), 2) AS pct FROM lineitem GROUP BY 1", ("lineitem",))
both("m4_linear_fit", "SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM (SELECT CAST(row_number() OVER (ORDER BY d) AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1))", ("events",))
both("r1_unnest", f"WITH {LONG}, m AS (SELECT model_id, array_agg(table_id) AS l FROM links GROUP BY 1) SELECT model_id, $UNNEST(l) AS table_id FROM m", LINKED)
both("r3_concat_flatten", f"WITH {LONG}, m AS (SELECT model_id, array_agg(table_id) AS a, array_agg(ord) AS b FROM links GROUP BY 1) SELECT model_id, $LEN($FLAT($ARRAY(a, b))) AS n FROM m", LINKED)
both("r4_list_distinct", f"WITH {LONG}, m AS (SELECT model_id, array_agg(table_id % 5) AS a FROM links GROUP BY 1) SELECT model_id, $JOIN(array_sort($DISTINCTLIST(a)), ',') AS a FROM m", LINKED)
both("r5_list_contains", f"WITH {LONG}, m AS (SELECT model_id, array_agg(table_id % 50) AS a FROM links GROUP BY 1) SELECT model_id, array_contains(a, 3) AS has FROM m", LINKED)
both("n3_json_field", "SELECT event_id, CAST($JSON(props, '$.k') AS BIGINT) AS k FROM events", ("events",))
