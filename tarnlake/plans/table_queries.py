"""Queries over tables built from orders and over tables taken out of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import tables as T
from tarnlake.operators import extract as X
from tarnlake.registry import query
from tarnlake.sources.tables import read_table


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order: header [part, qty], a row a line, separators and blanks among them."""
    lines = read_table(spark, sf_dir, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_quantity", F.array(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") == 2, " ").otherwise(F.col("l_quantity").cast("int").cast("string"))).alias("cells"))
    rows = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("rows"))
    return rows.select(F.col("l_orderkey").alias("id"), F.array(F.lit("part"), F.lit("qty")).alias("header"), F.concat(F.array(F.array(F.lit("---"), F.lit(":-:")), F.array(F.lit(""), F.lit(" "))), F.col("rows")).alias("rows"))


#: The same rows, one a line: id, position from 1, two cells.
CELLS = """SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, CAST(l_partkey AS VARCHAR) AS a, CASE WHEN l_linenumber = 2 THEN ' ' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS b FROM lineitem"""


def _text(rows):
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, ",")), ";")


def _register(name: str, make, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return order_tables(spark, sf_dir).select("id", make(F.col("header"), F.col("rows")).alias("value"))

    query(name, f"WITH c AS ({CELLS}) SELECT id, {oracle} AS value FROM c GROUP BY id")(run)


_register("t6_without_separators", lambda h, r: _text(T.without_separators(r)), "string_agg(a || ',' || b, ';' ORDER BY i)")
_register("t7_cleaned", lambda h, r: _text(T.cleaned(r)), "'---,:-:;' || string_agg(a || ',' || trim(b), ';' ORDER BY i)")
_register("t11_transposed", lambda h, r: _text(T.transposed(h, T.without_separators(r))), "'part,' || string_agg(a, ',' ORDER BY i) || ';qty,' || string_agg(b, ',' ORDER BY i)")
_register("t12_named_cells", lambda h, r: _text(T.named_cells(h, T.without_separators(r))), "string_agg('part-' || a || ',qty-' || b, ';' ORDER BY i)")
_register("t13_named_transposed", lambda h, r: _text(T.named_cells_transposed(h, T.without_separators(r))), "'part,' || string_agg('part-' || a, ',' ORDER BY i) || ';qty,' || string_agg('qty-' || b, ',' ORDER BY i)")
_register("t14_row_count", lambda h, r: T.row_count(r).cast("long"), "count(*) + 2")
_register("t5_drop_index_rows", lambda h, r: F.size(T.drop_index_rows(F.concat(F.array(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("0"), F.lit("1"), F.lit("2"))), F.transform(T.without_separators(r), lambda x: F.concat(x, F.array(F.lit("z"))))))).cast("long"), "count(*) + 1")
_register("t16_joined_labels", lambda h, r: T.joined_labels(F.array_join(T.without_separators(r)[0], ",")), "max(CASE WHEN i = 1 THEN a || '; ' || trim(b) END)")
_register("x27_table_to_text", lambda h, r: T.to_text(h, T.without_separators(r)), "'part,qty,' || string_agg(a || ',' || b, ',' ORDER BY i)")
_register("t10_qc_status", lambda h, r: T.qc_status(h, r, F.lit(False)), "CASE WHEN count(*) = 1 THEN 'one_row' ELSE 'valid' END")


@query("t9_signature", "SELECT p_partkey AS id, p_name || '|' || p_brand || '||' || '1|2' AS value FROM part")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("|"), F.lit("  "), F.col("p_name"), F.lit("  | "), F.col("p_brand"), F.lit("|\n|---|:-:|\n| 1 |   2 |"))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.regexp_replace(T.signature(md), r"^\||\|$", ""), r"\|\|\|\|", "||").alias("value"))


@query("t1_extracted_tables")
def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.renumbered(X.extract_tables(read_table(spark, sf_dir, "documents"))).select("hash", "k", F.size("header").alias("n_cols"), F.size("rows").alias("n_rows"))


@query("t2_html_tables", "SELECT page_id, 3 AS n_rows, 'h,h|a,b|a,c' AS cells FROM pages")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat("html", F.lit("<table><tr><th colspan=2>h</th></tr><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>"), F.lit("<!-- "), F.col("page_id").cast("string"), F.lit(" -->"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", html.alias("text"))
    found = X.extract_tables(pages)
    cells = F.array_join(F.transform(F.concat(F.array("header"), "rows"), lambda r: F.array_join(r, ",")), "|")
    return pages.select("page_id", F.sha2("text", 256).alias("hash")).join(found.filter("k = 1"), "hash").select("page_id", (F.size("rows") + 1).alias("n_rows"), cells.alias("cells"))


@query("t3_paper_tables", "SELECT page_id, 1 AS n_tables FROM pages")
def paper_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<figure class="ltx_table"><figcaption>Table 1</figcaption><table><tr><td>'), F.col("page_id").cast("string"), F.lit("</td><td><math alttext='x'></math></td></tr><tr><td>1</td></tr></table></figure>"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", html.alias("text"))
    found = X.extract_tables(pages, "arxiv").groupBy("hash").agg(F.count(F.lit(1)).cast("int").alias("n_tables"))
    return pages.select("page_id", F.sha2("text", 256).alias("hash")).join(found, "hash").select("page_id", "n_tables")


@query("t4_page_type", """SELECT page_id, CASE WHEN len(regexp_extract_all(lower(html), '<meta[^>]+name="citation_[a-z_]+"')) >= 3 THEN 'metadata' WHEN len(regexp_extract_all(lower(html), '<(?:section|article)\\b')) >= 2
 OR (contains(lower(html), 'introduction') AND contains(lower(html), 'conclusion')) THEN 'fulltext' ELSE 'metadata' END AS page_type FROM pages""")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", X.page_type(F.col("html")).alias("page_type"))


@query("t8_markdown_tables", "SELECT p_partkey AS id, 2 AS n_cols, p_brand AS cell FROM part")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("text\n\n| Name | **Brand** |\n| --- | :-: |\n| `x"), F.col("p_partkey").cast("string"), F.lit("` | *"), F.col("p_brand"), F.lit("* |\n\nmore"))
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", md.alias("text"))
    found = X.extract_tables(parts)
    return parts.select("id", F.sha2("text", 256).alias("hash")).join(found, "hash").select("id", F.size("header").alias("n_cols"), F.col("rows")[0][1].alias("cell"))


@query("x12_readme_title", "SELECT doc_id, 'Title ' || doc_id AS title FROM documents")
def readme_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Repository files navigation\n\n[link]\n# Title "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return X.mapped(docs, X.readme_title, "title", "string")


@query("x15_bibtex_blocks", "SELECT doc_id, 1 AS n FROM documents")
def bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see\n@article{k,\n title = {A {B} c},\n year=2020\n}\nend "), F.translate(F.coalesce("text", F.lit("")), "{}@", "")).alias("text"))
    return X.mapped(docs, lambda t: len(X.bibtex_blocks(t)), "n", "int")


@query("x16_parsed_bibtex", "SELECT doc_id, 'article' AS entry_type, 'T' || doc_id AS title, '2020' AS year, 1::BIGINT AS successful FROM documents")
def bibtex_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('@article{k, title = "T'), F.col("doc_id").cast("string"), F.lit('",\n year = 2020,\n note = {'), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "), F.lit("} }")).alias("text"))
    return X.parsed_bibtex(docs).select("doc_id", F.col("bibtex")[0]["entry_type"].alias("entry_type"), F.col("bibtex")[0]["title"].alias("title"), F.col("bibtex")[0]["year"].alias("year"), "successful")


@query("x17_yaml_tags", "SELECT doc_id, 'mit' AS license, 'a, b' AS tags FROM documents")
def yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("license: mit\ntags:\n- a\n- b\nsummary: about "), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "), F.lit("\n")).alias("tags"))
    return X.tag_columns(X.front_matter_tags(docs), ["license", "tags"]).select("doc_id", F.col("tags_license").alias("license"), F.col("tags_tags").alias("tags"))


@query("x23_table_context", "SELECT doc_id, CAST(1 + len(list_filter(regexp_split_to_array(coalesce(text, ''), '\n\\s*\n'), lambda p: regexp_matches(trim(p), '^(?i)(table|tab\\.)\\s*[0-9ivx]+\\s*[:.]'))) AS INTEGER) AS n_captions FROM documents")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\nTable 1: scores\n\nAs the table shows.\n\n| a | b |\n")).alias("text"))
    return X.mapped(docs, lambda t: len(X.table_context(t)["captions"]), "n_captions", "int")


@query("t1b_github_tables", "SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN octet_length(encode(coalesce(text, ''))) > 20000 THEN NULL WHEN contains(coalesce(text, ''), '|') THEN -1 ELSE 0 END AS n FROM documents")
def github(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of over 20,000 bytes are recorded as null; texts with bars have as many tables as they may, shown as -1."""
    files = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    found = X.github_tables(files, most_bytes=20_000).join(files, "name")
    return found.select("name", F.when(F.col("tables").isNull(), None).when(F.col("text").contains("|"), F.lit(-1)).otherwise(F.size("tables")).alias("n"))
