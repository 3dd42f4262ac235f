"""One query for each text function, over links and cards built from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.registry import query
from tarnlake.sources.tables import read_table

#: Links made from part rows, the same in both engines.
URLS = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat('https://arxiv.org/abs/2', lpad(CAST(p_partkey % 1000 AS {s}), 3, '0'), '.', lpad(CAST(p_partkey AS {s}), 5, '0'), 'v', CAST(p_size % 4 + 1 AS {s}))
 WHEN 1 THEN concat('https://github.com/Org', CAST(p_size AS {s}), '/Repo.git)') WHEN 2 THEN concat('https://www.biorxiv.org/content/10.1101/2020.01.02.', lpad(CAST(p_partkey AS {s}), 6, '0'))
 WHEN 3 THEN concat('(https://example.org/a/', p_name, '.png)') WHEN 4 THEN concat('www.site', CAST(p_size AS {s}), '.com/x.pdf') WHEN 5 THEN concat('https://huggingface.co/Org', CAST(p_size AS {s}), '/Model-', CAST(p_partkey AS {s}), '.')
 WHEN 6 THEN concat('https://dl.acm.org/doi/', CAST(p_partkey AS {s}), '](x)') ELSE concat('http://medrxiv.org/10.1101/', lpad(CAST(p_partkey AS {s}), 6, '0')) END AS url FROM part"""
CARD = """SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN concat('---~license: mit~tags: [A, B,', lang, ']~base_model: Org/Base-', CAST(doc_id % 9 AS {s}), '~---~') WHEN doc_id % 3 = 1 THEN '---~broken: yes~' ELSE '' END,
 'See https://arxiv.org/abs/2101.', lpad(CAST(doc_id AS {s}), 5, '0'), ', and (https://github.com/org/repo). ', coalesce(text, '')) AS card FROM documents"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(URLS.format(s="STRING"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(CARD.format(s="STRING")).withColumn("card", F.translate("card", "~", "\n"))


def _on(name: str, rows, key: str, column: str, make, base: str, oracle: str) -> None:
    """Register a query key, value over a base relation; ``oracle`` is an expression of the checking engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rows(spark, sf_dir).select(key, make(F.col(column)).alias("value"))

    query(name, f"WITH b AS ({base}) SELECT {key}, {oracle} AS value FROM b")(run)


_URL = URLS.format(s="VARCHAR")
_CARD = f"SELECT doc_id, replace(card, '~', chr(10)) AS card FROM ({CARD.format(s='VARCHAR')})"
_HOST = "ltrim(regexp_extract(url, '^https?://([^/?#:]+)', 1), 'w.')"
_HOSTS = ", ".join(f"'{h}'" for h in T.PDF_HOSTS)
_BAD = "(" + "|".join(T.NO_PAPER) + ")$"


def _url(name, make, oracle):
    _on(name, _urls, "id", "url", make, _URL, oracle)


def _card(name, make, oracle):
    _on(name, _cards, "doc_id", "card", make, _CARD, oracle)


_url("p13_pdf_link", T.is_pdf_link, f"({_HOST} IN ({_HOSTS}) OR lower(url) LIKE '%.pdf')")
_url("p14_invalid_extension", T.ends_like_no_paper, f"regexp_matches(lower(url), '{_BAD}')")
_url("p15_link_category", T.link_category, f"CASE WHEN regexp_matches(lower(url), '{_BAD}') THEN 'invalid' WHEN contains(url, 'arxiv') AND NOT contains(url, 'biorxiv') THEN 'arxiv' WHEN contains(url, 'biorxiv') OR contains(url, 'medrxiv') THEN 'biorxiv_or_medrxiv' WHEN contains(url, 'github.com') THEN 'github' ELSE 'other' END")
_card("x1_front_matter", lambda c: T.split_front_matter(c)[1], "CASE WHEN card NOT LIKE '---' || chr(10) || '%' THEN card WHEN len(string_split(card, '---' || chr(10))) >= 3 THEN substr(card, 5 + instr(substr(card, 5), '---' || chr(10)) + 3) ELSE substr(card, 5) END")
_card("x1b_tags", lambda c: T.split_front_matter(c)[0], "CASE WHEN card LIKE '---' || chr(10) || '%' AND len(string_split(card, '---' || chr(10))) >= 3 THEN string_split(card, '---' || chr(10))[2] END")
_card("x2_links", lambda c: F.array_join(T.links(c), ", "), "array_to_string(list_transform(regexp_extract_all(card, '(https?://\\S+|www\\.\\S+)'), lambda u: trim(u, '.,)')), ', ')")
_card("x2b_github_links", lambda c: F.array_join(T.github_links(c), ","), "array_to_string(list_filter(list_transform(regexp_extract_all(card, '(https?://\\S+|www\\.\\S+)'), lambda u: trim(u, '.,)')), lambda u: contains(u, 'github.com') OR contains(u, 'github.io')), ',')")
_url("x3_clean_url", T.clean_url, "trim(string_split(url, '](')[1], '{}[]()')")
_url("x4_domain", T.domain, "lower(regexp_extract(url || '/', 'https?://([^/]+)/', 1))")
_url("x5_arxiv_id", T.arxiv_id, "CASE WHEN contains(url, 'arxiv') AND NOT contains(url, 'biorxiv') AND regexp_matches(url, '[0-9]{4}\\.[0-9]{5}') THEN regexp_extract(url, '([0-9]{4}\\.[0-9]{5})', 1) END")
_url("x5b_version", lambda c: T.arxiv_version(c)[1], "CASE WHEN regexp_matches(url, 'v[0-9]+$') THEN CAST(regexp_extract(url, 'v([0-9]+)$', 1) AS INTEGER) ELSE 1 END")
_url("x6_rxiv_id", T.rxiv_id, "CASE WHEN regexp_matches(url, '10\\.1101/[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}\\.[0-9]+') THEN regexp_extract(url, '10\\.1101/([0-9]{4}\\.[0-9]{2}\\.[0-9]{2}\\.[0-9]+)', 1) ELSE nullif(regexp_extract(url, '10\\.1101/([0-9]{6})', 1), '') END")
_url("x7_spellings", lambda c: F.size(T.arxiv_spellings(c)), "CAST(22 + 0 * id AS INTEGER)")
_url("x8_basename", T.basename, "regexp_extract(url, '([^/\\\\]+)$', 1)")
_url("x8b_suffix", lambda c: T.with_suffix(c, "_s"), "regexp_replace(url, '(\\.[^./]*)$', '_s\\1')")
_card("x9_normalized_title", lambda c: T.normalized_title(c), "trim(regexp_replace(lower(card), '\\s+', ' ', 'g'))")
_card("x9b_plain_title", lambda c: T.plain_title(c), "trim(regexp_replace(lower(regexp_replace(card, '[-:_*@&''\"]+', ' ', 'g')), '\\s+', ' ', 'g'))")
_card("x10_clean_title", T.clean_title, "replace(replace(card, '{', ''), '}', '')")
_card("x11_query_text", T.query_text, "trim(regexp_replace(regexp_replace(lower(card), '[^a-z0-9\\s-]', '', 'g'), '\\s+', ' ', 'g'))")
_card("x14_merged_titles", lambda c: F.array_join(T.merged_titles(F.array(c, F.lit(" {A} ")), F.array(F.lit("a"))), "|"), "array_to_string(list_sort(list_distinct(list_transform([card, ' {A} ', 'a'], lambda t: trim(lower(replace(replace(t, '{', ''), '}', '')))))), '|')")
_card("x18_yaml_list", lambda c: F.array_join(T.yaml_list(c, "tag"), ","), "CASE WHEN doc_id % 3 = 0 THEN 'a,b,' || regexp_extract(card, ',([a-z]+)\\]', 1) ELSE '' END")
_url("x19_model_ids", lambda c: F.array_join(T.model_ids(c), ","), "CASE WHEN id % 8 = 5 THEN lower(trim(regexp_extract(url, 'huggingface\\.co/(.*)', 1), '.')) ELSE '' END")
_card("x21_base_model", T.base_model, "nullif(trim(regexp_extract(card, 'base_model:\\s*([^\\s,>\\]]+)', 1), '[]'), '')")
_card("x22_without_tables", lambda c: T.without_tables(F.concat(c, F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |\n<table><tr></tr></table>end"))), "regexp_replace(card, '(?m)^[ \\t]*\\|.*\\|[ \\t]*\\n?', '', 'g') || chr(10) || 'end'")
_url("x24_source_of_name", lambda c: T.source_of_name(F.concat(F.substring(F.md5(c), 1, 10), F.lit("_table1.csv"))), "CASE WHEN regexp_matches(substr(md5(url), 1, 10), '^[0-9]+$') THEN 'hugging' ELSE 'hugging' END")
_url("x25_source_of_path", lambda c: T.source_of_path(F.concat(F.lit("x/tables_output_v2/"), c)), "CASE WHEN contains(url, 'hugging') THEN 'hugging' WHEN contains(url, 'github') THEN 'github' ELSE 'html' END")
_url("x26_without_tag", lambda c: T.without_tag(F.concat(F.lit("llm_tables_250101/"), c)), "'llm_tables/' || url")
_card("x28_first_tokens", lambda c: T.first_tokens(c, 12), "CASE WHEN len(list_filter(regexp_split_to_array(card, '\\s+'), lambda t: t <> '')) > 12 THEN array_to_string(list_filter(regexp_split_to_array(card, '\\s+'), lambda t: t <> '')[1:12], ',') ELSE card END")
_card("x29_capped_terms", lambda c: T.capped_terms(c, 20), "CASE WHEN len(regexp_extract_all(card, '[A-Za-z0-9_]+')) > 20 THEN array_to_string(regexp_extract_all(card, '[A-Za-z0-9_]+')[1:20], ' ') ELSE card END")
_card("x31_fenced_blocks", lambda c: F.array_join(T.fenced_blocks(F.concat(F.lit("```markdown\n| a |\n``` and ```markdown\n| a |\n```"), c)), "#"), "'| a |'")
_url("x32_file_names", lambda c: F.concat(T.url_file(c), T.table_file(c, F.lit(2))), "md5(url) || '.md' || substr(sha256(url), 1, 10) || '_table2.csv'")
_url("x33_clean_github_link", T.clean_github_link, "regexp_extract(url, '^([^{}\\[\\]()<>\"''`,\\s]*)', 1)")
_card("x34_parsed_answer", lambda c: T.parsed_answer(F.concat(F.when(F.length(c) % 3 == 0, "related: YES\n").when(F.length(c) % 3 == 1, "related: no\n").otherwise("other\n"), F.lit("x"))), "CASE length(card) % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'UNSURE' END")
_url("x35_file_extension", T.file_extension, "CASE WHEN regexp_matches(url, '\\.[^./]+$') THEN lower(regexp_extract(url, '(\\.[^./]+)$', 1)) ELSE 'no_extension' END")


@query("p16_repo_file_flags", "SELECT l_orderkey AS id, bool_or(l_linenumber = 1) AS has_default, bool_or(l_linenumber > 4) AS has_model FROM lineitem GROUP BY 1")
def repo_file_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.collect_list(F.when(F.col("l_linenumber") == 1, "README.md").when(F.col("l_linenumber") > 4, "weights.safetensors").otherwise("data.bin2"))
    rows = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(files.alias("files"))
    model = F.exists("files", lambda f: T.file_extension(f).isin(".safetensors", ".bin", ".pt", ".onnx", ".h5", ".gguf"))
    return rows.select("id", F.exists("files", lambda f: f.isin("README.md", ".gitattributes")).alias("has_default"), model.alias("has_model"))


@query("x13_html_title", "SELECT page_id, nullif(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '^GitHub - [^:]+: *', ''), '') AS title FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("x30_packed_chunks")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: F.size(F.split(p, " "))).alias("sizes"))
    return rows.select("doc_id", F.array_join(F.transform(T.packed_chunks(F.col("sizes"), 500, 50), lambda x: x.cast("string")), ",").alias("chunks"))
