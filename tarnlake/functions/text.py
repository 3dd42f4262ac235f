"""Text functions over columns: front matter, links, titles, ids, sources.

All are built-in expressions and stay inside the JVM. Words of a pattern are ASCII on purpose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of papers.
PDF_HOSTS = (
    "arxiv.org", "biorxiv.org", "medrxiv.org", "dl.acm.org", "dblp.uni-trier.de", "scholar.google.com", "pubmed.ncbi.nlm.nih.gov", "frontiersin.org",
    "mdpi.com", "cvpr.thecvf.com", "nips.cc", "icml.cc", "ijcai.org", "webofscience.com", "journals.plos.org", "nature.com",
    "semanticscholar.org", "chemrxiv.org", "link.springer.com", "ieeexplore.ieee.org", "aaai.org", "openaccess.thecvf.com",
)
# Endings of links that are no papers.
NO_PAPER = (
    "png", "jpg", "jpeg", "gif", "zip", "rar", "7z", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "mp4", "mp3", "md", "pth", "pt", "ckpt",
    "safetensors", "json", "py", "ipynb", "csv", "tsv", "bin", "h5", "onnx", "pkl", "tar", "gz", "mov",
)
# Fixed value: what counts as a link.
LINK = r"(https?://\S+|www\.\S+)"


def either(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n|\r", "\n")


def split_front_matter(card: Column) -> tuple[Column, Column]:
    """(tags, readme): what stands between the first two ``---`` lines of a card that begins with one, and the rest."""
    text = unix_lines(card)
    parts = F.split(text, "---\n", 3)
    opened = text.startswith("---\n")
    tags = F.when(opened & (F.size(parts) == 3), F.get(parts, F.lit(1)))
    readme = F.when(~opened, text).when(F.size(parts) == 3, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return tags, readme


def links(text: Column) -> Column:
    """All links of a text, trimmed of the punctuation around them."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda u: F.btrim(u, F.lit(".,)")))


def github_links(text: Column) -> Column:
    return F.filter(links(text), lambda u: u.contains("github.com") | u.contains("github.io"))


def pdf_links(text: Column) -> Column:
    return F.filter(links(text), is_pdf_link)


def is_pdf_link(url: Column) -> Column:
    """On a paper host, its name freed of the leading characters ``w`` and ``.``, or ending in .pdf."""
    host = F.ltrim(F.coalesce(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1), F.lit("")), F.lit("w."))
    return host.isin(*PDF_HOSTS) | F.lower(url).endswith(".pdf")


def ends_like_no_paper(url: Column) -> Column:
    """Ends in one of the endings, a dot before it or not."""
    return F.lower(url).rlike("(" + "|".join(NO_PAPER) + ")$")


def link_category(url: Column) -> Column:
    u = F.lower(url)
    return F.when(ends_like_no_paper(url), "invalid").when(u.contains("arxiv") & ~u.contains("biorxiv"), "arxiv").when(u.contains("biorxiv") | u.contains("medrxiv"), "biorxiv_or_medrxiv").when(u.contains("github.com"), "github").otherwise("other")


def clean_url(url: Column) -> Column:
    return F.btrim(F.split_part(url, F.lit("]("), F.lit(1)), F.lit("{}[]()"))


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.concat(url, F.lit("/")), r"https?://([^/]+)/", 1))


def arxiv_id(text: Column) -> Column:
    """The id in a link that names arXiv, null if there is none."""
    found = F.regexp_extract(text, r"([0-9]{4}\.[0-9]{5})", 1)
    return F.when(F.lower(text).contains("arxiv") & ~F.lower(text).contains("biorxiv") & (found != ""), found)


def arxiv_version(ident: Column) -> tuple[Column, Column]:
    """(pure id, version); the version is 1 where none is named."""
    version = F.regexp_extract(ident, r"v([0-9]+)$", 1)
    return F.regexp_replace(ident, r"v[0-9]+$", ""), F.when(version == "", 1).otherwise(version.try_cast("int")).cast("int")


def rxiv_id(url: Column) -> Column:
    """The dated id of a bioRxiv or medRxiv link, else its older six-digit one."""
    dated, old = F.regexp_extract(url, r"10\.1101/([0-9]{4}\.[0-9]{2}\.[0-9]{2}\.[0-9]+)", 1), F.regexp_extract(url, r"10\.1101/([0-9]{6})", 1)
    return F.nullif(F.when(dated != "", dated).otherwise(old), F.lit(""))


def arxiv_spellings(ident: Column) -> Column:
    """The 22 links, DOIs and bare forms under which an id is met, with its version and without."""
    forms = [(f"{scheme}arxiv.org/{kind}/", ".pdf" if kind == "pdf" else "") for scheme in ("https://", "") for kind in ("abs", "pdf", "html")]
    forms += [(start, "") for start in ("arxiv:", "", "10.48550/arXiv.", "https://doi.org/10.48550/arXiv.", "doi.org/10.48550/arXiv.")]
    return F.array(*[F.concat(F.lit(a), x, F.lit(z)) for x in (ident, arxiv_version(ident)[0]) for a, z in forms])


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    return F.regexp_replace(path, r"(\.[^./]*)$", f"{suffix}$1")


def without_suffix(path: Column) -> Column:
    """The name without the suffixes of its augmented forms."""
    return F.regexp_replace(path, r"(_s_t|_s|_t)(\.[^./]*)?$", "$2")


def normalized_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def plain_title(title: Column) -> Column:
    return normalized_title(F.regexp_replace(title, r"[-:_*@&'\"]+", " "))


def clean_title(title: Column) -> Column:
    return F.translate(title, "{}", "")


def query_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", ""), r"\s+", " "))


def html_title(html: Column) -> Column:
    """The title element, freed of the prefix that repository pages have."""
    found = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.nullif(F.regexp_replace(found, r"^GitHub - [^:]+: *", ""), F.lit(""))


def merged_titles(*lists: Column) -> Column:
    all_ = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
    return F.array_sort(F.array_distinct(F.transform(all_, lambda t: F.trim(F.lower(clean_title(t))))))


def yaml_list(text: Column, key: str) -> Column:
    """The entries of the last inline list ``key: [a, b]`` or ``key: a``, lower-cased."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"^{key}s?:"))
    value = F.btrim(F.regexp_replace(F.element_at(lines, -1), f"^{key}s?:", ""), F.lit(" []"))
    entries = F.filter(F.split(F.lower(value), r"[,\s]+"), lambda x: (x != "") & ~x.startswith("arxiv:") & ~x.startswith("base_model"))
    return F.when(F.size(lines) > 0, F.transform(entries, lambda x: F.btrim(x, F.lit("'\"")))).otherwise(F.array().cast("array<string>"))


def model_ids(text: Column) -> Column:
    """Candidate ids ``org/name`` of hub links, query parameters and bare names, lower-cased and distinct."""
    part = r"[A-Za-z0-9][A-Za-z0-9._-]*"
    hub = F.regexp_extract_all(text, F.lit(rf"huggingface\.co/({part}/{part})"), F.lit(1))
    asked = F.regexp_extract_all(text, F.lit(rf"[?&](?:model|search)=({part}/{part})"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(rf"(?:^|[\s(\"'`])([A-Za-z0-9][A-Za-z0-9_-]*/{part})(?=$|[\s)\"'`,.;])"), F.lit(1))
    found = F.filter(F.concat(hub, asked, bare), lambda x: ~x.startswith("datasets/"))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.rtrim(x, F.lit(".,;:)")))))


def dataset_ids(text: Column) -> Column:
    part = r"[A-Za-z0-9][A-Za-z0-9._-]*"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"huggingface\.co/datasets/({part}/{part})"), F.lit(1)), lambda x: F.lower(F.rtrim(x, F.lit(".,;:)")))))


def base_model(text: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_extract(text, r"base_model:\s*([^\s,>\]]+)", 1), F.lit("[]'\"")), F.lit(""))


def without_tables(text: Column) -> Column:
    """The text without Markdown, HTML and LaTeX tables."""
    text = F.regexp_replace(text, r"(?is)<table.*?</table>", "")
    text = F.regexp_replace(text, r"(?s)\\begin\{tabular\}.*?\\end\{tabular\}", "")
    return F.regexp_replace(text, r"(?m)^[^\S\n]*\|.*\|[^\S\n]*\n?", "")


def source_of_name(name: Column) -> Column:
    """The source that a table's name tells."""
    base = basename(name)
    return F.when(base.rlike(r"^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?_table"), "arxiv").when(base.rlike(r"^[0-9a-f]{32}_table"), "github").when(base.rlike(r"^[0-9a-f]{6,31}_table"), "hugging").when(base.rlike(r"^[0-9]+_table"), "numeric").otherwise("unknown")


def source_of_path(path: Column) -> Column:
    return F.when(path.contains("hugging"), "hugging").when(path.contains("github"), "github").when(path.contains("tables_output"), "html").when(path.contains("llm"), "llm")


def without_tag(path: Column) -> Column:
    return F.regexp_replace(path, r"(deduped_hugging_csvs_v2|deduped_github_csvs_v2|tables_output_v2|llm_tables)_[0-9]+", "$1")


def first_tokens(text: Column, n: int) -> Column:
    """A text of at most n tokens as it is; a longer one as its first n, joined by commas."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.when(F.size(tokens) > n, F.array_join(F.slice(tokens, 1, n), ",")).otherwise(text)


def capped_terms(text: Column, n: int = 1024) -> Column:
    terms = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.when(F.size(terms) > n, F.array_join(F.slice(terms, 1, n), " ")).otherwise(text)


def fenced_blocks(text: Column) -> Column:
    """The distinct Markdown blocks of a model's answer in order, or the whole of it."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```markdown\s*\n(.*?)\s*```"), F.lit(1)), lambda b: F.trim(b)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def url_file(url: Column) -> Column:
    return F.concat(F.md5(url), F.lit(".md"))


def table_file(content: Column, k: Column) -> Column:
    return F.concat(F.substring(F.sha2(content, 256), 1, 10), F.lit("_table"), k.cast("string"), F.lit(".csv"))


def clean_github_link(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^{}\[\]()<>\"'`,\s]*)", 1)


def parsed_answer(text: Column) -> Column:
    """YES, NO or UNSURE of an answer ``related: …`` or of a bare one; UNSURE where none is found."""
    found = F.upper(F.regexp_extract(text, r"(?im)^\s*(?:related\s*:)?\s*[\"']?(yes|no|unsure)\b", 1))
    return F.when(found == "", "UNSURE").otherwise(found)


def file_extension(name: Column) -> Column:
    found = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return F.when(found == "", "no_extension").otherwise(found)


def packed_chunks(sizes: Column, limit: int, spare: int = 0) -> Column:
    """For the sizes of a document's blocks, the chunk of each: ceil(total / room) balanced chunks.

    A chunk closes once it has its share; a block over the share is alone in its chunk.
    """
    room = float(limit - spare)
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    share = total / F.greatest(F.lit(1.0), F.ceil(total / room))
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0.0).alias("held"))

    def step(acc: Column, x: Column) -> Column:
        opens = (acc["held"] > 0) & (acc["held"] + x > share)
        chunk = acc["chunk"] + opens.cast("int")
        return F.struct(F.concat(acc["out"], F.array(chunk)).alias("out"), chunk.alias("chunk"), F.when(opens, x.cast("double")).otherwise(acc["held"] + x).alias("held"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def annotation_slices(text: Column, annotations: Column) -> Column:
    """Structs (start, end, extracted_text) of a JSON text ``[{"start": …, "end": …}]`` of half-open code-point ranges.

    Null or unreadable JSON gives an empty list; ranges that are no ranges of the text are left out.
    """
    spans = F.coalesce(F.from_json(annotations, "array<struct<start: int, end: int>>"), F.array().cast("array<struct<start: int, end: int>>"))
    fine = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)))
    return F.transform(fine, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("extracted_text")))


def json_lists(json: Column) -> Column:
    """A JSON map of lists as MAP<STRING, ARRAY<STRING>>."""
    return F.from_json(json, "map<string, array<string>>")
