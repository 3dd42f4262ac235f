"""Tables, titles and citations out of documents: parsers that built-in expressions can't state.

Each parser is a plain function over one text, run over Arrow batches by ``mapInPandas``; documents
with equal text are parsed once. Every row and cell of a table is kept as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TABLE_SCHEMA = "k int, header array<string>, rows array<array<string>>"
SEPARATOR_CELL = re.compile(r"\s*:?-+:?\s*")
# Fixed value: what tells a badge.
BADGE = re.compile(r"img\.shields\.io|!\[|badge", re.I)

Grid = list[list[str]]


class _Tables(HTMLParser):
    """Rows of cells (text, rowspan, colspan) of the outermost tables, and where these stand."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[list[list[tuple[str, int, int]]], int, int, str]] = []
        self.starts = [0]
        for line in text.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.depth, self.rows, self.cell, self.span, self.begin, self.caption, self.in_caption = 0, [], None, (1, 1), 0, "", False
        self.feed(text)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.rows, self.begin, self.caption = [], self._at(), ""
        elif self.depth == 1 and tag == "tr":
            self._end_cell()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._end_cell()
            at = dict(attrs)
            number = lambda v: max(1, min(1000, int(v))) if v and v.strip().isdigit() else 1
            self.cell, self.span = [], (number(at.get("rowspan")), number(at.get("colspan")))
        elif self.depth == 1 and tag == "caption":
            self.in_caption = True
        elif self.cell is not None and tag == "math":
            self.cell.append(dict(attrs).get("alttext") or "")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            if self.depth == 1:
                self._end_cell()
                end = self._at() + len("</table>")
                self.found.append((self.rows, self.begin, end, self.caption.strip()))
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "caption":
            self.in_caption = False

    def _end_cell(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((" ".join("".join(self.cell).split()), *self.span))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)
        elif self.in_caption:
            self.caption += data


def html_grid(rows: list[list[tuple[str, int, int]]]) -> Grid:
    """Cells with their text repeated over every row and column that they span."""
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, across in row:
            while (r, c) in grid:
                c += 1
            for i in range(r, min(r + down, len(rows))):
                for j in range(c, c + across):
                    grid.setdefault((i, j), text)
            c += across
    width = max((j for _, j in grid), default=-1) + 1
    return [[grid.get((i, j), "") for j in range(width)] for i in range(len(rows))]


def split_row(line: str) -> list[str]:
    """Cells of a Markdown row; bars inside code spans and escaped ones don't divide."""
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    cells, cell, code, i = [], "", False, 0
    while i < len(line):
        if line.startswith("\\|", i):
            cell, i = cell + "|", i + 2
            continue
        if line[i] == "`":
            code = not code
        if line[i] == "|" and not (code and "`" in line[i:]):
            cells.append(cell)
            cell = ""
        else:
            cell += line[i]
        i += 1
    return [c.strip() for c in [*cells, cell]]


def is_separator(line: str) -> bool:
    cells = split_row(line)
    return "-" in line and all(SEPARATOR_CELL.fullmatch(c) for c in cells if c) and any(cells)


def markdown_blocks(text: str) -> list[list[str]]:
    """Stretches of lines that hold bars, borders added; a blank line or one without a bar ends one."""
    out, held = [], []
    for line in [*text.split("\n"), ""]:
        own = line.strip()
        if "|" in own:
            own = own if own.startswith("|") else f"| {own}"
            held.append(own if own.endswith("|") else f"{own} |")
        elif held:
            out.append(held)
            held = []
    return [b for b in out if len(b) >= 2 and (any(map(is_separator, b)) or sum(x.count("|") >= 2 for x in b) >= 2)]


def is_badges(block: list[str]) -> bool:
    """A layout table of badges: hardly any rows, an empty header, several pictures."""
    header, data = split_row(block[0]), [x for x in block[1:] if not is_separator(x)]
    return len(data) <= 2 and sum(not c for c in header) * 2 > len(header) and len(BADGE.findall("\n".join(block))) >= 3


def plain_cell(cell: str) -> str:
    cell = re.sub(r"\*\*(.+?)\*\*|__(.+?)__", lambda m: m[1] or m[2], cell)
    cell = re.sub(r"(?<!\w)[*_](.+?)[*_](?!\w)", r"\1", cell)
    return re.sub(r"`([^`]*)`", r"\1", cell).strip()


def markdown_grid(block: list[str]) -> Grid:
    """Rows of a block without separators, cells plain, filled up to the widest row's width."""
    rows = [[plain_cell(c) for c in split_row(x)] for x in block if not is_separator(x)]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def tables_of(text: str | None) -> list[Grid]:
    """HTML tables first, then Markdown ones; alike tables once, each of two rows or more."""
    text = text or ""
    grids: list[Grid] = []
    if "<table" in text.lower():
        parsed = _Tables(text).found
        for rows, begin, end, _ in reversed(parsed):
            if len(rows) >= 2:
                text = text[:begin] + text[end:]
        grids += [html_grid(rows) for rows, *_ in parsed if len(rows) >= 2]
    grids += [markdown_grid(b) for b in markdown_blocks(text) if not is_badges(b)]
    out, seen = [], set()
    for g in grids:
        key = tuple(tuple(c.strip() for c in r) for r in g if any(c.strip() for c in r))
        if len(key) >= 2 and key not in seen:
            seen.add(key)
            out.append([g[0], *[r for r in g[1:] if any(c.strip() for c in r)]])
    return out


def github_tables(files: DataFrame, key: str = "name", text: str = "text", most_bytes: int = 5 << 20) -> DataFrame:
    """(key, n_bytes, tables): the tables of each file, numbered from 0 and named <key>_table_<n>.csv.

    A file over ``most_bytes`` keeps its row with null tables; one without tables, or with null text,
    has an empty list. Tables (name, header, rows) alike in a file are each kept; each file counts.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for name, body in zip(df[key], df[text], strict=True):
                size = len((body or "").encode("utf-8", "surrogatepass"))
                found = None
                if size <= most_bytes:
                    grids = [markdown_grid(b) for b in markdown_blocks(body or "") if not is_badges(b)]
                    found = [{"name": f"{name}_table_{i}.csv", "header": g[0], "rows": g[1:]} for i, g in enumerate(grids)]
                out.append((name, size, found))
            yield pd.DataFrame(out, columns=[key, "n_bytes", "tables"])

    return files.select(key, text).mapInPandas(run, f"{key} {kind}, n_bytes long, tables array<struct<name: string, header: array<string>, rows: array<array<string>>>>")


def paper_tables(html: str | None) -> list[Grid]:
    """Captioned tables of a paper's page; equation layouts are left out."""
    out = []
    for m in re.finditer(r"(?is)<figure[^>]*class=\"[^\"]*ltx_(?:table|figure)[^\"]*\"[^>]*>(.*?)</figure>", html or ""):
        if "<figcaption" not in m[1].lower():
            continue
        body = re.sub(r"(?is)<table[^>]*class=\"[^\"]*ltx_(?:equation|eqn_table)[^\"]*\".*?</table>", "", m[1])
        out += [html_grid(rows) for rows, *_ in _Tables(body).found if rows]
    return out


def answer_tables(text: str | None) -> list[Grid]:
    """Tables of the fenced Markdown blocks of a model's answer, or of all of it."""
    blocks = list(dict.fromkeys(b.strip() for b in re.findall(r"(?s)```markdown\s*\n(.*?)```", text or ""))) or [text or ""]
    return [markdown_grid(b) for block in blocks for b in markdown_blocks(block)]


DIALECTS: dict[str, Callable[[str | None], list[Grid]]] = {"md": tables_of, "arxiv": paper_tables, "llm": answer_tables}


def extract_tables(docs: DataFrame, dialect: str = "md", text: str = "text", most_chars: int | None = None) -> DataFrame:
    """(hash, k, header, rows): the tables of each distinct text, numbered from 1.

    Texts over most_chars are left out, if it is given. Null texts have no table. Only texts that
    may hold a table reach the parser.
    """
    parse = DIALECTS[dialect]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(h, k, g[0], g[1:]) for h, t in zip(df["hash"], df["body"], strict=True) for k, g in enumerate(parse(t), 1)]
            yield pd.DataFrame(rows, columns=["hash", "k", "header", "rows"])

    body = F.col(text)
    rows = docs.filter(body.isNotNull() & (body.contains("|") | F.lower(body).contains("<table"))).select(F.sha2(body, 256).alias("hash"), body.alias("body"))
    if most_chars is not None:
        rows = rows.filter(F.length("body") <= most_chars)
    return rows.dropDuplicates(["hash"]).mapInPandas(run, f"hash string, {TABLE_SCHEMA}")


def renumbered(tables: DataFrame) -> DataFrame:
    """Tables that are left of a document, numbered anew from 1 in their order."""
    return tables.withColumn("k", F.row_number().over(Window.partitionBy("hash").orderBy("k")))


def page_type(html):
    """fulltext or metadata of a paper's page, as a column."""
    low = F.lower(html)
    metas = F.size(F.regexp_extract_all(low, F.lit(r"<meta[^>]+name=\"citation_[a-z_]+\""), F.lit(0)))
    parts = F.size(F.regexp_extract_all(low, F.lit(r"<(?:section|article)\b"), F.lit(0)))
    return F.when(metas >= 3, "metadata").when((parts >= 2) | (low.contains("introduction") & low.contains("conclusion")), "fulltext").otherwise("metadata")


# ---- citations, front matter, titles


def bibtex_blocks(text: str | None) -> list[str]:
    """Entries from a line that begins with @word{ to the line in which its braces close."""
    out, held, depth = [], [], 0
    for line in (text or "").split("\n"):
        if not held and not re.match(r"\s*@\w+\{", line):
            continue
        held.append(line)
        depth += line.count("{") - line.count("}")
        if depth <= 0:
            out.append("\n".join(held))
            held, depth = [], 0
    return out


FIELDS = ("title", "author", "year", "doi", "url", "journal", "booktitle", "volume", "pages")


def parse_bibtex(entry: str) -> dict[str, str | None] | None:
    """The kind and nine fields of an entry, null where not given; None if it can't be read."""
    m = re.match(r"\s*@(\w+)\s*\{\s*([^,]*),", entry)
    if not m:
        return None
    out: dict[str, str | None] = {"entry_type": m[1].lower(), **dict.fromkeys(FIELDS)}
    at = m.end()
    for f in re.finditer(r"(\w+)\s*=\s*", entry):
        if f.start() < at:
            continue
        i, depth = f.end(), 0
        mark = entry[i : i + 1]
        if mark in ("{", '"'):
            j = i + 1
            while j < len(entry) and not (depth == 0 and entry[j] == ("}" if mark == "{" else '"')):
                depth += (entry[j] == "{") - (entry[j] == "}")
                j += 1
            value = entry[i + 1 : j]
        else:
            j = i + len(re.match(r"[^,}\n]*", entry[i:])[0])
            value = entry[i:j]
        at = j
        if f[1].lower() in FIELDS:
            out[f[1].lower()] = " ".join(value.split())
    return out


def parsed_bibtex(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bibtex: structs of ten fields, successful: how many could be read)."""
    fields = ("entry_type", *FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [[p for e in bibtex_blocks(t) if (p := parse_bibtex(e))] for t in df[text]]
            yield pd.DataFrame({key: df[key], "bibtex": found, "successful": [len(f) for f in found]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, bibtex array<struct<{', '.join(f'{f}: string' for f in fields)}>>, successful long")


def yaml_tags(text: str | None) -> tuple[dict[str, str], str | None]:
    """(scalar and list values by key, error) of a front matter; what is no mapping is empty."""
    import yaml

    try:
        got = yaml.safe_load((text or "").replace("\t", " "))
    except yaml.YAMLError as e:
        return {}, str(e).split("\n")[0]
    if not isinstance(got, dict):
        return {}, None
    return {str(k): ", ".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in got.items() if v is not None}, None


def front_matter_tags(docs: DataFrame, key: str = "doc_id", text: str = "tags") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            got = [yaml_tags(t) for t in df[text]]
            yield pd.DataFrame({key: df[key], "tags": [g[0] for g in got], "error": [g[1] for g in got]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, tags map<string,string>, error string")


def tag_columns(tags: DataFrame, keys: list[str] | None = None, most: int = 200) -> DataFrame:
    """One column tags_<key> for each key; without keys, for the most frequent ones, ``most`` at most."""
    if keys is None:
        keys = [r["k"] for r in tags.select(F.explode(F.map_keys("tags")).alias("k")).groupBy("k").count().orderBy(F.desc("count"), "k").limit(most).collect()]
    return tags.select("*", *[F.col("tags")[k].alias(f"tags_{k}") for k in keys])


def readme_title(text: str | None) -> str | None:
    """The heading after the repository's file list: its first run of # lines, or the first # line."""
    lines = (text or "").split("\n")
    start = next((i + 1 for i, x in enumerate(lines) if "repository files navigation" in x.lower()), None)
    if start is not None:
        block: list[str] = []
        for line in lines[start:]:
            own = line.strip()
            if not own or own.startswith("["):
                if block:
                    break
            elif own.startswith("#"):
                block.append(own.lstrip("#").strip())
            else:
                break
        if block:
            return "".join(block)
    return next((x[2:].strip() for x in lines if x.startswith("# ")), None)


def table_context(text: str | None) -> dict[str, list[str]]:
    """Captions of tables and paragraphs that speak of tables."""
    text = re.sub(r"(?s)<table.*?</table>", "\n", text or "", flags=re.I)
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", re.sub(r"(?m)^\s*\|.*$", "", text))]
    captions = [p for p in paragraphs if re.match(r"(?i)(table|tab\.)\s*[0-9ivx]+\s*[:.]", p)]
    return {"captions": captions, "mentions": [p for p in paragraphs if re.search(r"(?i)\btables?\b", p) and p not in captions]}


def mapped(docs: DataFrame, parse: Callable[[str | None], object], out: str, kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, out) with a parser of one text applied over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({key: df[key], out: [parse(t) for t in df[text]]})

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, {out} {kind}")
