"""Sources: snapshots, CSV and TSV of uncertain form, NDJSON, catalogs. All through Spark's readers."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITATIONS = "citationid LONG, citingcorpusid LONG, citedcorpusid LONG, isinfluential BOOLEAN, contexts ARRAY<STRING>, intents ARRAY<ARRAY<STRING>>"
PREFIXES = {"modelcard": "train-*.parquet", "datasetcard": "datasetcard-train-*.parquet"}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_snapshots(spark: SparkSession, root: str, kind: str = "modelcard") -> list[str]:
    """Tags of the folders raw_<tag> under root that hold shards of the kind."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/raw_*")
    found = []
    for s in fs.globStatus(p) or []:
        name = s.getPath().getName()
        shards = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), PREFIXES[kind]))
        if shards is not None and len(shards):
            found.append(name.removeprefix("raw_"))
    return sorted(found)


def scan_snapshot(spark: SparkSession, root: str, tag: str, kind: str = "modelcard", columns: list[str] | None = None) -> DataFrame:
    """All shards of a snapshot with its tag, only the columns asked for."""
    known = list_snapshots(spark, root, kind)
    if tag not in known:
        raise ValueError(f"no {kind} snapshot {tag}; there are {', '.join(known) or 'none'}")
    df = spark.read.parquet(f"{root.rstrip('/')}/raw_{tag}/{PREFIXES[kind]}")
    return (df.select(*columns) if columns else df).withColumn("tag", F.lit(tag))


def decoded(raw: bytes) -> str:
    """UTF-8; else what the bytes 80 to 9F say: text of cp1252 where it defines them all, else Latin-1."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def parse_csv(raw: bytes, blank: str | None = None) -> list[list[str | None]]:
    """Rows of a CSV file of unknown encoding and delimiter; without any, one column of lines.

    The delimiter is the one that divides the first lines most evenly. Empty fields become ``blank``.
    """
    text = decoded(raw)
    if not text.strip():
        return []
    head = [x for x in text.splitlines()[:20] if x.strip()]
    best, width = None, 1
    for d in (",", "\t", ";", "|"):
        sizes = [len(r) for r in csv.reader(head, delimiter=d)]
        if sizes and min(sizes) > 1 and len(set(sizes)) == 1 and sizes[0] > width:
            best, width = d, sizes[0]
    if best is None:
        best = next((d for d in (",", "\t", ";", "|") if head and d in head[0]), None)
    if best is None:
        return [["line"], *[[x] for x in text.splitlines() if x]]
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=best) if r]
    return [[c if c != "" else blank for c in r] for r in rows if len(r) <= len(rows[0])]


def scan_csv_tables(spark: SparkSession, paths: str | list[str], most_bytes: int | None = None, blank: str | None = None, tidy: Callable[[list], list] | None = None) -> DataFrame:
    """(table_id, header, rows, error) of many small CSV files, read as bytes and parsed a batch at a time."""
    files = spark.read.format("binaryFile").load(paths)
    if most_bytes is not None:
        files = files.filter(F.col("length") <= most_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for path, raw in zip(df["path"], df["content"], strict=True):
                try:
                    rows = parse_csv(raw, blank)
                    rows = tidy(rows) if tidy else rows
                    out.append((path, rows[0] if rows else None, rows[1:], None if rows else "empty"))
                except csv.Error as e:
                    out.append((path, None, [], str(e)))
            yield pd.DataFrame(out, columns=["table_id", "header", "rows", "error"])

    return files.select("path", "content").mapInPandas(run, "table_id string, header array<string>, rows array<array<string>>, error string")


def scan_csv_display(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV tables as they stand: every cell is text, words like NA and empty cells stay what they are."""
    return scan_csv_tables(spark, paths, blank="")


def without_blanks(rows: list[list[str | None]]) -> list[list[str]]:
    """A table's rows, the header first, without blank rows and columns; white-space cells are empty."""
    tidy = [[c if c and c.strip() else "" for c in r] for r in rows]
    tidy = [r for r in tidy if any(r)]
    width = max(map(len, tidy), default=0)
    filled = [i for i in range(width) if any(i < len(r) and r[i] for r in tidy)]
    return [[r[i] if i < len(r) else "" for i in filled] for r in tidy]


def scan_csv_analysis(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV tables as text without blank rows and columns; the header loses the blank columns too."""
    return scan_csv_tables(spark, paths, blank="", tidy=without_blanks)


def _npz(paths: str | list[str], spark: SparkSession, parse: Callable, schema: str) -> DataFrame:
    """Rows of .npz files; a file is read by one task and handed on in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for raw in df["content"]:
                with np.load(io.BytesIO(raw), allow_pickle=False) as found:
                    yield from parse(found)

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, schema)


PIECE = 50_000


def scan_embeddings(spark: SparkSession, paths: str | list[str], ids: str = "ids", vectors: str = "embeddings") -> DataFrame:
    """(id, embedding) of .npz files that hold an array of ids and one of vectors."""

    def parse(found) -> Iterator[pd.DataFrame]:
        names, rows = found[ids], found[vectors]
        if len(names) != len(rows):
            raise ValueError(f"{len(names)} ids and {len(rows)} vectors")
        for i in range(0, len(names), PIECE):
            yield pd.DataFrame({"id": [str(x) for x in names[i : i + PIECE]], "embedding": list(rows[i : i + PIECE].astype(np.float32))})

    return _npz(paths, spark, parse, "id string, embedding array<float>")


def scan_sparse_graph(spark: SparkSession, paths: str | list[str], names: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight) of matrices in compressed rows (data, indices, indptr); names (place, name) replace numbers."""

    def parse(found) -> Iterator[pd.DataFrame]:
        data, columns, ends = found["data"], found["indices"], found["indptr"]
        for i in range(0, len(columns), PIECE):
            at = np.arange(i, min(i + PIECE, len(columns)))
            yield pd.DataFrame({"src": np.searchsorted(ends, at, side="right") - 1, "dst": columns[at].astype(np.int64), "weight": data[at].astype(np.float64)})

    edges = _npz(paths, spark, parse, "src long, dst long, weight double")
    if names is None:
        return edges
    side = lambda c: names.select(F.col("place").alias(c), F.col("name").alias(f"{c}_name"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "weight")


def scan_table(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """A table of the catalog; on a miss it is made from a Parquet data set."""
    if not spark.catalog.tableExists(name):
        if path is None:
            raise ValueError(f"no table {name}")
        spark.read.parquet(path).write.saveAsTable(name)
    return spark.table(name)


def scan_csv(spark: SparkSession, paths: str | list[str], separator: str = ",") -> DataFrame:
    """CSV files with a header as text columns, with the file's name."""
    return spark.read.csv(paths, header=True, sep=separator, inferSchema=False, mode="PERMISSIVE").withColumn("file", F.col("_metadata.file_name"))


def scan_ndjson(spark: SparkSession, paths: str | list[str], schema: str = CITATIONS, required: tuple[str, ...] = ()) -> DataFrame:
    """Line JSON under an explicit schema; lines that can't be read and rows without the required fields go."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    for c in required:
        df = df.filter(F.col(c).isNotNull())
    return df


def scan_citations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return scan_ndjson(spark, paths, CITATIONS, ("citingcorpusid", "citedcorpusid"))


def scan_tsv_queries(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """(qid, text) of lines ``qid<TAB>text``; strict: just two fields, both filled; else tabs may be in the text."""
    parts = spark.read.text(paths).select(F.split("value", "\t", -1 if strict else 2).alias("p"))
    kept = parts.filter((F.size("p") == 2) & (F.get("p", F.lit(0)) != "") & (F.get("p", F.lit(1)) != ""))
    return kept.select(F.get("p", F.lit(0)).alias("qid"), F.get("p", F.lit(1)).alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(filename, offset, value): lines known by file and running number in the file's blocks."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("filename"), F.monotonically_increasing_id().alias("offset"), "value")


def seek_lines(index: DataFrame, records: DataFrame) -> DataFrame:
    """Records (filename, line_index, …) that an index asks for: a semi-join in place of seeks."""
    return records.join(index.select("filename", "line_index").distinct(), ["filename", "line_index"], "left_semi")


def schema_catalog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, bytes, n_rows, columns) of Parquet data sets, the largest first."""
    out = []
    for name, path in paths.items():
        df = spark.read.parquet(path)
        fs, p = _fs(spark, path)
        out.append((name, fs.getContentSummary(p).getLength(), df.count(), [f"{c}:{t}" for c, t in df.dtypes]))
    return spark.createDataFrame(sorted(out, key=lambda x: (-x[1], x[0])), "name string, bytes long, n_rows long, columns array<string>")


def holding(catalog: DataFrame, *attributes: str) -> DataFrame:
    """Data sets of a catalog that have all the attributes: candidates for a join path."""
    names = F.transform("columns", lambda c: F.split_part(c, F.lit(":"), F.lit(1)))
    return catalog.filter(F.forall(F.array(*[F.lit(a) for a in attributes]), lambda a: F.array_contains(names, a)))


def join_path(catalog: DataFrame, start: str, goal: str, most: int = 4) -> list[list[str]]:
    """The shortest ways from one attribute to another: data sets, each sharing an attribute with the next.

    A data set that holds both is a way of one. The catalog is one row a data set and is read to the driver.
    """
    columns = {r["name"]: {c.partition(":")[0] for c in r["columns"]} for r in catalog.collect()}
    ways = [[n] for n in sorted(columns) if start in columns[n]]
    for _ in range(most):
        done = [w for w in ways if goal in columns[w[-1]]]
        if done:
            return done
        ways = [[*w, n] for w in ways for n in sorted(columns) if n not in w and columns[w[-1]] & columns[n]]
    return []


def fetched(wanted: DataFrame, cache: DataFrame, fetch: Callable[[str], str | None], key: str = "url") -> DataFrame:
    """The cache with what it lacked, got by an injected function; the function alone meets a network."""
    missing = wanted.select(key).distinct().join(cache.select(key), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({key: df[key], "body": [fetch(u) for u in df[key]]})

    return cache.select(key, "body").unionByName(missing.mapInPandas(run, f"{key} string, body string"))
