"""Sinks and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tarnlake.operators.order import numbered


def without_null_lists(df: DataFrame) -> DataFrame:
    """Null lists made empty, as every reader of the lake expects."""
    empty = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in df.schema.fields if isinstance(f.dataType, ArrayType)}
    return df.withColumns(empty) if empty else df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    without_null_lists(df).write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """A long table as CSV; nulls are empty fields."""
    df.write.mode("overwrite").csv(path, header=header, nullValue="", emptyValue="")


def corpus_lines(df: DataFrame, key: str, contents: str) -> DataFrame:
    """One JSON line {id, contents} for each row that is not blank."""
    return df.filter(F.trim(F.coalesce(F.col(contents), F.lit(""))) != "").select(F.to_json(F.struct(F.col(key).cast("string").alias("id"), F.col(contents).alias("contents"))).alias("value"))


def write_jsonl(df: DataFrame, path: str, key: str = "id", contents: str = "contents") -> None:
    corpus_lines(df, key, contents).write.mode("overwrite").text(path)


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def graph_tables(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a graph store; lists of the edges become JSON text."""
    nodes = edges.select(F.col(src).alias("node")).union(edges.select(dst)).distinct()
    lists = [f.name for f in edges.schema.fields if isinstance(f.dataType, ArrayType)]
    return nodes, edges.withColumns({c: F.to_json(c) for c in lists}) if lists else edges


def write_graph(edges: DataFrame, path: str, src: str, dst: str) -> None:
    nodes, rows = graph_tables(edges, src, dst)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    rows.write.mode("overwrite").parquet(f"{path}/edges")


def inverted_index(corpus: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of (id, contents): what a text index holds."""
    from tarnlake.operators.search import terms

    return corpus.select(F.col("id").alias("doc_id"), F.explode(terms(F.col("contents"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def write_partitioned(df: DataFrame, path: str, key: str = "modelId") -> None:
    """Folders by the first character of the key."""
    df.withColumn("partition", F.lower(F.substring(F.col(key).cast("string"), 1, 1))).write.mode("overwrite").partitionBy("partition").parquet(path)


def sorted_layout(tables: dict[str, DataFrame], key: str = "modelId") -> DataFrame:
    """All tables one under the other with their name, in ranges sorted by the key."""
    parts = [df.withColumn("_table_type", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.repartitionByRange(key).sortWithinPartitions(key)


def wide_layout(tables: dict[str, DataFrame], key: str = "modelId", order: str | None = None) -> DataFrame:
    """One row a key with a struct a table; of repeated keys the row last in ``order``."""
    out = None
    for name, df in tables.items():
        own = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(order) if order else F.xxhash64(*df.columns)).alias(name))
        out = own if out is None else out.join(own, key, "full")
    return out


def normalized_layout(tables: dict[str, DataFrame], key: str = "modelId") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(dimension of keys with a number from 0, tables that refer to it)."""
    keys = None
    for df in tables.values():
        keys = df.select(key) if keys is None else keys.union(df.select(key))
    dimension = numbered(keys.distinct(), [F.col(key)], "model_key").withColumn("model_key", F.col("model_key") - 1)
    return dimension, {n: df.join(dimension, key).drop(key) for n, df in tables.items()}


def selected(tables: DataFrame, mask: DataFrame, suffix: str = "") -> DataFrame:
    """Tables whose id is in a mask list, named with a suffix: a semi-join in place of links."""
    return tables.join(mask.select("table_id").distinct(), "table_id", "left_semi").withColumn("name", F.concat(F.col("table_id").cast("string"), F.lit(suffix)))


def markdown_report(query: dict, hits: list[dict], rows: int = 5) -> str:
    """A query's table and those found for it, the first rows of each. For a few tables, on the driver."""

    def block(t: dict) -> str:
        head = [str(c) for c in t["header"] or []]
        body = [[str(c or "") for c in r] for r in (t["rows"] or [])[:rows]]
        return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *body])

    return "\n\n".join([f"## {query['table_id']}", block(query), *[f"### {i}. {h['table_id']}\n\n{block(h)}" for i, h in enumerate(hits, 1)]])
