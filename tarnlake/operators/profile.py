"""Profiles of tables: columns, frequencies, suffixes, histograms, fits of growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def column_profile(df: DataFrame) -> DataFrame:
    """(col, type, n, n_null, pct_null, avg_length, bytes): lengths of lists in elements, of text in characters."""
    sums = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        length = F.size(c) if isinstance(f.dataType, ArrayType) else F.length(c) if isinstance(f.dataType, StringType) else F.lit(None)
        text = F.to_json(F.struct(c.alias("x"))) if not isinstance(f.dataType, StringType) else c
        sums += [F.sum(c.isNull().cast("long")).alias(f"null{i}"), F.avg(F.when(c.isNotNull(), length)).alias(f"len{i}"), F.sum(F.when(c.isNotNull(), F.octet_length(text))).alias(f"bytes{i}")]
    row = df.agg(*sums)
    parts = [
        F.struct(F.lit(f.name).alias("col"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n"), F.coalesce(F.col(f"null{i}"), F.lit(0)).alias("n_null"), (F.col(f"null{i}") * 100.0 / F.col("n")).alias("pct_null"), F.col(f"len{i}").cast("double").alias("avg_length"), F.coalesce(F.col(f"bytes{i}"), F.lit(0)).alias("bytes"))
        for i, f in enumerate(df.schema.fields)
    ]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def table_frequency(links: DataFrame, table: str, model: str) -> DataFrame:
    """One row: occurrences, tables, most models of a table, mean occurrences."""
    by_table = links.groupBy(table).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(model).alias("models"))
    return by_table.agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_tables"), F.max("models").alias("most_models"), F.avg("n").alias("mean"))


def most_frequent(links: DataFrame, table: str, k: int = 10) -> DataFrame:
    """(table, n) of the k tables with most rows, ties to the smaller name."""
    return links.groupBy(table).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), table).limit(k)


def neighbor_histogram(edges: DataFrame) -> DataFrame:
    """(degree, n): how many nodes have how many neighbours, from undirected edges (src, dst)."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def log_bins(df: DataFrame, value: str, per_decade: int = 5) -> DataFrame:
    """(bin, n) of positive values in bins of equal width on a log scale; bin b starts at 10^(b / per_decade)."""
    return df.filter(F.col(value) > 0).groupBy(F.floor(F.log10(F.col(value)) * per_decade + 1e-9).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def iqr_band(df: DataFrame, value: str, width: float = 1.5) -> DataFrame:
    """One row: q1, q3, low, high and how many values lie outside the band."""
    q = df.agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    q = q.select("q1", "q3", (F.col("q1") - width * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + width * (F.col("q3") - F.col("q1"))).alias("high"))
    outside = (F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))
    return df.select(value).crossJoin(F.broadcast(q)).groupBy("q1", "q3", "low", "high").agg(F.sum(outside.cast("long")).alias("n_outside"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def exponential_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """y = scale * exp(rate * x) by least squares of log y; rows with y of 0 or less go."""
    logs = df.filter(F.col(y) > 0).select(F.col(x).alias("x"), F.log(F.col(y)).alias("y"))
    return logs.agg(F.exp(F.regr_intercept("y", "x")).alias("scale"), F.regr_slope("y", "x").alias("rate"))
