"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Every source has a weight; together the targets make up all words of the corpus. A target stops at
``cap`` times its source's size, and what is over is reshared by weight until none is above. Each
source's weight follows a linear schedule over the training time 0..1. Its integral, turned round,
gives the time at which the source's n-th word is asked for, and so each document's position.

Defined results: a null text has size 0; the null source is a source of its own and sorts last; a
source without words gets target 0; repeated rows are rows of their own; ties in the hashed order
fall to doc_id, then size; an empty table gives an empty result. Columns whose names clash with the
working ones are kept by ``curriculum`` as they are, since the plan is joined back by ``row_key``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Half the change of a source's weight over the training time; odd ranks fall, even ranks rise.
SLOPE = 0.5
#: Rows that a bucket of the hashed order holds, about.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size) rows -> one row a source: rank, source_size, target, slope.

    Sorted by cap over weight, a source is capped when the level that the words left over give to it
    and all later ones is above its own; the first that is not sets the level for the rest. The
    windows run over one row a source, which are few beside the documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(table, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", (F.col("source_size") * cap).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    level = (
        ranked.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("weights"))
        .withColumn("level", F.min(F.when(F.col("limit") >= F.col("weight") * F.col("level"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(whole)["level"])
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("level"), F.col("limit")))
    return level.select("source", "rank", "source_size", target.alias("target"), F.when(F.col("rank") % 2 == 1, -SLOPE).otherwise(SLOPE).alias("slope"))


def schedule_time(share: Column, slope: Column) -> Column:
    """The time t at which the share of a source's demand is reached.

    The weight at t is 1 + slope * (2t - 1); its integral (1 - slope) t + slope t^2 = share.
    """
    a = F.lit(1.0) - slope
    root = F.sqrt(a * a + F.lit(4.0) * slope * share)
    return F.when(slope == 0, share).otherwise((root - a) / (F.lit(2.0) * slope))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: keys, size, source_size, target, passes, taken, share, slope.

    A source is laid out in the order of a hash of id and text, so that rows of one id are spread too. Whole passes come first; the rest of the
    target takes documents in that order until its end falls before a document's middle. The
    running sums are found in buckets of the hash, so no source has to meet in one task.
    """
    slim = stored(docs.select(*keys, "source", word_count(F.col("text")).alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))).alias("h")), "mix")
    rows = slim.count()
    digits = max(1, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)) + 1)
    # the null source joins under a name that no source has
    slim = slim.select("*", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("mix_source"), F.substring("h", 1, digits).alias("mix_bucket"))
    info = targets(slim.select("source", "size"), weights, cap).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("mix_source"), "rank", "source_size", "target", "slope")
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = slim.groupBy("mix_source", "mix_bucket").agg(F.sum("size").alias("n")).select("mix_source", "mix_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(info, "mix_source")
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = slim.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["mix_source", "mix_bucket"]).withColumn("start", F.col("base") + F.col("inside"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    at = at.withColumn("whole", whole.cast("long"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("start") + F.col("size") / 2.0 < rest)
    return at.withColumn("passes", F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(F.lit(0)).cast("long")).select(*keys, "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"), "start", "slope")


def position(turn: Column | None = None) -> Column:
    """Training time in millionths at which a document's pass (from 0, the first) is placed."""
    turn = F.lit(0) if turn is None else turn
    share = (turn * F.col("source_size") + F.col("start") + F.col("size") / 2.0) / F.col("target")
    return F.floor(schedule_time(F.least(F.lit(1.0), share), F.col("slope")) * 1_000_000).cast("long")


def curriculum(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents that the mix takes, once for each pass, range-sorted by training position.

    Columns are those of the input. A document without words is taken by no pass.
    """
    key = "mix_row_key"
    while key in docs.columns:
        key += "_"
    # rows with the same id are told apart by what they hold; equal rows are alike in everything
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    plan = mix_plan(keyed.select("doc_id", "source", "text", key), weights, cap, ("doc_id", key))
    turn = F.explode(F.expr("sequence(0L, passes - 1)"))
    turns = plan.filter("passes > 0").select("*", turn.alias("turn"))
    turns = turns.groupBy("doc_id", key, "turn").agg(F.min(position(F.col("turn"))).alias("mix_position"))
    mine = [keyed[c] for c in docs.columns]
    joined = keyed.join(turns, (keyed[key] == turns[key]) & keyed["doc_id"].eqNullSafe(turns["doc_id"]))
    return joined.select(*mine, turns["mix_position"].alias(key)).orderBy(key, "doc_id").drop(key)


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the first training position, range-sorted by it."""
    plan = mix_plan(docs.select("doc_id", "source", "text"))
    first = F.when(F.col("passes") > 0, position())
    return plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_sql(docs: str = "documents", columns: str = "doc_id, size, source_size, target, taken, position") -> str:
    """The same plan as one SQL statement."""
    weights = "[" + ", ".join(f"{w}.0::double" for w in WEIGHTS) + "]"
    return f"""
WITH mix_slim AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) AS h FROM {docs}),
mix_ranked AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM mix_slim GROUP BY source),
mix_caps AS (SELECT *, {weights}[((rank - 1) % {len(WEIGHTS)} + 1)::int] AS weight, (source_size * {CAP})::double AS cap FROM mix_ranked),
mix_levels AS (SELECT *, ((SELECT sum(source_size)::double FROM mix_caps) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM mix_caps),
mix_level AS (SELECT own AS level FROM mix_levels WHERE cap >= weight * own ORDER BY cap / weight, rank LIMIT 1),
mix_targets AS (SELECT source, rank, source_size, least(cap, coalesce(weight * (SELECT level FROM mix_level), cap)) AS target,
    CASE WHEN rank % 2 = 1 THEN -{SLOPE}::double ELSE {SLOPE}::double END AS slope FROM mix_levels),
mix_laid AS (SELECT d.*, t.source_size, t.target, t.slope,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::bigint ELSE 0 END AS whole
    FROM mix_slim d JOIN mix_targets t ON d.source IS NOT DISTINCT FROM t.source),
mix_passes AS (SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN start + size / 2.0::double < target - whole * source_size THEN 1 ELSE 0 END ELSE 0 END AS passes FROM mix_laid),
mix_plan AS (SELECT *, size * passes AS taken, CASE WHEN passes > 0 THEN
    floor(((sqrt((1.0::double - slope) * (1.0::double - slope) + 4.0::double * slope * least(1.0::double, (0 * source_size + start + size / 2.0::double) / target)) - (1.0::double - slope)) / (2.0::double * slope)) * 1000000)::bigint END AS position
    FROM mix_passes)
SELECT {columns} FROM mix_plan"""
