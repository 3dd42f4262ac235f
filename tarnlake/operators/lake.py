"""Snapshots, quality control, deduplication and linking of the lake's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.tables import content_hash, qc_status

#: Sources by priority; the first is preferred.
SOURCES = ("hugging", "github", "html", "llm")
#: Names of tables that nearly every card links.
GENERIC = ("1910.09700_table", "204823751_table")


def snapshot_delta(new: DataFrame, base_raw: DataFrame | None, base_done: DataFrame | None, compat: bool = False, key: str = "id", card: str = "card") -> DataFrame:
    """(key, status): new, updated or unchanged cards of a snapshot against the one before.

    A card is new if the earlier run did not finish it. A finished one whose earlier card is null is
    updated; with compat it has no status and is left out. Without an earlier run all are new.
    """
    ids = new.select(key, F.sha2(card, 256).alias("hash"))
    if base_raw is None or base_done is None:
        return ids.select(key, F.lit("new").alias("status"))
    old = base_raw.select(key, F.sha2(card, 256).alias("old_hash"), F.lit(True).alias("in_raw"))
    done = base_done.select(key).distinct().withColumn("done", F.lit(True))
    rows = ids.join(done, key, "left").join(old, key, "left")
    status = F.when(F.col("done").isNull(), "new").when(F.col("in_raw").isNull(), "updated").when(F.col("old_hash").isNull(), None if compat else "updated").when(F.col("hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("updated")
    return rows.select(key, status.alias("status")).filter("status IS NOT NULL")


def carried_over(base: DataFrame, redone: DataFrame) -> DataFrame:
    """Unchanged rows of a base and redone ones, over the columns that both have."""
    common = [c for c in base.columns if c in redone.columns]
    return base.select(common).unionByName(redone.select(common))


def priority(source: Column) -> Column:
    return reduce(lambda w, s: w.when(source == s, SOURCES.index(s) + 1), SOURCES[1:], F.when(source == SOURCES[0], 1)).otherwise(len(SOURCES) + 1)


def quality_control(tables: DataFrame, one_row_sources: tuple[str, ...] = ("hugging", "github", "llm")) -> DataFrame:
    """Tables (table_id, source, header, rows) with status and, for valid ones, the content's hash."""
    status = qc_status(F.col("header"), F.col("rows"), F.col("source").isin(*one_row_sources))
    return tables.withColumn("status", status).withColumn("hash", F.when(F.col("status") == "valid", content_hash(F.col("header"), F.col("rows"))))


def deduplicate(tables: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(canonical, mapping, matrix) of valid tables (table_id, source, ord, hash).

    Only tables that a model links and that are not generic count. Of tables with one hash the one
    of the best source, then the smallest ord and id, is canonical; mapping leads the others to it.
    The canonical table comes by an aggregate with partial sums, so a content of which a third of
    the rows are copies is one row a task.
    """
    rows = tables.filter(F.col("hash").isNotNull())
    for name in GENERIC:
        rows = rows.filter(~F.col("table_id").contains(name))
    if links is not None:
        rows = rows.join(links.select("table_id").distinct(), "table_id", "left_semi")
    best = F.min(F.struct(priority(F.col("source")).alias("p"), "ord", "table_id", "source"))
    canonical = rows.groupBy("hash").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")).select("hash", F.col("best.table_id").alias("canonical"), F.col("best.source").alias("source"), "copies")
    mapping = rows.join(canonical.filter("copies > 1").select("hash", "canonical"), "hash").filter(F.col("table_id") != F.col("canonical")).select("table_id", "canonical")
    per = rows.groupBy("hash", "source").agg(F.count(F.lit(1)).alias("n"))
    sources = per.groupBy("hash").agg(F.collect_list(F.struct("source", "n")).alias("s"))  # one entry a source
    pairs = sources.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: F.struct(a["source"].alias("a"), b["source"].alias("b"), a["n"].alias("n"))))).alias("pairs")).alias("x"))
    pairs = pairs.select("x.*")
    matrix = pairs.groupBy("a", "b").agg(F.count(F.when((F.col("a") != F.col("b")) | (F.col("n") > 1), 1)).alias("n"))
    return canonical, mapping, matrix


def canonical_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links (model_id, source, table_id) led to canonical tables, each once a model, under the first source that has it."""
    led = links.join(mapping, "table_id", "left").select("model_id", "source", F.coalesce("canonical", "table_id").alias("table_id"))
    return led.groupBy("model_id", "table_id").agg(F.min_by("source", priority(F.col("source"))).alias("source"))


def link_tables(model_titles: DataFrame, title_tables: DataFrame) -> DataFrame:
    """(model_id, source, table_id) of models with titles ARRAY and of titles with tables ARRAY by source."""
    titles = model_titles.select("model_id", F.explode(F.array_distinct("titles")).alias("title"))
    tables = title_tables.select("title", "source", F.explode("tables").alias("table_id"))
    return titles.join(tables, "title").select("model_id", "source", "table_id").distinct()


INTENTS = ("methodology", "background", "result")
CITATIONS = "struct<data: array<struct<id: bigint, isInfluential: boolean, intents: array<array<string>>, contexts: array<string>>>>"


def _named(intent: str):
    return lambda x: F.coalesce(F.array_contains(F.flatten(x["intents"]), intent), F.lit(False))


def _intent_is(name: str):
    return lambda p: p["intent"] == name


def citation_contexts(df: DataFrame, json_col: str) -> DataFrame:
    """The rows with the contexts of each intent: methodology_contexts, background_contexts, result_contexts.

    The n-th intent of an item goes with its n-th context; where their counts differ, with all of
    them joined by a space. An intent that is none of the known ones, nor null or none, is an error.
    """
    items = F.filter(F.coalesce(F.from_json(json_col, CITATIONS)["data"], F.array().cast(CITATIONS[13:-1])), lambda x: x["id"].isNotNull() & x["intents"].isNotNull())

    def pairs(x: Column) -> Column:
        intents, contexts = F.flatten(x["intents"]), F.coalesce(x["contexts"], F.array().cast("array<string>"))
        joined = F.array_join(contexts, " ")
        own = F.when(F.size(intents) == F.size(contexts), contexts).otherwise(F.transform(intents, lambda _: joined))
        return F.arrays_zip(intents.alias("intent"), own.alias("context"))

    found = F.flatten(F.transform(items, pairs))
    strange = F.filter(found, lambda p: ~F.coalesce(p["intent"], F.lit("none")).isin(*INTENTS, "None", "none"))
    checked = F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown intent: "), F.get(strange, F.lit(0))["intent"]))).otherwise(found)
    rows = df.withColumn("cited_pairs", checked)
    for name in INTENTS:
        rows = rows.withColumn(f"{name}_contexts", F.transform(F.filter("cited_pairs", _intent_is(name)), lambda p: p["context"]))
    return rows.drop("cited_pairs")


def citation_intents(df: DataFrame, json_col: str) -> DataFrame:
    """Eight distinct id lists of a JSON column: overall and by intent, all and influential ones.

    Null or unreadable JSON gives eight empty lists. An item without intents is in overall only.
    """
    items = F.filter(F.coalesce(F.from_json(json_col, CITATIONS)["data"], F.array().cast(CITATIONS[13:-1])), lambda x: x["id"].isNotNull())
    out = df
    for name in ("overall", *INTENTS):
        for mark in ("", "_infl"):
            own = items if name == "overall" else F.filter(items, _named(name))
            if mark:
                own = F.filter(own, lambda x: F.coalesce(x["isInfluential"], F.lit(False)))
            out = out.withColumn(f"{name}{mark}_ids", F.array_distinct(F.transform(own, lambda x: x["id"])))
    return out
