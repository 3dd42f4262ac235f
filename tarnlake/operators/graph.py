"""Relatedness graphs as edge lists (src, dst) with src < dst."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.components import star_forest
from tarnlake.operators.order import numbered
from tarnlake.session import discard, stored

#: Models of a target that a chunk holds at most; pairs from which on there is one more task.
DEALT, PAIRS_A_TASK = 2048, 1 << 22
#: Models of a run: Parquet packs dictionary ids in stretches of 504, so that equal runs are equal bytes, which snappy folds.
RUN = 504
#: Intents that are told by bits; shared references of a round.
INTENTS, PAIRS_A_ROUND = 30, 1 << 26
SCORES = ("inter", "len_a", "len_b", "jaccard", "dice", "max_pr")


def edges_of(df: DataFrame, a: str, b: str) -> DataFrame:
    """Canonical edges of pairs: ordered, distinct, no self loops."""
    x, y = F.col(a), F.col(b)
    return df.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")).distinct()


def mirror(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _scores(out: DataFrame) -> DataFrame:
    return out.withColumns({
        "jaccard": F.col("inter") / (F.col("len_a") + F.col("len_b") - F.col("inter")), "dice": 2 * F.col("inter") / (F.col("len_a") + F.col("len_b")),
        "max_pr": F.greatest(F.col("inter") / F.col("len_a"), F.col("inter") / F.col("len_b")),
    })


def overlap_scores(refs: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, inter, len_a, len_b, jaccard, dice, max_pr) of papers (paper, ref) that share a reference.

    An equi self-join on the reference, never the square of papers; scores under ``least`` go.
    """
    refs = refs.select("paper", "ref").distinct()
    size = refs.groupBy("paper").agg(F.count(F.lit(1)).alias("n"))
    shared = refs.alias("x").join(refs.alias("y"), "ref").filter("x.paper < y.paper").groupBy(F.col("x.paper").alias("a"), F.col("y.paper").alias("b")).agg(F.count(F.lit(1)).alias("inter"))
    out = shared.join(size.select(F.col("paper").alias("a"), F.col("n").alias("len_a")), "a").join(size.select(F.col("paper").alias("b"), F.col("n").alias("len_b")), "b")
    out = _scores(out)
    return out.filter(F.col("max_pr") >= least) if least else out


def overlap_by_intent(refs: DataFrame, least: float = 0.0) -> DataFrame:
    """The overlap scores of references (paper, ref, intent, influential): a row for each variant that a pair has.

    variant is an intent or overall, with _infl for influential references alone. Up to ``INTENTS``
    intents are bits of a number, and a pair of papers has one row a shared reference for all of them.
    """
    found = [r[0] for r in refs.select("intent").filter("intent IS NOT NULL").distinct().limit(INTENTS + 1).collect()]
    if len(found) <= INTENTS:
        return _overlap_by_bits(refs, sorted(found), least)
    marks = F.array_distinct(F.flatten(F.array(F.array(F.lit("overall"), F.col("intent")), F.when(F.col("influential"), F.array(F.lit("overall_infl"), F.concat("intent", F.lit("_infl")))).otherwise(F.array().cast("array<string>")))))
    rows = refs.select("paper", "ref", F.explode(marks).alias("variant")).filter("variant IS NOT NULL")
    named = rows.select(F.struct("variant", "paper").alias("paper"), F.struct("variant", "ref").alias("ref"))
    out = overlap_scores(named, least)
    return out.select(F.col("a.variant").alias("variant"), F.col("a.paper").alias("a"), F.col("b.paper").alias("b"), *[c for c in out.columns if c not in ("a", "b")])


def _overlap_by_bits(refs: DataFrame, intents: list[str], least: float) -> DataFrame:
    """overlap_by_intent with a bit a variant.

    Pairs are counted in rounds of about ``PAIRS_A_ROUND`` shared references, by a hash of the first
    paper, so that their shuffle files never lie on disk together. Of a pair with one shared reference
    only variants small enough for one to reach ``least`` are kept; sizes are joined to what is left.
    """
    names = list(dict.fromkeys(["overall", "overall_infl", *[x for i in intents for x in (i, f"{i}_infl")]]))
    bit = {n: 1 << k for k, n in enumerate(names)}

    def mark(suffix: str) -> Column:
        own = F.lit(0).cast("long")
        for i in intents:
            own = F.when(F.col("intent") == i, F.lit(bit[i + suffix]).cast("long")).otherwise(own)
        return own.bitwiseOR(F.lit(bit["overall" + suffix]).cast("long"))

    masks = mark("").bitwiseOR(F.when(F.col("influential"), mark("_infl")).otherwise(F.lit(0).cast("long")))
    has = lambda c, n: F.col(c).bitwiseAND(F.lit(bit[n]).cast("long")) != 0
    held = stored(refs.filter("paper IS NOT NULL").groupBy("paper", "ref").agg(F.bit_or(masks).alias("mask")), "refs")
    sizes = stored(held.groupBy("paper").agg(F.array(*[F.count_if(has("mask", n)) for n in names]).alias("n")), "ref-sizes")
    # a field of each variant, wide enough for the largest count, in words of 62 bits: sums of words are all counts
    width = max(1, (sizes.agg(F.max(F.array_max("n"))).first()[0] or 0).bit_length())
    fields = {n: (k // (62 // width), k % (62 // width) * width) for k, n in enumerate(names)}
    words = [f"w{j}" for j in range(max(j for j, _ in fields.values()) + 1)]

    def packed(flag) -> list[Column]:
        return [reduce(Column.bitwiseOR, [F.when(flag(n), F.lit(1 << shift).cast("long")).otherwise(F.lit(0).cast("long")) for n, (j, shift) in fields.items() if f"w{j}" == w]) for w in words]

    easy = packed(lambda n: F.lit(1) / F.nullif(F.get("n", names.index(n)), F.lit(0)) >= least)
    marked = stored(held.filter("ref IS NOT NULL").join(sizes.select("paper", *[c.alias(f"easy_{w}") for c, w in zip(easy, words, strict=True)]), "paper").select("paper", "ref", *[c.alias(w) for c, w in zip(packed(lambda n: has("mask", n)), words, strict=True)], *[f"easy_{w}" for w in words]), "refs-marked")
    discard(held)
    pairs = marked.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    rounds = max(1, math.ceil(pairs / PAIRS_A_ROUND))
    tasks = max(1, math.ceil(pairs / rounds / PAIRS_A_TASK * 4))  # rows that are shuffled, not only made
    other = marked.select("ref", F.col("paper").alias("b"), *[F.col(c).alias(f"b_{c}") for c in marked.columns if c not in ("paper", "ref")])

    def counted(k: int) -> DataFrame:
        left = marked.filter(F.pmod(F.xxhash64("paper"), F.lit(rounds)) == k)
        both = left.withColumnRenamed("paper", "a").join(other, "ref").filter("a < b")
        shared = {w: F.col(w).bitwiseAND(F.col(f"b_{w}")) for w in words}
        alone = {w: shared[w].bitwiseAND(F.col(f"easy_{w}").bitwiseOR(F.col(f"b_easy_{w}"))) for w in words}
        met = both.select("a", "b", *[c.alias(w) for w, c in shared.items()], *[c.alias(f"easy_{w}") for w, c in alone.items()])
        # dealt before they are counted: few pairs of a task come twice, and partial counts would only spill
        sums = met.repartition(tasks, "a", "b").groupBy("a", "b").agg(*[F.sum(w).alias(w) for w in words], *[F.bit_or(f"easy_{w}").alias(f"easy_{w}") for w in words], F.count(F.lit(1)).alias("refs"))
        left = sums.filter(reduce(Column.__or__, [F.col(f"easy_{w}") != 0 for w in words], F.col("refs") > 1))
        field = lambda c, shift: F.shiftright(c, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        found = [F.struct(F.lit(v).alias("v"), field(f"w{j}", shift).alias("inter"), field(f"easy_w{j}", shift).alias("easy")) for v, (j, shift) in enumerate(fields.values())]
        return left.select("a", "b", F.inline(F.array(*found))).filter("inter > 1 OR easy <> 0").select("a", "b", "v", "inter")

    def scored(k: int) -> DataFrame:
        out = counted(k)
        for side in ("a", "b"):
            out = out.join(sizes.select(F.col("paper").alias(side), "n"), side).withColumn(f"len_{side}", F.get("n", "v")).drop("n")
        out = out.withColumn("variant", F.get(F.array(*map(F.lit, names)), "v")).select("a", "b", "variant", "inter", "len_a", "len_b")
        return out.filter(F.greatest(F.col("inter") / F.col("len_a"), F.col("inter") / F.col("len_b")) >= least) if least else out

    parts = [scored(k) for k in range(rounds)] if rounds == 1 else [stored(scored(k), "overlaps") for k in range(rounds)]
    return _scores(reduce(DataFrame.unionByName, parts)).select("variant", "a", "b", *SCORES)


def direct_edges(refs: DataFrame, cites: DataFrame | None = None) -> DataFrame:
    """Papers of which one is among the other's references, or citations where given."""
    papers = refs.select("paper").distinct()
    pairs = refs.select("paper", F.col("ref").alias("other"))
    if cites is not None:
        pairs = pairs.unionByName(cites.select("paper", F.col("cite").alias("other")))
    return edges_of(pairs.join(papers.select(F.col("paper").alias("other")), "other", "left_semi"), "paper", "other")


def lift_edges(incidence: DataFrame, adjacency: DataFrame, include_self: bool = True) -> DataFrame:
    """Edges between tables whose nodes (node, table) are related, or the same with include_self."""
    inc = incidence.select("node", "table").distinct()
    near = mirror(adjacency)
    if include_self:
        near = near.unionByName(inc.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct())
    reach = inc.join(near, inc["node"] == near["src"]).select(F.col("table").alias("from"), F.col("dst").alias("node")).distinct()
    return edges_of(reach.join(inc.withColumnRenamed("table", "to"), "node"), "from", "to")


def _target_pairs(links: DataFrame) -> DataFrame:
    """(src, dst), each once, of the models in stored distinct links (model, target) that share a target.

    The models of a target are numbered in their order and dealt into runs, and runs into chunks. Each
    chunk meets each run from its own on in a cell, so that no target's pairs are one task's work, and a
    cell's pairs go out model by model, each with the whole run: in a file a constant and a repeated
    stretch, which take a small part of the room of pairs in any order.
    Of two models of which one has a single target there is one pair, which goes out as it is made. Only
    pairs of models that both have several targets can come again, and these alone are made distinct by
    a shuffle.
    """
    run = min(RUN, DEALT)
    several = links.groupBy("model").agg((F.count(F.lit(1)) > 1).alias("several"))
    again = not several.filter("several").isEmpty()
    placed = numbered(links, [F.col("target"), F.col("model")], "place")
    targets = stored(placed.groupBy("target").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "targets")
    rows = placed.join(targets, "target").withColumn("run", F.floor((F.col("place") - F.col("first")) / run).cast("int"))
    one = F.struct("model", "several") if again else F.col("model")
    model = lambda c: F.col(f"{c}.model") if again else F.col(c)
    rows = (rows.join(several, "model") if again else rows).groupBy("target", "n", "run").agg(F.sort_array(F.collect_list(one)).alias("models"))
    dealt = stored(rows.select("target", "run", "models", F.floor((F.col("n") - 1) / run).cast("int").alias("last")), "target-links")
    load = targets.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2 + 4 * F.col("n"))).first()[0] or 0
    tasks, cell = max(1, math.ceil(load / PAIRS_A_TASK)), ["target", "chunk", "other_run"]

    def met(rows: DataFrame) -> DataFrame:
        chunk = F.floor(F.col("run") / (DEALT // run)).cast("int")
        left = rows.select("target", chunk.alias("chunk"), "run", "models", F.explode(F.sequence("run", "last")).alias("other_run"))
        right = rows.select("target", F.explode(F.sequence(F.lit(0), chunk)).alias("chunk"), F.col("run").alias("other_run"), F.col("models").alias("others"))
        # a number of partitions that AQE doesn't lower: few rows make many pairs
        left = left.repartition(tasks, *cell).select(*cell, (F.col("run") < F.col("other_run")).alias("apart"), F.explode("models").alias("x"))
        # merged, as a broadcast of the models would make all pairs of a run at once and hold them
        both = left.join(right.repartition(tasks, *cell).hint("merge"), cell)
        return both.select("apart", "x", F.explode("others").alias("y")).filter(F.col("apart") | (model("x") < model("y")))

    ends = [model("x").alias("src"), model("y").alias("dst")]
    if not again:
        return met(dealt).select(*ends)
    many = dealt.withColumn("models", F.filter("models", lambda m: m["several"])).filter("size(models) > 0")
    return met(dealt).filter("NOT (x.several AND y.several)").select(*ends).unionByName(met(many).select(*ends).distinct())


def shared_target_edges(links: DataFrame, known: DataFrame | None = None, fold_case: bool = False) -> DataFrame:
    """Models (model, target) that share a target; with known models, also a model and its target.

    With fold_case targets are matched whatever their case, and known ones keep their own spelling.
    """
    if fold_case:
        links = links.withColumn("target", F.lower("target"))
        if known is not None:
            spelled = known.groupBy(F.lower("model").alias("target")).agg(F.min("model").alias("own"))
            links = links.join(spelled, "target", "left").select("model", F.coalesce("own", "target").alias("target"))
    links = stored(links.select("model", "target").filter("model IS NOT NULL AND target IS NOT NULL").distinct(), "links")
    pairs = _target_pairs(links)
    if known is None:
        return pairs
    named = stored(edges_of(links.join(known.select(F.col("model").alias("target")), "target", "left_semi"), "model", "target"), "known-links")
    # those whose ends share a target too are among the pairs
    own = links.select(F.col("model").alias("src"), F.col("target").alias("t"))
    both = named.join(own, "src").join(links.select(F.col("model").alias("dst"), F.col("target").alias("t")), ["dst", "t"], "left_semi").select("src", "dst")
    return pairs.unionByName(named.join(both, ["src", "dst"], "left_anti"))


def title_association(titles: DataFrame) -> DataFrame:
    """(a, b, shared) of rows (row, title) that have a title in common, own or cited."""
    rows = titles.select("row", "title").distinct()
    return rows.alias("x").join(rows.alias("y"), "title").filter("x.row < y.row").groupBy(F.col("x.row").alias("a"), F.col("y.row").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def union_edges(*edges: DataFrame, restrict_to: DataFrame | None = None) -> DataFrame:
    """All edges of several graphs, between the nodes of ``restrict_to`` where given."""
    out = reduce(DataFrame.unionByName, [e.select("src", "dst") for e in edges]).distinct()
    if restrict_to is not None:
        nodes = restrict_to.select(F.col(restrict_to.columns[0]).alias("n")).distinct()
        out = out.join(nodes, out["src"] == nodes["n"], "left_semi").join(nodes, out["dst"] == nodes["n"], "left_semi")
    return out


def variant(edges: DataFrame, suffix: str) -> DataFrame:
    """The graph between augmented forms: names with a suffix before the extension."""
    name = lambda c: F.regexp_replace(F.col(c).cast("string"), r"(\.[^./]*)?$", "").alias(c)
    return edges.select(*[F.concat(name(c), F.lit(suffix), F.regexp_extract(F.col(c).cast("string"), r"(\.[^./]*)$", 1)).alias(c) for c in ("src", "dst")])


def pair_lookup(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with related: whether an edge joins them in either direction."""
    known = edges.select("src", "dst", F.lit(True).alias("hit"))
    keyed = pairs.withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})
    return keyed.join(known, ["src", "dst"], "left").select("a", "b", F.coalesce("hit", F.lit(False)).alias("related"))


def coverage(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """queries (q) with whether each has an edge as src, as dst, and either."""
    src, dst = edges.select(F.col("src").alias("q")).distinct().withColumn("s", F.lit(True)), edges.select(F.col("dst").alias("q")).distinct().withColumn("d", F.lit(True))
    both = queries.select("q").distinct().join(src, "q", "left").join(dst, "q", "left")
    return both.select("q", F.coalesce("s", F.lit(False)).alias("as_src"), F.coalesce("d", F.lit(False)).alias("as_dst"), (F.col("s").isNotNull() | F.col("d").isNotNull()).alias("covered"))


def degrees(edges: DataFrame) -> DataFrame:
    return mirror(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbor) of the given nodes."""
    both = mirror(edges)
    return both.join(nodes.select(F.col(nodes.columns[0]).alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("neighbor"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component), the component being its smallest node; nodes without edges are their own."""
    found = star_forest(edges)
    if nodes is None:
        return found
    own = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return own.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
