"""Pair sampling, agreement of judges, kappas and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.order import running_sums


def hash_order(*columns: Column, seed: int = 42) -> Column:
    """A key that puts rows in an order that looks random and is the same in every run and engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def labelled_pairs(pairs: DataFrame, graphs: dict[str, DataFrame]) -> DataFrame:
    """pairs (a, b) with a 0/1 column for each graph and their combination as a string of digits."""
    out = pairs.select("a", "b", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    for name, edges in graphs.items():
        out = out.join(edges.select("src", "dst", F.lit(1).alias(name)).distinct(), ["src", "dst"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select("a", "b", *graphs, F.concat(*[F.col(n).cast("string") for n in graphs]).alias("combination"))


def sample_pairs_8way(labelled: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """A sample of ``total`` pairs spread over the label combinations, the rarest served first.

    Each combination gets an equal share; what a rare one can't fill is shared out again among the
    rest. Pairs are taken in hash order. Combinations are at most two to the number of graphs.
    """
    sizes = sorted((r["n"], r["combination"]) for r in labelled.groupBy("combination").agg(F.count(F.lit(1)).alias("n")).collect())
    quota, left = {}, total
    for i, (n, name) in enumerate(sizes):
        quota[name] = min(n, left // (len(sizes) - i))
        left -= quota[name]
    if not quota:
        return labelled
    limit = reduce(lambda w, x: w.when(F.col("combination") == x[0], x[1]), quota.items(), F.when(F.lit(False), 0)).otherwise(0)
    order = Window.partitionBy("combination").orderBy(hash_order(F.col("a"), F.col("b"), seed=seed), "a", "b")
    return labelled.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit).drop("r")


def balanced_pairs(labelled: DataFrame, label: str, total: int, positive: float = 0.5, seed: int = 42) -> DataFrame:
    """Pairs with and without a label in the given share, in hash order."""
    want = round(total * positive)
    order = Window.partitionBy(label).orderBy(hash_order(F.col("a"), F.col("b"), seed=seed), "a", "b")
    return labelled.withColumn("r", F.row_number().over(order)).filter(F.when(F.col(label) == 1, F.col("r") <= want).otherwise(F.col("r") <= total - want)).drop("r")


def majority(votes: DataFrame) -> DataFrame:
    """(pair, vote, consistency, unanimous, n) of votes (pair, judge, vote); ties go to the vote of the first judge."""
    per = votes.groupBy("pair", "vote").agg(F.count(F.lit(1)).alias("c"), F.min("judge").alias("first"))
    best = per.groupBy("pair").agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "vote")).alias("b"), F.sum("c").alias("n"))
    share = -F.col("b.c") / F.col("n")
    return best.select("pair", F.col("b.vote").alias("vote"), F.round(share, 6).alias("consistency"), (share == 1).alias("unanimous"), F.col("n").cast("long").alias("n"))


def confusion(judged: DataFrame, truth: str = "truth", vote: str = "vote") -> DataFrame:
    """One row: tp, fp, tn, fn, unsure, accuracy over all rows, precisions of YES and NO."""
    yes, no, t = F.col(vote) == "YES", F.col(vote) == "NO", F.col(truth) == 1
    out = judged.agg(*[F.count_if(c).alias(n) for n, c in (("tp", yes & t), ("fp", yes & ~t), ("tn", no & ~t), ("fn", no & t), ("unsure", ~yes & ~no))], F.count(F.lit(1)).alias("n"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return out.select("tp", "fp", "tn", "fn", "unsure", ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_yes"), ratio(F.col("tn"), F.col("tn") + F.col("fn")).alias("precision_no"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(po, pe, kappa) of two raters' columns; rows with a null are left out."""
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    left = rows.groupBy(F.col(a).alias("label")).agg(F.count(F.lit(1)).alias("x"))
    right = rows.groupBy(F.col(b).alias("label")).agg(F.count(F.lit(1)).alias("y"))
    pe = left.join(right, "label").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).cast("double").alias("xy"))
    out = n.crossJoin(F.broadcast(pe)).withColumn("pe", F.col("xy") / (F.col("n").cast("double") * F.col("n")))
    return out.select(F.round("po", 6).alias("po"), F.round("pe", 6).alias("pe"), F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def fleiss_kappa(votes: DataFrame) -> DataFrame:
    """(kappa) of votes (pair, judge, vote), each pair having as many judges as the others."""
    per = votes.groupBy("pair", "vote").agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = per.groupBy("pair").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    p = pairs.agg(F.avg((F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p"), F.sum("n").alias("all"))
    share = per.groupBy("vote").agg(F.sum("c").alias("c")).crossJoin(F.broadcast(p)).agg(F.sum((F.col("c") / F.col("all")) * (F.col("c") / F.col("all"))).alias("pe"), F.first("p").alias("p"))
    return share.select(F.round((F.col("p") - F.col("pe")) / (1 - F.col("pe")), 6).alias("kappa"))


def merged_responses(first: DataFrame, retried: DataFrame) -> DataFrame:
    """Responses by pair; a retried one takes the place of the first where it is not null."""
    both = first.join(retried.withColumnRenamed("response", "again"), "pair", "full")
    return both.select("pair", F.coalesce("again", "response").alias("response"))


def threshold_sweep(scores: DataFrame, points: int = 100) -> DataFrame:
    """(threshold, tp, fp, f1, youden, balanced_accuracy, mcc, g_mean, iba) over an even grid, of (score, label).

    iba is the index of balanced accuracy, balanced accuracy times one plus the dominance of either rate.
    Scores are counted by grid cell first, so the window runs over as many rows as there are points.
    """
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    cell = F.least(F.lit(points - 1), F.floor((F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * points)).cast("int")
    counts = scores.crossJoin(F.broadcast(ends)).groupBy(cell.alias("cell"), "lo", "hi").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") != 1).cast("long")).alias("n"))
    above, whole = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    at = counts.select((F.col("lo") + F.col("cell") * (F.col("hi") - F.col("lo")) / points).alias("threshold"), F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(whole).alias("all_p"), F.sum("n").over(whole).alias("all_n"))
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "all_p", "all_n"))
    fn, tn = pos - tp, neg - fp
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tpr, tnr = ratio(tp, pos), ratio(tn, neg)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * pos * neg * (tn + fn)))
    return at.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", *[F.round(c, 6).alias(n) for n, c in (("f1", ratio(2 * tp, 2 * tp + fp + fn)), ("youden", tpr + tnr - 1), ("balanced_accuracy", (tpr + tnr) / 2), ("mcc", mcc), ("g_mean", F.sqrt(tpr * tnr)), ("iba", (tpr + tnr) / 2 * (1 + F.abs(tpr - tnr))))])


def otsu(scores: DataFrame, bins: int = 256) -> DataFrame:
    """(threshold) that parts a score column best into two classes, over ``bins`` bins."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    cell = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * bins)).cast("int")
    counts = scores.crossJoin(F.broadcast(ends)).groupBy(cell.alias("cell"), "lo", "hi").agg(F.count(F.lit(1)).cast("double").alias("c"))
    low, whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    s = counts.select("cell", "lo", "hi", F.sum("c").over(low).alias("w0"), F.sum(F.col("c") * F.col("cell")).over(low).alias("s0"), F.sum("c").over(whole).alias("w"), F.sum(F.col("c") * F.col("cell")).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    between = F.when(w1 > 0, F.col("w0") * w1 * gap * gap).otherwise(-1.0)
    best = s.orderBy(between.desc(), "cell").limit(1)
    return best.select(F.round(F.col("lo") + (F.col("cell") + 1) * (F.col("hi") - F.col("lo")) / bins, 6).alias("threshold"))


def welch_t(scores: DataFrame) -> DataFrame:
    """(t, df) of Welch's test between the scores of label 1 and the others."""
    one = lambda mark, n: [f(F.when(mark, F.col("score"))).alias(f"{k}{n}") for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    mark = F.col("label") == 1
    a = scores.agg(*one(mark, 1), *one(~mark, 0))
    s1, s0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return a.select(F.round((F.col("m1") - F.col("m0")) / F.sqrt(s1 + s0), 6).alias("t"), F.round((s1 + s0) * (s1 + s0) / (s1 * s1 / (F.col("n1") - 1) + s0 * s0 / (F.col("n0") - 1)), 6).alias("df"))


def rank_tests(scores: DataFrame) -> DataFrame:
    """(ks, u, z): the Kolmogorov-Smirnov distance and the Mann-Whitney statistic of label 1 against the others.

    Equal scores are counted first; the running counts go over ranges of the distinct scores.
    """
    counts = scores.groupBy("score").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") != 1).cast("long")).alias("q"))
    run = running_sums(counts, [F.col("score")], {"cp": F.col("p"), "cq": F.col("q")})
    sizes = counts.agg(F.sum("p").cast("double").alias("n1"), F.sum("q").cast("double").alias("n0"))
    run = run.crossJoin(F.broadcast(sizes))
    out = run.agg(F.max(F.abs(F.col("cp") / F.col("n1") - F.col("cq") / F.col("n0"))).alias("ks"), F.sum(F.col("p") * (F.col("cq") - F.col("q") + F.col("q") / 2)).alias("u"), F.first("n1").alias("n1"), F.first("n0").alias("n0"))
    z = (F.col("u") - F.col("n1") * F.col("n0") / 2) / F.sqrt(F.col("n1") * F.col("n0") * (F.col("n1") + F.col("n0") + 1) / 12)
    return out.select(F.round("ks", 6).alias("ks"), F.round("u", 1).alias("u"), F.round(z, 6).alias("z"))


def folds(rows: DataFrame, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Rows with a fold from 0, from a hash of the key."""
    return rows.withColumn("fold", F.conv(F.substring(hash_order(F.col(key), seed=seed), 1, 8), 16, 10).cast("long") % n)


def vote_splits(votes: DataFrame, n: int = 5) -> DataFrame:
    """(yes, no, unsure, pairs): how often pairs of n votes divide in which way, as in 3-2."""
    count = lambda v: F.count_if(F.col("vote") == v)
    per = votes.groupBy("pair").agg(count("YES").alias("yes"), count("NO").alias("no"), count("UNSURE").alias("unsure"), F.count(F.lit(1)).alias("n"))
    return per.filter(F.col("n") == n).groupBy("yes", "no", "unsure").agg(F.count(F.lit(1)).alias("pairs"))


def unsure_rate(votes: DataFrame, by: str) -> DataFrame:
    """(by, n, unsure, rate) of votes by a judge's, model's or level's column."""
    rows = votes.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vote") == "UNSURE").alias("unsure"))
    return rows.withColumn("rate", F.round(F.col("unsure") / F.col("n"), 6))


def confusion_by(judged: DataFrame, level: str, truth: str = "truth", vote: str = "vote") -> DataFrame:
    """(level, tp, fp, tn, fn, unsure, accuracy): the confusion of each level."""
    yes, no, t = F.col(vote) == "YES", F.col(vote) == "NO", F.col(truth) == 1
    out = judged.groupBy(level).agg(*[F.count_if(c).alias(n) for n, c in (("tp", yes & t), ("fp", yes & ~t), ("tn", no & ~t), ("fn", no & t), ("unsure", ~yes & ~no))], F.count(F.lit(1)).alias("n"))
    return out.select(level, "tp", "fp", "tn", "fn", "unsure", F.round((F.col("tp") + F.col("tn")) / F.col("n"), 6).alias("accuracy"))


def signal_agreement(signals: DataFrame, truth: str, *names: str) -> DataFrame:
    """(signal, n, agree, rate): how often each boolean column says what the truth column does."""
    parts = [F.struct(F.lit(n).alias("signal"), (F.col(n).cast("int") == F.col(truth).cast("int")).alias("same")) for n in names]
    rows = signals.select(F.explode(F.array(*parts)).alias("x")).select("x.*").filter("same IS NOT NULL")
    return rows.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("agree")).withColumn("rate", F.round(F.col("agree") / F.col("n"), 6))


def graph_agreement(graphs: dict[str, DataFrame]) -> DataFrame:
    """(a, b, shared, either, agreement): shared edges of each two graphs over all edges of either."""
    names = sorted(graphs)
    marked = reduce(DataFrame.unionByName, [graphs[n].select("src", "dst", F.lit(n).alias("graph")) for n in names]).distinct()
    sets = marked.groupBy("src", "dst").agg(F.collect_set("graph").alias("s"))  # one entry a graph
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.array_contains("s", a).alias("x"), F.array_contains("s", b).alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = sets.select(F.explode(F.array(*rows)).alias("p")).select("p.*").filter("x OR y")
    return found.groupBy("a", "b").agg(F.count_if(F.col("x") & F.col("y")).alias("shared"), F.count(F.lit(1)).alias("either")).withColumn("agreement", F.round(F.col("shared") / F.col("either"), 6))


def hybrid_threshold(scores: DataFrame) -> DataFrame:
    """(threshold): the lower of the least score with a direct link and the 95th percentile of the others."""
    direct = F.min(F.when(F.col("label") == 1, F.col("score")))
    rest = F.percentile(F.when(F.col("label") != 1, F.col("score")), F.lit(0.95))
    return scores.agg(F.round(F.least(direct, rest), 6).alias("threshold"))


def non_direct_p95(scores: DataFrame) -> DataFrame:
    """(threshold): the 95th percentile of the scores without a direct link."""
    return scores.filter("label <> 1").agg(F.round(F.percentile("score", F.lit(0.95)), 6).alias("threshold"))
