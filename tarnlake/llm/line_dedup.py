"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its words. Lines with the same set are one class, known by its first line (in
the order of doc_id, hash of the text, line). The words of a class are put in order of rarity. Two
classes whose Jaccard similarity is at least 0.8 share ``SHARED`` words among the first
``size - ceil(0.8 size) + SHARED`` of both (prefix filter), differ little in size (length filter),
have enough words left from a shared one on (positional filter) and few bits of difference between
their sketches (the parity of the words in 64 places: a set difference of d words turns d bits at most).
What passes is verified on the words themselves. A line goes if an earlier line has its set or is
similar to it.

Rarity: words are counted in ``BUCKETS`` hashed buckets, a table of fixed size, and a word weighs the
logarithm of its bucket's count. Any order gives right results; this one is close to that of exact
counts without a shuffle of words.

A class needs one earlier match only, so in a first round the classes that share a word with more
than ``CROWD`` others meet the earliest class of each such word, which is one row a word however
large a group of near copies is. Only the classes that this leaves open meet all earlier classes in
the second round. A word's bucket bounds its rows: words of buckets up to ``TASK_ROWS`` are dealt by
word, heavier ones are joined in a way that AQE may split.

Classes are told by 64 bits of a hash over the sorted words. A line whose own text differs from that
of its class's first line is not taken to be equal to it but verified on the words, like a similar one.

Defined results: blank lines and null texts have no words and are never removed; a null text has one
blank line; of rows with equal doc_id and text all but one come later than that one, and so lose
every line with words; rows without an id come first; only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.session import discard, near, stored

BITS = 18
BUCKETS = 1 << BITS
#: Words of their prefixes that similar classes share; 1 is the plain prefix filter.
SHARED = 2
#: Classes of a prefix word from which on they meet its earliest class first.
CROWD = 32
#: Rows of a word that may meet in one task.
TASK_ROWS = 1 << 17
#: Steps of weight for each doubling of a count; a weight takes 7 bits, the hash of a word 56 (a negative number would come first).
STEPS, HASH_BITS = 3, 56
BLANKS = "\t\x0b\x0c\r"
NO_ID = -(1 << 63)
KEY = ("k", "h", "n")
EARLIER = ("ek", "eh", "en")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(k, h, n, line): documents' lines, by id, hash of the text and number."""
    return _keyed(docs).select("k", "h", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def words_of(line: Column) -> Column:
    """The words of a line, among them empty ones where blanks follow each other."""
    for blank in BLANKS:
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.split(line, " ")


def word_set(line: Column) -> Column:
    return F.array_remove(F.array_distinct(words_of(line)), "")


def _bucket(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BITS).cast("int")


def weight_of(count: int) -> int:
    return min(127, 1 + int(STEPS * math.log2(max(1, count))))


def rarity_table(docs: DataFrame) -> list[int]:
    """The weight of each bucket, collected in 1,024 strings whatever the corpus."""
    words = docs.filter("text IS NOT NULL").select(F.explode(words_of(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).filter("w <> ''")
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.groupBy(F.col("b").bitwiseAND(1023)).agg(F.array_join(F.collect_list(F.concat_ws(":", F.col("b").cast("string"), F.col("n").cast("string"))), ",").alias("found"))
    table = [0] * BUCKETS
    for r in parts.select("found").collect():
        for entry in r["found"].split(","):
            b, n = entry.split(":")
            table[int(b)] = weight_of(int(n))
    return table


def rare_first(line: Column, table: list[int]) -> Column:
    """The distinct words of a line as sorted numbers: 7 bits of weight, 56 of a hash."""
    weights = F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")

    def number(h: Column) -> Column:
        return F.shiftleft(F.get(weights, _bucket(h)).cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND((1 << HASH_BITS) - 1))

    keys = F.sort_array(F.array_distinct(F.transform(F.transform(words_of(line), lambda w: F.xxhash64(w)), number)))
    return F.array_remove(keys, number(F.xxhash64(F.lit(""))))


def numbered(lines: DataFrame, table: list[int]) -> DataFrame:
    """(k, h, n, t, sig, size, sketch, prefix) of every line: hashes of its text and its set, its size, parities and rarest words."""
    rows = lines.select(*KEY, F.xxhash64("line").alias("t"), rare_first(F.col("line"), table).alias("keys")).withColumn("size", F.size("keys"))
    sketch = F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))
    length = (F.col("size") - F.floor((F.col("size") * 8 + 9) / 10) + SHARED).cast("int")
    # smaller sets than four words can't be similar to another one
    return rows.select(*KEY, "t", F.xxhash64("keys").alias("sig"), "size", sketch.alias("sketch"), F.slice("keys", F.lit(1), F.when(F.col("size") >= 4, F.least("size", length)).otherwise(0)).alias("prefix"))


def line_classes(rows: DataFrame) -> DataFrame:
    """(sig, size, several, k, h, n, t, sketch, prefix) of each set of words, with its first line and whether it has others."""
    first = rows.filter("size > 0").select("sig", "size", F.struct(*KEY, "t", "sketch", "prefix").alias("first"))
    return first.groupBy("sig", "size").agg(F.min("first").alias("first"), (F.count(F.lit(1)) > 1).alias("several")).select("sig", "size", "several", "first.*")


def members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(k, h, n, size, fk, fh, fn, alike) of every line: the first line of its class and whether the texts are equal."""
    named = classes.filter("several").select("sig", "size", *[F.col(c).alias(f"f{c}") for c in (*KEY, "t")])
    shared = rows.filter("size > 0").join(near(named), ["sig", "size"]).select(*KEY, "size", "fk", "fh", "fn", (F.col("t") == F.col("ft")).alias("alike"))
    alone = classes.filter("NOT several").select(*KEY, "size")
    alone = alone.unionByName(rows.filter("size = 0").select(*KEY, "size"))
    return shared.unionByName(alone.select(*KEY, "size", *[F.col(c).alias(f"f{c}") for c in KEY], F.lit(True).alias("alike")))


def prefixes(classes: DataFrame, *more: str) -> DataFrame:
    """(token, k, h, n, size, pos, sketch) of the prefix words of each class."""
    return classes.select(F.posexplode("prefix").alias("pos", "token"), *KEY, "size", "sketch", *more)


def _passes(e: str, open_: Column | int = 1) -> Column:
    """Order, length, positions and sketches of a class that is open (1, else 0) and an earlier one that share a word."""
    sx, sy, px, py = F.col("size"), F.col(f"{e}size"), F.col("pos"), F.col(f"{e}pos")
    before = F.struct(*[F.col(f"{e}{c}") for c in KEY]) < F.struct(*KEY)
    # words from the shared one on, positions counting from 0, and those of the first SHARED before it
    left = F.least(sx - px, sy - py) + SHARED - 1
    apart = F.bit_count(F.col("sketch").bitwiseXOR(F.col(f"{e}sketch")))
    # shared words are at least 4/9 of both sizes, so words in one set only are a ninth of them at most
    return (sx * 10 >= sy * 8) & (sy * 10 >= sx * 8) & (left * open_ * 9 >= (sx + sy) * 4) & (apart * 9 <= sx + sy) & before


def _pair(e: str) -> list:
    return [*KEY, *[F.col(f"{e}{c}").alias(f"e{c}") for c in KEY]]


def led(classes: DataFrame) -> DataFrame:
    """(k, h, n, ek, eh, en): the classes of crowded prefix words with the earliest class of each such word."""
    rows = prefixes(classes)
    # what a word's rows come to are numbers, and a join to them that keeps the earliest rows or pairs only
    heads = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("lk")).filter(F.col("c") > CROWD).select("token", "lk")
    crowds = stored(heads, "line-crowds")
    first = F.min(F.struct(*[F.col(c).alias(f"l{c}") for c in (*KEY, "size", "pos", "sketch")])).alias("first")
    earliest = rows.join(near(crowds), ["token"]).filter(F.col("k") == F.col("lk")).groupBy("token").agg(first)
    firsts = stored(earliest.select("token", "first.*"), "line-firsts")
    pairs = stored(rows.join(near(firsts), "token").filter(_passes("l")).select(*_pair("l")).distinct(), "line-led")
    discard(crowds, firsts)
    return pairs


def met(classes: DataFrame, known: DataFrame) -> DataFrame:
    """(k, h, n, ek, eh, en): the classes that are not known to be similar with all earlier classes of their prefix words.

    Whether a class is open is the lowest bit of ``mark``, so that both sides of the light words' join
    have the same columns and filters, and read one exchange.
    """
    marked = classes.join(near(known.withColumn("gone", F.lit(True))), list(KEY), "left").withColumn("open", F.col("gone").isNull().cast("int"))
    weight = lambda token: F.shiftrightunsigned(token, HASH_BITS)
    bound = weight_of(TASK_ROWS)
    rows = lambda df: prefixes(df, "open").select("token", *KEY, "size", "sketch", (F.col("pos") * 2 + F.col("open")).alias("mark"))
    light = rows(marked).filter(weight(F.col("token")) <= bound).repartition("token")
    # the heaviest word of a prefix is its last
    heavy = rows(marked.filter(weight(F.try_element_at("prefix", F.lit(-1))) > bound)).filter(weight(F.col("token")) > bound)
    out = None
    for part in (light, heavy):
        earlier = part.select("token", *[F.col(c).alias(f"e{c}") for c in (*KEY, "size", "sketch", "mark")])
        both = part.join(earlier, "token").withColumn("pos", F.shiftright("mark", 1)).withColumn("epos", F.shiftright("emark", 1))
        pairs = both.filter(_passes("e", F.col("mark") % 2)).select(*_pair("e"))
        out = pairs if out is None else out.unionByName(pairs)
    pair = [*KEY, *EARLIER]
    return out.groupBy(*pair).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= SHARED).select(*pair)


def _asked_lines(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(k, h, n, words) of the lines asked for, once each; by broadcast where these are few."""
    asked, texts = stored(asked.distinct(), "line-asked"), stored(asked.select("k", "h").distinct(), "line-asked")
    found = _keyed(docs).join(near(texts), ["k", "h"], "left_semi")
    lines = found.select("k", "h", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    # repeated rows have the same lines
    once = lines.join(near(asked), list(KEY)).groupBy(*KEY).agg(F.first("line").alias("line"))
    read = stored(once.select(*KEY, word_set(F.col("line")).alias("words")), "line-texts")
    discard(asked, texts)
    return read


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(k, h, n) of the lines that are similar to the earlier line they are paired with."""
    held = stored(pairs, "line-pairs")
    if held.isEmpty():
        return held.select(*KEY)
    read = _asked_lines(docs, held.select(*KEY).unionByName(held.select(*[F.col(e).alias(c) for c, e in zip(KEY, EARLIER, strict=True)])))
    other = read.select(*[F.col(c).alias(e) for c, e in zip(KEY, EARLIER, strict=True)], F.col("words").alias("ewords"))
    both = held.join(other, list(EARLIER)).join(read, list(KEY))
    shared = F.size(F.array_intersect("words", "ewords"))
    out = stored(both.filter(shared * 9 >= (F.size("words") + F.size("ewords")) * 4).select(*KEY).distinct(), "line-similar")
    discard(held, read)
    return out


def line_marks(docs: DataFrame) -> DataFrame:
    """(k, h, n, size, removed) of every line."""
    lines = lines_of(docs)
    rows = stored(numbered(lines, rarity_table(docs)), "line-rows")
    classes = stored(line_classes(rows), "line-classes")
    member = stored(members(rows, classes), "line-members")
    discard(rows)
    twins = member.filter("size > 0 AND NOT alike AND NOT (k = fk AND h = fh AND n = fn)").select(*KEY, *[F.col(f"f{c}").alias(f"e{c}") for c in KEY])
    known = _verified(led(classes), docs)
    later = _verified(met(classes, known).unionByName(twins), docs)
    discard(classes)
    gone = stored(known.unionByName(later).distinct(), "line-gone")
    discard(known, later)
    classed = gone.select(*[F.col(c).alias(f"f{c}") for c in KEY], F.lit(True).alias("class_gone"))
    own = gone.withColumn("own_gone", F.lit(True))
    first = (F.col("k") == F.col("fk")) & (F.col("h") == F.col("fh")) & (F.col("n") == F.col("fn"))
    marked = member.join(near(classed), ["fk", "fh", "fn"], "left").join(near(own), list(KEY), "left")
    removed = F.coalesce("class_gone", F.lit(False)) | F.coalesce("own_gone", F.lit(False)) | (~first & F.col("alike"))
    return marked.select(*KEY, "size", F.when(F.col("size") > 0, removed).otherwise(False).alias("removed"))


def _by_document(docs: DataFrame) -> DataFrame:
    """(k, h, n_lines, copies, gone, worded): the lines that go from the first of equal rows, and from the others."""
    marks = line_marks(docs)
    numbers = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("n"))))
    return marks.groupBy("k", "h").agg((F.max("n") + 1).cast("long").alias("n_lines"), F.sum((F.col("n") == 0).cast("int")).alias("copies"), numbers(F.col("removed")).alias("gone"), numbers(F.col("size") > 0).alias("worded"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed lines' numbers, for every row."""
    rows = _by_document(docs).select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    gone = F.when(F.col("copy") == 1, F.col("gone")).otherwise(F.col("worded"))
    return rows.select(F.nullif(F.col("k"), F.lit(NO_ID)).alias("doc_id"), "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(F.transform(gone, lambda n: n.cast("string")), ",").alias("removed_lines"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left, for every row; a null text comes back as an empty one."""
    texts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).cast("int").alias("rows"))
    keyed = texts.select("*", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.xxhash64("text").alias("h"), F.explode(F.sequence(F.lit(1), "rows")).alias("copy"))
    joined = keyed.join(_by_document(docs).select("k", "h", "gone", "worded"), ["k", "h"])
    gone = F.when(F.col("copy") == 1, F.col("gone")).otherwise(F.col("worded"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    return joined.select("doc_id", F.array_join(kept, "\n").alias("text"))
