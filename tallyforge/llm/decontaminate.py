"""Benchmark decontamination: which documents hold a benchmark item, copied whole or nearly so.

Windows as long as an item get a SimHash fingerprint over their five-word shingles. A multi-index of Hamming
blocks pairs windows and items of one length whose fingerprints differ in at most RADIUS bits, without a miss:
of BLOCKS blocks one has at most RADIUS / BLOCKS errors, and all such errors are enumerated on the items' side.
Exact similarity of the shingle multisets decides. Only windows that line up with a shared shingle are made, and
only for items of which a document holds enough shingles: without these, no similarity of ``least`` is possible.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

SHINGLE = 5
BITS, BLOCKS, RADIUS = 64, 8, 24
# Items of at most so many words in all are broadcast at once; more are taken in blocks of that size.
MOST_WORDS = 500_000


def words(text: Column) -> Column:
    """Words of a text, lower-cased; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(of: Column) -> Column:
    """Hashes of all runs of five words, repeats included."""
    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
        return F.when(F.size(w) >= SHINGLE, made).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(of), runs)[0]  # the lambda's variable holds the words, which are made once


def simhash(hashes: Column) -> Column:
    """64 bits: each the sign of the sum over all shingles, repeats weighing more."""
    one = F.lit(1).cast("bigint")

    def bit(acc, b):
        ones = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.getbit(h, b).cast("int"))
        return F.when(ones * 2 > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), bit)


def _blocks(print_: Column) -> Column:
    width = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(print_, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("value")) for k in range(BLOCKS)])


def _errors() -> list[int]:
    """All patterns of at most RADIUS // BLOCKS wrong bits in a block."""
    width = BITS // BLOCKS
    return [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(width), k)]


def similarity(a: Column, b: Column) -> Column:
    """Sum of least over sum of greatest counts of two shingle multisets."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def _short(docs: DataFrame, benchmark: DataFrame, shortest: int) -> DataFrame:
    """Items of ``shortest`` to four words are one shingle each: documents that hold one word for word."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w")).where((F.col("n_words") >= shortest) & (F.col("n_words") < SHINGLE))
    items = items.select("item_id", "n_words", F.xxhash64("w").alias("hash")).distinct()
    runs = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(F.lit(n).alias("n_words"), (i - 1).alias("at"), F.xxhash64(F.slice(w, i, n)).alias("hash"))))
    lengths = [r.n_words for r in items.select("n_words").distinct().collect()]  # at most four numbers
    read = docs.select("doc_id", words(F.col("text")).alias("w"))
    out = None
    for n in lengths:
        found = read.select("doc_id", F.explode(runs(F.col("w"), n)).alias("r")).select("doc_id", "r.*").join(items, ["n_words", "hash"])
        found = found.groupBy("doc_id", "item_id", "n_words").agg(F.min("at").alias("at"))
        found = found.select("doc_id", "item_id", "at", "n_words", F.lit(1.0).alias("similarity"))
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, shortest: int = SHINGLE) -> DataFrame:
    """Pairs with a similarity of ``least`` or more: doc_id, item_id, at (the window's first word), n_words, similarity.

    One row per pair: its best window, the first of equals. Null and empty texts match nothing. An item of fewer than five
    words says little about a document that holds it; items from ``shortest`` words on are matched whole, word for word; rows with equal ids count as one document (or item) that holds what any of them holds. Only
    doc_id, text and item_id, text are read, so other columns can't clash. Empty tables give no rows.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w"))
    items = written(items.select("item_id", F.size("w").alias("n_words"), shingles(F.col("w")).alias("own")).where("size(own) > 0").distinct(), "items")
    total = items.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // MOST_WORDS))
    out = None
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else items
        found = _against(docs, part, least)
        out = found if out is None else out.union(found)
    if shortest < SHINGLE and (short := _short(docs, benchmark, shortest)) is not None:
        out = out.unionByName(short)
    best = W.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "at", "n_words")
    return out.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def _against(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    terms = items.select("item_id", "n_words", F.size("own").alias("n_own"), F.posexplode("own").alias("item_pos", "hash"))
    read = docs.select("doc_id", shingles(words(F.col("text"))).alias("all"))
    hits = (
        read.where("size(all) > 0").select("doc_id", "all", F.posexplode("all").alias("pos", "hash"))
        .join(F.broadcast(terms), "hash")
        .withColumn("start", F.greatest(F.col("pos") - F.col("item_pos"), F.lit(0)))
        # the window's shingles; at the text's ends it may be shorter than the item
        .withColumn("own", F.slice("all", F.col("start") + 1, F.least(F.col("pos") - F.col("item_pos"), F.lit(0)) + F.col("n_own")))
        .select("doc_id", "item_id", "item_pos", "start", "n_words", "n_own", "own")
    )
    hits = written(hits.groupBy("doc_id", "item_id", "start", "n_words", "n_own", "own").agg(F.collect_set("item_pos").alias("items_pos")), "hits")
    # an item of which a document holds too few shingles can't be similar enough at any place
    enough = (
        hits.select("doc_id", "item_id", "n_own", F.explode("items_pos").alias("p")).groupBy("doc_id", "item_id", "n_own")
        .agg(F.countDistinct("p").alias("n")).where(F.col("n") >= F.col("n_own") * least)
    )
    a, b = hits.alias("a"), enough.alias("b")
    keep = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.item_id").eqNullSafe(F.col("b.item_id")), "left_semi")
    windows = keep.select("doc_id", "start", "n_words", "own").distinct().withColumn("print", simhash(F.col("own")))
    index = items.select("item_id", "n_words", F.col("own").alias("item"), simhash(F.col("own")).alias("item_print"))
    index = index.withColumn("b", F.explode(_blocks(F.col("item_print")))).withColumn("e", F.explode(F.array(*map(F.lit, _errors()))))
    index = index.select("item_id", "n_words", "item_print", F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("e")).alias("value"))
    keyed = windows.withColumn("b", F.explode(_blocks(F.col("print")))).select("doc_id", "start", "n_words", "own", "print", "b.block", "b.value")
    near = (
        keyed.join(index, ["n_words", "block", "value"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("doc_id", "item_id", "start", "n_words", "own").distinct()
    )
    x, y = near.alias("x"), items.select("item_id", F.col("own").alias("item")).alias("y")
    pairs = x.join(y, F.col("x.item_id").eqNullSafe(F.col("y.item_id")) & (F.size("item") + SHINGLE - 1 == F.col("n_words")))
    pairs = pairs.select("x.doc_id", "x.item_id", F.col("start").alias("at"), "n_words", similarity(F.col("own"), F.col("item")).alias("similarity"))
    return pairs.where(F.col("similarity") >= least)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay."""
    bad = contaminated(docs, benchmark, least).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
