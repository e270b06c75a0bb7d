"""Ranked lexical search with block-max pruning.

The index is a forward one: a block is a range of documents in the table's order, with each document's terms and counts,
and beside it the greatest impact that any of its documents has for each of its terms. The sum of an item's weighted
maxima bounds the score of all documents in a block. An item's blocks are taken from the highest bound down, in bands
that grow; a band is scored from the forward index, and what stays below the item's k-th best score so far is never
scored. Scores are whole numbers, so a block at the threshold can still hold a tie and is scored too.

Documents never move: blocks are made where their rows are read, and read a few at a time. Of a search only bounds (item,
block), k best rows of each task and item, and the chosen blocks' numbers are shuffled.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, written

# A block ends with so many documents, or sooner with so many postings.
BLOCK_DOCS, BLOCK_POSTINGS = 128, 1 << 17
# Terms of items that go to every task at once; more items are searched in several parts.
MOST_TERMS = 100_000
# Blocks of an item in the first band, and how many times as many with each further one.
FIRST, GROWTH = 16, 8
# Numbers of blocks that are broadcast to the forward index, so that only these go to Python; beyond, all do.
MOST_CHOSEN = 1 << 20
# Items that are scored at once in a block.
TILE = 256
# Blocks that are read and go to Python at once, and that a row group holds: a row is a block, so Spark's usual thousands of rows
# would be a whole file in memory. Texts that are read at once.
BATCH, GROUP, TEXTS = 8, 32, 512

_TERM = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and everything beyond ASCII, of which only A-Z are lower-cased; none of null."""
    return text.translate(_TERM).split() if text else []


@contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """What runs within reads Parquet, and goes to Python, in batches of so many rows."""
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(rows))
    try:
        yield
    finally:
        for n, x in zip(names, before):
            spark.conf.set(n, x)


def _of_blocks(df: DataFrame, name: str) -> DataFrame:
    """``df``, whose rows are blocks, written in row groups of GROUP rows."""
    return written(df, name, {"parquet.block.row.count.limit": str(GROUP)})


class Index(NamedTuple):
    """``blocks``: the forward index. ``maxima``: block, its terms, the greatest impact and the documents of each.
    ``n_docs``: documents with a term; ``n_terms``: all their terms with repeats."""

    blocks: DataFrame
    maxima: DataFrame
    n_docs: int
    n_terms: int


BLOCKS = "block bigint, n_docs bigint, n_terms bigint, ids array<bigint>, lengths array<bigint>, ends array<int>, terms array<binary>, term array<int>, tf array<int>"
MAXIMA = "block bigint, terms array<binary>, most array<bigint>, df array<int>"


def _lists(values, kind: pa.DataType) -> pa.Array:
    """One row that holds a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _blocked(docs: int, postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            columns = [pa.array([number]), pa.array([len(ids)]), pa.array([sum(lengths)]), _lists(ids, pa.int64()), _lists(lengths, pa.int64()), _lists(ends, pa.int32()), _lists(list(vocabulary), pa.binary()), _lists(term, pa.int32()), _lists(tf, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BLOCKS.split(", ")])

        ids, lengths, ends, vocabulary, term, tf = [], [], [], {}, [], []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                counts = Counter(terms(text.as_py()))
                if not counts:
                    continue
                if ids and (len(ids) >= docs or len(term) + len(counts) > postings):
                    yield block()
                    number, ids, lengths, ends, vocabulary, term, tf = number + 1, [], [], [], {}, [], []
                term += [vocabulary.setdefault(t, len(vocabulary)) for t in counts]
                tf += counts.values()
                ids.append(doc_id)
                lengths.append(sum(counts.values()))
                ends.append(len(term))
        if ids:
            yield block()

    return run


def _values(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def impacts(lengths: np.ndarray, ends: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting counts for before its term's weight."""
    m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(ends, prepend=0)))


def _maxima(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                term = _values(b.column("term"), row)
                vocabulary = b.column("terms")[row].values
                most = np.zeros(len(vocabulary), np.int64)
                np.maximum.at(most, term, impacts(_values(b.column("lengths"), row), _values(b.column("ends"), row), _values(b.column("tf"), row), n_docs, n_terms))
                columns = [b.column("block").slice(row, 1), _lists(vocabulary, pa.binary()), _lists(most, pa.int64()), _lists(np.bincount(term, minlength=len(vocabulary)).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "terms", "most", "df"])

    return run


def index(docs: DataFrame) -> Index:
    """The index of all rows of ``docs``, written to the shared folder. Only doc_id and text are read; documents without a
    term are in no block; rows with equal or no ids are documents of their own. A text's terms are in one task's memory."""
    with _small_batches(docs.sparkSession, TEXTS):
        blocks = _of_blocks(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_blocked(BLOCK_DOCS, BLOCK_POSTINGS), BLOCKS), "blocks")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    with _small_batches(docs.sparkSession, BATCH):
        maxima = _of_blocks(blocks.select("block", "lengths", "ends", "terms", "term", "tf").mapInArrow(_maxima(n_docs, n_terms), MAXIMA), "maxima")
    return Index(blocks, maxima, n_docs, n_terms)


def drop(index: Index) -> None:
    """Deletes the index's tables."""
    discard(index.blocks, index.maxima)


class Items(NamedTuple):
    """Items by number: ``starts`` cuts ``term`` (numbers of the vocabulary) into one run an item; ``weight`` is by term."""

    vocabulary: pa.Array
    starts: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(run, "item_id bigint, term binary").distinct()


def _numbers(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Where each term stands in the vocabulary, -1 if it is not there."""
    return pc.fill_null(pc.index_in(terms, vocabulary), -1).to_numpy(zero_copy_only=False)


def _held(vocabulary: pa.Array):
    """Of each block's maxima those of the items' terms, as numbers of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                term = _numbers(b.column("terms")[row].values, vocabulary)
                here = np.flatnonzero(term >= 0)
                if len(here):
                    columns = [b.column("block").slice(row, 1), _lists(term[here], pa.int32()), _lists(_values(b.column("most"), row)[here], pa.int64()), _lists(_values(b.column("df"), row)[here], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "term", "most", "df"])

    return run


def _bounds(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                most = np.zeros(len(items.weight), np.int64)
                most[_values(b.column("term"), row)] = _values(b.column("most"), row)
                bound = np.add.reduceat((most * items.weight)[items.term], items.starts[:-1])
                found = np.flatnonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.repeat(b.column("block")[row].as_py(), len(found)), pa.int64()), pa.array(bound[found])], ["item", "block", "bound"])

    return run


FOUND = "item int, doc_id bigint, score bigint"


def _scored(items: Items, k: int, limits: list[tuple], least: dict[int, int], n_docs: int, n_terms: int, tile: int):
    """The task's ``k`` best documents of each item, of the blocks whose bound lies within the item's limits (item, low, high)."""
    low, high = np.full(len(items.starts) - 1, 2**63 - 1), np.full(len(items.starts) - 1, 2**63 - 1)
    for i, x, y in limits:
        low[i], high[i] = x, high[i] if y is None else y
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)

    def matrix(block: dict, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents by terms of the items (impacts), and those terms."""
        names = _numbers(block["terms"][row].values, items.vocabulary)
        term, ends = names[_values(block["term"], row)], _values(block["ends"], row)
        here = np.flatnonzero(term >= 0)
        impact = impacts(_values(block["lengths"], row), ends, _values(block["tf"], row), n_docs, n_terms)[here]
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[here]
        known, column = np.unique(term[here], return_inverse=True)
        # whole numbers: exact in doubles below 2^53
        kind = np.float64 if 1e6 * float(items.weight.max(initial=0)) * len(known) < 2**53 else np.int64
        out = np.zeros((len(ends), len(known)), kind)
        out[doc, column] = impact
        return out, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        floor = np.ones(len(items.starts) - 1, np.int64)  # what a document must have to be among the best so far
        for i, x in least.items():
            floor[i] = max(1, x)
        for b in batches:
            block = {n: b.column(n) for n in b.schema.names}
            for row in range(b.num_rows):
                a, known = matrix(block, row)
                most = np.zeros(len(items.weight), np.int64)
                most[known] = a.max(axis=0, initial=0)
                bound = np.add.reduceat((most * items.weight)[items.term], items.starts[:-1])
                ids, chosen = block["ids"][row].as_py(), np.flatnonzero((bound >= low) & (bound < high))
                column = np.full(len(items.weight), -1)
                column[known] = np.arange(len(known))
                for at in range(0, len(chosen), tile):
                    part = chosen[at : at + tile]
                    t = np.concatenate([items.term[items.starts[i] : items.starts[i + 1]] for i in part])
                    of = np.repeat(np.arange(len(part)), items.starts[part + 1] - items.starts[part])
                    here = column[t] >= 0
                    w = np.zeros((len(known), len(part)), a.dtype)
                    w[column[t[here]], of[here]] = items.weight[t[here]]
                    scores = (a @ w).astype(np.int64)
                    for j in np.flatnonzero(scores.max(axis=0, initial=0) >= floor[part]):
                        i, s = int(part[j]), scores[:, j]
                        rows = np.flatnonzero(s >= floor[i])
                        best[i] = heapq.nsmallest(k, best.get(i, []) + [(int(s[r]), ids[r]) for r in rows], key=order)
                        if len(best[i]) == k:
                            floor[i] = best[i][-1][0]
        out = [(i, d, s) for i, x in best.items() for s, d in x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search_part(index: Index, rows: list, k: int, count: dict | None) -> tuple[DataFrame, list]:
    """``rows``: (item_id, term) of some items, each once. The best documents by the items' numbers, and the items' ids."""
    spark = index.blocks.sparkSession
    by_item: dict = {}
    vocabulary: dict[bytes, int] = {}
    for item_id, t in rows:
        by_item.setdefault(item_id, []).append(vocabulary.setdefault(bytes(t), len(vocabulary)))
    words = pa.array(list(vocabulary), pa.binary())
    with _small_batches(spark, BATCH):
        held = _of_blocks(index.maxima.mapInArrow(_held(words), "block bigint, term array<int>, most array<bigint>, df array<int>"), "held")
    dfs = held.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.df").alias("df"))
    weighed = dfs.select("term", F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1))).alias("w"))
    weight = np.zeros(len(vocabulary), np.int64)
    with _small_batches(spark, BATCH):
        for r in weighed.collect():  # the vocabulary at most
            weight[r.term] = r.w
    sizes = [len(t) for t in by_item.values()]
    items = Items(words, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([t for x in by_item.values() for t in x], np.int64), weight)
    with _small_batches(spark, BATCH):
        bounds = written(held.mapInArrow(_bounds(items), "item int, block bigint, bound bigint"), "bounds")
    discard(held)
    blocks = max(1, index.blocks.count())
    shares, n = [], FIRST
    while n < blocks:
        shares, n = [*shares, 1 - n / blocks], n * GROWTH
    cuts = {}
    if shares:
        cuts = {r.item: r.cuts for r in bounds.groupBy("item").agg(F.percentile_approx("bound", shares, 10_000).alias("cuts")).collect()}
    top, least = None, {}
    for step in range(len(shares) + 1):
        # a band: bounds from its cut up and below the band before; an item whose k-th best score is not below that is done
        high = {i: cuts[i][step - 1] if step else None for i in cuts or range(len(sizes))}
        limits = [(i, max(cuts[i][step] if step < len(shares) else 1, least.get(i, 1)), h) for i, h in high.items() if h is None or least.get(i, 1) < h]
        if not limits:
            break
        limit = F.broadcast(spark.createDataFrame(limits, "item int, low bigint, high bigint"))
        chosen = bounds.join(limit, "item").where((F.col("bound") >= F.col("low")) & (F.col("high").isNull() | (F.col("bound") < F.col("high"))))
        chosen = written(chosen.groupBy("block").agg(F.count("*").alias("n")), "chosen")
        pairs, most = chosen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        if count is not None:
            count["scored"] = count.get("scored", 0) + pairs
        if pairs:
            read = index.blocks.select("block", "ids", "lengths", "ends", "terms", "term", "tf")
            # the index never moves: a block's items are found again from its own bounds
            read = read.join(F.broadcast(chosen.select("block")), "block", "left_semi") if most <= MOST_CHOSEN else read
            found = read.mapInArrow(_scored(items, k, limits, least, index.n_docs, index.n_terms, TILE), FOUND)
            with _small_batches(spark, BATCH):
                previous, top = top, written(_best(found if top is None else found.union(top.drop("rank")), k), "top")
            if previous is not None:
                discard(previous)
            least = {r.item: r.score for r in top.where(F.col("rank") == k).select("item", "score").collect()}
        discard(chosen)
    if count is not None:
        count["pairs"] = count.get("pairs", 0) + bounds.count()
    discard(bounds)
    return top, list(by_item)


def search(index: Index, items: DataFrame, k: int = 10, count: dict | None = None) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id, null last.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); documents with a score of 0 are never among the best. Rows with
    equal item ids are one item with the terms of all; null and empty items have no rows. An item at a time is a task's at
    most with its terms; ``count`` gets the pairs of item and block that have a bound, and how many of them were scored.
    """
    spark = items.sparkSession
    wanted = written(_item_terms(items), "item_terms")
    parts = max(1, -(-wanted.count() // MOST_TERMS))
    out = None
    for p in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).orderBy("item_id", "term").collect()  # about MOST_TERMS
        top, ids = _search_part(index, [(r.item_id, r.term) for r in rows], k, count) if rows else (None, [])
        if top is not None:
            named = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "item int, item_id bigint"))
            found = top.join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            out = found if out is None else out.union(found)
    discard(wanted)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


# N, L, df, tf and the score as the operator's description has them, by plain joins.
ORACLE = """
with d as (
  select row_number() over () r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w
  from documents),
s as (select count(*)::bigint n, sum(len(w))::bigint l from d where len(w) > 0),
p as (select r, doc_id, len(w)::bigint n, unnest(w) term from d),
tf as (select r, doc_id, n, term, count(*)::bigint tf from p group by r, doc_id, n, term),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term
  from benchmark),
w as (
  select term, floor(1000 * ln((2 * s.n + 2)::double / (2 * df + 1)::double))::bigint w
  from (select term, count(*)::bigint df from tf where term in (select term from q) group by term), s),
x as (
  select item_id, r, any_value(doc_id) doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * tf.n * s.n) // s.l))))::bigint score
  from q join tf using (term) join w using (term), s group by item_id, r)
select item_id, rank::int as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) rank from x where score > 0)
where rank <= 10
"""
