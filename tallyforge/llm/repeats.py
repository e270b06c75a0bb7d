"""Repeated passages: bytes covered by a string of LENGTH bytes that also starts anywhere else.

Every window of LENGTH bytes belongs to its anchor, the hashed gram of GRAM bytes in it that is least; equal windows
have equal anchors, wherever they stand. Runs of windows with one anchor are blocks. Blocks whose whole bytes recur
are repeated throughout. The rest of the blocks that share an anchor with others go, by anchor, to shards, and there
external induced sorting (module suffixes) orders their suffixes with common prefixes; windows next to one with a
common prefix of LENGTH are repeated. The windows of an anchor with too many bytes for one shard are counted by a
digest of 128 bits instead, in sums that are combined before they are shuffled. So no window is missed, and only what
can be repeated is sorted or counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HUB, MOST_HUBS, discard, slices, utf8, written
from .shingles import mix
from .suffixes import suffix_array

LENGTH, GRAM = 200, 50
# Bytes of blocks that are sorted together, up to an anchor's end; and the most of one anchor's. Beyond, its windows are counted.
SHARD, MOST_OF_ANCHOR = 1 << 20, 256 << 10
# Lists of blocks are broadcast while texts and list items, of at most 32 bytes each, are no more than this (128 MB); beyond,
# texts are looked up by a shuffled join.
MOST_BROADCAST = 4 << 20
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_END = 0xFF  # never in UTF-8


def blocks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of many texts: text number, first window, windows, anchor, digest of the block's bytes."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(_STEP))]))
        back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(_BACK))]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    ranked = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    # least of each run of grams in a window: of two parts, one up to and one from a multiple of the width
    width = LENGTH - GRAM + 1
    count = len(ranked) - width + 1
    size = -(-len(ranked) // width) * width
    laid = np.full(size, ~np.uint64(0))
    laid[: len(ranked)] = ranked
    laid = laid.reshape(-1, width)
    fore = np.minimum.accumulate(laid, axis=1).ravel()
    rear = np.minimum.accumulate(laid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(rear[:count], fore[width - 1 : width - 1 + count]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(count)
    of = np.searchsorted(offsets, starts, side="right") - 1
    valid = starts + LENGTH <= offsets[of + 1]
    starts, of, anchor = starts[valid], of[valid], anchor[valid]
    if not len(starts):
        return none, none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
    a, d, windows = starts[first], of[first], np.diff(np.append(first, len(starts)))
    with np.errstate(over="ignore"):
        digest = mix((sums[a + windows - 1 + LENGTH] - sums[a]) * back[a] + windows.astype(np.uint64))
    return d, a - offsets[d], windows, grams[anchor[first]].view(np.int64), digest.view(np.int64)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 19):
        offsets, data = utf8(batch.column(0))
        d, start, windows, anchor, digest = blocks(offsets, data)
        ids = batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(digest), pa.array(ids[d]), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))], ["anchor", "digest", "content", "start", "windows"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, content, list of blocks) to a row per block with its bytes."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    for batch in batches:
        rows = []
        for text, content, want in zip(*(batch.column(k) for k in range(3))):
            raw = text.as_py().encode()
            for b in want.as_py():
                rows.append((b["anchor"], content.as_py(), b["start"], b["windows"], b["edge"], raw[b["start"] : b["start"] + b["windows"] - 1 + LENGTH]))
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 5000]), kinds)], ["anchor", "content", "start", "windows", "edge", "bytes"])


def repeated_windows(raw: list[bytes], windows: np.ndarray) -> list[np.ndarray]:
    """For each block, which of its windows recur among the blocks."""
    sizes = np.array([len(r) + 1 for r in raw])
    text = np.frombuffer(b"".join(r + bytes([_END]) for r in raw), np.uint8)
    order, prefix = suffix_array(text, LENGTH)
    with_next = np.append(prefix[1:] >= LENGTH, False)
    hit = np.zeros(len(text), bool)
    hit[order[(prefix >= LENGTH) | with_next]] = True
    at = np.concatenate([[0], np.cumsum(sizes)])
    return [hit[a : a + w] for a, w in zip(at[:-1], windows)]


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor to repeated runs (content, first, last) of windows, for the edge blocks."""
    anchors, rows, size = None, [], 0

    def work(rows: list) -> pa.RecordBatch:
        out = []
        for (content, start, windows, edge, _), hit in zip(rows, repeated_windows([r[4] for r in rows], np.array([r[2] for r in rows]))):
            if edge and hit.any():
                step = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                out += [(content, start + int(a), start + int(b) - 1) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int32(), pa.int32()))], ["content", "first", "last"])

    for batch in batches:
        for anchor, *row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if anchor != anchors and size >= SHARD:
                yield work(rows)
                rows, size = [], 0
            anchors = anchor
            rows.append(row)
            size += len(row[4])
    if rows:
        yield work(rows)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their bytes to a row per window: its digest in two halves, text and block, place in the block."""
    for big in batches:
        for at in range(0, big.num_rows, 1000):
            halves, whose, begin, place = [], [], [], []
            for content, start, windows, raw in zip(*(big.slice(at, 1000).column(k).to_pylist() for k in (1, 2, 3, 5))):
                halves += [xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for i in range(windows)]
                whose += [content] * windows
                begin += [start] * windows
                place += range(windows)
            two = np.frombuffer(b"".join(halves), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(whose, pa.int64()), pa.array(begin, pa.int32()), pa.array(place, pa.int32())], ["h", "l", "content", "start", "at"])


def _counted_runs(cut: DataFrame, edges: DataFrame) -> DataFrame:
    """Repeated runs (content, first, last) of the edge blocks among ``cut``'s, by counts of their windows.

    A digest counted once names its only window, so nothing is joined back by digest: a block's runs are what its
    unique windows, at most as many as grams fit into a window, leave of it.
    """
    one = F.min(F.struct("content", "start", "at")).alias("w")
    unique = cut.mapInArrow(_digested, "h bigint, l bigint, content bigint, start int, at int").groupBy("h", "l").agg(F.count("*").alias("n"), one)
    unique = unique.where("n = 1").select("w.*").groupBy("content", "start").agg(F.sort_array(F.collect_list("at")).alias("gaps"))
    gaps = edges.select("content", "start", "windows").join(unique, ["content", "start"], "left")
    # between each two neighbours of -1, the gaps and the end there may be a run
    ends = F.concat(F.array(F.lit(-1)), F.coalesce("gaps", F.array().cast("array<int>")), F.array("windows"))
    runs = gaps.withColumn("ends", ends).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ends") - 1)))
    runs = runs.select("content", (F.col("start") + F.get("ends", F.col("k") - 1) + 1).alias("first"), (F.col("start") + F.get("ends", F.col("k")) - 1).alias("last"))
    return runs.where("first <= last")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, content, runs) to what is left: content, n_removed, n_spans, spans, sha."""
    for batch in batches:
        out = []
        for text, content, runs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            raw = text.encode()
            spans: list[list[int]] = []
            for a, b in sorted((r["first"], r["last"] + LENGTH) for r in runs):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            left, at = hashlib.sha256(), 0
            for a, b in spans:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            out.append((content, sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], left.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ([],) * 5, kinds)], ["content", "n_removed", "n_spans", "spans", "sha"])


_KEPT = "content bigint, n_removed bigint, n_spans bigint, spans array<struct<start:int,end:int>>, sha string"


def _numbered(docs: DataFrame, number: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, text, content; doc_id, n_bytes, content, sha; content, n, rep. Equal texts, and only they, share their content.

    Of texts with one ``number`` 60 bits of SHA-256 are compared; where they differ, those texts are numbered anew by the whole
    SHA-256, until no number stands for two texts. So 124 bits tell texts apart.
    """
    body = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", number(body).alias("content"))
    meta = base.select("doc_id", F.octet_length(body).cast("bigint").alias("n_bytes"), "content", F.sha2(body, 256).alias("sha"))
    part = F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint")
    salt = 0
    while True:
        meta = written(meta, "meta")
        unique = meta.groupBy("content").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"), F.min(part).alias("lo"), F.max(part).alias("hi"))
        unique = written(unique, "contents")
        shared = unique.where("lo <> hi").select(F.col("content").alias("of"))
        n = shared.count()
        if not n:
            return base, meta, unique.drop("lo", "hi")
        # one in the square of the texts over 2^65; broadcast while it is no more than the other lists
        shared = F.broadcast(shared) if n <= MOST_BROADCAST else shared
        anew = lambda df, sha: df.join(shared, F.col("content") == F.col("of"), "left").withColumn("content", F.when(F.col("of").isNull(), F.col("content")).otherwise(F.xxhash64(sha, F.lit(salt)))).drop("of")  # noqa: B023, E731
        base, meta, salt = anew(base, F.sha2(body, 256)), anew(meta, F.col("sha")), salt + 1


def repeated_passages(docs: DataFrame, number: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (bytes, ends exclusive).

    Texts are UTF-8 bytes, null is empty; matches never cross texts. A byte goes if a string of LENGTH bytes over it also
    starts anywhere else, in the same text too; overlaps count and strings are judged on the input. Equal texts are
    worked on once and all go whole if they have LENGTH bytes. Ids may be null or repeated: a row's text alone decides.
    Other columns are not read. An empty table gives no rows. ``number`` gives texts a long that few share; those that share
    one by chance are told apart. A text's work arrays take about 100 bytes a byte of it.
    """
    base, meta, unique = _numbered(docs, number)
    columns = ["anchor", "digest", "content", "start", "windows"]
    found = base.select("text", "content").where("text is not null").mapInArrow(_blocked, "anchor bigint, digest bigint, content bigint, start int, windows int")
    # copies of a text meet first; all after that are sums that are combined before they are shuffled, and joins
    found = distinct = written(found.groupBy(*columns).agg(F.lit(1).alias("one")).drop("one"), "distinct_blocks")
    place = F.xxhash64("content", "start")
    same = found.groupBy("anchor", "digest").agg(F.count("*").alias("n_same"), F.min(place).alias("first"), F.max("windows").alias("most"))
    shared = same.groupBy("anchor").agg(F.sum("n_same").alias("n_anchor"), F.max(F.col("n_same") == 1).alias("edges"), (F.sum(F.col("most") + LENGTH) > MOST_OF_ANCHOR).alias("large")).where("n_anchor > 1")
    same = same.join(shared.select("anchor", "edges", "large"), "anchor").select("anchor", "digest", (F.col("n_same") == 1).alias("edge"), "edges", "large", "first")
    # one of a digest's blocks is sorted; a second one of equal hash would do no harm
    found = found.join(same, ["anchor", "digest"]).select("anchor", "content", "start", "windows", "edge", "large", (F.col("edges") & (place == F.col("first"))).alias("sort"))
    found = written(found, "blocks")
    # nothing reads these any more, and they take room beside the shuffles that follow
    discard(distinct)

    def cut(blocks: DataFrame) -> DataFrame:
        wanted = blocks.where("sort").groupBy("content").agg(F.collect_list(F.struct("anchor", "start", "windows", "edge")).alias("want"))
        return _with_texts(base, wanted, unique, "want").mapInArrow(_cut_out, "anchor bigint, content bigint, start int, windows int, edge boolean, bytes binary")

    shards = cut(found.where("not large"))
    shards = shards.repartition("anchor").sortWithinPartitions("anchor", "content", "start").select("anchor", "content", "start", "windows", "edge", "bytes")
    runs = written(shards.mapInArrow(_sorted_shards, "content bigint, first int, last int"), "runs")
    large = found.where("large and sort")
    if not large.isEmpty():
        runs = runs.union(written(_counted_runs(cut(large), large.where("edge")), "counted_runs"))
    runs = runs.union(found.where("not edge").select("content", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last")))
    runs = runs.join(unique.where("n > 1").select("content"), "content", "left_anti")
    lists = runs.groupBy("content").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    kept = written(_with_texts(base, lists, unique, "runs").mapInArrow(_kept, _KEPT).dropDuplicates(["content"]), "kept")

    # texts of very many rows, at most MOST_HUBS of them, are known to be copies and need no runs; the rest meets by text
    many = max(HUB, (unique.agg(F.sum("n")).first()[0] or 0) // MOST_HUBS)
    hubs = F.broadcast(unique.where(F.col("n") > many).select("content", "n"))
    kept = kept.withColumnRenamed("sha", "left")
    rows = meta.join(hubs, "content", "left_anti").join(unique.select("content", "n"), "content").join(kept, "content", "left")
    rows = rows.unionByName(meta.join(hubs, "content"), allowMissingColumns=True)
    copied = (F.col("n") > 1) & (F.col("n_bytes") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return rows.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
        F.when(copied, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
    )


def _with_texts(base: DataFrame, lists: DataFrame, unique: DataFrame, name: str) -> DataFrame:
    """(text, content, list) for each content with a list: its text in the rows with its smallest id. Both keys count, so neither
    rows that share an id, or have none, nor copies of a text multiply."""
    lists = written(lists.join(unique.select("content", "rep"), "content"), "lists")
    side = lists.select(F.col("rep").alias("rep_id"), F.col("content").alias("of"), name)
    items = lists.agg(F.sum(F.size(name) + 1)).first()[0] or 0
    side = F.broadcast(side) if items <= MOST_BROADCAST else side
    return base.where("text is not null").join(side, (base["content"] == side["of"]) & base["doc_id"].eqNullSafe(side["rep_id"])).select("text", "content", name)
