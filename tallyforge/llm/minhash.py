"""Near duplicates of texts: MinHash signatures joined by a multi-index over their chunks.

A signature has SYMBOLS minima of BITS bits. Two texts are candidates if their signatures differ in at most RADIUS
symbols. CHUNKS chunks of three symbols share these errors, so one chunk has at most RADIUS // CHUNKS of them (one);
leaving out each symbol of a chunk in turn enumerates it, and candidates agree in one such key: none is missed.
At a similarity of 0.8, a pair exceeds the radius once in about 80 million times, and less the more alike it is.
Links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, slices, utf8, written
from .shingles import sets

SYMBOLS, BITS, CHUNKS, RADIUS = 36, 16, 12, 22
SIZE = SYMBOLS // CHUNKS
# Members of a bucket compared in one go; those of larger buckets are one group without a comparison.
BLOCK = 2048
# Texts of a group, and shingles in all, whose sets are compared in one go.
SET_BLOCK, MOST_SHINGLES = 1024, 4_000_000
# Members, about, that all parts of a large group share.
SHARED = 8
# Up to so many document ids are broadcast to fetch texts again; beyond, they are joined by a shuffle.
MOST_BROADCAST = 2_000_000
_RANDOM = np.random.default_rng(7)
_XOR = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_TOP = np.uint64(0x9FB21C651E98DF25)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS minima as unsigned numbers of BITS bits."""
    least = np.full(SYMBOLS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[None, at : at + (1 << 14)]
            least = np.minimum(least, ((part ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
        return ((least * _TOP) >> np.uint64(64 - BITS)).astype(np.uint16)


def keys(signatures: np.ndarray) -> np.ndarray:
    """(n, CHUNKS * SIZE) keys: each chunk with each of its symbols left out in turn, and the place of both."""
    s = signatures.astype(np.int64).reshape(len(signatures), CHUNKS, SIZE)
    out = []
    for c in range(CHUNKS):
        for gone in range(SIZE):
            key = np.full(len(s), c * SIZE + gone, np.int64)
            for k in range(SIZE):
                if k != gone:
                    key = (key << BITS) | s[:, c, k]
            out.append(key)
    return np.stack(out, axis=1) if len(s) else np.zeros((0, CHUNKS * SIZE), np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, content (digest of the set, null if empty), signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, digests, signatures = [], [], []
            for s in sets(*utf8(batch.column(1)), shingle):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "content", "signature"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, content binary, signature binary")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            k = keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), k.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(ids)], ["key", "id"])


def _by_group(work, keys: tuple[str, ...]):
    """Hands rows sorted by ``keys`` to ``work`` group by group, across batches; ``work`` gives arrays of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        out: list[np.ndarray] = []

        def each(t: pa.Table) -> None:
            g = np.stack([t.column(c).to_numpy() for c in keys], axis=1)
            cuts = np.append(0, np.flatnonzero(np.any(g[1:] != g[:-1], axis=1)) + 1)
            for a, b in zip(cuts, np.append(cuts[1:], len(g))):
                if b - a > 1:
                    out.extend(work(t.slice(a, b - a)))

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(out), axis=0)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
            same = np.all([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in keys], axis=0)
            cut = int(np.argmax(same))
            if cut:
                each(t.slice(0, cut))
            left = t.slice(cut)
            if len(out) > 20_000:
                yield flush()
        if left is not None:
            each(left)
        if out:
            yield flush()

    return run


def _distances(sigs: np.ndarray, rows: slice) -> np.ndarray:
    """Symbols in which the rows differ from all."""
    d = np.zeros((rows.stop - rows.start, len(sigs)), np.uint8)
    for k in range(SYMBOLS):
        d += sigs[rows, k, None] != sigs[None, :, k]
    return d


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _forest(t: pa.Table) -> list[np.ndarray]:
    """Of all candidate pairs of a bucket only so many that they connect the same."""
    ids, sigs = t.column("id").to_numpy(), _signatures(t)
    label, out = np.arange(len(ids)), []
    for at in range(0, len(ids), 256):
        rows = slice(at, min(len(ids), at + 256))
        near = _distances(sigs, rows) <= RADIUS
        near &= np.arange(len(ids))[None, :] < np.arange(rows.start, rows.stop)[:, None]
        for r in np.flatnonzero(near.any(axis=1)):
            found = np.flatnonzero(near[r])
            met, first = np.unique(label[found], return_index=True)
            fresh = met != label[at + r]
            if fresh.any():
                out.append(np.stack([np.full(int(fresh.sum()), ids[at + r]), ids[found[first[fresh]]]], axis=1))
                label[np.isin(label, met)] = label[at + r]
    return out


def _linked(least: int):
    """Of all links of one part of a group so many that they connect the same: nearest signatures first, full sets decide."""

    def work(t: pa.Table) -> list[np.ndarray]:
        ids, sigs = t.column("id").to_numpy(), _signatures(t)
        lists = t.column("members").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(at)
        label, out, left = np.arange(len(ids)), [], len(ids) - 1
        pairs = []
        for k in range(0, len(ids), 256):
            rows = slice(k, min(len(ids), k + 256))
            d = _distances(sigs, rows)
            ok = (d <= RADIUS) & (np.arange(len(ids))[None, :] < np.arange(rows.start, rows.stop)[:, None])
            # an intersection is at most the smaller set, a union at least the larger
            ok &= 100 * np.minimum(size[rows, None], size[None, :]) >= least * np.maximum(size[rows, None], size[None, :])
            a, b = np.nonzero(ok)
            pairs.append((d[a, b], (a + k).astype(np.int32), b.astype(np.int32)))
        d, a, b = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(d, kind="stable")
        a, b = a[order], b[order]
        for step in range(0, len(a), 2000):
            if not left:
                break
            open_ = np.flatnonzero(label[a[step : step + 2000]] != label[b[step : step + 2000]]) + step
            for x, y in zip(a[open_].tolist(), b[open_].tolist()):
                if label[x] == label[y]:
                    continue
                both = len(np.intersect1d(flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]], assume_unique=True))
                if 100 * both >= least * (size[x] + size[y] - both):
                    out.append(np.array([[ids[x], ids[y]]]))
                    label[label == label[x]] = label[y]
                    left -= 1
        return out

    return work


def _apart(least: int):
    """Pairs (id, id) of the members that have a candidate with another label: those of ``left`` against the rest."""

    def work(t: pa.Table) -> list[np.ndarray]:
        ids, label, n, sigs = t.column("id").to_numpy(), t.column("label").to_numpy(), t.column("n_shingles").to_numpy(), _signatures(t)
        mine = np.flatnonzero(t.column("mine").to_numpy())
        hit = np.zeros(len(ids), bool)
        for k in range(0, len(mine), 256):
            rows = mine[k : k + 256]
            d = np.zeros((len(rows), len(ids)), np.uint8)
            for s in range(SYMBOLS):
                d += sigs[rows, s, None] != sigs[None, :, s]
            near = (d <= RADIUS) & (label[rows, None] != label[None, :])
            near &= 100 * np.minimum(n[rows, None], n[None, :]) >= least * np.maximum(n[rows, None], n[None, :])
            hit[rows] |= near.any(axis=1)
            hit |= near.any(axis=0)
        found = ids[hit]
        return [np.stack([found, found], axis=1)] if len(found) else []

    return work


def _by_key(rows: DataFrame, *keys: str) -> DataFrame:
    # a set number of tasks: work per byte is high, so small ones must not be put together by their size
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "id")


def _in_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, id, g: number of blocks) to one per pair of blocks they are in."""
    rows = rows.withColumn("block", F.pmod(F.hash("id"), F.col("g")))
    spread = F.expr("transform(sequence(0, g - 1), o -> named_struct('i', least(block, o), 'j', greatest(block, o)))")
    return rows.withColumn("p", F.explode(spread)).select(key, "p.i", "p.j", "id", "signature", "members")


def near_duplicates(docs: DataFrame, shingle: int = 5, least: int = 80) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * intersection >= ``least`` * union of their distinct shingles of ``shingle`` words (A-Z
    lower-cased; a shorter text is one shingle). component_id is the smallest id reachable by links, kept whether a
    row has it. Null, empty and blank texts have no shingles and are linked with nothing. Rows with equal ids are one
    document that has each of their texts' links. Rows without an id are linked with nothing: their component_id is
    null and they are kept. Other columns are not read. An empty table gives no rows.

    Texts with equal sets are one vertex (a grouped minimum). Candidates make groups, of which only a spanning forest is
    ever passed on; all members of a bucket of over BLOCK are one group at once. The sets of a group meet once, in parts
    of bounded size that share a few members; what is connected already is not compared any more. So the rows between
    stages grow with the texts. Only where a group in several parts stays in pieces, signatures of all but the largest
    piece meet those of the others in blocks, and the sets of such texts as have a candidate there in pairs of blocks.
    """
    texts = written(sketches(docs, shingle), "sketches")
    usable = texts.where("content is not null and doc_id is not null")
    # two classes can have one id; each needs its own vertex only as long as it looks for links
    classes = written(usable.groupBy("content").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "classes")
    vertices = classes.select(F.xxhash64("content").alias("id"), "content", "rep", "signature", "n_shingles")
    keyed = written(vertices.select("id", "signature").mapInArrow(_keyed, "key bigint, id bigint"), "keyed")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    met = keyed.join(crowded, "key")
    members = met.where(F.col("n") <= BLOCK).select("key", "id").join(vertices.select("id", "signature"), "id")
    candidates = _by_key(members, "key").mapInArrow(_by_group(_forest, ("key",)), "a bigint, b bigint")
    candidates = candidates.union(met.where(F.col("n") > BLOCK).select(F.col("id").alias("a"), F.col("least").alias("b")))
    groups = components(candidates).select("id", F.col("component_id").alias("grp"))
    grouped = written(groups.join(vertices, "id").select("id", "grp", "signature", "n_shingles", F.col("rep").alias("doc_id")), "grouped")
    parts = grouped.groupBy("grp").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n_shingles") / MOST_SHINGLES)).cast("int").alias("g"))
    parts = written(parts, "parts")
    sets_ = _sets_of(docs, grouped, shingle).join(grouped.select("id", "grp", "signature"), "id").join(parts, "grp")
    hashed = F.pmod(F.xxhash64("id"), F.col("n"))
    part = F.when(F.col("g") == 1, F.array(F.lit(0))).when(hashed < SHARED, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.pmod(F.hash("id"), F.col("g"))))
    dealt = sets_.select("grp", F.explode(part).alias("i"), "id", "signature", "members")
    found = written(_by_key(dealt, "grp", "i").mapInArrow(_by_group(_linked(least), ("grp", "i")), "a bigint, b bigint"), "links")
    if not (large := parts.where("g > 1")).isEmpty():
        found = found.union(_between_parts(docs, grouped.join(large.select("grp", "n"), "grp"), found, shingle, least))
    merged = components(
        found.join(vertices.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a").join(vertices.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        .union(usable.join(classes.select("content", "rep"), "content").where("doc_id <> rep").groupBy("doc_id", "rep").count().select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    )
    out = texts.join(merged, texts["doc_id"] == merged["id"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _between_parts(docs: DataFrame, members: DataFrame, links: DataFrame, shingle: int, least: int) -> DataFrame:
    """Links (a, b) between the pieces that ``links`` leave of large groups. ``members``: id, grp, signature, n_shingles, doc_id, n."""
    pieces = components(links.join(members.select(F.col("id").alias("a")), "a", "left_semi"))
    members = members.join(pieces, "id", "left").withColumn("label", F.coalesce("component_id", "id")).drop("component_id")
    members = written(members, "members")
    sizes = members.groupBy("grp", "label").agg(F.count("*").alias("k"))
    most = sizes.groupBy("grp").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.sum("k").alias("n"), F.max("k").alias("k"))
    most = most.where("k < n").select("grp", "top", F.ceil((F.col("n") - F.col("k")) / BLOCK).cast("int").alias("mg"), F.ceil(F.col("n") / (4 * BLOCK)).cast("int").alias("ng"))
    rows = members.drop("n").join(most, "grp").withColumn("i", F.pmod(F.hash("id"), F.col("mg"))).withColumn("j", F.pmod(F.xxhash64("id"), F.col("ng")).cast("int"))
    cells = lambda i, j, mine: F.transform(F.sequence(F.lit(0), (F.col("ng") if mine else F.col("mg")) - 1), lambda o: F.struct((i if mine else o).alias("i"), (o if mine else j).alias("j"), F.lit(mine).alias("mine")))
    left, right = cells(F.col("i"), F.col("j"), True), cells(F.col("i"), F.col("j"), False)
    spread = rows.withColumn("c", F.explode(F.when(F.col("label") == F.col("top"), right).otherwise(F.concat(left, right))))
    spread = _by_key(spread.select("grp", "c.i", "c.j", "id", "c.mine", "label", "n_shingles", "signature"), "grp", "i", "j")
    apart = spread.mapInArrow(_by_group(_apart(least), ("grp", "i", "j")), "a bigint, b bigint").select(F.col("a").alias("id")).distinct()
    some = written(members.join(apart, "id", "left_semi").select("id", "grp", "signature", "n_shingles", "doc_id"), "apart")
    blocks = some.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") * 2 / SET_BLOCK), F.ceil(F.sum("n_shingles") * 2 / MOST_SHINGLES)).cast("int").alias("g"))
    sets_ = _sets_of(docs, some, shingle).join(some.select("id", "grp", "signature"), "id").join(blocks, "grp")
    return written(_by_key(_in_pairs(sets_, "grp"), "grp", "i", "j").mapInArrow(_by_group(_linked(least), ("grp", "i", "j")), "a bigint, b bigint"), "more_links")


def _sets_of(docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(id, members array) of the classes in ``reps`` (id, doc_id), from the texts with these doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests, members = [], []
            for s in sets(*utf8(batch.column(0)), shingle):
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                members.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(members, pa.list_(pa.int64()))], ["content", "members"])

    ids = reps.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").select("text")
    made = texts.mapInArrow(run, "content binary, members array<bigint>").where("content is not null")
    made = made.select(F.xxhash64("content").alias("id"), "members")
    # a text of the class may come back more than once
    return made.join(reps.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
