"""Near duplicates of embeddings by sorted projection passes.

A pass orders the vectors of a label by a key of concatenated random hyperplane signs and compares each with the next
WINDOW in that order. Only keys, ids and vectors rounded to a byte a component go through the passes; a pair whose
cosine could reach the threshold, by the rounding errors that go with them, joins two vectors into a group. The first
and last rows of every partition are compared once more among themselves, so that no window ends at a border. Within a
group, blocks are compared in full and in double precision: that gives the verified links and exact link counts for
every linked vector the passes have brought together.

Signs are of the difference from the label's mean, as vectors with a common direction are else hardly parted. A pair
at the threshold, taken to be as far from the mean as its label is on average, agrees in one sign with probability
1 - arccos(its cosine there) / pi: about 0.936 at 0.98 where the mean is zero. It meets in a window once the key's
leading signs that part a label's n vectors into windows agree; passes repeat until such a pair misses all of them less
than once in a million times. A label that needs over MOST_PASSES and more than it has blocks is compared in full.
This takes each sign to halve what is left; a label of tight clusters far from its mean can miss more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, written

WINDOW, SIGNS = 64, 62
# Vectors, and numbers in all, of one block; pairs of blocks are compared in tiles of TILE rows.
BLOCK, MOST_NUMBERS, TILE = 8192, 2_000_000, 1024
MISS, MOST_PASSES = 1e-6, 64
# Up to so many labels' means are broadcast; beyond, a shuffled join does the work.
MOST_BROADCAST = 10_000


def passes(n: Column, shared: Column, least: float) -> Column:
    """Passes for a label of ``n`` unit vectors whose mean has the squared length ``shared``."""
    near = F.greatest(F.lit(0.0), 1 - (1 - least) / F.greatest(1 - shared, F.lit(1e-9)))
    together = F.pow(1 - F.acos(near) / math.pi, 1 + F.greatest(F.lit(0.0), F.log2(n / WINDOW)))
    return F.greatest(F.lit(4), F.ceil(math.log(MISS) / F.log1p(-F.least(together, F.lit(0.999999)))).cast("int"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, dims, vector) to sums of unit vectors by group."""
    for big in batches:
        for at in range(0, big.num_rows, 5000):
            batch = big.slice(at, 5000)
            grp = batch.column(0).to_numpy()
            order = np.argsort(grp, kind="stable")
            cuts = np.flatnonzero(np.diff(grp[order])) + 1
            out = [(int(grp[rows[0]]), len(rows), _unit(batch.column(2).take(pa.array(rows))).sum(axis=0).tolist()) for rows in np.split(order, cuts) if len(rows)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.float64())))], ["grp", "n", "total"])


def _blocks(n: Column, dims: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(n * dims / MOST_NUMBERS)).cast("int")


def _labels(vertices: DataFrame, least: float) -> DataFrame:
    """(grp, mean, n_passes, g): each label's mean, its passes, and g > 0 blocks instead where those are fewer than too many passes."""
    sums = written(vertices.select("grp", "dims", "vector").mapInArrow(_summed, "grp bigint, n bigint, total array<double>"), "sums")
    n = sums.groupBy("grp").agg(F.sum("n").alias("n"))
    mean = sums.select("grp", F.posexplode("total").alias("k", "t")).groupBy("grp", "k").agg(F.sum("t").alias("t"))
    mean = mean.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("m")).join(n, "grp")
    mean = mean.select("grp", "n", F.transform("m", lambda x: x["t"] / F.col("n")).alias("mean"))
    shared = F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x)
    g = _blocks(F.col("n"), F.size("mean"))
    made = mean.withColumn("p", passes(F.col("n"), shared, least))
    return written(made.select("grp", "mean", F.col("p").alias("n_passes"), F.when((F.col("p") > MOST_PASSES) & (F.col("p") > g), g).otherwise(0).alias("g")), "labels")


def _unit(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    x = raw.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _rounded(x: np.ndarray) -> list[bytes]:
    """Unit vectors with a byte a component: scale, length of the rounding error, components."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - q * scale[:, None], axis=1)
    head = np.stack([scale, error], axis=1)
    return [h.tobytes() + r.tobytes() for h, r in zip(head, q.astype(np.int8))]


def _unrounded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    head = raw[:, :16].copy().view(np.float64)
    return raw[:, 16:].view(np.int8).astype(np.float32) * head[:, :1].astype(np.float32), head[:, 1]


@lru_cache(maxsize=MOST_PASSES)
def _planes(p: int, d: int) -> np.ndarray:
    """A pass's hyperplanes, the same in every task; a worker keeps those of one length, half a kilobyte a pass and dimension."""
    return np.random.default_rng([p, d]).standard_normal((d, SIGNS))


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, grp, dims, vector, mean, n_passes) to a row per pass with its key: signs of what sets a vector apart from its label's mean."""
    for big in batches:
        for at in range(0, big.num_rows, 1000):
            batch = big.slice(at, 1000)
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                n_passes = part.column(5).to_numpy()
                units = _unit(part.column(3))
                small = pa.array(_rounded(units), pa.binary())
                x = units - np.array(part.column(4).to_pylist())
                for p in range(int(n_passes.max())):
                    on = np.flatnonzero(n_passes > p)
                    bits = (x[on] @ _planes(p, int(d)) > 0).astype(np.int64)
                    key = bits @ (np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                    take = pa.array(on)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p), pa.int32()), part.column(1).take(take), pa.array(key), part.column(0).take(take), small.take(take)], ["pass", "grp", "key", "id", "small"])


class _Sets:
    """Union-find over the ids of one piece of work."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


_PASS = "pass int, grp bigint, key bigint, id bigint, small binary"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pass", pa.int32()), ("grp", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("small", pa.binary())])


def _windows(least: float):
    """Rows sorted by (pass, grp, key, id) to pairs (a, b) that may be linked, of those within a piece only what connects
    it; and the partition's first and last WINDOW rows as they came."""

    def border(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(batch.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *batch.columns], schema=_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None
        first = 0
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                if first < WINDOW:
                    yield border(batch.slice(0, WINDOW - first))
                    first += batch.num_rows
                if left is not None:
                    batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
                known = left.num_rows if left is not None else 0
                left = batch.slice(max(0, batch.num_rows - WINDOW))
                step, grp, ids = (batch.column(c).to_numpy() for c in (0, 1, 3))
                pairs = []
                # runs of one pass and label: their vectors have the same length
                cuts = np.flatnonzero((step[1:] != step[:-1]) | (grp[1:] != grp[:-1])) + 1
                for a, b in zip(np.append(0, cuts), np.append(cuts, len(ids))):
                    if b - a < 2 or b <= known:
                        continue
                    x, error = _unrounded(batch.column(4).slice(a, b - a))
                    united = _Sets()
                    for i in range(0, b - a, 256):
                        p, q = slice(i, i + 256), slice(i, i + 256 + WINDOW)
                        # a cosine differs by the errors, and by what single precision loses
                        near = x[p] @ x[q].T + (error[p, None] + error[None, q] + error[p, None] * error[None, q] + 1e-5) >= least
                        r, c = np.nonzero(near)
                        # a pair of two rows that both came over was seen with the batch before
                        ok = (c > r) & (c - r <= WINDOW) & (a + i + c >= known)
                        for u, v in zip(ids[a + i + r[ok]].tolist(), ids[a + i + c[ok]].tolist()):
                            if united.join(u, v):
                                pairs.append((u, v))
                if pairs:
                    out = np.array(pairs, dtype=np.int64)
                    rest = [pa.nulls(len(out), f.type) for f in list(_PAIRS)[2:]]
                    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy()), *rest], schema=_PAIRS)
        if left is not None:
            yield border(left)

    return run


_COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _counted(least: float):
    """Rows sorted by (component, i, j): for each vector the weight of those linked with it among the two blocks (id, n),
    and pairs (a, b) that connect the linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            comp, i, j, block, ids, weight = (t.column(c).to_numpy() for c in ("component_id", "i", "j", "block", "id", "weight"))
            cuts = np.flatnonzero((comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            who, many, one, other = [], [], [], []
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(ids))):
                x, united = _unit(t.column("vector").slice(a, b - a).combine_chunks()), _Sets()
                for k in range(0, b - a, TILE):
                    near = x[k : k + TILE] @ x.T >= least
                    rows = np.arange(k, k + len(near))
                    near[rows - k, rows] = False
                    if i[a] != j[a]:
                        near &= block[a + rows, None] != block[None, a:b]
                    n = near @ weight[a:b]
                    on = np.flatnonzero(n)
                    who.append(ids[a + rows[on]])
                    many.append(n[on])
                    r, c = np.nonzero(np.triu(near, k + 1))
                    for u, v in zip(ids[a + k + r].tolist(), ids[a + c].tolist()):
                        if united.join(u, v):
                            one.append(u)
                            other.append(v)
            for x, y, at in ((np.concatenate(who), np.concatenate(many), 0), (np.array(one, np.int64), np.array(other, np.int64), 2)):
                if len(x):
                    columns = [pa.nulls(len(x), pa.int64())] * 4
                    columns[at : at + 2] = pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
            tail = [t.column(c).to_numpy() for c in ("component_id", "i", "j")]
            cut = int(np.argmax((tail[0] == tail[0][-1]) & (tail[1] == tail[1][-1]) & (tail[2] == tail[2][-1])))
            if cut:
                yield from work(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None:
            yield from work(left)

    return run


def _paired(inside: DataFrame) -> DataFrame:
    """(component_id, g, id, weight, vector) dealt out to all pairs of its g blocks."""
    inside = inside.withColumn("block", F.pmod(F.hash("id"), F.col("g")))
    spread = F.expr("transform(sequence(0, g - 1), o -> named_struct('i', least(block, o), 'j', greatest(block, o)))")
    inside = inside.withColumn("p", F.explode(spread)).select("component_id", "p.i", "p.j", "block", "id", "weight", "vector")
    return inside.repartition("component_id", "i", "j").sortWithinPartitions("component_id", "i", "j", "id")


def near_vectors(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """Every row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label and length are linked if their cosine, in double precision, is ``least`` or more. Vectors that
    are null, empty or zero, that hold null or non-finite numbers, or whose label or id is null link with nothing;
    component_id is then their own id (null without one) and they are kept. Equal vectors of a label are one vertex
    with a weight, so copies are not paired. Rows with equal ids and different vectors share a component. Other columns
    are not read. An empty table gives no rows. Vectors are told apart by 128 bits of their SHA-256 and by label, and
    numbered from there on; labels by 63 bits of a hash of label and length.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.size("embedding") > 0
    good &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # labels have negative numbers and vectors others, so that both can name what is compared in full
    grp = F.xxhash64("label", F.size("embedding")).bitwiseOR(F.lit(-(2**63)).cast("bigint"))
    base = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), *[F.when(usable, x).alias(n) for x, n in ((grp, "grp"), (F.size("embedding"), "dims"), (v, "v"))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [None if x is None else np.asarray(x, dtype=np.float64).tobytes() for x in b.column(3).to_pylist()]
            digests = [None if x is None else hashlib.sha256(x).digest()[:16] for x in vectors]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "grp", "dims", "digest", "vector"])

    base = written(base.mapInArrow(packed, "vec_id bigint, grp bigint, dims int, digest binary, vector binary"), "vectors")
    made = base.where("digest is not null").groupBy("grp", "digest").agg(F.min("dims").alias("dims"), F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("vector").alias("vector"))
    vertices = written(made.withColumn("id", F.monotonically_increasing_id()), "vertices")
    members = base.select("vec_id", "grp", "digest").join(vertices.select("grp", "digest", "id", "rep", "weight"), ["grp", "digest"], "left")
    members = written(members.select("vec_id", "id", "rep", "weight"), "members")
    labels = _labels(vertices, least)
    labels = F.broadcast(labels) if labels.count() <= MOST_BROADCAST else labels
    placed = vertices.join(labels, "grp")
    projected = placed.where("g = 0").select("id", "grp", "dims", "vector", "mean", "n_passes").mapInArrow(_projected, _PASS)
    order = ["pass", "grp", "key", "id"]
    projected = projected.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    near = written(projected.mapInArrow(_windows(least), "a bigint, b bigint, " + _PASS), "near")
    # borders: as many rows as there are partitions, times two windows
    borders = near.where("id is not null").drop("a", "b").distinct().repartition("pass", "grp").sortWithinPartitions(*order)
    near = near.select("a", "b").union(borders.mapInArrow(_windows(least), "a bigint, b bigint, " + _PASS).select("a", "b"))
    groups = written(components(near.where("a is not null")), "groups")

    inside = groups.join(vertices, "id").select("component_id", "id", "weight", "vector", "dims")
    sizes = inside.groupBy("component_id").agg(_blocks(F.count("*"), F.max("dims")).alias("g"))
    inside = inside.join(sizes, "component_id").select("component_id", "g", "id", "weight", "vector")
    whole = placed.where("g > 0").select(F.col("grp").alias("component_id"), "g", "id", "weight", "vector")
    found = written(_paired(inside.union(whole)).mapInArrow(_counted(least), "id bigint, n bigint, a bigint, b bigint"), "found")
    counts = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))

    rep = vertices.select("id", "rep")
    across = components(
        found.where("a is not null").select("a", "b").join(rep.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a")
        .join(rep.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        .union(members.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    )
    out = members.join(counts, "id", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"))
    out = out.join(across, out["vec_id"] == across["id"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", "n_links", own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
