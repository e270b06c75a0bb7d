"""Ball k-means: exact Lloyd rounds that compare a vector only with the centroids its ball can reach.

A cluster is a ball: its centroid, and a radius that holds all its members. Centroids whose distance is beyond twice the
radius can't take a member; the others are the ball's neighbours, in order of distance. Half of a neighbour's distance cuts
the ball into a stable core, whose members stay unseen by any other centroid, and annuli, whose members are compared with
the neighbours up to their annulus and no more. All numbers are whole, so the cuts, distances, means and ties are exact.

Spark holds the vectors and their clusters, written once a round; the driver holds k centroids and k radii.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

# Components beyond count as this: squared distances of up to 64 components then fit a long.
MOST_COMPONENT = 1 << 27
# Numbers in all centroids, which go to every task.
MOST_NUMBERS = 4_000_000


class Centroids(NamedTuple):
    """Whole-numbered centroids, their squared distances, each one's neighbours by distance, and how many its ball reaches."""

    at: np.ndarray
    between: np.ndarray
    order: np.ndarray
    reach: np.ndarray


def surroundings(at: np.ndarray, radii: list[int | None]) -> Centroids:
    """``radii``: a radius for each ball, None where it is not known. A tie at twice the radius counts as reached."""
    at = at.astype(np.int64)
    between = np.stack([((at - c) ** 2).sum(axis=1) for c in at]) if len(at) else np.zeros((0, 0), np.int64)
    order = np.argsort(between, axis=1, kind="stable")
    order = np.stack([o[o != k] for k, o in enumerate(order)]) if len(at) else order
    reach = np.array([sum(1 for i in o if r is None or int(between[k, i]) <= 4 * r * r) for k, (o, r) in enumerate(zip(order, radii))], np.int64)
    return Centroids(at, between, order, reach)


def nearest(x: np.ndarray, own: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of ``x`` (ties: the smaller number), the squared distance, and the number of
    distances worked out. ``own``: the row's ball so far."""
    best, compared = own.copy(), len(x)
    d = ((x - c.at[own]) ** 2).sum(axis=1)
    least = d.copy()
    for k in np.unique(own):
        members = np.flatnonzero(own == k)
        near = c.order[k][: c.reach[k]]
        # a neighbour at D can take or tie a member at d only if D <= 2d: the annulus is the number of such neighbours
        # (compared as a quarter of D, rounded up, which can't overflow)
        annulus = np.searchsorted(-(-c.between[k][near] // 4), d[members], side="right")
        for a, i in enumerate(near):
            rows = members[annulus > a]
            if not len(rows):
                break
            compared += len(rows)
            e = ((x[rows] - c.at[i]) ** 2).sum(axis=1)
            won = (e < least[rows]) | ((e == least[rows]) & (i < best[rows]))
            best[rows[won]], least[rows[won]] = i, e[won]
    return best, least, compared


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)


def assigned(vectors: DataFrame, c: Centroids, tile: int = 4096) -> DataFrame:
    """``vectors`` (vec_id, x, cluster, distance) with the nearest centroid of each, by its ball so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, tile):
                b = big.slice(at, tile)
                best, least, _ = nearest(_matrix(b.column("x"), b.num_rows), b.column("cluster").to_numpy().astype(np.int64), c)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "x", "cluster", "distance"])

    return vectors.mapInArrow(run, vectors.schema)


def balls(vectors: DataFrame) -> list:
    """(cluster, n, total, farthest, inertia) of every cluster: sums are made in each task first, then added as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            x, own, d = _matrix(b.column("x"), b.num_rows), b.column("cluster").to_numpy(), b.column("distance").to_numpy()
            for k in np.unique(own):
                rows = own == k
                n, far, inertia, total = found.get(int(k), (0, 0, 0, 0))
                found[int(k)] = (n + int(rows.sum()), max(far, int(d[rows].max())), inertia + sum(d[rows].tolist()), total + x[rows].sum(axis=0).astype(object))
        rows = [(k, i, n, str(far), str(inertia), str(t)) for k, (n, far, inertia, total) in found.items() for i, t in enumerate(total)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["cluster", "i", "n", "farthest", "inertia", "total"])

    parts = vectors.mapInArrow(run, "cluster int, i int, n bigint, farthest string, inertia string, total string")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    summed = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.max(big("farthest")).alias("farthest"), F.sum(big("inertia")).alias("inertia"), F.sum(big("total")).alias("total"))
    found: dict[int, list] = {}
    for r in summed.orderBy("cluster", "i").collect():  # k times dimensions
        found.setdefault(r.cluster, [r.n, int(r.farthest), int(r.inertia), []])[3].append(int(r.total))
    return [(k, *v) for k, v in found.items()]


def whole(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x) of the vectors with ``dims`` components, all of them finite, as whole numbers floor(scale * component)."""
    v = F.col("embedding")
    bad = F.exists(v, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    kept = vectors.where(v.isNotNull() & (F.size(v) == dims) & ~bad)
    bound = lambda y: F.least(F.greatest(y, F.lit(float(-MOST_COMPONENT))), F.lit(float(MOST_COMPONENT)))
    return kept.select("vec_id", F.transform(v, lambda y: F.floor(bound(F.lit(float(scale)) * y.cast("double"))).cast("int")).alias("x"))


def first_centroids(x: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of seed:vec_id (equal ones by vector); a top-k that every task cuts short."""
    named = x.select(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256).alias("h"), "x")
    return np.array([r.x for r in named.orderBy("h", "x").limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """k-means by balls: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold null or non-finite components are left out, as they have no place.
    Repeated rows and ids count each. With fewer than ``k`` vectors every one is a first centroid; a table without any
    gives no rows. Components beyond 2^27 count as 2^27, so that no squared distance passes a long; sums over clusters
    are exact and null where they pass a long. Only vec_id and embedding are read, so other columns can't clash.
    """
    if k * dims > MOST_NUMBERS or dims > 64:
        raise ValueError(f"{k} centroids of {dims} components: at most {MOST_NUMBERS} numbers go to every task, and 64 components to a squared distance")
    read = whole(vectors, dims, scale)
    at = first_centroids(read, k, seed)
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    spark = vectors.sparkSession
    if not len(at):
        return spark.createDataFrame([], out)
    # at first one ball of unknown radius holds all
    state = written(read.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), "vectors")
    radii: list[int | None] = [None] * len(at)
    for step in range(rounds + 1):
        previous, state = state, written(assigned(state, surroundings(at, radii)), "vectors")
        discard(previous)
        found = {x[0]: x[1:] for x in balls(state)}
        if step == rounds:
            break
        moved = at.copy()
        for j, (n, _, _, total) in found.items():
            moved[j] = [t // n for t in total]
        for j in range(len(at)):
            far = found[j][1] if j in found else 0
            shift = int(((moved[j] - at[j]) ** 2).sum())
            radii[j] = math.isqrt(far) + 1 + math.isqrt(shift) + 1  # what held the members still does after the centroid's move
        at = moved
    digest = lambda c: hashlib.sha256(",".join(str(int(y)) for y in c).encode()).hexdigest()
    fits = lambda n: n if n < 1 << 63 else None
    everything = sum(v[2] for v in found.values())
    table = spark.createDataFrame([(j, fits(v[2]), fits(everything), digest(at[j])) for j, v in found.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


# The rounds are written out; every vector meets every centroid.
_ASSIGN = """
a{r} as (
  select r, vec_id, x, arg_min(j, d * 16 + j) j, min(d) d
  from (
    select v.r, v.vec_id, v.x, c.j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d
    from v, c{r} c)
  group by r, vec_id, x),"""
_MOVE = """
m{r} as (
  select j, i, sum(y)::bigint s, count(*)::bigint n
  from (select j, unnest(x) y, generate_subscripts(x, 1) i from a{r}) group by j, i),
c{s} as (
  select c.j, coalesce(m.x, c.x) x
  from c{r} c left join (select j, list((s - ((s % n) + n) % n) // n order by i) x from m{r} group by j) m using (j)),"""
ORACLE = (
    """
with v as (
  select row_number() over () r, vec_id, list_transform(embedding, lambda y: floor(64.0::double * y::double)::bigint) x
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
c0 as (
  select row_number() over (order by h, x) - 1 j, x
  from (select sha256('1:' || vec_id::varchar) h, x from v order by h, x limit 16)),"""
    + "".join(_ASSIGN.format(r=r) + (_MOVE.format(r=r, s=r + 1) if r < 3 else "") for r in range(4))
    + """
t as (select j, sum(d)::bigint s from a3 group by j)
select a.vec_id, a.j::int as cluster, a.d as distance, t.s as cluster_inertia, (select sum(s) from t)::bigint as inertia,
  sha256(array_to_string(c.x, ',')) as centroid_sha256
from a3 a join t using (j) join c3 c using (j)
"""
)
