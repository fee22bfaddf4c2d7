"""Clustering of vectors round centroids, by a vantage-point tree over the centroids.

1. Vectors of DIMENSIONS finite components become integers floor(SCALE * x), so that distances and sums are exact.
2. The k vectors whose sha256 of "seed:id" is least are the first centroids.
3. Each round builds a vantage-point tree over the centroids on the driver (k vectors) and broadcasts it. Every vector
   searches the tree best first: of its open nodes the one with the least bound is next, and a node is left out only if
   its bound lies above the best distance, so that nodes at just that distance are still opened and the smaller number
   wins a tie. Bounds are square roots with a margin for rounding; the distances that decide are integers.
4. Tasks add up the components of each cluster's vectors; a centroid moves to the floor of the mean.

All vectors of a batch search at once: in each step every vector opens one node of its own. What a task sends is one row a
cluster, what the driver gathers is k * DIMENSIONS numbers a round. The vectors are never shuffled.

Defined results: a vector that is null, of another length, or with a null or non-finite component is left out; components
are held within +-LIMIT, as distances would pass 64 bits beyond; of vectors with equal hashes (a repeated or null id) the
smaller one is first; equal centroids are told apart by number, the smaller one takes their vectors; a sum of distances over
64 bits is null; fewer vectors than k give fewer centroids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import cut

K, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, "1"
#: Components are held within this, so that a squared distance stays below 2**62 at 64 dimensions.
LIMIT = 1 << 26
#: Centroids that a leaf of the tree holds at most.
LEAF = 2
#: Vectors that search the tree together.
TOGETHER = 4096
#: Share of the distances compared that rounding may be off by; nodes within it are opened.
MARGIN = 1e-12


@dataclass
class Tree:
    """Nodes of a vantage-point tree. An inner node has a vantage centroid and two children, each with the least and
    greatest distance of its centroids from the vantage; a leaf has a few centroids. Every centroid stands in one place."""

    centroids: np.ndarray
    vantage: list[int]
    leaf: list[list[int]]
    children: list[tuple[tuple[int, float, float], ...]]


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = rows - point
    return np.einsum("ij,ij->i", d, d)


def build(centroids: np.ndarray) -> Tree:
    """The vantage of a node is its centroid farthest from the others (ties: the smaller number); the median of the distances parts its children."""
    tree = Tree(centroids, [], [], [])

    def add(members: list[int]) -> int:
        node = len(tree.vantage)
        tree.vantage.append(-1)
        tree.leaf.append([])
        tree.children.append(())
        if len(members) <= LEAF:
            tree.leaf[node] = members
            return node
        spread = [int(squared(centroids[members], centroids[m]).max()) for m in members]
        vantage = members[int(np.argmax(spread))]
        rest = [m for m in members if m != vantage]
        far = squared(centroids[rest], centroids[vantage])
        order = np.argsort(far, kind="stable")
        half = len(rest) // 2
        parts = [order[:half], order[half:]]
        tree.vantage[node] = vantage
        tree.children[node] = tuple((add([rest[i] for i in p]), math.sqrt(int(far[p].min())), math.sqrt(int(far[p].max()))) for p in parts if len(p))
        return node

    if len(centroids):
        add(list(range(len(centroids))))
    return tree


def nearest(tree: Tree, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row (ties: the smaller number), and how many distances were taken."""
    n = len(rows)
    best = np.full(n, np.iinfo(np.int64).max)
    number = np.full(n, len(tree.centroids))
    bound = np.full((n, len(tree.vantage)), np.inf)  # of the nodes that are open for a row
    bound[:, 0] = 0.0
    taken = 0

    def try_centroid(who: np.ndarray, c: int) -> np.ndarray:
        d = squared(rows[who], tree.centroids[c])
        better = (d < best[who]) | ((d == best[who]) & (c < number[who]))
        best[who[better]] = d[better]
        number[who[better]] = c
        return d

    active = np.arange(n)
    while len(active):
        node = bound[active].argmin(1)
        lowest = bound[active, node]
        reach = np.sqrt(best[active].astype(np.float64))
        go = lowest <= reach + MARGIN * (lowest + reach)  # inclusive: a bound at just the best distance is opened
        go &= np.isfinite(lowest)
        active, node = active[go], node[go]
        bound[active, node] = np.inf
        for one in np.unique(node):
            who = active[node == one]
            for c in tree.leaf[one]:
                try_centroid(who, c)
                taken += len(who)
            if tree.vantage[one] >= 0:
                d = np.sqrt(try_centroid(who, tree.vantage[one]).astype(np.float64))
                taken += len(who)
                for child, low, high in tree.children[one]:
                    away = np.maximum(np.maximum(d - high, low - d), 0.0)
                    bound[who, child] = np.maximum(away - MARGIN * (d + high), 0.0)
    return number, best, taken


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    v = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    fine = (F.size("x") == dimensions) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT))))
    return v.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("x", held).alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The k vectors whose hash of seed and id is least, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(key, "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64) if found else np.zeros((0, 0), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            yield part, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; without a vector it stays."""
    tree = rows.sparkSession.sparkContext.broadcast(build(centroids))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = tree.value.centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for _, x in _blocks(batches):
            number, _, _ = nearest(tree.value, x)
            count += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            present = np.unique(number)
            total[present] += np.add.reduceat(x[order], np.searchsorted(number[order], present), axis=0)
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * d), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), lists], ["cluster", "n", "total"])

    parts = rows.mapInArrow(added, "cluster int, n long, total array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "s"))
    found = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = centroids.copy()
    for r in found:
        out[r.cluster, r["at"]] = int(r.s) // r.n
    tree.unpersist()
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each row."""
    tree = rows.sparkSession.sparkContext.broadcast(build(centroids))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            number, best, _ = nearest(tree.value, x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(told, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row per vector that takes part: id, cluster, distance, cluster_inertia, inertia and the hash of its centroid."""
    rows = whole(vectors, id_col, vector_col, dimensions, scale)
    centroids = first_centroids(rows, k, seed)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(rows, centroids)
        found = cut(assigned(rows, centroids))
    else:
        found = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    sizes = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()
    spark, inertia = vectors.sparkSession, [r.cluster_inertia for r in sizes]
    total = None if None in inertia or sum(inertia) >= 1 << 63 else sum(inertia)
    told = [(r.cluster, r.cluster_inertia, total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sizes]
    per = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return found.join(F.broadcast(per), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same in SQL, round by round: distances to all centroids."""
    near = lambda c: (
        f"select vec_id, v, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance from (select k.rn, k.vec_id, k.v, c.cluster, "
        f"list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT as d from kept k cross join {c} c) group by rn, vec_id, v"
    )
    steps = [
        f"whole as (select vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] as v from embeddings where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "kept as (select row_number() over (order by vec_id, v) as rn, vec_id, v from whole)",
        f"c0 as (select (row_number() over (order by sha256('{SEED}:' || vec_id::VARCHAR), v) - 1)::INTEGER as cluster, v as c from kept order by sha256('{SEED}:' || vec_id::VARCHAR), v limit {K})",
    ]
    for r in range(ROUNDS):
        steps += [
            f"a{r} as materialized ({near(f'c{r}')})",
            f"s{r} as (select cluster, pos, sum(x) as s, count(*) as n from (select cluster, unnest(v) as x, unnest(range(len(v))) as pos from a{r}) group by 1, 2)",
            f"m{r} as (select cluster, list(((s - (((s % n) + n) % n)) // n)::BIGINT order by pos) as c from s{r} group by 1)",
            f"c{r + 1} as materialized (select o.cluster, coalesce(m.c, o.c) as c from c{r} o left join m{r} m using (cluster))",
        ]
    steps.append(f"z as materialized ({near(f'c{ROUNDS}')})")
    return (
        f"with {', '.join(steps)} select vec_id, z.cluster, distance, (sum(distance) over (partition by z.cluster))::BIGINT as cluster_inertia, "
        f"(sum(distance) over ())::BIGINT as inertia, sha256(array_to_string(f.c, ',')) as centroid_sha256 from z join c{ROUNDS} f on f.cluster = z.cluster"
    )


CENTROIDS_SQL = _sql()
