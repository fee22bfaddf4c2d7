"""Near-duplicates of embeddings by cross-polytope hashing.

1. Equal vectors become one class; what follows works on one vector per class.
2. Each vector is turned by seeded sign flips and fast Hadamard transforms; the corner of the cross-polytope (a
   coordinate with its sign) nearest to it is its hash. A few corners make a bucket of one of the tables;
   with multiprobing a vector also stands in the PROBES buckets that come next.
3. Vectors that share a bucket are candidates. Their cosines are taken in double precision, in blocks of at most
   BLOCK x BLOCK; a bucket with more vectors is dealt as pairs of blocks over several tasks. A pair counts only in
   the bucket of least code that both stand in, so nothing is counted twice and no pair needs to be listed.
4. Blocks give each vector its number of links and one link to a common vector of those linked with it; connected
   components follow from the latter.

More vectors fill the buckets; the number of corners follows theirs so that a bucket keeps a few unrelated ones, and
the number of tables follows that of the corners so that pairs are found as often.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; equal
vectors link with each other; vectors of different length don't link; a row that repeats a vec_id adds its own
links (component_id joins them anyway); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import cut, dealt, groups_of, looked_up
from lucerna.llm.components import components

THRESHOLD, TABLES, PROBES, BLOCK, SEED = 0.95, 6, 4, 1024, 10
#: Corners up to which TABLES do, and how many times more tables each further corner asks for.
FEW_CORNERS, MORE_TABLES = 4, 1.6
#: Unrelated vectors that a bucket may hold on average.
FILL = 4


def functions_for(n: int, dimensions: int) -> int:
    """Corners per bucket: enough that n vectors fill the buckets to FILL at most."""
    corners = 2 * _power(dimensions)
    return max(1, math.ceil(math.log(max(n * PROBES / FILL, 2)) / math.log(corners)))


def tables_for(functions: int) -> int:
    """Tables that find a pair at the threshold with probability 0.98 or more, as measured for 1 to 6 corners in 64 dimensions."""
    return math.ceil(TABLES * MORE_TABLES ** max(0, functions - FEW_CORNERS))


def _power(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of 2."""
    n, d = x.shape
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / math.sqrt(d)


def buckets(unit: np.ndarray, functions: int, tables: int | None = None, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(vectors, tables * probes) bucket codes. The first bucket of a table has the nearest corners; each further one
    changes the corner whose second choice is nearest, in order of that loss."""
    n, d = unit.shape
    tables = tables or tables_for(functions)
    wide = np.zeros((n, _power(d)))
    wide[:, :d] = unit
    size = wide.shape[1]
    out = np.empty((n, tables * probes), np.int64)
    for t in range(tables):
        corner, other, loss = [], [], []
        for f in range(functions):
            signs = np.random.default_rng([seed, t, f, size]).choice([-1.0, 1.0], (3, size))
            x = wide
            for s in signs:
                x = hadamard(x * s)
            height = np.abs(x)
            top = np.argpartition(-height, min(probes, size - 1), axis=1)[:, : probes + 1]
            rows = np.arange(n)[:, None]
            top = np.take_along_axis(top, np.argsort(-height[rows, top], axis=1, kind="stable"), axis=1)
            code = top * 2 + (x[rows, top] < 0)
            corner.append(code[:, 0])
            other.append(code[:, 1:])
            loss.append(height[rows, top[:, :1]] - height[rows, top[:, 1:]])
        base = 2 * size
        key = np.full(n, t, np.int64)
        for c in corner:
            key = key * base + c
        losses = np.concatenate(loss, axis=1)
        ranked = np.argsort(losses, axis=1, kind="stable")[:, : probes - 1]
        width = losses.shape[1] // functions
        out[:, t * probes : (t + 1) * probes] = key[:, None]  # vectors of few dimensions have fewer other corners
        for p in range(ranked.shape[1]):
            which, choice = ranked[:, p] // width, ranked[:, p] % width
            key = np.full(n, t, np.int64)
            for f, c in enumerate(corner):
                key = key * base + np.where(which == f, other[f][np.arange(n), choice], c)
            out[:, t * probes + p + 1] = key
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _compare(ids, weights, vectors, codes, side, two: bool, code: int, threshold: float) -> dict[str, np.ndarray]:
    """The links of one block, or between two, that belong to this bucket: per vector the number of vectors linked and a root."""
    unit = _unit(vectors)
    rows = np.flatnonzero(side != 1)
    cols = np.flatnonzero(side == 1) if two else rows  # one of two blocks may be empty
    close = unit[rows] @ unit[cols].T >= threshold
    if not two:
        close = np.triu(close, 1)
    a, b = np.nonzero(close)
    a, b = rows[a], cols[b]
    if len(a):
        step = 200_000
        first = np.concatenate([_least_shared(codes[a[k : k + step]], codes[b[k : k + step]]) for k in range(0, len(a), step)])
        a, b = a[first == code], b[first == code]
    n = np.bincount(a, weights[b], len(ids)) + np.bincount(b, weights[a], len(ids))
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return {"rep": ids, "n": n.astype(np.int64), "root": ids[root]}


def _least_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least of x's codes that is also among y's, so the same from both ends; the greatest number if none is."""
    none = np.iinfo(np.int64).max
    out = np.full(len(x), none, np.int64)
    for k in range(x.shape[1]):
        np.minimum(out, np.where((x[:, k : k + 1] == y).any(1), x[:, k], none), out=out)
    return out


def keyed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, key) for each row; equal vectors share a key, one that can't link has neither vector nor key."""
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.withColumn("vector", F.when(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)), F.transform("vector", lambda x: F.when(x == 0, 0.0).otherwise(x))))
    text = F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")
    return v.withColumn("key", F.sha2(text, 256))


def links(reps: DataFrame, functions: int, threshold: float = THRESHOLD) -> DataFrame:
    """reps (rep, size, vector): rows (rep, n, root) whose n add up to the vectors linked with rep outside its class."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length in pc.unique(pc.list_value_length(batch.column(1))).to_pylist():
                part = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), length))
                codes = buckets(_unit(_matrix(part.column(1))), functions)
                key = codes * 4099 + length  # only vectors of one length meet
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, key.shape[1], dtype=np.int32)), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["rep", "codes"])

    coded = cut(reps.select("rep", "vector").mapInArrow(hashed, "rep long, codes array<bigint>"))
    entries = coded.select("rep", F.explode(F.array_distinct("codes")).alias("code"))
    spread = dealt(entries, ["code"], "rep", BLOCK)
    full = spread.join(reps.select("rep", "size", "vector").join(coded, "rep"), "rep").select("code", "low", "high", "side", "rep", "size", "vector", "codes")
    keys = ["code", "low", "high"]
    grouped = full.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for t in groups_of(batches, keys):
            vectors, codes = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for c in ("vector", "codes"))
            held.append(_compare(t["rep"].to_numpy(), t["size"].to_numpy(), vectors, codes, t["side"].to_numpy(), t["low"][0].as_py() != t["high"][0].as_py(), t["code"][0].as_py(), threshold))
            size += len(t)
            if size > 50_000:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    def told(found: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        cols = {k: np.concatenate([f[k] for f in found]) for k in ("rep", "n", "root")}
        linked = (cols["n"] > 0) | (cols["root"] != cols["rep"])
        return pa.RecordBatch.from_arrays([pa.array(v[linked]) for v in cols.values()], list(cols))

    return grouped.mapInArrow(compare, "rep long, n long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: its id, n_links, component_id and kept."""
    rows = keyed(vectors, id_col, vector_col)
    reps = rows.where("vector is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.any_value("vector").alias("vector"))
    reps = cut(reps)
    seen = reps.agg(F.count("*"), F.max(F.size("vector"))).first()
    found = cut(links(reps, functions_for(seen[0], seen[1] or 1), threshold))
    per_rep = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = cut(components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    label = cut(
        reps.join(per_rep, "rep", "left")
        .join(named.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = looked_up(rows.where("key is not null").select("id", "key"), label, ["key"], "size").select("id", "n_links", "component_id")
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
