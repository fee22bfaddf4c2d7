"""What several operators share: reading, cutting lineage and handling Arrow batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token everywhere in this subpackage: a run of characters other than ASCII white space.
#: bytes.split() without arguments splits at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker handles at a time; bounds its memory whatever the batch size.
SLICE_BYTES = 1_000_000
#: Bytes of a batch that a task hands to its Python worker: Spark holds it twice outside its heap, the worker once more.
BATCH_BYTES = 6_000_000
#: The most keys that looked_up() broadcasts, and the rows from which a key is one of them.
HOT, HOT_ROWS = 1000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; without it one in the warehouse, which a cluster shares too."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lucerna"


_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again: a lost executor costs no recomputation."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/lucerna/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lucerna_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def remove(*tables: DataFrame) -> None:
    """Deletes what cut() wrote for these tables, which nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._lucerna_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what cut() wrote within: for work whose result is written before the block ends."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at about BATCH_BYTES, unless it has a limit of its own. No result depends on them."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(limit, spark.conf.get(limit, f"{BATCH_BYTES}b"))


def looked_up(rows: DataFrame, unique: DataFrame, key: list[str], n: str) -> DataFrame:
    """The inner join of rows with a table that has one row per key and in column n how many of the rows have it.

    Of the keys with over HOT_ROWS rows the HOT with most are broadcast, so HOT narrow rows in all; any other key has at
    most HOT_ROWS rows or 1 / HOT of them all. However many rows share a key, they never meet in one task.
    unique should be cut and must be narrow. The broadcast keys pass as Arrow: rows of Python objects would start a second set of
    Python workers in every executor, which stay.
    """
    hot = unique.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n), *key).limit(HOT).toArrow()
    if not hot.num_rows:
        return rows.join(unique, key)
    top = F.broadcast(rows.sparkSession.createDataFrame(hot, unique.schema))
    keys = F.broadcast(top.select(*key))
    return rows.join(top, key).unionByName(rows.join(keys, key, "left_anti").join(unique.join(keys, key, "left_anti"), key))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about `size` bytes of text (SLICE_BYTES unless given) or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // (size or SLICE_BYTES)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows sorted by integer keys, each as one table; holds one group and one batch at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        values = np.stack([t[k].to_numpy() for k in keys], 1)
        edges = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(1)]))
        for a, b in zip(edges, [*edges[1:], len(values)]):
            key = tuple(values[a].tolist())
            if key != last and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            last = key
            held.append(t.slice(int(a), int(b - a)))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def dealt(members: DataFrame, bucket: list[str], name: str, block: int, main: str | None = None) -> DataFrame:
    """members with low, high and side, so that any two members of a bucket meet in one group (bucket, low, high).

    A bucket of up to `block` members is one group. A larger one is cut into parts by the hash of `name`; a group then
    holds one part, or two of them, told apart by side (0 and 1; only rows of different sides are to be compared).
    Buckets of a single member are left out.

    main: a boolean column; members of the main part of their bucket need not meet each other, only all the others.
    """
    chief = F.lit(False) if main is None else F.col(main)
    sizes = members.groupBy(*bucket).agg(F.count("*").alias("_n"), F.count_if(chief).alias("_m")).where("_n > 1 and _n > _m")
    # parts of the main members come first; where all fit into one block there is one part of both kinds
    one = F.col("_n") <= block
    sizes = cut(sizes.withColumn("_main", F.when(one, 0).otherwise(F.ceil(F.col("_m") / block))).withColumn("_parts", F.when(one, 1).otherwise(F.col("_main") + F.ceil((F.col("_n") - F.col("_m")) / block))))
    here = F.xxhash64(name)
    part = F.when(chief & (F.col("_main") > 0), F.pmod(here, F.col("_main"))).otherwise(F.col("_main") + F.pmod(here, F.greatest(F.col("_parts") - F.col("_main"), F.lit(1)))).cast("int")
    with_part = looked_up(members, sizes, bucket, "_n").withColumn("_part", part)
    first = F.when(F.col("_part") < F.col("_main"), F.col("_main")).otherwise(F.lit(0))
    both = with_part.withColumn("_other", F.explode(F.sequence(first.cast("int"), (F.col("_parts") - 1).cast("int"))))
    placed = both.withColumn("low", F.least("_part", "_other")).withColumn("high", F.greatest("_part", "_other"))
    return placed.withColumn("side", F.when(F.col("_part") > F.col("low"), 1).otherwise(0)).drop("_n", "_m", "_main", "_parts", "_part", "_other")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


#: Bytes of a search term: ASCII letters (capitals as small ones) and digits, and all of what is not ASCII; other bytes part terms.
_TERM = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Bytes of a text that are split at a time.
PIECE = 1_000_000


def folded(term: bytes) -> bytes:
    return term.translate(_TERM)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of about PIECE bytes of it: maximal runs of letters, digits and characters beyond ASCII."""
    text = text.translate(_TERM)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of the given lengths; 0 for an empty run."""
    ends = np.cumsum(lengths)
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends] - total[ends - lengths]


#: Bytes that a hash sees: capital A-Z as small letters, white space marked by 0.
_FOLDED = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLDED[65:91] += np.uint64(32)
_FOLDED[[9, 10, 11, 12, 13, 32]] = 0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, A-Z lower-cased, of all texts in order, and the number of words of each text.

    The same on every machine.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    letter = (_FOLDED > 0)[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    at = np.flatnonzero(letter).astype(np.int32)  # narrow types, as these arrays are most of a worker's memory
    place = at - np.repeat(starts.astype(np.int32), np.add.reduceat(letter, starts, dtype=np.int32))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()), _ODD)]), dtype=np.uint64)
    begin = np.searchsorted(at, starts)
    value = power[place]
    value *= _FOLDED[raw[at]]
    return scramble(np.add.reduceat(value, begin)), counts
