"""A search index of evidence units that lives (R10, ST5): kept in segments, appended to, and searched as one.

A segment is what one write adds, in folders of its number:

- units: id, session_id, asset_id, length in tokens, and the unit's postings: its distinct tokens, sorted, with their tf
  weighted by column, and shared: how many first characters each has in common with the one before it.
- frequencies: token, shared, n: in how many units a token stands with so many shared characters. A prefix longer than
  shared meets this token first in its unit, so the units that hold a prefix are counted from these few rows.
- gone: asset_id of each asset that the segment writes anew or deletes. It ends the asset's units of all segments before.

Numbers order the segments, not the time of writing; a segment written twice is the same. compacted() writes the living units
of all segments as one. A unit is a row with all its postings, so it is scored where it is read and only the best of each
task are sent on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.functions.batches import NO_SPACE, WORD_BYTES, runs
from lucerna.sources.tables import settle

#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Weight of each column of a unit.
COLUMN_WEIGHTS = {"title": 1.0, "excerpt": 0.5, "content_text": 1.0, "search_text": 1.0}
#: Units that a task handles together; pairs of question and prefix that are searched in one pass.
TOGETHER, ASKED = 2000, 200_000
#: First characters of tokens that are compared all at once.
FIRST = 24
#: As many assets that were written again or deleted, or fewer, are broadcast, so that units are not shuffled; with more the index should be compacted.
FEW_ENDED = 500_000


@dataclass
class Index:
    """The living units of an index with their postings, and the frequencies of their tokens."""

    units: DataFrame
    frequencies: DataFrame


NO_WORD = r"[^\p{L}\p{N}]+"


def _folded(c: Column | str) -> Column:
    """In lower case and without diacritics, which only texts beyond ASCII can have."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.when(F.octet_length(text) > F.length(text), X.without_marks(text)).otherwise(F.lower(text))


def words(c: Column | str) -> Column:
    """The tokens of a text: runs of letters and digits, in lower case and without diacritics."""
    return F.filter(F.split(_folded(c), NO_WORD), lambda w: w != "")


def _spaced(low: Column) -> Column:
    """A text in lower case, so that its runs of WORD_BYTES are its tokens; within ASCII they are that already."""
    return F.when(F.octet_length(low) > F.length(low), F.regexp_replace(X.unmarked(low), NO_WORD, " ")).otherwise(low)


def _once(n_rows: int, same: list[pa.Array], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Of each column and row the weight of its text and how often it counts: where same names an earlier column with that text, with that one."""
    sums, times = np.repeat(np.array(weights, np.float64)[:, None], n_rows, axis=1), np.ones((len(weights), n_rows))
    for k, column in enumerate(same, 1):
        at = pc.fill_null(column, -1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(at >= 0)
        sums[at[rows], rows] += weights[k]
        times[at[rows], rows] += 1
    return sums, times


UNITS = "id string, session_id string, asset_id string, length long, tokens array<string>, tfs array<double>, shared array<int>"


def postings(units: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """UNITS of units (id, session_id, asset_id if known, and the columns of weights). A unit is one row, so its tokens are counted where it is read; no shuffle."""
    weights = weights or COLUMN_WEIGHTS
    asset = F.col("asset_id") if "asset_id" in units.columns else F.lit(None)
    kinds = [F.col("id").cast("string").alias("id"), F.col("session_id").cast("string").alias("session_id"), asset.cast("string").alias("asset_id")]
    low = units.select(*kinds, *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"w{k}") for k, c in enumerate(weights)])
    same = [F.coalesce(*[F.when(F.col(f"w{k}") == F.col(f"w{j}"), j) for j in range(k)]) for k in range(1, len(weights))]  # a text that is there already is split once
    told = [F.lit(None).cast("int"), *same]
    each = low.select("id", "session_id", "asset_id", *[F.when(x.isNull(), _spaced(F.col(f"w{k}"))).otherwise("").alias(f"w{k}") for k, x in enumerate(told)], *same)  # words, as texts: lists take longer to hand over

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                found = [runs(batch.column(3 + k), WORD_BYTES) for k in range(len(weights))]
                sums, times = _once(batch.num_rows, batch.columns[3 + len(weights) :], list(weights.values()))
                weight, times = (np.concatenate([x[k][f[0]] for k, f in enumerate(found)]) for x in (sums, times))
                row = np.concatenate([x[0] for x in found])
                distinct, number = _numbered(pa.concat_arrays([x[1] for x in found]))  # so that numbers are sorted and counted, not texts
                key, where = np.unique(row * max(len(distinct), 1) + number, return_inverse=True)
                at, number = key // max(len(distinct), 1), key % max(len(distinct), 1)
                ends = pa.array(np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32))
                tf = np.bincount(where, weight, len(key))
                listed = [pa.ListArray.from_arrays(ends, x) for x in (distinct.take(pa.array(number)), pa.array(tf, pa.float64()), pa.array(_in_common(distinct.to_pylist(), number, at), pa.int32()))]
                size = np.bincount(row, times, batch.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), *listed], [c.split()[0] for c in UNITS.split(", ")])

    return each.mapInArrow(counted, UNITS)


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct texts in order, and each text's number among them."""
    coded = texts.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def _in_common(distinct: list[str], number: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many first characters each token (its number among the distinct ones, which are in order) shares with the one before it in its row.

    Two tokens share as much as the least that neighbours between them in the order do; least holds it for runs of 1, 2, 4, ... neighbours.
    """
    near = np.zeros(len(distinct), np.int32)
    letters = np.array(distinct, f"U{FIRST}").view(np.uint32).reshape(len(distinct), -1)[:, :FIRST] if len(distinct) else np.zeros((0, FIRST), np.uint32)
    near[1:] = np.logical_and.accumulate((letters[1:] == letters[:-1]) & (letters[1:] != 0), axis=1).sum(axis=1)
    for k in np.flatnonzero(near == FIRST):
        a, b = distinct[k - 1], distinct[k]
        near[k] = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    least = [near]
    while 2 << (len(least) - 1) <= len(near):
        last, half = least[-1], 1 << (len(least) - 1)
        least.append(np.minimum(last[:-half], last[half:]))
    out = np.zeros(len(number), np.int32)
    follows = np.flatnonzero(rows[1:] == rows[:-1]) + 1 if len(rows) else np.zeros(0, np.int64)
    first, last = number[follows - 1] + 1, number[follows]
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    for k, run in enumerate(least):
        some = level == k
        out[follows[some]] = np.minimum(run[first[some]], run[last[some] - (1 << k) + 1])
    return out


def frequencies_of(units: DataFrame) -> DataFrame:
    """token, shared, n of units with postings; counted task by task before they are sent."""
    each = units.where("size(tokens) > 0").select(F.array_join("tokens", " ").alias("tokens"), "shared")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = runs(batch.column(0), NO_SPACE)[1].dictionary_encode()
            shared = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            step = int(shared.max(initial=0)) + 1
            key, n = np.unique(coded.indices.to_numpy(zero_copy_only=False) * np.int64(step) + shared, return_counts=True)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key // step)), pa.array(key % step, pa.int32()), pa.array(n, pa.int64())], ["token", "shared", "n"])

    return each.mapInArrow(counted, "token string, shared int, n long").groupBy("token", "shared").agg(F.sum("n").alias("n"))


def built(units: DataFrame, weights: dict[str, float] | None = None) -> Index:
    """An index of these units alone, written to the folder for tables in between."""
    found = settle(postings(units, weights))
    return Index(found, settle(frequencies_of(found)))


def is_there(index: Index) -> bool:
    """Whether the tables that an index was built into have not been removed."""
    spark = index.units.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]) for df in (index.units, index.frequencies) if df.inputFiles()]
    return len(paths) == 2 and all(p.getFileSystem(conf).exists(p) for p in paths)


# --- segments


def _listed(spark: SparkSession, pattern: str) -> list[int]:
    """The numbers N of the folders "...=N/..." that a pattern names, by the file system of the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    at = pattern.rstrip("/").split("/")[::-1].index(next(p for p in pattern.split("/")[::-1] if "=*" in p))
    return [int(f.getPath().toString().rstrip("/").split("/")[::-1][at].split("=")[1]) for f in found or []]


def _folder(root: str, spark: SparkSession) -> str:
    """The latest whole generation of the index."""
    return f"{root}/generation={max(_listed(spark, f'{root}/generation=*/whole/_SUCCESS'), default=0)}"


def write_segment(root: str, number: int, units: DataFrame, gone: DataFrame) -> None:
    """Adds units, and ends what earlier segments hold of the assets in gone (asset_id, deleted). The last part tells that the segment is whole."""
    spark = units.sparkSession
    folder = _folder(root, spark)
    at = lambda name: f"{folder}/{name}/segment={number}"
    postings(units).write.mode("overwrite").parquet(at("units"))
    frequencies_of(spark.read.schema(UNITS).parquet(at("units"))).write.mode("overwrite").parquet(at("frequencies"))
    gone.select(F.col("asset_id").cast("string").alias("asset_id"), F.col("deleted").cast("boolean").alias("deleted")).distinct().write.mode("overwrite").parquet(at("gone"))


def delete_assets(root: str, assets: DataFrame) -> None:
    """Ends all units of these assets (asset_id), in a segment after the last."""
    spark = assets.sparkSession
    none = spark.createDataFrame([], "id string, session_id string, asset_id string, title string, excerpt string, content_text string, search_text string")
    write_segment(root, last_segment(spark, root) + 1, none, assets.select("asset_id", F.lit(True).alias("deleted")))


def last_segment(spark: SparkSession, root: str) -> int:
    return max(_listed(spark, f"{_folder(root, spark)}/gone/segment=*/_SUCCESS"), default=-1)


_SCHEMA = {"units": f"{UNITS}, segment long", "frequencies": "token string, shared int, n long, segment long", "gone": "asset_id string, deleted boolean, segment long"}


def _part(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A part of all segments; parts are written one after the other, and a segment counts once its last one, gone, is there."""
    paths = [f"{folder}/{name}/segment={n}" for n in _listed(spark, f"{folder}/gone/segment=*/_SUCCESS")]
    return spark.read.schema(_SCHEMA[name]).option("basePath", f"{folder}/{name}").parquet(*paths) if paths else spark.createDataFrame([], _SCHEMA[name])


def load(spark: SparkSession, root: str) -> Index:
    """The index with what all segments hold. Assets written again or deleted, of which there are few, end their units; the frequencies of these are taken off."""
    folder = _folder(root, spark)
    every = _part(spark, folder, "gone").groupBy("asset_id").agg(F.max("segment").alias("_last"), F.max_by("deleted", "segment").alias("_deleted"), F.count("*").alias("n"))
    ended = settle(every.where("n > 1 or _deleted").drop("n"))
    if ended.count() <= FEW_ENDED:
        ended = F.broadcast(ended)
    units = _part(spark, folder, "units")
    dead = (F.col("segment") < F.col("_last")) | F.col("_deleted")
    living = units.join(ended, "asset_id", "left").where(F.col("_last").isNull() | ~dead).drop("_last", "_deleted", "segment").select(*[c.split()[0] for c in UNITS.split(", ")])
    lost = frequencies_of(units.join(ended, "asset_id").where(dead))
    told = _part(spark, folder, "frequencies").drop("segment").unionByName(lost.withColumn("n", -F.col("n"))).groupBy("token", "shared").agg(F.sum("n").alias("n")).where("n > 0")
    return Index(living, told)


def compacted(spark: SparkSession, root: str) -> None:
    """Writes the living units as one segment of a new generation, which is read once it is whole. Nothing may be written meanwhile."""
    old, last = _folder(root, spark), last_segment(spark, root)
    if last < 0:
        return
    new = f"{root}/generation={int(old.rsplit('=', 1)[1]) + 1}"
    load(spark, root).units.write.mode("overwrite").parquet(f"{new}/units/segment={last}")
    units = spark.read.schema(UNITS).parquet(f"{new}/units/segment={last}")
    frequencies_of(units).write.mode("overwrite").parquet(f"{new}/frequencies/segment={last}")
    units.select("asset_id", F.lit(False).alias("deleted")).distinct().write.mode("overwrite").parquet(f"{new}/gone/segment={last}")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{new}/whole")


# --- search


def query_prefixes(question: Column, most: int = 8) -> Column:
    """The first words of two characters or more; each stands for all words that begin so. A letter with a diacritic parts words here."""
    found = F.split(F.regexp_replace(F.lower(question), "[^a-z0-9]+", " "), " ")
    return F.slice(F.filter(found, lambda w: F.length(w) >= 2), 1, most)


@dataclass
class _Asked:
    """A block of questions: prefixes by length, each with its number, weight, and the questions of each session that hold it, with how often."""

    by_length: dict[int, tuple[pa.Array, np.ndarray]]
    idf: np.ndarray
    sessions: dict[str, int]
    keys: np.ndarray  # session * prefixes + prefix, sorted
    question: np.ndarray
    times: np.ndarray
    place: np.ndarray  # each question's place among those of its session
    of_session: np.ndarray  # the questions by session and place, those of a session from starts on
    starts: np.ndarray


def _asked(rows: list[tuple[int, str, str]], df: dict[str, int], n_units: int) -> _Asked:
    """rows: (question, session, prefix) as often as it is asked."""
    prefixes = sorted({p for _, _, p in rows})
    number = {p: k for k, p in enumerate(prefixes)}
    sessions = {s: k for k, s in enumerate(sorted({s for _, s, _ in rows}))}
    idf = np.array([max(math.log((n_units - df.get(p, 0) + 0.5) / (df.get(p, 0) + 0.5)), LEAST_IDF) for p in prefixes])
    by_length: dict[int, tuple[pa.Array, np.ndarray]] = {}
    for size in sorted({len(p) for p in prefixes}):
        some = [p for p in prefixes if len(p) == size]
        by_length[size] = pa.array(some, pa.string()), np.array([number[p] for p in some])
    many = Counter(rows)
    each = sorted((sessions[s] * len(prefixes) + number[p], q, n) for (q, s, p), n in many.items())
    keys, question, times = (np.array(x, np.int64) for x in zip(*each))
    of = {q: sessions[s] for q, s, _ in rows}
    of_session = np.array(sorted(of, key=lambda q: (of[q], q)), np.int64)
    starts = np.searchsorted([of[q] for q in of_session.tolist()], np.arange(len(sessions)))
    place = np.zeros(max(of) + 1, np.int64)
    place[of_session] = np.arange(len(of_session)) - starts[[of[q] for q in of_session.tolist()]]
    return _Asked(by_length, idf, sessions, keys, question, times, place, of_session, starts)


def _scores(batch: pa.RecordBatch, a: _Asked, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, rank) of each question and unit of its session that is hit."""
    row, flat = runs(batch.column(3), NO_SPACE)
    tf = pc.list_flatten(batch.column(4)).to_numpy(zero_copy_only=False)
    session = np.array([a.sessions[s] for s in batch.column(1).to_pylist()], np.int64)
    n = len(a.idf)
    coded = flat.dictionary_encode()  # each distinct token is looked up once
    token = coded.indices.to_numpy(zero_copy_only=False)
    rows, found, weights = [], [], []
    for size, (texts, numbers) in a.by_length.items():
        at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(coded.dictionary, 0, size), texts), -1).to_numpy(zero_copy_only=False)
        if not (at >= 0).any():
            continue
        at = at[token]
        hit = np.flatnonzero(at >= 0)
        prefix = numbers[at[hit]]
        some = _among(session[row[hit]] * n + prefix, a.keys)  # prefixes that the row's session asks for
        rows.append(row[hit][some])
        found.append(prefix[some])
        weights.append(tf[hit][some])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows, found, weights = map(np.concatenate, (rows, found, weights))
    key, where = np.unique(rows * n + found, return_inverse=True)
    tf = np.bincount(where, weights, len(key))
    rows, found = key // n, key % n
    lengths = batch.column(2).to_numpy(zero_copy_only=False)
    part = a.idf[found] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[rows] / mean))
    wanted = session[rows] * n + found
    first, last = np.searchsorted(a.keys, wanted), np.searchsorted(a.keys, wanted, "right")
    many = last - first
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    question, row = a.question[at], np.repeat(rows, many)
    pairs, rank = _summed(a.place[question] * batch.num_rows + row, np.repeat(part, many) * a.times[at], int(a.place.max(initial=0) + 1) * batch.num_rows)
    row, place = pairs % batch.num_rows, pairs // batch.num_rows
    return a.of_session[a.starts[session[row]] + place], row, np.round(rank, 9)


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted keys, of which there is one at least."""
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _summed(key: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, all below size, and the sum of each one's values; sorted only where keys are few beside size."""
    if size > max(4 * len(key), 1 << 20):
        each, where = np.unique(key, return_inverse=True)
        return each, np.bincount(where, values, len(each))
    each = np.flatnonzero(np.bincount(key, minlength=size))
    return each, np.bincount(key, values, size)[each]


def _blocks(asked: DataFrame) -> Iterator[list]:
    """The questions (question_id, session_id, prefixes), in blocks of about ASKED prefixes; one block is on the driver at a time."""
    block, size = [], 0
    for r in asked.toLocalIterator():
        block.append(r)
        size += len(r.prefixes)
        if size >= ASKED:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(questions: DataFrame, index: Index, most: int | None) -> DataFrame:
    """The best units of each question's session: question_id, id, rank, place. Statistics are those of all living units.
    With most None, all units that are hit, in no order and without their place.

    Questions are taken in blocks, each a pass over the units of its sessions; only a block's prefixes are broadcast. A task
    scores each unit where it is read and sends its best of each question. Ranks are rounded to nine decimals, so that sums in
    another order are the same.
    """
    spark = questions.sparkSession
    id_type = questions.schema["question_id"].dataType.simpleString()
    ready = questions.select("question_id", F.col("session_id").cast("string").alias("session_id"), query_prefixes(F.col("question")).alias("prefixes")).where("size(prefixes) > 0 and session_id is not null")
    n_units, all_length = index.units.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    out = spark.createDataFrame([], f"question_id {id_type}, id string, rank double")
    for block in _blocks(ready):
        texts = spark.sparkContext.broadcast(sorted({p for r in block for p in r.prefixes}))
        held = index.frequencies.select("token", "shared", "n").mapInArrow(_held(texts), "prefix string, n long")
        df = {r.prefix: r.n for r in held.groupBy("prefix").agg(F.sum("n").alias("n")).collect()}
        asked = _asked([(k, r.session_id, p) for k, r in enumerate(block) for p in r.prefixes], df, n_units)
        shared = spark.sparkContext.broadcast((asked, all_length / max(n_units, 1) or 1.0))
        sessions = spark.createDataFrame([(s,) for s in asked.sessions], "session_id string")
        read = index.units.where("size(tokens) > 0").select("id", "session_id", "length", F.array_join("tokens", " ").alias("tokens"), "tfs")
        found = read.join(F.broadcast(sessions), "session_id", "left_semi").select(*read.columns).mapInArrow(_task(shared, most), "question long, id string, rank double")  # a block's sessions
        names = F.broadcast(spark.createDataFrame([(k, r.question_id) for k, r in enumerate(block)], f"question long, question_id {id_type}"))
        out = out.unionByName(found.join(names, "question").select("question_id", "id", "rank"))
    if most is None:
        return out
    order = Window.partitionBy("question_id").orderBy(F.desc("rank"), "id")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("question_id", "id", "rank", "place")


def _held(shared):
    """A task's part of how many units hold each prefix, from the frequencies of tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = shared.value
        sums = np.zeros(len(texts), np.int64)
        by_length = {size: [k for k, p in enumerate(texts) if len(p) == size] for size in {len(p) for p in texts}}
        for batch in batches:
            in_common, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for size, numbers in by_length.items():
                at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(batch.column(0), 0, size), pa.array([texts[k] for k in numbers])), -1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero((at >= 0) & (in_common < size))
                np.add.at(sums, np.array(numbers)[at[hit]], n[hit])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in some], pa.string()), pa.array(sums[some])], ["prefix", "n"])

    return counted


def _task(shared, most: int | None):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, mean = shared.value
        names = ["question", "id", "rank"]
        kept = pa.table({"question": pa.array([], pa.int64()), "id": pa.array([], pa.string()), "rank": pa.array([], pa.float64())})
        least = np.full(int(asked.question.max(initial=-1)) + 1, -np.inf)  # the last kept rank of a question that has as many as are wanted
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                question, row, rank = _scores(batch, asked, mean)
                if most is not None:
                    good = rank >= least[question]
                    question, row, rank = question[good], row[good], rank[good]
                    order = np.lexsort((-rank, question))
                    place = np.arange(len(order)) - np.searchsorted(question[order], question[order])
                    last = order[place == most - 1]
                    bar = least.copy()
                    bar[question[last]] = np.maximum(bar[question[last]], rank[last])
                    good = rank >= bar[question]
                    question, row, rank = question[good], row[good], rank[good]
                new = pa.table([pa.array(question, pa.int64()), batch.column(0).take(pa.array(row, pa.int64())).cast(pa.string()), pa.array(rank, pa.float64())], names)
                if most is None:
                    yield from new.combine_chunks().to_batches()
                    continue
                if not len(new):
                    continue
                both = pa.concat_tables([kept, new]).sort_by([("question", "ascending"), ("rank", "descending"), ("id", "ascending")])
                q = both["question"].to_numpy()
                place = np.arange(len(q)) - np.searchsorted(q, q)
                kept = both.filter(pa.array(place < most)).combine_chunks()
                least[q[place == most - 1]] = both["rank"].to_numpy()[place == most - 1]
        if most is not None:
            yield from kept.to_batches()

    return scored
