"""Quality rules by compression bands.

A text's zstandard ratio (bytes before / bytes after) over the whole document and over fixed chunks says
whether it repeats itself (ratio too high) or is noise (too low). What is normal depends on the length, so the
limits are given for bands of length, each sqrt(2) times as long as the one before.

fit() takes them from labelled documents: LOWEST and HIGHEST are the shares of good documents of a band that lie below
and above. The least ratio lies halfway (geometrically) between the good ones' lowest and that of noise: random words
of letters and digits of the band's length, the same on every machine. So prose that compresses less than the labelled
one stays, and where short prose and noise can't be told apart by their ratio, prose is kept. Real repetition is marked
by REPEATED times the greatest ratio, what a text reaches of which as much repeats as the base rules allow; ordinary
prose of any origin lies below. Between the two a text is dropped only if symbols make up more than SYMBOL_SHARE of it.
Of the chunks, a share of CHUNKS_OUT may be out of their limits. All texts labelled as good that may be learned from are
read: ratios are taken where the texts lie, and only these meet the labels, so no text is shuffled and no label broadcast
by this module. A band with under FIT_LEAST good documents has the limits of LIMITS, which are those of a fit to another
set of prose and what is used without labels.

Defined results: a null or empty text has no words, counts 0 and base_failed; rows with a null id, repeated
rows and ties are judged each on its own; an empty table gives an empty result; columns other than the id and
the text are neither read nor returned by quality_signals and are carried along, whatever they are called, by
keep_good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import as_bytes, cut, fold, remove, slices, sums

#: A rest of under half a chunk joins the chunk before.
CHUNK, LEVEL = 2048, 3
FIT_LEAST, LOWEST, HIGHEST = 20, 0.002, 0.998
#: Ratios are counted in cells, so many to each doubling of the ratio, before the exact limits are read from a few of them.
CELLS = 1024
#: Bytes at which the first band ends; every second one ends at twice the bytes. Longer texts than the last band's are of it.
FIRST_END, N_BANDS = 128, 20


@dataclass(frozen=True)
class Limits:
    """Least and greatest ratio of plain prose in each band, and of its chunks."""

    bands: tuple[tuple[float, float], ...]
    chunk: tuple[float, float]


#: Fixed values, set by hand: limits for any prose, without labels to fit them to.
LIMITS = Limits(
    (
        (0.80, 2.40), (0.90, 2.30), (0.90, 2.30), (1.10, 2.12), (1.10, 2.12), (1.28, 2.08), (1.36, 2.12), (1.48, 2.15), (1.60, 2.19), (1.67, 2.26),
        (1.73, 2.30), (1.81, 2.36), (1.85, 2.42), (1.95, 2.46), (2.00, 2.50), (2.05, 2.54), (2.05, 2.57), (2.05, 2.61), (2.05, 2.66), (2.05, 2.82),
    ),
    (1.45, 2.50),
)


def band_of(size: int) -> int:
    return min(max(0, math.floor(2 * math.log2(max(size, 1) / FIRST_END) + 1 + 1e-9)), N_BANDS - 1)


BASE_MIN_WORDS, WINDOW, BASE_MAX_REPEAT_PERCENT = 20, 8, 30
REPEATED, SYMBOL_SHARE, CHUNKS_OUT = 1 / (1 - BASE_MAX_REPEAT_PERCENT / 100), 0.05, 0.25
SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"

SIGNALS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "doc_ratio double, chunk_least double, chunk_greatest double"
)
_MULTIPLIERS = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """For each list of words, how many lie in a window of WINDOW words that occurs twice or more in it."""
    lengths = np.array([len(t) for t in texts], np.int64)
    n = int(lengths.sum())
    if n < WINDOW:
        return np.zeros(len(texts), np.int64)
    codes = np.fromiter((hash(w) for t in texts for w in t), np.int64, n).view(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    last = n - WINDOW + 1
    key = doc[:last] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        key += codes[k : k + last] * _MULTIPLIERS[k]
    key = np.where(doc[:last] == doc[WINDOW - 1 :], key, np.uint64(0))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][(ordered[1:] == ordered[:-1]) & (ordered[1:] != 0)])
    if len(twice) == 0:
        return np.zeros(len(texts), np.int64)
    found = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    steps = np.zeros(n + 1, np.int64)
    steps[:last] += found
    steps[WINDOW:] -= found
    return sums((np.cumsum(steps[:-1]) > 0).astype(np.int64), lengths)


def chunk_ratios(data: bytes, zstd: zstandard.ZstdCompressor) -> list[float]:
    """Ratios of the chunks; of a text of under one and a half, none."""
    if len(data) < CHUNK + CHUNK // 2:
        return []
    starts = list(range(0, len(data), CHUNK))
    if len(data) - starts[-1] < CHUNK // 2:
        starts.pop()
    return [(b - a) / len(zstd.compress(data[a:b])) for a, b in zip(starts, [*starts[1:], len(data)])]


def ratio(data: bytes, zstd: zstandard.ZstdCompressor) -> float:
    return len(data) / len(zstd.compress(data)) if data else 1.0


def within_limits(size: int, whole: float, chunks: list[float], limits: Limits = LIMITS, symbols: float = 0.0) -> bool:
    """size: in bytes; symbols: the share of bytes that are SYMBOLS."""
    low, high = limits.bands[band_of(size)]
    least, greatest = limits.chunk
    above = whole > high or any(c > greatest for c in chunks)
    out = sum(not least <= c <= greatest * REPEATED for c in chunks) / max(len(chunks), 1)
    return low <= whole <= high * REPEATED and out <= CHUNKS_OUT and not (above and symbols > SYMBOL_SHARE)


@cache
def noise_ratio(size: int) -> float:
    """The ratio of random words of letters and digits with a length of size bytes."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    rng, zstd, found = np.random.default_rng(size), zstandard.ZstdCompressor(level=LEVEL), []
    for _ in range(16):
        text = letters[rng.integers(0, 36, size)]
        text[np.cumsum(rng.integers(4, 11, size // 4 + 1)).clip(max=size - 1)] = 32
        found.append(ratio(text.tobytes(), zstd))
    return float(np.mean(found))


def ratios(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, band, ratio: a row for each text that isn't empty, and one of band -1 for each of its chunks. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches):
            rows = [(n, k, r) for n, data in enumerate(as_bytes(batch.column(1))) if data for k, r in [(band_of(len(data)), ratio(data, zstd)), *((-1, c) for c in chunk_ratios(data, zstd))]]
            at, bands, found = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(bands, pa.int32()), pa.array(found, pa.float64())], ["id", "band", "ratio"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, band int, ratio double")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The ratios (band, ratio) of all texts labelled as good; a fifth of the ids is left to measure with."""
    allowed = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0)
    good = labels.where((F.col("quality") == 1) & allowed).select(F.col("doc_id").alias("id"))
    return ratios(docs.where(allowed)).join(good, "id", "left_semi").select("band", "ratio")


def fit(good: DataFrame, default: Limits = LIMITS) -> Limits:
    """Limits from the ratios of good texts (band, ratio). What comes to the driver are counts of the cells and two values for each limit."""
    parts = cut(good)
    bands, chunk = list(default.bands), default.chunk
    for band, (low, high) in _quantiles(parts).items():
        size = CHUNK if band < 0 else round(FIRST_END * 2 ** (band / 2 - 0.25))
        limits = (min(math.sqrt(low * noise_ratio(size)), low), high)
        if band < 0:
            chunk = limits
        else:
            bands[band] = limits
    remove(parts)
    return replace(default, bands=tuple(bands), chunk=chunk)


def _quantiles(parts: DataFrame) -> dict[int, tuple[float, float]]:
    """LOWEST and HIGHEST of each band with FIT_LEAST ratios or more, exact and between two ratios by proportion.

    Ratios are counted by cell; of the cells in which a wanted place lies, the distinct ratios are counted.
    """
    placed = parts.withColumn("cell", F.floor(F.log2("ratio") * CELLS).cast("int"))
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("band", "cell").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.band, []).append((r.cell, r.n))
    spots: dict[int, list[float]] = {}
    wanted = set()
    for band, cells in counts.items():
        cells.sort()
        ends = np.cumsum([n for _, n in cells])
        if ends[-1] < FIT_LEAST:
            continue
        spots[band] = [share * (int(ends[-1]) - 1) for share in (LOWEST, HIGHEST)]
        for place in {f(x) for x in spots[band] for f in (math.floor, math.ceil)}:
            at = int(np.searchsorted(ends, place, "right"))
            wanted.add((band, cells[at][0], place, place - int(ends[at]) + cells[at][1]))
    if not wanted:
        return {}
    spark = parts.sparkSession
    columns = dict(zip(("band", "cell", "place", "within"), zip(*sorted(wanted))))
    asked = F.broadcast(spark.createDataFrame(pa.table(columns), "band int, cell int, place long, within long"))  # as Arrow: see looked_up()
    some = placed.join(F.broadcast(asked.select("band", "cell").distinct()), ["band", "cell"]).groupBy("band", "cell", "ratio").agg(F.count("*").alias("n"))
    upto = some.withColumn("end", F.sum("n").over(Window.partitionBy("band", "cell").orderBy("ratio")))
    found = upto.join(asked, ["band", "cell"]).where((F.col("within") < F.col("end")) & (F.col("within") >= F.col("end") - F.col("n"))).collect()
    value = {(r.band, r.place): r.ratio for r in found}

    def between(band: int, x: float) -> float:
        low, high = value[band, math.floor(x)], value[band, math.ceil(x)]
        return low + (high - low) * (x - math.floor(x))

    return {band: (between(band, low), between(band, high)) for band, (low, high) in spots.items()}


def signals(texts: pa.Array, limits: Limits = LIMITS) -> dict[str, pa.Array]:
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    data = as_bytes(texts)
    words = [b.split() for b in data]
    points = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    n = np.array([len(w) for w in words], np.int64)
    spaces = np.array([len(b) - len(b.translate(None, SPACE)) for b in data], np.int64)
    lines = [[x for x in b.split(b"\n") if x.strip()] for b in data]
    repeats = repeated_words(words)
    failed = (n < BASE_MIN_WORDS) | (100 * repeats > BASE_MAX_REPEAT_PERCENT * n)
    whole, chunks = [ratio(b, zstd) for b in data], [chunk_ratios(b, zstd) for b in data]
    symbols = [len(b) - len(b.translate(None, SYMBOLS)) for b in data]
    good = np.array([within_limits(len(b), w, c, limits, x / max(len(b), 1)) for b, w, c, x in zip(data, whole, chunks, symbols)], bool)
    return {
        "n_words": pa.array(n),
        "word_chars": pa.array(points.astype(np.int64) - spaces),
        "n_symbols": pa.array(symbols, pa.int64()),
        "n_dup_lines": pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
        "n_repeat_words": pa.array(repeats),
        "base_failed": pa.array(failed),
        "kept": pa.array(good & ~failed),
        "doc_ratio": pa.array(whole, pa.float64()),
        "chunk_least": pa.array([min(c, default=w) for w, c in zip(whole, chunks)], pa.float64()),
        "chunk_greatest": pa.array([max(c, default=w) for w, c in zip(whole, chunks)], pa.float64()),
    }


def quality_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """One row per row of docs: its id and the columns of SIGNALS. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = signals(batch.column(1), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.values()], [id_col, *out])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {SIGNALS}")


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(signals(batch.column(at), limits)["kept"])

    return docs.mapInArrow(run, docs.schema)
