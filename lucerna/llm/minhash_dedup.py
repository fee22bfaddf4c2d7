"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. Shingles of SHINGLE words (a shorter text is one shingle). Their document frequencies are counted over all
   documents; a shingle's weight is 1 + log(its count in the text) times a damped inverse document frequency: 1 up to
   FREQUENT of all documents, falling with the logarithm to FLOOR for one that stands everywhere. So only frequent
   shingles must be known to all tasks, and there are at most mean document length / FREQUENT of them.
2. Texts with equal words are one class; what follows works on a representative.
3. BANDS x ROWS samples, such that two texts share a sample with the probability of their weighted Jaccard
   similarity; ROWS samples make a band, texts that share a band are candidates.
4. In each band bucket every text is compared with one of them (a star, not all pairs), the centre changing over
   STARS rounds; a bucket whose texts are all in one component is done with. Of the texts still apart, all pairs of a
   bucket whose samples agree by AGREE or more are compared too, but for pairs within the component that holds most of
   the bucket. This is done in blocks: first the samples alone tell which texts have such a partner, then the blocks of
   these texts compare them; a pair belongs to its first shared band, and no pair is listed but one link for two
   components. A link needs a weighted Jaccard similarity, or the plain one of the shingle sets, of THRESHOLD.
5. Connected components of the links are the groups.

Candidates are found by chance, and by their weighted similarity only. Two texts of weighted similarity s share a band
with probability 1 - (1 - s^ROWS)^BANDS (0.8: 0.99999, 0.7: 0.998, 0.5: 0.88) and agree in AGREE of the samples with
0.9999, 0.97 and 0.2; only the first is needed where the star's centre is one of them. The logarithm of the counts keeps
the weighted similarity of a pair near its plain one: where a fifth of a text stands ten times in the other it is 0.68.

Keys that very many rows share (a bucket, a group of exact copies, a centre, an edge's end) are looked up and compared
in parts (common.looked_up, common.dealt and spread_stars), so no task meets all of a key's rows.

Defined results: a document is an id with its words; rows that repeat both are one document, of which the first row
is kept, and one id with several texts is several documents, each with the class of its text. A text without words
(null, empty or blank) is a group of its own; a row with a null doc_id has a null class and is kept; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import as_bytes, cut, dealt, groups_of, looked_up, scramble, slices, word_hashes
from lucerna.llm.components import components

SHINGLE, THRESHOLD, BANDS, ROWS, SEED = 5, 0.8, 16, 3, 8
#: Rounds of stars with other centres, in parts of RAYS; texts still apart are compared by their samples, of which this share must agree.
STARS, AGREE, BLOCK, RAYS = 2, 0.56, 2048, 256
FREQUENT, LEAST_FREQUENT, FLOOR = 5e-4, 10, 0.5
#: Keys that a task counts at a time, that a counting group holds on average, and the most parts that a task's or a bundle's keys are cut into.
COUNTED, GROUP, FAN = 1_000_000, 1_000_000, 4096

_PLACES = np.random.default_rng(SEED).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = 1 << 16
_GAMMA = np.random.default_rng(SEED + 1).standard_gamma(2.0, _TABLE)
_LOG_GAMMA = np.log(np.random.default_rng(SEED + 2).standard_gamma(2.0, _TABLE))
_SEEDS = np.random.default_rng(SEED + 3).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, how often each occurs, and how many each text has."""
    words, counts = word_hashes(texts)
    n = len(words)
    whole = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), whole)
    start = np.arange(len(doc)) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(whole) - whole), whole)
    stop = np.repeat(np.cumsum(counts), whole)
    key = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        at = start + k
        key += np.where(at < stop, words[np.minimum(at, n - 1)], np.uint64(0)) * _PLACES[k] if n else 0
    key = scramble(key)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return key[first], np.diff(first, append=len(key)), np.bincount(doc[first], minlength=len(texts))


def _parts(keys: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, keys, n): one row for each part that has keys. keys: sorted."""
    part = ((keys >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    ends = pa.array(np.append(edge, len(keys)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys.view(np.int64), n.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(part[edge]), *lists], ["part", "keys", "n"])


def _added(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (t[c].combine_chunks().flatten().to_numpy() for c in ("keys", "n"))
    found, at = np.unique(keys.view(np.uint64), return_inverse=True)
    return found, np.bincount(at, n, len(found)).astype(np.int64)


def document_frequencies(docs: DataFrame, n_bytes: int, least: float) -> DataFrame:
    """(key, df) of the shingles that more than `least` of docs (text) hold.

    Tasks add up COUNTED keys at a time and send them by hash range; beyond FAN ranges on two levels, so that what is
    sent stays in FAN parts of many keys, however large the input.
    """
    groups = max(8, math.ceil(n_bytes / 6 / GROUP))
    first = min(groups, FAN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in slices(batches):
            held.append(shingles(as_bytes(batch.column(0)))[0])
            size += len(held[-1])
            if size >= COUNTED:
                yield _parts(*np.unique(np.concatenate(held), return_counts=True), first)
                held, size = [], 0
        if size:
            yield _parts(*np.unique(np.concatenate(held), return_counts=True), first)

    def merge(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_parts(*_added(t), groups)])

    def add(t: pa.Table) -> pa.Table:
        found, total = _added(t)
        often = total > least
        return pa.table({"key": found[often].view(np.int64), "df": total[often]})

    kind = "part long, keys array<bigint>, n array<bigint>"
    sent = docs.mapInArrow(count, kind)
    if groups > FAN:
        bundles = math.ceil(groups / FAN)
        sent = sent.withColumn("bundle", F.pmod(F.xxhash64("keys"), F.lit(bundles))).groupBy("part", "bundle").applyInArrow(merge, kind)
    return sent.groupBy("part").applyInArrow(add, "key long, df long")


def frequent(docs: DataFrame, n_docs: int, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that more than the frequent share of docs (text) hold, and their weights."""
    least = max(LEAST_FREQUENT, FREQUENT * n_docs)
    rows = document_frequencies(docs, n_bytes, least).toPandas()
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    fall = np.log(n_docs / rows["df"].to_numpy(float)[order]) / max(math.log(n_docs / least), 1e-9) if len(rows) else np.zeros(0)
    return keys[order], FLOOR + (1 - FLOOR) * np.clip(fall, 0, 1)


def weighted(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights of shingles that occur n times."""
    return (1 + np.log(n)) * idf(known, keys)


def idf(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    if not len(known[0]):
        return np.ones(len(keys))
    at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
    return np.where(known[0][at] == keys, known[1][at], 1.0)


def bands(keys: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BANDS) bucket keys by consistent weighted sampling, and 16 bits of each sample; zeros without shingles."""
    out = np.zeros((len(sizes), BANDS), np.uint64)
    sketch = np.zeros((len(sizes), BANDS * ROWS), np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out, sketch
    starts = (np.cumsum(sizes) - sizes)[full]
    lengths = sizes[full]
    log_weight = np.log(weights)
    for band in range(BANDS):
        key = np.full(len(full), np.uint64(band + 1))
        for row in range(ROWS):
            u = scramble(keys ^ _SEEDS[band * ROWS + row])
            r = _GAMMA[u & np.uint64(_TABLE - 1)]
            beta = (u >> np.uint64(32)).astype(np.float64) * 2.0**-32
            t = np.floor(log_weight / r + beta)
            a = _LOG_GAMMA[(u >> np.uint64(16)) & np.uint64(_TABLE - 1)] - r * (t - beta + 1.0)
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
            chosen = least[np.searchsorted(least, starts)]
            sample = scramble(keys[chosen] + t[chosen].astype(np.int64).view(np.uint64))
            sketch[full, band * ROWS + row] = (sample & np.uint64(0xFFFF)).astype(np.uint16)
            key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + sample)
        out[full, band] = key
    return out, sketch


def signatures(docs: DataFrame, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (doc_id, text): doc_id, same (a digest of its words; empty without words), place (the task), bands and sketch. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for batch in slices(batches):
            texts = as_bytes(batch.column(1))
            keys, n, sizes = shingles(texts)
            found, sketch = bands(keys, weighted(shared.value, keys, n), sizes)
            found = found.view(np.int64)
            same = [hashlib.md5(b" ".join(w)).digest() if (w := t.lower().split()) else b"" for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, BANDS, dtype=np.int32)), pa.array(found.ravel()))
            samples = pa.array([x.tobytes() for x in sketch], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(np.full(len(texts), place, np.int32)), lists, samples], ["doc_id", "same", "place", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, same binary, place int, bands array<bigint>, sketch binary")


def _candidates(t: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its partners: in another component, samples that agree, this band the first they share."""
    reps, part, side = (t[c].to_numpy() for c in ("rep", "component", "side"))
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(len(t), -1)
    band = t["band"][0].as_py()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if (side == 1).any() else np.flatnonzero(side == 0)
    for i in left:
        near = right[(part[right] != part[i]) & ((side[right] == 1) | (reps[right] > reps[i]))]
        if len(near):
            same = sketch[near] == sketch[i]
            close = same.sum(1) >= least
            near = near[close][same[close].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
            if len(near):
                yield int(i), near


def residual(members: DataFrame, texts: DataFrame, known: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """members (band, bucket, rep, component, main, sketch): links (a, b) that join components within a bucket. main: whether
    the component is the one that most of the bucket's members are in."""
    least = round(AGREE * BANDS * ROWS)
    keys = ["band", "bucket", "low", "high"]
    shared = members.sparkSession.sparkContext.broadcast(known)

    def grouped(rows: DataFrame) -> DataFrame:
        return dealt(rows, ["band", "bucket"], "rep", BLOCK, "main").repartition(*keys).sortWithinPartitions(*keys)

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, keys):
            with_partner = np.zeros(len(t), bool)
            for i, near in _candidates(t, least):
                with_partner[i] = True
                with_partner[near] = True
            yield from t.select(["band", "bucket", "rep"]).filter(pa.array(with_partner)).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for t in groups_of(batches, keys):
            reps, part = t["rep"].to_numpy(), t["component"].to_numpy()
            hashes, n, sizes = shingles([unpack.decompress(p) for p in t["packed"].to_pylist()])
            weights = weighted(shared.value, hashes, n)
            ends = np.cumsum(sizes)
            spans = [slice(int(e - s), int(e)) for e, s in zip(ends, sizes)]
            joined: dict[int, int] = {}

            def root(x: int, joined: dict[int, int] = joined) -> int:
                while x in joined:
                    x = joined[x]
                return x

            found = []
            for i, near in _candidates(t, least):
                for j in near.tolist():
                    x, y = root(int(part[i])), root(int(part[j]))
                    if x != y and _similar(hashes[spans[i]], weights[spans[i]], hashes[spans[j]], weights[spans[j]], threshold):
                        joined[max(x, y)] = min(x, y)
                        found.append((int(reps[i]), int(reps[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], ["a", "b"])

    kind = members.schema["band"].dataType.simpleString()
    chosen = grouped(members).mapInArrow(partnered, f"band {kind}, bucket long, rep long").distinct()
    full = cut(members.join(chosen, ["band", "bucket", "rep"]))  # the key is unique on both sides
    with_text = full.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    return grouped(with_text).mapInArrow(compare, "a long, b long")


def spread_stars(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (centre, ray) and their texts as groups (centre, part) of at most about RAYS rays, the centre first in each.

    A centre's text is sent once for each part, whatever the number of its rays.
    """
    sizes = cut(pairs.groupBy("centre").agg(F.count("*").alias("n")))
    rays = looked_up(pairs, sizes, ["centre"], "n").withColumn("part", F.pmod(F.xxhash64("ray"), F.ceil(F.col("n") / RAYS)))
    member = rays.join(texts.withColumnRenamed("doc_id", "ray"), "ray").select("centre", "part", F.lit(1).alias("place"), F.col("ray").alias("node"), "packed")
    heads = sizes.join(texts.withColumnRenamed("doc_id", "centre"), "centre").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / RAYS) - 1)))
    centre = heads.select("centre", "part", F.lit(0).alias("place"), F.col("centre").alias("node"), "packed")
    return member.unionByName(centre).repartition("centre", "part").sortWithinPartitions("centre", "part", "place")


def verified(pairs: DataFrame, texts: DataFrame, known: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The links (a, b) among pairs (centre, ray): similarity of threshold or more. texts: doc_id, packed."""
    shared = pairs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, head = None, None
        for whole in batches:
            for batch in slices(iter([whole]), "packed"):
                keys, n, sizes = shingles([unpack.decompress(p) for p in batch.column(4).to_pylist()])
                weights = weighted(shared.value, keys, n)
                ends = np.cumsum(sizes)
                a, b = [], []
                groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for group, place, node, end, size in zip(groups, batch.column(2).to_pylist(), batch.column(3).to_pylist(), ends.tolist(), sizes.tolist()):
                    mine = keys[end - size : end], weights[end - size : end]
                    if place == 0:
                        last, head = group, (mine[0].copy(), mine[1].copy())
                    elif group == last and _similar(*head, *mine, threshold):
                        a.append(group[0])
                        b.append(node)
                    elif group != last:
                        raise RuntimeError("a star has lost its centre")
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return spread_stars(pairs, texts).mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, threshold: float) -> bool:
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = np.minimum(wx[i], wy[j]).sum()
    weighted = least / (wx.sum() + wy.sum() - least)
    plain = len(i) / (len(x) + len(y) - len(i))
    return bool(max(weighted, plain) >= threshold - 1e-12)


def pack(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the text as zstandard bytes, a third of its size in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress(t) for t in as_bytes(batch.column(1))], pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def _apart(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """shared (rep, band, bucket) with components, where a bucket's texts aren't all in one; main: whether it is the bucket's largest."""
    placed = cut(shared.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    sizes = placed.groupBy("band", "bucket", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("band", "bucket").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("components")).where("components > 1")
    found = looked_up(placed, cut(split.drop("components")), ["band", "bucket"], "n")
    return found.select("band", "bucket", "rep", "component", (F.col("component") == F.col("most")).alias("main"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text; no null id): one row per row: doc_id, same (digest of its words, or empty), class_id, kept."""
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    known = frequent(docs.where("text is not null").select("text"), n_docs, n_bytes)
    signed = cut(signatures(docs, known))
    # a document's rows are counted within each task that read them, so that one id may repeat without end
    rows = cut(signed.groupBy("doc_id", "same", "place").agg(F.count("*").alias("rows")))
    several = cut(rows.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select("doc_id"))
    reps = representatives(signed, several)
    entries = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    full = entries.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(looked_up(entries, cut(full), ["band", "bucket"], "n").drop("n"))
    texts = cut(packed_texts(docs, reps.join(shared.select("rep").distinct(), "rep"), several))
    open_, parts, links = shared.withColumn("component", F.col("rep")), None, None
    checked = None
    for star in range(STARS):
        if open_.isEmpty():
            break
        centres = open_.groupBy("band", "bucket").agg(F.min_by(F.struct("rep", "component"), F.xxhash64("rep", F.lit(star))).alias("c"), F.count("*").alias("n"))
        rays = looked_up(open_, cut(centres), ["band", "bucket"], "n").where("component <> c.component")
        pairs = rays.select(F.col("c.rep").alias("centre"), F.col("rep").alias("ray")).distinct()
        pairs = cut(pairs if checked is None else pairs.join(checked, ["centre", "ray"], "left_anti"))
        new = cut(verified(pairs, texts, known, threshold))
        checked, links = (pairs, new) if checked is None else (checked.union(pairs), links.union(new))
        parts = cut(components(links))
        open_ = cut(_apart(shared, parts))
    if not open_.isEmpty():
        sketches = reps.select("rep", "sketch").join(open_.select("rep").distinct(), "rep", "left_semi")
        parts = components(links.union(residual(open_.join(sketches, "rep"), texts, known, threshold)))
    placed = reps.select("rep", "same", "least", "n")
    placed = placed.withColumn("component", F.col("rep")) if parts is None else placed.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return labelled(rows, cut(placed))


def representatives(signed: DataFrame, several: DataFrame) -> DataFrame:
    """One row for each text with words: same, least id, n rows, bands, sketch and rep, its number: that id, or a hash of the
    text where the id is among several (doc_id), those that stand for more than one text."""
    worded = signed.where(F.octet_length("same") > 0)
    found = worded.groupBy("same").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    shared = several.select(F.col("doc_id").alias("least"), F.lit(True).alias("_several"))
    return cut(found.join(shared, "least", "left").withColumn("rep", F.when(F.col("_several"), F.xxhash64("same")).otherwise(F.col("least"))).drop("_several"))


def packed_texts(docs: DataFrame, wanted: DataFrame, several: DataFrame) -> DataFrame:
    """(doc_id, packed): a text of each wanted representative (rep, same, least), under its number."""
    own = wanted.where("rep = least").select(F.col("least").alias("doc_id"))
    one = pack(docs).join(own, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    if several.isEmpty():
        return one
    other = wanted.where("rep <> least").select(F.col("least").alias("doc_id"), "same", "rep")
    more = docs.join(several, "doc_id", "left_semi").withColumn("same", digest(F.col("text"))).join(other, ["doc_id", "same"]).dropDuplicates(["rep"])
    return one.unionByName(pack(more.select(F.col("rep").alias("doc_id"), "text")))


def labelled(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """rows (doc_id, same, place, rows) as single ones with class_id and kept. placed: same, least, n, component of the texts with words."""
    class_ = placed.groupBy("component").agg(F.min(F.struct(F.col("least").alias("class_id"), F.col("same").alias("chief"))).alias("c"), F.count("*").alias("members"))
    label = cut(looked_up(placed, cut(class_), ["component"], "members").select("same", "n", "c.class_id", "c.chief"))
    first = F.row_number().over(Window.partitionBy("doc_id", "same").orderBy("place")) == 1
    each = rows.withColumn("first", first)
    worded = F.octet_length("same") > 0
    told = looked_up(each.where(worded), label, ["same"], "n").withColumn("chief", (F.col("doc_id") == F.col("class_id")) & (F.col("same") == F.col("chief"))).drop("n")
    blank = each.where(~worded).withColumn("class_id", F.col("doc_id")).withColumn("chief", F.lit(True))
    every = told.unionByName(blank).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return every.select("doc_id", "same", "class_id", (F.col("chief") & (F.col("k") == 1) & F.col("first")).alias("kept"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: its id, class_id (the least id of its group) and kept (one row of each group is)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = classes(rows.where("doc_id is not null"), threshold).select(F.col("doc_id").alias(id_col), "class_id", "kept")
    nameless = rows.where("doc_id is null").select(F.col("doc_id").alias(id_col), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(nameless)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that groups() keeps: one of each group; rows with a null id stay.

    Of rows that repeat an id and its words the one with the least hash of all its columns stays.
    """
    own = docs[id_col].cast("long")
    rows = docs.select(own.alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null")
    found = cut(classes(rows, threshold))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    gone = cut(ids.where("n > 1 or not kept").select(F.col("doc_id").alias("gone"), (F.col("n") > 1).alias("several")))
    # docs as one struct, whatever its columns are called
    each = docs.select(own.alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = each.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
    several = gone.where("several").select(F.col("gone").alias("id"))
    if several.isEmpty():
        return whole
    again = each.join(several, "id", "left_semi").withColumn("same", digest(F.col("row")[text_col]))
    chosen = found.where("kept").select(F.col("doc_id").alias("id"), "same").distinct()
    one = again.join(chosen, ["id", "same"]).groupBy("id", "same").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return whole.unionByName(one.select("row.*"))


def digest(text: Column) -> Column:
    """As signatures() makes it: 16 bytes of a text's words, or none where it has no words."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_replace(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "), "^ | $", "")
    return F.when(F.coalesce(words, F.lit("")) == "", F.to_binary(F.lit(""), F.lit("hex"))).otherwise(F.unhex(F.md5(F.encode(words, "UTF-8"))))
