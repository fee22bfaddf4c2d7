"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram, of the token alone and of a uniform
choice. The weights depend on how often the context occurs (a bucket for each power of two) and are learned by
expectation-maximisation on held-out counts: those of every HELD-th training document against the counts of all
other training documents.

Counting and looking up are one exchange. A block of texts sends its distinct words and bigrams (as 64-bit hashes)
with their counts, cut by hash range; each range adds up what all blocks sent and answers every block in the order
in which it asked. A block asks once for each key, so no word is hot; ranges grow in number with the input. Where
there are more than FAN ranges, the exchange has two levels, so that a block never sends more than FAN small parts:
blocks send to wide ranges, bundles of blocks add up there what their blocks sent and ask the ranges proper in their
blocks' place. The texts themselves travel once more, packed, to meet the answers. The weights are learned from a
histogram of quantised estimates, whose size is bounded (buckets x levels x levels).

The blocks are formed twice from the same scan and named by their partition, their place in it and a digest of their
content; docs must give the same partitions, rows and order both times, as reading a table does (else write it first:
stage=True). A block that doesn't find its answer fails the job instead of giving another result.

Defined results: a null text is empty and has only its end token; rows with a null id (as id '') or repeated rows are
counted and scored each on its own; without any training text every estimate is the uniform one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import as_bytes, cut, scramble, slices, word_hashes

MODULUS, HELD_OUT, HELD = 7, 2, 16
#: Bytes of text in a block, keys in a range on average, buckets of context frequency, levels per factor of two.
BLOCK, RANGE, BUCKETS, LEVELS, ROUNDS = 8_000_000, 300_000, 24, 4, 200
#: The most parts that a block or a bundle of blocks sends of each kind, and the keys that a bundle's part holds on average.
FAN, BUNDLE = 1024, 3_000_000
NEVER = -10_000
END, START = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
WORD_KIND, BIGRAM_KIND = 0, 1


def fold_of(doc_id) -> int:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode())


def is_training(doc_id) -> bool:
    return fold_of(doc_id) % MODULUS != HELD_OUT


def is_deleted(doc_id) -> bool:
    """Whether a training document is kept from the counts while the weights are learned."""
    return is_training(doc_id) and fold_of(doc_id) // MODULUS % HELD == 0


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens (words and ends), of their contexts and of the bigrams, and the number of tokens of each text."""
    words, counts = word_hashes(texts)
    sizes = counts + 1
    ends = np.cumsum(sizes) - 1
    token = np.empty(len(words) + len(texts), np.uint64)
    inside = np.ones(len(token), bool)
    inside[ends] = False
    token[inside], token[ends] = words, END
    context = np.concatenate([[START], token[:-1]]) if len(token) else token
    context[ends[:-1] + 1] = START
    bigram = scramble(context * np.uint64(0x9E3779B97F4A7C15) + token)
    return scramble(token), scramble(context), bigram, sizes


class Blocks:
    """Rows gathered into blocks: full once it holds BLOCK bytes, whatever the batches in which the rows come."""

    def __init__(self, stream: str):
        self.stream, self.number = stream, 0
        self.ids: list = []
        self.texts: list[bytes] = []
        self.size = 0

    def add(self, i, text: bytes) -> bool:
        self.ids.append(i)
        self.texts.append(text)
        self.size += len(text)
        return self.size >= BLOCK

    def take(self) -> tuple[str, list, list[bytes]]:
        """The block's name, ids and texts; the next one is empty."""
        digest = hashlib.md5(repr(self.ids).encode())
        for t in self.texts:
            digest.update(t)
            digest.update(b"\0")
        context = TaskContext.get()
        name = f"{self.stream} {context.partitionId() if context else 0} {self.number} {digest.hexdigest()}"
        out = name, self.ids, self.texts
        self.number, self.ids, self.texts, self.size = self.number + 1, [], [], 0
        return out


def blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("all", "deleted")) -> Iterator[tuple[str, list, list[bytes]]]:
    """Name, ids and texts of the blocks of two streams: all rows, and once more those kept from the counts."""
    streams = [Blocks(name) for name in names]
    for batch in slices(batches):
        for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            for stream in streams:
                if (stream.stream == "all" or is_deleted(i)) and stream.add(i, text):
                    yield stream.take()
    for stream in streams:
        if stream.ids:
            yield stream.take()


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.int64).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


def _part(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) * np.uint64(ranges) >> np.uint64(31)).astype(np.int64)


def _parted(name: str, kind: int, keys: np.ndarray, n: np.ndarray, m: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """One row for each part that has keys. keys: sorted."""
    part = _part(keys, parts)
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(keys)]):
        yield pa.RecordBatch.from_pylist([{"block": name, "kind": kind, "part": int(part[a]), "keys": keys[a:b].tobytes(), "n": _pack(n[a:b]), "m": _pack(m[a:b])}], REQUEST)


def requests(docs: DataFrame, ranges: int) -> DataFrame:
    """What each block asks: (block, kind, part, keys, n in training texts, n in deleted ones). The stream 'deleted' asks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in blocks(batches):
            token, _, bigram, sizes = token_keys(texts)
            counted = name.startswith("all")
            training = np.repeat([is_training(i) for i in ids], sizes) & counted
            deleted = np.repeat([is_deleted(i) for i in ids], sizes) & counted
            for kind, every in ((WORD_KIND, token), (BIGRAM_KIND, bigram)):
                keys, at = np.unique(every, return_inverse=True)
                n, m = (np.bincount(at, w, len(keys)).astype(np.int64) for w in (training, deleted))
                yield from _parted(name, kind, keys, n, m, ranges)

    return docs.select("doc_id", "text").mapInArrow(run, "block string, kind int, part long, keys binary, n binary, m binary")


REQUEST = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("m", pa.binary())])
ANSWER = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("part", pa.int64()), ("total", pa.binary()), ("deleted", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64()), ("deleted_tokens", pa.int64())])


def answers(asked: DataFrame) -> DataFrame:
    """For each request the counts over all blocks, in its order; and per range, with a null block, its types and tokens."""

    def add(t: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, np.uint64) for k in t["keys"].to_pylist()]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        total, deleted = (np.bincount(at, np.concatenate([_unpack(x) for x in t[c].to_pylist()]), len(keys)).astype(np.int64) for c in ("n", "m"))
        kind, part = t["kind"][0].as_py(), t["part"][0].as_py()
        ends = np.cumsum([len(a) for a in asked])
        rows = [
            {"block": name, "kind": kind, "part": part, "total": _pack(total[at[e - len(a) : e]]), "deleted": _pack(deleted[at[e - len(a) : e]])}
            for name, a, e in zip(t["block"].to_pylist(), asked, ends)
        ]
        rows.append({"kind": kind, "part": part, "types": int((total > 0).sum()), "tokens": int(total.sum()), "deleted_tokens": int(deleted.sum())})
        return pa.Table.from_pylist(rows, ANSWER)

    fields = "block string, kind int, part long, total binary, deleted binary, types long, tokens long, deleted_tokens long"
    return asked.groupBy("kind", "part").applyInArrow(add, fields)


def exchanged(docs: DataFrame, ranges: int) -> DataFrame:
    """answers() to the requests of all blocks of docs, on one level or two."""
    if ranges <= FAN:
        return answers(requests(docs, ranges))
    bundles = max(1, ranges * RANGE * 2 // (FAN * BUNDLE))
    asked = cut(requests(docs, FAN)).withColumn("bundle", F.pmod(F.crc32(F.encode("block", "UTF-8")), F.lit(bundles)))
    key = ["kind", "part", "bundle"]

    def merge(t: pa.Table) -> pa.Table:
        keys, at = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in t["keys"].to_pylist()]), return_inverse=True)
        n, m = (np.bincount(at, np.concatenate([_unpack(x) for x in t[c].to_pylist()]), len(keys)).astype(np.int64) for c in ("n", "m"))
        name = f"{t['part'][0].as_py()} {t['bundle'][0].as_py()}"
        return pa.Table.from_batches(list(_parted(name, t["kind"][0].as_py(), keys, n, m, ranges)), REQUEST)

    def spread(t: pa.Table, found: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, np.uint64) for k in t["keys"].to_pylist()]
        keys = np.unique(np.concatenate(asked))
        found = found.sort_by("fine")
        total, deleted = (np.concatenate([_unpack(x) for x in found[c].to_pylist()]) for c in ("total", "deleted"))
        if len(total) != len(keys):
            raise RuntimeError("a bundle of blocks has lost an answer")
        rows = []
        for name, kind, part, mine in zip(t["block"].to_pylist(), t["kind"].to_pylist(), t["part"].to_pylist(), asked):
            at = np.searchsorted(keys, mine)
            rows.append({"block": name, "kind": kind, "part": part, "total": _pack(total[at]), "deleted": _pack(deleted[at])})
        return pa.Table.from_pylist(rows, ANSWER)

    fine = cut(answers(asked.groupBy(*key).applyInArrow(merge, asked.drop("bundle").schema)))
    names = F.split("block", " ")
    of_bundle = fine.where("block is not null").select("kind", names[0].cast("long").alias("part"), names[1].cast("long").alias("bundle"), F.col("part").alias("fine"), "total", "deleted")
    back = asked.groupBy(*key).cogroup(of_bundle.groupBy(*key)).applyInArrow(spread, fine.schema)
    return back.unionByName(fine.where("block is null"))


def packed(docs: DataFrame, stream: str) -> DataFrame:
    """The blocks of a stream themselves, to meet their answers: (block, ids, sizes in bytes, texts)."""
    kind = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in blocks(batches, (stream,)):
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            yield pa.RecordBatch.from_pylist([{"block": name, "ids": ids, "sizes": list(map(len, texts)), "texts": body}], kind)

    return docs.select("doc_id", "text").mapInArrow(run, "block string, ids array<bigint>, sizes array<int>, texts binary")


class Answered:
    """A block's tokens with the counts of each: c of the token, of its context, of the bigram; and where its texts end."""

    def __init__(self, block: pa.Table, found: pa.Table):
        self.ids = block["ids"][0].as_py()
        sizes = np.array(block["sizes"][0].as_py(), np.int64)
        body = zstandard.ZstdDecompressor().decompress(block["texts"][0].as_py())
        ends = np.cumsum(sizes)
        token, context, bigram, self.sizes = token_keys([body[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())])
        start = scramble(np.array([START]))[0]
        end = scramble(np.array([END]))[0]
        words, at = np.unique(token, return_inverse=True)
        total, deleted = self._counts(found, WORD_KIND, len(words))
        # each text has one start, as it has one end
        before = np.searchsorted(words, np.where(context == start, end, context))
        self.token, self.token_deleted = total[at], deleted[at]
        self.context, self.context_deleted = total[before], deleted[before]
        pairs, at = np.unique(bigram, return_inverse=True)
        total, deleted = self._counts(found, BIGRAM_KIND, len(pairs))
        self.bigram, self.bigram_deleted = total[at], deleted[at]

    @staticmethod
    def _counts(found: pa.Table, kind: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        mine = found.filter(pc.equal(found["kind"], kind)).sort_by("part")
        out = [np.concatenate([_unpack(x) for x in mine[c].to_pylist()]) if len(mine) else np.zeros(0, np.int64) for c in ("total", "deleted")]
        if len(out[0]) != size:
            raise RuntimeError("a block of texts differs from the one that asked for counts; write the input to a table first")
        return out[0], out[1]


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def estimates(token: np.ndarray, context: np.ndarray, bigram: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    return token / max(tokens, 1), bigram / np.maximum(context, 1)


def learn(histogram) -> np.ndarray:
    """(BUCKETS, 3) weights of uniform, token and bigram estimate by expectation-maximisation. histogram: bucket, q1, q2, n."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    for b, rows in histogram.groupby("bucket"):
        q = rows[["q1", "q2"]].to_numpy(float)
        ratio = np.hstack([np.ones((len(q), 1)), np.where(q <= NEVER, 0.0, 2.0 ** (q / LEVELS))])
        n = rows["n"].to_numpy(float)
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = ratio * w
            share /= share.sum(1, keepdims=True)
            new = (share * n[:, None]).sum(0) + 1 / 3
            new /= new.sum()
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        weights[int(b)] = w
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stage: bool = False) -> DataFrame:
    """One row per row of docs: its id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = cut(rows) if stage else rows
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(8, math.ceil(n_bytes / 6 * 0.8 / RANGE))
    found = cut(exchanged(rows, ranges))
    totals = found.where(f"block is null and kind = {WORD_KIND}").agg(F.sum("types"), F.sum("tokens"), F.sum("deleted_tokens")).first()
    types, tokens, deleted_tokens = (int(x or 0) for x in totals)
    uniform = 1 / (types + 1)

    def weigh(key, block: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(block):
            return pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "q1", "q2", "n")})
        x = Answered(block, answer)
        context = x.context - x.context_deleted
        p1, p2 = estimates(x.token - x.token_deleted, context, x.bigram - x.bigram_deleted, tokens - deleted_tokens)
        with np.errstate(divide="ignore"):
            q1, q2 = (np.where(p > 0, np.round(LEVELS * np.log2(np.maximum(p, 1e-300) / uniform)), NEVER).astype(np.int64) for p in (p1, p2))
        cells, n = np.unique(np.stack([bucket(context), q1, q2], 1), axis=0, return_counts=True)
        return pa.table({"bucket": cells[:, 0], "q1": cells[:, 1], "q2": cells[:, 2], "n": n})

    answered = found.where("block is not null").select("block", "kind", "part", "total", "deleted")
    histogram = (
        packed(rows, "deleted").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(weigh, "bucket long, q1 long, q2 long, n long")
    ).groupBy("bucket", "q1", "q2").agg(F.sum("n").alias("n"))
    weights = learn(histogram.toPandas())

    def rate(key, block: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(block):
            return pa.Table.from_pylist([], SCORED)
        x = Answered(block, answer)
        p1, p2 = estimates(x.token, x.context, x.bigram, tokens)
        w = weights[bucket(x.context)]
        logs = np.log10(w[:, 0] * uniform + w[:, 1] * p1 + w[:, 2] * p2)
        base = np.log10((x.token + 1) / (tokens + (types + 1)))
        doc = np.repeat(np.arange(len(x.ids)), x.sizes)
        n = len(x.ids)
        return pa.table(
            {
                "doc_id": pa.array(x.ids, pa.int64()),
                "held_out": pa.array([not is_training(i) for i in x.ids]),
                "n_tokens": pa.array(x.sizes),
                "n_known": pa.array(np.bincount(doc, x.token > 0, n).astype(np.int64)),
                "base_score": pa.array(np.bincount(doc, base, n)),
                "score": pa.array(np.bincount(doc, logs, n)),
            }
        )

    out = packed(rows, "all").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
