"""Language ID for texts that may mix languages.

The scripts of a word narrow the languages it can be in; each of these scores the word by its byte trigrams; then
a Viterbi pass over the words, with a penalty for switching, labels spans. A text's language is the one with most
letters in its spans.

The model: per language, counts of byte trigrams (hashed to BUCKETS) and of words by script, over all training
texts. Its size is bounded by languages x BUCKETS, whatever the corpus.

Defined results: a null text, a text without a letter, or any text when nothing was learned is `und` with score 0
and no spans; equal letters go to the language first in order of code points; rows with a null id or repeated
rows are labelled each on its own; an empty table gives an empty result; other columns are not read by label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import as_bytes, fold, slices

BUCKETS, ALPHA, SWITCH_PENALTY, FOREIGN_SCRIPT = 1 << 16, 0.5, 12.0, -60.0
#: A language is a candidate for a script that at least this share of its training words is in.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
LABEL = "lang_pred string, score double, n_spans int, spans array<struct<first_word:int,n_words:int,lang:string>>"

#: First and last code point, script.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0531, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"),
    (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"),
    (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"),
    (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "kana"),
    (0x30A0, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]
SCRIPT_NAMES = sorted({s for _, _, s in SCRIPTS})
_STARTS = np.array([a for a, _, _ in SCRIPTS])
_ENDS = np.array([b for _, b, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(s) for _, _, s in SCRIPTS])
_LATIN = SCRIPT_NAMES.index("latin")
_BLANKS = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


def script_of(word: str) -> int:
    """Number of the script that most of the word's code points are in; -1 if none is known."""
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.maximum(np.searchsorted(_STARTS, points, "right") - 1, 0)
    known = _SCRIPT_OF[at][(points >= _STARTS[at]) & (points <= _ENDS[at])]
    return int(np.bincount(known).argmax()) if len(known) else -1


@dataclass
class Words:
    """The words of some texts: how many each text has, and for each letter byte its word and trigram bucket."""

    per_text: np.ndarray
    word: np.ndarray
    bucket: np.ndarray
    letters: np.ndarray  # letter bytes of each word
    script: np.ndarray  # of each word, -1 if unknown
    starts: np.ndarray = field(repr=False)


def words_of(texts: list[bytes]) -> Words:
    data = [b" " + t.translate(_BLANKS) + b" " for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    blank = raw == 32
    first = np.concatenate([[False], ~blank[1:] & blank[:-1]])
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(d) for d in data]) if data else np.zeros(0, np.int64)
    per_text = np.diff(np.searchsorted(starts, ends), prepend=0)
    letter = (raw >= 0x80) | ((raw >= 97) & (raw <= 122))
    letter[:1] = letter[-1:] = False
    at = np.flatnonzero(letter).astype(np.int32)  # slices hold few MB, and a text under 2 GB
    code = np.zeros(len(at), np.uint32)
    for step in (-1, 0, 1):  # narrow types and work in place: these arrays are most of a worker's memory
        code <<= np.uint32(8)
        code |= raw[at + np.int32(step)]
    code *= np.uint32(2654435761)
    code >>= np.uint32(16)
    bucket = code.astype(np.uint16)
    place = np.cumsum(first, dtype=np.int32)
    place -= 1
    word = place[at]
    letters = np.bincount(word, minlength=len(starts))
    script = np.full(len(starts), _LATIN, np.int64)
    foreign = np.unique(place[np.flatnonzero(raw >= 0xCD)])
    if len(foreign):
        blanks = np.flatnonzero(blank)
        stops = blanks[np.searchsorted(blanks, starts[foreign])]
        script[foreign] = [script_of(raw[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(starts[foreign], stops)]
    return Words(per_text, word, bucket, letters, script, starts)


def lower(column: pa.Array) -> list[bytes]:
    return as_bytes(pc.utf8_lower(column))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (BUCKETS, languages) log probability of a trigram
    allowed: np.ndarray  # (scripts + 1, languages) added to a word's score; the last row is for an unknown script


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learns from all rows of docs with a language and a text.

    Each task sums its trigram counts in an array per language; only these sums are shuffled, and only the sums
    over all tasks, at most languages x (BUCKETS + scripts) numbers, come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = batch.column(0).to_pylist()
            texts = lower(batch.column(1))
            for lang in set(langs):
                w = words_of([t for t, x in zip(texts, langs) if x == lang])
                total = found.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                total[:BUCKETS] += np.bincount(w.bucket, minlength=BUCKETS)
                seen = w.script[(w.letters > 0) & (w.script >= 0)]
                total[BUCKETS:] += np.bincount(seen, minlength=len(SCRIPT_NAMES))
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    source = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).where("lang is not null and text is not null")
    rows = source.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    counts[rows["bucket"], rows["lang"].map({x: k for k, x in enumerate(langs)})] = rows["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((grams + ALPHA) / (grams.sum(0) + ALPHA * BUCKETS)).astype(np.float32)
    can = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    can[~can.any(1)] = True
    allowed = np.vstack([np.where(can, 0.0, FOREIGN_SCRIPT), np.zeros(len(langs))]).astype(np.float32)
    return Model(langs, scores, allowed)


def best_path(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each row of scores (words, languages); lengths: words of each text. All texts advance together."""
    total, states = scores.shape
    order = np.argsort(-lengths, kind="stable")
    offsets = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
    value = np.zeros((len(lengths), states), np.float32)
    switch = np.zeros((total, states), bool)
    before = np.zeros(total, np.int16)
    for t in range(longest):
        a = active[t]
        v, rows = value[:a], offsets[:a] + t
        if t:
            before[rows] = top = v.argmax(1)
            change = v[np.arange(a), top][:, None] - np.float32(penalty)
            switch[rows] = v < change
            v = np.maximum(v, change)
        value[:a] = v + scores[rows]
    label = np.zeros(total, np.int16)
    state = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        rows = offsets[:a] + t
        label[rows] = state[:a]
        state[:a] = np.where(switch[rows, state[:a]], before[rows], state[:a])
    return label


def _label(model: Model, column: pa.Array, penalty: float) -> list[pa.Array]:
    texts = lower(column)
    w = words_of(texts)
    n, langs = len(texts), len(model.langs)
    readable = np.array([any(map(str.isalpha, x)) if x else False for x in column.to_pylist()], bool) & bool(langs)
    if not langs:
        return _columns(["und"] * n, np.zeros(n), [[] for _ in range(n)])
    scores = np.empty((len(w.starts), langs), np.float32)
    for k in range(langs):
        scores[:, k] = np.bincount(w.word, model.scores[w.bucket, k], minlength=len(w.starts))
    scores += model.allowed[w.script]
    label = best_path(scores, w.per_text, penalty)
    doc = np.repeat(np.arange(n), w.per_text)
    mass = np.bincount(doc * langs + label, w.letters, minlength=n * langs).reshape(n, langs)
    chosen = mass.argmax(1)
    share = mass[np.arange(n), chosen] / np.maximum(mass.sum(1), 1)
    edge = np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]) if len(label) else np.zeros(0, bool)
    first = np.flatnonzero(edge)
    size = np.diff(first, append=len(label))
    offset = np.cumsum(w.per_text) - w.per_text
    spans: list[list] = [[] for _ in range(n)]
    for d, a, c, k in zip(doc[first].tolist(), (first - offset[doc[first]]).tolist(), size.tolist(), label[first].tolist()):
        if readable[d]:
            spans[d].append({"first_word": a, "n_words": c, "lang": model.langs[k]})
    names = [model.langs[k] if r else UNKNOWN for k, r in zip(chosen, readable)]
    return _columns(names, np.where(readable, share, 0.0), spans)


def _columns(names: list[str], share: np.ndarray, spans: list[list]) -> list[pa.Array]:
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
    return [pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, kind)]


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row per row of docs: its id and the columns of LABEL (spans in words, counted from 0). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = _label(shared.value, batch.column(1), penalty)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], [id_col, "lang_pred", "score", "n_spans", "spans"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {LABEL}")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of docs, with all their columns, that have a language holding at least this share of the letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            names, share, _, _ = _label(shared.value, batch.column(at), penalty)
            yield batch.filter(pc.and_(pc.not_equal(names, UNKNOWN), pc.greater_equal(share, least)))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that the contract allows to learn from."""
    return docs.where((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())
