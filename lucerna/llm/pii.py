"""Personal data: base spans by pattern, and information-theoretic sanitisation of the terms that reveal them.

1. Base spans (e-mail, IP, card, phone) are found in each whole text, in time in proportion to it. Each value found (its
   letters in lower case, or its digits) is a protected entity.
2. A term (letters, digits and characters beyond ASCII) within CONTEXT characters of an entity occurs with it. The same pass
   counts all terms of the corpus.
3. How strongly term t reveals entity e is their pointwise mutual information as a share of e's information content:
   log(P(e|t) / P(e)) / -log P(e), with P(e|t) = occurrences of t with e / occurrences of t in the corpus, and
   P(e) = occurrences of e / terms of the corpus. It is 1 for a term that stands nowhere but with e, and 0 for one as likely
   elsewhere. An estimate needs MIN_CONTEXTS different surroundings of e with t, so that copies of one text, or a rare word
   that stood by an address once, tell nothing.
4. Near its entity, a term that reveals REMOVE or more is removed, one from GENERALISE on is replaced by its class (a number,
   a name, a word). These spans are added with kinds "general" and "removed"; base spans stay.

One pass reads the texts; what follows shuffles counts of terms and narrow marks, never texts. Terms are counted per task
before they are shuffled, so a frequent word sends one row a task; marks of a pair of entity and term that very many rows
share meet the pair's row by a broadcast of at most common.HOT rows.

Defined results: a null or empty text has no span; base spans of different kinds may overlap; a term that overlaps a base
span is not looked at; a row that repeats is told the same each time, rows of one id with other texts each their own; a term
near several entities takes the stronger outcome; an empty table gives an empty result; only id and text are read (sanitise
keeps all other columns, whatever their names).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import cut, folded, looked_up, slices, terms

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "general", "removed")
#: Characters on either side of an entity that belong to its surroundings.
CONTEXT = 60
MIN_CONTEXTS = 2
GENERALISE, REMOVE = 0.85, 0.95
#: Terms that a task counts before it sends them on.
COUNTED = 300_000

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts twice, with its digits added."""
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds, looked for from each @, as long runs of letters would be read again and again."""
    after = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            after = m.end()  # the next local part can't reach into this address


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of the base spans, in that order."""
    found = []
    if "@" in text:
        found += [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.groups()]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((m.start(), 1, m.end(), ".".join(parts)))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 10 <= len(digits) <= 15:
                found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def _number(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode(), digest_size=8).digest(), "big", signed=True)


def marks(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, str, int, int, int]]:
    """(entity, term, start, end, surroundings) for the terms near each span that overlap none; entity and surroundings as hashes."""
    closed: list[list[int]] = []  # the spans as disjoint stretches
    for a, _, b, _ in spans:
        if closed and a < closed[-1][1]:
            closed[-1][1] = max(closed[-1][1], b)
        else:
            closed.append([a, b])
    stretch = 0
    for a, kind, b, value in spans:
        entity = _number(f"{BASE[kind]}:{value}")
        while closed[stretch][1] <= a:
            stretch += 1
        low, high = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
        for lo, hi, own in ((low, a, text[low:a]), (b, high, text[b:high])):
            around = _number(own.lower())
            for m in _TERM.finditer(text, lo, hi):
                s, e = m.span()
                if (s == lo and s and _TERM.match(text[s - 1])) or (e == hi and e < len(text) and _TERM.match(text[e])):
                    continue  # a part of a longer term
                if not _covered(closed, stretch, s, e):
                    yield entity, folded(m.group().encode()).decode(), s, e, around


def _covered(closed: list[list[int]], near: int, start: int, end: int) -> bool:
    """Whether a stretch meets start to end; looks from the given stretch outwards as far as needed."""
    k = near
    while k > 0 and closed[k][0] >= end:
        k -= 1
    while k < len(closed) - 1 and closed[k][1] <= start:
        k += 1
    return closed[k][0] < end and closed[k][1] > start


_SPAN = "struct<start:bigint,kind:int,end:bigint,entity:bigint>"
_MARK = "struct<entity:bigint,term:string,start:bigint,end:bigint,around:bigint>"
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("entity", pa.int64())]))
_MARK_ARROW = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("around", pa.int64())]))


def _key(doc_id: str, text: str) -> Column:
    """Tells rows with the same id apart by their text; rows that repeat share it."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, key) in one pass: a row per document (key, doc_id, spans, marks), and rows (term, n) of counted terms.

    The term "" stands for all terms.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def counted() -> pa.RecordBatch:
            n = len(count)
            nothing = [pa.nulls(n, t) for t in (pa.string(), kind, _SPAN_ARROW, _MARK_ARROW)]
            return pa.RecordBatch.from_arrays([*nothing, pa.array([t.decode() for t in count], pa.string()), pa.array(list(count.values()), pa.int64())], names)

        names, kind = ["key", "doc_id", "spans", "marks", "term", "n"], None
        for batch in slices(batches):
            kind = batch.column(0).type
            spans, near = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                for piece in terms(text.encode()):
                    count.update(piece)
                    count[b""] += len(piece)
                found = base_spans(text)
                spans.append([(a, k, b, _number(f"{BASE[k]}:{v}")) for a, k, b, v in found])
                near.append(list(marks(text, found)) if found else [])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), _lists(spans, _SPAN_ARROW), _lists(near, _MARK_ARROW), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names)
            if len(count) > COUNTED:
                yield counted()
                count.clear()
        if count:
            yield counted()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "key").mapInArrow(read, f"key string, doc_id {id_type}, spans array<{_SPAN}>, marks array<{_MARK}>, term string, n long")


def _lists(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    names = [f.name for f in kind.value_type]
    return pa.array([[dict(zip(names, r)) for r in row] for row in rows], kind)


def disclosures(scanned: DataFrame, min_contexts: int = MIN_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The pairs of entity and term to act on: entity, term, share (how much of the entity the term reveals), kind, together (occurrences)."""
    seen = scanned.where("size(marks) > 0").select(F.explode("marks").alias("m")).select("m.entity", "m.term", "m.around")
    pairs = seen.groupBy("entity", "term", "around").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("contexts"))
    pairs = cut(pairs.where(F.col("contexts") >= min_contexts))
    entities = scanned.where("size(spans) > 0").select(F.explode("spans.entity").alias("entity")).groupBy("entity").agg(F.count("*").alias("of_entity"))
    counts = scanned.where("term <> ''").groupBy("term").agg(F.sum("n").alias("of_term"))
    everything = scanned.where("term = ''").agg(F.sum("n")).first()[0] or 1
    known = pairs.join(counts, "term").join(entities, "entity")
    # a term within reach of two occurrences of an entity is met twice, so its share is held at 1
    given = F.least(F.col("together") / F.col("of_term"), F.lit(1.0))
    content = -F.log(F.least(F.col("of_entity") / F.lit(float(everything)), F.lit(1.0)))
    share = F.when(content > 0, 1 + F.log(given) / content).otherwise(0.0)
    found = known.withColumn("share", share).where(F.col("share") >= generalise)
    return found.select("entity", "term", "share", F.when(F.col("share") >= remove, KINDS.index("removed")).otherwise(KINDS.index("general")).alias("kind"), "together")


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """One row per document: key, doc_id and spans, an array of (start, kind, end) in that order, kind as its place in KINDS."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("key", _key("doc_id", "text"))
    scanned = cut(scan(rows))
    acted = cut(disclosures(scanned, **limits))
    base = scanned.where("key is not null").select("key", "doc_id", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"), (F.size("marks") > 0).alias("marked"))
    near = scanned.where("size(marks) > 0").select("key", F.explode("marks").alias("m")).select("key", "m.entity", "m.term", "m.start", "m.end")
    hits = looked_up(near, acted.select("entity", "term", "kind", "together"), ["entity", "term"], "together")
    hits = hits.groupBy("key", "start", "end").agg(F.max("kind").alias("kind"))  # removed is the stronger
    more = hits.groupBy("key").agg(F.collect_list(F.struct(F.col("start"), F.col("kind").cast("int").alias("kind"), F.col("end"))).alias("more"))
    with_more = base.where("marked").join(more, "key", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.slice("base", 1, 0)))))
    return with_more.select("key", "doc_id", "spans").unionByName(base.where("not marked").select("key", "doc_id", F.col("base").alias("spans")))


def digest(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """The spans of each document with their counts, the hash of the base spans and all spans as text."""
    found = spans_of(docs)
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *counts[: len(BASE)], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), *counts[len(BASE) :])


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with base spans named by their kind, general terms by their class, and removed ones left out; of overlapping spans the first counts."""
    out, at = [], 0
    for start, kind, end in spans:
        if start < at:
            at = max(at, end)
            continue
        term = text[start:end]
        name = f"[{KINDS[kind].upper()}]" if kind < len(BASE) else "" if KINDS[kind] == "removed" else "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[WORD]"
        out += [text[at:start], name]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """docs with their columns, the text without what its spans cover; a text without spans stays as it is."""
    found = spans_of(docs, id_col, text_col, **limits).where("size(spans) > 0").select("key", "spans").dropDuplicates(["key"])
    mine = f"_{hashlib.md5(','.join(docs.columns).encode()).hexdigest()}"  # no column of docs has this name
    keyed = docs.withColumn(mine, F.md5(F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("")), F.coalesce(docs[text_col], F.lit("")))))

    @F.pandas_udf("string")
    def put(text, spans):
        return text.combine(spans, lambda t, s: t if s is None else replaced(t, [(x["start"], x["kind"], x["end"]) for x in s]))

    joined = keyed.join(found.select(F.col("key").alias(mine), F.col("spans").alias(f"{mine}s")), mine, "left")
    return joined.withColumn(text_col, F.when(F.col(f"{mine}s").isNull(), F.col(text_col)).otherwise(put(F.col(text_col), F.col(f"{mine}s")))).select(*docs.columns)
