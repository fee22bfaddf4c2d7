"""Ranked lexical search by the Best Position Algorithm, for a stated set of queries against all documents.

1. Queries are read in blocks of at most QUERY_TERMS pairs of query and term; each block is a pass of its own, and only its
   terms are broadcast, so what is sent doesn't grow with the documents.
2. One pass counts the documents, their terms and in how many documents each query term stands; weights follow.
3. A second pass reads the documents as they lie. A task gathers the postings of BLOCK_POSTINGS or so, and makes of them one
   impact list a term: documents by falling impact, with a way back from a document to its places in all lists.
4. For each query the lists are read side by side. A document that comes up for the first time is looked up in all the
   query's lists (direct access): that gives its whole score, and marks its places as seen. The best position of a list is
   the end of its unbroken run of seen places, which direct accesses carry beyond what was read in turn; the sum of the
   impacts there bounds every document not seen. A list seen whole adds nothing. Reading ends once that bound lies strictly
   below the kth score, so documents that tie with the kth are all seen.
5. The k best of the blocks before are the score to beat in the next, and a task sends k rows a query. These are ranked in
   two steps, so that many tasks' rows of one query don't meet in one task.

Documents are not shuffled. Scores are 64-bit integers throughout.

Defined results: a null text has no term; a query without a term gives no row; a row that repeats a doc_id is a document of
its own; equal scores are ranked by doc_id, a null one last; each row of queries is a query of its own and ranked for itself,
also where item_id repeats; without documents or queries there is no row; columns other than id and text are not read. A text
of any length is taken piece by piece; a term in over half the documents has a weight near 0, and one of weight 0 adds nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import as_bytes, cut, slices, sums, terms

MOST = 50
#: Fixed values of the score.
UNIT, TF_SCALE, LENGTH_SCALE, B_PERCENT, WEIGHT_SCALE = 1_000_000_000, 1000, 20, 50, 1000
#: Pairs of query and term in a block of queries; postings that a task holds at a time; places read of each list in the first turn.
QUERY_TERMS, BLOCK_POSTINGS, STRIDE = 200_000, 1_000_000, 4
#: Parts that a query's rows are ranked in before they are ranked together.
PARTS = 32


def query_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = QUERY_TERMS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The queries as (id, distinct terms), in blocks of about `most` terms; one block is on the driver at a time."""
    block, size = [], 0
    for r in items.select(items[id_col].alias("i"), items[text_col].cast("binary").alias("t")).toLocalIterator():
        found = sorted({t for piece in terms(bytes(r.t or b"")) for t in piece})
        block.append((r.i, found))
        size += max(len(found), 1)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _counted(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[tuple[pa.RecordBatch, list[int], list[Counter]]]:
    """Of each slice of (doc_id, text): the number of terms of each text, and how often each term with a number stands in it."""
    for batch in slices(batches):
        lengths, counts = [], []
        for text in as_bytes(batch.column(1)):
            n, c = 0, Counter()
            for piece in terms(text):
                n += len(piece)
                c.update(map(number.get, piece))
            c.pop(None, None)
            lengths.append(n)
            counts.append(c)
        yield batch, lengths, counts


def statistics(docs: DataFrame, number: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and the documents that hold each numbered term."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, with_terms, all_terms = Counter(), 0, 0
        for _, lengths, counts in _counted(batches, shared.value):
            with_terms += sum(n > 0 for n in lengths)
            all_terms += sum(lengths)
            for c in counts:
                df.update(c.keys())
        df[-1], df[-2] = with_terms, all_terms
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    found = {r.term: r.n for r in docs.mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    shared.unpersist()
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(t, 0) for t in range(len(number))], np.int64)


def weights_of(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Lists:
    """Impact lists of a block of documents: postings by document, and by term with falling impact."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, per_doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.known = ids, known
        self.begin, self.per_doc, self.term, self.impact = np.cumsum(per_doc) - per_doc, per_doc, term, impact
        doc = np.repeat(np.arange(len(ids)), per_doc)
        order = np.lexsort((ids[doc], ~known[doc], -impact, term))
        self.doc, self.falling = doc[order], impact[order]
        sizes = np.bincount(term, minlength=n_terms)
        self.start = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.place = np.empty(len(term), np.int64)  # of each posting in its term's list
        self.place[order] = np.arange(len(term)) - self.start[term[order]]


class Best:
    """The k best documents found so far: score, whether the id is not null, id."""

    def __init__(self, k: int):
        self.k, self.rows = k, (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    @property
    def kth(self) -> int:
        return int(self.rows[0][-1]) if len(self.rows[0]) == self.k else 0

    def add(self, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        good = score >= max(self.kth, 1)
        if not good.any():
            return
        score, known, ids = (np.concatenate([a, b[good]]) for a, b in zip(self.rows, (score, known, ids)))
        order = np.lexsort((ids, ~known, -score))[: self.k]
        self.rows = score[order], known[order], ids[order]


def best_positions(lists: Lists, query: np.ndarray, best: Best, spare: np.ndarray, stride: int = STRIDE) -> tuple[int, int]:
    """Adds the best documents of the lists of the query's terms to best. Returns how many documents were looked up and places read.

    spare: a number for each term, all -1; it is used and left so.
    """
    query = query[lists.sizes[query] > 0]
    size, start = lists.sizes[query], lists.start[query]
    offset = np.cumsum(size) - size
    spare[query] = np.arange(len(query))
    seen = np.zeros(int(size.sum()), bool)
    done = np.zeros(len(lists.ids), bool)
    position = np.zeros(len(query), np.int64)  # places of the unbroken run of seen ones
    looked, read = 0, 0
    while True:
        bound = 0
        come = []
        for i, at in enumerate(position.tolist()):
            if at < size[i]:
                bound += int(lists.falling[start[i] + max(at - 1, 0)])
                come.append(lists.doc[start[i] + at : start[i] + min(at + stride, int(size[i]))])
        if not come or bound < max(best.kth, 1):
            break
        read += sum(map(len, come))
        new = np.concatenate(come)
        new = np.unique(new[~done[new]])
        done[new] = True
        looked += len(new)
        n = lists.per_doc[new]
        at = np.arange(int(n.sum())) + np.repeat(lists.begin[new] - (np.cumsum(n) - n), n)
        which = spare[lists.term[at]]
        ours = which >= 0
        seen[offset[which[ours]] + lists.place[at[ours]]] = True
        best.add(sums(np.where(ours, lists.impact[at], 0), n), lists.known[new], lists.ids[new])
        for i, p in enumerate(position.tolist()):
            if p < size[i]:
                rest = seen[offset[i] + p : offset[i] + size[i]]
                gap = int(rest.argmin())
                position[i] = p + (gap if not rest[gap] else len(rest))
        stride *= 2
    spare[query] = -1
    return looked, read


def _found(docs: DataFrame, queries: list[list[int]], number: dict[bytes, int], weight: np.ndarray, documents: int, all_terms: int, most: int) -> DataFrame:
    """(query, score, doc_id): the best documents of each query, task by task."""
    shared = docs.sparkSession.sparkContext.broadcast((number, weight, [np.array(q, np.int64) for q in queries]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weight, asked = shared.value
        best = [Best(most) for _ in asked]
        spare = np.full(len(weight), -1, np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> None:
            ids, known, per_doc, term, impact = (np.concatenate(x) for x in zip(*held))
            lists = Lists(ids, known, per_doc, term, impact, len(weight))
            for q, b in zip(asked, best):
                best_positions(lists, q, b, spare)

        for batch, lengths, counts in _counted(batches, number):
            per_doc = np.array([len(c) for c in counts], np.int64)
            term = np.fromiter((t for c in counts for t in c), np.int64)
            tf = np.fromiter((n for c in counts for n in c.values()), np.int64)
            norm = [LENGTH_SCALE * (100 - B_PERCENT + (B_PERCENT * n * documents) // all_terms) for n in lengths]
            impact = weight[term] * ((UNIT * tf) // (TF_SCALE * tf + np.repeat(np.array(norm, np.int64), per_doc)))
            column = batch.column(0)
            held.append((column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False), per_doc, term, impact))
            size += len(term)
            if size >= BLOCK_POSTINGS:
                flush()
                held, size = [], 0
        if held:
            flush()
        rows = [b.rows for b in best]
        n = [len(r[0]) for r in rows]
        score, known, ids = (np.concatenate([r[k] for r in rows]) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(rows)), n)), pa.array(score), pa.array(ids, mask=~known)], ["query", "score", "doc_id"])

    return docs.mapInArrow(search, "query long, score long, doc_id long")


def _top(found: DataFrame, keys: list, most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(docs: DataFrame, items: DataFrame, most: int = MOST, query_terms: int = QUERY_TERMS) -> DataFrame:
    """The `most` best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in query_blocks(items, most=query_terms):
        number = {t: n for n, t in enumerate(sorted({t for _, found in block for t in found}))}
        documents, all_terms, df = statistics(texts, number)
        if not number or not documents:
            continue
        found = _found(texts, [[number[t] for t in found] for _, found in block], number, weights_of(documents, df), documents, all_terms, most)
        found = _top(_top(found, ["query", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))], most).drop("rank"), ["query"], most)
        names = F.broadcast(spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"query long, item_id {kind}"))  # QUERY_TERMS rows at most
        out = out.unionByName(cut(found.join(names, "query").select("item_id", "rank", "doc_id", "score")))
    return out


_TERM_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
with d as (select row_number() over () as rn, doc_id, {_TERM_SQL} as terms from documents),
docs as (select rn, doc_id, len(terms) as n from d where len(terms) > 0),
total as (select count(*) as docs, sum(n)::BIGINT as l from docs),
tf as (select rn, term, count(*) as tf from (select rn, unnest(terms) as term from d) group by 1, 2),
df as (select term, floor({WEIGHT_SCALE} * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT as w from tf, total group by 1),
items as (select row_number() over () as q, item_id, list_distinct({_TERM_SQL}) as terms from benchmark),
asked as (select q, item_id, unnest(terms) as term from items),
m as (select rn, doc_id, {LENGTH_SCALE} * (100 - {B_PERCENT} + ({B_PERCENT} * n * docs) // l) as norm from docs, total),
scored as (select q, item_id, doc_id, rn, sum(w * (({UNIT} * tf) // ({TF_SCALE} * tf + norm)))::BIGINT as score
  from asked join tf using (term) join df using (term) join m using (rn) group by 1, 2, 3, 4)
select item_id, rank::INTEGER as rank, doc_id, score from (
  select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from scored where score > 0) where rank <= {MOST}
"""
