"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

1. Lexicon: for each word and each word beginning, in how many toxic and other training documents it occurs.
   Those that mark toxic documents become terms (whole words, or stems that stand for all words beginning so).
2. The Levenshtein automata of the terms are intersected with the trie of the lexicon into one table of states;
   the distinct tokens of a batch of texts walk through it together. Whole terms may be misspelled (an insertion,
   deletion, substitution or swap; one for 5 to 8 letters, two from 9); stems match exactly.
3. Each hit looks at the words around it: quotation marks around the hit and reporting words speak for a quotation,
   words that address someone for abuse. Both kinds of words are lists of a few dozen, in four languages (REPORTING,
   ADDRESS).
4. A logistic regression over the sums of hits turns this into a score from 0 to 1. A ridge draws its weights to
   PRIOR, set by hand, which is what holds for features that the training rows never show.

The lexicon has no cap: a term must stand in MIN_SUPPORT_SHARE of the toxic documents, so there are at most as many as
a toxic document has words and stems, divided by that share.

Lexicon and regression are fitted on at most FIT_ROWS labelled rows, those with the smallest hash of their id; so the
labels can be broadcast to the scan of the texts, whose other rows are never shuffled.

Defined results: a null or empty text has no hits and gets the score that belongs to no hits; with no training row
of either label every score is 0; rows with a null id or repeated rows are scored each on its own; a document with
several labels counts once for each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import cut, fold, slices

FIT_ROWS = 40_000
MIN_STEM, MAX_STEM, MIN_WORD = 3, 9, 4
MIN_SUPPORT, MIN_SUPPORT_SHARE, MIN_LOG_ODDS, MIN_STEM_ODDS = 5, 0.01, 3.5, 2.8
WHOLE_SHARE = 0.8
FAMILY, ALIKE = 3, 4
WINDOW = 8
#: Letters from which a term may have one, two edits.
ONE_EDIT, TWO_EDITS = 5, 9
#: Words around a hit.
REPORTING = frozenset("said says saying wrote writes quoted quote quotes quoting called calls calling word words term terms slur insult reported reportedly alleged allegedly".split())
ADDRESS = frozenset("you your yours you're youre u ur yourself du dich dir ihr dein deine tu te toi ton ta vous votre usted tus eres".split())
QUOTES = "\"“”„«»‟"
FEATURES = ["exact", "fuzzy", "stem", "quoted", "reported", "address", "density"]
#: What the regression is drawn to where the training rows don't tell.
PRIOR = np.array([2.0, 1.0, 1.5, -1.0, -0.5, 0.5, 0.5])
RIDGE = 2.0

_EDGE = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‟…’‘"
_TOKENS = re.compile(r"[^\x20\x09-\x0D]+")
HITS = "exact double, fuzzy double, stem double, quoted double, reported double, address double, density double"


def tokens(text: str) -> list[str]:
    return [t.strip(_EDGE) for t in _TOKENS.findall(text.lower())]


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float


def _document_counts(texts: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
    """In how many rows of texts each word and each stem (with *) occurs, or only those of a given set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                words = {w for w in tokens(text) if len(w) >= MIN_STEM}
                every = words | {w[:k] + "*" for w in words for k in range(MIN_STEM, min(len(w), MAX_STEM + 1))}
                found.update(every if among is None else every & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())], ["term", "n"])

    return texts.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(labelled: DataFrame) -> list[Term]:
    """labelled: text, toxic.

    Candidates occur in at least MIN_SUPPORT_SHARE of the toxic documents; so there are at most
    1 / MIN_SUPPORT_SHARE times as many as a document has words and stems, whatever the number of documents.
    """
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    sizes = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    n_toxic, n_other = sizes[0], sizes[1]
    if not n_toxic or not n_other:
        return []
    support = max(MIN_SUPPORT, MIN_SUPPORT_SHARE * n_toxic)
    toxic = {r.term: r.n for r in _document_counts(rows.where("toxic = 1")).where(F.col("n") >= support).collect()}
    other = {r.term: r.n for r in _document_counts(rows.where("toxic = 0"), frozenset(toxic)).collect()}
    odds = {t: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((other.get(t, 0) + 0.5) / (n_other + 1))) for t, n in toxic.items()}
    stems = {t[:-1] for t in odds if t.endswith("*") and odds[t] >= MIN_STEM_ODDS}
    whole = {t for t in odds if not t.endswith("*") and len(t) >= MIN_WORD and odds[t] >= MIN_LOG_ODDS}
    taken: list[Term] = []
    covered: list[str] = []
    for s in sorted(stems, key=lambda x: (len(x), x)):
        if any(s.startswith(c) for c in covered):
            continue
        best = max((w for w in whole if w.startswith(s)), key=lambda w: (toxic[w], w), default=None)
        if best and toxic[best] >= WHOLE_SHARE * toxic[s + "*"]:
            continue
        covered.append(s)
        taken.append(Term(s, True, odds[s + "*"]))
    taken += [Term(w, False, odds[w]) for w in whole if not any(w.startswith(c) for c in covered)]
    return families(sorted(taken, key=lambda x: (-x.weight, x.text)))


def families(terms: list[Term]) -> list[Term]:
    """FAMILY or more terms that begin alike are the endings of one stem: their common beginning takes their place."""
    groups: dict[str, list[Term]] = {}
    for t in terms:
        groups.setdefault(t.text[:ALIKE], []).append(t)
    out: list[Term] = []
    for group in groups.values():
        if len(group) < FAMILY:
            out += group
        else:
            out.append(Term(commonprefix([t.text for t in group]), True, min(t.weight for t in group)))
    return out


@dataclass
class Automaton:
    classes: np.ndarray  # class of each code point, 0 for those in no term
    step: np.ndarray  # (states, classes): next state, 0 is dead
    term: np.ndarray  # of each state: the term accepted, -1 if none
    edits: np.ndarray


def edits_allowed(term: Term) -> int:
    return 0 if term.stem or len(term.text) < ONE_EDIT else 1 if len(term.text) < TWO_EDITS else 2


def automaton(terms: list[Term]) -> Automaton:
    """The terms' Levenshtein automata intersected with their trie, made deterministic.

    A place is (trie node, edits so far, character that a swap still owes). A state is a set of places.
    """
    children: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    most = [0]
    for k, term in enumerate(terms):
        node = 0
        for c in term.text:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                most.append(0)
            most[node] = max(most[node], edits_allowed(term))
            node = children[node][c]
        most[node] = max(most[node], edits_allowed(term))
        ends[node] = k
    letters = sorted({c for t in terms for c in t.text})
    number = {c: i + 1 for i, c in enumerate(letters)}

    def closed(places: set) -> frozenset:
        """With deletions, and without places that a better one covers."""
        todo, out = list(places), set(places)
        while todo:
            node, e, owed = todo.pop()
            if not owed and e < most[node]:
                for nxt in children[node].values():
                    if e + 1 <= most[nxt] and (nxt, e + 1, "") not in out:
                        out.add((nxt, e + 1, ""))
                        todo.append((nxt, e + 1, ""))
        return frozenset(p for p in out if not any((p[0], e, p[2]) in out for e in range(p[1])))

    def move(state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e, owed in state:
            if node < 0:
                out.add((node, e, owed))
                continue
            if owed:
                if c == owed[0]:
                    out.add((int(owed[1:]), e, ""))
                continue
            for x, nxt in children[node].items():
                if x == c:
                    out.add((nxt, e, ""))
                    if nxt in ends and terms[ends[nxt]].stem and e == 0:
                        out.add((-1 - ends[nxt], 0, ""))
                elif e < most[nxt]:
                    out.add((nxt, e + 1, ""))
                    for y, after in children[nxt].items():
                        if y == c and e < most[after]:
                            out.add((node, e + 1, f"{x}{after}"))
            if e < most[node]:
                out.add((node, e + 1, ""))
        return closed(out)

    states = {frozenset(): 0, closed({(0, 0, "")}): 1}
    order = list(states)
    rows = [[0] * (len(letters) + 1)]
    at = 1
    while at < len(order):
        row = []
        for c in ["", *letters]:
            nxt = move(order[at], c or "\0")
            if nxt not in states:
                states[nxt] = len(order)
                order.append(nxt)
            row.append(states[nxt])
        rows.append(row)
        at += 1
    accepts = []
    for state in order:
        hits = [(e, ends[n]) for n, e, owed in state if not owed and n >= 0 and n in ends and e <= edits_allowed(terms[ends[n]]) and not (terms[ends[n]].stem and e == 0)]
        hits += [(0, -1 - n) for n, _, _ in state if n < 0]
        accepts.append(min(hits, default=(0, -1)))
    classes = np.zeros(max(map(ord, letters), default=0) + 2, np.int16)  # the last stands for all beyond
    for c, i in number.items():
        classes[ord(c)] = i
    return Automaton(classes, np.array(rows, np.int32), np.array([k for _, k in accepts]), np.array([e for e, _ in accepts]))


def walk(a: Automaton, words: list[str]) -> dict[str, tuple[int, int]]:
    """Words that the automaton accepts: their term and edits. All words advance together, a character at a time."""
    if not words or len(a.step) < 2:
        return {}
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = a.classes[np.minimum(points, len(a.classes) - 1)]
    offset = np.cumsum(lengths) - lengths
    alive, state, t, hits = np.arange(len(words)), np.ones(len(words), np.int32), 0, {}
    while len(alive):
        done = lengths[alive] == t
        for w, s in zip(alive[done].tolist(), state[done].tolist()):
            if a.term[s] >= 0:
                hits[words[w]] = (int(a.term[s]), int(a.edits[s]))
        alive, state = alive[~done], state[~done]
        state = a.step[state, classes[offset[alive] + t]]
        alive, state = alive[state > 0], state[state > 0]
        t += 1
    return hits


def automata(terms: list[Term], size: int = 8) -> list[Automaton]:
    """One automaton for each few neighbouring terms: the states of one for all would grow much faster than the lexicon."""
    order = sorted(range(len(terms)), key=lambda k: terms[k].text)
    out = []
    for k in range(0, len(order), size):
        some = np.array(order[k : k + size])
        a = automaton([terms[i] for i in some])
        a.term = np.where(a.term >= 0, some[np.maximum(a.term, 0)], -1)
        out.append(a)
    return out


def walk_all(tables: list[Automaton], words: list[str]) -> dict[str, tuple[int, int]]:
    hits: dict[str, tuple[int, int]] = {}
    for a in tables:
        for w, (term, edits) in walk(a, words).items():
            if w not in hits or edits < hits[w][1]:
                hits[w] = (term, edits)
    return hits


def _features(terms: list[Term], hits: dict[str, tuple[int, int]], text: str, words: list[str]) -> list[float]:
    out = [0.0] * len(FEATURES)
    at = [k for k, w in enumerate(words) if w in hits]
    if not at:
        return out
    raw = _TOKENS.findall(text)
    marks = np.cumsum([sum(map(t.count, QUOTES)) for t in raw]) if any(q in text for q in QUOTES) else None
    total = 0.0
    for k in at:
        term, edits = hits[words[k]]
        kind = 2 if terms[term].stem else 1 if edits else 0
        around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
        quoted = False
        if marks is not None:
            start, stop = max(0, k - WINDOW), min(len(raw), k + 1 + WINDOW)
            left = marks[k - 1] - (marks[start - 1] if start else 0) if k else 0
            right = marks[stop - 1] - marks[k]
            own = sum(map(raw[k].count, QUOTES))
            quoted = own >= 2 or left % 2 == 1 or (own == 1 and (right % 2 == 1 or left % 2 == 1))
        out[kind] += 0.25 if quoted else 1.0
        out[3] += quoted
        out[4] += any(w in REPORTING for w in around)
        out[5] += any(w in ADDRESS for w in around)
        total += 0.25 if quoted else 1.0
    return [*np.log1p(out[:6]).tolist(), float(np.log1p(100 * total / max(len(words), 1)))]


def hit_features(docs: DataFrame, terms: list[Term], tables: list[Automaton], carried: list[str]) -> DataFrame:
    """docs (text and carried columns): the carried columns and HITS. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, tables = shared.value
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            words = [tokens(t) if t else [] for t in texts]
            hits = walk_all(tables, list(set().union(*words) - {""}))
            rows = np.array([_features(terms, hits, t, w) for t, w in zip(texts, words)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(rows[:, k]) for k in range(len(FEATURES))]], [*carried, *FEATURES])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select("text", *carried).mapInArrow(run, f"{fields}, {HITS}")


@dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray | None
    bias: float
    tables: list[Automaton] | None = None


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Newton's method, drawn to prior by a ridge; the bias is free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    centre, pull = np.append(prior, 0.0), np.append(np.full(x.shape[1], ridge), 1e-3)
    w = centre.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pull * (w - centre)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), grad)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def train(labelled: DataFrame) -> Model:
    """labelled: text, toxic (0 or 1)."""
    rows = cut(labelled.where("text is not null and toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic")))
    terms = lexicon(rows)
    if not terms:
        return Model([], None, 0.0)
    tables = automata(terms)
    table = hit_features(rows, terms, tables, ["toxic"]).toPandas()
    if table["toxic"].nunique() < 2:
        return Model(terms, None, 0.0)
    return Model(terms, *logistic(table[FEATURES].to_numpy(), table["toxic"].to_numpy(float), PRIOR, RIDGE), tables)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, score, predicted and the features it was scored by."""
    ready = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    if model.weights is None:
        return ready.select(id_col, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *[F.lit(0.0).alias(c) for c in FEATURES])
    found = hit_features(ready, model.terms, model.tables or automata(model.terms), [id_col])
    z = sum((F.col(c) * float(w) for c, w in zip(FEATURES, model.weights)), F.lit(model.bias))
    chance = 1 / (1 + F.exp(-z))
    return found.select(id_col, chance.alias("score"), F.when(chance >= 0.5, 1).otherwise(0).alias("predicted"), *FEATURES)


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Labelled documents that the contract allows to learn from, at most about fit_rows of them."""
    allowed = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    some = allowed.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
