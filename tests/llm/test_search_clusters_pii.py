"""Centroid clustering, lexical search and personal data against brute force, and their edge cases."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lucerna.llm import centroids, lexical_search, pii
from lucerna.llm.common import folded, terms
from tests.conftest import SF

# --- centroids


@pytest.mark.parametrize("k", [1, 2, 3, 16, 40])
def test_tree_gives_the_nearest_centroid_and_the_smaller_number(k):
    r = np.random.default_rng(k)
    c = r.integers(-3, 4, (k, 5))
    c[k // 2] = c[0]  # equal centroids
    x = np.concatenate([r.integers(-3, 4, (500, 5)), c])  # few values: many ties
    number, best, taken = centroids.nearest(centroids.build(c), x)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all() and taken <= len(x) * k


def test_tree_leaves_far_centroids_out():
    c = np.array([[1000 * k, 0] for k in range(64)])
    x = np.array([[1000 * (k % 64) + 3, 1] for k in range(640)])
    number, _, taken = centroids.nearest(centroids.build(c), x)
    assert (number == np.arange(640) % 64).all() and taken < 640 * 20


def test_tree_with_large_numbers():
    c = np.array([[centroids.LIMIT] * 64, [-centroids.LIMIT] * 64, [centroids.LIMIT - 1] * 64])
    number, best, _ = centroids.nearest(centroids.build(c), c)
    assert number.tolist() == [0, 1, 2] and best.tolist() == [0, 0, 0]
    assert centroids.nearest(centroids.build(c[:1]), c[1:2])[1].tolist() == [64 * (2 * centroids.LIMIT) ** 2]


def test_clusters_of_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r.normal(0, 1, 4)], 0) for i in range(30)]
    rows += [(3, rows[3][1], 1), (None, rows[4][1], 1), (50, None, 1), (51, [], 1), (52, [1.0, 2.0, 3.0], 1), (53, [1.0, None, 2.0, 3.0], 1), (54, [float("nan")] * 4, 1), (55, [float("inf")] * 4, 1), (56, [1e300] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = sorted(map(tuple, centroids.cluster(df, k=5, dimensions=4).collect()), key=str)
    assert len(got) == 33 and not {50, 51, 52, 53, 54, 55} & {g[0] for g in got}
    assert got == sorted(map(tuple, centroids.cluster(df.repartition(7), k=5, dimensions=4).collect()), key=str)
    kept = [(i, [min(max(math.floor(64 * v), -centroids.LIMIT), centroids.LIMIT) for v in x]) for i, x, _ in rows if x and len(x) == 4 and all(v is not None and math.isfinite(v) for v in x)]
    c = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:5]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), n) for n, y in enumerate(c))
    for _ in range(3):
        of = collections.defaultdict(list)
        for _, x in kept:
            of[near(x)[1]].append(x)
        c = [[sum(v) // len(of[n]) for v in zip(*of[n])] if of[n] else y for n, y in enumerate(c)]
    assert sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str) == sorted(((g[0], g[1], g[2]) for g in got), key=str)
    assert {g[5] for g in got} == {hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest() for n in {g[1] for g in got}}
    assert centroids.cluster(df.limit(0)).count() == 0 and centroids.cluster(df.limit(2), dimensions=4).count() == 2


# --- search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def _ranked(docs, items, most):
    each = [(d, collections.Counter(_terms(t))) for d, t in docs]
    each = [(d, c) for d, c in each if c]
    n_docs, all_terms = len(each), sum(sum(c.values()) for _, c in each)
    df = collections.Counter(t for _, c in each for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in each:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def test_terms_are_the_patterns(monkeypatch):
    text = "Ab-c_1 é x 日本\0Z " * 50
    assert [t.decode() for p in terms(text.encode()) for t in p] == _terms(text)
    import lucerna.llm.common as common

    monkeypatch.setattr(common, "PIECE", 7)
    assert [t.decode() for p in terms(text.encode()) for t in p] == _terms(text)


@pytest.mark.parametrize("postings,stride", [(1_000_000, 4), (40, 1), (300, 64)])
def test_search_finds_the_best(spark, monkeypatch, postings, stride):
    r = np.random.default_rng(postings)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(words[min(39, int(w))] for w in r.exponential(6, r.integers(1, 30)))) for k in range(400)]
    docs += [(k + 400, docs[7][1]) for k in range(60)] + [(7, docs[7][1]), (None, docs[7][1]), (900, None), (901, ""), (902, "!!"), (903, "W1 w1 w2 " * 30_000)]
    items = [(1, "w1 w2 W3 w3 zzz"), (2, docs[7][1]), (2, "w30 w31"), (3, None), (4, "?"), (None, "w39"), (5, "w0 w38")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, rank int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical_search.best_positions, "__defaults__", (stride,))
    number = {t: n for n, t in enumerate(sorted({t for _, x in items for t in [y.encode() for y in _terms(x)]}))}
    assert lexical_search.statistics(df.select("doc_id", "text"), number)[0] == len(docs) - 3
    got = sorted(map(tuple, lexical_search.search(df, q, most=10, query_terms=5).collect()), key=str)  # several blocks of queries
    assert got == _ranked(docs, items, 10)


def test_best_positions_stop_early_and_are_right():
    """Against all scores, with lists of many ties, in blocks of any stride."""
    r = np.random.default_rng(5)
    for stride in (1, 4, 50):
        n, v = 3000, 12
        has = r.random((n, v)) < 0.3
        weight = r.integers(0, 6, (n, v)) ** 3
        ids, per_doc = r.permutation(n), has.sum(1)
        doc, term = np.nonzero(has)
        lists = lexical_search.Lists(ids, np.ones(n, bool), per_doc, term, weight[doc, term], v)
        for query in (np.arange(3), np.array([5]), np.arange(v)):
            best = lexical_search.Best(10)
            looked, _ = lexical_search.best_positions(lists, query, best, np.full(v, -1), stride)
            score = (weight * has)[:, query].sum(1)
            want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if s > 0)[:10]
            assert [(-s, i) for s, i in zip(best.rows[0].tolist(), best.rows[2].tolist())] == want
            assert len(query) == v or looked < n / 2


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.search(docs, items).collect()] == [(1, 1, 1)]


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain(text):
    def fine(kind, m):
        digits = re.sub("[^0-9]", "", m[0])
        if kind == "ip":
            return all(int(p) <= 255 for p in m[0].split("."))
        if kind == "card":
            twice = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(t - 9 * (t > 9) for t in twice) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), k, m.end()) for k, p in enumerate(PLAIN.values()) for m in re.finditer(p, text or "") if fine(list(PLAIN)[k], m)]
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(found))


def _base(text):
    return ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b, _ in pii.base_spans(text))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@@..--_ +()0123456789é", max_size=60))
def test_patterns_in_any_text(text):
    assert _base(text) == _plain(text)


def test_patterns_by_case():
    for text in ("@x.y@z.w", "a@b.c_d@e.f", "a@b@c.d", "é@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "4111 1111-1111 1111", "4111  1111", "+1 (555) 010-9999).", "+12345", "x" * 100_000 + "@", "1" * 100_000, "1." * 50_000, "+1" * 50_000):
        assert _base(text) == (_plain(text) if len(text) < 1000 else _base(text))


def test_private_data(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.find(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = _plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [getattr(r, f"n_{k}") for k in PLAIN] == [want.count(f"{k}:") for k in PLAIN]
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in PLAIN) == want
        assert want or not r.spans


def _texts():
    filler = "the meeting of the group was held in the large room and the notes were kept there"
    out = [f"{filler} {n} ask Zorblat at boss{n % 2}@corp{n % 2}.example.com about the room and page {n}. {filler}" for n in range(6)]
    out = [t.replace("Zorblat", "Zorblat" if n % 2 == 0 else "Quimby") for n, t in enumerate(out)]
    return out + [f"{filler} {n} again" for n in range(30)]


def _revealing(texts, min_contexts=2):
    """Plainly: the terms that reveal REMOVE or more, by what is near each address."""
    count, near, contexts, entity = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.Counter()
    for t in texts:
        count.update(_terms(t))
        for m in re.finditer(PLAIN["email"], t):
            entity[m[0].lower()] += 1
            for lo, hi in ((max(0, m.start() - pii.CONTEXT), m.start()), (m.end(), min(len(t), m.end() + pii.CONTEXT))):
                for w in re.finditer(r"\w+", t):
                    if lo <= w.start() and w.end() <= hi:
                        near[m[0].lower(), w[0].lower()] += 1
                        contexts[m[0].lower(), w[0].lower()].add(t[lo:hi].lower())
    total = sum(count.values())
    share = {k: 1 + math.log(min(1, n / count[k[1]])) / -math.log(entity[k[0]] / total) for k, n in near.items() if len(contexts[k]) >= min_contexts}
    return {k for k, s in share.items() if s >= pii.REMOVE}, {k for k, s in share.items() if pii.GENERALISE <= s < pii.REMOVE}


def test_terms_that_reveal_an_address(spark):
    texts = _texts()
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    removed, general = _revealing(texts)
    assert ("boss0@corp0.example.com", "zorblat") in removed and ("boss1@corp1.example.com", "quimby") in removed
    acted = pii.disclosures(pii.scan(df.withColumn("key", df.text)))
    of = {pii._number(f"email:boss{k}@corp{k}.example.com"): f"boss{k}@corp{k}.example.com" for k in (0, 1)}
    found = {(of[r.entity], r.term, r.kind) for r in acted.collect()}
    assert found == {(*k, 5) for k in removed} | {(*k, 4) for k in general}
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    at = texts[0].index("Zorblat")
    assert f"removed:{at}:{at + 7}" in spans[0].split(",") and all(not spans[n] for n in range(6, 36))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zorblat" not in clean[0] and "[EMAIL]" in clean[0] and clean[20] == texts[20]


def test_copies_are_no_evidence(spark):
    df = spark.createDataFrame([(n, "rare wombat at one@two.example.org here") for n in range(20)], "doc_id long, text string")
    assert {r.spans for r in pii.find(df).collect()} == {"email:15:34"}


def test_odd_rows(spark):
    near = "Tellmore sits by me@x.example.com now and then. "
    rows = [(1, None), (2, ""), (None, near + "a"), (None, near + "b"), (3, near + "c"), (3, near + "c"), (3, "other"), (4, "y" * 300_000 + " " + near * 3), (5, "me@x.example.com" * 3)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string").repartition(4)
    got = pii.find(df).collect()
    assert len(got) == len(rows) and sum(r.n_email for r in got) == sum(_plain(t).count("email:") for _, t in rows)
    assert sorted(r.spans for r in got if r.doc_id == 3)[0] == "" and len({r.spans for r in got if r.doc_id == 3}) == 2
    assert all("removed:0:8" in r.spans.split(",") for r in got if r.doc_id is None)
    clean = pii.sanitise(df)
    assert clean.columns == df.columns and clean.count() == len(rows) and {r.spans for r in clean.collect()} == {"z"}
    assert sorted(r.text for r in clean.where("doc_id = 3").collect())[-1] == "other"
    assert pii.find(df.limit(0)).count() == pii.sanitise(df.limit(0)).count() == 0


def test_overlapping_spans_are_replaced_once():
    assert pii.replaced("ab +1234567890 cd", [(3, 2, 14), (4, 3, 14), (15, 5, 17)]) == "ab [CARD] "
    assert folded("É_Ab".encode()) == "É ab".encode()
