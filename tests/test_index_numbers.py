"""Tokens of the index are counted by number, and texts are handed over, not lists of texts."""

import numpy as np
import pyarrow as pa
from lucerna.operators import search_index


def test_shared_characters_equal_one_by_one():
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abé😀"), r.integers(1, 9))) for _ in range(400)]
    rows = np.sort(r.integers(0, 30, 400))
    distinct, number = search_index._numbered(pa.array(texts))
    assert distinct.to_pylist() == sorted(set(texts)) and [distinct[int(k)].as_py() for k in number] == texts
    key = np.unique(rows * len(distinct) + number)
    rows, number = key // len(distinct), key % len(distinct)
    names = distinct.take(pa.array(number)).to_pylist()
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [common(names[k - 1], names[k]) if k and rows[k] == rows[k - 1] else 0 for k in range(len(names))]
    assert search_index._in_common(distinct.to_pylist(), number, rows).tolist() == want
    assert search_index._in_common([], np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_no_lists_are_handed_over(spark):
    units = spark.createDataFrame([("a", "s", "Alpha beta", "", "alpha, Beta gamma", None), ("b", "s", None, "", " - ", "")], "id string, session_id string, title string, excerpt string, content_text string, search_text string")
    found = search_index.postings(units)
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.length, r.tokens, r.tfs, r.shared) for r in found.orderBy("id").collect()] == [("a", 5, ["alpha", "beta", "gamma"], [2.0, 2.0, 1.0], [0, 0, 0]), ("b", 0, [], [], [])]
    asked = spark.createDataFrame([("q", "s", "alp zz")], "question_id string, session_id string, question string")
    best = search_index.search(asked, search_index.built(units), 1)
    assert [(r.question_id, r.id, r.place) for r in best.collect()] == [("q", "a", 1)]
    assert "array_join(" in best._jdf.queryExecution().optimizedPlan().toString()
