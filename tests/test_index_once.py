"""A text that a unit holds in several columns is split once; frequencies and prefixes are counted in the tasks that read them."""

import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from lucerna.operators import search_index

TEXTS = ["Alpha beta, alpha", "Été naïve 中文 x1", "", None, "Kelvin alphabet", "a-b_c 12 be"]


def _units(spark):
    rows = [(f"u{k}-{m}", "s" if k % 2 else "t", x, [x, None, "Beta"][m], x and x.upper() if m else "other") for k, x in enumerate(TEXTS) for m in range(3)]
    return spark.createDataFrame(rows, "id string, session_id string, content_text string, excerpt string, search_text string").withColumn("title", F.col("id"))


def _words(x):
    plain = "".join(c for c in unicodedata.normalize("NFD", (x or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def test_postings_equal_plain_ones(spark):
    weights = {"title": 1.0, "excerpt": 0.5, "content_text": 2.0, "search_text": 4.0}
    units = _units(spark)
    found = search_index.postings(units, weights)
    want = {}
    for r in units.collect():
        tf = Counter()
        for c, w in weights.items():
            for t in _words(r[c]):
                tf[t] += w
        want[r.id] = (sum(len(_words(r[c])) for c in weights), sorted(tf.items()))
    assert {r.id: (r.length, list(zip(r.tokens, r.tfs))) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "WHEN (w1#" in plan  # a text is compared with those before it, not split again

    shared = search_index.frequencies_of(found)
    assert "Generate" not in shared._jdf.queryExecution().optimizedPlan().toString()
    plain = found.select(F.explode(F.arrays_zip("tokens", "shared")).alias("p")).groupBy("p.tokens", "p.shared").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, plain.collect()))


def test_search_by_prefixes_of_frequencies(spark):
    q = spark.createDataFrame([("q", "s", "alp be"), ("r", "t", "kel zz"), ("n", "u", "alpha")], "question_id string, session_id string, question string")
    found = search_index.search(q, search_index.built(_units(spark)), 18)
    assert {(r.question_id, r.id[:2]) for r in found.collect()} == {("r", "u4")} | {("q", f"u{k}") for k in (1, 3, 5)}
