"""Of chunks and transcripts a task sends on only the first matches of each question, scored where they are read."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.functions.batches import TOKEN_BYTES, runs
from lucerna.operators import retrieval
from lucerna.plans.queries import QUERIES
from lucerna.plans.views import Views
from tests.conftest import SF

ASKED = ["What is a.b (c)?", "define e=mc^2 | x", "alpha beta gamma", "What is beta?", "", None, "delta omega", "explain tau*", "what is the?", "one two three four five six seven eight nine alpha"]
TEXTS = ["so a.b (c) is", "aXb (c)", "E=mc^2 | x holds", "beta", "the alphabet", "gamma alpha", "delta and more", "", None, "tau* and tau", "one two three four five six seven eight alpha beta", "\u00e9t\u00e9 be\u00adta Alpha\u00a0", "the is of"]


def test_runs_and_tokens(spark):
    texts = [*TEXTS, " ", "\u4e2d a1 b2 a1", "x"]
    rows, found = runs(pa.array(["skipped", *texts]).slice(1), TOKEN_BYTES)
    assert list(zip(rows.tolist(), found.to_pylist()))[:5] == [(0, "so"), (0, "a"), (0, "b"), (0, "c"), (0, "is")]
    want = [r.t or [] for r in spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1).select(X.unique(X.tokenize("x")).alias("t")).collect()]
    normal = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1).select(X.normalize("x").alias("t")).collect()]
    row, place, number, tokens = retrieval._distinct_tokens(pa.array(normal, pa.string()))
    assert [[tokens[int(k)].as_py() for k in number[row == r]] for r in range(len(texts))] == want
    assert [place[row == r].tolist() for r in range(len(texts))] == [list(range(len(w))) for w in want]
    assert len(runs(pa.array([], pa.string()), TOKEN_BYTES)[1]) == 0


def test_rounds_as_spark(spark):
    """Every score of up to 48 tokens."""
    each = [(n, s, k, b) for n in range(1, 49) for s in range(n + 1) for k in range(0, s + 1) for b in (0.1, 0.4, 0.4 + 0.4, 0.4 + 0.7)]
    n, s, k, b = (np.array(x) for x in zip(*each))
    raw = s / n * 1.6 + k / n * 0.6 + b
    got = retrieval._rounded(raw)
    df = spark.createDataFrame(pa.table({"n": n, "s": s, "k": k, "b": b, "got": got}))
    assert df.where(F.round(F.col("s") / F.col("n") * F.lit(1.6) + F.col("k") / F.col("n") * F.lit(0.6) + F.col("b"), 3) != F.col("got")).count() == 0


def test_first_equal_first_of_all(spark, monkeypatch):
    """With few rows at once, many equal scores, and positions that are equal or null."""
    rows = [(f"{s}{k}", s, t) for s in ("s", "t", None) for k, t in enumerate(ASKED)]
    q = spark.createDataFrame(rows, "question_id string, session_id string, question string")
    many = [(f"{s}{k}-{m}", s, t, ["en", t] if m % 2 else None, None if m == 3 else m % 5) for s in ("s", "t", "u", None) for k, t in enumerate(TEXTS) for m in range(12)]
    c = spark.createDataFrame([(i, s, t[:5] if t and o == 2 else "", w, t, t, o) for i, s, t, w, o in many], "id string, session_id string, heading string, keywords array<string>, text string, speaker_label string, order_index int").repartition(3)
    listed = lambda df: [tuple(r) for r in retrieval.merge_matches([df], 4).orderBy("question_id", "rank").collect()]
    for score in (retrieval.material_matches, retrieval.transcript_matches):
        want = listed(score(q, c))
        assert len(want) > 20
        for asked, together in ((200_000, 2000), (2, 7)):
            monkeypatch.setattr(retrieval, "ASKED", asked)
            monkeypatch.setattr(retrieval, "TOGETHER", together)
            assert listed(score(q, c, 4)) == want
        assert score(q.limit(0), c, 4).count() == 0
        assert score(q, c.coalesce(1), 1).groupBy("question_id").count().where("count > 1").count() == 0


def test_merged_queries_send_only_first_matches(spark):
    """Fails where all pairs of questions and chunks are sent on."""
    plan = QUERIES["C7_extract"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("shared#") > 4
    v = Views(spark, SF)
    assert retrieval.material_matches(v.questions(), v.chunks(), 18).count() < retrieval.material_matches(v.questions(), v.chunks()).count()
