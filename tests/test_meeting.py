"""Questions meet chunks and transcripts where these are read."""

from pyspark.sql import functions as F

from lucerna.operators import retrieval
from lucerna.plans.queries import QUERIES
from lucerna.plans.views import Views
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_shuffled(spark):
    """And a query on one kind of evidence does nothing for the others."""
    for name in ("R8_J18_materials", "R8_transcripts"):
        assert "hashpartitioning" not in plan(QUERIES[name](spark, SF))


def test_one_branch_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr(Views, "index", lambda v: 1 / 0)
    assert QUERIES["R1_R2_R3_R7_glossary"](spark, SF).count() > 0


def test_meeting_equals_all_pairs(spark, monkeypatch):
    """With a block for each question or so, phrases with signs of patterns, and without sessions, tokens or texts."""
    asked = ["What is a.b (c)?", "define e=mc^2 | x", "alpha beta gamma", "What is beta?", "", None, "delta omega", "explain tau*"]
    rows = [(f"{s}{k}", s, t) for s in ("s", "t", None) for k, t in enumerate(asked)]
    q = retrieval.prepare_questions(spark.createDataFrame(rows, "question_id string, session_id string, question string"))
    texts = ["so a.b (c) is", "aXb (c)", "E=mc^2 | x holds", "beta", "the alphabet", "gamma alpha", "delta and more", "", None, "tau* and tau", "one two three four five six seven eight alpha beta"]
    c = spark.createDataFrame([(f"{s}{k}", s, t) for s in ("s", "t", "u", None) for k, t in enumerate(texts)], "id string, session_id string, text string")
    ready = retrieval._ready(c, F.col("text"))
    both = q.join(ready, "session_id").withColumn("score", retrieval.text_score(F.col("q_tokens"), F.col("c_tokens"), F.lit(0.1)))
    good = both.where((F.col("focus").isNull() & (F.col("score") >= 0.65) & (F.size("q_tokens") > 0)) | retrieval.holds_focus(F.col("focus"), F.col("candidate")))
    want = sorted((r.question_id, r.id) for r in good.select("question_id", "id").collect())
    assert len(want) > 8
    for most in (200_000, 2):
        monkeypatch.setattr(retrieval, "ASKED", most)
        monkeypatch.setattr(retrieval, "AT_ONCE", min(most, 200))
        assert sorted((r.question_id, r.id) for r in retrieval.meeting(q, ready, 0.65, 0.1).select("question_id", "id").collect()) == want
    assert retrieval.meeting(q.limit(0), ready, 0.65, 0.1).count() == 0


def test_space_before_a_sign_that_is_none_stays(spark):
    from lucerna.functions import text as X

    texts = ["  a  b　\t", "a \u0085", " \n ", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.s for r in df.select("k", X.strip("t").alias("s")).orderBy("k").collect()] == ["a  b", "a \u0085", "", "", None]


def test_only_matched_records_are_put_together(spark):
    from lucerna.operators import context

    matches = spark.createDataFrame([("q", 1, "material_chunk", "c1", "l", "e"), ("q", 2, "material_chunk", "gone", "l", "e")], "question_id string, rank int, source_type string, source_record_id string, label string, excerpt string")
    found = spark.createDataFrame([("material_chunk", "c1", "- one"), ("material_chunk", "c1", "- one"), ("material_chunk", "c2", "- two")], "source_type string, id string, entry string")
    out = context.focused(matches, found)
    assert "LeftSemi" in plan(out)
    assert [r.block for r in out.orderBy("order_index").collect()] == ["Focused lecture material\n- one", "Focused evidence\n- l: e"]


def test_a_task_sends_what_can_fill_the_blocks(spark):
    """Of 6,000 candidates that share a token only the best are sent on, and some that hold the focus only in their entry."""
    q = retrieval.prepare_questions(spark.createDataFrame([("q", "s", "alpha beta gamma"), ("w", "s", "What is zeta eta?")], "question_id string, session_id string, question string"))
    n = F.col("id").cast("int")
    body = F.when(n % 100 == 0, "alpha beta gamma").otherwise(F.concat(F.lit("alpha "), "id"))
    c = spark.range(0, 6000, 1, 1).select(F.lit("s").alias("session_id"), F.col("id").cast("string").alias("id"), F.lit("k").alias("source_type")).withColumn("body", body)
    c = c.withColumn("entry", F.concat(F.lit("- "), "body", F.when(n % 10 == 3, F.lit(" Zeta eta")).otherwise(""))).withColumn("c_tokens", retrieval.X.unique(retrieval.X.tokenize("body")))
    out = retrieval.filling(q, c, 0.2, 100, 300).collect()
    best = [r for r in out if r.question_id == "q"]
    assert len(best) == 60 and {(r.shared, r.near) for r in best} == {(3, 3)}  # all of the best score
    held = [r for r in out if r.question_id == "w"]
    assert retrieval.MOST_SOURCES < len(held) and all(r.in_entry and not r.in_body for r in held)
