"""Whether a question is supported, its category and its answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.operators.retrieval import SUPPORT, holds_focus
from lucerna.sources.tables import settle

#: Words that put a question into a category; a word counts inside other words too.
CATEGORY_WORDS = {
    "exam_prep": ["exam", "quiz", "test", "assessment", "revision"],
    "applications": ["apply", "example", "use", "practical", "implementation"],
    "logistics": ["when", "where", "schedule", "deadline", "location"],
    "concepts": ["what", "why", "define", "meaning", "concept", "grounding"],
}
#: What is said where the evidence is not enough.
UNSUPPORTED = (
    "This question is not supported by the current on-device lecture pack. "
    "Ask about the glossary, lecture materials, or transcript loaded into this session."
)
TRACEABLE, REASONED, TOP = 6, 12, 3


def categorize(questions: DataFrame, categories: DataFrame) -> DataFrame:
    """question_id, category_id: the first category of the session with a word in the question, else the first one."""
    words = F.create_map(*[x for k, v in CATEGORY_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    both = questions.join(categories.select("session_id", F.col("id").alias("category_id"), "key", "created_at", "label"), "session_id")
    q = X.normalize("question")
    hit = F.coalesce(F.exists(F.try_element_at(words, F.col("key")), lambda w: F.contains(q, w)), F.lit(False))
    best = both.groupBy("question_id").agg(F.min_by("category_id", F.struct(~hit, "created_at", "label", "category_id")).alias("category_id"))
    return questions.select("question_id").join(best, "question_id", "left")


def support(questions: DataFrame, matches: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """Per question the figures of its first three matches, supported and reason. matches: with rank."""
    top = matches.where(F.col("rank") <= TOP)
    focused = holds_focus(F.col("focus"), F.concat_ws(" ", "label", "excerpt"))
    figures = top.groupBy("question_id").agg(
        F.max("score").alias("strongest"), F.avg("score").alias("average"), F.sum("score").alias("total"), F.count_if(focused).alias("focused"), F.count_distinct("source_type").alias("kinds")
    )
    asked = questions.select("question_id", F.col("focus").isNotNull().alias("definition"))
    joined = asked.join(figures, "question_id", "left").fillna(0, ["strongest", "average", "total", "focused", "kinds"])
    yes = (
        (F.col("strongest") >= threshold)
        | ((F.col("focused") >= 1) & (F.col("strongest") >= threshold - 0.15))
        | ((F.col("focused") >= 2) & (F.col("average") >= threshold - 0.2))
        | (~F.col("definition") & (F.col("kinds") >= 2) & (F.col("total") >= threshold * 2.15))
    )
    return joined.withColumn("supported", yes).withColumn("reason", F.when(F.col("supported"), "grounded evidence found").otherwise("not enough grounded evidence"))


def definition_answer(matches: DataFrame) -> DataFrame:
    """C4: question_id, definition: of the glossary term that is the focus, else of the first match that holds it."""
    exact = (F.col("source_type") == "glossary_term") & (X.normalize(X.label_name("label")) == F.col("focus"))
    holds = holds_focus(F.col("focus"), F.concat_ws(" ", "label", "excerpt"))
    tier = F.when(exact, 0).when(holds, 1)
    return matches.withColumn("tier", tier).where("tier is not null").groupBy("question_id").agg(X.sentence(F.min_by("excerpt", F.struct("tier", "rank"))).alias("definition"))


def extract(matches: DataFrame, most: int = 2) -> DataFrame:
    """question_id, generated: excerpts of the first matches, what stands in for a language model."""
    order = Window.partitionBy("question_id").orderBy("rank")
    some = matches.where(X.strip("excerpt") != "").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("n", X.excerpt("excerpt", 140).alias("x"))))
    return some.groupBy("question_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), " ").alias("generated"))


def answer(questions: DataFrame, matches: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """question_id, supported, answer, confidence, sources (at most TRACEABLE, in order).

    generated: question_id, generated; by default C7.
    """
    matches = settle(matches)  # read by four consumers
    said = generated if generated is not None else extract(matches)
    checked = support(questions, matches).select("question_id", "supported")
    traced = matches.where(F.col("rank") <= TRACEABLE).groupBy("question_id").agg(
        F.avg("score").alias("average"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_type", "source_record_id"))), lambda s: F.struct(s["source_type"], s["source_record_id"])).alias("sources")
    )
    joined = checked.join(traced, "question_id", "left").join(said, "question_id", "left").join(definition_answer(matches), "question_id", "left")
    text = F.when((F.coalesce(F.trim("generated"), F.lit("")) == "") | X.is_refusal("generated"), F.col("definition")).otherwise(X.first_paragraphs(X.first_sentences("generated")))
    ok = F.col("supported") & F.col("sources").isNotNull() & F.col("text").isNotNull()
    return (
        joined.withColumn("text", text)
        .withColumn("supported", ok)
        .select(
            "question_id", "supported", F.when(ok, F.col("text")).otherwise(UNSUPPORTED).alias("answer"),
            F.when(ok, X.confidence("average")).otherwise(0.0).alias("confidence"), F.when(ok, F.size("sources")).otherwise(0).alias("n_sources"), F.when(ok, F.col("sources")).alias("sources"),
        )
    )
