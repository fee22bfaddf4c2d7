"""Entry points over a model's tables: ask (Q10), import (S1, M8, M10), and what can be plugged in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.operators import context, decide, mutations, retrieval
from lucerna.sources import packs


class Generator(Protocol):
    """Prompts (question_id, prompt) to (question_id, generated)."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


class Reranker(Protocol):
    """Candidates (question_id, id, title, excerpt) to (question_id, id, new_score)."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


def matches(questions: DataFrame, tables: dict[str, DataFrame], reranker: Reranker | None = None) -> DataFrame:
    """R7-R13 over the tables that are there. questions: question_id, session_id, question."""
    branches = []
    if "evidence_units" in tables:
        units = tables["evidence_units"]
        scores = None
        if reranker:
            first = retrieval.bm25(questions, units, most=retrieval.RERANKED).join(units.select("id", "title", X.excerpt("content_text", 320).alias("excerpt")), "id")
            scores = reranker(first.select("question_id", "id", "title", "excerpt"))
        branches.append(retrieval.evidence_matches(questions, units, scores))
    if "glossary_terms" in tables:
        branches.append(retrieval.glossary_matches(questions, tables["glossary_terms"]))
    for name, score in (("material_chunks", retrieval.material_matches), ("transcript_entries", retrieval.transcript_matches)):
        if name in tables:
            branches.append(score(questions, tables[name], retrieval.MOST_SOURCES))
    return retrieval.merge_matches(branches)


def ask(questions: DataFrame, tables: dict[str, DataFrame], generator: Generator | None = None, reranker: Reranker | None = None) -> tuple[DataFrame, DataFrame]:
    """Q10: answers (question_id, category_id, supported, answer, confidence) and their sources (question_id, rank, type, id).

    Without a generator the answer is put together from excerpts.
    """
    ready = retrieval.prepare_questions(questions)
    found = matches(questions, tables, reranker)
    generated = None
    if generator:
        evidence = found.where(F.col("rank") <= decide.REASONED).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))), lambda e: e["excerpt"]).alias("evidence"))
        generated = generator(questions.join(evidence, "question_id").select("question_id", context.prompt(F.col("question"), F.col("evidence")).alias("prompt")))
    answers = decide.answer(ready, found, generated)
    if "qa_categories" in tables:
        answers = answers.join(decide.categorize(questions, tables["qa_categories"]), "question_id", "left")
    sources = answers.where("supported").select("question_id", F.posexplode("sources").alias("rank", "s")).select("question_id", "rank", "s.source_type", "s.source_record_id")
    return answers.drop("sources"), sources


def import_packs(loaded: DataFrame, tables: dict[str, DataFrame], now: str) -> dict[str, DataFrame]:
    """The tables with the packs' rows in place of those of the same sessions; the packs' ids stay as they are."""
    out = {}
    for name, rows in packs.tables(loaded, now).items():
        if name not in tables:
            out[name] = rows
        elif name == "lecture_sessions":
            out[name] = mutations.upsert(tables[name].select(*rows.columns), rows, ["id"])
        else:
            out[name] = mutations.replace_session(tables[name].select(*rows.columns), rows, packs_sessions(loaded))
    return tables | out


def packs_sessions(loaded: DataFrame) -> DataFrame:
    return loaded.select(F.col("pack.session.id").alias("session_id")).distinct()
