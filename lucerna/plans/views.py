"""Lecture-shaped views over the driver's tables. Each has the same definition as SQL in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.operators.search_index import Index, built, is_there

SESSIONS = 20
#: The indexes built so far, by application and folder: one serves all queries of a session.
_INDEXES: dict[tuple[str, str], Index] = {}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sessions(self) -> DataFrame:
        d = self.table("documents").groupBy("source").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        return d.select(
            F.col("source").alias("id"), F.concat(F.lit("Session "), F.upper("source")).alias("title"), F.concat(F.lit("2024-01-"), F.lpad((F.col("first") % 28 + 1).cast("string"), 2, "0")).alias("starts_at"),
            F.when(F.col("first") % 3 == 0, "live").when(F.col("first") % 3 == 1, "ended").otherwise("scheduled").alias("status"),
        )

    def materials(self) -> DataFrame:
        d = self.table("documents")
        kind = F.when(F.col("doc_id") % 4 == 0, "slides").when(F.col("doc_id") % 4 == 1, "handout").when(F.col("doc_id") % 4 == 2, "code_example").otherwise("reading")
        return d.select(
            F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("session_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
            F.concat(kind, F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_label"), X.excerpt("text", 220).alias("content_text"), F.col("doc_id").alias("order_index"),
        )

    def chunks(self) -> DataFrame:
        """A chunk for each line of a document that isn't blank."""
        d = self.table("documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.trim("line") != "")
        material = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
        return d.select(
            F.concat(material, F.lit("_"), F.col("n").cast("string")).alias("id"), F.col("source").alias("session_id"), material.alias("material_id"),
            F.concat(F.lit("Part "), (F.col("n") + 1).cast("string")).alias("heading"), F.array("lang").alias("keywords"), F.col("line").alias("text"), (F.col("doc_id") * 10000 + F.col("n")).alias("order_index"),
        )

    def glossary(self) -> DataFrame:
        b = self.table("benchmark")
        words = F.split("text", " ")
        return b.select(
            F.concat(F.lit("term"), F.col("item_id").cast("string")).alias("id"), F.concat(F.lit("src"), (F.col("item_id") % SESSIONS).cast("string")).alias("session_id"),
            F.array_join(F.slice(words, 1, 2), " ").alias("term"), F.slice(words, 3, 1).alias("aliases"), F.col("text").alias("definition"), F.col("item_id").alias("order_index"),
        )

    def transcript(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(
            F.concat_ws("_", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("src"), (F.col("conv_id") % SESSIONS).cast("string")).alias("session_id"),
            F.col("role").alias("speaker_label"), "text", (F.col("turn") * 30).alias("started_at_seconds"), (F.col("conv_id") * 1000 + F.col("turn")).alias("order_index"),
        )

    def questions(self) -> DataFrame:
        """Each benchmark passage as a question, and one for what its term is."""
        g = self.glossary()
        plain = g.select(F.concat(F.lit("q"), F.col("order_index").cast("string")).alias("question_id"), "session_id", F.col("definition").alias("question"))
        asked = g.select(F.concat(F.lit("w"), F.col("order_index").cast("string")).alias("question_id"), "session_id", F.concat(F.lit("What is "), F.col("term"), F.lit("?")).alias("question"))
        return plain.union(asked)

    def categories(self) -> DataFrame:
        rows = [(k, n) for n, k in enumerate(["exam_prep", "applications", "logistics", "concepts"])]
        keys = self.spark.createDataFrame(rows, "key string, n int")
        s = self.questions().select("session_id").distinct()
        return s.crossJoin(F.broadcast(keys)).select(F.concat_ws("_", "session_id", "key").alias("id"), "session_id", "key", F.col("key").alias("label"), F.col("n").cast("string").alias("created_at"))

    def qa(self) -> dict[str, DataFrame]:
        """Questions, answers and sources made from labelled documents."""
        labelled = self.table("labels").join(self.table("documents").select("doc_id", "source", "lang", "text"), "doc_id")
        n = F.col("doc_id").cast("string")
        questions = labelled.select(
            F.concat(F.lit("q"), n).alias("id"), F.col("source").alias("session_id"), F.col("lang").alias("category_id"), "text",
            F.when(F.col("toxic") == 1, "private").otherwise("public").alias("visibility"), F.when(F.col("doc_id") % 2 == 0, "seed_public").otherwise("user_local").alias("origin"), F.lpad(n, 12, "0").alias("created_at"),
        )
        answers = labelled.where("quality = 1").select(
            F.concat(F.lit("a"), n).alias("id"), F.concat(F.lit("q"), n).alias("question_id"), F.col("source").alias("session_id"), "text",
            F.lit("grounded").alias("state"), F.round((F.col("doc_id") % 100) / 100, 2).alias("confidence_score"), F.lpad(n, 12, "0").alias("created_at"),
        )
        kinds = F.array(*map(F.lit, ["glossary_term", "material_chunk", "transcript_entry"]))
        sources = labelled.where("quality = 1").select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("k")).select(
            F.concat_ws("_", F.lit("s"), F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("answer_id"), F.col("source").alias("session_id"),
            F.element_at(kinds, ((F.col("doc_id") + F.col("k")) % 3 + 1).cast("int")).alias("source_type"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_0")).alias("source_record_id"),
            F.concat(F.lit("label "), F.col("k").cast("string")).alias("label"), F.lit("excerpt").alias("excerpt"), ((F.col("doc_id") * 7 + F.col("k") * 3) % 10).cast("double").alias("relevance_score"), F.lpad(F.col("k").cast("string"), 2, "0").alias("created_at"),
        )
        langs = self.table("documents").select(F.col("lang").alias("id")).distinct().withColumn("label", F.concat(F.lit("Language "), F.col("id")))
        return {"questions": questions, "answers": answers, "sources": sources, "categories": langs}

    def assets(self) -> DataFrame:
        """Documents as uploads: the file name and state follow from doc_id."""
        ext = F.array(*map(F.lit, ["txt", "md", "csv", "pdf", "pptx", "docx", "png", "mp4", "zip"]))
        stem = F.array(*map(F.lit, ["lecture_notes", "glossary-terms", "transcript 1", "Course_Summary", "public_qa", "slide_deck", "code-example", "handout"]))
        states = F.array(*map(F.lit, ["ready", "pending", "processing", "failed", "ready"]))
        pick = lambda a, n: F.element_at(a, (F.col("doc_id") % n + 1).cast("int"))
        name = F.concat(pick(stem, 8), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), pick(ext, 9))
        return self.table("documents").select(
            F.col("doc_id").cast("string").alias("asset_id"), F.col("source").alias("session_id"), name.alias("name"), pick(states, 5).alias("status"), "doc_id", "n_chars", "text", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("created_at")
        )

    def units(self) -> DataFrame:
        """Chunks as indexed evidence."""
        c = self.chunks()
        return c.select(
            "id", "session_id", F.col("material_id").alias("asset_id"), F.when(F.col("order_index") % 5 == 0, "pdf").otherwise("text").alias("modality"), F.concat_ws(" ", "material_id", "heading").alias("title"),
            X.excerpt("text", 240).alias("excerpt"), F.col("text").alias("content_text"), F.lower("text").alias("search_text"), "order_index",
        )

    def index(self) -> Index:
        """The search index of the units, built once, and anew if its tables have been cleared."""
        key = (self.spark.sparkContext.applicationId, self.dir)
        if key not in _INDEXES or not is_there(_INDEXES[key]):
            _INDEXES[key] = built(self.units())
        return _INDEXES[key]
