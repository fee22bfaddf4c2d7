"""Lookups, ordered scans and read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.operators.retrieval import STORED_SOURCE_PRIORITY

#: The order of each table's rows; - marks a falling column, ! one with an order of its own.
ORDERS = {
    "lecture_sessions": ["-starts_at", "title", "id"],
    "lecture_materials": ["order_index", "title", "id"],
    "material_chunks": ["order_index", "id"],
    "glossary_terms": ["order_index", "term", "id"],
    "transcript_entries": ["order_index", "started_at_seconds", "id"],
    "summaries": ["!kind", "title", "id"],
    "qa_categories": ["created_at", "label", "id"],
    "questions": ["-created_at", "-id"],
    "answers": ["created_at", "id"],
    "answer_sources": ["!source_type", "-relevance_score", "created_at", "id"],
    "notes": ["-pinned", "-updated_at", "-created_at", "-id"],
    "bookmarks": ["-created_at", "target_type", "target_id", "id"],
    "uploaded_assets": ["created_at", "file_name"],
    "evidence_units": ["created_at", "id"],
    "asset_digests": ["created_at", "id"],
}
RANKS = {"kind": ["overview", "key_points", "exam_focus"], "source_type": STORED_SOURCE_PRIORITY}
DISPLAYED = 4


def rank_of(column: str) -> Column:
    """Place in a fixed order; unknown values last."""
    out = F
    for k, value in enumerate(RANKS[column]):
        out = out.when(F.col(column) == value, k)
    return out.otherwise(99)


def order_of(table: str) -> list[Column]:
    keys = []
    for k in ORDERS[table]:
        keys.append(rank_of(k[1:]) if k[0] == "!" else F.col(k[1:]).desc() if k[0] == "-" else F.col(k).asc())
    return keys


def ordered(df: DataFrame, table: str, within: str | None = None, name: str = "rank") -> DataFrame:
    """The table's order as a number, per value of `within` if one is given."""
    window = Window.partitionBy(within) if within else Window.partitionBy()
    return df.withColumn(name, F.row_number().over(window.orderBy(*order_of(table))))


def scan(df: DataFrame, table: str, **where) -> DataFrame:
    """Rows equal to all of `where` (None: is null), in the table's order."""
    for column, value in where.items():
        df = df.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return df.orderBy(*order_of(table))


def lookup(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ids (one column of the same name); no ids, no rows."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def with_known_sources(items: DataFrame, sources: str, known: DataFrame) -> DataFrame:
    """Items (id, array of ids) all of whose sources are known (id)."""
    missing = items.select("id", F.explode(sources).alias("source")).join(known.select(F.col("id").alias("source")), "source", "left_anti")
    return items.join(missing.select("id").distinct(), "id", "left_anti")


def chunks_in_order(chunks: DataFrame, materials: DataFrame) -> DataFrame:
    """Chunks with their place in the session: by material, then by place within it."""
    m = materials.select(F.col("id").alias("material_id"), F.col("order_index").alias("material_order"))
    order = Window.partitionBy("session_id").orderBy("material_order", "order_index", "id")
    return chunks.join(m, "material_id").withColumn("rank", F.row_number().over(order))


def _sources(sources: DataFrame) -> DataFrame:
    """Per answer its sources in order."""
    placed = ordered(sources, "answer_sources", "answer_id")
    row = F.struct("rank", "source_type", "source_record_id", "label", "excerpt", "relevance_score")
    return placed.groupBy("answer_id").agg(F.array_sort(F.collect_list(row)).alias("sources"))


def _with_answers(questions: DataFrame, answers: DataFrame, sources: DataFrame, how: str) -> DataFrame:
    a = answers.select(F.col("id").alias("answer_id"), F.col("question_id").alias("id"), F.col("text").alias("answer"), "state", "confidence_score")
    empty = F.array().cast("array<struct<rank:int,source_type:string,source_record_id:string,label:string,excerpt:string,relevance_score:double>>")
    return questions.join(a, "id", how).join(_sources(sources), "answer_id", "left").withColumn("sources", F.coalesce("sources", empty))


def community_feed(questions: DataFrame, answers: DataFrame, sources: DataFrame, categories: DataFrame) -> DataFrame:
    """Public questions with their answer, its sources and the category, where there are any."""
    full = _with_answers(questions.where("visibility = 'public'"), answers, sources, "left")
    named = full.join(categories.select(F.col("id").alias("category_id"), F.col("label").alias("category")), "category_id", "left")
    return ordered(named, "questions", "session_id")


def question_history(questions: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """The user's own questions that have an answer."""
    return ordered(_with_answers(questions.where("origin = 'user_local'"), answers, sources, "inner"), "questions", "session_id")


def counts(sessions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """A2: per session the number of rows in each table, 0 where there are none. Each table shrinks before the join."""
    out = sessions.select(F.col("id").alias("session_id"))
    for name, df in tables.items():
        out = out.join(df.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "left")
    return out.fillna(0, list(tables))


def latest(entries: DataFrame, most: int = DISPLAYED) -> DataFrame:
    """Per session its last entries, in order."""
    down = Window.partitionBy("session_id").orderBy(F.desc("order_index"), F.desc("started_at_seconds"), F.desc("id"))
    return entries.withColumn("from_end", F.row_number().over(down)).where(F.col("from_end") <= most)


def overview(sessions: DataFrame, tables: dict[str, DataFrame], entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Q3: a session with its counts, latest entries and summaries."""
    last = latest(entries).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text"))), lambda e: e["text"]).alias("latest"))
    told = summaries.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(rank_of("kind").alias("rank"), "kind", "text"))).alias("summaries"))
    s = sessions.select(F.col("id").alias("session_id"), "title", "status", "starts_at")
    return s.join(counts(sessions, tables), "session_id").join(last, "session_id", "left").join(told, "session_id", "left")


def workspaces(sessions: DataFrame, materials: DataFrame, assets: DataFrame) -> DataFrame:
    """Per session its files (uploads, then materials' labels, each once) and the state of its uploads."""
    up = assets.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("created_at", "file_name"))), lambda a: a["file_name"]).alias("files"), *status_counts()
    )
    own = materials.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("order_index", "title", "source_label"))), lambda m: m["source_label"]).alias("labels"), F.count("*").alias("n_materials")
    )
    none = F.array().cast("array<string>")
    joined = sessions.select(F.col("id").alias("session_id"), "title").join(up, "session_id", "left").join(own, "session_id", "left")
    every = joined.withColumn("files", F.array_distinct(F.concat(F.coalesce("files", none), F.coalesce("labels", none)))).drop("labels")
    return every.fillna(0, ["n_materials", "ready", "processing", "failed", "assets"]).fillna(False, ["in_flight"])


def status_counts() -> list[Column]:
    """A3, A4: aggregates over uploads."""
    waiting = F.col("status").isin("pending", "processing")
    return [
        F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(waiting).alias("processing"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count("*").alias("assets"), F.bool_or(waiting).alias("in_flight"),
    ]


def indexing_summary(assets: DataFrame) -> DataFrame:
    """Q9."""
    return assets.groupBy("session_id").agg(*status_counts())


def workspace_text(spaces: DataFrame) -> DataFrame:
    """Q12: what a workspace's line says."""
    n = F.col("assets")
    said = F.when(n == 0, "No uploads yet").when(F.col("ready") == n, F.format_string("%d sources indexed", n)).otherwise(F.format_string("%d of %d sources indexed", F.col("ready"), n))
    return spaces.withColumn("subtitle", F.format_string("%d materials", F.col("n_materials"))).withColumn("indexed_text", said)


def evidence_dim(materials: DataFrame, chunks: DataFrame, terms: DataFrame, entries: DataFrame, units: DataFrame) -> DataFrame:
    """What a note, a bookmark or a source can point at: (type, id, label, text, parent_id)."""
    pick = lambda df, kind, label, text, parent: df.select(F.lit(kind).alias("type"), F.col("id"), label.alias("label"), text.alias("text"), parent.alias("parent_id"))
    none = F.lit(None).cast("string")
    parts = [
        pick(materials, "lecture_material", F.col("title"), F.col("content_text"), none),
        pick(chunks, "material_chunk", F.col("heading"), F.col("text"), F.col("material_id")),
        pick(terms, "glossary_term", F.col("term"), F.col("definition"), none),
        pick(entries, "transcript_entry", F.col("speaker_label"), F.col("text"), none),
        pick(units, "evidence_unit", F.col("title"), F.col("content_text"), F.col("asset_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What stands for an anchor that isn't found.
DEFAULT_LABELS = {"session": "Session note", "lecture_material": "Lecture material", "material_chunk": "Material section", "glossary_term": "Glossary term", "transcript_entry": "Transcript", "evidence_unit": "Indexed evidence"}


def notes_with_labels(notes: DataFrame, dim: DataFrame) -> DataFrame:
    """Notes with the label of what they are anchored to."""
    found = dim.select(F.col("type").alias("anchor_type"), F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"))
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_LABELS.items() for x in kv])
    joined = notes.join(found, ["anchor_type", "anchor_id"], "left")
    return ordered(joined.withColumn("anchor_label", F.coalesce("anchor_label", F.try_element_at(default, F.col("anchor_type")))), "notes", "session_id")


def source_detail(sources: DataFrame, dim: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Sources with what they point at, its parent's label, and whether it is bookmarked; dangling ones drop out."""
    found = dim.select(F.col("type").alias("source_type"), F.col("id").alias("source_record_id"), F.col("label").alias("record_label"), "text", "parent_id")
    parents = dim.select(F.col("id").alias("parent_id"), F.col("label").alias("parent_label")).where("type = 'lecture_material'")
    marked = bookmarks.select("session_id", F.col("target_type").alias("source_type"), F.col("target_id").alias("source_record_id"), F.lit(True).alias("bookmarked")).distinct()
    joined = sources.join(found, ["source_type", "source_record_id"]).join(parents, "parent_id", "left").join(marked, ["session_id", "source_type", "source_record_id"], "left")
    return joined.withColumn("bookmarked", F.coalesce("bookmarked", F.lit(False)))


def materials_snapshot(materials: DataFrame, chunks: DataFrame, terms: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Q7: per session its materials, chunks, terms and bookmarks as ordered lists."""
    lists = [(materials, "lecture_materials", "title"), (chunks, "material_chunks", "heading"), (terms, "glossary_terms", "term"), (bookmarks, "bookmarks", "label")]
    out = None
    for df, table, column in lists:
        rows = F.array_sort(F.collect_list(F.struct("rank", F.col(column).alias("value"))))
        part = ordered(df, table, "session_id").groupBy("session_id").agg(F.transform(rows, lambda r: r["value"]).alias(table))
        out = part if out is None else out.join(part, "session_id", "full_outer")
    return out


def previews(detail: DataFrame, units: DataFrame) -> DataFrame:
    """Q8: sources that are units with a preview, and what is known about these in one string."""
    u = units.where("preview_uri is not null").select(F.col("id").alias("source_record_id"), "preview_uri", "modality", "page_number", "slide_number", "frame_label")
    about = F.concat_ws(" | ", "modality", F.concat(F.lit("page "), F.col("page_number").cast("string")), F.concat(F.lit("slide "), F.col("slide_number").cast("string")), "frame_label")
    return detail.where("source_type = 'evidence_unit'").join(u, "source_record_id").withColumn("about", about)
