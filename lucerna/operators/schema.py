
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of each table; ? marks one that may be null.
COLUMNS = {
    "lecture_sessions": "id title course_code lecturer description location starts_at status source_pack_version tags:list created_at updated_at",
    "lecture_materials": "id session_id title type source_label content_text order_index:int created_at updated_at",
    "material_chunks": "id session_id material_id heading text keywords:list order_index:int created_at",
    "glossary_terms": "id session_id term aliases:list definition order_index:int created_at updated_at",
    "transcript_entries": "id session_id speaker_label text started_at_seconds:double order_index:int created_at",
    "summaries": "id session_id kind title text created_at updated_at",
    "qa_categories": "id session_id key label description created_at",
    "questions": "id session_id category_id? text normalized_text status visibility origin created_at updated_at",
    "answers": "id question_id session_id text state confidence_score:double created_at",
    "answer_sources": "id answer_id session_id source_type source_record_id label excerpt relevance_score:double created_at",
    "notes": "id session_id content anchor_type anchor_id? pinned:bool created_at updated_at",
    "bookmarks": "id session_id target_type target_id label created_at",
    "uploaded_assets": "id session_id file_name media_type source_kind source_extension checksum? size_bytes?:long status error_message? created_at updated_at indexed_at?",
    "evidence_units": "id session_id asset_id source_type source_record_id? modality title excerpt content_text search_text page_number?:int slide_number?:int frame_label? timestamp_start_seconds?:double timestamp_end_seconds?:double preview_uri? metadata_json? created_at",
    "asset_digests": "id session_id asset_id? kind title text created_at updated_at",
}
#: What a column may hold.
ALLOWED = {
    ("lecture_sessions", "status"): "scheduled live ended",
    ("lecture_materials", "type"): "slide_deck handout reading code_sample",
    ("summaries", "kind"): "overview key_points exam_focus",
    ("questions", "status"): "supported unsupported",
    ("questions", "visibility"): "public private",
    ("questions", "origin"): "seed_public user_local",
    ("answers", "state"): "grounded unsupported",
    ("answer_sources", "source_type"): "glossary_term material_chunk transcript_entry evidence_unit",
    ("notes", "anchor_type"): "session lecture_material material_chunk glossary_term transcript_entry evidence_unit",
    ("bookmarks", "target_type"): "lecture_material material_chunk glossary_term transcript_entry evidence_unit",
    ("uploaded_assets", "status"): "pending processing ready failed",
    ("evidence_units", "modality"): "text image video pdf slide",
    ("asset_digests", "kind"): "asset_summary session_summary",
}
#: Keys besides id.
UNIQUE = {
    "glossary_terms": ["session_id", "term"],
    "summaries": ["session_id", "kind"],
    "qa_categories": ["session_id", "key"],
    "answers": ["question_id"],
    "bookmarks": ["session_id", "target_type", "target_id"],
    "asset_digests": ["asset_id", "kind"],
}
#: Parent tables and what a parent's deletion does to its children.
PARENTS = {
    "lecture_materials": [("session_id", "lecture_sessions", "cascade")],
    "material_chunks": [("session_id", "lecture_sessions", "cascade"), ("material_id", "lecture_materials", "cascade")],
    "glossary_terms": [("session_id", "lecture_sessions", "cascade")],
    "transcript_entries": [("session_id", "lecture_sessions", "cascade")],
    "summaries": [("session_id", "lecture_sessions", "cascade")],
    "qa_categories": [("session_id", "lecture_sessions", "cascade")],
    "questions": [("session_id", "lecture_sessions", "cascade"), ("category_id", "qa_categories", "set null")],
    "answers": [("session_id", "lecture_sessions", "cascade"), ("question_id", "questions", "cascade")],
    "answer_sources": [("session_id", "lecture_sessions", "cascade"), ("answer_id", "answers", "cascade")],
    "notes": [("session_id", "lecture_sessions", "cascade")],
    "bookmarks": [("session_id", "lecture_sessions", "cascade")],
    "uploaded_assets": [("session_id", "lecture_sessions", "cascade")],
    "evidence_units": [("session_id", "lecture_sessions", "cascade"), ("asset_id", "uploaded_assets", "cascade")],
    "asset_digests": [("session_id", "lecture_sessions", "cascade"), ("asset_id", "uploaded_assets", "cascade")],
}
_KINDS = {"": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "list": T.ArrayType(T.StringType())}


def struct(table: str) -> T.StructType:
    fields = []
    for item in COLUMNS[table].split():
        name, _, kind = item.partition(":")
        fields.append(T.StructField(name.rstrip("?"), _KINDS[kind], name.endswith("?")))
    return T.StructType(fields)


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the table, and the others with a column reason."""
    checks = [(F.col(f.name).isNull(), f"{f.name} is null") for f in struct(table) if not f.nullable]
    checks += [(F.trim(f.name) == "", f"{f.name} is empty") for f in struct(table) if not f.nullable and f.name.endswith("id")]
    checks += [(~F.col(c).isin(v.split()), f"{c} is unknown") for (t, c), v in ALLOWED.items() if t == table]
    checks += [(F.col(f.name) < 0, f"{f.name} is negative") for f in struct(table) if f.name in ("order_index", "relevance_score")]
    checks += [((F.col(f.name) < 0) | (F.col(f.name) > 1), f"{f.name} is beyond 0 to 1") for f in struct(table) if f.name == "confidence_score"]
    checks += [(F.col(f.name) < 1, f"{f.name} is under 1") for f in struct(table) if f.name in ("page_number", "slide_number")]
    reason = F.concat_ws("; ", *[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks])
    judged = df.withColumn("reason", reason)
    return judged.where("reason = ''").drop("reason"), judged.where("reason <> ''")
