"""One query for each operator of the blueprint, over whole tables; oracles.py has the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.operators import context, decide, mutations, parse, reads, retrieval, search_index
from lucerna.plans import api
from lucerna.plans.views import Views
from lucerna.sources import assembly, files, packs
from lucerna.sources.tables import folder_between, settle
from lucerna.streaming import index as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


# --- text functions


@query
def F1_F4_F10_normalize_excerpt(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(X.normalize("text")).alias("normalized"), X.excerpt("text", 180).alias("excerpt"), F.md5(X.collapse("text")).alias("collapsed"))


@query
def F2_F3_tokens(v: Views) -> DataFrame:
    t = v.table("conversations").withColumn("tokens", X.tokenize("text"))
    return t.select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"), F.size(X.unique("tokens")).cast("long").alias("n_distinct"))


@query
def F5_F7_F9_ids_titles(v: Views) -> DataFrame:
    a = v.assets()
    return a.select("asset_id", X.slug("name").alias("slug"), X.build_id("material", F.col("name"), F.col("doc_id") % 3).alias("built"), X.scoped_id("session_id", "asset_id").alias("scoped"), X.display_title(X.base_name("name")).alias("title"))


@query
def F8_F37_digests(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", X.checksum("html").alias("checksum"), X.stable_id("page_id", "url").alias("stable"))


@query
def F11_F12_W8_clock(v: Views) -> DataFrame:
    t = v.table("conversations").withColumn("clock", X.clock(F.col("conv_id") * 30 + F.col("turn")))
    return t.select("conv_id", "turn", "clock", X.clock_seconds("clock").alias("seconds"))


@query
def F13_T11_transcript_lines(v: Views) -> DataFrame:
    lines = v.table("conversations").select("conv_id", "turn", F.concat(F.lit("["), X.clock(F.col("turn") * 75), F.lit("] "), F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    t = X.transcript_line("line", F.col("turn"))
    return lines.select("conv_id", "turn", t["speaker"].alias("speaker"), F.md5(t["text"]).alias("text"), t["started_at"].alias("started_at"))


@query
def F14_F15_F22_split(v: Views) -> DataFrame:
    b = v.table("benchmark").withColumn("line", F.concat(F.lit(" Item "), F.col("item_id").cast("string"), F.lit(" : a; b ,"), F.col("text")))
    kv = X.key_value("line")
    return b.select("item_id", kv["key"].alias("key"), F.md5(kv["value"]).alias("value"), F.size(X.delimited("line")).cast("long").alias("parts"), F.array_join(X.keywords("text"), " ").alias("keywords"))


@query
def F16_F20_classify(v: Views) -> DataFrame:
    a = v.assets().withColumn("extension", X.extension("name")).withColumn("base", X.base_name("name"))
    return a.select("asset_id", "extension", "base", X.file_kind("base").alias("kind"), X.extension_error("extension").alias("error"), X.material_type("base", "extension").alias("type"), X.modality("extension").alias("modality"))


@query
def F21_summary_kind(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", X.summary_kind("text").alias("kind"))


@query
def F23_F25_F26_F27_numbers(v: Views) -> DataFrame:
    x = F.col("l_extendedprice").cast("decimal(20,4)")  # doubles would sum to a little less than a whole number in some orders of the rows
    return v.table("lineitem").groupBy("l_orderkey").agg(F.avg(F.col("l_quantity").cast("double")).alias("q"), F.sum(x).cast("double").alias("p")).select(
        "l_orderkey", X.clamp(X.rounded(F.col("q") / 40, 3), 0.0, 1.0, 0.7).alias("clamped"), X.confidence(X.rounded(F.col("q") / 10, 1)).alias("confidence"), X.gigabytes(F.floor(F.col("p")) * 100000).alias("gigabytes")
    )


@query
def F24_string_list(v: Views) -> DataFrame:
    j = v.table("events").select("event_id", F.concat(F.lit('["'), F.col("event_type"), F.lit('", 1, null, "x", {"a": "b"}]')).alias("json"))
    return j.select("event_id", F.array_join(X.string_list("json"), "|").alias("strings"))


@query
def F28_F29_F34_sentences(v: Views) -> DataFrame:
    b = v.table("benchmark").withColumn("words", F.slice(F.split("text", " "), F.lit(1), (F.col("item_id") % 4).cast("int")))
    return b.select("item_id", X.spoken_list("words").alias("spoken"), X.sentence("text").alias("sentence"), X.without_end_marks("text").alias("bare"), X.lower_first("text").alias("lowered"), X.first_sentences("text", 1).alias("first"))


@query
def F31_F33_F35_markup(v: Views) -> DataFrame:
    p = v.table("pages")
    return p.select("page_id", X.embedded_json(F.concat(F.lit("say {\"id\": "), F.col("page_id").cast("string"), F.lit("} now"))).alias("json"), X.is_refusal(F.when(F.col("page_id") % 2 == 0, " Unsupported. ").otherwise("yes")).alias("refusal"), F.size(X.tag_runs("html", "p")).cast("long").alias("runs"), F.md5(X.xml_decode(F.element_at(X.tag_runs("html", "h1"), 1))).alias("heading"))


@query
def F36_F38_labels(v: Views) -> DataFrame:
    n = F.col("doc_id")
    d = v.table("documents").select("doc_id", "lang", F.when(n % 3 == 0, n).alias("page"), F.when(n % 3 == 1, n).alias("slide"), F.when(n % 2 == 0, n * 10).alias("start"), F.when(n % 4 == 0, n * 10 + 5).alias("end"))
    named = X.label("Material", "lang")
    return d.select("doc_id", named.alias("label"), X.label_name(named).alias("name"), X.location("page", "slide", "start", "end").alias("location"))


@query
def G1_G5_glossary_rules(v: Views) -> DataFrame:
    c = v.chunks().select("id", F.split("text", r"\. ")[0].alias("term"), F.col("text").alias("definition"))
    return c.select("id", X.is_term("term").alias("is_term"), X.is_definition("definition").alias("is_definition"), X.is_ignored_entry("term", "definition").alias("ignored"), X.keeps_term("term").alias("keeps"))


# --- parsing


@query
def T1_paragraphs(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", F.regexp_replace("text", "\n", "\n \n").alias("text"))
    return parse.exploded(d, parse.paragraphs(F.col("text")), ["doc_id"])


@query
def T2_passages(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", "text")
    return parse.exploded(d, parse.passages(F.col("text")), ["doc_id"]).withColumn("heading", F.concat(F.lit("Passage "), (F.col("order_index") + 1).cast("string")))


@query
def T3_T13_markdown(v: Views) -> DataFrame:
    d = v.table("conversations").select("conv_id", "turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("text")).alias("line"))
    md = d.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    out = parse.markdown_sections(md, ["conv_id"])
    return out.select("conv_id", "order_index", "heading", F.md5("text").alias("text"), X.summary_kind("heading").alias("kind"))


@query
def T4_material_chunks(v: Views) -> DataFrame:
    a = v.assets().select("asset_id", "name", X.base_name("name").alias("base_name"), X.extension("name").alias("extension"), "text")
    return parse.material_chunks(a).withColumns({"text": F.md5("text"), "keywords": F.array_join("keywords", " ")})


@query
def T5_T9_glossary(v: Views) -> DataFrame:
    d = v.table("benchmark").select(F.floor(F.col("item_id") / 10).alias("doc"), "item_id", F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2)).alias("term"), "text")
    packs = d.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", F.concat_ws(": ", "term", "text").alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return parse.glossary(packs, ["doc"]).withColumn("aliases", F.array_join("aliases", ","))


@query
def T12_categories(v: Views) -> DataFrame:
    d = v.table("customer").select(F.floor(F.col("c_custkey") / 20).alias("asset_id"), "c_custkey", F.concat_ws(": ", "c_name", "c_mktsegment").alias("line"))
    packs = d.groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return parse.categories(packs)


@query
def T15_A16_metadata(v: Views) -> DataFrame:
    d = v.table("orders").select(F.col("o_custkey").alias("asset_id"), "o_orderkey", F.concat_ws(": ", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("line"))
    packs = d.groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return parse.metadata(packs).select("asset_id", *[F.try_element_at("record", F.lit(k)).alias(k) for k in "fop"])


@query
def T10_columns(v: Views) -> DataFrame:
    """Two lines of each document as the halves of a page, with a page number, put in order."""
    line = lambda n: F.trim(F.substring(F.regexp_replace(F.coalesce(F.get(F.split("text", "\n"), F.lit(n)), F.lit("")), r"\s+", " "), 1, 50))
    d = v.table("documents").select("doc_id", line(0).alias("a"), line(1).alias("b"), F.col("text").alias("whole"))
    row = lambda left, right: F.concat(F.rpad(left, 60, " "), right)
    page = F.concat_ws("\n", row(F.concat(F.lit("l "), "a"), F.concat(F.lit("r "), "b")), F.lit("12"), row(F.concat(F.lit("m "), "b"), F.concat(F.lit("s "), "a")))
    return d.select("doc_id", parse.columns_in_order(F.concat_ws("\f", page, F.regexp_replace("whole", r"[\s]+", " "))).alias("t")).select("doc_id", F.md5("t").alias("text"))


def _raw_files(v: Views) -> DataFrame:
    """Each document as an upload: its text as CSV of one chunk and as a transcript, a glossary, and for some a session file, categories and questions."""
    n = F.col("doc_id").cast("string")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    asked = F.concat(F.lit('[{"questionText": "What is '), n, F.lit('?", "categoryKey": "'), F.when(F.col("doc_id") % 4 == 0, "concepts").otherwise("lang"), F.lit('", "answer": {"text": "It is.", "sources": [{"sourceType": "glossary_term", "sourceId": "glossary_term_'), n, F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""), F.lit('"}]}}]'))
    parts = [
        (F.lit(True), F.concat(F.lit("notes_"), n), "csv", "material", F.concat(F.lit("Heading,Text\nPart 1,"), quoted)),
        (F.lit(True), F.lit("terms"), "csv", "glossary", F.concat(F.lit("term,definition\nTerm "), n, F.lit(","), F.coalesce("lang", F.lit("none")))),
        (F.lit(True), F.concat(F.lit("said_"), n), "txt", "transcript", F.concat(F.lit("[01:05] Dr. X: "), F.coalesce("text", F.lit("")))),
        (F.col("doc_id") % 3 == 0, F.lit("session"), "json", "session", F.concat(F.lit('{"title": "Course '), n, F.lit('", "tags": ["x", "uploaded"], "status": "ended"}'))),
        (F.col("doc_id") % 2 == 0, F.lit("categories"), "txt", "categories", F.concat(F.lit("Concepts: c\nLang: "), F.coalesce("lang", F.lit("none")))),
        (F.lit(True), F.lit("publicqa"), "json", "public_qa", asked),
    ]
    one = lambda k, f: F.when(f[0], F.struct(F.lit(k).alias("position"), F.concat_ws(".", f[1], F.lit(f[2])).alias("name"), f[1].alias("base_name"), F.lit(f[2]).alias("extension"), F.lit(f[3]).alias("kind"), f[4].alias("text")))
    each = v.table("documents").select(n.alias("upload"), F.explode(F.array_compact(F.array(*[one(k, f) for k, f in enumerate(parts)]))).alias("f"))
    return each.select("upload", "f.*")


@query
def T21_T17_J14_assembly(v: Views) -> DataFrame:
    t = assembly.assemble(_raw_files(v), "2024-01-01", "upload")
    told = {
        "lecture_sessions": F.concat_ws("|", "title", "status", F.array_join("tags", ","), "description"), "lecture_materials": F.concat_ws("|", "title", "type", "source_label"), "material_chunks": F.concat_ws("|", "material_id", F.md5("text")),
        "glossary_terms": F.concat_ws("|", "term", "definition"), "transcript_entries": F.concat_ws("|", "speaker_label", F.md5("text"), F.col("started_at_seconds").cast("int").cast("string")), "qa_categories": F.concat_ws("|", "key", "description"),
        "questions": F.concat_ws("|", "category_id", "text"), "answers": F.concat_ws("|", "question_id", "text"), "answer_sources": F.concat_ws("|", "source_record_id", "label", "excerpt"),
    }
    every = [t[name].select(F.lit(name).alias("name"), "id", F.col("id" if name == "lecture_sessions" else "session_id").alias("session_id"), value.alias("told")) for name, value in told.items()]
    return reduce(DataFrame.unionByName, every)


@query
def T16_materials(v: Views) -> DataFrame:
    a = v.assets().select("session_id", "asset_id", F.col("doc_id").alias("position"), X.base_name("name").alias("base_name"), X.extension("name").alias("extension"), "text")
    return parse.materials(a)


@query
def T18_T19_units(v: Views) -> DataFrame:
    """Each line of a document as a paragraph."""
    u = parse.evidence_units(v.assets().select("asset_id", "session_id", "name", X.extension("name").alias("extension"), F.regexp_replace("text", "\n", "\n\n").alias("text")))
    return u.withColumns({"content_text": F.md5("content_text"), "search_text": F.md5("search_text")})


# --- retrieval and decisions


def _glossary(v: Views) -> DataFrame:
    return retrieval.glossary_matches(v.questions(), v.glossary())


def _materials(v: Views, most: int | None = None) -> DataFrame:
    return retrieval.material_matches(v.questions(), v.chunks(), most)


def _transcripts(v: Views, most: int | None = None) -> DataFrame:
    return retrieval.transcript_matches(v.questions(), v.transcript(), most)


def _matches(v: Views) -> list[DataFrame]:
    return [_glossary(v), _materials(v, retrieval.MOST_SOURCES), _transcripts(v, retrieval.MOST_SOURCES), retrieval.evidence_matches(v.questions(), v.units(), index=v.index())]


def _short(matches: DataFrame) -> DataFrame:
    return matches.select("question_id", "source_type", "source_record_id", "label", "score")


@query
def R4_R6_focus(v: Views) -> DataFrame:
    q = retrieval.prepare_questions(v.questions())
    other = F.concat_ws(" ", F.lit("About"), F.col("focus"))
    return q.select("question_id", "focus", retrieval.focus_boost(F.col("focus"), other).alias("boost"), F.size("q_tokens").cast("long").alias("n_tokens"))


@query
def R1_R2_R3_R7_glossary(v: Views) -> DataFrame:
    return _short(_glossary(v))


@query
def R8_J18_materials(v: Views) -> DataFrame:
    return _short(_materials(v))


@query
def R8_transcripts(v: Views) -> DataFrame:
    return _short(_transcripts(v))


@query
def R13_O15_L2_top_matches(v: Views) -> DataFrame:
    return retrieval.merge_matches(_matches(v)).select("question_id", "source_type", "source_record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def R9_R10_J2_bm25(v: Views) -> DataFrame:
    found = retrieval.bm25(v.questions(), v.units(), most=None, index=v.index())
    return found.select("question_id", "id", F.round("rank", 6).alias("rank"))


def _versions(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The units of three writes: all assets, then every third with its text in reverse order of words, and the assets deleted last."""
    units = v.units()
    turned = F.array_join(F.reverse(F.split("content_text", " ")), " ")
    number = F.regexp_extract("asset_id", "([0-9]+)$", 1).cast("long")
    again = units.where(number % 3 == 0).withColumns({"content_text": turned, "search_text": F.lit(""), "excerpt": F.lit("")})
    gone = units.where(number % 7 == 0).select("asset_id").distinct()
    return units, again, gone


@query
def R10_ST5_living_index(v: Views) -> DataFrame:
    """The first 18 units of each question by an index of three segments: all units, a third of the assets written again, a seventh deleted."""
    units, again, gone = _versions(v)
    root = f"{folder_between(v.spark)}/index-{uuid.uuid4().hex}"
    search_index.write_segment(root, 0, units, units.select("asset_id", F.lit(False).alias("deleted")))
    search_index.write_segment(root, 1, again, again.select("asset_id", F.lit(False).alias("deleted")))
    search_index.delete_assets(root, gone)
    found = search_index.search(v.questions(), search_index.load(v.spark, root), retrieval.MOST_SOURCES)
    return found.select("question_id", "id", F.round("rank", 6).alias("rank"), F.col("place").cast("long").alias("place"))


@query
def R11_R12_J17_evidence(v: Views) -> DataFrame:
    q, units = v.questions(), v.units()
    again = retrieval.bm25(q, units, most=retrieval.RERANKED, index=v.index()).select("question_id", "id", (F.lit(20.0) - F.col("place")).alias("new_score"))
    return _short(retrieval.evidence_matches(q, units, again, v.index())).withColumn("score", F.round("score", 6))


@query
def R14_O18_lexical(v: Views) -> DataFrame:
    c = v.transcript().select("id", "session_id", F.col("speaker_label").alias("label"), "text", F.when(F.col("speaker_label") == "system", 1.0).otherwise(0.0).alias("priority"), "order_index")
    return retrieval.lexical(v.questions(), c).select("question_id", "id", "label", "score", F.col("rank").cast("long").alias("rank"))


@query
def C1_D15_categorize(v: Views) -> DataFrame:
    return decide.categorize(v.questions(), v.categories())


@query
def C2_C3_A5_A8_support(v: Views) -> DataFrame:
    s = decide.support(retrieval.prepare_questions(v.questions()), retrieval.merge_matches(_matches(v)))
    return s.select("question_id", F.round("strongest", 6).alias("strongest"), F.round("average", 6).alias("average"), F.col("focused").cast("long").alias("focused"), F.col("kinds").cast("long").alias("kinds"), "supported", "reason")


@query
def C4_definitions(v: Views) -> DataFrame:
    return decide.definition_answer(retrieval.merge_matches(_matches(v)))


@query
def C7_extract(v: Views) -> DataFrame:
    return decide.extract(retrieval.merge_matches(_matches(v)))


@query
def Q10_C5_C6_ask(v: Views) -> DataFrame:
    a = decide.answer(retrieval.prepare_questions(v.questions()), retrieval.merge_matches(_matches(v)))
    return a.select("question_id", "supported", "answer", "confidence", F.col("n_sources").cast("long").alias("n_sources"))


# --- context


def _evidence_tables(v: Views) -> dict[str, DataFrame]:
    """All kinds of evidence; every unit of an even document has a preview, and each upload and session a digest."""
    preview = F.when(F.regexp_extract("asset_id", "([0-9]+)$", 1).cast("long") % 2 == 0, F.concat(F.lit("file:/"), "id"))
    units = v.units().withColumns({"preview_uri": preview, "page_number": F.when(F.col("order_index") % 3 == 0, (F.col("order_index") % 100).cast("int"))})
    d = v.table("documents")
    n = F.col("doc_id").cast("string")
    of_asset = d.select(F.concat(F.lit("dig"), n).alias("id"), F.col("source").alias("session_id"), F.concat(F.lit("doc"), n).alias("asset_id"), F.lit("asset_summary").alias("kind"), F.concat(F.lit("Digest "), n).alias("title"), X.excerpt("text", 200).alias("text"), F.lpad(n, 12, "0").alias("created_at"))
    of_session = v.sessions().select(F.concat(F.lit("dig_"), "id").alias("id"), F.col("id").alias("session_id"), F.lit(None).cast("string").alias("asset_id"), F.lit("session_summary").alias("kind"), F.lit("Session").alias("title"), F.col("title").alias("text"), F.col("starts_at").alias("created_at"))
    assets = v.assets().select(F.concat(F.lit("doc"), "asset_id").alias("id"), F.col("name").alias("file_name"))
    return {"evidence_units": units, "glossary_terms": v.glossary(), "material_chunks": v.chunks(), "transcript_entries": v.transcript(), "uploaded_assets": assets, "asset_digests": of_asset.unionByName(of_session)}


@query
def B1_B5_context_blocks(v: Views) -> DataFrame:
    q = retrieval.prepare_questions(v.questions())
    return context.answer_evidence(q, settle(retrieval.merge_matches(_matches(v))), _evidence_tables(v))


@query
def B2_J9_focused(v: Views) -> DataFrame:
    """The first six matches of each question from their whole records."""
    f = context.focused(settle(retrieval.merge_matches(_matches(v))), context.records(_evidence_tables(v)), context.PROFILES["production"]["focused"])
    return f.select("question_id", "order_index", F.md5("block").alias("block"))


@query
def B6_J11_digests(v: Views) -> DataFrame:
    t = _evidence_tables(v)
    d = context.digests_for(t["asset_digests"], settle(retrieval.merge_matches(_matches(v))), retrieval.prepare_questions(v.questions()), context.records(t))
    return d.select("question_id", "section", "order_index", F.md5("block").alias("block"))


@query
def R15_visual(v: Views) -> DataFrame:
    t = _evidence_tables(v)
    return context.visual_evidence(retrieval.prepare_questions(v.questions()), settle(retrieval.merge_matches(_matches(v))), t["evidence_units"], t["uploaded_assets"]).withColumn("caption", F.md5("caption"))


@query
def J15_names(v: Views) -> DataFrame:
    """Uploads whose names repeat: each third document has the name of the one before."""
    d = v.table("documents").select("doc_id", F.col("source").alias("session_id"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 60).cast("string"), F.lit(".txt")).alias("name"), "lang")
    rows = d.select("session_id", F.col("doc_id").alias("position"), "name", "lang")
    out = files.matched_by_name(d.select("doc_id", "session_id", F.col("name").alias("file_name")), rows.where("position % 2 = 0"), rows.where("position % 3 = 0"))
    return out.select("doc_id", "file_name", F.col("source.position").alias("source"), F.col("parsed.position").alias("parsed"))


@query
def B7_prompt(v: Views) -> DataFrame:
    m = retrieval.merge_matches(_matches(v)).where("rank <= 12").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))), lambda x: x["excerpt"]).alias("evidence"))
    return v.questions().join(m, "question_id", "left").select("question_id", context.prompt(F.col("question"), F.coalesce("evidence", F.array().cast("array<string>"))).alias("prompt"))


@query
def B8_B10_summaries(v: Views) -> DataFrame:
    return context.summaries(v.chunks(), v.transcript())


@query
def B6_B11_A15_W6_digests(v: Views) -> DataFrame:
    d = context.asset_digests(v.units())
    return d.select("session_id", "asset_id", F.md5("text").alias("text"))


# --- reads


@query
def P1_P6_lookup(v: Views) -> DataFrame:
    wanted = v.glossary().select(F.concat(F.lit("doc"), F.col("order_index").cast("string")).alias("id"))
    return reads.lookup(v.materials(), wanted).select("id", "title")


@query
def P2_P5_P8_filters(v: Views) -> DataFrame:
    a = v.assets().withColumnRenamed("name", "file_name").withColumn("error_message", F.when(F.col("doc_id") % 3 == 0, "unreadable"))
    return reads.scan(a, "uploaded_assets", status="ready", error_message=None).select("asset_id", "file_name")


@query
def P11_D13_known_sources(v: Views) -> DataFrame:
    items = v.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("sources"))
    known = v.table("supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"))
    return reads.with_known_sources(items, "sources", known).select(F.col("id").alias("order_id"), F.size("sources").cast("long").alias("n_sources"))


@query
def O1_Q11_sessions(v: Views) -> DataFrame:
    return reads.ordered(v.sessions(), "lecture_sessions").select("id", "title", "starts_at", "status", F.col("rank").cast("long").alias("rank"))


@query
def O2_O3_J1_chunks(v: Views) -> DataFrame:
    return reads.chunks_in_order(v.chunks(), v.materials()).select("session_id", "id", F.col("rank").cast("long").alias("rank"))


@query
def O10_P9_sources(v: Views) -> DataFrame:
    return reads.ordered(v.qa()["sources"], "answer_sources", "answer_id").select("id", "answer_id", F.col("rank").cast("long").alias("rank"))


@query
def A1_A2_counts(v: Views) -> DataFrame:
    qa = v.qa()
    return reads.counts(v.sessions(), {"materials": v.materials(), "chunks": v.chunks(), "terms": v.glossary(), "entries": v.transcript(), "questions": qa["questions"], "answers": qa["answers"]})


@query
def A3_A4_Q9_indexing(v: Views) -> DataFrame:
    return reads.indexing_summary(v.assets())


@query
def A10_median(v: Views) -> DataFrame:
    return v.table("lineitem").groupBy("l_suppkey").agg(parse.half_up_median(F.col("l_extendedprice").cast("double")).alias("median"))


@query
def A9_A11_arg_max(v: Views) -> DataFrame:
    rows = v.chunks().select("session_id", F.col("order_index").alias("n"), F.split("text", " ")[0].alias("term"), F.col("text").alias("definition"))
    return parse.merge_terms(rows, ["session_id"]).select("session_id", F.col("order_index").cast("long").alias("order_index"), F.md5("definition").alias("definition"))


@query
def A14_U3_ordered_union(v: Views) -> DataFrame:
    e = mutations.ordered_union(v.table("events"), ["user_id"], "event_id", "event_type")
    return e.select("user_id", F.array_join("event_type", ",").alias("types"))


@query
def A17_status_lattice(v: Views) -> DataFrame:
    return mutations.most_advanced(v.assets(), ["session_id"], "doc_id")


@query
def W2_W3_A13_append(v: Views) -> DataFrame:
    """Every line of a session's documents as a term of its first two words, into the session's glossary."""
    at = lambda df, when: df.withColumns({"created_at": F.lit(when), "updated_at": F.lit(when)})
    more = v.chunks().select("id", "session_id", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("term"), F.col("keywords").alias("aliases"), F.col("text").alias("definition"), "order_index")
    out = mutations.append_pack({"glossary_terms": at(v.glossary(), "1")}, {"glossary_terms": at(more, "2")})["glossary_terms"]
    return out.select("session_id", "id", "term", F.md5("definition").alias("definition"), F.array_join("aliases", ",").alias("aliases"), F.col("order_index").cast("long").alias("order_index"), "updated_at")


@query
def W5_latest_entries(v: Views) -> DataFrame:
    return reads.latest(v.transcript()).select("session_id", "id", F.col("from_end").cast("long").alias("from_end"))


@query
def Q1_J3_J5_J6_feed(v: Views) -> DataFrame:
    qa = v.qa()
    f = reads.community_feed(qa["questions"], qa["answers"], qa["sources"], qa["categories"])
    return f.select("id", "session_id", "category", "answer", F.array_join(F.transform("sources", lambda s: s["source_type"]), ",").alias("sources"), F.col("rank").cast("long").alias("rank"))


@query
def Q2_J4_history(v: Views) -> DataFrame:
    qa = v.qa()
    f = reads.question_history(qa["questions"], qa["answers"], qa["sources"])
    return f.select("id", "session_id", "confidence_score", F.size("sources").cast("long").alias("n_sources"), F.col("rank").cast("long").alias("rank"))


@query
def Q3_overview(v: Views) -> DataFrame:
    summaries = context.summaries(v.chunks(), v.transcript())
    o = reads.overview(v.sessions(), {"materials": v.materials(), "terms": v.glossary()}, v.transcript(), summaries)
    return o.select("session_id", "title", "materials", "terms", F.md5(F.array_join("latest", "\n")).alias("latest"), F.md5(F.array_join(F.transform("summaries", lambda x: x["text"]), "\n")).alias("summaries"))


@query
def Q4_Q12_J19_workspaces(v: Views) -> DataFrame:
    a = v.assets().withColumnRenamed("name", "file_name")
    w = reads.workspace_text(reads.workspaces(v.sessions(), v.materials(), a))
    return w.select("session_id", F.size("files").cast("long").alias("n_files"), "n_materials", "ready", "processing", "failed", "in_flight", "subtitle", "indexed_text")


def _dim(v: Views) -> DataFrame:
    return reads.evidence_dim(v.materials(), v.chunks(), v.glossary(), v.transcript(), v.units())


@query
def Q5_J7_notes(v: Views) -> DataFrame:
    kinds = F.array(*map(F.lit, ["session", "lecture_material", "material_chunk", "glossary_term"]))
    n = v.table("events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("anchor_type"),
        F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("doc"), (F.col("event_id") % 1500).cast("string"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("doc"), (F.col("event_id") % 1500).cast("string"), F.lit("_0"))).when(F.col("event_id") % 4 == 3, F.concat(F.lit("term"), (F.col("event_id") % 60).cast("string"))).alias("anchor_id"),
        (F.col("event_id") % 3 == 0).alias("pinned"), F.lpad((F.col("event_id") % 50).cast("string"), 4, "0").alias("updated_at"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("created_at"),
    )
    return reads.notes_with_labels(n, _dim(v)).select("id", "session_id", "anchor_label", F.col("rank").cast("long").alias("rank"))


@query
def Q6_J8_source_detail(v: Views) -> DataFrame:
    marks = v.qa()["sources"].where("relevance_score > 5").select("session_id", F.col("source_type").alias("target_type"), F.col("source_record_id").alias("target_id"))
    return reads.source_detail(v.qa()["sources"], _dim(v), marks).select("id", "record_label", "parent_label", "bookmarked")


@query
def Q7_snapshot(v: Views) -> DataFrame:
    marks = v.glossary().select("session_id", F.lit("glossary_term").alias("target_type"), F.col("id").alias("target_id"), F.col("term").alias("label"), F.col("id").alias("created_at"), "id")
    s = reads.materials_snapshot(v.materials(), v.chunks(), v.glossary(), marks)
    return s.select("session_id", *[F.md5(F.array_join(t, ",")).alias(t) for t in ("lecture_materials", "material_chunks", "glossary_terms", "bookmarks")])


# --- mutations and streaming


@query
def M1_upsert(v: Views) -> DataFrame:
    old = v.table("customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("value"))
    new = v.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("ordered").alias("c_name"), F.col("o_totalprice").cast("double").alias("value"), "o_orderkey")
    w = Window.partitionBy("c_custkey").orderBy(F.desc("o_orderkey"))
    return mutations.upsert(old, new.withColumn("n", F.row_number().over(w)).where("n = 1").select("c_custkey", "c_name", "value"), ["c_custkey"])


@query
def M4_M5_cascade(v: Views) -> DataFrame:
    t = {"lecture_materials": v.materials(), "material_chunks": v.chunks()}
    gone = v.materials().where("order_index % 5 = 0").select("id")
    return mutations.delete(t, "lecture_materials", gone)["material_chunks"].select("id", "material_id")


@query
def M6_toggle(v: Views) -> DataFrame:
    presses = v.table("events").select(F.col("user_id").cast("string").alias("session_id"), F.lit("event").alias("target_type"), F.col("event_type").alias("target_id"), F.col("event_type").alias("label"), F.col("event_id").alias("at"))
    current = presses.where("at % 10 = 0").select("session_id", "target_type", "target_id", "label").distinct()
    return mutations.toggle_bookmarks(current, presses)


@query
def M9_consolidate(v: Views) -> DataFrame:
    t = {"lecture_sessions": v.sessions(), "glossary_terms": v.glossary()}
    return mutations.consolidate(t, "src0")["glossary_terms"].select("id", "session_id", "term")


@query
def M9_J16_references(v: Views) -> DataFrame:
    """All sessions into one: what units, digests, bookmarks and questions refer to after it, and the uploads' states."""
    d = v.table("documents")
    text = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    name = F.concat(F.lit("Notes "), F.floor(F.col("doc_id") / 3).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".TXT").otherwise(".txt"))
    a = v.assets().select(F.concat(F.lit("doc"), "asset_id").alias("id"), "session_id", name.alias("file_name"), F.lit("material").alias("source_kind"), "status", "created_at")
    digests = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("session_id"), text.alias("asset_id"), F.lit("asset_summary").alias("kind"), F.col("lang").alias("title"), F.md5("text").alias("text"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("created_at"))
    g, c = v.glossary(), v.categories()
    t = {
        "lecture_sessions": v.sessions(), "glossary_terms": g, "uploaded_assets": a, "evidence_units": v.units().select("id", "session_id", "asset_id"), "asset_digests": digests.withColumn("updated_at", F.col("created_at")), "qa_categories": c,
        "bookmarks": g.select(F.concat(F.lit("m"), "id").alias("id"), "session_id", F.lit("glossary_term").alias("target_type"), F.col("id").alias("target_id"), F.lpad(F.col("order_index").cast("string"), 9, "0").alias("created_at")),
        "questions": v.questions().select(F.col("question_id").alias("id"), "session_id", F.concat_ws("_", "session_id", F.lit("concepts")).alias("category_id")),
    }
    out = mutations.consolidate(t, "src0", "now")
    refers = {"uploaded_assets": F.col("status"), "evidence_units": F.col("asset_id"), "asset_digests": F.concat_ws(" ", "asset_id", F.when(F.col("asset_id").isNull(), F.md5("text")).otherwise(F.col("text"))), "bookmarks": F.col("target_id"), "questions": F.col("category_id")}
    every = [out[n].select(F.lit(n).alias("name"), (F.when(F.col("asset_id").isNull(), "all").otherwise(F.col("id")).alias("id") if n == "asset_digests" else F.col("id")), value.alias("refers")) for n, value in refers.items()]
    return reduce(DataFrame.unionByName, every)


@query
def U4_U5_J10_difference(v: Views) -> DataFrame:
    """A customer's orders as a session: those that are settled are there, all come in, and the others are numbered on."""
    o = v.table("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("session_id"), F.lit(0).alias("order_index"), "o_orderstatus")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("key")) - 1
    current = o.where("o_orderstatus = 'F'").drop("o_orderstatus").withColumn("order_index", place)
    incoming = o.drop("o_orderstatus").withColumn("order_index", F.pmod("key", F.lit(1000)).cast("int"))
    return mutations.append_rows(current, incoming, ["session_id", "key"]).select("key", "session_id", F.col("order_index").cast("long").alias("order_index"))


@query
def F32_answer_text(v: Views) -> DataFrame:
    b = v.table("benchmark")
    asked = F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 3))
    told = F.when(F.col("item_id") % 2 == 0, F.concat(F.regexp_replace(asked, "[?!.]+$", ""), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    value = F.concat(F.lit("<thinking>"), "text", F.lit("</Thinking>\nQuestion: why\nFinal answer: "), told, F.lit("\n1. "), F.regexp_replace("text", "\n", " "), F.lit("\nEvidence:\n"), "text")
    return b.select("item_id", X.answer_text(value, F.concat(asked, F.lit("?"))).alias("answer"))


@query
def F30_unit_payload(v: Views) -> DataFrame:
    d = v.table("documents")
    name = F.when(F.col("doc_id") % 2 == 0, "content_text").otherwise("contentText")
    u = X.unit_payload(F.to_json(F.map_from_arrays(F.array(name, F.lit("title")), F.array("text", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise("")))), "source")
    return d.select("doc_id", u.alias("u")).select("doc_id", "u.title", F.md5("u.excerpt").alias("excerpt"), F.md5("u.content_text").alias("content_text"), F.md5("u.search_text").alias("search_text"))


@query
def M2_upsert_digest(v: Views) -> DataFrame:
    a = v.assets().select("asset_id", "session_id", F.lit("asset_summary").alias("kind"), F.col("name").alias("title"), F.md5("text").alias("text"), F.col("created_at").alias("updated_at"), "status")
    new = a.where("status <> 'failed'").withColumn("title", F.lit("again")).drop("status")
    return mutations.upsert_digest(a.where("status <> 'ready'").drop("status"), new)


@query
def M3_set_status(v: Views) -> DataFrame:
    a = v.assets().select(F.col("asset_id").alias("id"), "status", F.lit("old").alias("error_message"), F.lit("1").alias("indexed_at"), F.col("created_at").alias("updated_at"))
    done = a.where("status = 'processing'").select("id", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit("2").alias("indexed_at"), F.lit("2").alias("updated_at"))
    return mutations.set_status(a, done)


@query
def M7_new_notes(v: Views) -> DataFrame:
    r = v.table("conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.when(F.col("turn") % 3 > 0, F.concat(F.lit(" "), "text", F.lit("\n"))).otherwise(" ").alias("content"),
        F.when(F.col("turn") % 2 == 0, "material_chunk").alias("anchor_type"), F.when(F.col("turn") % 4 == 0, "c").alias("anchor_id"), F.col("turn").cast("string").alias("created_at"),
    )
    made, refused = mutations.new_notes(r)
    return made.select("session_id", "created_at", "anchor_type", F.md5("content").alias("content"), F.lit(None).cast("string").alias("reason")).unionByName(refused.select("session_id", "created_at", "anchor_type", F.md5("content").alias("content"), "reason"))


@query
def M8_W3_append_materials(v: Views) -> DataFrame:
    m = v.materials()
    first = F.col("source_label").startswith("slides")
    out = mutations.append_pack({"lecture_materials": m.where(first)}, {"lecture_materials": m.where(~first)})
    return out["lecture_materials"].select("id", "session_id", "order_index")


@query
def M8_J13_append_questions(v: Views) -> DataFrame:
    e = v.table("events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("event_id"))
    kinds = e.select("session_id", "key").distinct().withColumn("created_at", F.lit("1"))
    named = lambda df, p: df.withColumn("id", F.concat_ws("_", F.lit(p), "session_id", "key"))
    q = e.select(F.col("event_id").alias("id"), "session_id", F.concat_ws("_", F.lit("new"), "session_id", "key").alias("category_id"))
    out = mutations.append_pack({"qa_categories": named(kinds.where("key in ('view', 'error')"), "old")}, {"qa_categories": named(kinds, "new"), "questions": q})
    return out["questions"]


@query
def ST2_ST3_index_states(v: Views) -> DataFrame:
    a = v.assets().select("asset_id", "session_id", "name", X.extension("name").alias("extension"), "text", F.col("created_at").alias("queued_at"))
    return streaming.latest_states(streaming.states_of(a)).select("asset_id", "session_id", "status")


# --- files and packs of sessions


def _pack_files(v: Views) -> DataFrame:
    """Each document as a pack of one session; every fifth upload is a raw file instead."""
    n, one = F.col("doc_id").cast("string"), F.lit(0).alias("orderIndex")
    named = lambda prefix: F.concat(F.lit(prefix), n)
    same = lambda value, *names: [F.lit(value).alias(x) for x in names]
    body, lang = F.coalesce(F.nullif(X.strip("text"), F.lit("")), F.lit("none")), F.coalesce("lang", F.lit("none"))
    points = F.array(F.struct(F.lit("glossary_term").alias("sourceType"), named("g").alias("sourceId")), F.struct(F.when(F.col("doc_id") % 2 == 0, "material_chunk").otherwise("evidence_unit").alias("sourceType"), named("c").alias("sourceId")))
    answer = F.struct(named("a").alias("id"), F.lit("It is.").alias("text"), F.lit(0.5).alias("confidenceScore"), points.alias("sources"))
    pack = F.struct(
        *same("1.0.0", "packVersion"), *same("2024-01-01", "exportedAt"),
        F.struct(named("s").alias("id"), named("Course ").alias("title"), *same("x", "courseCode", "lecturer", "description", "location"), *same("2024-01-01", "startsAt"), *same("live", "status"), F.array(F.lit("tag"), lang).alias("tags")).alias("session"),
        F.array(F.struct(named("m").alias("id"), *same("Notes", "title", "sourceLabel"), *same("reading", "type"), X.excerpt(body, 220).alias("contentText"), one, F.array(F.struct(named("c").alias("id"), *same("Part", "heading"), body.alias("text"), F.array(lang).alias("keywords"), one)).alias("chunks"))).alias("materials"),
        F.array(F.struct(named("g").alias("id"), named("Term ").alias("term"), F.array(lang).alias("aliases"), F.md5(body).alias("definition"), one)).alias("glossary"),
        F.array(F.struct(named("t").alias("id"), *same("Dr. X", "speakerLabel"), body.alias("text"), F.lit(5.5).alias("startedAtSeconds"), one)).alias("transcript"),
        F.array(F.struct(named("u").alias("id"), *same("overview", "kind"), *same("O", "title"), lang.alias("text"))).alias("summaries"),
        F.array(F.struct(named("k").alias("id"), *same("concepts", "key", "label", "description"))).alias("qaCategories"),
        F.array(F.struct(named("q").alias("id"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise("concepts").alias("categoryKey"), F.concat(F.lit(" What is "), n, F.lit("? ")).alias("questionText"), *same("2024-02-01", "askedAt"), answer.alias("answer"))).alias("publicQa"),
    )
    value = F.when(F.col("doc_id") % 5 == 0, F.to_json(F.array(lang))).otherwise(F.to_json(pack))
    return v.table("documents").select(n.alias("upload"), F.concat(named("p"), F.lit(".json")).alias("name"), value.alias("value"))


@query
def S1_S2_T20_M10_packs(v: Views) -> DataFrame:
    """Packs told from raw files, read into tables, in place of what every second session had before."""
    whole, _ = packs.split_uploads(_pack_files(v))
    loaded = settle(packs.parse_packs(whole))
    n = F.col("doc_id").cast("string")
    was = v.table("documents").where("doc_id % 2 = 0").select(F.concat(F.lit("old"), n).alias("id"), F.concat(F.lit("s"), n).alias("session_id"), *[F.lit("old").alias(c) for c in ("material_id", "heading", "text", "created_at")], F.array().cast("array<string>").alias("keywords"), F.lit(0).alias("order_index"))
    t = api.import_packs(loaded, {"material_chunks": was}, "now")
    told = {
        "lecture_sessions": F.concat_ws("|", "title", "source_pack_version", F.array_join("tags", ",")), "lecture_materials": F.md5("content_text"), "material_chunks": F.concat_ws("|", "material_id", F.md5("text"), F.array_join("keywords", ",")),
        "glossary_terms": F.concat_ws("|", "term", "definition", F.array_join("aliases", ",")), "transcript_entries": F.concat_ws("|", "speaker_label", F.md5("text")), "summaries": F.concat_ws("|", "kind", "text"), "qa_categories": F.col("key"),
        "questions": F.concat_ws("|", "category_id", "normalized_text"), "answers": F.concat_ws("|", "question_id", "text"), "answer_sources": F.concat_ws("|", "answer_id", "source_record_id", "label", F.md5("excerpt")),
    }
    every = [t[name].select(F.lit(name).alias("name"), "id", F.col("id" if name == "lecture_sessions" else "session_id").alias("session_id"), value.alias("told")) for name, value in told.items()]
    return reduce(DataFrame.unionByName, every)


@query
def T14_public_qa(v: Views) -> DataFrame:
    """Three questions a document: a whole one, one without an answer, one whose sources have no kind."""
    n = F.col("doc_id").cast("string")
    source = F.struct(F.lit("glossary_term").alias("sourceType"), n.alias("sourceId"))
    row = lambda question, answer, sources: F.struct(F.concat(F.lit(question), n, F.lit("? ")).alias("questionText"), F.when(F.col("doc_id") % 2 == 0, "Big Topic").alias("categoryKey"), F.struct(answer.alias("text"), (F.col("doc_id") % 3 / 2.0 + 0.25).alias("confidenceScore"), sources.alias("sources")).alias("answer"))
    no_kind = F.struct(F.lit(None).cast("string").alias("sourceType"), n.alias("sourceId"))
    rows = F.array(row(" What is ", F.col("text"), F.array(source, no_kind)), row("Why ", F.lit(" "), F.array(source)), row("How ", F.col("text"), F.array(no_kind)))
    d = v.table("documents").select(n.alias("asset_id"), F.to_json(F.struct(rows.alias("publicQa"))).alias("text"))
    return parse.public_qa(d).select("asset_id", F.col("order_index").cast("long").alias("order_index"), "id", "answer_id", "question", F.md5("answer").alias("answer"), "category", "confidence_score", F.size("sources").cast("long").alias("n_sources"))


@query
def T15_session_files(v: Views) -> DataFrame:
    """What a session file tells: JSON for even documents, lines for odd ones."""
    title = F.concat(F.lit("Course "), F.col("doc_id").cast("string"))
    status = F.when(F.col("doc_id") % 3 == 0, "live").when(F.col("doc_id") % 3 == 1, "ended").otherwise("gone")
    js = F.to_json(F.struct(title.alias("title"), status.alias("status"), F.col("lang").alias("description"), F.array(F.lit(" a "), F.col("source")).alias("tags")))
    lines = F.concat_ws("\n", F.concat(F.lit("Title: none\nTITLE : "), title), F.concat(F.lit("status: "), status), F.lit("no key here"), F.concat(F.lit("Tags: a; "), F.col("source")))
    even = F.col("doc_id") % 2 == 0
    d = v.table("documents").select(F.col("doc_id").cast("string").alias("asset_id"), F.lit("session").alias("name"), F.when(even, "json").otherwise("txt").alias("extension"), F.when(even, js).otherwise(lines).alias("text"))
    return parse.session_metadata(d).select("asset_id", "title", "status", "description", F.array_join("tags", ",").alias("tags"))


@query
def Q8_previews(v: Views) -> DataFrame:
    """The sources of answers as units of evidence, with what is known about those that have a preview."""
    number = F.regexp_extract("asset_id", "([0-9]+)$", 1).cast("long")
    units = _evidence_tables(v)["evidence_units"].withColumns({"slide_number": F.when(number % 3 == 0, number), "frame_label": F.when(number % 4 == 0, "frame")})
    sources = v.qa()["sources"].withColumn("source_type", F.lit("evidence_unit"))
    marks = sources.where("relevance_score > 5").select("session_id", F.col("source_type").alias("target_type"), F.col("source_record_id").alias("target_id"))
    return reads.previews(reads.source_detail(sources, _dim(v), marks), units).select("id", "record_label", "preview_uri", "about", "bookmarked")


@query
def O4_O14_orders(v: Views) -> DataFrame:
    """Each kind of row in its order within a session."""
    qa, g, n = v.qa(), v.glossary(), F.col("event_id")
    notes = v.table("events").select(n.cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), (n % 3 == 0).alias("pinned"), (n % 50).alias("updated_at"), (n % 7).alias("created_at"))
    told = context.summaries(v.chunks(), v.transcript()).select("session_id", "kind", F.col("kind").alias("title"), F.concat_ws("_", "session_id", "kind").alias("id"))
    marks = g.select("id", "session_id", F.col("id").alias("target_id"), F.lit("glossary_term").alias("target_type"), (F.col("order_index") % 3).alias("created_at"))
    digests = v.assets().select(F.col("asset_id").alias("id"), "session_id", F.col("status").alias("created_at"))
    t = {
        "glossary_terms": g, "transcript_entries": v.transcript(), "summaries": told, "qa_categories": v.categories(), "questions": qa["questions"], "answers": qa["answers"], "notes": notes, "bookmarks": marks,
        "uploaded_assets": v.assets().select(F.col("asset_id").alias("id"), "session_id", F.col("status").alias("created_at"), F.col("name").alias("file_name")), "evidence_units": v.units().withColumn("created_at", F.col("modality")), "asset_digests": digests,
    }
    every = [reads.ordered(rows, name, "session_id").select(F.lit(name).alias("name"), "session_id", "id", F.col("rank").cast("long").alias("rank")) for name, rows in t.items()]
    return reduce(DataFrame.unionByName, every)


@query
def P3_P4_keys(v: Views) -> DataFrame:
    """The user's own public questions, and the bookmarks under given sessions, kinds and targets."""
    qa = v.qa()
    own = reads.scan(qa["questions"], "questions", visibility="public", origin="user_local").select(F.lit("question").alias("name"), "id", "session_id")
    marks = qa["sources"].select("id", "session_id", F.col("source_type").alias("target_type"), F.col("source_record_id").alias("target_id"))
    wanted = v.chunks().select("session_id", F.lit("material_chunk").alias("target_type"), F.col("id").alias("target_id"))
    return own.unionByName(reads.lookup(marks, wanted, ["session_id", "target_type", "target_id"]).select(F.lit("bookmark").alias("name"), "id", "session_id"))


@query
def U5_put_first(v: Views) -> DataFrame:
    """A user's kinds of events as a list as first seen; the kind of the last event is put in front."""
    e = v.table("events").groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("key")).agg(F.min("event_id").alias("at"))
    last = v.table("events").groupBy(F.col("user_id").alias("session_id")).agg(F.max_by("event_type", "event_id").alias("key"), F.max("event_id").alias("at"))
    return mutations.put_first(e, last, ["session_id", "key"], "at").select("session_id", "key", F.col("place").cast("long").alias("place"))
