"""Length-bounded context and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.operators.retrieval import MOST_SOURCES, filling, focus_boost, holding, holds_focus, sharing, text_score
from lucerna.sources.tables import settle

FOCUSED, BLOCKS, BLOCK_CHARS = 8, 3, 900
ANSWER_RULES = ["Answer only from the evidence.", "Say unsupported if the evidence doesn't answer the question.", "Use at most six sentences."]
#: How many matches are written out, and the characters and number of blocks of each kind of record, by profile.
PROFILES = {
    "development": {"focused": 8, "visual": 1, "evidence_unit": (1150, 4), "glossary_term": (900, 3), "material_chunk": (1150, 4), "transcript_entry": (900, 2)},
    "production": {"focused": 6, "visual": 1, "evidence_unit": (1000, 3), "glossary_term": (800, 2), "material_chunk": (1000, 3), "transcript_entry": (850, 2)},
}
#: Titles of matches and of blocks, and what a record's kind adds to its score; in the order in which they are written.
TITLES = {
    "evidence_unit": ("Focused multimodal evidence", "Session indexed multimodal context", 0.35), "glossary_term": ("Focused glossary evidence", "Session glossary context", 0.4),
    "material_chunk": ("Focused lecture material", "Session lecture material context", 0.2), "transcript_entry": ("Focused transcript evidence", "Session transcript context", 0.05),
}
DIGESTS, VISUAL_BOOST, VISUAL_LEAST = 4, 0.3, 0.6
#: Parts in which the first lines of a session or question are looked for, before they are put together.
PARTS = 64


def _or_null(rows: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column).cast(kind) if column in rows.columns else F.lit(None).cast(kind)


def _listed(rows: DataFrame, column: str, word: str) -> Column:
    words = F.coalesce(_or_null(rows, column, "array<string>"), F.array().cast("array<string>"))
    return F.when(F.size(words) > 0, F.concat(F.lit(f" {word}: "), F.array_join(words, ", "), F.lit("."))).otherwise("")


def _seconds(x: Column) -> Column:
    return F.floor(x.cast("double") + 0.5).cast("long").cast("string")


def _place(rows: DataFrame) -> Column:
    """Where in its file a unit stands: page, else slide, else time."""
    page, slide, start, end = (_or_null(rows, c, "double") for c in ("page_number", "slide_number", "timestamp_start_seconds", "timestamp_end_seconds"))
    time = F.concat(F.lit("Timestamp "), _seconds(start), F.lit("s"), F.when(end.isNotNull(), F.concat(F.lit("-"), _seconds(end), F.lit("s"))).otherwise(""), F.lit("."))
    whole = lambda word, x: F.concat(F.lit(f"{word} "), x.cast("long").cast("string"), F.lit("."))
    return F.when(page.isNotNull(), whole("Page", page)).when(slide.isNotNull(), whole("Slide", slide)).when(start.isNotNull(), time)


def records(tables: dict[str, DataFrame]) -> DataFrame:
    """B1: session_id, source_type, id, asset_id, entry (the record in one line) and body (what it is scored by) of the four kinds of evidence there are.

    tables: glossary_terms, material_chunks, transcript_entries, evidence_units and, for the names of files, uploaded_assets.
    """
    parts = []
    keys = lambda kind, asset=None: ["session_id", F.lit(kind).alias("source_type"), "id", (asset if asset is not None else F.lit(None)).cast("string").alias("asset_id")]
    told = lambda name, body, *more: F.concat(F.lit("- "), F.coalesce(name, F.lit("")), F.lit(": "), F.coalesce(body, F.lit("")), *more).alias("entry")
    both = lambda *c: F.concat_ws(" ", *c).alias("body")
    if "glossary_terms" in tables:
        t = tables["glossary_terms"]
        parts.append(t.select(*keys("glossary_term"), told(F.col("term"), F.col("definition"), _listed(t, "aliases", "Aliases")), both("term", "definition")))
    if "material_chunks" in tables:
        t = tables["material_chunks"]
        parts.append(t.select(*keys("material_chunk"), told(F.col("heading"), F.col("text"), _listed(t, "keywords", "Keywords")), both("heading", "text")))
    if "transcript_entries" in tables:
        t = tables["transcript_entries"]
        at = F.concat("speaker_label", F.lit(" at "), _seconds(F.col("started_at_seconds")), F.lit("s"))
        parts.append(t.select(*keys("transcript_entry"), told(at, F.col("text")), both("speaker_label", "text")))
    if "evidence_units" in tables:
        t = tables["evidence_units"]
        if "uploaded_assets" in tables:
            t = t.join(tables["uploaded_assets"].select(F.col("id").alias("asset_id"), F.col("file_name").alias("_file")), "asset_id", "left")
        file = F.when(F.coalesce(_or_null(t, "_file"), F.lit("")) != "", F.concat(F.lit(" Source file: "), _or_null(t, "_file"), F.lit("."))).otherwise("")
        parts.append(t.select(*keys("evidence_unit", F.col("asset_id")), told(F.col("title"), F.col("content_text"), file, F.coalesce(F.concat(F.lit(" "), _place(t)), F.lit(""))), both("title", "search_text")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def focused(matches: DataFrame, found: DataFrame, most: int = FOCUSED) -> DataFrame:
    """question_id, order_index, block: the first matches written out from their whole records; one without a record by its label and excerpt."""
    first = matches.where(F.col("rank") <= most)
    wanted = settle(first.select("source_type", "source_record_id").distinct())  # the records that no match names are not shuffled; settled, so that its size is known before they could be
    whole = found.select("source_type", F.col("id").alias("source_record_id"), "entry").join(wanted, ["source_type", "source_record_id"], "left_semi").dropDuplicates(["source_type", "source_record_id"])
    title = F.create_map(*[F.lit(x) for kind, t in TITLES.items() for x in (kind, t[0])])
    known = F.concat_ws("\n", F.try_element_at(title, F.col("source_type")), "entry")
    unknown = F.concat(F.lit("Focused evidence\n- "), F.coalesce("label", F.lit("")), F.lit(": "), F.coalesce("excerpt", F.lit("")))
    joined = first.join(whole, ["source_type", "source_record_id"], "left")
    return joined.select("question_id", (F.col("rank") - 1).cast("int").alias("order_index"), F.when(F.col("entry").isNotNull(), known).otherwise(unknown).alias("block"))


def first_here(rows: DataFrame, key: str, order: list[Column], size: Column, most: int) -> DataFrame:
    """Of each task the first rows of each key in an order whose sizes come to most, so that few rows are shuffled to find a key's first; the last one may go beyond."""
    spread = rows.withColumn("_size", size.cast("long")).sortWithinPartitions(key, *order)
    at, sizes = spread.columns.index(key), spread.columns.index("_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at).dictionary_encode("encode")
            number, takes = keys.indices.to_numpy(zero_copy_only=False), batch.column(sizes).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[True], number[1:] != number[:-1]])
            before = np.cumsum(takes) - takes
            run_ = np.cumsum(starts) - 1
            before = before - before[starts][run_]
            names = (batch.column(at)[0].as_py(), batch.column(at)[batch.num_rows - 1].as_py())
            if last == (names[0],):
                before = before + np.where(run_ == 0, total, 0)
            last, total = (names[1],), int(before[-1] + takes[-1])
            yield batch.filter(pa.array(before < most))

    return spread.mapInArrow(run, spread.schema).drop("_size")


def first_filling(rows: DataFrame, keys: list[str], order: list[Column], size: Column, most: int) -> DataFrame:
    """The first rows of each key in an order whose sizes come to most; the last one may go beyond. First in parts, so that a key with very many rows doesn't meet in one task."""
    spread = rows.withColumn("_size", size).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    for by in ([*keys, "_part"], keys):
        before = F.sum("_size").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
        spread = spread.withColumn("_before", before).where(F.col("_before") < most)
    return spread.drop("_size", "_part", "_before")


def remaining(questions: DataFrame, candidates: DataFrame, used: DataFrame, boost: float, most_chars: int = BLOCK_CHARS, most_blocks: int = BLOCKS) -> DataFrame:
    """Candidates (session_id, source_type, id, entry, body) not among those used, with the score of
    their body and a place; relevant: whether any of a question's entries holds its focus.

    Rows that can't come into the first most_blocks blocks are left out: an entry takes its length and a line end of a
    block, or a whole one, so what lies beyond most_chars * most_blocks characters is never packed. A line without a
    token or the focus of the question scores as all such lines of its session do, so of these only the first in order,
    as many as fill the blocks beside those used, meet the session's questions; all others meet on a token or the focus.

    used: at most MOST_SOURCES rows of a question, as merge_matches gives.
    """
    q = questions.select("question_id", "session_id", "focus", "q_tokens")
    c = candidates.withColumn("c_tokens", X.unique(X.tokenize("body")))
    room = most_chars * most_blocks
    placed = [F.collate("entry", "UNICODE"), F.col("id")]
    takes = F.least(F.length("entry") + 1, F.lit(most_chars))
    most = room + MOST_SOURCES * most_chars

    told = ["question_id", "source_type", "id", "entry", "focus"]
    lines = c.select("session_id", "id", "source_type", "entry", (F.size("c_tokens") > 0).alias("has_tokens"))

    def first_lines(*before: Column) -> DataFrame:
        order = [*before, *placed]
        return first_filling(first_here(lines, "session_id", order, takes, most), ["session_id"], order, takes, most)

    asks = F.size("q_tokens") > 0
    plain = q.where(asks).join(first_lines(~F.col("has_tokens")), "session_id").unionByName(q.where(~asks).join(first_lines(), "session_id")).withColumn("asks", asks)
    least = F.when(F.col("asks") & F.col("has_tokens"), F.lit(float(boost))).otherwise(0.0)  # the score if no token is shared
    bare = plain.select(*told, least.alias("score"), holds_focus(F.col("focus"), F.col("entry")).alias("in_entry"))
    gone = used.select("question_id", "source_type", F.col("source_record_id").alias("id"))
    met = filling(q, c, boost, most_chars, most)
    if met is not None:
        words = F.size("q_tokens")
        added = F.when(F.col("in_body"), F.when(F.size(F.filter(F.split("focus", r"\s+"), lambda w: w != "")) >= 2, 0.7).otherwise(0.4)).otherwise(0.0)
        score = F.when((words > 0) & F.col("has_tokens"), F.round(F.col("shared") / words * F.lit(1.6) + F.col("near") / words * F.lit(0.6) + (F.lit(boost) + added), 3)).otherwise(0.0)
        bare = bare.unionByName(met.select(*told, score.alias("score"), "in_entry"))
    once = bare.groupBy("question_id", "source_type", "id").agg(*[F.first(x).alias(x) for x in ("entry", "focus", "in_entry")], F.max("score").alias("score"))
    left = settle(once.join(gone, ["question_id", "source_type", "id"], "left_anti"))
    sorted_by = [F.desc("score"), *placed]
    first = first_filling(left, ["question_id", "source_type"], sorted_by, takes, room)
    kept = first.withColumn("rank", F.row_number().over(Window.partitionBy("question_id", "source_type").orderBy(*sorted_by)))
    about = left.where("in_entry").select("question_id", "source_type").distinct().withColumn("relevant", F.lit(True))
    kept = kept.join(about, ["question_id", "source_type"], "left")
    return kept.select("question_id", "source_type", F.col("id").alias("source_record_id"), "rank", "entry", "score", "focus", F.coalesce("relevant", F.lit(False)).alias("relevant"))


def pack_blocks(title: Column, entries: Column, most_chars: int = BLOCK_CHARS, most_blocks: int = BLOCKS) -> Column:
    """Entries under a title line in blocks of at most most_chars characters, title and line ends counted, also the last one; an
    entry that is too long has a block of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, entry: Column) -> Column:
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(entry) + 2 > most_chars)
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(full | (acc["now"] == ""), F.concat(title, F.lit("\n"), entry)).otherwise(F.concat(acc["now"], F.lit("\n"), entry))
        return F.struct(done.alias("done"), now.alias("now"))

    every = F.aggregate(entries, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))
    return F.slice(every, 1, most_blocks)


def blocks(entries: DataFrame, title: str, most_chars: int = BLOCK_CHARS, most_blocks: int = BLOCKS) -> DataFrame:
    """question_id, order_index, block. entries: question_id, rank, entry, focus, and relevant if that is known."""
    relevant = F.col("relevant") if "relevant" in entries.columns else holds_focus(F.col("focus"), F.col("entry"))
    grouped = entries.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda e: e["entry"]).alias("entries"), F.bool_or(relevant).alias("relevant")
    )
    name = F.when(F.col("relevant"), f"{title} (high relevance)").otherwise(title)
    return grouped.select("question_id", F.posexplode(pack_blocks(name, F.col("entries"), most_chars, most_blocks)).alias("order_index", "block"))


def digests_for(digests: DataFrame, matches: DataFrame, questions: DataFrame, found: DataFrame, most: int = DIGESTS) -> DataFrame:
    """question_id, section, order_index, block: a question's first digests of uploads with a matched unit, or that hold the focus; then its session's.

    digests: id, session_id, asset_id (null for the session's), kind, title, text, created_at; matches: question_id,
    source_type, source_record_id; found: as records gives. A digest with neither meets no question.
    """
    q = questions.select("question_id", "session_id", "focus")
    of_assets = digests.where("kind = 'asset_summary' and asset_id is not null")
    matched = matches.where("source_type = 'evidence_unit'").select("question_id", "source_record_id")
    units = found.where("source_type = 'evidence_unit' and asset_id is not null").select(F.col("id").alias("source_record_id"), "asset_id").join(settle(matched.select("source_record_id").distinct()), "source_record_id", "left_semi").dropDuplicates(["source_record_id"])
    hit = matched.join(units, "source_record_id").join(q.select("question_id", "session_id"), "question_id").select("question_id", "session_id", "asset_id").distinct()
    by_unit = hit.join(of_assets.select("id", "session_id", "asset_id"), ["session_id", "asset_id"]).select("question_id", "id")
    asked = q.where("focus is not null").select("session_id", F.col("question_id").alias("key"), F.col("focus").alias("phrase"))
    by_focus = holding(asked, of_assets.select("session_id", "id", X.normalize(F.concat_ws(" ", "title", "text")).alias("body"))).select(F.col("key").alias("question_id"), "id")
    order = Window.partitionBy("question_id").orderBy("created_at", "id")
    chosen = by_unit.union(by_focus).distinct().join(of_assets.select("id", "title", "text", "created_at"), "id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    first = chosen.select("question_id", F.lit(5).alias("section"), (F.col("n") - 1).alias("order_index"), F.concat(F.lit("Asset digest\n- "), "title", F.lit(": "), "text").alias("block"))
    own = digests.where("kind = 'session_summary'").groupBy("session_id").agg(F.min_by("text", F.struct("created_at", "id")).alias("text"))
    last = q.join(own, "session_id").select("question_id", F.lit(6).alias("section"), F.lit(0).alias("order_index"), F.concat(F.lit("Session digest\n"), "text").alias("block"))
    return first.unionByName(last)


def answer_evidence(questions: DataFrame, matches: DataFrame, tables: dict[str, DataFrame], profile: str = "development") -> DataFrame:
    """question_id, section, order_index, block: all that an answer may be drawn from, in the order of section and order_index.

    First the best matches from their whole records, then blocks of what else the session has: units, terms, materials,
    transcript; then digests. questions: as prepare_questions gives; matches: as merge_matches gives, and settled.
    """
    limits = PROFILES[profile]
    found = settle(records(tables))
    out = focused(matches, found, limits["focused"]).select("question_id", F.lit(0).alias("section"), "order_index", "block")
    for section, (kind, (_, title, boost)) in enumerate(TITLES.items(), 1):
        chars, most = limits[kind]
        left = remaining(questions, found.where(F.col("source_type") == kind).drop("asset_id"), matches, boost, chars, most)
        packed = settle(blocks(left, title, chars, most))  # a few blocks a question: what was shuffled for one kind is gone before the next
        out = out.unionByName(packed.select("question_id", F.lit(section).alias("section"), "order_index", "block"))
    if "asset_digests" in tables:
        out = out.unionByName(digests_for(tables["asset_digests"], matches, questions, found))
    return out


def visual_evidence(questions: DataFrame, matches: DataFrame, units: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """question_id, tier, id, uri, caption: the first matched unit with a preview; only for questions without one, the best of the session's
    units with a preview that score VISUAL_LEAST or hold the focus (equal scores by title, then id).

    questions: as prepare_questions gives; units: with preview_uri; assets: id and file_name.
    """
    seen = units.where("preview_uri is not null and preview_uri <> ''")
    matched = matches.where("source_type = 'evidence_unit'").select("question_id", "rank", F.col("source_record_id").alias("id")).join(seen.select("id").distinct(), "id", "left_semi")
    first = settle(matched.groupBy("question_id").agg(F.min_by("id", "rank").alias("id")).select("question_id", F.lit(0).alias("tier"), "id"))
    rest = questions.join(first, "question_id", "left_anti")
    c = seen.select("session_id", "id", "title", F.concat_ws(" ", "title", "search_text").alias("body"), F.concat_ws(" ", "title", "content_text").alias("content")).withColumn("c_tokens", X.unique(X.tokenize("body")))
    asked = rest.where("focus is not null").select("session_id", F.col("question_id").alias("key"), F.col("focus").alias("phrase"))
    held = holding(asked, c.select("session_id", "id", X.normalize(F.concat_ws("\n", "body", "content")).alias("body"))).select(F.col("key").alias("question_id"), "id")
    pairs = sharing(rest, c, VISUAL_LEAST, VISUAL_BOOST).union(held).distinct()
    scored = pairs.join(rest.select("question_id", "focus", "q_tokens"), "question_id").join(c, "id").withColumn("score", text_score(F.col("q_tokens"), F.col("c_tokens"), F.lit(VISUAL_BOOST) + focus_boost(F.col("focus"), F.col("body"))))
    good = scored.where((F.col("score") >= VISUAL_LEAST) | holds_focus(F.col("focus"), F.col("content")))
    second = good.groupBy("question_id").agg(F.min_by("id", F.struct(-F.col("score"), F.collate("title", "UNICODE"), "id")).alias("id")).select("question_id", F.lit(1).alias("tier"), "id")
    chosen = settle(first.unionByName(second))
    full = chosen.join(seen.join(chosen.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "id")
    if assets is not None:
        full = full.join(assets.select(F.col("id").alias("asset_id"), F.col("file_name").alias("_file")), "asset_id", "left")
    file = F.when(F.coalesce(_or_null(full, "_file"), F.lit("")) != "", F.concat(F.lit("File: "), _or_null(full, "_file"), F.lit(".")))
    page, slide, frame, start = (_or_null(full, x) for x in ("page_number", "slide_number", "frame_label", "timestamp_start_seconds"))
    spot = F.when(page.isNotNull(), F.concat(F.lit("Page "), page, F.lit("."))).when(slide.isNotNull(), F.concat(F.lit("Slide "), slide, F.lit(".")))
    time = F.when(start.isNotNull(), _place(full.select(*[x for x in full.columns if x.startswith("timestamp")]))) if "timestamp_start_seconds" in full.columns else F.lit(None).cast("string")
    caption = F.concat_ws(" ", "title", file, spot, F.when(F.coalesce(frame, F.lit("")) != "", F.concat(frame, F.lit("."))), time, "excerpt")
    return full.select("question_id", "tier", "id", F.col("preview_uri").alias("uri"), caption.alias("caption"))


def prompt(question: Column, evidence: Column, most: int = 12, clip: int = 1000) -> Column:
    """Numbered, clipped evidence, the question and the rules."""
    numbered = F.transform(F.slice(evidence, 1, most), lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), X.excerpt(e, clip)))
    return F.concat_ws("\n", F.lit("Evidence:"), F.array_join(numbered, "\n"), F.concat(F.lit("Question: "), question), *[F.lit(f"- {r}") for r in ANSWER_RULES])


def first_of(df: DataFrame, key: str, order: list, most: int, as_: str, text: Column) -> DataFrame:
    """Per key the texts of the first rows, in order."""
    w = Window.partitionBy(key).orderBy(*order)
    some = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return some.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", text.alias("x")))), lambda p: p["x"]).alias(as_))


def summaries(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Three summaries per session from its first three chunks and two transcript entries.

    chunks: session_id, id, heading, keywords, text, order_index; order_index: the place within the session, as reads.chunks_in_order ranks
    chunks whose own is that within their material; entries: session_id, id, text, order_index.
    """
    said = first_of(chunks, "session_id", ["order_index", "id"], 3, "chunks", F.col("text"))
    heard = first_of(entries, "session_id", ["order_index", "id"], 2, "entries", F.col("text"))
    heads = first_of(chunks, "session_id", ["order_index", "id"], 8, "heads", F.concat(F.array(X.without_end_marks("heading")), F.col("keywords")))
    both = said.join(heard, "session_id", "full_outer").join(heads, "session_id", "left")
    none = F.array().cast("array<string>")
    evidence = F.concat(F.coalesce("chunks", none), F.coalesce("entries", none))
    topics = F.filter(F.array_distinct(F.transform(F.flatten(F.coalesce("heads", F.array().cast("array<array<string>>"))), X.strip)), lambda t: t != "")
    clipped = F.transform(F.slice(evidence, 1, 3), lambda e: X.sentence(X.excerpt(X.collapse(e), 140)))
    kinds = F.array(
        F.struct(F.lit("overview").alias("kind"), F.concat(F.lit("This session covers "), X.spoken_list(F.slice(topics, 1, 4)), F.lit(". "), F.array_join(clipped, " ")).alias("text")),
        F.struct(F.lit("key_points").alias("kind"), F.array_join(F.transform(clipped, lambda e: F.concat(F.lit("- "), e)), "\n").alias("text")),
        F.struct(F.lit("exam_focus").alias("kind"), F.concat(F.lit("Review "), X.spoken_list(F.slice(topics, 1, 3)), F.lit(".")).alias("text")),
    )
    return both.select("session_id", F.explode(kinds).alias("s")).select("session_id", "s.kind", "s.text")


def asset_digests(units: DataFrame, most: int = 4) -> DataFrame:
    """Per asset the excerpts of its first units."""
    some = first_of(units, "asset_id", ["order_index", "id"], most, "parts", X.collapse("excerpt"))
    owner = units.groupBy("asset_id").agg(F.min("session_id").alias("session_id"))
    return some.join(owner, "asset_id").select("session_id", "asset_id", F.lit("asset_summary").alias("kind"), F.array_join("parts", " ").alias("text"))


def session_digests(digests: DataFrame, most_chars: int | None = 420) -> DataFrame:
    """Per session its asset digests in order, each clipped; most_chars None leaves them whole."""
    text = F.col("text") if most_chars is None else X.excerpt("text", most_chars)
    parts = F.array_sort(F.collect_list(F.struct("asset_id", text.alias("x"))))
    return digests.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "\n\n").alias("text")).withColumn("kind", F.lit("session_summary"))
