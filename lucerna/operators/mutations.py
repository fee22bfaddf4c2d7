"""Changes to tables as new tables (M1-M11): unions, latest-wins windows and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.operators.schema import PARENTS
from lucerna.sources.tables import settle

#: States of an upload from least to most.
STATUS_ORDER = ["failed", "pending", "processing", "ready"]


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """M1: rows of incoming replace rows with their key; of several incoming ones the last by `order` wins."""
    if order:
        w = Window.partitionBy(*key).orderBy(F.desc(order))
        incoming = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return current.join(incoming.select(*key).distinct(), key, "left_anti").select(*current.columns).unionByName(incoming)


def upsert_digest(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """M2: by asset and kind, where a match changes title, text and updated_at only; a session's digest is replaced."""
    new = incoming.where("asset_id is not null").select("asset_id", "kind", F.col("title").alias("_title"), F.col("text").alias("_text"), F.col("updated_at").alias("_at"))
    changed = current.join(new, ["asset_id", "kind"], "left")
    for column, source in (("title", "_title"), ("text", "_text"), ("updated_at", "_at")):
        changed = changed.withColumn(column, F.coalesce(source, column))
    changed = changed.drop("_title", "_text", "_at")
    added = incoming.where("asset_id is not null").join(current.select("asset_id", "kind"), ["asset_id", "kind"], "left_anti")
    sessions = incoming.where("asset_id is null")
    kept = changed.join(sessions.select("session_id", "kind", F.lit(True).alias("_new")), ["session_id", "kind"], "left").where("asset_id is not null or _new is null").drop("_new")
    return kept.unionByName(added).unionByName(sessions)


def set_status(assets: DataFrame, updates: DataFrame) -> DataFrame:
    """M3. updates: id, status, error_message, indexed_at, updated_at; what is left out becomes null."""
    u = updates.select("id", *[F.col(c).alias("_" + c) for c in ("status", "error_message", "indexed_at", "updated_at")], F.lit(True).alias("_hit"))
    out = assets.join(u, "id", "left")
    for c in ("status", "error_message", "indexed_at", "updated_at"):
        out = out.withColumn(c, F.when(F.col("_hit"), F.col("_" + c)).otherwise(F.col(c)))
    return out.select(*assets.columns)


def delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """M4, M5: tables without these rows and without their children, or with the children's reference emptied."""
    out = dict(tables)
    gone = {table: ids.select("id").distinct()}
    out[table] = out[table].join(gone[table], "id", "left_anti")
    for child, parents in PARENTS.items():  # parents stand before their children
        if child not in out:
            continue
        for column, parent, action in parents:
            if parent not in gone:
                continue
            lost = gone[parent].select(F.col("id").alias(column))
            if action == "cascade":
                removed = out[child].join(lost, column, "left_semi").select("id")
                gone[child] = gone[child].union(removed).distinct() if child in gone else removed
                out[child] = out[child].join(lost, column, "left_anti")
            else:
                hit = lost.withColumn("_gone", F.lit(True))
                out[child] = out[child].join(hit, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*tables[child].columns)
    return out


def toggle_bookmarks(current: DataFrame, presses: DataFrame) -> DataFrame:
    """M6: each press of a target adds its bookmark or takes it away: an odd number changes its state.

    current: session_id, target_type, target_id, label; presses: the same and at.
    """
    key = ["session_id", "target_type", "target_id"]
    pressed = presses.groupBy(*key).agg(F.count("*").alias("n"), F.max_by("label", "at").alias("_label"))
    both = current.withColumn("_has", F.lit(True)).join(pressed, key, "full_outer")
    stands = F.col("_has").isNotNull() != (F.coalesce("n", F.lit(0)) % 2 == 1)
    return both.where(stands).select(*key, F.coalesce("label", "_label").alias("label"))


def new_notes(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: notes that can be made (anchored to the session by default) and requests that can't be, with a reason."""
    r = requests.withColumn("anchor_type", F.coalesce("anchor_type", F.lit("session"))).withColumn("content", X.strip("content"))
    reason = F.when(F.coalesce("content", F.lit("")) == "", "empty").when((F.col("anchor_type") != "session") & F.col("anchor_id").isNull(), "no anchor")
    judged = r.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason").withColumn("id", X.stable_id("session_id", "content", "created_at")), judged.where("reason is not null")


def append_rows(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key isn't there yet, numbered on from the session's last."""
    new = incoming.join(current.select(*key).distinct(), key, "left_anti")
    last = current.groupBy("session_id").agg((F.max("order_index") + 1).alias("_next"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("order_index", *[k for k in key if k != "session_id"])) - 1
    numbered = new.withColumn("order_index", rank).join(last, "session_id", "left").withColumn("order_index", (F.col("order_index") + F.coalesce("_next", F.lit(0))).cast("int")).drop("_next")
    return current.unionByName(numbered.select(*current.columns))


def put_first(current: DataFrame, incoming: DataFrame, key: list[str], order: str, within: str = "session_id") -> DataFrame:
    """Incoming rows in front of a session's list, in their order; what had their keys leaves it. Gives a place from 0."""
    left = current.join(incoming.select(*key).distinct(), key, "left_anti").withColumn("_late", F.lit(1))
    both = incoming.withColumn("_late", F.lit(0)).unionByName(left)
    place = F.row_number().over(Window.partitionBy(within).orderBy("_late", order, *[k for k in key if k != within])) - 1
    return both.withColumn("place", place).drop("_late")


def numbered_on(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both, the incoming rows' order_index counted on from the session's last."""
    last = current.groupBy("session_id").agg((F.max("order_index") + 1).alias("_next"))
    moved = incoming.join(last, "session_id", "left").withColumn("order_index", F.col("order_index") + F.coalesce("_next", F.lit(0)))
    return current.unionByName(moved.select(*current.columns))


def _first_seen(by: str):
    """Distinct elements of array column `by`, over the rows of a group in the order of order_index and id."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "id", F.col(by).alias("x")))), lambda r: r["x"])))


def append_pack(current: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of packs join sessions that exist; incoming rows have those sessions' ids.

    A session takes the version, the tags in addition and the time of change; materials and transcripts are numbered on;
    a known term takes the longer definition and all aliases, new ones are numbered on; known categories stay and
    questions point to them; summaries of a known kind take the new title and text; all other rows are added. Incoming
    rows of one term count as one; a table in one argument only is taken as it is.
    """
    both = set(current) & set(incoming)
    out = {**incoming, **current}
    for name in both - {"lecture_sessions", "glossary_terms", "qa_categories", "summaries", "questions"}:
        out[name] = numbered_on(current[name], incoming[name]) if name in ("lecture_materials", "transcript_entries") else current[name].unionByName(incoming[name])
    if "lecture_sessions" in both:
        i = incoming["lecture_sessions"].select("id", F.col("source_pack_version").alias("_version"), F.col("tags").alias("_tags"), F.col("updated_at").alias("_at"))
        s = current["lecture_sessions"].join(i, "id", "left")
        tags = F.when(F.col("_tags").isNull(), F.col("tags")).otherwise(F.array_distinct(F.concat("tags", "_tags")))
        out["lecture_sessions"] = s.withColumns({"tags": tags, "source_pack_version": F.coalesce("_version", "source_pack_version"), "updated_at": F.coalesce("_at", "updated_at")}).select(*current["lecture_sessions"].columns)
    if "glossary_terms" in both:
        out["glossary_terms"] = _append_glossary(current["glossary_terms"], incoming["glossary_terms"])
    if "summaries" in both:
        i = incoming["summaries"].select("session_id", "kind", F.col("title").alias("_title"), F.col("text").alias("_text"), F.col("updated_at").alias("_at"))
        s = current["summaries"].join(i, ["session_id", "kind"], "left").withColumns({c: F.coalesce("_" + x, c) for c, x in (("title", "title"), ("text", "text"), ("updated_at", "at"))})
        new = incoming["summaries"].join(current["summaries"].select("session_id", "kind"), ["session_id", "kind"], "left_anti")
        out["summaries"] = s.select(*current["summaries"].columns).unionByName(new.select(*current["summaries"].columns))
    if "qa_categories" in both:
        c, i = current["qa_categories"], incoming["qa_categories"]
        known = c.groupBy("session_id", "key").agg(F.min_by("id", F.struct("created_at", "id")).alias("_known"))
        mapped = i.join(known, ["session_id", "key"], "left")
        out["qa_categories"] = c.unionByName(mapped.where("_known is null").select(*c.columns))
        if "questions" in incoming:
            to = mapped.select("session_id", F.col("id").alias("category_id"), F.coalesce("_known", "id").alias("_to"))
            q = incoming["questions"].join(to, ["session_id", "category_id"], "left").withColumn("category_id", F.col("_to")).select(*incoming["questions"].columns)
            out["questions"] = current["questions"].unionByName(q) if "questions" in current else q
    elif "questions" in both:
        out["questions"] = current["questions"].unionByName(incoming["questions"])
    return out


def _append_glossary(current: DataFrame, incoming: DataFrame) -> DataFrame:
    size = F.struct(F.length("definition"), -F.col("order_index"))
    rows = incoming.withColumn("_norm", X.normalize("term"))
    one = rows.groupBy("session_id", "_norm").agg(
        F.min_by("id", F.struct("order_index", "id")).alias("id"), F.min_by("term", F.struct("order_index", "id")).alias("term"), F.max_by("definition", size).alias("definition"), _first_seen("aliases").alias("aliases"),
        F.min("order_index").alias("order_index"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
    )
    i = one.select("session_id", "_norm", F.col("definition").alias("_definition"), F.col("aliases").alias("_aliases"), F.col("updated_at").alias("_at"))
    c = current.withColumn("_norm", X.normalize("term")).join(i, ["session_id", "_norm"], "left")
    longer = F.length("_definition") > F.length("definition")
    aliases = F.when(F.col("_aliases").isNull(), F.col("aliases")).otherwise(F.array_distinct(F.concat("aliases", "_aliases")))
    changed = F.coalesce(longer, F.lit(False)) | (F.size(aliases) > F.size("aliases"))
    c = c.withColumns({"definition": F.when(longer, F.col("_definition")).otherwise(F.col("definition")), "aliases": aliases, "updated_at": F.when(changed, F.col("_at")).otherwise(F.col("updated_at"))})
    new = one.join(current.select("session_id", X.normalize("term").alias("_norm")), ["session_id", "_norm"], "left_anti")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("order_index", "id")) - 1
    return numbered_on(c.select(*current.columns), new.withColumn("order_index", place).select(*current.columns))


def most_advanced(assets: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per key the state furthest on, and of equal ones the last by `order`."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    return assets.groupBy(*key).agg(F.max_by("status", F.struct(rank, order)).alias("status"))


def ordered_union(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Per key the distinct values in the order in which they first stood; each value shrinks to one row first."""
    first = rows.groupBy(*key, value).agg(F.min(order).alias("_first"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda r: r[value]).alias(value))


def session_ranks(sessions: DataFrame, preferred: str | None) -> DataFrame:
    """session_id, _rank from 0: the preferred session first, then by O1. One row a session is numbered in one task."""
    order = Window.partitionBy().orderBy(F.coalesce(F.col("id") != F.lit(preferred), F.lit(True)), F.desc("starts_at"), "title", "id")
    return settle(sessions.select(F.col("id").alias("session_id"), (F.row_number().over(order) - 1).alias("_rank")))


def _offsets(sizes: DataFrame) -> DataFrame:
    """_rank, _base: of sizes (_rank, n) the sum of those before. A row a session."""
    before = F.sum("n").over(Window.partitionBy().orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("_base", F.coalesce(before, F.lit(0))).select("_rank", "_base")


def _moved_on(rows: DataFrame) -> DataFrame:
    """rows (with _rank) with order_index counted on from session to session; sums over sessions, so no row meets another."""
    base = _offsets(rows.groupBy("_rank").agg((F.max("order_index") + 1).alias("n")))
    return rows.join(base, "_rank").withColumn("order_index", (F.col("order_index") + F.col("_base")).cast(rows.schema["order_index"].dataType)).drop("_base")


def _merged_terms(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of all sessions by name: the first's row with the longest definition and all aliases; new ones numbered on. Also old id to id."""
    at = F.struct("_rank", "order_index", "id")
    named = rows.withColumn("_norm", X.normalize("term"))
    longest = F.struct(F.length("definition"), -F.col("_rank"), -F.col("order_index"))
    plain = [c for c in rows.columns if c not in ("aliases", "definition", "updated_at", "id")]
    has = lambda c: c in rows.columns
    one = named.groupBy("_norm").agg(F.min_by("id", at).alias("id"), *[F.min_by(c, at).alias(c) for c in plain], F.max_by("definition", longest).alias("definition"), *([F.max("updated_at").alias("updated_at")] if has("updated_at") else []))
    if has("aliases"):
        each = named.select("_norm", "_rank", "order_index", "id", F.posexplode("aliases").alias("_i", "alias"))
        first = each.groupBy("_norm", "alias").agg(F.min(F.struct("_rank", "order_index", "id", "_i")).alias("_at"))
        listed = first.groupBy("_norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "alias"))), lambda x: x["alias"]).alias("aliases"))
        one = one.join(listed, "_norm", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    place = F.row_number().over(Window.partitionBy("_rank").orderBy("order_index", "id")) - 1
    own = one.where("_rank = 0")
    more = one.where("_rank > 0").withColumn("order_index", place.cast(rows.schema["order_index"].dataType))
    sizes = more.groupBy("_rank").agg(F.count("*").alias("n")).unionByName(own.agg(F.lit(0).alias("_rank"), F.coalesce(F.max("order_index") + 1, F.lit(0)).cast("long").alias("n")))
    more = more.join(_offsets(sizes), "_rank").withColumn("order_index", (F.col("order_index") + F.col("_base")).cast(rows.schema["order_index"].dataType)).drop("_base")
    to = named.select(F.col("id").alias("old"), "_norm").join(one.select("_norm", F.col("id").alias("new")), "_norm").where("old <> new").select("old", "new")
    return own.unionByName(more).drop("_norm"), to


def _merged_assets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets of all sessions by kind and name: those of the first session with a name stay; of them the last made takes in
    all of later sessions: their newest type, extension, checksum, size, message and time, and the state furthest on. Also old id to id."""
    key = ["_kind", "_name"]
    named = rows.withColumn("_kind", F.coalesce("source_kind", F.lit(""))).withColumn("_name", X.normalize("file_name"))
    at = F.struct("created_at", "file_name", "id")
    first = named.groupBy(*key).agg(F.min("_rank").alias("_first"))
    heads = named.join(first, key).where("_rank = _first").groupBy(*key).agg(F.max_by("id", at).alias("new"), F.first("_first").alias("_first"))
    with_head = named.join(heads, key)
    later = F.struct("_rank", "created_at", "file_name", "id")
    mine = with_head.where("id = new or _rank > _first")
    state = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    newest = [c for c in ("media_type", "source_extension", "checksum", "size_bytes", "error_message", "indexed_at", "updated_at") if c in rows.columns]
    taken = mine.groupBy("new").agg(F.max_by("status", F.struct(state, later)).alias("_status"), *[F.max_by(c, F.when(F.col(c).isNotNull(), later)).alias(f"_{c}") for c in newest])
    kept = with_head.where("_rank = _first").join(taken.withColumnRenamed("new", "_of"), F.col("id") == F.col("_of"), "left")
    kept = kept.withColumns({"status": F.coalesce("_status", "status"), **{c: F.when(F.col("_of").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in newest}})
    return kept.select(*rows.columns), with_head.where("_rank > _first").select(F.col("id").alias("old"), "new")


def _mapped(rows: DataFrame, column: str, to: DataFrame, when: Column | None = None) -> DataFrame:
    """rows with the ids of a column replaced by those they went to."""
    hit = rows.join(to.select(F.col("old").alias("_old"), F.col("new").alias("_new")), (F.col(column) == F.col("_old")) & (F.lit(True) if when is None else when), "left")
    return hit.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def consolidate(tables: dict[str, DataFrame], preferred: str | None, now: str | None = None) -> dict[str, DataFrame]:
    """All sessions into the preferred one (else the first by O1), in one pass with sessions ranked in that order.

    What goes into another row leaves a pair of ids, and every reference to it follows: terms (one a name, the longest
    definition, all aliases), categories (one a key), uploads (one a kind and name, from the first session that has it). So
    questions follow categories; sources, notes and bookmarks follow terms; units and digests follow uploads. Bookmarks are
    freed of repeats after that. Summaries and digests of one kind keep the first row with the last one's title and text;
    materials, transcripts and new terms are numbered on; questions of other sessions without an answer are left out; the
    session takes all tags, and its digest is written anew from the uploads' digests in their order.

    now: the time of change; without it the latest there is. With one session or none nothing changes.
    """
    sessions = tables["lecture_sessions"]
    rank = session_ranks(sessions, preferred)
    found = rank.where("_rank < 2").collect()
    if len(found) < 2:
        return dict(tables)
    target = next(r.session_id for r in found if r["_rank"] == 0)
    ranked = {name: df.join(rank, "session_id").withColumn("session_id", F.lit(target)) for name, df in tables.items() if name != "lecture_sessions"}
    terms = assets = categories = None
    if "glossary_terms" in ranked:
        ranked["glossary_terms"], terms = _merged_terms(ranked["glossary_terms"])
        terms = settle(terms)
    if "uploaded_assets" in ranked:
        ranked["uploaded_assets"], assets = _merged_assets(ranked["uploaded_assets"])
        assets = settle(assets)
    for name in ("lecture_materials", "transcript_entries"):
        if name in ranked:
            ranked[name] = _moved_on(ranked[name])
    if "qa_categories" in ranked:
        c = ranked["qa_categories"]
        stays = c.groupBy("key").agg(F.min_by("id", F.struct("_rank", "created_at", "id")).alias("new"))
        categories = settle(c.select("key", F.col("id").alias("old")).join(stays, "key").where("old <> new").select("old", "new"))
        ranked["qa_categories"] = c.join(stays.select(F.col("new").alias("id")), "id", "left_semi")
    if "questions" in ranked:
        q = ranked["questions"]
        if "answers" in tables:
            answered = tables["answers"].select(F.col("question_id").alias("id"))
            q = q.where("_rank = 0").unionByName(q.where("_rank > 0").join(answered, "id", "left_semi"))
        ranked["questions"] = _mapped(q, "category_id", categories) if categories is not None else q
    if "summaries" in ranked:
        ranked["summaries"] = _last_text(ranked["summaries"], ["kind"], ["_rank", "id"])
    if terms is not None:
        for name, column, kind in (("answer_sources", "source_record_id", "source_type"), ("notes", "anchor_id", "anchor_type"), ("bookmarks", "target_id", "target_type")):
            if name in ranked:
                ranked[name] = _mapped(ranked[name], column, terms, F.col(kind) == "glossary_term")
    if "bookmarks" in ranked:
        marks = ranked["bookmarks"]
        w = Window.partitionBy("target_type", "target_id").orderBy("_rank", F.desc("created_at"), "id") if "created_at" in marks.columns else Window.partitionBy("target_type", "target_id").orderBy("_rank", "id")
        ranked["bookmarks"] = marks.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    if assets is not None:
        for name in ("evidence_units", "asset_digests"):
            if name in ranked:
                ranked[name] = _mapped(ranked[name], "asset_id", assets)
    if "asset_digests" in ranked:
        every = ranked["asset_digests"]
        of_assets = settle(_last_text(every.where("asset_id is not null"), ["asset_id", "kind"], ["_rank", "created_at", "id"]))
        own = every.where("asset_id is null and _rank = 0")
        latest = F.lit(now) if now else F.max("updated_at")
        parts = F.array_sort(F.collect_list(F.struct("created_at", "id", F.concat_ws("\n", "title", "text").alias("x"))))
        text = F.array_join(F.transform(parts, lambda p: p["x"]), "\n\n")
        made = of_assets.where("kind = 'asset_summary'").groupBy("session_id").agg(text.alias("text"), latest.alias("updated_at")).withColumns(
            {"id": X.stable_id(F.lit("asset_digest"), "session_id"), "asset_id": F.lit(None).cast("string"), "kind": F.lit("session_summary"), "title": F.lit("Workspace session digest"), "created_at": F.col("updated_at")}
        )
        columns = tables["asset_digests"].columns
        kept_own = own.join(made.select("session_id"), "session_id", "left_anti")
        ranked["asset_digests"] = of_assets.select(*columns).unionByName(made.select(*columns)).unionByName(kept_own.select(*columns))
    out = {name: df.select(*tables[name].columns) for name, df in ranked.items()}
    if "tags" in sessions.columns:
        at = sessions.join(rank, sessions["id"] == rank["session_id"]).select("_rank", F.posexplode("tags").alias("_i", "tag"))
        first = at.groupBy("tag").agg(F.min(F.struct("_rank", "_i")).alias("_at"))
        tags = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "tag"))), lambda x: x["tag"]).alias("_tags"))
        sessions = sessions.where(F.col("id") == target).join(tags).withColumn("tags", F.col("_tags")).drop("_tags")
    out["lecture_sessions"] = sessions.where(F.col("id") == target).select(*tables["lecture_sessions"].columns)
    return out


def _last_text(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first, with the title, text and time of change of the last."""
    at = F.struct(*order)
    last = [c for c in ("title", "text", "updated_at") if c in rows.columns]
    return rows.groupBy(*key).agg(*[F.min_by(c, at).alias(c) for c in rows.columns if c not in (*last, *key)], *[F.max_by(c, at).alias(c) for c in last])


def replace_session(current: DataFrame, incoming: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """A pack's rows take the place of all rows of its session, also in tables of which it has no row.

    sessions: the packs' session_id; without it, those of the incoming rows.
    """
    replaced = incoming.select("session_id").distinct() if sessions is None else sessions
    return current.join(replaced, "session_id", "left_anti").select(*current.columns).unionByName(incoming)


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """M11."""
    return {name: df.limit(0) for name, df in tables.items()}
