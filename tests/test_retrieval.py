"""Rules that are easy to mend by accident, and independence of the partitioning."""

from lucerna.functions import text as X
from lucerna.operators import context, decide, retrieval, search_index
from lucerna.plans.queries import QUERIES
from pyspark.sql import functions as F
from tests.conftest import SF


def test_better_rank_scores_lower_and_never_under_one(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (2.0,), (9.0,)], "r double")
    got = [x.s for x in df.select(retrieval.evidence_score(F.col("r"), F.lit(None).cast("string"), F.lit("x"), F.lit("text")).alias("s")).collect()]
    assert got == [16.0, 8.0, 2.0, 1.0]


def test_boost_is_ignored_without_tokens(spark):
    empty = F.array().cast("array<string>")
    assert spark.range(1).select(retrieval.text_score(empty, F.array(F.lit("a")), F.lit(1.4)).alias("s")).first()["s"] == 0.0


def test_category_words_count_inside_words(spark):
    q = spark.createDataFrame([("q1", "s", "because of it"), ("q2", "s", "zzz")], "question_id string, session_id string, question string")
    c = spark.createDataFrame([("c1", "s", "logistics", "1", "L"), ("c2", "s", "applications", "2", "A")], "id string, session_id string, key string, created_at string, label string")
    assert {r.question_id: r.category_id for r in decide.categorize(q, c).collect()} == {"q1": "c2", "q2": "c1"}


def test_focus(spark):
    df = spark.createDataFrame([("What is  a Cell ??",), ("Define x",), ("Why so",), ("what does it mean?",)], "q string")
    assert [r.f for r in df.select(retrieval.focus(F.col("q")).alias("f")).collect()] == ["a cell", "x", None, "it"]


def test_ranks_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = {tuple(r) for r in QUERIES["R13_O15_L2_top_matches"](spark, SF).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert {tuple(r) for r in QUERIES["R13_O15_L2_top_matches"](spark, SF).collect()} == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_top_k_keeps_only_k_rows_before_the_window(spark):
    plan = QUERIES["R13_O15_L2_top_matches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_bm25_gives_every_hit_without_a_limit(spark):
    q = spark.createDataFrame([("q1", "s", "ab cd")], "question_id string, session_id string, question string")
    units = spark.createDataFrame([(f"u{k}", "s", "ab", "", f"abc {k}", "") for k in range(50)], "id string, session_id string, title string, excerpt string, content_text string, search_text string")
    every = retrieval.bm25(q, units, most=None)
    assert {r.id for r in every.collect()} == {f"u{k}" for k in range(50)}
    assert {(r.id, r.rank) for r in retrieval.bm25(q, units, most=3).collect()} <= {(r.id, r.rank) for r in every.collect()}
    plan = QUERIES["R9_R10_J2_bm25"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_context_packs_every_line_that_has_room(spark):
    """Very short entries: blocks are as those of all lines, sorted and packed one by one."""
    q = spark.createDataFrame([("q1", "s", "What is tin?")], "question_id string, session_id string, question string")
    rows = [(f"t{k:03}", "s", "transcript_entry", f"U: {k:03}", f"{k:03}") for k in range(900)] + [("long", "s", "transcript_entry", "A" * 400, "tin"), ("gone", "s", "transcript_entry", "B", "tin")]
    c = spark.createDataFrame(rows, "id string, session_id string, source_type string, entry string, body string")
    used = spark.createDataFrame([("q1", "transcript_entry", "gone")], "question_id string, source_type string, source_record_id string")
    left = context.remaining(retrieval.prepare_questions(q), c, used, 0.05, 300, 3)
    got = [r.block for r in context.blocks(left, "T", 300, 3).orderBy("order_index").collect()]
    want, now = [], ""
    for entry in ["A" * 400] + [f"U: {k:03}" for k in range(900)]:
        if now and len(now) + len(entry) + 2 > 300:
            want.append(now)
            now = ""
        now = f"{now or 'T'}\n{entry}"
    assert got == want[:3] and sum(b.count("U: ") for b in got) > 50


def test_context_has_all_kinds(spark):
    out = QUERIES["B1_B5_context_blocks"](spark, SF).select("section").distinct()
    assert {r.section for r in out.collect()} == {0, 1, 2, 3, 4, 5, 6}


UNIT = "id string, session_id string, asset_id string, title string, excerpt string, content_text string, search_text string"


def test_diacritics_fold_as_in_a_full_text_index(spark):
    """All letters of the Latin blocks, alone and with combining marks, against SQLite's tokenizer."""
    import sqlite3
    import unicodedata

    letters = [chr(c) for c in [*range(0xC0, 0x250), *range(0x300, 0x332), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(c))[0] in "LM"]
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(x)")
    c.execute("create virtual table v using fts5vocab(t, 'instance')")
    texts = [f"a{x}b {x}" for x in letters]
    c.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts)))
    want = {k: [] for k in range(len(texts))}
    for term, doc in c.execute("select term, doc from v order by doc, offset"):
        want[doc].append(term)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
    got = {r.n: r.w for r in df.select("n", search_index.words("x").alias("w")).collect()}
    ascii_of = lambda found: [t for t in found if t.isascii()]  # noqa: E731  a prefix that is asked for is ASCII
    # a mark alone is a token there, but no prefix can ask for it; ligatures and letters newer than its tables stay
    assert {k for k in got if ascii_of(got[k]) != ascii_of(want[k])} == set()


def test_words_without_diacritics_are_found(spark):
    q = spark.createDataFrame([("q1", "s", "cafe"), ("q2", "s", "uber senor"), ("q3", "s", "café")], "question_id string, session_id string, question string")
    rows = [("u1", "Café"), ("u2", "cafe\u0301s"), ("u3", "Über"), ("u4", "SEÑORA"), ("u5", "nothing"), ("u6", "strasse stra\u00dfe")]
    units = spark.createDataFrame([(i, "s", "a", "", "", t, "") for i, t in rows], UNIT)
    found = {}
    for r in retrieval.bm25(q, units).collect():
        found.setdefault(r.question_id, set()).add(r.id)
    assert found == {"q1": {"u1", "u2"}, "q2": {"u3", "u4"}, "q3": {"u1", "u2"}}


def _sqlite(units, question, session, most=18):
    """What the reference's index gives: ids by falling absolute rank."""
    import sqlite3

    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(id unindexed, session_id unindexed, title, excerpt, content_text, search_text)")
    c.executemany("insert into t values (?, ?, ?, ?, ?, ?)", units)
    words = [w for w in "".join(x if x.isascii() and x.isalnum() else " " for x in question.lower()).split() if len(w) > 1][:8]
    rows = c.execute("select id, abs(bm25(t, 6.0, 1.0, 1.0, 0.5)) from t where t match ? and session_id = ? order by 2 desc limit ?", (" OR ".join(f"{w}*" for w in words), session, most))
    return {(i, round(r, 6)) for i, r in rows}


def test_index_in_segments_equals_one_built_anew(spark, tmp_path):
    """After appends, assets written again, deletions and compaction; and equals SQLite's ranks."""
    import random

    r = random.Random(3)
    vocabulary = ["tin", "tinder", "tint", "Ärger", "argen", "élan", "elanes", "one", "once", "zebra", "x9", "日本"]
    texts = lambda: tuple(" ".join(r.choices(vocabulary, k=r.randint(0, 9))) for _ in range(4))
    asset = lambda a: [(f"{a}_{k}", "s0", a, *texts()) for k in range(3)]
    root, now = str(tmp_path / "index"), {}
    q = spark.createDataFrame([("q1", "s0", "tin élan one"), ("q2", "s0", "on on arg"), ("q3", "s0", "none ?"), ("q4", "other", "tin"), ("q5", "s0", "a")], "question_id string, session_id string, question string")

    def write(number, assets):
        rows = [u for a in assets for u in asset(a)]
        now.update({a: [u for u in rows if u[2] == a] for a in assets})
        df = spark.createDataFrame(rows, UNIT)
        for _ in range(2):  # a batch that runs again
            search_index.write_segment(root, number, df, df.select("asset_id", F.lit(False).alias("deleted")))

    def same():
        live = [u for us in now.values() for u in us]
        found = lambda df: {(x.question_id, x.id, round(x.rank, 6), x.place) for x in df.collect()}
        got = found(search_index.search(q, search_index.load(spark, root), 18))
        assert got == found(retrieval.bm25(q, spark.createDataFrame(live, UNIT)))
        for name, text in (("q1", "tin élan one"), ("q2", "on on arg")):
            assert {(i, s) for k, i, s, _ in got if k == name} == _sqlite([(u[0], u[1], *u[3:]) for u in live], text, "s0", 1000) or len(live) > 18
        assert got

    write(0, ["a1", "a2", "a3"])
    same()
    write(10, ["a2", "a4"])
    same()
    search_index.delete_assets(root, spark.createDataFrame([("a1",)], "asset_id string"))
    del now["a1"]
    same()
    search_index.compacted(spark, root)
    same()
    write(20, ["a1", "a4"])
    same()
    search_index.delete_assets(root, spark.createDataFrame([("a1",), ("a2",), ("a4",)], "asset_id string"))
    for a in ("a1", "a2", "a4"):
        del now[a]
    same()


def test_an_index_of_nothing(spark, tmp_path):
    q = spark.createDataFrame([("q1", "s", "tin")], "question_id string, session_id string, question string")
    assert search_index.search(q, search_index.load(spark, str(tmp_path / "none")), 18).count() == 0
    assert retrieval.bm25(q, spark.createDataFrame([], UNIT)).count() == 0
    assert retrieval.bm25(q.limit(0), spark.createDataFrame([("u", "s", "a", "tin", "", "", "")], UNIT)).count() == 0


def _evidence(spark, n_chunks=40):
    """A session with a third of all rows and more, and a small one."""
    at = {"s": n_chunks, "t": 3}
    g = spark.createDataFrame([(f"g{k}{x}", x, f"Term {k}", ["al", f"b{k}"] if k else [], f"what term {k} means") for x in at for k in range(3)], "id string, session_id string, term string, aliases array<string>, definition string")
    c = spark.createDataFrame([(f"c{k}{x}", x, f"Head {k % 7}", ["k"] if k % 2 else [], f"a line about tin and topic {k}" if k % 3 else f"words {k}") for x, n in at.items() for k in range(n)], "id string, session_id string, heading string, keywords array<string>, text string")
    t = spark.createDataFrame([(f"t{k}{x}", x, "Dr. A", f"said {k} of tin", k * 2.5) for x in at for k in range(4)], "id string, session_id string, speaker_label string, text string, started_at_seconds double")
    u = spark.createDataFrame([(f"u{k}{x}", x, f"a{k % 3}{x}", "pdf", f"Unit {k}", "ex", f"content {k} with zinc", f"content {k} with zinc and tin", k if k % 2 else None, f"uri{k}" if k in (1, 4) else None) for x in at for k in range(6)], "id string, session_id string, asset_id string, modality string, title string, excerpt string, content_text string, search_text string, page_number int, preview_uri string")
    a = spark.createDataFrame([(f"a{k}{x}", f"file{k}.pdf") for x in at for k in range(2)], "id string, file_name string")
    d = spark.createDataFrame([(f"d{k}{x}", x, f"a{k}{x}", "asset_summary", f"Digest {k}", "about a tin cell" if k == 2 else "other", str(k)) for x in at for k in range(3)] + [("ds", "s", None, "session_summary", "S", "all of s", "9")], "id string, session_id string, asset_id string, kind string, title string, text string, created_at string")
    return {"glossary_terms": g, "material_chunks": c, "transcript_entries": t, "evidence_units": u, "uploaded_assets": a, "asset_digests": d}


def _plain_evidence(spark, tables, question, session, matches, profile):
    """The context of one question, step by step: records, scores by the tested expressions row by row, sorting and packing in Python."""
    rows = {k: [r.asDict() for r in v.collect()] for k, v in tables.items()}
    names = {r["id"]: r["file_name"] for r in rows["uploaded_assets"]}
    page = lambda u: f" Page {u['page_number']}." if u["page_number"] is not None else ""
    lines = {
        "evidence_unit": [(u["id"], f"- {u['title']}: {u['content_text']}" + (f" Source file: {names[u['asset_id']]}." if u["asset_id"] in names else "") + page(u), f"{u['title']} {u['search_text']}") for u in rows["evidence_units"] if u["session_id"] == session],
        "glossary_term": [(g["id"], f"- {g['term']}: {g['definition']}" + (f" Aliases: {', '.join(g['aliases'])}." if g["aliases"] else ""), f"{g['term']} {g['definition']}") for g in rows["glossary_terms"] if g["session_id"] == session],
        "material_chunk": [(c["id"], f"- {c['heading']}: {c['text']}" + (f" Keywords: {', '.join(c['keywords'])}." if c["keywords"] else ""), f"{c['heading']} {c['text']}") for c in rows["material_chunks"] if c["session_id"] == session],
        "transcript_entry": [(t["id"], f"- {t['speaker_label']} at {int(t['started_at_seconds'] + 0.5)}s: {t['text']}", f"{t['speaker_label']} {t['text']}") for t in rows["transcript_entries"] if t["session_id"] == session],
    }
    q = retrieval.prepare_questions(spark.createDataFrame([("q", session, question)], "question_id string, session_id string, question string"))
    focus = q.first()["focus"]
    limits, used = context.PROFILES[profile], {(k, i) for k, i, _, _ in matches}
    out = []
    for n, (kind, i, label, excerpt) in enumerate(matches[: limits["focused"]]):
        entry = next((e for k, e, _ in lines.get(kind, []) if k == i), None)
        out.append((0, n, f"{context.TITLES[kind][0]}\n{entry}" if entry else f"Focused evidence\n- {label}: {excerpt}"))
    for section, (kind, (_, title, boost)) in enumerate(context.TITLES.items(), 1):
        left = [x for x in lines[kind] if (kind, x[0]) not in used]
        if not left:
            continue
        df = q.crossJoin(spark.createDataFrame(left, "id string, entry string, body string"))
        score = retrieval.text_score(F.col("q_tokens"), X.unique(X.tokenize("body")), F.lit(boost) + retrieval.focus_boost(F.col("focus"), F.col("body")))
        entries = [r.entry for r in df.select("id", "entry", score.alias("s")).orderBy(F.desc("s"), F.collate("entry", "UNICODE"), "id").collect()]
        title += " (high relevance)" if focus and any(focus in e.lower() for e in entries) else ""
        chars, most = limits[kind]
        blocks, now = [], ""
        for e in entries:
            if now and len(now) + len(e) + 2 > chars:
                blocks.append(now)
                now = ""
            now = f"{now or title}\n{e}"
        out += [(section, n, b) for n, b in enumerate([*blocks, now][:most])]
    hit = {u["asset_id"] for u in rows["evidence_units"] if ("evidence_unit", u["id"]) in used}
    digests = [d for d in sorted(rows["asset_digests"], key=lambda d: d["created_at"]) if d["session_id"] == session]
    near = [d for d in digests if d["asset_id"] and (d["asset_id"] in hit or (focus and focus in f"{d['title']} {d['text']}".lower()))][:4]
    out += [(5, n, f"Asset digest\n- {d['title']}: {d['text']}") for n, d in enumerate(near)]
    return out + [(6, 0, f"Session digest\n{d['text']}") for d in digests if d["asset_id"] is None]


def test_evidence_of_an_answer_step_by_step(spark):
    tables = _evidence(spark)
    asked = [("q1", "s", "What is tin?"), ("q2", "s", "topic zinc words"), ("q3", "t", "Explain a tin cell"), ("q4", "t", "??")]
    q = retrieval.prepare_questions(spark.createDataFrame(asked, "question_id string, session_id string, question string"))
    matches = {
        "q1": [("glossary_term", "g1s", "L", "E"), ("evidence_unit", "u1s", "L", "E"), ("material_chunk", "gone", "Lost", "its excerpt"), ("transcript_entry", "t2s", "L", "E")] + [("material_chunk", f"c{k}s", "L", "E") for k in range(8)],
        "q2": [("evidence_unit", "u2s", "L", "E")], "q3": [], "q4": [("evidence_unit", "u4t", "L", "E")],
    }
    m = spark.createDataFrame([(k, *x, n + 1) for k, xs in matches.items() for n, x in enumerate(xs)], "question_id string, source_type string, source_record_id string, label string, excerpt string, rank int")
    for profile in context.PROFILES:
        got = {}
        for r in context.answer_evidence(q, m, tables, profile).collect():
            got.setdefault(r.question_id, []).append((r.section, r.order_index, r.block))
        for k, session, text in asked:
            assert sorted(got[k]) == sorted(_plain_evidence(spark, tables, text, session, matches[k], profile)), (profile, k)


def test_pictures_for_an_answer(spark):
    tables = _evidence(spark)
    q = retrieval.prepare_questions(spark.createDataFrame([("q1", "s", "what of zinc"), ("q2", "s", "content zinc tin"), ("q3", "t", "What is content 4?"), ("q4", "t", "nothing here")], "question_id string, session_id string, question string"))
    m = spark.createDataFrame([("q1", "evidence_unit", "u2s", 1), ("q1", "evidence_unit", "u4s", 2), ("q1", "evidence_unit", "u1s", 3), ("q2", "evidence_unit", "u2s", 1)], "question_id string, source_type string, source_record_id string, rank int")
    got = {r.question_id: (r.tier, r.id, r.uri, r.caption) for r in context.visual_evidence(q, m, tables["evidence_units"], tables["uploaded_assets"]).collect()}
    assert got == {"q1": (0, "u4s", "uri4", "Unit 4 File: file1.pdf. ex"), "q2": (1, "u1s", "uri1", "Unit 1 File: file1.pdf. Page 1. ex"), "q3": (1, "u4t", "uri4", "Unit 4 File: file1.pdf. ex")}


def test_phrases_meet_the_texts_that_hold_them(spark):
    """Against all pairs: phrases of one, two and more words, also where they begin or end within words of the text."""
    import random

    r = random.Random(9)
    words = ["a", "ab", "abc", "bca", "cabab", "é", "日本", "x-y", "aaaa", "b"]
    texts = [(f"s{k % 2}", f"t{k}", r.choice(["", " "]).join(r.choices(words, k=r.randint(0, 8))) if k % 5 == 0 else " ".join(r.choices(words, k=r.randint(0, 8)))) for k in range(200)]
    phrases = [(f"s{k % 2}", f"p{k}", " ".join(r.choices(words, k=r.randint(1, 4)))) for k in range(60)] + [("s0", "none", ""), ("s1", "long", "cabab abc ab")]
    got = retrieval.holding(spark.createDataFrame(phrases, "session_id string, key string, phrase string"), spark.createDataFrame(texts, "session_id string, id string, body string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, i) for s, k, p in phrases if p for t, i, b in texts if s == t and p in b)
    assert retrieval.holding(spark.createDataFrame(phrases[:0], "session_id string, key string, phrase string"), spark.createDataFrame(texts, "session_id string, id string, body string")).count() == 0


def test_one_build_serves_all_queries_until_it_is_cleared(spark):
    import shutil

    from lucerna.plans.views import Views

    first = Views(spark, SF).index()
    assert Views(spark, SF).index() is first
    shutil.rmtree(first.units.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    again = Views(spark, SF).index()
    assert again is not first and search_index.is_there(again) and again.units.count() > 0
