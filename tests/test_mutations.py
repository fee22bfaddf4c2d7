from lucerna.operators import mutations, schema


def frame(spark, table, *rows):
    fields = schema.struct(table)
    fields.fields = [f.__class__(f.name, f.dataType, True) for f in fields.fields]
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


def test_a_pack_joins_a_session(spark):
    term = lambda id, term, aliases, definition, n, at: {"id": id, "session_id": "s", "term": term, "aliases": aliases, "definition": definition, "order_index": n, "created_at": at, "updated_at": at}
    now = {
        "lecture_sessions": frame(spark, "lecture_sessions", {"id": "s", "title": "T", "tags": ["a", "b"], "source_pack_version": "1", "updated_at": "1"}, {"id": "other", "tags": ["x"], "updated_at": "1"}),
        "glossary_terms": frame(spark, "glossary_terms", term("g1", "Tin", ["t"], "short", 0, "1"), term("g2", "Lead", [], "a long definition", 1, "1")),
        "summaries": frame(spark, "summaries", {"id": "u1", "session_id": "s", "kind": "overview", "title": "O", "text": "o", "updated_at": "1"}),
        "transcript_entries": frame(spark, "transcript_entries", {"id": "t1", "session_id": "s", "order_index": 6}),
        "notes": frame(spark, "notes", {"id": "n"}),
    }
    pack = {
        "lecture_sessions": frame(spark, "lecture_sessions", {"id": "s", "title": "new", "tags": ["b", "c"], "source_pack_version": "2", "updated_at": "2"}),
        "glossary_terms": frame(spark, "glossary_terms", term("n1", " TIN ", ["t", "u"], "longer one", 0, "2"), term("n2", "lead", [], "less", 1, "2"), term("n3", "Zinc", ["z"], "d", 4, "2"), term("n4", "zinc", ["y"], "dd", 5, "2"), term("n5", "Gold", [], "d", 6, "2")),
        "summaries": frame(spark, "summaries", {"id": "u2", "session_id": "s", "kind": "overview", "title": "P", "text": "p", "updated_at": "2"}, {"id": "u3", "session_id": "s", "kind": "key_points", "title": "K", "text": "k", "updated_at": "2"}),
        "transcript_entries": frame(spark, "transcript_entries", {"id": "t2", "session_id": "s", "order_index": 0}, {"id": "t3", "session_id": "new", "order_index": 1}),
    }
    out = mutations.append_pack(now, pack)
    rows = lambda table, *columns: sorted(tuple(r) for r in out[table].select(*columns).collect())
    assert rows("lecture_sessions", "id", "title", "tags", "source_pack_version") == [("other", None, ["x"], None), ("s", "T", ["a", "b", "c"], "2")]
    assert rows("glossary_terms", "id", "term", "aliases", "definition", "order_index", "updated_at") == [
        ("g1", "Tin", ["t", "u"], "longer one", 0, "2"), ("g2", "Lead", [], "a long definition", 1, "1"), ("n3", "Zinc", ["z", "y"], "dd", 2, "2"), ("n5", "Gold", [], "d", 3, "2"),
    ]
    assert rows("summaries", "id", "title", "text", "updated_at") == [("u1", "P", "p", "2"), ("u3", "K", "k", "2")]
    assert rows("transcript_entries", "id", "order_index") == [("t1", 6), ("t2", 7), ("t3", 1)]
    assert rows("notes", "id") == [("n",)]


def test_questions_point_to_the_categories_that_stay(spark):
    c = lambda id, key: {"id": id, "session_id": "s", "key": key, "label": "l", "created_at": "1"}
    q = lambda id, category: {"id": id, "session_id": "s", "category_id": category}
    out = mutations.append_pack(
        {"qa_categories": frame(spark, "qa_categories", c("old", "k")), "questions": frame(spark, "questions", q("q0", "old"))},
        {"qa_categories": frame(spark, "qa_categories", c("a", "k"), c("b", "m")), "questions": frame(spark, "questions", q("q1", "a"), q("q2", "b"), q("q3", "none"), q("q4", None))},
    )
    assert {tuple(r) for r in out["questions"].select("id", "category_id").collect()} == {("q0", "old"), ("q1", "old"), ("q2", "b"), ("q3", None), ("q4", None)}
    assert {r.id for r in out["qa_categories"].collect()} == {"old", "b"}


def _three_sessions(spark):
    at = {"created_at": "1", "updated_at": "1"}
    s = lambda id, starts, tags: {"id": id, "title": id, "starts_at": starts, "tags": tags} | at
    term = lambda id, session, term, aliases, definition, n: {"id": id, "session_id": session, "term": term, "aliases": aliases, "definition": definition, "order_index": n} | at
    asset = lambda id, session, name, status, made, **more: {"id": id, "session_id": session, "file_name": name, "source_kind": "material", "status": status, "media_type": f"type of {id}", "created_at": made, "updated_at": made} | more
    digest = lambda id, session, asset, text, made, kind="asset_summary": {"id": id, "session_id": session, "asset_id": asset, "kind": kind, "title": f"T {id}", "text": text, "created_at": made, "updated_at": made}
    rows = {
        "lecture_sessions": [s("a", "1", ["x"]), s("b", "3", ["y", "x"]), s("c", "2", ["z"])],
        "glossary_terms": [term("a1", "a", "Tin", ["t"], "short", 0), term("b1", "b", " tin", ["u", "t"], "much longer", 0), term("b2", "b", "Lead", [], "d", 1), term("c1", "c", "LEAD", ["l"], "e", 0), term("c2", "c", "Zinc", [], "z", 1), term("c3", "c", "TIN ", [], "x", 2)],
        "qa_categories": [{"id": f"k{x}", "session_id": x, "key": "exam", "created_at": "1"} for x in "abc"] + [{"id": "kc2", "session_id": "c", "key": "other", "created_at": "2"}],
        "questions": [{"id": "qa", "session_id": "a", "category_id": "ka"}, {"id": "qb", "session_id": "b", "category_id": "kb"}, {"id": "qb2", "session_id": "b", "category_id": "kb"}, {"id": "qc", "session_id": "c", "category_id": "kc2"}, {"id": "qa2", "session_id": "a", "category_id": None}],
        "answers": [{"id": "aa", "session_id": "a", "question_id": "qa"}, {"id": "ab", "session_id": "b", "question_id": "qb"}, {"id": "ac", "session_id": "c", "question_id": "qc"}],
        "answer_sources": [{"id": "s1", "session_id": "b", "answer_id": "ab", "source_type": "glossary_term", "source_record_id": "b1"}, {"id": "s2", "session_id": "c", "answer_id": "ac", "source_type": "glossary_term", "source_record_id": "c2"}, {"id": "s3", "session_id": "c", "answer_id": "ac", "source_type": "material_chunk", "source_record_id": "c3"}],
        "notes": [{"id": "n1", "session_id": "c", "anchor_type": "glossary_term", "anchor_id": "c1"}, {"id": "n2", "session_id": "c", "anchor_type": "session", "anchor_id": None}],
        "bookmarks": [{"id": f"m{x}{k}", "session_id": x, "target_type": kind, "target_id": t, "created_at": str(k)} for k, (x, kind, t) in enumerate([("a", "glossary_term", "a1"), ("b", "glossary_term", "b1"), ("c", "glossary_term", "c3"), ("c", "glossary_term", "c1"), ("b", "glossary_term", "b2"), ("b", "material_chunk", "b1")])],
        "uploaded_assets": [asset("p1", "a", "One.txt", "ready", "1", checksum="old"), asset("p2", "a", "one.TXT", "pending", "2", checksum="mine"), asset("p3", "b", " one.txt ", "processing", "1"), asset("p4", "c", "ONE.txt", "failed", "1", checksum="new", error_message="why"), asset("p5", "c", "two.txt", "failed", "1"), asset("p6", "c", "two.txt", "pending", "2")],
        "evidence_units": [{"id": f"u{k}", "session_id": x, "asset_id": f"p{k}"} for k, x in enumerate("aabccc", 1)],
        "asset_digests": [digest("d1", "a", "p2", "first", "1"), digest("d3", "b", "p3", "second", "2"), digest("d4", "c", "p4", "third", "3"), digest("d5", "c", "p5", "fourth", "4"), digest("da", "a", None, "gone", "1", "session_summary"), digest("dc", "c", None, "gone", "1", "session_summary")],
        "summaries": [{"id": f"y{x}", "session_id": x, "kind": "overview", "title": x, "text": x} | at for x in "abc"] + [{"id": "yb2", "session_id": "b", "kind": "key_points", "title": "K", "text": "k"} | at],
        "lecture_materials": [{"id": f"l{x}{k}", "session_id": x, "order_index": k} for x in "abc" for k in (0, 2)],
    }
    return {name: frame(spark, name, *r) for name, r in rows.items()}


def test_sessions_become_one(spark):
    now = _three_sessions(spark)
    out = mutations.consolidate(now, "a", "9")
    rows = lambda table, *columns: sorted((tuple(r) for r in out[table].select(*columns).collect()), key=str)
    assert all({r.session_id for r in out[t].select("session_id").collect()} == {"a"} for t in out if t != "lecture_sessions")
    assert rows("lecture_sessions", "id", "tags") == [("a", ["x", "y", "z"])]
    # the others in order of time, latest first: b, c
    assert rows("glossary_terms", "id", "term", "aliases", "definition", "order_index") == [("a1", "Tin", ["t", "u"], "much longer", 0), ("b2", "Lead", ["l"], "d", 1), ("c2", "Zinc", [], "z", 2)]
    assert rows("qa_categories", "id", "key") == [("ka", "exam"), ("kc2", "other")]
    assert rows("questions", "id", "category_id") == [("qa", "ka"), ("qa2", None), ("qb", "ka"), ("qc", "kc2")]
    assert rows("answer_sources", "id", "source_record_id") == [("s1", "a1"), ("s2", "c2"), ("s3", "c3")]
    assert rows("notes", "id", "anchor_id") == [("n1", "b2"), ("n2", None)]
    assert rows("bookmarks", "id", "target_id") == [("ma0", "a1"), ("mb4", "b2"), ("mb5", "b1")]
    assert rows("uploaded_assets", "id", "status", "checksum", "error_message", "media_type") == [
        ("p1", "ready", "old", None, "type of p1"), ("p2", "processing", "new", "why", "type of p4"), ("p5", "failed", None, None, "type of p5"), ("p6", "pending", None, None, "type of p6"),
    ]
    assert rows("evidence_units", "id", "asset_id") == [("u1", "p1"), ("u2", "p2"), ("u3", "p2"), ("u4", "p2"), ("u5", "p5"), ("u6", "p6")]
    assert [r[1:] for r in rows("asset_digests", "id", "asset_id", "title")] == [(None, "Workspace session digest"), ("p2", "T d4"), ("p5", "T d5")]
    assert {r.asset_id: r.text for r in out["asset_digests"].collect()} == {"p2": "third", "p5": "fourth", None: "T d4\nthird\n\nT d5\nfourth"}
    assert rows("summaries", "id", "kind", "title") == [("ya", "overview", "c"), ("yb2", "key_points", "K")]
    assert rows("lecture_materials", "id", "order_index") == [("la0", 0), ("la2", 2), ("lb0", 3), ("lb2", 5), ("lc0", 6), ("lc2", 8)]


def test_no_reference_is_left_without_its_row(spark):
    out = mutations.consolidate(_three_sessions(spark), None)
    ids = lambda t: {r.id for r in out[t].select("id").collect()}
    for child, column, parent in (("questions", "category_id", "qa_categories"), ("answers", "question_id", "questions"), ("answer_sources", "answer_id", "answers"), ("evidence_units", "asset_id", "uploaded_assets"), ("asset_digests", "asset_id", "uploaded_assets")):
        assert {r[0] for r in out[child].select(column).collect()} - {None} <= ids(parent) | ({"qb2"} if column == "question_id" else set()), child
    for child, column, kind in (("answer_sources", "source_record_id", "source_type"), ("notes", "anchor_id", "anchor_type"), ("bookmarks", "target_id", "target_type")):
        assert {r[0] for r in out[child].where(f"{kind} = 'glossary_term'").select(column).collect()} <= ids("glossary_terms")
    assert [r.id for r in out["lecture_sessions"].collect()] == ["b"]
    assert mutations.consolidate({"lecture_sessions": out["lecture_sessions"]}, None)["lecture_sessions"].count() == 1
