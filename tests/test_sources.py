import io
import json
import zipfile

import pytest
from lucerna.operators import mutations, parse, schema
from lucerna.sources import assembly, files, packs, pdf, tables
from pyspark.sql import functions as F

def rows_of(n, **fields):
    return [{k: v(i) if callable(v) else v for k, v in fields.items()} for i in range(n)]


def chunks(m, n):
    return rows_of(n, id=lambda i: f"c{m}_{i}", heading=lambda i: f"Head {m} {i}", text=lambda i: f"text {m} {i}", keywords=["k"], orderIndex=lambda i: i)


def qa(i, sources):
    answer = {"id": f"a{i}", "text": f"answer {i}", "confidenceScore": 0.8, "sources": [{"sourceType": t, "sourceId": s} for t, s in sources]}
    return {"id": f"q{i}", "categoryKey": f"key{i}", "questionText": f" What {i}? ", "askedAt": f"2024-02-0{i + 1}", "answer": answer}


#: As many rows of each kind as the reference's own example has: 1, 2, 6, 4, 4, 2, 4, 3, 3 and 8.
PACK = {
    "packVersion": "1.0.0",
    "exportedAt": "2024-01-01",
    "session": {"id": "s1", "title": "T", "courseCode": "C-1", "lecturer": "L", "description": "d", "location": "here", "startsAt": "2024-01-01", "status": "live", "tags": ["a"]},
    "materials": [{"id": f"m{m}", "title": f"M {m}", "type": "reading", "sourceLabel": f"m{m}.txt", "contentText": "c", "orderIndex": m, "chunks": chunks(m, 3)} for m in range(2)],
    "glossary": rows_of(4, id=lambda i: f"g{i}", term=lambda i: f"Term {i}", aliases=["x"], definition=lambda i: f"definition {i}", orderIndex=lambda i: i),
    "transcript": rows_of(4, id=lambda i: f"t{i}", speakerLabel="Dr. B", text=lambda i: f"said {i}", startedAtSeconds=lambda i: 5.5 * i, orderIndex=lambda i: i),
    "summaries": [{"id": "u0", "kind": "overview", "title": "O", "text": "o"}, {"id": "u1", "kind": "key_points", "title": "K", "text": "k"}],
    "qaCategories": rows_of(4, id=lambda i: f"k{i}", key=lambda i: f"key{i}", label=lambda i: f"Label {i}", description="d"),
    "publicQa": [
        qa(0, [("glossary_term", "g0"), ("material_chunk", "c0_1"), ("transcript_entry", "t2")]),
        qa(1, [("material_chunk", "c1_2"), ("evidence_unit", "later")]),
        qa(2, [("glossary_term", "g3"), ("glossary_term", "g1"), ("transcript_entry", "t0")]),
    ],
}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_packs_become_tables(spark, tmp_path):
    p = packs.read_packs(spark, write(tmp_path / "demo.json", json.dumps(PACK)))
    t = packs.tables(p, "now")
    assert [t[n].count() for n in t] == [1, 2, 6, 4, 4, 2, 4, 3, 3, 8]
    for name, df in t.items():
        assert df.columns == [c.split(":")[0].rstrip("?") for c in schema.COLUMNS[name].split()] and schema.validate(df, name)[1].count() == 0
    assert t["lecture_sessions"].first()["source_pack_version"] == "1.0.0:demo.json"
    q = t["questions"].orderBy("id").first()
    assert (q["category_id"], q["text"], q["normalized_text"], q["created_at"]) == ("k0", " What 0? ", "what 0?", "2024-02-01")
    got = {tuple(r) for r in t["answer_sources"].select("id", "source_type", "label", "excerpt", "relevance_score").collect()}
    assert ("a0_src_1", "material_chunk", "Material: Head 0 1", "text 0 1", 1.4) in got and ("a1_src_1", "evidence_unit", "Indexed evidence", "Indexed lecture evidence", 1.2) in got
    assert ("a2_src_0", "glossary_term", "Glossary: Term 3", "definition 3", 2.0) in got and ("a2_src_2", "transcript_entry", "Transcript: Dr. B", "said 0", 1.0) in got


def test_a_category_that_is_not_there_is_none(spark, tmp_path):
    p = packs.read_packs(spark, write(tmp_path / "a.json", json.dumps(PACK | {"qaCategories": []})))
    assert {r.category_id for r in packs.tables(p, "now")["questions"].collect()} == {None}


def test_bad_packs_raise_or_are_told(spark, tmp_path):
    def problem(pack):
        return packs.read_packs(spark, write(tmp_path / "b.json", json.dumps(pack)), strict=False).first()["problem"]

    assert problem(PACK) == ""
    assert problem(PACK | {"packVersion": "2", "materials": []}).startswith("version; no material")
    assert problem(PACK | {"publicQa": [qa(0, [("glossary_term", "c0_1")])]}) == "an unknown source"
    assert problem(PACK | {"publicQa": [qa(0, [])]}) == "an answer without source"
    assert problem(PACK | {"glossary": [{"id": "g", "term": " ", "definition": "d", "orderIndex": 0}], "publicQa": []}) == "glossary: a text is missing"
    with pytest.raises(Exception, match="invalid pack: an unknown source"):
        loaded = packs.read_packs(spark, write(tmp_path / "b.json", json.dumps(PACK | {"publicQa": [qa(0, [("transcript_entry", "no")])]})))
        packs.tables(loaded, "now")["lecture_sessions"].collect()


def test_a_pack_is_told_from_raw_files(spark):
    rows = [("u1", "a.JSON", json.dumps(PACK)), ("u2", "a.json", "[1]"), ("u2", "b.txt", "words"), ("u3", "a.txt", json.dumps(PACK))]
    whole, raw = packs.split_uploads(spark.createDataFrame(rows, "upload string, name string, value string"))
    assert [tuple(r)[:2] for r in whole.collect()] == [("u1", "a.JSON")] and sorted(r.name for r in raw.collect()) == ["a.json", "a.txt", "b.txt"]
    whole, _ = packs.split_uploads(spark.createDataFrame([("u1", "a.json", json.dumps(PACK)), ("u1", "b.txt", "x")], "upload string, name string, value string"))
    with pytest.raises(Exception, match="beside other files"):
        whole.collect()
    many = [(f"u{i}", "a.json", json.dumps(PACK) if i % 2 else "[1]") for i in range(20)]
    whole, raw = packs.split_uploads(spark.createDataFrame(many, "upload string, name string, value string"))
    assert packs.parse_packs(whole).count() == 10 and raw.count() == 10  # strict: files that are no packs aren't checked as such


def test_csv(spark, tmp_path):
    path = write(tmp_path / "x.csv", 'Term , DEF,term\n"a ""q""\nb", one ,late\n,,\nc\n')
    got = [r.asDict() for r in files.read_csv(spark, path).collect()]
    assert got == [{"term": "late", "def": "one"}, {"term": "", "def": ""}]


def test_pptx(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ppt/slides/slide2.xml", "<a:p><a:r><a:t>Two &amp;</a:t></a:r></a:p>")
        z.writestr("ppt/slides/slide1.xml", "<a:p><a:r><a:t>Head</a:t></a:r></a:p><a:p><a:t>bo</a:t><a:t>dy</a:t></a:p>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", "<a:p><a:t>say this</a:t></a:p>")
    (tmp_path / "d.pptx").write_bytes(data.getvalue())
    got = parse.slides(files.uploads(spark, str(tmp_path / "d.pptx"))).orderBy("slide").collect()
    assert [(r.slide, r.heading, r.text) for r in got] == [(1, "Head", "body\n\n## Speaker Notes\nsay this"), (2, "Two &", "Two &")]


def test_tables_are_written_and_added_to(spark, tmp_path):
    a = spark.createDataFrame([(1,)], "id int")
    tables.write_tables({"x": a}, str(tmp_path))
    tables.write_tables({"x": spark.createDataFrame([(2,)], "id int")}, str(tmp_path), append=True)
    tables.write_tables({}, str(tmp_path))
    assert sorted(r.id for r in tables.read_table(spark, str(tmp_path), "x").collect()) == [1, 2]


def test_validation(spark):
    rows = spark.createDataFrame([("a", "s", "overview", "t", "x", "1", "1"), ("b", "s", "odd", "t", None, "1", "1")], schema.struct("summaries").simpleString()[7:-1].replace(":", " "))
    good, bad = schema.validate(rows, "summaries")
    assert [r.id for r in good.collect()] == ["a"]
    assert bad.first()["reason"] == "text is null; kind is unknown"


def test_cascade_and_set_null(spark):
    t = {
        "qa_categories": spark.createDataFrame([("c1", "s"), ("c2", "s")], "id string, session_id string"),
        "questions": spark.createDataFrame([("q1", "s", "c1"), ("q2", "s", "c2")], "id string, session_id string, category_id string"),
        "answers": spark.createDataFrame([("a1", "q1", "s")], "id string, question_id string, session_id string"),
    }
    out = mutations.delete(t, "qa_categories", spark.createDataFrame([("c1",)], "id string"))
    assert {tuple(r) for r in out["questions"].select("id", "category_id").collect()} == {("q1", None), ("q2", "c2")}
    out = mutations.delete(t, "questions", spark.createDataFrame([("q1",)], "id string"))
    assert out["answers"].count() == 0


def test_toggle_by_parity(spark):
    current = spark.createDataFrame([("s", "t", "1", "l")], "session_id string, target_type string, target_id string, label string")
    presses = spark.createDataFrame([("s", "t", "1", "l", 1), ("s", "t", "2", "m", 2), ("s", "t", "3", "n", 3), ("s", "t", "3", "n", 4)], "session_id string, target_type string, target_id string, label string, at int")
    assert [(r.target_id, r.label) for r in mutations.toggle_bookmarks(current, presses).collect()] == [("2", "m")]


def _upload(spark, *uploads):
    """Files (name, kind, text) of each upload as raw assets."""
    rows = [(f"u{k}", n, name, name.rsplit(".", 1)[0].lower(), name.rsplit(".", 1)[1].lower(), kind, text) for k, files_ in enumerate(uploads) for n, (name, kind, text) in enumerate(files_)]
    return spark.createDataFrame(rows, "upload string, position int, name string, base_name string, extension string, kind string, text string")


def test_files_become_a_session(spark):
    """What the reference's importer is expected to build of its files, and of uploads with less."""
    qa_text = json.dumps({"publicQa": [
        {"id": "q1", "questionText": " Why? ", "categoryKey": "Exam Prep", "answer": {"id": "a1", "text": "So.", "confidenceScore": 3, "sources": [{"sourceType": "glossary_term", "sourceId": "glossary_tin"}, {"sourceType": "transcript_entry", "sourceId": "transcript_talk_1_1"}]}},
        {"id": "q2", "questionText": "Lost?", "categoryKey": "exam_prep", "answer": {"text": "x", "sources": [{"sourceType": "glossary_term", "sourceId": "glossary_tin"}, {"sourceType": "glossary_term", "sourceId": "gone"}]}},
        {"id": "q3", "questionText": "Other?", "categoryKey": "general", "answer": {"text": "x", "sources": [{"sourceType": "glossary_term", "sourceId": "glossary_tin"}]}},
    ]})
    whole = [
        ("session.json", "session", json.dumps({"title": "Metals, an Intro", "courseCode": "M-1", "lecturer": "Dr. A", "tags": ["m", "uploaded"]})),
        ("slides.md", "material", "# Tin\nTin is soft.\n\n# Lead\nLead is heavy."), ("empty.txt", "material", "  "), ("my_handout.txt", "material", "One paragraph.\n\nAnother one."),
        ("glossary.csv", "glossary", "term,definition,aliases\nTin,A soft metal,Sn\nLead,short,"), ("more.json", "glossary", json.dumps([{"term": "lead", "definition": "a longer one", "aliases": ["Pb"]}])),
        ("talk.txt", "transcript", "[00:05] Dr. A: Tin melts.\n\nThen it sets."), ("categories.csv", "categories", "key,label,description\n,Exam Prep,for exams"), ("publicqa.json", "public_qa", qa_text), ("summary.md", "summaries", "# Key points\nAll of it."),
    ]
    only_terms = [("definitions.pdf", "glossary", "Working length: The extent that is used while a canal is shaped")]
    no_pairs = [("groundrules.pdf", "glossary", "Ground rules for shaping include keeping the canal as it is, avoiding ledges, and keeping access open throughout all of it.")]
    terms_csv = [("t.csv", "glossary", "term,definition\nZinc,bluish"), ("c.txt", "categories", "no colon here")]
    talk = [("talk.txt", "transcript", "Hello there.\n\nBob Q: Good-bye now.")]
    t = assembly.assemble(_upload(spark, whole, only_terms, no_pairs, terms_csv, talk), "2024-05-05", "five uploads")
    for name, df in t.items():
        assert df.columns == [c.split(":")[0].rstrip("?") for c in schema.COLUMNS[name].split()], name
        assert schema.validate(df, name)[1].count() == 0, name
    rows = lambda name, session, *columns: [tuple(r) for r in t[name].where(F.col("id" if name == "lecture_sessions" else "session_id") == session).orderBy("id").select(*columns).collect()]
    m = "session_metals_an_intro"
    assert rows("lecture_sessions", m, "title", "course_code", "lecturer", "status", "location", "starts_at", "tags", "source_pack_version") == [
        ("Metals, an Intro", "M-1", "Dr. A", "live", "five uploads", "2024-05-05", ["uploaded", "ground-truth", "m", "session", "material", "glossary", "transcript", "categories", "public-qa", "summaries"], "1.0.0:five uploads"),
    ]
    assert rows("lecture_materials", m, "id", "title", "type", "order_index", "content_text") == [(f"{m}_material_my_handout_2", "My Handout", "handout", 2, "One paragraph. Another one."), (f"{m}_material_slides", "Slides", "slide_deck", 0, "Tin is soft. Lead is heavy.")]
    assert [r[:2] for r in rows("material_chunks", m, "id", "heading", "order_index")] == [(f"{m}_chunk_my_handout_passage_1_0", "Passage 1"), (f"{m}_chunk_my_handout_passage_2_1_1", "Passage 2"), (f"{m}_chunk_slides_lead_1_1", "Lead"), (f"{m}_chunk_slides_tin_0", "Tin")]
    assert rows("glossary_terms", m, "id", "term", "definition", "aliases", "order_index") == [(f"{m}_glossary_lead_1", "Lead", "a longer one", ["Pb", "lead"], 1), (f"{m}_glossary_tin", "Tin", "A soft metal", ["Sn"], 0)]
    assert rows("transcript_entries", m, "id", "speaker_label", "text", "started_at_seconds") == [(f"{m}_transcript_talk_0", "Dr. A", "Tin melts.", 5.0), (f"{m}_transcript_talk_1_1", "Lecture", "Then it sets.", 30.0)]
    assert rows("questions", m, "id", "category_id", "text") == [(f"{m}_q1", f"{m}_category_exam_prep", "Why?")] and rows("answers", m, "id", "confidence_score") == [(f"{m}_a1", 1.0)]
    assert rows("answer_sources", m, "id", "source_record_id", "label") == [(f"{m}_a1_src_0", f"{m}_glossary_tin", "Glossary: Tin"), (f"{m}_a1_src_1", f"{m}_transcript_talk_1_1", "Transcript: Lecture")]
    assert rows("summaries", m, "id", "kind") == [(f"{m}_summary_key_points_key_points", "key_points")]
    assert rows("lecture_sessions", "session_definitions", "title", "course_code") == [("Definitions", "LOCAL-IMPORT")] and rows("glossary_terms", "session_definitions", "term") == [("Working length",)]
    assert len(rows("lecture_materials", "session_definitions", "title")) == 1
    assert rows("glossary_terms", "session_groundrules", "term") == [] and rows("lecture_materials", "session_groundrules", "title") == [("Groundrules",)]
    assert "keeping the canal" in rows("material_chunks", "session_groundrules", "text")[0][0]
    assert rows("qa_categories", "session_t", "id", "key") == [("session_t_category_concepts", "concepts")] and rows("lecture_materials", "session_t", "id", "source_label") == [("session_t_material_imported_glossary", "generated-from-glossary")]
    assert rows("lecture_materials", "session_talk", "id") == [("session_talk_material_imported_transcript",)] and rows("material_chunks", "session_talk", "heading") == [("Lecture 1",), ("Bob Q 2",)]
    # no reference without its row
    ids = {r.id for n in ("material_chunks", "glossary_terms", "transcript_entries") for r in t[n].select("id").collect()}
    assert {r.source_record_id for r in t["answer_sources"].collect()} <= ids and {r.material_id for r in t["material_chunks"].collect()} == {r.id for r in t["lecture_materials"].collect()}


def test_files_for_a_session_that_is_there(spark):
    there = spark.createDataFrame([("u0", "s9", "Old title", None, "Dr. Z", "d", "l", "2020", "ended", ["old"])], "upload string, id string, title string, course_code string, lecturer string, description string, location string, starts_at string, status string, tags array<string>")
    t = assembly.assemble(_upload(spark, [("a.txt", "material", "Some text.")]), "now", "files", there)
    s = t["lecture_sessions"].first()
    assert (s.id, s.title, s.course_code, s.lecturer, s.status, s.tags) == ("s9", "Old title", "LOCAL-IMPORT", "Dr. Z", "ended", ["old", "uploaded", "ground-truth", "material"])
    assert t["material_chunks"].first().id.startswith("s9_chunk_a_")
    assert all(df.count() == 0 for df in assembly.assemble(_upload(spark, [("a.txt", "material", "Some text.")]).limit(0), "now", "files").values())


def _pdf(pages, flate=True, extra=b"", fonts=b"", packed=False, kids=None):
    """A PDF file of these content streams; packed: pages in an object stream."""
    import zlib

    n = len(pages)
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in (kids or range(10, 10 + n))), n)}
    for k, content in enumerate(pages):
        data = zlib.compress(content) if flate else content
        bodies[10 + k] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents %d 0 R >>" % (100 + k)
        bodies[100 + k] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if flate else b"", data)
    bodies[5] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica %s>>" % fonts
    if packed:
        inside = {k: bodies.pop(k) for k in list(bodies) if k < 100}
        head, at, texts = b"", 0, b""
        for k, b in inside.items():
            head += b"%d %d " % (k, at)
            texts += b + b" "
            at += len(b) + 1
        data = zlib.compress(head + texts)
        bodies[900] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(inside), len(head), len(data), data)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in bodies.items()) + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


def _texts(spark, **named):
    found = pdf.pdf_texts(spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary"))
    return {r.path: r.text if r.problem is None else r.problem for r in found.collect()}


def test_pdf_texts(spark):
    line = lambda x, y, t: b"BT /F1 10 Tf 1 0 0 1 %d %d Tm (%s) Tj ET\n" % (x, y, t)
    one = b"BT /F1 12 Tf 14 TL 72 700 Td (First line) Tj T* (with \\(brackets\\) and \\351) Tj 0 -30 Td [(Ker) -20 (ned) -300 (words)] TJ ET"
    two = line(300, 700, b"right one") + line(72, 700, b"left one") + line(72, 688, b"left two") + line(300, 688, b"right two")
    moved = b"q 1 0 0 1 0 500 cm " + line(72, 100, b"low") + b"Q " + line(72, 650, b"high, in place")
    cmap = b"6 0 obj\n<< /Length 1 >>\nstream\n1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange\nendstream\nendobj\n"
    got = _texts(
        spark, one=_pdf([one]), plain=_pdf([one], flate=False), two=_pdf([two]), moved=_pdf([moved]), packed=_pdf([line(72, 700, b"p one"), line(72, 700, b"p two")], packed=True),
        order=_pdf([line(72, 700, b"second"), line(72, 700, b"first")], kids=[11, 10]), hexed=_pdf([b"BT /F1 10 Tf 72 700 Td <00010002000300 04> Tj ET"], fonts=b"/ToUnicode 6 0 R ", extra=cmap),
        blank=_pdf([b"0 0 m 10 10 l S"]), junk=b"hello", none=b"", broken=_pdf([one])[:200] + b"\n%%EOF", locked=_pdf([one]) + b"\ntrailer << /Encrypt 9 0 R >>", flate=_pdf([one]).replace(b"stream\nx", b"stream\ny"),
    )
    assert got["one"] == got["plain"] == "First line\nwith (brackets) and é\nKerned words"
    assert got["two"] == "left one right one\nleft two right two" and got["moved"] == "high, in place\nlow"
    assert got["packed"] == "p one\n\fp two" and got["order"] == "first\n\fsecond" and got["hexed"] == "Habc"
    assert got["blank"] == pdf.NO_TEXT and "not a PDF" in got["junk"] and "not a PDF" in got["none"] and "encrypted" in got["locked"]
    assert got["broken"] == pdf.NO_TEXT and "could not be read" in got["flate"]


def test_pdf_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(_pdf([b"BT /F1 10 Tf 72 700 Td (Some text) Tj ET"]))
    (tmp_path / "b.pdf").write_bytes(b"junk")
    (tmp_path / "c.txt").write_text("x")
    good, bad = files.with_pdf_texts(files.uploads(spark, str(tmp_path)))
    assert [(r.name, r.text) for r in good.collect()] == [("a.pdf", "Some text")] and [r.name for r in bad.collect()] == ["b.pdf"] and "not a PDF" in bad.first()["error"]


def test_a_pack_is_parsed_once_for_all_rules(spark):
    files = spark.createDataFrame([("u", "p.json", "{}"), ("w", "p.json", None)], "upload string, name string, value string")
    loaded = packs.parse_packs(files.select(F.col("name").alias("label"), "value"), strict=False)
    judged = files.select(packs.is_pack(F.col("name"), F.col("value")).alias("is_pack"))
    for df, most in ((loaded, 2), (judged, 1)):
        assert 1 <= df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= most
    assert all(r.problem.startswith("no session; version") for r in loaded.collect()) and not any(r.is_pack for r in judged.collect())
