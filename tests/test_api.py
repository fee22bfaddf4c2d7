import json

from lucerna.__main__ import main
from lucerna.plans import api
from lucerna.sources import packs
from pyspark.sql import functions as F
from tests.test_sources import PACK, write


def questions(spark):
    rows = [("q1", "s1", "What is a cell?"), ("q2", "s1", "unrelated words entirely")]
    return spark.createDataFrame(rows, "question_id string, session_id string, question string")


def test_ask(spark, tmp_path):
    pack = PACK | {"glossary": [{"id": "g1", "term": "a cell", "definition": "The smallest unit of life.", "orderIndex": 0}], "publicQa": []}
    tables = packs.tables(packs.read_packs(spark, write(tmp_path / "a.json", json.dumps(pack))), "now")
    answers, sources = api.ask(questions(spark), tables)
    got = {r.question_id: r for r in answers.collect()}
    assert got["q1"].supported and got["q1"].answer == "The smallest unit of life." and not got["q2"].supported and got["q2"].confidence == 0
    assert [r.source_record_id for r in sources.collect()] == ["g1"]
    said, _ = api.ask(questions(spark), tables, generator=lambda p: p.select("question_id", F.lit("Unsupported.").alias("generated")))
    assert {r.question_id: r.answer for r in said.collect()}["q1"] == "The smallest unit of life."


def test_import_twice_changes_nothing(spark, tmp_path):
    loaded = packs.read_packs(spark, write(tmp_path / "a.json", json.dumps(PACK)))
    once = api.import_packs(loaded, {}, "now")
    twice = api.import_packs(loaded, once, "now")
    for name in once:
        assert sorted(map(tuple, once[name].collect()), key=str) == sorted(map(tuple, twice[name].collect()), key=str)
    assert once["material_chunks"].orderBy("id").first()["material_id"] == "m0"


def test_a_pack_without_rows_of_a_kind_empties_its_session(spark, tmp_path):
    first = packs.read_packs(spark, write(tmp_path / "a.json", json.dumps(PACK)))
    second = packs.read_packs(spark, write(tmp_path / "b.json", json.dumps(PACK | {"glossary": [], "publicQa": []})))
    out = api.import_packs(second, api.import_packs(first, {}, "now"), "now")
    assert out["glossary_terms"].count() == 0 and out["answers"].count() == 0 and out["material_chunks"].count() == 6


def test_command_line(spark, tmp_path, capsys):
    pack = PACK | {"glossary": [{"id": "g1", "term": "a cell", "definition": "The smallest unit of life.", "orderIndex": 0}], "publicQa": []}
    path = write(tmp_path / "a.json", json.dumps(pack))

    def told(*argv):
        main([*argv, "--json"])
        return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]

    cell, other = told("answer", "--pack", path, "--question", "What is a cell?", "--question", "unrelated words entirely")
    assert cell["supported"] and cell["answer"] == "The smallest unit of life." and not other["supported"] and cell["session_id"] == "s1"
    dry, nothing = told("answer", "--pack", path, "--question", "What is a cell?", "--question", "unrelated words entirely", "--dry-run")
    assert dry["evidence"][0] == "The smallest unit of life." and "[1] The smallest unit of life." in dry["prompt"] and "answer" not in dry
    assert nothing["evidence"] == [] and not nothing["supported"]
    assert {r["kind"] for r in told("summary", "--pack", path)} == {"overview", "key_points", "exam_focus"}
    (plan,) = told("summary", "--pack", path, "--dry-run")
    assert plan["evidence"] == ["text 0 0", "text 0 1", "text 0 2", "said 0", "said 1"]
    assert told("doctor")[0]["spark"].startswith("4.")
