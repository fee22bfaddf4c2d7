from lucerna.functions import text as X
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_strip_takes_every_kind_of_white_space(spark):
    assert one(spark, X.normalize(F.lit(" \t Ab ﻿\n"))) == "ab"


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    assert one(spark, X.tokenize(F.lit("The cat, a CAT é1 x 42!"))) == ["cat", "cat", "42"]
    assert one(spark, X.unique(X.tokenize(F.lit("cat dog cat")))) == ["cat", "dog"]


def test_excerpt_counts_its_dots(spark):
    assert one(spark, X.excerpt(F.lit("a" * 10), 10)) == "a" * 10
    assert one(spark, X.excerpt(F.lit("abcdef ghijk"), 10)) == "abcdef..."


def test_slug_and_title(spark):
    assert one(spark, X.slug(F.lit(" -- "))) == "item"
    assert one(spark, X.display_title(F.lit("week_2-introNotes"))) == "Week 2 IntroNotes"


def test_clock_goes_beyond_an_hour(spark):
    assert one(spark, X.clock(F.lit(6005))) == "100:05"
    assert one(spark, X.clock(F.lit(-3))) == "00:00"
    assert one(spark, X.clock_seconds(F.lit("at 1:02:03"))) == 3723
    assert one(spark, X.clock_seconds(F.lit("none"))) is None


def test_string_list_drops_what_is_no_string(spark):
    assert one(spark, X.string_list(F.lit('["a", 1, null, "b"]'))) == ["a", "b"]
    assert one(spark, X.string_list(F.lit("{"))) == []
    assert one(spark, X.string_list(F.lit('{"a": 1}'))) == []


def test_spoken_list(spark):
    for items, said in (([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")):
        assert one(spark, X.spoken_list(F.array(*map(F.lit, items)).cast("array<string>"))) == said


def test_kind_ladder(spark):
    for name, kind in (("week1_glossary", "glossary"), ("public_qa", "public_qa"), ("metaphor", "material"), ("session-summary", "session")):
        assert one(spark, X.file_kind(F.lit(name))) == kind


def test_embedded_json(spark):
    assert one(spark, X.embedded_json(F.lit('so {"a": {"b": 1}} done'))) == '{"a": {"b": 1}}'
    assert one(spark, X.embedded_json(F.lit("so {a"))) == "{}"


def test_transcript_line(spark):
    t = one(spark, X.transcript_line(F.lit("[01:05] Ann Lee: good morning"), F.lit(3)))
    assert (t["speaker"], t["text"], t["started_at"]) == ("Ann Lee", "good morning", 65)
    t = one(spark, X.transcript_line(F.lit("good morning"), F.lit(3)))
    assert (t["speaker"], t["text"], t["started_at"]) == ("Lecture", "good morning", 90)


def test_xml_decodes_the_ampersand_last(spark):
    assert one(spark, X.xml_decode(F.lit("a &amp;lt; b &lt;"))) == "a &lt; b <"


def test_answer_text(spark):
    said = "Tin is soft."
    for value, question, answer in (
        (f"{said}\n\nInstruction: only local.\nEvidence:\n1. Tin", "What is tin?", said),
        (f"<thinking>a\nb</thinking>\nFinal answer:\n{said}", "?", said),
        (f"<|channel>thought x<channel|>{said}<turn|>", "", said),
        (f"what IS tin: {said}", " What is tin?! ", said),
        ("What is tin", "What is tin?", ""),
        ("Answer:\n1. a\nanalysis: b\n2.5 parts", "q", "2.5 parts"),
        (said, None, said),
    ):
        assert one(spark, X.answer_text(F.lit(value), F.lit(question).cast("string"))) == answer


def test_unit_payload(spark):
    u = one(spark, X.unit_payload(F.lit('{"title": " ", "excerpt": " e "}'), F.lit("T")))
    assert tuple(u) == ("T", "e", "e", "T e")
    assert tuple(one(spark, X.unit_payload(F.lit("no json"), F.lit("T")))) == ("T", "", "T", "T")
    u = one(spark, X.unit_payload(F.lit('{"title": "A", "contentText": "c", "searchText": "s"}'), F.lit("T")))
    assert tuple(u) == ("A", "c", "c", "s")
