"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from lucerna.llm import embedding_dedup, html_text, language_id, minhash_dedup, mixing, ngram_lm, pieces, quality_rules, toxicity, warc

LONG = "the quick brown fox jumps over a lazy dog " * 4000
ROWS = [
    (1, "the cat sat on the mat and looked at the other cat that sat there too", "en", "a", 0, 1),
    (2, None, None, None, 0, 2),
    (3, "", "en", "a", 0, 3),
    (4, " \t\n ", "en", None, 0, 4),
    (5, LONG, "en", "b", 0, 5),
    (None, "der Hund und die Katze sind im Haus und sehen aus dem Fenster in den Garten", "de", "b", 0, 6),
    (7, "12 34 !!", "en", "b", 0, 7),
    (8, "der Hund und die Katze sind im Haus und sehen aus dem Fenster in den Garten", "de", "b", 0, 8),
    (8, "der Hund und die Katze sind im Haus und sehen aus dem Fenster in den Garten", "de", "b", 0, 8),
    (9, "x" * 5000 + " 😀 ▁ \0 é", "en", "b", 0, 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int, n_words int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r[column])
    return out


def test_quality(docs, none):
    got = by_id(quality_rules.quality_signals(docs), "n_words")
    assert got[2] == got[3] == got[4] == [0] and got[8] == [16, 16] and got[5] == [36000]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and 5 not in by_id(kept, "n_words")
    assert quality_rules.quality_signals(none).count() == quality_rules.keep_good(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.taken == 0 for r in got if r.size == 0) and all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.apply_mix(docs).columns == docs.columns
    assert mixing.mix(none).count() == mixing.apply_mix(none).count() == 0


def test_pieces(docs, none):
    got = docs.count()
    rows = pieces.encode(docs).collect()
    assert len(rows) == got and all(r.decoded_ok for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [0, 0]
    assert pieces.add_tokens(docs).columns[: len(docs.columns)] == docs.columns
    assert pieces.encode(none).count() == 0


def test_language(docs, none):
    model = language_id.train(docs)
    got = by_id(language_id.label(docs, model), "lang_pred")
    assert got[2] == got[3] == got[4] == got[7] == ["und"] and got[8] == ["de", "de"] and got[1] == ["en"] and got[None] == ["de"]
    assert language_id.keep_known(docs, model).columns == docs.columns
    empty = language_id.train(none)
    assert set(by_id(language_id.label(docs, empty), "lang_pred")[1]) == {"und"}
    assert language_id.label(none, model).count() == 0


def test_dedup(spark, docs, none):
    got = by_id(minhash_dedup.groups(docs), "class_id")
    assert got[None] == [None] and got[8] == [8, 8] and got[2] == [2] and got[3] == [3] and got[4] == [4]
    assert sorted(by_id(minhash_dedup.groups(docs), "kept")[8]) == [False, True]
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.n_words for r in kept.select("doc_id", "n_words").collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert minhash_dedup.groups(none).count() == minhash_dedup.keep_one(none).count() == 0


def test_dedup_of_rows_that_repeat(spark):
    """One row of each group stays, whether rows repeat whole, repeat an id with another text, or are copies."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "p"), (1, a, "p"), (1, a.upper(), "q"), (2, a, "r"), (3, b, "s"), (3, c, "t"), (4, c, "u"), (5, None, "v"), (5, None, "w"), (5, "", "x"), (6, "", "y"), (None, a, "z"), (None, a, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string").repartition(4)
    kept = sorted(tuple(r) for r in minhash_dedup.keep_one(df.select("doc_id", "text", "_id")).fillna(0, ["doc_id"]).select("doc_id", "_id").collect())
    assert [k for k, _ in kept] == [0, 0, 1, 3, 3, 5, 6] and {x for k, x in kept if k == 3} == {"s", "t"}
    assert kept == sorted(tuple(r) for r in minhash_dedup.keep_one(df.repartition(2)).fillna(0, ["doc_id"]).select("doc_id", "_id").collect())
    got = minhash_dedup.groups(df).where("doc_id is not null").collect()
    assert len(got) == 11 and sum(r.kept for r in got) == 5 and {r.class_id for r in got if r.doc_id in (1, 2)} == {1} and {r.class_id for r in got if r.doc_id == 4} == {3}


def test_ngrams(docs, none):
    got = by_id(ngram_lm.score(docs), "n_tokens")
    assert got[2] == got[3] == got[4] == [1] and got[8] == [17, 17] and got[None] == [17]
    assert ngram_lm.score(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(toxicity.training_rows(docs, labels))).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, toxicity.Model([], None, 0.0)).count() == 0


def test_html(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>a<p>b", 1), (4, "u", "<div" * 3000, 1), (4, "u", "<div>" * 20000 + "deep text here, and more of it to read", 1), (5, "u", "<script>x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert [(r.text, r.n_chars) for r in got[:3]] == [("", 0), ("", 0), ("a\nb", 3)]
    assert got[4].text.startswith("deep text") and got[5].text == ""
    assert html_text.extract(pages.limit(0)).count() == 0


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [2.0, 0.0], 5), (3, None, 5), (4, [0.0, 0.0], 5), (5, [float("nan"), 1.0], 5), (6, [None, 1.0], 5), (7, [1.0, 0.0], 5), (8, [0.0, 1.0], 5), (9, [1.0, 0.0, 0.0], 5), (10, [], 5), (11, [float("inf"), 1.0], 5)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(v).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[7] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 8, 9, 10, 11))
    assert embedding_dedup.near_duplicates(v.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "response", "http://A.com/x/", 5, {"etag": '"1"', "x": "y"}), (2, "revisit", "https://www.a.com/x#f", 9, {"etag": 'W/"1"', "x": "z", "date": "d"}), (3, "revisit", "a.com/x", 5, None), (4, "revisit", None, 9, None), (5, "revisit", "a.com/x", 9, {"etag": '"2"'}), (6, "revisit", "a.com/x", 9, {}), (7, "revisit", "a.com/x", None, {})]
    c = spark.createDataFrame([r + ("extra",) for r in rows], "record_id long, kind string, url string, time long, headers map<string,string>, outcome string")
    got = {r.record_id: (r.response_id, r.outcome, r.headers) for r in warc.resolve(c, bin_width=2).collect()}
    assert got[2] == (1, "resolved", {"etag": 'W/"1"', "x": "y", "date": "d"})
    assert [got[k][1] for k in (3, 4, 5, 6, 7)] == ["no_response", "no_response", "mismatch", "unvalidated", "no_response"]
    assert warc.resolve(c.limit(0)).count() == 0
