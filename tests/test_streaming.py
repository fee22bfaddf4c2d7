import json

from lucerna.streaming import index


def row(i, text, at):
    return {"asset_id": i, "session_id": "s", "name": f"{i}.txt", "extension": "txt", "text": text, "queued_at": at}


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    first = [row("a", "one\n\ntwo", "1"), row("b", " ", "1")]
    (source / "1.json").write_text("\n".join(map(json.dumps, first)))
    index.start(spark, str(source), root).awaitTermination()
    second = [row("a", "three", "2"), row("c", "four", "2")]
    (source / "2.json").write_text("\n".join(map(json.dumps, second)))
    index.start(spark, str(source), root).awaitTermination()
    index.start(spark, str(source), root).awaitTermination()
    got = {(r.asset_id, r.content_text) for r in index.current_units(spark, root).collect()}
    every = spark.createDataFrame([tuple(r.values()) for r in first + second], index.ASSET)
    assert got == {(r.asset_id, r.content_text) for r in index.units_of(every).collect()} == {("a", "three"), ("c", "four")}
    states = {r.asset_id: r.status for r in index.latest_states(spark.read.parquet(f"{root}/states")).collect()}
    assert states == {"a": "ready", "b": "failed", "c": "ready"}
    words = {(r.asset_id, t) for r in index.current_index(spark, root).units.collect() for t in r.tokens}
    assert {("a", "three"), ("c", "four")} <= words and not words & {("a", "one"), ("a", "two")}
    assert {(r.asset_id, r.text) for r in index.current(spark, root, "digests").collect()} == {("a", "three"), ("c", "four")}


def test_an_asset_that_becomes_empty_has_no_units(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k, text in enumerate(("one", " ")):
        (source / f"{k}.json").write_text(json.dumps(row("a", text, str(k))))
        index.start(spark, str(source), root).awaitTermination()
    assert index.current_units(spark, root).count() == 0 == index.current(spark, root, "digests").count()


def test_a_broken_asset_fails_alone(spark, tmp_path):
    """Between two good ones, in the batch's order; when it comes again whole it is indexed, and its message goes."""
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rows = [row("a", "one", "1"), row("b", "[1, ", "2") | {"name": "b.json", "extension": "json"}, row("c", "\n \t", "3"), row("d", "four", "4"), row("e", None, "5")]
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    index.start(spark, str(source), root).awaitTermination()
    states = {r.asset_id: (r.status, r.error_message) for r in index.latest_states(spark.read.parquet(f"{root}/states")).collect()}
    assert {k: v[0] for k, v in states.items()} == {"a": "ready", "b": "failed", "c": "failed", "d": "ready", "e": "failed"}
    assert states["a"][1] is None and "not valid JSON" in states["b"][1] and "No text" in states["c"][1] and "No text" in states["e"][1]
    assert [r.asset_id for r in spark.read.parquet(f"{root}/states").where("step = 2").orderBy("place").collect()] == list("abcde")
    assert {r.asset_id for r in index.current_units(spark, root).collect()} == {"a", "d"} == {r.asset_id for r in index.current_index(spark, root).units.collect()}
    (source / "2.json").write_text(json.dumps(rows[1] | {"text": "[1, 2]", "queued_at": "6"}) + "\n" + json.dumps(row("a", " ", "7")))
    index.start(spark, str(source), root).awaitTermination()
    states = {r.asset_id: (r.status, r.error_message) for r in index.latest_states(spark.read.parquet(f"{root}/states")).collect()}
    assert states["b"] == ("ready", None) and states["a"][0] == "failed"
    assert {r.asset_id for r in index.current_index(spark, root).units.collect()} == {"b", "d"}
