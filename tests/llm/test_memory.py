"""What a task's Python worker and Spark hold for it is bounded, and one set of workers serves an executor."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lucerna.llm import common, pieces, quality_rules
from tests.conftest import SF


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_batches_of_every_stage_are_small(spark):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes], "rows": [b.num_rows]})

    for name, stage in corpus_pipeline.STAGES:
        if name == "mixing":
            continue  # holds no Python
        own = spark.newSession()
        stage(own, common.table(own, SF, "documents"), SF)
        texts = own.range(1000, numPartitions=1).select("id", F.repeat(F.lit("word "), 3000).alias("text"))
        found = texts.mapInArrow(size, "size long, rows long").agg(F.max("size"), F.sum("rows")).first()
        assert found[0] < common.BATCH_BYTES + 100_000 and found[1] == 1000, name


def test_a_limit_of_the_session_stays(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000b")
    common.small_batches(own)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000b"


def test_hot_keys_pass_without_python_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    unique = rows.groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct("id", F.encode(F.col("k").cast("string"), "UTF-8").alias("b"))).alias("c"))
    found = common.looked_up(rows, unique, ["k"], "n")
    assert found.schema["c"].dataType == unique.schema["c"].dataType
    assert "ExistingRDD" not in _plan(found)
    assert sorted(found.select("id", "n", "c").collect()) == sorted(rows.join(unique, "k").select("id", "n", "c").collect())


def test_wanted_cells_pass_without_python_rows(spark, monkeypatch):
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(type(data)) or create(self, data, *a, **k))
    parts = spark.range(1000).select(F.lit(3).alias("band"), (1 + F.col("id") / 1000).alias("ratio"))
    low, high = quality_rules._quantiles(parts)[3]
    assert abs(low - 1.001998) < 1e-9 and abs(high - 1.997002) < 1e-9
    assert made == [pa.Table]


def test_a_small_memo_gives_the_same_tokens():
    t = pieces.load()
    texts = [f"word{k} other{k % 7} some text" for k in range(500)]
    memo = {}
    small = [pieces.encode_texts(t, texts[k : k + 50], memo, 120) for k in range(0, 500, 50)]
    assert len(memo) <= 120
    assert sum(small, []) == pieces.encode_texts(t, texts, {}, 10_000)
