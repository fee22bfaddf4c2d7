"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words by its weight, but no more than max_epochs times its own words; what is
cut off goes to the others by weight, again and again until no source is above its cap. Sorting the sources by
cap / weight turns this repetition into one running sum: the sources cut off are a prefix. A source's documents
are then taken a whole number of times each, and the fraction left is a seeded sample of whole documents: in the
order of a hash, those that bring the running size nearest to what is wanted.

The running size is kept by (source, bin of the hash), so a source that holds a third of all rows is dealt over
BINS groups, and only per-bin sums are put in order within a source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size
0 are taken 0 words; rows that repeat a doc_id are separate documents; equal hashes are ordered by id, then
size; an empty table gives an empty result. Other columns are neither read nor returned by mix and are carried
along by apply_mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.common import WORD, cut

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS, SEED, BINS = 3, 17, 4096


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """per_source (source, source_size): one row per source. Adds target.

    One task handles this table: a row per source, never per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    rise = Window.orderBy(F.col("ratio"), F.col("place"))
    table = F.array(*[F.lit(w) for w in weights])
    ranked = (
        per_source.withColumn("place", F.row_number().over(order))
        .withColumn("weight", F.element_at(table, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("cap_before", F.sum("cap").over(rise) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(every) - F.sum("weight").over(rise) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("cap_before")).cast("double") / F.col("weight_from"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("ratio"))
    return (
        ranked.withColumn("first_fit", F.min(fits).over(every))
        .withColumn("level", F.max(F.when(fits == F.col("first_fit"), F.col("level"))).over(every))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """sizes (doc_id, source, size, ...): adds source_size, target, times (how often the mix takes the row) and taken."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))
    hashed = (
        sizes.withColumn("_u", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))
        .withColumn("_bin", F.shiftright("_u", 20))
        .withColumn("_none", F.col("source").isNull())
        .withColumn("_source", F.coalesce("source", F.lit("")))
    )
    key = ["_none", "_source", "_bin"]
    bins = hashed.groupBy(*key).agg(F.sum("size").alias("_bin_size"))
    per = bins.groupBy("_none", "_source").agg(F.sum("_bin_size").alias("source_size"))
    per = per.select(F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size")
    goal = targets(per, weights, max_epochs).select(
        F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target"
    )
    before = Window.partitionBy("_none", "_source").orderBy("_bin")
    rules = (
        bins.withColumn("_before", F.sum("_bin_size").over(before) - F.col("_bin_size"))
        .join(goal, ["_none", "_source"])
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_wanted", F.col("target") - F.col("_whole") * F.col("source_size"))
        .drop("_bin_size")
    )
    inside = Window.partitionBy(*key).orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra = F.col("_before") + F.col("_run") - F.col("size") / 2 < F.col("_wanted")
    return (
        hashed.withColumn("_run", F.sum("size").over(inside))
        .join(rules, key)
        .withColumn("times", F.when(F.col("size") > 0, F.col("_whole") + F.when(extra, 1).otherwise(0)).otherwise(0))
        .withColumn("taken", F.col("times") * F.col("size"))
        .drop("_u", "_bin", "_none", "_source", "_before", "_whole", "_wanted", "_run")
    )


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and source, times."""
    sizes = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(text_col).alias("size"))
    return plan(cut(sizes)).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def apply_mix(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (with doc_id and source) as the mix takes them: each row as often as it is taken, all columns kept."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sizes = docs.select("doc_id", "source", word_count(text_col).alias("size"), whole.alias("_row"))
    taken = plan(sizes).where("times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return taken.select("_row.*")


MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS u
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM p),
w AS (SELECT *, CAST(CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight, 3 * source_size AS cap FROM r),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place) AS BIGINT) - cap AS cap_before,
         CAST(sum(weight) OVER () AS BIGINT) - CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place) AS BIGINT) + weight AS weight_from
       FROM w),
g AS (SELECT *, CAST(total - cap_before AS DOUBLE) / weight_from AS level FROM f),
m AS (SELECT level FROM g WHERE level * weight <= cap ORDER BY CAST(cap AS DOUBLE) / weight, place LIMIT 1),
t AS (SELECT g.source, g.source_size, least(CAST(g.cap AS DOUBLE), m.level * g.weight) AS target FROM g, m),
x AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM d)
SELECT c.doc_id, c.source, c.size, x.source_size, x.target,
       CAST(CASE WHEN c.size > 0 THEN x.whole + CASE WHEN CAST(c.run AS DOUBLE) - c.size / 2.0 < x.target - x.whole * x.source_size THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS times,
       CAST(CASE WHEN c.size > 0 THEN x.whole + CASE WHEN CAST(c.run AS DOUBLE) - c.size / 2.0 < x.target - x.whole * x.source_size THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) * c.size AS taken
FROM c JOIN x ON c.source IS NOT DISTINCT FROM x.source
"""
