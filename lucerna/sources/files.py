"""Files: text, Markdown, CSV, folders of uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import text as X
from lucerna.sources import pdf


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: names in lower case, cells trimmed, missing ones '', blank rows dropped; of two columns with one name the later counts."""
    raw = spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    head = raw.first()
    if head is None:
        return raw
    names = [(x or "").strip().lower() for x in head]
    last = {n: k for k, n in enumerate(names)}
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema=", ".join(f"c{k} string" for k in range(len(names))), enforceSchema=True)
    cell = lambda k: F.coalesce(F.trim(f"c{k}"), F.lit(""))
    some = F.concat(*[cell(k) for k in range(len(names))]) != ""
    return rows.where(some).select(*[cell(k).alias(n) for n, k in last.items()])


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Name, extension, kind, error, size, checksum and content of the files in a folder."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        name.alias("name"), X.extension(name).alias("extension"), X.base_name(name).alias("base_name"), X.file_kind(X.base_name(name)).alias("kind"),
        X.extension_error(X.extension(name)).alias("error"), F.col("length").alias("size_bytes"), X.checksum("content").alias("checksum"), "path", "content",
    )


def texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text files with their text, and those without any."""
    decoded = files.where(~F.col("extension").isin(X.IMAGES + X.VIDEOS + ["pdf", "pptx"])).withColumn("text", F.col("content").cast("string"))
    blank = F.coalesce(X.strip("text"), F.lit("")) == ""
    return decoded.where(~blank), decoded.where(blank)


def with_pdf_texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The PDF files among uploads with their text, and those that give none, with the reason as error."""
    found = files.where("extension = 'pdf'").drop("text").join(pdf.pdf_texts(files.where("extension = 'pdf'")), "path")
    return found.where("problem is null").drop("problem"), found.where("problem is not null").withColumn("error", F.col("problem")).drop("problem", "text")


def matched_by_name(uploads: DataFrame, sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """Uploads (session_id, file_name) with the source and the parsed file of their name: of sources that share one the first, of parsed
    files the last. An upload without a source is left out; without a parsed file its column is null.

    sources and parsed: session_id, position, name and what else they have; the result has them as structs.
    """
    one = lambda df, pick, out: df.groupBy("session_id", F.col("name").alias("file_name")).agg(pick(F.struct(*df.columns), "position").alias(out))
    return uploads.join(one(sources, F.min_by, "source"), ["session_id", "file_name"]).join(one(parsed, F.max_by, "parsed"), ["session_id", "file_name"], "left")
