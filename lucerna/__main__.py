"""Questions about a pack, and summaries of it, from the command line.

python -m lucerna doctor [--json]
python -m lucerna answer --pack PACK.json --question "..." [--question "..."] [--dry-run] [--json]
python -m lucerna summary --pack PACK.json [--dry-run] [--json]

--dry-run prints the evidence and the prompt instead of an answer or a summary.
"""

from __future__ import annotations

import argparse
import json
import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.operators import context, decide, reads
from lucerna.plans import api
from lucerna.sources import packs

INSTRUCTION = "Summarize the session using only the evidence."


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lucerna")
    commands = p.add_subparsers(dest="command", required=True)
    doctor = commands.add_parser("doctor", help="what this installation runs on")
    doctor.add_argument("--json", action="store_true")
    for name, text in (("answer", "answer questions from a pack"), ("summary", "summarize a pack's sessions")):
        c = commands.add_parser(name, help=text)
        c.add_argument("--pack", required=True, help="a JSON pack, or a folder or pattern of some")
        c.add_argument("--dry-run", action="store_true", help="the evidence and the prompt only")
        c.add_argument("--json", action="store_true")
        if name == "answer":
            c.add_argument("--question", action="append", required=True)
        else:
            c.add_argument("--instruction", default=INSTRUCTION)
    return p


def report(spark: SparkSession) -> list[dict]:
    conf = spark.conf
    return [{"python": platform.python_version(), "spark": pyspark.__version__, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "checkpoints": conf.get("spark.checkpoint.dir", ""), "warehouse": conf.get("spark.sql.warehouse.dir")}]


def answers(spark: SparkSession, tables: dict[str, DataFrame], asked: list[str], dry: bool) -> list[dict]:
    """Each question is put to each session of the packs."""
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(asked)], "n int, question string")
    sessions = tables["lecture_sessions"].select(F.col("id").alias("session_id"))
    questions = rows.crossJoin(F.broadcast(sessions)).withColumn("question_id", F.concat_ws("_", F.col("n").cast("string"), "session_id"))
    if dry:
        found = api.matches(questions, tables).where(F.col("rank") <= decide.REASONED).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))), lambda e: e["excerpt"]).alias("evidence"))
        out = questions.join(found, "question_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))).withColumn("supported", F.size("evidence") > 0)
        out = out.select("n", "session_id", "question", "supported", "evidence", context.prompt(F.col("question"), F.col("evidence")).alias("prompt"))
    else:
        told, _ = api.ask(questions, tables)
        out = told.join(questions, "question_id").select("n", "session_id", "question", "supported", "answer", "confidence")
    return [r.asDict() for r in out.orderBy("n", "session_id").drop("n").toLocalIterator()]


def summaries(tables: dict[str, DataFrame], instruction: str, dry: bool) -> list[dict]:
    placed = reads.chunks_in_order(tables["material_chunks"], tables["lecture_materials"])
    chunks, entries = placed.withColumn("order_index", F.col("rank")), tables["transcript_entries"]
    if dry:
        said = context.first_of(chunks, "session_id", ["order_index", "id"], 3, "chunks", F.col("text")).join(context.first_of(entries, "session_id", ["order_index", "id"], 2, "entries", F.col("text")), "session_id", "full_outer")
        none = F.array().cast("array<string>")
        out = said.select("session_id", F.concat(F.coalesce("chunks", none), F.coalesce("entries", none)).alias("evidence")).withColumn("prompt", context.prompt(F.lit(instruction), F.col("evidence")))
        return [r.asDict() for r in out.orderBy("session_id").toLocalIterator()]
    return [r.asDict() for r in context.summaries(chunks, entries).orderBy("session_id", "kind").toLocalIterator()]


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lucerna").getOrCreate()
    if args.command == "doctor":
        found = report(spark)
    else:
        tables = packs.tables(packs.read_packs(spark, args.pack), "")
        if args.command == "answer":
            found = answers(spark, {k: v for k, v in tables.items() if k != "evidence_units"}, args.question, args.dry_run)
        else:
            found = summaries(tables, args.instruction, args.dry_run)
    for row in found:
        print(json.dumps(row, ensure_ascii=False) if args.json else "\n".join(f"{k}: {v}" for k, v in row.items()) + "\n")


if __name__ == "__main__":
    main()
