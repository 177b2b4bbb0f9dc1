"""python -m tracelens.cli COMMAND: ingest, query, ablate, evaluate and schema over files; for spark-submit as well."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import engine, session
from .operators import counterfactual, ingest, suites
from .plans import report
from .plans.config import ABLATIONS, COMPOSITES
from .sources import files, fixtures


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tracelens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest", help="Markdown trees into an index")
    one.add_argument("roots", nargs="+")
    one.add_argument("--index", required=True)
    for name, text in (("query", "traces of a test set"), ("ablate", "a sweep over a test set")):
        one = commands.add_parser(name, help=text)
        one.add_argument("--index", required=True)
        one.add_argument("--testset", required=True)
        one.add_argument("--out", required=True)
        one.add_argument("--ablations", nargs="*", default=["baseline"] if name == "query" else [*ABLATIONS, *COMPOSITES])
    one = commands.add_parser("evaluate", help="the isolation suite; exit status 1 if a probe fails")
    one.add_argument("--out", required=True)
    commands.add_parser("schema", help="schema of a trace")
    return parser.parse_args(argv)


def _questions(cases):
    return cases.select(F.xxhash64("case_id").alias("query_id"), "case_id", "tenant_id", "query", "kind", "answer_key")


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or session.build()
    session.ship(spark)
    if a.command == "ingest":
        chunks = session.cut(ingest.chunk_markdown(files.union_roots(spark, a.roots)).drop("heading_path"))
        version = ingest.corpus_version(chunks.select("tenant_id", F.col("chunk_id").alias("doc_id"), "text")).first()[0]
        none = spark.createDataFrame([], "query_id long, tenant_id string, query string")
        engine.Engine(spark, chunks, none).save(a.index, version)
        print(f"{chunks.count()} chunks, {version}")
    elif a.command in ("query", "ablate"):
        cases = _questions(files.read_testset(spark, a.testset))
        e = engine.Engine.load(spark, a.index, cases.select("query_id", "tenant_id", "query"))
        if a.command == "query":
            files.write_traces(e.query(a.ablations, files.read_meta(spark, a.index)["version"]), a.out)
        else:
            d = session.cut(counterfactual.diffs(e.run(a.ablations)["answers"], cases.select("query_id", "kind", "answer_key")))
            files.write_diffs(d, a.out)
            print(report.table(counterfactual.tabulate(d), "Outcomes"))
    elif a.command == "evaluate":
        asked = suites.isolation_questions(spark)
        e = engine.Engine(spark, suites.competing_chunks(spark), asked.select("query_id", "tenant_id", "query"))
        found = suites.guard(spark, {"isolation": suites.failed_suite(spark, "isolation", lambda: suites.isolation(e, asked))})
        files.write_ndjson(found, a.out)
        print(report.table(found.orderBy("case_id"), "Isolation"))
        failed = found.where("not passed")
        return report.exit_code(failed.count(), failed.where("severity >= 3").count())
    else:
        docs = spark.createDataFrame([], "tenant_id string, doc_id string, text string")
        none = spark.createDataFrame([], "query_id long, tenant_id string, query string")
        print(files.schema_json(engine.Engine(spark, fixtures.chunks(docs), none).query()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
