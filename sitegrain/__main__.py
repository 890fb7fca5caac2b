"""Command line: ``python -m sitegrain list``, ``run QUERY FOLDER`` and ``report FOLDER OUT``."""

from __future__ import annotations

import argparse

#: What a report shows of a crawl.
SECTIONS = ("crawl_summary", "technical_issue_counts", "prioritised_issues", "broken_internal_links", "orphan_pages", "url_issue_frequency", "host_categories", "vitals_summary", "technology_counts")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sitegrain", description="queries over a folder of Parquet tables")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="print the first rows of a query, or write it whole")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--rows", type=int, default=20)
    run.add_argument("--out", help="folder for the whole result as Parquet")
    report = commands.add_parser("report", help="an HTML page and JSON tables of a crawl")
    report.add_argument("folder")
    report.add_argument("out")
    given = parser.parse_args(args)

    from .operators import sinks
    from .plans import crawling, findings, proofs, slate  # noqa: F401  the others add to the slate
    from .sources.shared import scratch_run

    if given.command == "list":
        print("\n".join(sorted(slate.QUERIES)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("sitegrain").getOrCreate()
    if given.command == "run" and given.query not in slate.QUERIES:
        parser.error(f"there is no query {given.query}")
    with scratch_run(spark):
        if given.command == "report":
            sinks.write_report(given.out, f"Crawl of {given.folder}", {name: slate.QUERIES[name](spark, given.folder) for name in SECTIONS})
            return 0
        found = slate.QUERIES[given.query](spark, given.folder)
        if given.out:
            found.write.parquet(given.out)
        else:
            found.show(given.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
