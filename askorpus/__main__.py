"""Command line: fetch, ingest, ask, threads, health, compact and reset on a store."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from askorpus.config import get_settings
from askorpus.plans.crawl import count_statuses
from askorpus.plans.ingest import summarise
from askorpus.providers import PageTable
from askorpus.service import Service
from askorpus.sources.facts import read_rules


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    settings = get_settings()
    parser = argparse.ArgumentParser(prog="askorpus", description=__doc__)
    parser.add_argument("--store", default=settings.store_path)
    commands = parser.add_subparsers(dest="command", required=True)
    fetch = commands.add_parser("fetch", help="crawl a site into the raw table")
    fetch.add_argument("--site", default="all", choices=["all", *(s.name for s in settings.sites)])
    fetch.add_argument("--pages", required=True, help="Parquet of fetched pages: url, html, extract, error")
    fetch.add_argument("--sitemaps", help="Parquet of sitemap files: sitemap, xml; needed without --retry-failed")
    fetch.add_argument("--log", required=True, help="failure log: written, and read by --retry-failed")
    fetch.add_argument("--fetched-at", required=True, help="time the documents carry")
    fetch.add_argument("--force", action="store_true", help="store pages whose text is unchanged too")
    fetch.add_argument("--limit", type=int, default=0, help="URLs of each source; 0: all")
    fetch.add_argument("--concurrency", type=int, default=0, help="tasks that handle pages; 0: as the session has it")
    fetch.add_argument("--retry-failed", action="store_true", help="only what the log names")
    ingest = commands.add_parser("ingest", help="bring the corpus up to date")
    ingest.add_argument("--raw", help="folder of JSON documents; default: the raw table")
    ingest.add_argument("--only", help="substring of the JSON text")
    ingest.add_argument("--dry-run", action="store_true")
    ask = commands.add_parser("ask", help="answer a table of requests")
    ask.add_argument("--facts", required=True)
    ask.add_argument("--requests", required=True, help="Parquet of requests")
    ask.add_argument("--events", required=True, help="where the event frames go")
    ask.add_argument("--batch", required=True, help="name of this batch; repeating it is harmless")
    threads = commands.add_parser("threads", help="list a page of threads")
    threads.add_argument("--after")
    commands.add_parser("health")
    commands.add_parser("compact")
    reset = commands.add_parser("reset", help="forget corpus and threads")
    reset.add_argument("--yes", action="store_true")
    return parser.parse_args(argv)


def fetch(spark: SparkSession, service: Service, args: argparse.Namespace) -> None:
    pages = spark.read.parquet(args.pages)
    fetcher = PageTable(pages.repartition(args.concurrency) if args.concurrency else pages)
    if args.retry_failed:
        report = service.retry(args.log, fetcher, args.fetched_at, args.site, args.limit, args.force)
    else:
        if not args.sitemaps:
            raise SystemExit("fetch needs --sitemaps unless it retries")
        frontier = service.frontier(spark.read.parquet(args.sitemaps), pages, args.site, args.limit)
        report = service.crawl(frontier, fetcher, args.fetched_at, args.force, args.log)
    count_statuses(report).orderBy("source", "status").show(truncate=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args, settings = parse(argv), get_settings()
    spark = spark or SparkSession.builder.appName("askorpus").getOrCreate()
    rules = read_rules(spark, args.facts, settings) if args.command == "ask" else ()
    service = Service(spark, args.store, rules, settings)
    if args.command == "fetch":
        fetch(spark, service, args)
    elif args.command == "ingest":
        summarise(service.ingest(args.raw, args.only, args.dry_run)).show(truncate=False)
    elif args.command == "ask":
        from askorpus.plans.turns import frames

        result = service.ask(spark.read.parquet(args.requests), args.batch)
        frames(result.events).write.mode("overwrite").parquet(args.events)
    elif args.command == "threads":
        service.threads.list(args.after).orderBy("rank").show(settings.page_size, truncate=False)
    elif args.command == "health":
        service.health().show(truncate=False)
    elif args.command == "compact":
        service.compact()
    elif args.command == "reset":
        if not args.yes:
            print("reset forgets corpus and threads; repeat with --yes")
            return 1
        service.reset(confirm=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
