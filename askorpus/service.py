"""One object with the operations of the whole application."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askorpus.config import Settings
from askorpus.functions.rules import Rule
from askorpus.operators.chunking import Splitter, recursive_splitter
from askorpus.operators.stats import corpus_stats, stats_note
from askorpus.plans import crawl as cr
from askorpus.plans import ingest as ing
from askorpus.plans import threads as th
from askorpus.plans import turns as tn
from askorpus.plans.health import health
from askorpus.providers import (
    ChatModel, Embedder, ExtractiveChat, Fetcher, HashingEmbedder, Router, RuleRouter)
from askorpus.sources import failures, rawdocs, sitemaps
from askorpus.sources.staging import staged
from askorpus.sources.store import Store
from askorpus.streaming.turns import before_turns, stored_history, turn_messages


class Service:
    """Raw documents, corpus and threads under one root folder."""

    def __init__(self, spark: SparkSession, root: str, rules: Sequence[Rule],
                 settings: Settings | None = None, embedder: Embedder | None = None,
                 router: Router | None = None, chat: ChatModel | None = None,
                 splitter: Splitter | None = None) -> None:
        self.spark, self.rules = spark, rules
        self.settings = settings or Settings()
        self.embedder = embedder or HashingEmbedder()
        self.router, self.chat = router or RuleRouter(), chat or ExtractiveChat()
        self.splitter = splitter or recursive_splitter(
            self.settings.chunk_size, self.settings.chunk_overlap)
        self.raw = Store(spark, f"{root}/raw", cr.TABLES)
        self.corpus = Store(spark, f"{root}/corpus", ing.TABLES)
        self.threads = th.ThreadStore(Store(spark, f"{root}/threads", th.TABLES), self.settings)
        self._note: str | None = None

    # -- filling the corpus ------------------------------------------------

    def _hosts(self) -> dict[str, str]:
        """Both spellings of each site's host lead to the one its sitemap uses."""
        hosts = {}
        for site in self.settings.sites:
            base = site.sitemap_url.split("/", 3)
            host = base[2].lower().removeprefix("www.")
            hosts[host] = hosts[f"www.{host}"] = f"{base[0]}//{base[2]}"
        return hosts

    def frontier(self, files: DataFrame, pages: DataFrame, site: str = "all",
                 limit: int = 0) -> DataFrame:
        sites = [s for s in self.settings.sites if site in ("all", s.name)]
        return sitemaps.frontier(self.spark, sites, files, pages, self._hosts(), limit)

    def crawl(self, frontier: DataFrame, fetcher: Fetcher, fetched_at: str, force: bool = False,
              failure_log: str | None = None) -> DataFrame:
        """Fetch a frontier into the raw table; failures go to the log."""
        news = [s.name for s in self.settings.sites if s.has_news]
        results = cr.crawl(self.raw, fetcher.fetch(frontier), news, self.settings.news_site,
                           fetched_at, force)
        if failure_log:
            failures.write_failures(results, failure_log)
        return results

    def retry(self, failure_log: str, fetcher: Fetcher, fetched_at: str, site: str = "all",
              limit: int = 0, force: bool = False) -> DataFrame:
        """Fetch again what the log names, and rewrite the log without what now worked."""
        names = [s.name for s in self.settings.sites]
        lines = staged(self.spark.read.text(failure_log), "failure-log")
        again = staged(failures.retry_frontier(
            failures.parse_failures(lines, names), site, limit), "retry-frontier")
        results = self.crawl(again, fetcher, fetched_at, force)
        # what was tried keeps its line only where it failed again; the rest stays as it is
        rest = failures.lines_not_of(lines, again)
        rest.unionAll(failures.failure_lines(results)).write.mode("overwrite").text(failure_log)
        return results

    def ingest(self, json_path: str | None = None, only: str | None = None, dry_run: bool = False,
               compat: bool = False, prune: bool = False) -> DataFrame:
        """Bring the corpus up to date with the raw table, or with a folder of
        JSON files; ``only`` keeps documents whose JSON contains a substring."""
        if json_path is not None:
            texts = rawdocs.read_json_texts(self.spark, json_path)
            # a URL in two files is one document: its newest fetch
            docs = rawdocs.newest_per_url(rawdocs.good_docs(rawdocs.parse_raw(texts, only)))
        else:
            docs = self.raw.read("raw")
            if only:
                body = rawdocs.to_json_text(*[F.col(c) for c in docs.columns])
                docs = docs.filter(F.contains(body, F.lit(only)))
        return ing.ingest(self.corpus, docs, self.splitter, self.embedder, dry_run, compat, prune)

    def corrupt(self, json_path: str) -> DataFrame:
        """The documents of a folder that ``ingest`` cannot read."""
        return rawdocs.bad_docs(rawdocs.parse_raw(rawdocs.read_json_texts(self.spark, json_path)))

    def unknown_hosts(self, failure_log: str) -> DataFrame:
        """The URLs of a failure log that belong to no known site; ``retry`` leaves them."""
        return failures.unknown_hosts(self.spark.read.text(failure_log), [s.name for s in self.settings.sites])

    # -- asking ------------------------------------------------------------

    def chunks(self) -> DataFrame:
        return self.corpus.read("chunks")

    def note(self) -> str:
        """The corpus counts as a sentence; computed once until ``refresh``."""
        if self._note is None:
            stats = corpus_stats(self.chunks())
            self._note = stats_note(stats, self.settings.news_site).first().note
        return self._note

    def refresh(self) -> None:
        self._note = None

    def engine(self) -> tn.Engine:
        return tn.Engine(self.chunks(), self.rules, self.embedder, self.router, self.chat,
                         self.note(), self.settings)

    def ask(self, requests: DataFrame, batch_name: str, remember: bool = True) -> tn.TurnResult:
        """Answer (turn_id, thread_id, question, temperature, top_k) requests."""
        earlier = before_turns(self.threads.messages(), requests)
        result = tn.run_turns(requests, stored_history(earlier), self.engine())
        if remember:
            self.threads.append(turn_messages(result, F.current_timestamp()), batch_name)
        return result

    # -- upkeep ------------------------------------------------------------

    def health(self, model_probe: Callable[[], object] | None = None) -> DataFrame:
        return health(self.spark, self.chunks, self.threads.threads, model_probe, self.settings)

    def compact(self) -> None:
        for store in (self.raw, self.corpus, self.threads.store):
            store.compact()

    def reset(self, confirm: bool = False) -> None:
        """Forget corpus and threads. Raw documents stay."""
        self.corpus.reset(confirm)
        self.threads.store.reset(confirm)
        self.refresh()
