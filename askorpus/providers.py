"""What the jobs need from a model, and offline stand-ins that are deterministic.

A provider hands over columns or frames, so a networked one can be a pandas UDF
(or ``mapInPandas``) while the defaults below need no service.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askorpus.config import Settings
from askorpus.functions import text as tx


class Embedder(Protocol):
    def column(self, text: Column) -> Column:
        """array<float> of a text."""


class Router(Protocol):
    def column(self, question: Column, history: Column) -> Column:
        """'direct', 'structured' or 'rag'; history is array<struct<role,content>>."""


class ChatModel(Protocol):
    def generate(self, turns: DataFrame, prompts: DataFrame) -> DataFrame:
        """(turn_id, seq, token, error) for each turn.

        ``turns`` has one row per turn with its context; ``prompts`` has the
        messages as rows (turn_id, seq, role, content) so that a long thread
        never has to become one value.
        """


class Fetcher(Protocol):
    def fetch(self, frontier: DataFrame) -> DataFrame:
        """(url, source, html, extract, error) for the URLs of a frontier."""


@dataclass(frozen=True)
class ModelCall:
    """How a chat or router model is to be called."""

    host: str
    model: str
    temperature: float
    context_tokens: int
    reasoning: bool = False


# Context sizes of the two kinds of call.
CHAT_CONTEXT_TOKENS = 8192
ROUTER_CONTEXT_TOKENS = 2048


def chat_call(settings: Settings, temperature: float | None = None) -> ModelCall:
    return ModelCall(settings.ollama_host, settings.llm_model,
                     settings.temperature if temperature is None else temperature,
                     CHAT_CONTEXT_TOKENS)


def router_call(settings: Settings) -> ModelCall:
    # routing has a model of its own only where one is named
    named = settings.llm_router_model.strip()
    return ModelCall(settings.ollama_host, named if named else settings.llm_model, 0.0, ROUTER_CONTEXT_TOKENS)


@dataclass(frozen=True)
class PageTable:
    """Pages that were fetched beforehand: (url, html, extract, error), one row per URL."""

    pages: DataFrame

    def fetch(self, frontier: DataFrame) -> DataFrame:
        return frontier.select("url", "source").join(
            self.pages.select("url", "html", "extract", "error"), "url", "left")


@dataclass(frozen=True)
class FunctionFetcher:
    """Calls ``one(url, source) -> (html, extract, error)`` for every URL. What it
    raises becomes the error.

    A host is fetched by at most ``per_host`` tasks at a time; different hosts are
    fetched by as many tasks as the session shuffles into."""

    one: Callable[[str, str], tuple[str | None, str | None, str | None]]
    per_host: int = 8

    def fetch(self, frontier: DataFrame) -> DataFrame:
        one = self.one

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for url, source in zip(batch["url"], batch["source"]):
                    try:
                        rows.append((url, source, *one(url, source)))
                    except Exception as problem:
                        rows.append((url, source, None, None, f"{type(problem).__name__}: {problem}"))
                yield pd.DataFrame(rows, columns=["url", "source", "html", "extract", "error"])

        lane = F.pmod(F.xxhash64("url"), F.lit(self.per_host))
        return frontier.select("url", "source").repartition(F.col("source"), lane).mapInPandas(
            run, "url string, source string, html string, extract string, error string")


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed feature hashing of words, scaled to length one."""

    dim: int = 64

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            slots = _Slots(dim)
            for texts in batches:
                yield texts.map(lambda t: None if t is None else _hash_words(t.split(), slots))

        return embed(F.lower(text))


class _Slots(dict):
    """word -> slot, with the slots for negative signs behind the others.

    Words are remembered while a task runs; the memory is emptied when large.
    """

    LIMIT = 1_000_000

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        number = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        slot = self[word] = number % (2 * self.dim)
        return slot


def _hash_words(words: list[str], slots: _Slots) -> np.ndarray:
    where = np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=len(words))
    counts = np.bincount(where, minlength=2 * slots.dim).astype(np.float64)
    vector = counts[:slots.dim] - counts[slots.dim:]
    length = float(np.sqrt((vector ** 2).sum()))
    return (vector / length if length else vector).astype(np.float32)


@dataclass(frozen=True)
class RuleRouter:
    """Route by words, in the spirit of the classifier's tie rules: a question
    about this thread or small talk is direct; a request for a verified fact is
    structured; a very short message is direct; everything else is rag."""

    facts: tuple[str, ...] = (
        "teléfono", "telefono", "línea ética", "linea etica", "horario", "nit",
        "razón social", "razon social", "dirección", "direccion", "ubicación", "ubicacion",
        "sede", "marcas", "portafolio", "empleo", "vacante")
    talk: tuple[str, ...] = (
        "hola", "buenos días", "buenas tardes", "buenas noches", "gracias", "chao", "adiós",
        "me llamo", "mi nombre es", "soy ", "cómo estás", "chiste")
    follow_up: tuple[str, ...] = (
        "por qué", "explícame eso", "repite", "repítelo", "continúa", "cómo me llamo",
        "el segundo", "lo anterior", "fue eso", "y eso")
    short_words: int = 3

    def column(self, question: Column, history: Column) -> Column:
        lowered = F.concat(F.lit(" "), tx.normalise(F.lower(question)), F.lit(" "))
        words = F.size(F.split(tx.normalise(question), " "))

        def starts_word(items):
            any_item = "|".join(rf"\Q{item}\E" for item in items)
            return F.rlike(lowered, F.lit(rf"[^\p{{L}}\p{{N}}_](?:{any_item})"))

        return (F.when(starts_word(self.talk), F.lit("direct"))
                .when(starts_word(self.follow_up) & (F.size(history) > 0), F.lit("direct"))
                .when(starts_word(self.facts), F.lit("structured"))
                .when(words <= self.short_words, F.lit("direct"))
                .otherwise(F.lit("rag")))


@dataclass(frozen=True)
class ExtractiveChat:
    """Answers with the first paragraph of the context, token by token."""

    def generate(self, turns: DataFrame, prompts: DataFrame) -> DataFrame:
        reply = self.reply(F.col("context"))
        return turns.select(
            "turn_id", F.posexplode(F.regexp_extract_all(reply, F.lit(r"(\S+\s*)"), F.lit(1)))
            .alias("seq", "token"), F.lit(None).cast("string").alias("error"))

    @staticmethod
    def reply(context: Column) -> Column:
        inner = F.regexp_extract(context, r"(?s)<contexto>\n(.*?)\n</contexto>", 1)
        body = F.when(F.length(inner) > 0, inner).otherwise(context)
        return F.substring_index(body, "\n---\n", 1)
