"""Recursive character splitting: one row per chunk of a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askorpus.operators.slices import slices

# Separators from coarse to fine; "" means single characters.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")

# A splitter maps a text column to array<string>.
Splitter = Callable[[Column], Column]


def _cuts(text: str, start: int, end: int, separator: str) -> list[int]:
    """Piece boundaries of text[start:end]; a separator opens the piece after it."""
    marks = [start]
    at = text.find(separator, start, end)
    while at != -1:
        if at > start:
            marks.append(at)
        at = text.find(separator, at + len(separator), end)
    marks.append(end)
    return marks


def _pack(marks: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Group neighbouring pieces into spans of at most ``size`` characters.

    Pieces touch, so a span is fully described by its first and last boundary,
    and dropping pieces from its front just moves the first boundary on.
    """
    first = 0
    for last in range(1, len(marks)):
        grown = marks[last]
        if grown - marks[first] > size and first < last - 1:
            yield marks[first], marks[last - 1]
            while first < last - 1 and (
                    marks[last - 1] - marks[first] > overlap
                    or grown - marks[first] > size):
                first += 1
    if marks[-1] > marks[first]:
        yield marks[first], marks[-1]


def _pack_characters(start: int, end: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The same for pieces of one character, without listing them."""
    while end - start > size:
        yield start, start + size
        start += size - min(overlap, size - 1)
    if end > start:
        yield start, end


def _spans(text: str, start: int, end: int, separators: tuple[str, ...],
           size: int, overlap: int) -> Iterator[tuple[int, int]]:
    for depth, separator in enumerate(separators):
        if separator == "":
            yield from _pack_characters(start, end, size, overlap)
            return
        if text.find(separator, start, end) != -1:
            break
    else:
        # no separator occurs and none means "characters": nothing to cut at
        yield start, end
        return
    finer = separators[depth + 1:]
    run: list[int] = []
    marks = _cuts(text, start, end, separator)
    for lo, hi in zip(marks, marks[1:]):
        if hi - lo < size:
            run = run or [lo]
            run.append(hi)
            continue
        if run:
            yield from _pack(run, size, overlap)
            run = []
        if finer:
            yield from _spans(text, lo, hi, finer, size, overlap)
        else:
            yield lo, hi
    if run:
        yield from _pack(run, size, overlap)


def split_spans(text: str, size: int, overlap: int,
                separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Where the chunks of one text are, stripped; blank ones are left out."""
    out = []
    for a, b in _spans(text, 0, len(text), separators, size, overlap):
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        b = a + len(piece.strip())
        if b > a:
            out.append((a, b))
    return out


def split_text(text: str, size: int, overlap: int,
               separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    return [text[a:b] for a, b in split_spans(text, size, overlap, separators)]


def recursive_splitter(size: int = 600, overlap: int = 100,
                       separators: tuple[str, ...] = SEPARATORS) -> Splitter:
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                yield pa.array([None if t is None else split_text(t, size, overlap, separators) for t in texts],
                               pa.list_(pa.string()))

    return split


def span_splitter(size: int = 600, overlap: int = 100,
                  separators: tuple[str, ...] = SEPARATORS) -> Splitter:
    """Like ``recursive_splitter``, giving array<struct<start,end>> in characters from 0."""
    places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                yield pa.array([None if t is None else [
                    {"start": a, "end": b} for a, b in split_spans(t, size, overlap, separators)] for t in texts], places)

    return split


def line_splitter(text: Column) -> Column:
    """One chunk per non-blank line; a JVM-side splitter."""
    lines = F.transform(F.split(text, "\n"), lambda ln: F.trim(ln))
    return F.filter(lines, lambda ln: F.length(ln) > 0)


def explode_chunks(docs: DataFrame, splitter: Splitter, text: str = "text") -> DataFrame:
    """One row per chunk with its 0-based position; the text column is dropped."""
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode(splitter(F.col(text))).alias("pos", "content"))
