"""Splitting documents into chunks of a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import PARAGRAPH_GAP, SENTENCE_GAP
from weftgraph.schemas import CHUNK


def _pieces(text: str, pattern: str) -> Iterator[tuple[int, int]]:
    """Where the parts between a pattern's matches begin and end."""
    at = 0
    for gap in re.finditer(pattern, text):
        yield at, gap.start()
        at = gap.end()
    yield at, len(text)


def pack(text: str, budget: int, count: Callable[[str], int], keep_empty: bool = False) -> list[tuple]:
    """(text, start, end, at a paragraph's end, at a sentence's end) of each chunk, with offsets into the text.

    Paragraphs go into the open chunk while its pieces' tokens stay within the budget. One that is over the budget alone gives its sentences instead, and such a sentence its words; what was open is
    closed before these, so chunks are in the order of the text. Pieces are joined by a space. A word over the budget is a chunk of its own.
    """
    out: list[tuple] = []
    open_: list[tuple[int, int]] = []
    used = 0

    def close(paragraph: bool) -> None:
        nonlocal used
        if open_:
            joined = " ".join(text[a:b] for a, b in open_)
            if joined or keep_empty:
                out.append((joined, open_[0][0], open_[-1][1], paragraph, not paragraph))
        open_.clear()
        used = 0

    def add(span: tuple[int, int], paragraph: bool) -> bool:
        nonlocal used
        cost = count(text[span[0] : span[1]])
        if cost > budget:
            return False
        if open_ and used + cost > budget:
            close(paragraph)
        open_.append(span)
        used += cost
        return True

    for a, b in _pieces(text, PARAGRAPH_GAP):
        if add((a, b), True):
            continue
        for c, d in _pieces(text[a:b], SENTENCE_GAP):
            if add((a + c, a + d), False):
                continue
            close(False)
            for word in re.finditer(r"\S+", text[a + c : a + d]):
                span = (a + c + word.start(), a + c + word.end())
                if not add(span, False):
                    close(False)
                    open_.append(span)
                    close(False)
            close(False)
    close(True)
    return out


def chunk_documents(docs: DataFrame, budget: int, text_col: str = "content", count: Callable[[str], int] = lambda t: len(t.split())) -> DataFrame:
    """docs, a row for each chunk, with chunk_no, chunk, start_char, end_char and the two boundary flags. Documents without a chunk (null, empty) give no row."""

    @F.pandas_udf(CHUNK)
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = [f.name for f in CHUNK.elementType]
        for texts in batches:
            yield pd.Series([[dict(zip(names, (i, *c), strict=True)) for i, c in enumerate(pack(t or "", budget, count))] for t in texts], dtype=object)

    parts = docs.withColumn("__c", F.explode(chunks(F.col(text_col))))
    return parts.select(*docs.columns, "__c.chunk_no", F.col("__c.text").alias("chunk"), "__c.start_char", "__c.end_char", "__c.is_paragraph_boundary", "__c.is_sentence_boundary")
