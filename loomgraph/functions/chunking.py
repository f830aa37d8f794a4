"""Sentence-aware chunking, a recurrence over positions (Arrow UDF)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence ends, in the order in which they are looked for.
SENTENCE_ENDS = (". ", "! ", "? ", "\n")


def sentence_spans(text: str, size: int = 512, overlap: int = 50) -> list[tuple[int, int]]:
    """(start, end) of windows of ``size`` characters cut after a sentence end.

    The last occurrence of the first kind of end that occurs in the window
    decides.  The next window starts ``overlap`` before the cut.  A cut that
    would not move the start forward is ignored (the window is then cut at
    its full size), so the walk ends and skips no character.
    """
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for mark in SENTENCE_ENDS:
                at = text.rfind(mark, start, end)
                if at >= 0:
                    if at + len(mark) - overlap > start:
                        end = at + len(mark)
                    break
        out.append((start, min(end, len(text))))
        start = end - overlap
    return out


def sentence_chunks(text: str, size: int = 512, overlap: int = 50) -> list[str]:
    """Stripped texts of the windows that are not blank; a short text is one chunk as it is."""
    if len(text) <= size:
        return [text]
    pieces = (text[a:b].strip() for a, b in sentence_spans(text, size, overlap))
    return [p for p in pieces if p]


def sentence_chunks_column(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Array of chunks; null for null."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under size")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sentence_chunks(t, size, overlap))

    return cut(text)
