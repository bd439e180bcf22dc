"""Recursive splitting of texts at paragraphs, sentences, lines, blanks and characters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the coarsest to the finest; a separator stays at the end of its piece.
SEPARATORS = (r"\n\n", r"(?<=[.!?])\s+", r"\n", r" ")


#: Characters of texts whose pieces are given out at once.
PIECES_CHARS = 1 << 20


def tokens(n_chars: int) -> int:
    return max(1, n_chars // 4) if n_chars else 0


def split_text(text: str, most: int, level: int = 0) -> list[str]:
    """Pieces of at most so many tokens whose concatenation is the text; a piece begins where the coarsest fitting separator ends."""
    if tokens(len(text)) <= most:
        return [text] if text else []
    if level == len(SEPARATORS):
        size = most * 4 + 3
        return [text[k : k + size] for k in range(0, len(text), size)]
    ends = [m.end() for m in re.finditer(SEPARATORS[level], text)]
    out, held, start = [], "", 0
    for end in ends + [len(text)]:
        piece, start = text[start:end], end
        if held and tokens(len(held) + len(piece)) > most:
            out.append(held)
            held = ""
        if tokens(len(held) + len(piece)) <= most:
            held += piece
        else:
            out += split_text(piece, most, level + 1)
    return out + [held] if held else out


def _pieces(most: int):
    columns = ["document_id", "level_index", "span_start", "span_end", "text"]

    def rows(batches):
        for b in batches:
            out, held = [], 0
            for doc, text in zip(b["document_id"], b["text"]):
                at = 0
                if held > PIECES_CHARS:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
                held += len(text or "")
                for k, piece in enumerate(split_text(text or "", most)):
                    if piece.strip():
                        out.append((doc, k, at, at + len(piece), piece))
                    at += len(piece)
            yield pd.DataFrame(out, columns=columns)

    return rows


def split_documents(docs: DataFrame, most: int = 100) -> DataFrame:
    """document_id, level_index, span_start, span_end, text: leaves of every document.

    Blank pieces go after the spans are known, so spans may have gaps; null and empty texts have no leaves.
    Documents are split one by one inside Arrow batches, without a shuffle.
    """

    x = docs.select(F.col("doc_id").cast("long").alias("document_id"), "text")
    return x.mapInPandas(_pieces(most), "document_id long, level_index int, span_start long, span_end long, text string")
