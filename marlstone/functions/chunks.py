"""Long texts in chunks of a bounded number of estimated tokens, each as a row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import CHARS_PER_TOKEN
from marlstone.session import ship

# Where paragraphs, sentences and words end.
PARAGRAPH, SENTENCE, WORD = r"\n\s*\n", r"(?<=[.!?…。！？])\s+", r"\s+"
_LEVELS = tuple(map(re.compile, (SENTENCE, WORD)))


def _fitting(part: str, room: int, level: int = 0):
    """Pieces of at most `room` characters, with the gap after each: a space, or nothing inside a cut word."""
    if len(part) <= room:
        yield part, " "
    elif level < len(_LEVELS):
        for piece in filter(None, map(str.strip, _LEVELS[level].split(part))):
            yield from _fitting(piece, room, level + 1)
    else:
        for at in range(0, len(part), room):
            yield part[at : at + room], "" if at + room < len(part) else " "


def _tail(text: str, most: int) -> str:
    """What the next chunk repeats: the longest end of at most `most` characters that begins a word, else just those."""
    end = text[-most:]
    if len(end) == len(text) or text[-most - 1].isspace():
        inner = end.lstrip()
    else:
        inner = (re.split(WORD, end, maxsplit=1) + [""])[1]
    return inner or end


def split_text(text: str, max_tokens: int, overlap: int = 0) -> list[str]:
    """Chunks in order. Blank text has none; text within the limit is one, unchanged.

    New text of a chunk has at most max_tokens - overlap tokens, less the room of a separator
    where chunks overlap; a blank line follows each paragraph.
    """
    if overlap < 0 or max_tokens <= overlap:
        raise ValueError("the overlap must be 0 or more and leave room for new text in a chunk")
    if not text.strip():
        return []
    if len(text) <= CHARS_PER_TOKEN * max_tokens:
        return [text]
    room = CHARS_PER_TOKEN * (max_tokens - overlap) - 2 * (overlap > 0)
    chunks: list[str] = []
    lead, body, gap = "", "", ""
    for paragraph in filter(None, map(str.strip, re.split(PARAGRAPH, text))):
        for piece, after in _fitting(paragraph, room):
            joined = body + gap + piece
            if body and len(joined) > room:
                chunks.append(lead + body)
                lead = _tail(chunks[-1], CHARS_PER_TOKEN * overlap) + gap if overlap else ""
                joined = piece
            body, gap = joined, after
        gap = "\n\n"
    return [*chunks, lead + body]


def chunks(rows: DataFrame, key: str, text: str, max_tokens: int, overlap: int = 0) -> DataFrame:
    """key, chunk_no from 0, chunk. Null and blank texts have no rows."""
    ship(rows.sparkSession)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, max_tokens, overlap), na_action="ignore")

    return rows.select(key, F.posexplode(cut(text)).alias("chunk_no", "chunk"))
