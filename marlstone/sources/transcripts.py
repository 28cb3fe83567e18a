"""Transcripts: which subtitle track to read, and the text of WebVTT files."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_TRACKS = 4
# Blocks that hold no spoken text.
SILENT_BLOCKS = ("NOTE", "STYLE", "REGION")


def ranked_tracks(tracks: DataFrame, language: str, most: int = MOST_TRACKS) -> DataFrame:
    """The tracks worth trying with their rank from 1.

    tracks: video, position, key, language, automatic, original. Manual ones go before the
    video's own captions, the wanted language before English before others; translations by
    machine come last and only into the wanted language. One row for each key and kind.
    """
    wanted = language.lower().split("-")[0]
    other = ~F.col("language").isin(wanted, "en")
    manual, own = ~F.col("automatic"), F.col("automatic") & F.col("original")
    tier = F.lit(None).cast("int")
    for number, test in reversed(list(enumerate((manual & (F.col("language") == wanted), own & (F.col("language") == wanted), manual & (F.col("language") == "en"), own & (F.col("language") == "en"), manual & other, own & other, F.col("automatic") & ~F.col("original") & (F.col("language") == wanted)), 1))):
        tier = F.when(test, number).otherwise(tier)
    marked = F.when(manual, 0).when(F.lower("key").endswith("-orig"), 0).when(F.col("original"), 1).otherwise(2)
    placed = tracks.withColumn("tier", tier).withColumn("_marked", marked).where("tier IS NOT NULL")
    order = [F.col("tier"), F.col("_marked"), F.col("position")]
    once = placed.withColumn("_copy", F.row_number().over(Window.partitionBy("video", "key", "automatic").orderBy(*order))).where("_copy = 1")
    rank = F.row_number().over(Window.partitionBy("video").orderBy(*order))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).drop("_marked", "_copy")


_CUE = re.compile(r"^[^\n]*-->[^\n]*\n(.*?)(?:\n[ \t]*\n|\Z)", re.MULTILINE | re.DOTALL)


def spoken(vtt: str) -> str:
    """The spoken text of one file: no tags, times or repeats of the line before."""
    plain = re.sub(r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n", vtt.removeprefix("\ufeff"))
    # Blocks that begin with a silent word hold no cue; a longer word, as of a cue's name, is none.
    silent = re.compile(rf"(?:^|\n[ \t]*\n)(?:{'|'.join(SILENT_BLOCKS)})(?=\s)(?:[^\n]|\n(?![ \t]*\n))*")
    cues = _CUE.findall(silent.sub("\n\n", plain))
    lines = pd.Series([" ".join(html.unescape(re.sub(r"<[^>]*>", "", line)).split()) for cue in cues for line in cue.split("\n")], dtype=object)
    lines = lines[lines != ""]
    return " ".join(lines[lines != lines.shift()])


@F.pandas_udf(T.StringType())
def vtt_text(files: pd.Series) -> pd.Series:
    return files.map(spoken, na_action="ignore")
