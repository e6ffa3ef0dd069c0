"""Transcript text -> lines -> role-tagged memory rows (CMD-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as tx


def transcript_lines(transcripts: DataFrame, text_col: str = "transcript",
                     keys=("channel",)) -> DataFrame:
    """strip(), split on newlines, one row per line with its number (SNK-8, STR-8)."""
    return transcripts.select(*keys, F.posexplode(tx.split_lines(tx.strip(text_col)))
                              .alias("line_no", "line"))


def parse_transcript(transcripts: DataFrame, bot_name: str, text_col: str = "transcript",
                     keys=("channel",)) -> DataFrame:
    """Split each line once on ':'; lines without one are dropped (PF-24).
    Both parts are stripped (STR-5). The bot's lines become 'ai' with the bare
    message, others 'human' with 'sender: message' (STR-11)."""
    lines = transcript_lines(transcripts, text_col, keys)
    parts = lines.select(*keys, "line_no", tx.split_once("line", ":").alias("p"))\
        .where(F.size("p") == 2)
    who = tx.strip(F.col("p")[0])
    what = tx.strip(F.col("p")[1])
    is_bot = who == F.lit(bot_name)
    return parts.select(
        *keys, "line_no",
        F.when(is_bot, F.lit("ai")).otherwise(F.lit("human")).alias("role"),
        F.when(is_bot, what).otherwise(F.concat(who, F.lit(": "), what)).alias("content"))
