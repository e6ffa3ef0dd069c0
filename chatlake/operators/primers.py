"""buildprimer as one chain (CMD-5): a user's history becomes files, dossier
requests, a primer, and the primer of their ``user_info`` row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators import digest, history, packing, prompts, registry
from chatlake.operators.chunks import PACK_LIMIT


def build_primers(chat: DataFrame, users: DataFrame, folder: str, max_tokens: int = PACK_LIMIT) -> DataFrame:
    """Run the chain for every sender of ``chat`` and return the new ``user_info``.

    Written below ``folder``: ``history`` and ``primers``, text files of each
    sender; ``requests``, the dossier prompts over their whole history, for a
    model to answer; ``user_info``, ``users`` with the extractive profile as the
    primer of every row whose name is a sender's (other rows stay as they are).
    """
    spark = chat.sparkSession
    history.write_user_history(history.user_history_lines(chat), f"{folder}/history")
    lines = history.user_history_lines(chat, style="primer").select(
        F.col("sender").alias("request_id"), "section_no", "seq", F.posexplode(F.split("line", "\n")).alias("sub", "text"))
    packed = packing.pack_line_rows(lines, "request_id", ["section_no", "seq", "sub"], "text", max_tokens)
    prompts.dossier_from_chunks(packed).write.parquet(f"{folder}/requests")
    digest.write_primers(digest.profile_text(digest.user_profiles(chat)), f"{folder}/primers")
    told = history.read_lines(spark, f"{folder}/primers", "sender").select(
        F.col("sender").alias("user_name"), F.col("line").alias("primer"))
    registry.update_by_name(users, told).write.parquet(f"{folder}/user_info")
    return spark.read.parquet(f"{folder}/user_info")
