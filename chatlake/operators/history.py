"""History queries over chat_history: filters, last-N, transcripts, grouped
user documents, activity counts and the high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators.ids import group_positions
from chatlake.operators.keyed_files import read_by_key, scan_by_key, write_by_key


def user_history(history: DataFrame, sender: str, channel: str | None = None) -> DataFrame:
    """Messages of one sender, optionally in one channel (PF-1, PF-7, PF-8).

    An empty or None channel means all channels, decided at plan build time so
    both predicates reach the parquet scan. The vector column is never read.
    """
    out = history.where(F.col("sender") == F.lit(sender))
    if channel:
        out = out.where(F.col("channel") == F.lit(channel))
    return out.select("id", "ts", "sender", "channel", "message")


def _check_last_n_args(channel, n):
    if not isinstance(channel, str):
        raise ValueError(f"channel_name must be a string, not {type(channel)}")
    if not isinstance(n, int) or isinstance(n, bool):
        raise ValueError(f"n must be an integer, not {type(n)}")
    if n < 0:
        raise ValueError("n must not be negative")


def recent_chats_desc(history: DataFrame, channel: str, n: int) -> DataFrame:
    """Last n messages of a channel, newest first (O-1): scan with the channel
    predicate pushed down, then a bounded top-n (TakeOrderedAndProject)."""
    _check_last_n_args(channel, n)
    return (history.where(F.col("channel") == F.lit(channel))
            .select("id", "sender", "message")
            .orderBy(F.desc("id")).limit(n))


def recent_chats(history: DataFrame, channel: str, n: int) -> DataFrame:
    """The same n messages as one chronological transcript 'sender: message'
    joined by newlines (O-2, A-3, STR-2). The group is bounded by n."""
    last = recent_chats_desc(history, channel, n)
    return last.agg(
        F.lit(channel).alias("channel"),
        F.count(F.lit(1)).alias("n_lines"),
        F.coalesce(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("id", tx.line("sender", "message").alias("l")))),
            lambda s: s["l"]), "\n"), F.lit("")).alias("transcript"),
    )


def last_n_per_channel(history: DataFrame, n: int, keep=()) -> DataFrame:
    """Last n of every channel (W-1). ``row_number() <= n`` becomes a partial
    WindowGroupLimit before the shuffle, so each map task forwards at most n
    rows per channel: a hot channel costs n * tasks rows, not its size."""
    w = Window.partitionBy("channel").orderBy(F.desc("id"))
    return (history.select("id", "sender", "channel", "message", *keep)
            .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n))


def channel_transcripts(history: DataFrame, n: int, newest_first: bool = False) -> DataFrame:
    """Transcript of the last n messages of every channel: chronological (the
    mention memory), or newest first (the summarize command's text, which the
    reference builds from the descending query without reversing it)."""
    last = last_n_per_channel(history, n)
    return last.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("id", tx.line("sender", "message").alias("l"))),
                         asc=not newest_first),
            lambda s: s["l"]), "\n").alias("transcript"),
    )


def user_history_lines(history: DataFrame, senders: DataFrame | None = None,
                       style: str = "file") -> DataFrame:
    """Every user's history document as ordered lines (A-2, STR-3, SNK-6).

    Per sender, one section per channel in order of the channel's first
    message. ``style="file"``: a '--- channel ---' header, the 'sender:
    message' lines in id order, then one empty line. ``style="primer"`` (the
    text a profile is built from): a '=== channel ===' header and the bare
    messages. Rows are (sender, section_no, channel, seq, line) with seq = -1
    for the header, the message id for messages and 2^62 for the closing
    empty line. No group is collected: the section order comes from a
    (sender, channel) aggregate, and the file sink writes range-partitioned
    sorted rows.
    """
    if style not in ("file", "primer"):
        raise ValueError(f"unknown style {style!r}")
    h = history.select("id", "sender", "channel", "message")
    if senders is not None:
        h = h.join(senders, "sender", "left_semi")
    first = h.groupBy("sender", "channel").agg(F.min("id").alias("first_id"))
    sections = first.withColumn(
        "section_no", F.row_number().over(Window.partitionBy("sender").orderBy("first_id")))
    text = tx.line("sender", "message") if style == "file" else F.col("message")
    msgs = h.join(sections.select("sender", "channel", "section_no"), ["sender", "channel"])\
        .select("sender", "section_no", "channel", F.col("id").alias("seq"), text.alias("line"))
    # header (and closing empty line) of each section in one pass
    mark = "---" if style == "file" else "==="
    parts = [F.struct(F.lit(-1).cast("long").alias("seq"),
                      F.concat(F.lit(mark + " "), F.col("channel"), F.lit(" " + mark)).alias("line"))]
    if style == "file":
        parts.append(F.struct(F.lit(1 << 62).cast("long").alias("seq"), F.lit("").alias("line")))
    frame = sections.select("sender", "section_no", "channel", F.explode(F.array(*parts)).alias("f"))
    return msgs.unionByName(frame.select("sender", "section_no", "channel", "f.seq", "f.line"))


def write_lines(lines: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Text files, one folder per ``key``, its ``line``s in ``order``.

    Range partitioning on (key, order) splits a key with many lines over many
    tasks; part files of a key are in order by name.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_by_key(lines.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order), path, key)


def read_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, line) of the files that ``write_lines`` wrote, keys as text."""
    return read_by_key(spark, path, key)


def read_ordered(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, line_no, line) of such files in the order they hold: by the number of
    the part file, the place of the read block in it and the row in the block."""
    rows = scan_by_key(spark, path, key).select(
        key, F.col("value").alias("line"), F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("part"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return group_positions(rows, key, ["part", "block", "row"], "line_no").select(key, "line_no", "line")


def write_user_history(lines: DataFrame, path: str) -> None:
    """History documents as text files, one folder per sender (SNK-6)."""
    write_lines(lines, path, "sender", ["section_no", "seq"])


def activity_counts(history: DataFrame) -> DataFrame:
    """Messages per sender per channel (A-4); partial aggregation map side."""
    return history.groupBy("sender", "channel").agg(F.count(F.lit(1)).alias("n_messages"))


def activity_rollup(history: DataFrame) -> DataFrame:
    """Per day, channel and sender with subtotals (A-4 rollup)."""
    return (history.withColumn("day", F.to_date("ts"))
            .rollup("day", "channel", "sender")
            .agg(F.count(F.lit(1)).alias("n_messages"),
                 F.grouping_id().alias("level")))


def high_water_mark(history: DataFrame) -> DataFrame:
    """MAX(ts) of the store (A-1); NULL on an empty table."""
    return history.agg(F.max("ts").alias("hwm"))
