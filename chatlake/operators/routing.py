"""Message routing and the live/backfill paths (ST-1, ST-2, ST-4, ST-5, SET-3).

Routing is one stateless CASE chain, the same expression for a batch table
and for a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators.ids import group_positions
from chatlake.session import checkpoint_root

LAST_N = 40   # transcript length on a mention


def route(events: DataFrame, bot_id: str, role: str, special_name: str,
          mode: str = "live") -> DataFrame:
    """Add ``route``, ``logged`` and ``channel_name`` to MESSAGE_EVENT rows.

    live (first match wins): the bot itself -> self (logged); '!' prefix ->
    command; the special name (case-insensitive) -> canned reply, not logged;
    text channel and the role -> attachment (saved, not logged) or log;
    direct message -> log; else drop.
    backfill: text channel and the role -> log; else drop.
    A role listed twice still logs once (D9). Direct messages are stored under
    channel 'DM' (STR-12, D10).
    """
    has_role = F.array_contains("author.roles", role)
    is_text = F.col("channel.kind") == "text"
    is_dm = F.col("channel.kind") == "dm"
    if mode == "live":
        r = (F.when(F.col("author.id") == bot_id, "self")
             .when(F.startswith("content", F.lit("!")), "command")
             .when(F.lower("author.name") == special_name.lower(), "canned")
             .when(is_text, F.when(has_role, F.when(F.size("attachments") > 0, "attachment")
                                   .otherwise("log")).otherwise("drop"))
             .when(is_dm, "log")
             .otherwise("drop"))
    elif mode == "backfill":
        r = F.when(is_text & has_role, "log").otherwise("drop")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return (events.withColumn("route", r)
            .withColumn("logged", F.col("route").isin("self", "log"))
            .withColumn("channel_name", F.when(is_dm, F.lit("DM")).otherwise(F.col("channel.name"))))


def logged_messages(routed: DataFrame) -> DataFrame:
    """Routed events that go to chat_history, as history rows: the text with the
    names of those it mentions (STR-13). The bot's own messages are logged and
    nothing more, so they keep no mentions that could ask for an answer."""
    none = F.lit(None).cast(routed.schema["mentions"].dataType)
    return routed.where("logged").select(
        F.col("message_id"), F.col("event_ts").alias("ts"), F.col("author.name").alias("sender"),
        F.col("channel_name").alias("channel"), tx.clean_content("content", "mentions").alias("message"),
        F.when(F.col("route") == "self", F.filter(F.coalesce("mentions", none), lambda m: F.lit(False)))
        .otherwise(F.col("mentions")).alias("mentions"))


def after_mark(events: DataFrame, store: DataFrame, ts_col: str = "event_ts",
               store_ts: str = "ts", key: str = "message_id") -> DataFrame:
    """Rows after the store's high-water mark (SRC-7, PF-23, DT-4).

    The mark is one value, fetched first (a footer read with parquet
    aggregate pushdown) so that ``ts > mark`` is a literal predicate the
    source scan can push down: only files and row groups after the mark are
    read. An empty store has no mark, and then nothing is read at all.

    The mark travels through a millisecond clock, so rows of that
    millisecond are read again and removed by message id; only stored rows
    at or after the truncated mark can be such repeats, so the anti join
    reads just those.
    """
    hwm = store.agg(F.max(store_ts).alias("m")).first()["m"]
    if hwm is None:
        return events.limit(0)
    mark = F.lit(hwm.replace(microsecond=hwm.microsecond // 1000 * 1000)).cast("timestamp")
    fresh = events.where(F.col(ts_col) > mark)
    recent = store.where(F.col(store_ts) >= mark).select(key)
    return fresh.join(recent, key, "left_anti")


def mention_requests(history: DataFrame, bot_id: str, n: int = LAST_N) -> DataFrame:
    """For each logged message that mentions the bot: the channel's last n
    logged messages up to and including it, as a transcript (ST-2, ST-7).

    Positions inside a channel are dense and skew-safe (group_positions);
    each mention expands to its n position keys and equi-joins on
    (channel, pos), so no channel is ever handled by a single task and
    each request group holds at most n rows. Both sides of that join read
    the positions, so they are checkpointed once to the shared checkpoint
    folder (reliable, survives executor loss) instead of computed twice.
    """
    checkpoint_root(history.sparkSession)
    pos = group_positions(history.select("message_id", "sender", "channel", "message", "mentions"),
                          "channel", "message_id", "pos").checkpoint(eager=True)
    asks = (pos.where(F.exists("mentions", lambda m: m["id"] == F.lit(bot_id)))
            .select(F.col("message_id").alias("request_id"), "channel",
                    F.explode(F.sequence(F.greatest(F.lit(1), F.col("pos") - (n - 1)), F.col("pos")))
                    .alias("pos")))
    ctx = asks.join(pos.select("channel", "pos", "message_id", "sender", "message"),
                    ["channel", "pos"])
    return ctx.groupBy("request_id", "channel").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("message_id", tx.line("sender", "message").alias("l")))),
            lambda s: s["l"]), "\n").alias("transcript"))
