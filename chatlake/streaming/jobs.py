"""Structured Streaming jobs over the message stream (ST-1..ST-9).

Each job reads a file stream, keeps its progress in a checkpoint under the
shared checkpoint folder and writes through ``foreachBatch`` sinks that are
idempotent per batch (a replayed batch inserts nothing twice), so an
executor or driver restart resumes without duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from chatlake.functions import text as tx
from chatlake.operators import history as hist
from chatlake.operators import registry as reg
from chatlake.operators import routing as rt
from chatlake.operators import store as st
from chatlake.operators import transcripts as trs
from chatlake.operators.ids import dense_ids
from chatlake.session import staged


def read_stream(spark: SparkSession, path_glob: str, schema: T.StructType,
                files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path_glob)


def _run(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _name(batch_id: int) -> str:
    return f"stream-{batch_id:012d}"


def _log_batch(events: DataFrame, batch_id: int, table: str, routing: tuple[str, str, str]) -> DataFrame | None:
    """Store the logged messages of a micro-batch and quarantine its unusable
    rows; the rows as stored, None if there are none."""
    ok = (F.col("message_id").isNotNull() & F.col("event_ts").isNotNull()
          & F.col("author.id").isNotNull() & F.col("content").isNotNull()
          & (F.col("channel.name").isNotNull() | F.coalesce(F.col("channel.kind") == "dm", F.lit(False))))
    # by batch, so that a batch that is run again replaces its rows
    (events.where(~ok).withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(f"{table}_quarantine"))
    routed = rt.route(events.where(ok), *routing, "live")
    rows = rt.logged_messages(routed).drop("mentions").withColumnRenamed("message_id", "source_id")
    return st.add(rows, table, _name(batch_id), unique=True)


def _register_batch(events: DataFrame, batch_id: int, table: str) -> None:
    """Add the authors first seen in a micro-batch to ``user_info``, numbered on
    after the stored users by (first sighting, user id)."""
    spark = events.sparkSession
    ev = events.select(F.col("author.id").alias("user_id"), F.col("author.name").alias("user_name"),
                       F.col("event_ts").alias("ts"), "message_id").where("user_id IS NOT NULL")
    store = st.existing(spark, table)
    # users of earlier batches: a batch that is run again replaces its own
    earlier = (store.where(F.col("batch_id") < batch_id) if store is not None
               else spark.createDataFrame([], "id long, user_id string"))
    # only stored users seen in this batch matter: a semi join with the
    # batch's ids filters the user table map side instead of shuffling all of it
    seen = earlier.join(ev.select("user_id").distinct(), "user_id", "left_semi")
    new = reg.insert_if_absent(seen, ev.withColumn("first_ts", F.col("ts")), "user_id",
                               ["user_name", "first_ts"], ["ts", "message_id"])
    last = earlier.agg(F.max("id")).first()[0]
    none = F.lit(None).cast("string")
    with staged(new, "new-users") as new:      # numbering passes over them several times
        (dense_ids(new, ["first_ts", "user_id"], "id", start=0 if last is None else last + 1)
         .select("id", "user_id", "user_name", none.alias("real_name"), none.alias("primer"),
                 none.alias("history_summary"), "first_ts", F.lit(batch_id).alias("batch_id"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(table))


def ingest_stream(stream: DataFrame, to_events, table: str, checkpoint: str,
                  bot_id: str, role: str, special_name: str):
    """Live routing + ingest (ST-1, ST-6, SNK-1): route each micro-batch, keep
    the logged rows, and store them under the batch's name in the layout that
    batch jobs write too (``operators.store``), numbered after the ids already
    issued by either.

    Exactly once without scanning the store: a batch that is run again replaces
    its own partitions, one that is in the store's record is not written again, and
    a message that is delivered again, however late, is known by its id.

    Rows missing an id, a time, an author, a text or a channel go to a quarantine table
    next to the store and the rest of the batch goes on (ST-9).
    """
    def sink(batch: DataFrame, batch_id: int):
        _log_batch(to_events(batch), batch_id, table, (bot_id, role, special_name))

    return _run(stream.writeStream.foreachBatch(sink), checkpoint)


def first_seen_stream(stream: DataFrame, to_events, table: str, checkpoint: str,
                      routing: tuple[str, str, str] | None = None):
    """Users registered on first sight (ST-3, SNK-3): per micro-batch the
    earliest sighting of each author, minus authors already stored, as full
    ``user_info`` rows with ids.

    With ``routing`` = (bot_id, role, special_name) only the authors of
    messages the live path logs are registered, as the reference registers a
    user on those paths only.
    """
    def sink(batch: DataFrame, batch_id: int):
        events = to_events(batch)
        if routing is not None:
            events = rt.route(events, *routing, "live").where("logged")
        _register_batch(events, batch_id, table)

    return _run(stream.writeStream.foreachBatch(sink), checkpoint)


def mention_stream(stream: DataFrame, to_events, base: str, checkpoint: str,
                   bot_id: str, role: str, special_name: str, bot_name: str, n: int = rt.LAST_N):
    """The whole message handler as one job (ST-2, ST-3, ST-7, CMD-9): each
    micro-batch registers its users (``base``/user_info), stores its messages
    (``base``/chat_history) and, for every stored message that mentions the bot,
    writes the channel's last ``n`` messages up to it as role-tagged rows
    (request_id, channel, line_no, role, content) to ``base``/requests.

    The last ``n`` rows of every channel are kept beside the store, so a batch
    reads those and its own rows, never the history. The buffer has two slots
    used in turn: a batch reads the slot of the one before and replaces its own,
    so running it again gives the same.
    """
    routing = (bot_id, role, special_name)
    spark = stream.sparkSession
    shape = ["message_id", "source_id", "sender", "channel", "message"]

    def sink(batch: DataFrame, batch_id: int):
        batch.persist()
        try:
            events = to_events(batch)
            logged = rt.route(events, *routing, "live").where("logged")
            _register_batch(logged, batch_id, f"{base}/user_info")
            stored = _log_batch(events, batch_id, f"{base}/chat_history", routing)
            before = st.existing(spark, f"{base}/last/slot={(batch_id - 1) % 2}") if batch_id else None
            if stored is None:
                stored = spark.createDataFrame([], "id long, source_id long, sender string, channel string, message string")
            rows = stored.withColumnRenamed("id", "message_id").select(shape)
            rows = rows if before is None else rows.unionByName(before.select(shape))
            last = hist.last_n_per_channel(rows.withColumnRenamed("message_id", "id"), n, keep=["source_id"])
            last.withColumnRenamed("id", "message_id").select(shape)\
                .write.mode("overwrite").parquet(f"{base}/last/slot={batch_id % 2}")
            # only messages of others ask, and only when they are new
            asks = (logged.where((F.col("route") == "log") & F.exists("mentions", lambda m: m["id"] == F.lit(bot_id)))
                    .dropDuplicates(["message_id"])
                    .join(stored.select(F.col("source_id").alias("message_id")), "message_id", "left_semi"))
            told = rows.join(asks.select(F.col("message_id").alias("source_id"), "mentions"), "source_id", "left")
            with staged(told.withColumn("mentions", F.coalesce("mentions", F.array())), "told") as told:
                asked = rt.mention_requests(told, bot_id, n)
                asked = asked.join(rows.select(F.col("message_id").alias("request_id"), "source_id"), "request_id")\
                    .drop("request_id").withColumnRenamed("source_id", "request_id")
                (trs.parse_transcript(asked, bot_name, keys=("request_id", "channel"))
                 .withColumn("batch_id", F.lit(batch_id))
                 .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("batch_id").parquet(f"{base}/requests"))
        finally:
            batch.unpersist()

    return _run(stream.writeStream.foreachBatch(sink), checkpoint)


def _last_lines(n: int):
    """Keyed state: a channel's last ``n`` logged messages, and for each new one
    that asks, the lines up to it. A message that the buffer holds is not taken
    again; one older than all that a full buffer holds comes too late."""
    def run(key, frames, state):
        import bisect

        import pandas as pd

        held = list(zip(*state.get)) if state.exists else []
        known = {x[1] for x in held}
        new = sorted({(r.at, r.message_id): r for f in frames for r in f.itertuples(index=False)}.items())
        out = []
        for (at, message_id), r in new:
            row = (int(at), int(message_id), r.sender, r.message)
            if message_id in known or (len(held) == n and row < held[0]):
                continue
            place = bisect.bisect(held, row)
            held.insert(place, row)
            known.add(message_id)
            if r.asks:
                lines = held[max(0, place + 1 - n):place + 1]
                out += [(row[1], key[0], i, x[2], x[3]) for i, x in enumerate(lines)]
            for gone in held[:-n]:
                known.discard(gone[1])
            held = held[-n:]
        state.update(tuple(list(c) for c in zip(*held)) if held else ([], [], [], []))
        yield pd.DataFrame(out, columns=["request_id", "channel", "line_no", "sender", "message"])
    return run


def last_n_stream(stream: DataFrame, to_events, out: str, checkpoint: str,
                  bot_id: str, role: str, special_name: str, n: int = rt.LAST_N):
    """Per-channel buffers as keyed state (ST-7): for every logged message that
    mentions the bot, the channel's last ``n`` logged messages up to it, as rows
    (request_id, channel, line_no, sender, message) appended to ``out``.

    The state is ``n`` rows a channel, kept in the checkpoint, so a batch reads
    neither the store nor a buffer table and a restart goes on where it stopped. The rows
    of one channel in one micro-batch pass through one task, in order.
    """
    routed = rt.route(to_events(stream), bot_id, role, special_name, "live")
    rows = rt.logged_messages(routed).where("message_id IS NOT NULL AND ts IS NOT NULL AND channel IS NOT NULL").select(
        "channel", F.unix_micros("ts").alias("at"), "message_id", F.coalesce("sender", F.lit("")).alias("sender"),
        tx.normalize(F.coalesce("message", F.lit(""))).alias("message"),
        F.coalesce(F.exists("mentions", lambda m: m["id"] == F.lit(bot_id)), F.lit(False)).alias("asks"))
    lines = rows.groupBy("channel").applyInPandasWithState(
        _last_lines(n), "request_id long, channel string, line_no int, sender string, message string",
        "at array<long>, ids array<long>, senders array<string>, messages array<string>",
        "append", GroupStateTimeout.NoTimeout)
    return _run(lines.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)


def interaction_stream(stream: DataFrame, to_events, out: str, checkpoint: str, bot_id: str, role: str,
                       special_name: str, within: str = "10 minutes", delay: str = "1 hour"):
    """Requests joined to the bot's answers as streams (SNK-9, CMD-9): a logged
    message that mentions the bot, with each message of the bot in the same channel
    up to ``within`` later; a request without an answer comes out once the watermark
    says that none can come. Rows (request_id, channel, request_ts, answer_id,
    answer_ts).

    Both sides carry a watermark, so the state holds what lies within ``delay`` plus
    ``within`` of the newest event. Messages delivered twice within the watermark count
    once. Rows without an author (heartbeats) only move the clock.
    """
    def side(keep, **names):
        routed = rt.route(to_events(stream), bot_id, role, special_name, "live")
        return (routed.where(keep | F.col("author.id").isNull())
                .select(*[F.col(c).alias(n) for n, c in names.items()])
                .withWatermark(list(names)[1], delay).dropDuplicatesWithinWatermark([list(names)[0]]))

    asks = side((F.col("route") == "log") & F.exists("mentions", lambda m: m["id"] == F.lit(bot_id)),
                request_id="message_id", request_ts="event_ts", channel="channel_name")
    own = side(F.col("route") == "self", answer_id="message_id", answer_ts="event_ts", place="channel_name")
    pairs = asks.join(own, F.expr(f"channel = place AND answer_ts > request_ts AND answer_ts <= request_ts + INTERVAL {within}"), "leftOuter")
    return _run(pairs.where("channel IS NOT NULL").select("request_id", "channel", "request_ts", "answer_id", "answer_ts")
                .writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)


def activity_stream(stream: DataFrame, ts_col: str, channel_col: str, out: str,
                    checkpoint: str, delay: str = "1 hour", size: str = "1 day"):
    """Per-channel counts per day with a watermark (ST-8). Append mode emits
    a day once the watermark passes its end; the last open day is held."""
    counts = (stream.withColumn("ts", F.col(ts_col).cast("timestamp"))
              .withWatermark("ts", delay)
              .groupBy(F.window("ts", size), F.col(channel_col).alias("channel"))
              .agg(F.count(F.lit(1)).alias("n_messages"))
              .select(F.col("window.start").alias("window_start"),
                      F.col("window.end").alias("window_end"), "channel", "n_messages"))
    return _run(counts.writeStream.outputMode("append").format("parquet").option("path", out),
                checkpoint)
