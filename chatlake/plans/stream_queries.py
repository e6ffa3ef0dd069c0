"""Registered routing and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.operators import routing as rt
from chatlake.operators import store
from chatlake.plans.registry import query
from chatlake.session import run_dir
from chatlake.sources import views
from chatlake.sources.tables import read_table
from chatlake.sources.views import (ANSWER_WITHIN, BOT_ID, BOT_NAME, MEMBER_ROLE, SPECIAL_NAME, STORED_BEFORE,
                                    STREAM_FROM, events_to_messages, mentioning_messages, with_views)
from chatlake.streaming import jobs

_LIVE_SQL = f"""CASE WHEN author_id = '{BOT_ID}' THEN 'self'
      WHEN starts_with(content, '!') THEN 'command'
      WHEN lower(author_name) = '{SPECIAL_NAME.lower()}' THEN 'canned'
      WHEN channel_kind = 'text' THEN CASE WHEN list_contains(author_roles, '{MEMBER_ROLE}')
            THEN CASE WHEN n_attachments > 0 THEN 'attachment' ELSE 'log' END ELSE 'drop' END
      WHEN channel_kind = 'dm' THEN 'log' ELSE 'drop' END"""
_BACKFILL_SQL = f"""CASE WHEN channel_kind = 'text' AND list_contains(author_roles, '{MEMBER_ROLE}')
      THEN 'log' ELSE 'drop' END"""
_CHANNEL_SQL = "CASE WHEN channel_kind = 'dm' THEN 'DM' ELSE channel_name END"


def _routed_sql(mode_sql: str) -> str:
    return f"""SELECT *, route IN ('self', 'log') AS logged, {_CHANNEL_SQL} AS stored_channel
        FROM (SELECT *, {mode_sql} AS route FROM message_events)"""


def _route(spark, sf, mode):
    return rt.route(views.message_events(spark, sf), BOT_ID, MEMBER_ROLE, SPECIAL_NAME, mode)


@query("route_messages", with_views(f"""
    SELECT message_id, route, logged, stored_channel AS channel_name FROM ({_routed_sql(_LIVE_SQL)})""",
    "message_events"))
def route_messages(spark, sf):
    """Live routing of every message (ST-1)."""
    return _route(spark, sf, "live").select("message_id", "route", "logged", "channel_name")


@query("route_messages_backfill", with_views(f"""
    SELECT message_id, route, logged, stored_channel AS channel_name FROM ({_routed_sql(_BACKFILL_SQL)})""",
    "message_events"))
def route_messages_backfill(spark, sf):
    """Catch-up routing: role test only, text channels only (ST-5)."""
    return _route(spark, sf, "backfill").select("message_id", "route", "logged", "channel_name")


_STORE_SQL = f"""store AS (SELECT message_id, event_ts AS ts FROM ({_routed_sql(_LIVE_SQL)})
        WHERE logged AND event_ts < TIMESTAMP '{STORED_BEFORE}'),
    bf AS (SELECT message_id, event_ts, author_name AS sender, stored_channel AS channel_name, content
           FROM ({_routed_sql(_BACKFILL_SQL)})
           WHERE logged AND event_ts > (SELECT max(ts) FROM store))"""


def _store_and_backfill(spark, sf):
    live = rt.logged_messages(_route(spark, sf, "live"))
    store = live.where(F.col("ts") < F.lit(STORED_BEFORE).cast("timestamp"))
    bf = rt.logged_messages(_route(spark, sf, "backfill"))
    events = bf.withColumnRenamed("ts", "event_ts")
    return store, rt.after_mark(events, store, "event_ts", "ts")


@query("backfill_since_hwm", with_views(f"""WITH {_STORE_SQL}
    SELECT message_id, event_ts, sender, channel_name, content FROM bf""", "message_events"))
def backfill_since_hwm(spark, sf):
    """Messages after the stored mark, taken through the backfill path (SRC-7, ST-4)."""
    _, fresh = _store_and_backfill(spark, sf)
    return fresh.select("message_id", "event_ts", "sender", F.col("channel").alias("channel_name"),
                        F.col("message").alias("content"))


@query("live_plus_backfill", with_views(f"""WITH {_STORE_SQL}
    SELECT message_id, 'live' AS path FROM store
    UNION ALL SELECT message_id, 'backfill' FROM bf WHERE message_id NOT IN (SELECT message_id FROM store)""",
    "message_events"))
def live_plus_backfill(spark, sf):
    """The stored table after the catch-up: live rows plus backfilled rows,
    one row per message id (SET-3)."""
    store, fresh = _store_and_backfill(spark, sf)
    return (store.select("message_id", F.lit("live").alias("path"))
            .unionByName(fresh.select("message_id", F.lit("backfill").alias("path"))))


@query("mention_requests", with_views(f"""
    WITH r AS ({_routed_sql(_LIVE_SQL)}),
    l AS (SELECT message_id, stored_channel AS channel, author_name AS sender, content, mentions_bot, route,
                 row_number() OVER (PARTITION BY stored_channel ORDER BY message_id) AS pos FROM r WHERE logged)
    SELECT m.message_id AS request_id, m.channel, count(*) AS n_lines,
           string_agg(x.sender || ': ' || x.content, chr(10) ORDER BY x.pos) AS transcript
    FROM l m JOIN l x ON x.channel = m.channel AND x.pos BETWEEN m.pos - 39 AND m.pos
    WHERE m.mentions_bot AND m.route = 'log' GROUP BY m.message_id, m.channel""", "message_events"))
def mention_requests(spark, sf):
    """Requests raised by mentions of the bot, each with the channel's last
    40 logged messages (ST-2, CMD-9)."""
    logged = rt.logged_messages(_route(spark, sf, "live"))
    return rt.mention_requests(logged, BOT_ID)


def _events_glob(sf: str) -> str:
    # a glob path: a file stream source needs a directory or a pattern
    return f"{sf.rstrip('/')}/events*.parquet"


def _events_schema(spark, sf):
    return read_table(spark, sf, "events").schema


_INGESTED_SQL = with_views(f"""
    WITH r AS ({_routed_sql(_LIVE_SQL)}),
    src AS (SELECT message_id AS source_id, event_ts AS ts, author_name AS sender, stored_channel AS channel,
                   array_to_string(regexp_extract_all(lower(CASE WHEN mentions_bot THEN '@{BOT_NAME} ' ELSE '' END || content),
                                   '@?[\\p{{L}}\\p{{N}}]+(?:[._''-][\\p{{L}}\\p{{N}}]+)*'), ' ') AS message
            FROM r WHERE logged)
    SELECT row_number() OVER (ORDER BY ts, source_id) - 1 AS id, source_id, ts, sender, channel, message
    FROM src""", "message_events")


@query("stream_ingest", _INGESTED_SQL)
def stream_ingest(spark, sf):
    """The live path as a stream: route, put names for mentions, normalise, embed,
    number, append (ST-1, SNK-1, STR-13)."""
    base = run_dir(spark, "stream_ingest")
    s = jobs.read_stream(spark, _events_glob(sf), _events_schema(spark, sf), files_per_trigger=1)
    jobs.ingest_stream(s, mentioning_messages, f"{base}/chat_history", f"{base}/_checkpoint",
                       BOT_ID, MEMBER_ROLE, SPECIAL_NAME)
    return spark.read.parquet(f"{base}/chat_history").select(
        "id", "source_id", "ts", "sender", "channel", "message")


@query("stream_redelivered", _INGESTED_SQL)
def stream_redelivered(spark, sf):
    """Three arrivals of events, each with every third message of all those before
    delivered once more and some twice in one arrival: the store has each once, as
    from the plain stream (ST-3, SET-3)."""
    base = run_dir(spark, "stream_redelivered")
    before = None
    for part in _slices(spark, sf):
        again = part.where(F.col("event_id") % 5 == 0)
        if before is not None:
            again = again.unionByName(before.where(F.col("event_id") % 3 == 0))
        part.unionByName(again).write.mode("append").parquet(f"{base}/arrived")
        before = part if before is None else before.unionByName(part)
        s = jobs.read_stream(spark, f"{base}/arrived", _events_schema(spark, sf))
        jobs.ingest_stream(s, mentioning_messages, f"{base}/chat_history", f"{base}/_checkpoint",
                           BOT_ID, MEMBER_ROLE, SPECIAL_NAME)
    return spark.read.parquet(f"{base}/chat_history").select("id", "source_id", "ts", "sender", "channel", "message")


@query("stream_first_seen", with_views(f"""
    SELECT row_number() OVER (ORDER BY min(event_ts), author_id) - 1 AS id, author_id AS user_id,
           arg_min(author_name, struct_pack(a := event_ts, b := message_id)) AS user_name,
           min(event_ts) AS first_ts
    FROM ({_routed_sql(_LIVE_SQL)}) WHERE logged GROUP BY author_id""", "message_events"))
def stream_first_seen(spark, sf):
    """Users registered on first sight from the stream, on the logging
    paths only (ST-3, SNK-3)."""
    base = run_dir(spark, "stream_users")
    s = jobs.read_stream(spark, _events_glob(sf), _events_schema(spark, sf), files_per_trigger=1)
    jobs.first_seen_stream(s, events_to_messages, f"{base}/user_info", f"{base}/_checkpoint",
                           (BOT_ID, MEMBER_ROLE, SPECIAL_NAME))
    return spark.read.parquet(f"{base}/user_info").select("id", "user_id", "user_name", "first_ts")


def _slices(spark, sf, n: int = 3):
    """The events in ``n`` parts of about equal size, one after the other in time."""
    e = read_table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = e.select(at.cast("double").alias("t")).approxQuantile("t", [i / n for i in range(1, n)], 0.01)
    edges = [float("-inf"), *cuts, float("inf")]
    return [e.where((at > edges[i]) & (at <= edges[i + 1])) for i in range(n)]


_ORDERED_SQL = f"""r AS ({_routed_sql(_LIVE_SQL)}),
    l AS (SELECT message_id, event_ts, stored_channel AS channel, author_name AS sender, content, mentions_bot, route,
                 row_number() OVER (ORDER BY event_ts, message_id) - 1 AS id,
                 row_number() OVER (PARTITION BY stored_channel ORDER BY event_ts, message_id) AS pos
          FROM r WHERE logged)"""
_STORED_TEXT_SQL = ("array_to_string(regexp_extract_all(lower({x}), "
                    "'@?[\\p{{L}}\\p{{N}}]+(?:[._''-][\\p{{L}}\\p{{N}}]+)*'), ' ')")


@query("stream_mentions", with_views(f"""WITH {_ORDERED_SQL},
    t AS (SELECT m.message_id AS request_id, m.channel,
                 string_agg(x.sender || ': ' || {_STORED_TEXT_SQL.format(x="x.content")}, chr(10) ORDER BY x.pos) AS transcript
          FROM l m JOIN l x ON x.channel = m.channel AND x.pos BETWEEN m.pos - 39 AND m.pos
          WHERE m.mentions_bot AND m.route = 'log' GROUP BY ALL),
    tl AS (SELECT request_id, channel, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line
           FROM (SELECT request_id, channel, string_split(trim(transcript), chr(10)) AS ls FROM t)),
    p AS (SELECT request_id, channel, line_no, trim(substr(line, 1, instr(line, ':') - 1)) AS who,
                 trim(substr(line, instr(line, ':') + 1)) AS what FROM tl WHERE instr(line, ':') > 0)
    SELECT request_id, channel, line_no, CASE WHEN who = '{BOT_NAME}' THEN 'ai' ELSE 'human' END AS role,
           CASE WHEN who = '{BOT_NAME}' THEN what ELSE who || ': ' || what END AS content FROM p""", "message_events"))
def stream_mentions(spark, sf):
    """The message handler as one stream over three arrivals of events: users,
    store, and the role-tagged last 40 lines of each mention (ST-2, ST-7, CMD-9)."""
    base = run_dir(spark, "stream_mentions")
    for part in _slices(spark, sf):
        part.write.mode("append").parquet(f"{base}/arrived")
        # the job is started anew for each arrival and goes on from its checkpoint
        s = jobs.read_stream(spark, f"{base}/arrived", _events_schema(spark, sf))
        jobs.mention_stream(s, events_to_messages, base, f"{base}/_checkpoint",
                            BOT_ID, MEMBER_ROLE, SPECIAL_NAME, BOT_NAME)
    out = store.existing(spark, f"{base}/requests")
    if out is None:     # nobody mentioned the bot
        return spark.createDataFrame([], "request_id long, channel string, line_no int, role string, content string")
    return out.select("request_id", "channel", "line_no", "role", "content")


@query("stream_last_n", with_views(f"""WITH {_ORDERED_SQL}
    SELECT m.message_id AS request_id, m.channel, row_number() OVER (PARTITION BY m.message_id ORDER BY x.pos) - 1 AS line_no,
           x.sender, {_STORED_TEXT_SQL.format(x="x.content")} AS message
    FROM l m JOIN l x ON x.channel = m.channel AND x.pos BETWEEN m.pos - 39 AND m.pos
    WHERE m.mentions_bot AND m.route = 'log'""", "message_events"))
def stream_last_n(spark, sf):
    """The last 40 lines up to each mention out of keyed state, over three arrivals
    with a restart between them (ST-7)."""
    base = run_dir(spark, "stream_last_n")
    for part in _slices(spark, sf):
        part.write.mode("append").parquet(f"{base}/arrived")
        s = jobs.read_stream(spark, f"{base}/arrived", _events_schema(spark, sf))
        jobs.last_n_stream(s, events_to_messages, f"{base}/lines", f"{base}/_checkpoint", BOT_ID, MEMBER_ROLE, SPECIAL_NAME)
    return spark.read.parquet(f"{base}/lines")


@query("stream_interactions", with_views(f"""WITH r AS ({_routed_sql(_LIVE_SQL)}),
    asks AS (SELECT * FROM r WHERE route = 'log' AND mentions_bot), own AS (SELECT * FROM r WHERE route = 'self')
    SELECT a.message_id AS request_id, a.stored_channel AS channel, a.event_ts AS request_ts,
           o.message_id AS answer_id, o.event_ts AS answer_ts
    FROM asks a LEFT JOIN own o ON o.stored_channel = a.stored_channel AND o.event_ts > a.event_ts
      AND o.event_ts <= a.event_ts + INTERVAL {ANSWER_WITHIN}""", "message_events"))
def stream_interactions(spark, sf):
    """Requests with the bot's answers in their channel within a day, unanswered
    ones too, over three arrivals and a heartbeat that closes the last day (SNK-9, CMD-9)."""
    base = run_dir(spark, "stream_interactions")
    events = read_table(spark, sf, "events")
    beat = events.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")).select(
        *[F.col("ts") if f.name == "ts" else F.lit(-1).cast(f.dataType).alias(f.name) if f.name == "event_id"
          else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    for part in [*_slices(spark, sf), beat]:
        part.write.mode("append").parquet(f"{base}/arrived")
        s = jobs.read_stream(spark, f"{base}/arrived", events.schema)
        jobs.interaction_stream(s, events_to_messages, f"{base}/pairs", f"{base}/_checkpoint",
                                BOT_ID, MEMBER_ROLE, SPECIAL_NAME, within=ANSWER_WITHIN)
    return spark.read.parquet(f"{base}/pairs")


@query("catch_up", with_views(f"""WITH live AS (SELECT * FROM ({_routed_sql(_LIVE_SQL)}) WHERE logged),
    s AS (SELECT *, 0 AS step FROM live WHERE event_ts < TIMESTAMP '{STORED_BEFORE}'),
    b AS (SELECT *, 1 AS step FROM ({_routed_sql(_BACKFILL_SQL)}) WHERE logged
          AND event_ts > (SELECT date_trunc('milliseconds', max(event_ts)) FROM s) AND message_id NOT IN (SELECT message_id FROM s)),
    n AS (SELECT *, 2 AS step FROM live WHERE event_ts >= TIMESTAMP '{STREAM_FROM}'
          AND message_id NOT IN (SELECT message_id FROM s UNION ALL SELECT message_id FROM b))
    SELECT row_number() OVER (ORDER BY step, event_ts, message_id) - 1 AS id, message_id AS source_id, event_ts AS ts,
           author_name AS sender, stored_channel AS channel, {_STORED_TEXT_SQL.format(x="content")} AS message
    FROM (SELECT * FROM s UNION ALL SELECT * FROM b UNION ALL SELECT * FROM n)""", "message_events"))
def catch_up(spark, sf):
    """A store as of a stop, what its text channels got meanwhile written after the
    mark, a live stream that delivers the end of it again, and one more catch-up
    that finds nothing left: each message once (SRC-7, ST-4, ST-5, SET-3)."""
    base = run_dir(spark, "catch_up")
    table = f"{base}/chat_history"

    def rows(df):
        return rt.logged_messages(df).drop("mentions").withColumnRenamed("message_id", "source_id")

    store.add(rows(_route(spark, sf, "live")).where(F.col("ts") < F.lit(STORED_BEFORE).cast("timestamp")), table, "live")
    missed = rows(_route(spark, sf, "backfill"))
    names = [r[0] for r in views.message_events(spark, sf).where("channel.kind = 'text'").select("channel.name").distinct().collect()]
    load = lambda channels: missed.where(F.col("channel").isin(channels))
    store.catch_up(spark, names, load, table, "missed-0")
    read_table(spark, sf, "events").where(F.col("ts") >= F.lit(STREAM_FROM).cast("timestamp_ntz")).write.parquet(f"{base}/arrived")
    s = jobs.read_stream(spark, f"{base}/arrived", _events_schema(spark, sf))
    jobs.ingest_stream(s, events_to_messages, table, f"{base}/_checkpoint", BOT_ID, MEMBER_ROLE, SPECIAL_NAME)
    store.catch_up(spark, names, load, table, "missed-1")
    return spark.read.parquet(table).select("id", "source_id", "ts", "sender", "channel", "message")


@query("store_mixed", with_views(f"""WITH {_ORDERED_SQL}
    SELECT id, message_id AS source_id, event_ts AS ts, sender, channel,
           {_STORED_TEXT_SQL.format(x="content")} AS message, true AS arrived FROM l""", "message_events"))
def store_mixed(spark, sf):
    """One store written by a batch job (the older half of the events) and then by
    the stream (the rest): one layout, ids dense across both (SRC-1, SNK-1, ST-6)."""
    base = run_dir(spark, "store_mixed")
    table = f"{base}/chat_history"
    old, new = _slices(spark, sf, 2)
    routed = rt.route(events_to_messages(old), BOT_ID, MEMBER_ROLE, SPECIAL_NAME, "live")
    store.add(rt.logged_messages(routed).drop("mentions").withColumnRenamed("message_id", "source_id"), table, "import")
    new.write.parquet(f"{base}/arrived")
    s = jobs.read_stream(spark, f"{base}/arrived", _events_schema(spark, sf))
    jobs.ingest_stream(s, events_to_messages, table, f"{base}/_checkpoint", BOT_ID, MEMBER_ROLE, SPECIAL_NAME)
    return spark.read.parquet(table).select("id", "source_id", "ts", "sender", "channel", "message",
                                            (F.col("ingest_ts") > F.col("ts")).alias("arrived"))


@query("stream_activity", """
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, channel, count(*) AS n_messages
    FROM (SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS window_start, event_type AS channel FROM events)
    GROUP BY window_start, channel
    HAVING window_start + INTERVAL 1 DAY <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 1 HOUR""")
def stream_activity(spark, sf):
    """Daily per-channel counts from the stream with a 1-hour watermark (ST-8)."""
    base = run_dir(spark, "stream_activity")
    s = jobs.read_stream(spark, _events_glob(sf), _events_schema(spark, sf), files_per_trigger=1)
    jobs.activity_stream(s, "ts", "event_type", f"{base}/out", f"{base}/_checkpoint")
    return spark.read.parquet(f"{base}/out")
