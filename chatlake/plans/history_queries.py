"""Registered history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlake.operators import history as hist
from chatlake.plans.registry import query
from chatlake.sources import views
from chatlake.sources.tables import read_table
from chatlake.sources.views import with_views
from chatlake.functions import text as tx

CHANNEL = "ch-0"        # channel asked about in the transcript queries
SENDER = "user-7"       # user asked about in the per-user queries
SENDER_CHANNEL = "click"
LAST_N = 40             # transcript length on a mention (reference value)


@query("scan_history", with_views(
    "SELECT id, ts, sender, channel, message FROM chat_event", "chat_event"))
def scan_history(spark, sf):
    return views.chat_event(spark, sf).select("id", "ts", "sender", "channel", "message")


@query("recent_chats", with_views(f"""
    SELECT '{CHANNEL}' AS channel, count(*) AS n_lines,
           coalesce(string_agg(sender || ': ' || message, chr(10) ORDER BY id), '') AS transcript
    FROM (SELECT * FROM chat_text WHERE channel = '{CHANNEL}' ORDER BY id DESC LIMIT {LAST_N})""",
    "chat_text"))
def recent_chats(spark, sf):
    return hist.recent_chats(views.chat_text(spark, sf), CHANNEL, LAST_N)


@query("recent_chats_desc", with_views(f"""
    SELECT id, sender, message FROM chat_text WHERE channel = '{CHANNEL}'
    ORDER BY id DESC LIMIT {LAST_N}""", "chat_text"))
def recent_chats_desc(spark, sf):
    return hist.recent_chats_desc(views.chat_text(spark, sf), CHANNEL, LAST_N)


@query("recent_chats_all", with_views(f"""
    SELECT * FROM (SELECT id, sender, channel, message,
        row_number() OVER (PARTITION BY channel ORDER BY id DESC) AS rn FROM chat_text)
    WHERE rn <= {LAST_N}""", "chat_text"))
def recent_chats_all(spark, sf):
    return hist.last_n_per_channel(views.chat_text(spark, sf), LAST_N)


@query("channel_transcript", with_views(f"""
    SELECT channel, count(*) AS n_lines,
           string_agg(sender || ': ' || message, chr(10) ORDER BY id) AS transcript
    FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY id DESC) AS rn FROM chat_text)
    WHERE rn <= {LAST_N} GROUP BY channel""", "chat_text"))
def channel_transcript(spark, sf):
    return hist.channel_transcripts(views.chat_text(spark, sf), LAST_N)


@query("user_history", with_views(f"""
    SELECT id, ts, sender, channel, message FROM chat_event WHERE sender = '{SENDER}'""",
    "chat_event"))
def user_history(spark, sf):
    return hist.user_history(views.chat_event(spark, sf), SENDER)


@query("user_history_channel", with_views(f"""
    SELECT id, ts, sender, channel, message FROM chat_event
    WHERE sender = '{SENDER}' AND channel = '{SENDER_CHANNEL}'""", "chat_event"))
def user_history_channel(spark, sf):
    return hist.user_history(views.chat_event(spark, sf), SENDER, SENDER_CHANNEL)


@query("user_history_doc", with_views("""
    WITH sec AS (SELECT sender, channel,
            row_number() OVER (PARTITION BY sender ORDER BY min(id)) AS section_no
         FROM chat_text GROUP BY sender, channel)
    SELECT h.sender, s.section_no, h.channel, h.id AS seq, h.sender || ': ' || h.message AS line
    FROM chat_text h JOIN sec s ON h.sender = s.sender AND h.channel = s.channel
    UNION ALL SELECT sender, section_no, channel, -1, '--- ' || channel || ' ---' FROM sec
    UNION ALL SELECT sender, section_no, channel, 4611686018427387904, '' FROM sec""",
    "chat_text"))
def user_history_doc(spark, sf):
    return hist.user_history_lines(views.chat_text(spark, sf))


@query("primer_history_lines", with_views("""
    WITH sec AS (SELECT sender, channel,
            row_number() OVER (PARTITION BY sender ORDER BY min(id)) AS section_no
         FROM chat_text GROUP BY sender, channel)
    SELECT h.sender, s.section_no, h.channel, h.id AS seq, h.message AS line
    FROM chat_text h JOIN sec s ON h.sender = s.sender AND h.channel = s.channel
    UNION ALL SELECT sender, section_no, channel, -1, '=== ' || channel || ' ===' FROM sec""",
    "chat_text"))
def primer_history_lines(spark, sf):
    """The text a user profile is built from (CMD-5): '=== channel ==='
    sections of bare messages, as ordered lines."""
    return hist.user_history_lines(views.chat_text(spark, sf), style="primer")


@query("activity_counts", with_views("""
    SELECT sender, channel, count(*) AS n_messages FROM chat_event GROUP BY sender, channel""",
    "chat_event"))
def activity_counts(spark, sf):
    return hist.activity_counts(views.chat_event(spark, sf))


@query("activity_rollup", with_views("""
    SELECT day, channel, sender, count(*) AS n_messages,
           GROUPING(day, channel, sender) AS level
    FROM (SELECT CAST(ts AS DATE) AS day, channel, sender FROM chat_event)
    GROUP BY ROLLUP (day, channel, sender)""", "chat_event"))
def activity_rollup(spark, sf):
    return hist.activity_rollup(views.chat_event(spark, sf))


@query("high_water_mark", with_views("SELECT max(ts) AS hwm FROM chat_event", "chat_event"))
def high_water_mark(spark, sf):
    return hist.high_water_mark(views.chat_event(spark, sf))


SQL_SURFACE = """SELECT h.sender, u.primer, h.channel, COUNT(*) AS n_messages
FROM chat_history h JOIN chat_channels c ON c.channel_name = h.channel
LEFT JOIN user_info u ON h.sender = concat('user-', u.user_id)
WHERE h.channel = 'click' GROUP BY h.sender, u.primer, h.channel"""


def run_sql(spark, statement: str):
    """SQL over the registered chat views, read path only (SRC-10): the parsed
    statement must be a query, with no command or insert anywhere in it."""
    from py4j.java_gateway import is_instance_of

    if not statement.strip():
        raise ValueError("empty statement")
    plans = "org.apache.spark.sql.catalyst.plans.logical."
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    while todo:
        plan = todo.pop()
        if any(is_instance_of(spark.sparkContext._gateway, plan, plans + c) for c in ("Command", "ParsedStatement")):
            raise ValueError("only SELECT statements are allowed")
        for below in (plan.children(), plan.innerChildren()):
            todo += [p for p in (below.apply(i) for i in range(below.size()))
                     if is_instance_of(spark.sparkContext._gateway, p, plans + "LogicalPlan")]
    return spark.sql(statement)


def sql_session(spark, sf):
    """A session of its own with the three tables as views, so that the
    caller's views keep their names."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    views.chat_event(own, sf).createOrReplaceTempView("chat_history")
    views.users(own, sf).createOrReplaceTempView("user_info")
    (read_table(own, sf, "events").select(F.length("event_type").cast("long").alias("id"), F.col("event_type").alias("channel_name"))
     .distinct().createOrReplaceTempView("chat_channels"))
    return own


@query("sql_surface", with_views(
    """WITH chat_history AS (SELECT * FROM chat_event), user_info AS (SELECT * FROM users),
    chat_channels AS (SELECT DISTINCT length(event_type) AS id, event_type AS channel_name FROM events)
    """ + SQL_SURFACE, "chat_event", "users"))
def sql_surface(spark, sf):
    return run_sql(sql_session(spark, sf), SQL_SURFACE)


SAMPLE_SEED = "chatlake"


@query("sample_line", f"""
    WITH lines AS (SELECT doc_id, p, trim(l, ' ' || chr(9) || chr(10) || chr(13)) AS line
                   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
                                generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents))
    SELECT line, n_lines FROM (
      SELECT line, count(*) OVER () AS n_lines,
             row_number() OVER (ORDER BY md5(doc_id || ':' || p || '{SAMPLE_SEED}'), doc_id, p) AS r FROM lines)
    WHERE r = 1""")
def sample_line(spark, sf, seed: str = SAMPLE_SEED):
    """One line drawn uniformly from all lines of all documents (SRC-9, O-6).

    The draw is a hash of the line's place, so equal lines compete one by one,
    and it is repeatable for a seed; min_by over the hash is a partial
    aggregate (no global sort, no collect)."""
    docs = read_table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    key = F.struct(F.md5(F.concat("doc_id", F.lit(":"), "p", F.lit(seed))), "doc_id", "p")
    return lines.agg(F.min_by(tx.strip("l"), key).alias("line"), F.count(F.lit(1)).alias("n_lines"))
