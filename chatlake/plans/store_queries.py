"""Registered ingest and registry queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.functions import vectors as vx
from chatlake.operators import audit
from chatlake.operators import ingest as ing
from chatlake.operators import registry as reg
from chatlake.operators import store
from chatlake.operators.ids import dense_ids
from chatlake.plans.registry import query
from chatlake.session import run_dir
from chatlake.sources import views
from chatlake.sources.tables import create_tables, read_table
from chatlake.sources.views import REGISTERED_BEFORE, STORED_BEFORE, with_views

TOKEN_RE_SQL = "@?[\\p{L}\\p{N}]+(?:[._''-][\\p{L}\\p{N}]+)*"
TERM_RE_SQL = "[\\p{L}\\p{N}]+"


def _hashed_stats_sql(src: str, key: str, text: str) -> str:
    """nnz and norm of the 64-bucket hashed term counts, DuckDB side."""
    return f"""hs_terms AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '{TERM_RE_SQL}')) AS term FROM {src}),
    hs_b AS (SELECT k, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS c
             FROM hs_terms GROUP BY ALL),
    hs AS (SELECT k, count(*) AS nnz, sqrt(sum(c * c)) AS norm,
                  string_agg(CAST(bucket AS VARCHAR) || ':' || CAST(c AS VARCHAR), ' ' ORDER BY bucket) AS slots
           FROM hs_b GROUP BY k)"""


def _nnz(v):
    return F.size(F.filter(v, lambda x: x > 0))


def _slots(v):
    """'slot:count' of the slots that are not zero, in order."""
    said = F.transform(v, lambda x, i: F.when(x > 0, F.concat_ws(":", i, x.cast("long"))))
    return F.array_join(said, " ")


@query("dense_ids", """
    SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS id FROM events""")
def dense_ids_q(spark, sf):
    """Dense ascending ids in (ts, event_id) order over the whole table (W-2)."""
    e = read_table(spark, sf, "events").select("event_id", "ts")
    return dense_ids(e, ["ts", "event_id"], "id").select("event_id", "id")


_NORMALIZED = f"array_to_string(regexp_extract_all(lower(props), '{TOKEN_RE_SQL}'), ' ')"


@query("ingest_messages", f"""
    WITH src AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, 'user-' || CAST(user_id AS VARCHAR) AS sender,
                        event_type AS channel, {_NORMALIZED} AS message FROM events),
    {_hashed_stats_sql('src', 'event_id', 'message')}
    SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS id, ts, sender, channel, message,
           event_id AS source_id, round(coalesce(hs.norm, 0), 6) AS norm
    FROM src LEFT JOIN hs ON hs.k = src.event_id""")
def ingest_messages(spark, sf):
    """Two appends through the write path: the store as it was before a
    restart, then everything after, numbered on from the store's record (SNK-1)."""
    path = run_dir(spark, "chat_history")
    msgs = views.chat_event(spark, sf).withColumnRenamed("id", "source_id")
    before = F.col("ts") < F.lit(STORED_BEFORE).cast("timestamp")
    store.add(msgs.where(before), path, "restart-0")
    store.add(msgs.where(~before), path, "restart-1")
    out = spark.read.parquet(path)
    return out.select("id", "ts", "sender", "channel", "message", "source_id",
                      F.round("norm", 6).alias("norm"))


@query("embed_messages", with_views(f"""WITH {_hashed_stats_sql('chat_text', 'id', 'message')}
    SELECT id, coalesce(hs.nnz, 0) AS nnz, round(coalesce(hs.norm, 0), 6) AS norm, coalesce(slots, '') AS slots
    FROM chat_text LEFT JOIN hs ON hs.k = chat_text.id""", "chat_text"))
def embed_messages(spark, sf):
    """Default embedding of every message (U-1)."""
    v = views.chat_text(spark, sf).select("id", ing.default_embed(F.col("message")).alias("v"))
    return v.select("id", _nnz("v").alias("nnz"), F.round(vx.norm("v"), 6).alias("norm"), _slots("v").alias("slots"))


@query("reembed_all", with_views(f"""WITH {_hashed_stats_sql('chat_vec', 'id', 'message')}
    SELECT id, coalesce(hs.nnz, 0) AS nnz, round(coalesce(hs.norm, 0), 6) AS norm, coalesce(slots, '') AS slots
    FROM chat_vec LEFT JOIN hs ON hs.k = chat_vec.id""", "chat_vec"))
def reembed_all(spark, sf):
    """Recompute every stored vector from its message in one pass, written
    to a new location (SNK-5; D5: the message, not the channel)."""
    path = run_dir(spark, "reembedded")
    stored = views.chat_vec(spark, sf)
    redone = stored.withColumn("vector", ing.default_embed(F.col("message")))\
        .withColumn("norm", vx.norm("vector"))
    redone.write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("id", _nnz("vector").alias("nnz"), F.round("norm", 6).alias("norm"), _slots("vector").alias("slots"))


@query("reembed_store", f"""
    WITH src AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS id, {_NORMALIZED} AS message FROM events),
    {_hashed_stats_sql('src', 'id', 'message')}
    SELECT id, coalesce(hs.nnz, 0) AS nnz, round(coalesce(hs.norm, 0), 6) AS norm, coalesce(slots, '') AS slots, true AS changed
    FROM src LEFT JOIN hs ON hs.k = src.id""")
def reembed_store(spark, sf):
    """All events ingested to a store under one embedding, then each of its vectors
    recomputed from its message by another and the store written to a new location;
    both are compared (SNK-5; D5)."""
    path = run_dir(spark, "reembed_store")
    flat = lambda m: F.array_repeat(F.lit(0.5).cast("float"), ing.EMBED_DIM)
    store.add(views.chat_event(spark, sf).withColumnRenamed("id", "source_id"), f"{path}/old", "import", embed=flat)
    back = store.reembed(spark, f"{path}/old", f"{path}/new")
    old = spark.read.parquet(f"{path}/old").select("id", F.col("vector").alias("before"))
    return back.join(old, "id").select("id", _nnz("vector").alias("nnz"), F.round("norm", 6).alias("norm"),
                                       _slots("vector").alias("slots"), (F.col("vector") != F.col("before")).alias("changed"))


def _channel_sightings(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(F.col("user_id").alias("id"),
                    F.concat(F.lit("dm-"), F.col("user_id").cast("string"), F.lit("-"),
                             F.col("event_type")).alias("channel_name"),
                    F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _split(df):
    t = F.lit(REGISTERED_BEFORE).cast("timestamp")
    return df.where(F.col("ts") < t), df.where(F.col("ts") >= t)


@query("upsert_channels", """
    SELECT user_id AS id,
           arg_min('dm-' || CAST(user_id AS VARCHAR) || '-' || event_type,
                   struct_pack(a := ts, b := event_id)) AS channel_name
    FROM events GROUP BY user_id""")
def upsert_channels(spark, sf):
    """Channels known before the stream, plus channels whose id is new,
    named as first seen (SNK-2)."""
    early, late = _split(_channel_sightings(spark, sf))
    existing = reg.first_seen(early, "id", ["channel_name"], ["ts", "event_id"]).drop("_first")
    return reg.upsert(existing, late, "id", ["channel_name"], ["ts", "event_id"])


@query("upsert_users", """
    SELECT CAST(user_id AS VARCHAR) AS user_id,
           arg_min('user-' || CAST(user_id AS VARCHAR), struct_pack(a := ts, b := event_id)) AS user_name
    FROM events GROUP BY user_id""")
def upsert_users(spark, sf):
    """Users registered before the stream plus first sightings of new ids (SNK-3)."""
    e = read_table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_name"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id")
    early, late = _split(e)
    existing = reg.first_seen(early, "user_id", ["user_name"], ["ts", "event_id"]).drop("_first")
    return reg.upsert(existing, late, "user_id", ["user_name"], ["ts", "event_id"])


_UPDATES_SQL = """SELECT c.c_name AS user_name, 'urgent orders: ' || CAST(count(*) AS VARCHAR) AS primer
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE o.o_orderpriority = '1-URGENT' GROUP BY c.c_name"""


def _primer_updates(spark, sf):
    o = read_table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    c = read_table(spark, sf, "customer")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.col("c_name").alias("user_name"))
            .agg(F.concat(F.lit("urgent orders: "), F.count(F.lit(1)).cast("string")).alias("primer")))


@query("update_primer", with_views(f"""WITH upd AS ({_UPDATES_SQL})
    SELECT u.id, u.user_name, coalesce(upd.primer, u.primer) AS primer
    FROM users u LEFT JOIN upd ON u.user_name = upd.user_name""", "users"))
def update_primer(spark, sf):
    """Profiles set for every row with the name, written as a new table version."""
    path = run_dir(spark, "user_info")
    new = reg.update_by_name(views.users(spark, sf), _primer_updates(spark, sf))
    new.select("id", "user_name", "primer").write.parquet(path)
    return spark.read.parquet(path)


@query("primer_lookup", with_views("""
    WITH f AS (SELECT user_name, arg_min_null(primer, id) AS primer FROM users GROUP BY user_name)
    SELECT user_name, 0 AS pos, 'Primer for ' || user_name || ': ' || primer AS message
    FROM f WHERE primer IS NOT NULL AND length(primer) <= 2000
    UNION ALL
    SELECT user_name, pos, substr(primer, pos * 2000 + 1, 2000) FROM (
      SELECT user_name, primer, unnest(range(0, CAST(ceil(length(primer) / 2000.0) AS BIGINT))) AS pos
      FROM f WHERE length(primer) > 2000)""", "users"))
def primer_lookup(spark, sf):
    return reg.primer_messages(views.users(spark, sf))


@query("primer_replies", with_views("""
    WITH asked AS (SELECT user_name FROM users UNION SELECT DISTINCT 'user-' || CAST(user_id AS VARCHAR) FROM events),
    f AS (SELECT user_name, arg_min_null(primer, id) AS primer FROM users GROUP BY user_name),
    a AS (SELECT user_name, primer FROM asked LEFT JOIN f USING (user_name))
    SELECT user_name, 0 AS pos, CASE WHEN primer IS NULL THEN 'No primer found for ' || user_name || '.'
           ELSE 'Primer for ' || user_name || ': ' || primer END AS message
    FROM a WHERE primer IS NULL OR length(primer) <= 2000
    UNION ALL
    SELECT user_name, pos, substr(primer, pos * 2000 + 1, 2000) FROM (
      SELECT user_name, primer, unnest(range(0, CAST(ceil(length(primer) / 2000.0) AS BIGINT))) AS pos
      FROM a WHERE length(primer) > 2000)""", "users"))
def primer_replies(spark, sf):
    """The primer command for every user and for names that are none (CMD-6)."""
    u = views.users(spark, sf)
    names = u.select("user_name").union(read_table(spark, sf, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string"))))
    return reg.primer_replies(u, names)


@query("known_sender_messages", with_views("""
    SELECT id, sender, channel FROM chat_event
    WHERE sender IN (SELECT 'user-' || CAST(c_custkey AS VARCHAR) FROM customer)""", "chat_event"))
def known_sender_messages(spark, sf):
    known = read_table(spark, sf, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_name"))
    return reg.known_sender_messages(views.chat_event(spark, sf), known)\
        .select("id", "sender", "channel")


@query("resolve_mentions", f"""
    WITH reg AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN user_id % 10 = 0 THEN '<@' || CAST(user_id + 1 AS VARCHAR) || '>'
                        ELSE 'user-' || CAST(user_id AS VARCHAR) END AS user_name
                 FROM events WHERE ts < TIMESTAMP '{REGISTERED_BEFORE}' GROUP BY user_id),
    m AS (SELECT event_id AS message_id, CAST((user_id * 7) % 150 AS VARCHAR) AS a,
                 CAST((user_id * 7) % 150 + 1 AS VARCHAR) AS b, props FROM events)
    SELECT message_id, coalesce('@' || x.user_name, '<@' || a || '>') || ' ' || coalesce('@' || y.user_name, '<@' || b || '>')
           || props AS clean_content
    FROM m LEFT JOIN reg x ON x.user_id = m.a LEFT JOIN reg y ON y.user_id = m.b""")
def resolve_mentions(spark, sf):
    e = read_table(spark, sf, "events")
    first = (F.col("user_id") * 7) % 150
    msgs = e.select(F.col("event_id").alias("message_id"),
                    F.concat(F.lit("<@"), first.cast("string"), F.lit("> <@"), (first + 1).cast("string"), F.lit(">"),
                             "props").alias("content"))
    known = e.where(F.col("ts") < F.lit(REGISTERED_BEFORE).cast("timestamp_ntz"))\
        .select(F.col("user_id").cast("string").alias("user_id")).distinct()\
        .select("user_id", F.when(F.col("user_id").cast("long") % 10 == 0, F.concat(
            F.lit("<@"), (F.col("user_id").cast("long") + 1).cast("string"), F.lit(">")))
            .otherwise(F.concat(F.lit("user-"), "user_id")).alias("user_name"))
    return reg.resolve_mentions(msgs, known)


_PAIRS_SQL = """p AS (SELECT a.conv_id, a.turn, a.text AS content, b.text AS response,
                      len(regexp_extract_all(a.text, '[^\\s]+')) + len(regexp_extract_all(b.text, '[^\\s]+')) AS tokens_used,
                      make_timestamp(1704067200000000 + (a.conv_id * 60 + a.turn) * 1000000) AS ts
               FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
               WHERE a.role = 'user' AND b.role = 'assistant')"""


def _interactions(spark, sf):
    """Request/answer pairs with their time and tokens."""
    c = read_table(spark, sf, "conversations")
    a, b = c.alias("a"), c.alias("b")
    pairs = (a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
             .where((F.col("a.role") == "user") & (F.col("b.role") == "assistant"))
             .select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"),
                     F.col("a.text").alias("content"), F.col("b.text").alias("response"),
                     F.timestamp_seconds(F.lit(1704067200) + F.col("a.conv_id") * 60 + F.col("a.turn"))
                     .alias("ts")))
    return pairs.withColumn("tokens_used", tx.token_count("content") + tx.token_count("response"))


@query("interaction_audit", f"""WITH {_PAIRS_SQL}
    SELECT CAST(ts AS DATE) AS day, count(*) AS n_requests, CAST(sum(tokens_used) AS BIGINT) AS tokens_used,
           CAST(sum(length(content) + length(response)) AS BIGINT) AS n_chars FROM p GROUP BY 1""")
def interaction_audit(spark, sf):
    """The audit table written in two batches, one of them twice, then read
    back: requests, tokens and characters of each day (SNK-9)."""
    path = run_dir(spark, "audit")
    rows = _interactions(spark, sf)
    for batch, odd in (("b0", 0), ("b1", 1), ("b1", 1)):
        audit.append(rows.where(F.col("conv_id") % 2 == odd), path, batch)
    return audit.daily(audit.read(spark, path))


@query("interaction_log", f"""
    WITH {_PAIRS_SQL}
    SELECT conv_id, turn, tokens_used,
           md5(chr(10) || repeat('*', 20) || chr(10) || 'Time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10)
               || 'Content Sent: ' || content || chr(10) || 'Response: ' || response || chr(10)
               || 'Tokens Used: ' || CAST(tokens_used AS VARCHAR) || chr(10) || repeat('*', 20)) AS log_md5
    FROM p""")
def interaction_log(spark, sf):
    """Audit rows for each request/answer pair and their text form (SNK-9)."""
    logged = _interactions(spark, sf)
    stars = F.lit("*" * 20)
    text = F.concat(F.lit("\n"), stars, F.lit("\nTime: "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                    F.lit("\nContent Sent: "), "content", F.lit("\nResponse: "), "response",
                    F.lit("\nTokens Used: "), F.col("tokens_used").cast("string"), F.lit("\n"), stars)
    return logged.select("conv_id", "turn", "tokens_used", F.md5(text).alias("log_md5"))


@query("list_text_channels", """
    SELECT DISTINCT 1 + user_id % 3 AS server_id, CAST(length(event_type) AS BIGINT) AS id,
           event_type AS name FROM events WHERE event_type <> 'signup'""")
def list_text_channels(spark, sf):
    """Server listing -> its text channels (SRC-8)."""
    m = views.message_events(spark, sf)
    return (m.where(F.col("channel.kind") == "text")
            .select((1 + F.col("author.id").cast("long") % 3).alias("server_id"),
                    F.col("channel.id").alias("id"), F.col("channel.name").alias("name")).distinct())


@query("schema_tables", with_views("""
    SELECT 'chat_channels' AS table_name, count(DISTINCT user_id) AS n_rows FROM events
    UNION ALL SELECT 'user_info', count(*) FROM users
    UNION ALL SELECT 'chat_history', count(*) FROM chat_vec""", "users", "chat_vec"))
def schema_tables(spark, sf):
    """CREATE TABLE IF NOT EXISTS for the three tables, loaded from the test
    views, then read back through the catalog (SRC-2..4)."""
    db = f"chatlake_{uuid.uuid4().hex[:10]}"
    loc = run_dir(spark, db)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{loc}'")
    previous = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(db)
    try:
        create_tables(spark, loc)
        chans = reg.first_seen(_channel_sightings(spark, sf), "id", ["channel_name"],
                               ["ts", "event_id"]).drop("_first")
        chans.select("id", "channel_name", *[F.lit(None).cast("string").alias(c)
                                             for c in ("description", "short_term", "long_term")])\
            .write.insertInto(f"{db}.chat_channels")
        u = views.users(spark, sf)
        u.select("id", "user_id", "user_name", F.lit(None).cast("string").alias("real_name"),
                 "primer", F.lit(None).cast("string").alias("history_summary"))\
            .write.insertInto(f"{db}.user_info")
        h = views.chat_vec(spark, sf)
        h.select("id", "ts", "sender", "channel", "message", "vector",
                 vx.norm("vector").alias("norm"), F.lit(None).cast("timestamp"))\
            .write.insertInto(f"{db}.chat_history")
        parts = [spark.table(f"{db}.{t}").agg(F.lit(t).alias("table_name"),
                                               F.count(F.lit(1)).alias("n_rows"))
                 for t in ("chat_channels", "user_info", "chat_history")]
    finally:
        spark.catalog.setCurrentDatabase(previous)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
