"""Chat-store views over the driver's test tables (FIXTURES.md section 2).

Each view exists twice: as a Spark DataFrame builder and as DuckDB SQL used
by the oracle. Both read the whole table; nothing is subset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.sources.tables import read_table

# Fixed fixture parameters (ours, not the reference's).
BOT_ID = "7"                 # author id of the bot in the test stream
BOT_NAME = "user-7"          # its display name
MEMBER_ROLE = "member"       # the role whose messages are logged
SPECIAL_NAME = "user-13"     # the name that gets a canned reply
REGISTERED_BEFORE = "2024-01-03 00:00:00"   # users/channels known before the stream
STORED_BEFORE = "2024-01-16 00:00:00"       # chat_history content before a restart
STREAM_FROM = "2024-01-20 00:00:00"         # live messages after that restart
ANSWER_WITHIN = "1 DAY"                     # an answer's time behind its request


def chat_text(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.concat(F.lit("ch-"), (F.col("conv_id") % 10).cast("string")).alias("channel"),
        F.col("role").alias("sender"),
        F.col("text").alias("message"),
    )


def chat_event(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("sender"),
        F.col("event_type").alias("channel"),
        F.col("props").alias("message"),
    )


def chat_vec(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with a vector: the embeddings, given out in turn by id."""
    emb = read_table(spark, sf, "embeddings")
    given = emb.select(F.col("vec_id").alias("given"), F.col("embedding").alias("vector"))
    turn = F.pmod(F.col("id"), F.greatest(F.lit(emb.agg(F.max("vec_id")).first()[0] or 0) + 1, F.lit(1)))
    return chat_event(spark, sf).withColumn("given", turn).join(given, "given").drop("given")


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_name").alias("user_name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("primer"),
    )


def long_text(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text")


def message_events(spark: SparkSession, sf: str) -> DataFrame:
    """Nested message events (MESSAGE_EVENT schema) built from ``events``."""
    return events_to_messages(read_table(spark, sf, "events"))


def events_to_messages(e: DataFrame) -> DataFrame:
    """Shape ``events`` rows (a table or a stream) as MESSAGE_EVENT rows."""
    role = F.when(F.col("user_id") % 2 == 0, F.lit(MEMBER_ROLE)).otherwise(F.lit("guest"))
    roles = F.array(role, F.when(F.col("event_type") == "view", role)
                    .otherwise(F.col("event_type")))
    name = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    mention = F.struct(F.lit(BOT_ID).alias("id"), F.lit(BOT_NAME).alias("name"))
    return e.select(
        F.col("event_id").alias("message_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.struct(F.col("user_id").cast("string").alias("id"), name.alias("name"),
                 roles.alias("roles")).alias("author"),
        F.struct(F.length("event_type").cast("long").alias("id"),
                 F.col("event_type").alias("name"),
                 F.when(F.col("event_type") == "signup", F.lit("dm"))
                 .otherwise(F.lit("text")).alias("kind")).alias("channel"),
        F.when(F.col("value") >= 150, F.array(mention))
        .otherwise(F.array().cast("array<struct<id:string,name:string>>")).alias("mentions"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") >= 100),
               F.array(F.lit("receipt.png")))
        .otherwise(F.array().cast("array<string>")).alias("attachments"),
        F.concat(F.when(F.col("value") < 2, F.lit("!sum ")).otherwise(F.lit("")),
                 F.col("props")).alias("content"),
    )


def mentioning_messages(e: DataFrame) -> DataFrame:
    """``events_to_messages`` with the mention's token in the text, as it is sent."""
    m = events_to_messages(e)
    return m.withColumn("content", F.concat(F.array_join(F.transform("mentions", lambda x: F.concat(
        F.lit("<@"), x["id"], F.lit("> "))), ""), "content"))


BUILDERS = {
    "chat_text": chat_text, "chat_event": chat_event, "chat_vec": chat_vec,
    "users": users, "long_text": long_text, "message_events": message_events,
}


def register_views(spark: SparkSession, sf: str) -> None:
    for name, build in BUILDERS.items():
        build(spark, sf).createOrReplaceTempView(name)


# ---- DuckDB SQL of the same views (oracle side) ----
VIEW_SQL = {
    "chat_text": """SELECT conv_id*100+turn AS id, 'ch-' || CAST(conv_id % 10 AS VARCHAR) AS channel,
        role AS sender, text AS message FROM conversations""",
    "chat_event": """SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts,
        'user-' || CAST(user_id AS VARCHAR) AS sender, event_type AS channel, props AS message
        FROM events""",
    "chat_vec": """SELECT e.*, m.embedding AS vector FROM chat_event e
        JOIN embeddings m ON e.id % (SELECT max(vec_id) + 1 FROM embeddings) = m.vec_id""",
    "users": """SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS user_id, c_name AS user_name,
        CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS primer FROM customer""",
    "long_text": "SELECT doc_id, text FROM documents",
    "message_events": f"""SELECT event_id AS message_id, CAST(ts AS TIMESTAMP) AS event_ts,
        CAST(user_id AS VARCHAR) AS author_id, 'user-' || CAST(user_id AS VARCHAR) AS author_name,
        [CASE WHEN user_id % 2 = 0 THEN '{MEMBER_ROLE}' ELSE 'guest' END,
         CASE WHEN event_type = 'view' THEN (CASE WHEN user_id % 2 = 0 THEN '{MEMBER_ROLE}' ELSE 'guest' END)
              ELSE event_type END] AS author_roles,
        event_type AS channel_name,
        CASE WHEN event_type = 'signup' THEN 'dm' ELSE 'text' END AS channel_kind,
        value >= 150 AS mentions_bot,
        CASE WHEN event_type = 'purchase' AND value >= 100 THEN 1 ELSE 0 END AS n_attachments,
        CASE WHEN value < 2 THEN '!sum ' ELSE '' END || props AS content
        FROM events""",
}
VIEW_DEPS = {"chat_vec": ["chat_event"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named views (and their dependencies)."""
    order: list[str] = []

    def add(n):
        for d in VIEW_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{sql[len('WITH RECURSIVE'):].lstrip()}"
    if sql.upper().startswith("WITH"):
        return f"WITH {ctes},\n{sql[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"
