"""Fixed table schemas of the chat store (one place, checked on read)."""

from pyspark.sql import types as T

CHAT_CHANNELS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("channel_name", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("short_term", T.StringType(), True),
    T.StructField("long_term", T.StringType(), True),
])

USER_INFO = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("user_name", T.StringType(), False),
    T.StructField("real_name", T.StringType(), True),
    T.StructField("primer", T.StringType(), True),
    T.StructField("history_summary", T.StringType(), True),
])

CHAT_HISTORY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("sender", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
    T.StructField("norm", T.DoubleType(), True),
    T.StructField("ingest_ts", T.TimestampType(), True),    # arrival; ts is the event's time
])

AUTHOR = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("roles", T.ArrayType(T.StringType())),
])
CHANNEL_REF = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),  # text, dm, other
])
MENTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
])
MESSAGE_EVENT = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("author", AUTHOR),
    T.StructField("channel", CHANNEL_REF),
    T.StructField("mentions", T.ArrayType(MENTION)),
    T.StructField("attachments", T.ArrayType(T.StringType())),
    T.StructField("content", T.StringType()),
])

INTERACTION_LOG = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("content", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("tokens_used", T.LongType()),
])

TABLES = {"chat_channels": CHAT_CHANNELS, "user_info": USER_INFO,
          "chat_history": CHAT_HISTORY}
