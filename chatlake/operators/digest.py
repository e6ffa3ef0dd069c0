"""Extractive digests and profiles (C-6, C-7), in place of hosted-model text.

A message's score is ``sum_t tf * ln((1+N)/(1+df_t)) / sqrt(len)`` over its
terms (N = messages in the table, df_t = messages holding term t, len = its
term count). Terms are exploded once; document frequencies are a partial
aggregate; the join of terms to their frequencies is left to adaptive
execution (a runtime broadcast of the frequency table when it is measured
small, split skewed partitions when a very common term is hot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.functions import vectors as vx
from chatlake.operators.chunks import PIECE_CHARS, reply_pieces
from chatlake.operators.history import last_n_per_channel
from chatlake.operators.keyed_files import write_by_key

DIGEST_K = 5
USER_DIGEST_K = 3
PROFILE_TERMS = 5
RELEVANCE_THRESHOLD = 0.1
# Fixed value: the reply for a user without messages in the channel.
NO_HISTORY = "No chat history found for user %s in channel %s."
# The replies when a primer does not help, or there is no such user.
NOT_USEFUL = "The primer is not useful for answering the query."
NO_USER = "No user with the username '%s' found in the database."


def term_counts(messages: DataFrame, key: str = "id", text_col: str = "message",
                carry=()) -> DataFrame:
    """(key, carry..., term, tf) for every term of every message; ``carry``
    columns ride along so no join back to the messages is needed."""
    return (messages.select(key, *carry, F.explode(tx.terms(text_col)).alias("term"))
            .groupBy(key, *carry, "term").agg(F.count(F.lit(1)).alias("tf")))


def idf(tf: DataFrame, n_docs) -> DataFrame:
    """(term, df, idf) with idf = ln((1+N)/(1+df)); N may be a scalar Column.

    Every tf is over 0: reading it keeps ``tf`` the same plan here and where
    the frequencies are joined to it, so that it is shuffled once."""
    return tf.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, F.lit(1))).alias("df"))\
        .withColumn("idf", F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))))


def message_scores(messages: DataFrame, key: str = "id", text_col: str = "message",
                   carry=(), every: bool = False) -> DataFrame:
    """(key, carry..., score) for messages with at least one term; with ``every``
    the others too, whose score is 0."""
    tf = term_counts(messages, key, text_col, carry)
    n_docs = messages.agg(F.count(F.lit(1))).scalar()
    w = tf.join(idf(tf, n_docs).select("term", "idf"), "term")
    scored = w.groupBy(key, *carry).agg(
        (F.sum(F.col("tf") * F.col("idf")) / F.sqrt(F.sum("tf"))).alias("score"))
    if not every:
        return scored
    bare = messages.where(F.coalesce(F.size(tx.terms(text_col)), F.lit(0)) <= 0)
    return scored.unionByName(bare.select(key, *carry, F.lit(0.0).alias("score")))


def summaries(messages: DataFrame, group_cols: list[str], k: int = DIGEST_K,
              size: int = PIECE_CHARS) -> DataFrame:
    """The reply text of every group's summary: its k best-scored messages as
    'sender: message' lines in id order, cut to ``size``-character pieces (CMD-1,
    CMD-2). Rows (groups..., pos, piece). A message without a term scores 0, so a
    group that has nothing else still gets its reply.

    Messages are scored among ``messages``, each id once; only the k picked a
    group are joined back to their texts.
    """
    best = top_messages(messages, group_cols, k, every=True).select(*group_cols, "id")
    lines = messages.select("id", tx.line("sender", "message").alias("l")).join(best, "id")
    text = lines.groupBy(*group_cols).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("id", "l"))), lambda x: x["l"]), "\n").alias("text"))
    return reply_pieces(text, group_cols, "text", size)


def channel_summaries(history: DataFrame, n: int, k: int = DIGEST_K, size: int = PIECE_CHARS) -> DataFrame:
    """summarize n (CMD-1): every channel's summary of its last n messages."""
    return summaries(last_n_per_channel(history, n).drop("rn"), ["channel"], k, size)


def user_summaries(history: DataFrame, requests: DataFrame, k: int = USER_DIGEST_K, size: int = PIECE_CHARS) -> DataFrame:
    """usersummary (CMD-2): for each (sender, channel) of ``requests`` the
    summary of that user's messages there, or the reply that there are none."""
    asked = requests.select("sender", "channel").distinct()
    there = history.join(asked, ["sender", "channel"], "left_semi")
    none = (asked.join(there.select("sender", "channel").distinct(), ["sender", "channel"], "left_anti")
            .select("sender", "channel", F.lit(0).alias("pos"),
                    F.format_string(NO_HISTORY, "sender", "channel").alias("piece")))
    return summaries(there, ["sender", "channel"], k, size).unionByName(none)


def top_messages(messages: DataFrame, group_cols: list[str], k: int = DIGEST_K, every: bool = False) -> DataFrame:
    """The k best-scored messages of every group, ties by id (CMD-1, CMD-2).

    The per-group top-k is a partial WindowGroupLimit before the shuffle, so
    a hot group sends at most k rows per task.
    """
    scored = message_scores(messages, carry=group_cols, every=every)
    rank_key = F.round("score", 9)
    w = Window.partitionBy(*group_cols).orderBy(F.desc(rank_key), F.asc("id"))
    return (scored.withColumn("digest_rank", F.row_number().over(w))
            .where(F.col("digest_rank") <= k)
            .select(*group_cols, "digest_rank", "id", F.round("score", 6).alias("score")))


def user_profiles(messages: DataFrame, n_terms: int = PROFILE_TERMS) -> DataFrame:
    """Per sender: activity facts and the most distinctive terms (C-6 profile).

    weight(sender, term) = total tf of the term in the sender's messages *
    idf(term); the top terms are a bounded per-sender top-k.
    """
    tf = term_counts(messages, carry=["sender"])
    n_docs = messages.agg(F.count(F.lit(1))).scalar()
    by_sender = tf.groupBy("sender", "term").agg(F.sum("tf").alias("ttf"))
    weighted = by_sender.join(idf(tf, n_docs).select("term", "idf"), "term")\
        .withColumn("weight", F.col("ttf") * F.col("idf"))
    w = Window.partitionBy("sender").orderBy(F.desc(F.round("weight", 9)), F.asc("term"))
    top = (weighted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_terms)
           .groupBy("sender").agg(F.array_join(F.transform(
               F.sort_array(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]), " ")
               .alias("top_terms")))
    facts = messages.groupBy("sender").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.countDistinct("channel").alias("n_channels"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.sum(F.size(tx.terms("message"))).alias("n_terms"))
    # a plain join would keep NULL senders out of the term counts on this side only, which then are shuffled twice
    told = facts.join(top.withColumnRenamed("sender", "_sender"), F.col("sender").eqNullSafe(F.col("_sender")), "left").drop("_sender")
    return told.withColumn("top_terms", F.when(F.col("sender").isNotNull(), F.col("top_terms")))


def primer_relevance(requests: DataFrame, users: DataFrame,
                     threshold: float = RELEVANCE_THRESHOLD, dim: int = 64) -> DataFrame:
    """Is a user's primer useful for a question (C-7, CMD-7, D7)?

    requests: (request_id, user_name, question). The primer is looked up by
    name (first row by id); similarity is the cosine of the hashed term
    vectors. No such user or no primer -> NULL.
    """
    primers = users.groupBy("user_name").agg(F.min_by("primer", F.col("id")).alias("primer"))
    j = requests.join(primers, "user_name", "left").select(
        "request_id", "user_name", "primer",
        vx.hashed_tf("primer", dim).alias("va"), vx.hashed_tf("question", dim).alias("vb"))
    sim = vx.cosine("va", "vb")
    return j.select("request_id", "user_name",
                    F.when(F.col("primer").isNotNull(), F.round(F.coalesce(sim, F.lit(0.0)), 6))
                    .alias("similarity"),
                    F.when(F.col("primer").isNotNull(), F.coalesce(sim, F.lit(0.0)) > threshold)
                    .alias("relevant"))


def primer_check(requests: DataFrame, users: DataFrame, threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """The answer to each (request_id, user_name, question) of the primer check
    (CMD-7): the primer of the name's first row by id if it helps with the question,
    else the reply that it does not, or that there is no such user. Usefulness is
    ``primer_relevance``'s, in place of a hosted model's yes or no."""
    first = users.groupBy("user_name").agg(F.min_by("primer", F.col("id")).alias("primer"), F.lit(True).alias("found"))
    useful = primer_relevance(requests, users, threshold).select("request_id", "user_name", "relevant")
    return (requests.join(useful, ["request_id", "user_name"]).join(first, "user_name", "left")
            .select("request_id", "user_name", F.when(F.col("found").isNull(), F.format_string(NO_USER, "user_name"))
                    .when(F.coalesce("relevant", F.lit(False)), F.col("primer")).otherwise(F.lit(NOT_USEFUL)).alias("reply")))


def profile_text(profiles: DataFrame) -> DataFrame:
    """One primer line per sender from its profile facts (C-6 text form)."""
    return profiles.select("sender", F.format_string(
        "%s: %d messages in %d channels (ids %d..%d); distinctive terms: %s",
        "sender", "n_messages", "n_channels", "first_id", "last_id",
        F.coalesce("top_terms", F.lit(""))).alias("primer"))


def write_primers(primers: DataFrame, path: str) -> None:
    """Primer text files, one folder per sender (SNK-7). The cost is that of the
    files, so senders are dealt to all tasks however few bytes they are."""
    n = int(primers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = primers.select("sender", F.col("primer").alias("line"))
    write_by_key(rows.repartitionByRange(n, "sender").sortWithinPartitions("sender"), path, "sender")
