"""Users and channels: insert-if-absent, update-by-name, lookups (SNK-2..4, J-2/4/6/7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.operators.chunks import PIECE_CHARS, pieces

# Fixed value: the reply for a name without a primer.
NO_PRIMER = "No primer found for %s."


def first_seen(sightings: DataFrame, key: str, value_cols: list[str],
               order_cols: list[str]) -> DataFrame:
    """Per key, the values of its earliest sighting by ``order_cols``.

    ``min_by`` over a struct key is a partial aggregate: each map task keeps
    one row per key, so a key seen a billion times costs one row per task.
    """
    order = F.struct(*order_cols)
    return sightings.groupBy(key).agg(
        *[F.min_by(c, order).alias(c) for c in value_cols],
        F.min(order).alias("_first"))


def insert_if_absent(existing: DataFrame, arriving: DataFrame, key: str,
                     value_cols: list[str], order_cols: list[str]) -> DataFrame:
    """The new rows: keys not yet stored, with their first-seen values.

    Running it again on its own output inserts nothing (left anti join).
    """
    new = first_seen(arriving, key, value_cols, order_cols)
    return new.join(existing.select(key), key, "left_anti").drop("_first")


def upsert(existing: DataFrame, arriving: DataFrame, key: str, value_cols: list[str],
           order_cols: list[str]) -> DataFrame:
    """The table after inserting the absent keys (existing rows untouched)."""
    added = insert_if_absent(existing, arriving, key, value_cols, order_cols)
    return existing.select(key, *value_cols).unionByName(added.select(key, *value_cols))


def update_by_name(users: DataFrame, updates: DataFrame, name_col: str = "user_name",
                   value_col: str = "primer") -> DataFrame:
    """SET value WHERE name = ? for every row with that name (SNK-4, J-4).

    ``updates`` has one row per name. Written to a new location by the caller;
    the table being read is never overwritten.
    """
    upd = updates.select(F.col(name_col), F.col(value_col).alias("_new"))
    return (users.join(upd, name_col, "left")
            .withColumn(value_col, F.coalesce(F.col("_new"), F.col(value_col)))
            .drop("_new"))


def primer_messages(users: DataFrame, names: DataFrame | None = None,
                    size: int = PIECE_CHARS) -> DataFrame:
    """Replies of the primer command (CMD-6, PF-4, O-5).

    First row by id for each name; a NULL primer counts as not found (D11).
    Up to ``size`` characters the reply is 'Primer for NAME: text' (the prefix
    is not counted); longer primers go out as bare ``size``-character pieces.
    Rows (user_name, pos, message).
    """
    u = users if names is None else users.join(names, "user_name", "left_semi")
    first = u.groupBy("user_name").agg(F.min_by("primer", F.col("id")).alias("primer"))\
        .where(F.col("primer").isNotNull())
    short = F.array(F.concat(F.lit("Primer for "), F.col("user_name"), F.lit(": "), F.col("primer")))
    msgs = F.when(F.length("primer") <= size, short).otherwise(pieces("primer", size))
    return first.select("user_name", F.posexplode(msgs).alias("pos", "message"))


def primer_replies(users: DataFrame, names: DataFrame, size: int = PIECE_CHARS) -> DataFrame:
    """The primer command for each user_name of ``names`` (CMD-6): the replies of
    ``primer_messages``, or the one that there is none (unknown name or no primer)."""
    asked = names.select("user_name").distinct()
    found = primer_messages(users, asked, size)
    none = (asked.join(found.select("user_name").distinct(), "user_name", "left_anti")
            .select("user_name", F.lit(0).alias("pos"), F.format_string(NO_PRIMER, "user_name").alias("message")))
    return found.unionByName(none)


def known_sender_messages(history: DataFrame, users: DataFrame,
                          name_col: str = "user_name") -> DataFrame:
    """Messages whose sender is a registered user (J-7): a left semi join."""
    return history.join(users.select(F.col(name_col).alias("sender")), "sender", "left_semi")


def resolve_mentions(messages: DataFrame, users: DataFrame, key: str = "message_id",
                     text_col: str = "content") -> DataFrame:
    """Replace '<@id>' mention tokens by '@name' of registered users (STR-13).

    Unknown ids stay as they are; of several names for one id the smallest is
    taken. A text is cut at its mentions once and each mention is looked up, so
    a name that looks like a mention is not read again. Each group holds only
    one message's mentions.
    """
    mention = r"<@(\d+)>"
    found = messages.select(key, F.explode(F.array_distinct(
        F.regexp_extract_all(text_col, F.lit(mention), 1))).alias("user_id"))
    known = users.groupBy("user_id").agg(F.min("user_name").alias("user_name"))
    names = found.distinct().join(known, "user_id").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("user_id", "user_name"))).alias("names"))
    # the text's parts between mentions, and the ids of the mentions
    cut = messages.join(names, key, "left").select(
        key, "names", F.split(text_col, r"<@\d+>", -1).alias("parts"),
        F.regexp_extract_all(text_col, F.lit(mention), 1).alias("ids"))
    said = F.zip_with("parts", "ids", lambda part, i: F.concat(part, F.coalesce(
        F.concat(F.lit("@"), F.try_element_at("names", i)), F.concat(F.lit("<@"), i, F.lit(">")), F.lit(""))))
    return cut.select(key, F.array_join(said, "").alias("clean_content"))
