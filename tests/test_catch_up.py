"""The store's record, catch-up, redelivery, keyed buffers and joined streams on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators import digest as dg
from chatlake.operators import prompts as pr
from chatlake.operators import routing as rt
from chatlake.operators import store
from chatlake.schemas import MESSAGE_EVENT
from chatlake.session import remove_dir, run_dir
from chatlake.streaming import jobs

T0 = dt.datetime(2024, 3, 1, 12)
ROWS = "ts timestamp, source_id long, sender string, channel string, message string"
BOT, ROLE, SPECIAL = "7", "member", "zed"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows(spark, *ids, channel="a"):
    return spark.createDataFrame([(at(i), i, "u", channel, f"word {i}") for i in ids], ROWS)


def ids_of(spark, path):
    got = sorted((r["id"], r["source_id"]) for r in spark.read.parquet(path).select("id", "source_id").collect())
    assert [i for i, _ in got] == list(range(len(got)))
    return [s for _, s in got]


# ---- the record ----
def test_record_folds_old_batches(spark, monkeypatch):
    monkeypatch.setattr(store, "RECENT", 2)
    path = run_dir(spark, "t_record") + "/h"
    for k in range(7):
        store.add(rows(spark, 10 * k, 10 * k + 1), path, f"b{k}")
    record = store.Record(spark, path)
    assert len(record.batches) <= 5 and record.next_id == 14 and record.mark == at(61)
    assert all(record.has(f"b{k}") for k in range(7)) and not record.has("b7")
    # a batch that is finished long since is not written again, and an id of one is known
    assert store.add(rows(spark, 99), path, "b0").count() == 2
    assert store.add(rows(spark, 0, 1, 61, 70), path, "again", unique=True).select("source_id").collect()[0][0] == 70
    assert ids_of(spark, path) == [*(10 * k + j for k in range(7) for j in (0, 1)), 70]


def test_record_survives_a_batch_that_was_cut_off(spark):
    path = run_dir(spark, "t_cut") + "/h"
    store.add(rows(spark, 0, 1), path, "b0")
    before = store.Record(spark, path)
    store.add(rows(spark, 2, 3), path, "b1")
    # as if the last slot had not been written: the batch is not finished and is written again
    remove_dir(spark, f"{path}/_state/slot={(before.seq + 1) % 2}")
    assert not store.Record(spark, path).has("b1")
    store.add(rows(spark, 2, 3), path, "b1")
    assert ids_of(spark, path) == [0, 1, 2, 3]


def test_add_of_no_rows_and_of_bad_names(spark):
    path = run_dir(spark, "t_none") + "/h"
    assert store.add(rows(spark, 1).limit(0), path, "none", unique=True) is None
    assert store.Record(spark, path).has("none")
    assert store.add(rows(spark, 1, 1, 1), path, "one", unique=True).count() == 1
    with pytest.raises(ValueError):
        store.add(rows(spark, 2), path, "a/b")


# ---- catch-up ----
def test_catch_up_of_an_empty_store_reads_nothing(spark):
    def never(_):
        raise AssertionError("read")

    assert store.catch_up(spark, ["a"], never, run_dir(spark, "t_empty") + "/h", "m0") == (None, [])


def test_catch_up_leaves_a_failing_channel_behind(spark):
    path = run_dir(spark, "t_fail") + "/h"
    store.add(rows(spark, 0, 1), path, "live-0")
    source = rows(spark, 0, 1, 5, 6).unionByName(rows(spark, 3, 7, channel="b"))
    broken = {"b"}

    def load(channels):
        # reading a row of a broken channel fails in the task
        bad = F.col("channel").isin(*(broken & set(channels) or {"-"}))
        return source.where(F.col("channel").isin(channels)).withColumn(
            "message", F.when(bad, F.raise_error(F.lit("no permission")).cast("string")).otherwise(F.col("message")))

    stored, failed = store.catch_up(spark, ["a", "b"], load, path, "m0")
    assert failed == ["b"] and sorted(r["source_id"] for r in stored.collect()) == [5, 6]
    # live rows go on, one of them in the channel that is behind
    store.add(rows(spark, 9).unionByName(rows(spark, 8, channel="b")), path, "live-1", unique=True)
    assert store.Record(spark, path).behind == {"b": at(1)}
    broken.clear()
    stored, failed = store.catch_up(spark, ["a", "b"], load, path, "m1")
    assert failed == [] and sorted(r["source_id"] for r in stored.collect()) == [3, 7]
    assert store.catch_up(spark, ["a", "b"], load, path, "m2")[0] is None
    assert sorted(ids_of(spark, path)) == [0, 1, 3, 5, 6, 7, 8, 9] and store.Record(spark, path).behind == {}


def test_catch_up_with_every_channel_failing(spark):
    path = run_dir(spark, "t_all_fail") + "/h"
    store.add(rows(spark, 0), path, "live-0")
    load = lambda c: rows(spark, 5).withColumn("message", F.raise_error(F.lit("gone")).cast("string"))
    assert store.catch_up(spark, ["a"], load, path, "m0") == (None, ["a"])
    assert store.catch_up(spark, ["a"], lambda c: rows(spark, 5), path, "m1")[0].count() == 1
    assert ids_of(spark, path) == [0, 5]


# ---- streams ----
def event(i, author, channel, *, mention=False, kind="text", roles=(ROLE,), minutes=None, content=None):
    return (i, at(i if minutes is None else minutes), (author, f"user-{author}" if author else None, list(roles)),
            (1, channel, kind), [(BOT, "bot")] if mention else [], [], content or f"says {i}")


def arrive(spark, folder, events):
    spark.createDataFrame(events, MESSAGE_EVENT).coalesce(1).write.mode("append").parquet(folder)


def as_is(df):
    return df


def test_last_n_stream_over_restarts_and_redelivery(spark):
    base = run_dir(spark, "t_last_n")
    first = [event(i, "2", "a") for i in range(5)] + [event(5, "3", "a", mention=True), event(6, "2", "b", mention=True)]
    second = [event(5, "3", "a", mention=True), event(7, BOT, "a", mention=True), event(8, "2", "a", mention=True),
              event(0, "2", "a", mention=True), event(9, "2", "a", roles=("guest",), mention=True)]
    for part in (first, second, second):
        arrive(spark, f"{base}/in", part)
        s = jobs.read_stream(spark, f"{base}/in", MESSAGE_EVENT)
        jobs.last_n_stream(s, as_is, f"{base}/out", f"{base}/_ck", BOT, ROLE, SPECIAL, n=3)
    got = sorted((r["request_id"], r["line_no"], r["sender"], r["message"]) for r in spark.read.parquet(f"{base}/out").collect())
    # 7 is the bot's own, 9 is not logged, 0 comes again too late
    assert got == [(5, 0, "user-2", "says 3"), (5, 1, "user-2", "says 4"), (5, 2, "user-3", "says 5"), (6, 0, "user-2", "says 6"),
                   (8, 0, "user-3", "says 5"), (8, 1, "user-7", "says 7"), (8, 2, "user-2", "says 8")]


def test_interactions_answered_unanswered_and_twice(spark):
    base = run_dir(spark, "t_pairs")
    ask, own = event(1, "2", "a", mention=True), event(4, BOT, "a")
    parts = [[ask, event(2, "3", "b", mention=True), event(3, BOT, "c", mention=True)],
             [own, own, ask, event(5, BOT, "a"), event(30, BOT, "b")],
             [event(60 * 24, None, None, roles=())]]
    for part in parts:
        arrive(spark, f"{base}/in", part)
        s = jobs.read_stream(spark, f"{base}/in", MESSAGE_EVENT)
        jobs.interaction_stream(s, as_is, f"{base}/out", f"{base}/_ck", BOT, ROLE, SPECIAL, within="10 minutes")
    got = {(r["request_id"], r["channel"], r["answer_id"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {(1, "a", 4), (1, "a", 5), (2, "b", None)}
    assert spark.read.parquet(f"{base}/out").count() == 3


def test_mention_stream_ignores_own_and_repeated_requests(spark):
    base = run_dir(spark, "t_handler")
    parts = [[event(1, "2", "a", mention=True, content="hi <@7> and <@8>"), event(2, BOT, "a", mention=True)],
             [event(1, "2", "a", mention=True, content="hi <@7> and <@8>"), event(3, "3", "a")]]
    for part in parts:
        arrive(spark, f"{base}/in", part)
        s = jobs.read_stream(spark, f"{base}/in", MESSAGE_EVENT)
        jobs.mention_stream(s, as_is, base, f"{base}/_ck", BOT, ROLE, SPECIAL, "user-7")
    assert [(r["request_id"], r["content"]) for r in spark.read.parquet(f"{base}/requests").collect()] == [(1, "user-2: hi @bot and @8")]
    assert ids_of(spark, f"{base}/chat_history") == [1, 2, 3]


def test_own_messages_ask_nothing_in_batch(spark):
    df = spark.createDataFrame([event(1, "2", "a", mention=True), event(2, BOT, "a", mention=True)], MESSAGE_EVENT)
    logged = rt.logged_messages(rt.route(df, BOT, ROLE, SPECIAL))
    assert [r["request_id"] for r in rt.mention_requests(logged, BOT).collect()] == [1]


# ---- text and replies ----
def test_clean_content(spark):
    cases = [("hi <@7>!", [("7", "bot")], "hi @bot!"), ("<@!7><@8>", [("7", "<@8>"), ("8", "x")], "@<@8>@x"),
             ("<@9> stays", [("7", "bot")], "<@9> stays"), ("none", [], "none"), (None, [("7", "b")], None), ("<@7>", None, "<@7>"),
             ("<@7> twice <@7>", [("7", None), ("7", "bot")], "@bot twice @bot")]
    df = spark.createDataFrame([(i, t, m) for i, (t, m, _) in enumerate(cases)], "i int, t string, m array<struct<id:string,name:string>>")
    got = {r["i"]: r["c"] for r in df.select("i", tx.clean_content("t", "m").alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_messages_without_terms_are_replied_to(spark):
    h = spark.createDataFrame([(1, "ann", "a", "!!!"), (2, "bob", "a", "some words"), (3, "bob", "b", "?")],
                              "id long, sender string, channel string, message string")
    asked = spark.createDataFrame([("ann", "a"), ("bob", "b"), ("bob", "z")], "sender string, channel string")
    got = {(r["sender"], r["channel"]): r["piece"] for r in dg.user_summaries(h, asked).collect()}
    assert got == {("ann", "a"): "ann: !!!", ("bob", "b"): "bob: ?", ("bob", "z"): "No chat history found for user bob in channel z."}
    assert {r["channel"]: r["piece"] for r in dg.channel_summaries(h, 5).collect()} == {"a": "ann: !!!\nbob: some words", "b": "bob: ?"}


def test_primer_is_that_of_the_first_row(spark):
    users = spark.createDataFrame([(1, "ann", None), (2, "ann", "likes tea"), (3, "bob", "likes tea")], "id long, user_name string, primer string")
    asked = spark.createDataFrame([("r1", "ann", "tea?"), ("r2", "bob", "tea?"), ("r3", "bob", "cars?"), ("r4", "eve", "tea?")],
                                  "request_id string, user_name string, question string")
    assert sorted(r["request_id"] for r in pr.primer_check_prompts(asked, users).collect()) == ["r2", "r3"]
    assert {r["request_id"]: r["reply"] for r in dg.primer_check(asked, users).collect()} == {
        "r1": dg.NOT_USEFUL, "r2": "likes tea", "r3": dg.NOT_USEFUL, "r4": dg.NO_USER % "eve"}
