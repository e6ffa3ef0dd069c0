"""Stream = batch: the same events in one or several micro-batches give the
batch answer, and a restart from the checkpoint adds nothing (SURVEY 5.4)."""

import datetime as dt
import tempfile
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlake.operators import routing as rt
from chatlake.operators import store
from chatlake.session import run_dir
from chatlake.sources.tables import open_store, read_table
from chatlake.sources.views import BOT_ID, BOT_NAME, MEMBER_ROLE, SPECIAL_NAME, events_to_messages
from chatlake.streaming import jobs

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def split_events(spark):
    """The sf0.001 events as 4 files in time order (test input only)."""
    ev = read_table(spark, SF, "events")
    bounds = ev.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    d = tempfile.mkdtemp(prefix="chatlake-stream-src-")
    edges = [-1] + bounds + [10 ** 12]
    for i in range(4):
        part = ev.where((F.col("event_id") > edges[i]) & (F.col("event_id") <= edges[i + 1]))
        part.coalesce(1).write.parquet(f"{d}/tmp{i}")
        f = [p for p in spark.sparkContext._jvm.java.io.File(f"{d}/tmp{i}").list() if p.endswith(".parquet")][0]
        import shutil
        shutil.copy(f"{d}/tmp{i}/{f}", f"{d}/events_{i}.parquet")
        time.sleep(1.1)
    return d, ev.schema


def _batch_ingest_ids(spark):
    routed = rt.route(events_to_messages(read_table(spark, SF, "events")), BOT_ID, MEMBER_ROLE,
                      SPECIAL_NAME, "live")
    logged = rt.logged_messages(routed)
    w = Window.orderBy("ts", "message_id")
    return sorted((r.id, r.message_id) for r in
                  logged.select((F.row_number().over(w) - 1).alias("id"), "message_id").collect())


@pytest.mark.parametrize("files_per_trigger", [1, 4])
def test_stream_ingest_equals_batch(spark, split_events, files_per_trigger):
    src, schema = split_events
    base = run_dir(spark, "t_stream_ingest")
    table, ckpt = f"{base}/chat_history", f"{base}/_checkpoint"

    def run():
        s = jobs.read_stream(spark, f"{src}/events*.parquet", schema, files_per_trigger)
        jobs.ingest_stream(s, events_to_messages, table, ckpt, BOT_ID, MEMBER_ROLE, SPECIAL_NAME)

    run()
    got = sorted((r.id, r.source_id) for r in spark.read.parquet(table).collect())
    assert got == _batch_ingest_ids(spark)
    run()   # restart from the checkpoint: nothing new
    assert spark.read.parquet(table).count() == len(got)


def test_first_seen_stream_equals_batch(spark, split_events):
    src, schema = split_events
    base = run_dir(spark, "t_first_seen")
    s = jobs.read_stream(spark, f"{src}/events*.parquet", schema, 1)
    jobs.first_seen_stream(s, events_to_messages, f"{base}/users", f"{base}/_checkpoint")
    got = sorted((r.user_id, r.user_name) for r in spark.read.parquet(f"{base}/users").collect())
    ev = read_table(spark, SF, "events")
    want = sorted((str(r.user_id), f"user-{r.user_id}") for r in ev.select("user_id").distinct().collect())
    assert got == want


def test_users_are_full_rows_with_dense_ids(spark, split_events):
    src, schema = split_events
    base = run_dir(spark, "t_user_rows")
    s = jobs.read_stream(spark, f"{src}/events*.parquet", schema, 1)
    jobs.first_seen_stream(s, events_to_messages, f"{base}/user_info", f"{base}/_checkpoint")
    rows = open_store(spark, f"{base}/user_info", "user_info").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows))) and len(rows) > 1
    assert len({r.user_id for r in rows}) == len(rows)


def test_batch_then_stream_share_one_store(spark, split_events):
    src, schema = split_events
    base = run_dir(spark, "t_mixed")
    table = f"{base}/chat_history"
    old = spark.createDataFrame([(T0 + dt.timedelta(minutes=i), -9 + i, "user-2", "view", f"old {i}") for i in range(5)],
                                "ts timestamp, source_id long, sender string, channel string, message string")
    for _ in range(2):      # a finished batch is not written again
        assert store.add(old, table, "import").count() == 5
    s = jobs.read_stream(spark, f"{src}/events*.parquet", schema, 1)
    jobs.ingest_stream(s, events_to_messages, table, f"{base}/_checkpoint", BOT_ID, MEMBER_ROLE, SPECIAL_NAME)
    got = open_store(spark, table, "chat_history").select("id").collect()
    want = _batch_ingest_ids(spark)
    assert sorted(r.id for r in got) == list(range(5 + len(want)))
    rows = spark.read.parquet(table)
    assert sorted((r.id - 5, r.source_id) for r in rows.where("id >= 5").collect()) == want
    assert rows.where("ingest_ts IS NULL").count() == 0 and "id_block" in rows.columns


def test_mention_stream_equals_batch_and_replays(spark, split_events):
    src, schema = split_events
    base = run_dir(spark, "t_mentions")

    def run(checkpoint):
        s = jobs.read_stream(spark, f"{src}/events*.parquet", schema, 2)
        jobs.mention_stream(s, events_to_messages, base, checkpoint, BOT_ID, MEMBER_ROLE, SPECIAL_NAME, BOT_NAME, n=3)
        return sorted((r.request_id, r.line_no, r.role, r.content) for r in spark.read.parquet(f"{base}/requests").collect())

    got = run(f"{base}/_checkpoint")
    counts = [spark.read.parquet(f"{base}/{t}").count() for t in ("user_info", "chat_history")]
    routed = rt.route(events_to_messages(read_table(spark, SF, "events")), BOT_ID, MEMBER_ROLE, SPECIAL_NAME, "live")
    w = Window.partitionBy("channel").orderBy("ts", "message_id")
    lines = {}
    for r in rt.logged_messages(routed).withColumn("pos", F.row_number().over(w)).collect():
        lines[r.channel, r.pos] = r
    asks = [(c, p, r) for (c, p), r in lines.items() if any(m.id == BOT_ID for m in r.mentions)]
    want = [(r.message_id, i, lines[c, q].sender == BOT_NAME) for c, p, r in asks for i, q in enumerate(range(max(1, p - 2), p + 1))]
    assert [(a, b, role == "ai") for a, b, role, _ in got] == sorted(want)
    # all batches once more, as after a lost checkpoint: nothing is added
    assert run(f"{base}/_again") == got
    assert counts == [spark.read.parquet(f"{base}/{t}").count() for t in ("user_info", "chat_history")]


def test_activity_stream_holds_last_window(spark, split_events):
    src, schema = split_events
    base = run_dir(spark, "t_activity")
    s = jobs.read_stream(spark, f"{src}/events*.parquet", schema, 1)
    jobs.activity_stream(s, "ts", "event_type", f"{base}/out", f"{base}/_checkpoint")
    out = spark.read.parquet(f"{base}/out")
    ev = read_table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    max_ts = ev.agg(F.max("ts")).first()[0]
    assert out.agg(F.max("window_end")).first()[0] <= max_ts
    day = ev.groupBy(F.window("ts", "1 day").end.alias("e"), "event_type").count()
    want = {(r.e, r.event_type): r["count"] for r in day.collect()}
    for r in out.collect():
        assert want[(r.window_end, r.channel)] == r.n_messages


def test_quarantine_keeps_batch_going(spark):
    src = tempfile.mkdtemp(prefix="chatlake-stream-bad-")
    rows = [(1, dt.datetime(2024, 1, 1, 10), 2, "view", 10.0, "hello"),
            (2, dt.datetime(2024, 1, 1, 11), 2, "view", 10.0, None),
            (None, dt.datetime(2024, 1, 1, 12), 4, "view", 10.0, "x")]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/events_0")
    base = run_dir(spark, "t_quarantine")
    s = jobs.read_stream(spark, f"{src}/events_0/*.parquet", spark.createDataFrame([], schema).schema)
    jobs.ingest_stream(s, events_to_messages, f"{base}/h", f"{base}/_ck", BOT_ID, MEMBER_ROLE, SPECIAL_NAME)
    assert [r.source_id for r in spark.read.parquet(f"{base}/h").collect()] == [1]
    assert spark.read.parquet(f"{base}/h_quarantine").count() == 2


def test_a_micro_batch_is_computed_once_before_it_is_numbered(spark, monkeypatch):
    """Numbering and positions pass over their rows several times: they get stored
    rows, not the joins and aggregates that lead to them."""
    plans = []

    def noted(fn):
        def run(df, *args, **how):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return fn(df, *args, **how)
        return run

    monkeypatch.setattr(jobs, "dense_ids", noted(jobs.dense_ids))
    monkeypatch.setattr(store, "dense_ids", noted(store.dense_ids))
    monkeypatch.setattr(rt, "mention_requests", noted(rt.mention_requests))
    base = run_dir(spark, "t_once")
    events = read_table(spark, SF, "events")
    events.limit(300).write.parquet(f"{base}/arrived")
    jobs.mention_stream(jobs.read_stream(spark, f"{base}/arrived", events.schema), events_to_messages, base,
                        f"{base}/_checkpoint", BOT_ID, MEMBER_ROLE, SPECIAL_NAME, BOT_NAME)
    assert len(plans) == 3 and not [p for p in plans if "Aggregate" in p or "Join" in p]
