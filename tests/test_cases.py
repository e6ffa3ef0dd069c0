"""Hand-made cases with known answers (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlake.operators import chunks as ch
from chatlake.operators import history as hist
from chatlake.operators import registry as reg
from chatlake.operators import routing as rt
from chatlake.operators import search as srch
from chatlake.operators import transcripts as trs
from chatlake.functions import text as tx
from chatlake import schemas

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def _history(spark):
    rows = [
        (1, "general", "alice", "i play tennis", [1.0, 0.0]),
        (2, "general", "bob", "nice", [0.0, 1.0]),
        (3, "off", "alice", "tennis script", [1.0, 0.0]),
        (4, "general", "bot", "tennis is good", [1.0, 0.0]),
        (5, "general", "carol", "@bot tennis?", [1.0, 0.0]),
        (6, "random", "dan", "tennis again", [3.0, 4.0]),
        (7, "general", "bot", "noted", [0.0, 1.0]),
        (8, "general", "alice", "tennis bye", [1.0, 0.0]),
        (9, "general", "eve", "zero", [0.0, 0.0]),
    ]
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=i), s, c, m, v) for i, c, s, m, v in rows],
        "id long, ts timestamp, sender string, channel string, message string, vector array<float>")


def test_vector_search_hits_and_context(spark):
    h = _history(spark)
    hits = srch.vector_search(h, [1.0, 0.0], bot_name="bot", mention="@bot", exclude_channels=["off"])
    got = [(r.hit_rank, r.id, r.similarity) for r in hits.orderBy("hit_rank").collect()]
    assert got == [(1, 1, 1.0), (2, 8, 1.0), (3, 6, 0.6)]
    ctx = srch.search_context(h, hits)
    by_hit = {}
    for r in ctx.collect():
        by_hit.setdefault(r.hit_id, set()).add(r.id)
    assert by_hit == {1: {1, 2}, 8: {7, 8, 9}, 6: {6}}
    strict = srch.vector_search(h, [1.0, 0.0], threshold=0.6, bot_name="bot", mention="@bot",
                                exclude_channels=["off"])
    assert sorted(r.id for r in strict.collect()) == [1, 8]


def test_vector_search_batch_equals_single(spark):
    h = _history(spark)
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "qid long, vector array<double>")
    batch = srch.vector_search_batch(h, q, bot_name="bot", mention="@bot", exclude_channels=["off"])
    for qid, vec in [(0, [1.0, 0.0]), (1, [0.0, 1.0])]:
        single = srch.vector_search(h, vec, bot_name="bot", mention="@bot", exclude_channels=["off"])
        a = sorted((r.hit_rank, r.id, r.similarity) for r in single.collect())
        b = sorted((r.hit_rank, r.id, r.similarity) for r in batch.where(F.col("qid") == qid).collect())
        assert a == b


def test_vector_search_batch_blocks(spark):
    h = _history(spark)
    q = spark.createDataFrame([(i, [1.0, float(i) / 10]) for i in range(7)], "qid long, vector array<double>")
    one = srch.vector_search_batch(h, q, k=3)
    blocked = srch.vector_search_batch(h, q, k=3, shard_rows=2)
    key = lambda df: sorted((r.qid, r.hit_rank, r.id) for r in df.collect())
    assert key(one) == key(blocked)


@pytest.mark.parametrize("text,pieces", [
    ("a b", ["a b"]), ("a b c", ["a ", "b c"]), ("aa bb ccc", ["aa b", "b ccc"]), ("", [""])])
def test_bisect_cases(spark, text, pieces):
    assert [p for _, p in ch.bisect_text(text, 2)] == pieces
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.piece for r in ch.bisect_chunks(df, ["doc_id"], "text", 2).orderBy("path").collect()]
    assert got == pieces


@pytest.mark.parametrize("text,chunks", [
    ("a b\nc\nd e", {0: "a b\nc", 1: "d e"}),
    ("a b c d\ne", {1: "a b c d", 2: "e"}),
    ("", {0: ""}),
])
def test_pack_cases(spark, text, chunks):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.chunk_no: r.chunk for r in ch.pack_lines(df, ["doc_id"], "text", 3).collect()}
    assert got == chunks


@pytest.mark.parametrize("n,count", [(0, 1), (2000, 1), (2001, 2), (4000, 2)])
def test_piece_counts(spark, n, count):
    df = spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")
    rows = ch.reply_pieces(df, ["doc_id"], "text").collect()
    assert len(rows) == count
    assert "".join(r.piece for r in sorted(rows, key=lambda r: r.pos)) == "x" * n


def test_transcript_parse(spark):
    text = "bot: hi\nann: a: b\n ann :  x \nno colon"
    df = spark.createDataFrame([("c", text)], "channel string, transcript string")
    got = [(r.role, r.content) for r in trs.parse_transcript(df, "bot").orderBy("line_no").collect()]
    assert got == [("ai", "hi"), ("human", "ann: a: b"), ("human", "ann: x")]


def test_last_n(spark):
    h = spark.createDataFrame([(i, "c", "u", f"m{i}") for i in range(1, 6)],
                              "id long, channel string, sender string, message string")
    assert [r.id for r in hist.recent_chats_desc(h, "c", 2).collect()] == [5, 4]
    assert hist.recent_chats(h, "c", 2).first().transcript == "u: m4\nu: m5"
    assert hist.recent_chats_desc(h, "c", 0).count() == 0
    for bad in ("2", -1):
        with pytest.raises(ValueError):
            hist.recent_chats(h, "c", bad)


@pytest.mark.parametrize("text,user", [
    ("!check ann why", "why"), ("ann why", "ann"), ("!check", "!check"), ("!check ann", None), ("", None)])
def test_command_parse(spark, text, user):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.parse_command_user("t").alias("u")).first().u == user


def _event(spark, rows):
    data = []
    for i, (author_id, name, roles, kind, content, n_att) in enumerate(rows):
        data.append((i, T0, (author_id, name, roles), (1, "general" if kind != "dm" else "x", kind),
                     [], ["f.png"] * n_att, content))
    return spark.createDataFrame(data, schemas.MESSAGE_EVENT)


ROUTING = [
    ("0", "bot", [], "text", "hello", 0),
    ("1", "ann", ["R"], "text", "!sum 3", 0),
    ("2", "Zed", ["R"], "text", "hi", 0),
    ("1", "ann", ["R"], "text", "hi", 0),
    ("1", "ann", ["R", "R"], "text", "hi", 0),
    ("1", "ann", ["R"], "text", "pic", 1),
    ("1", "ann", [], "text", "hi", 0),
    ("1", "ann", [], "dm", "hi", 0),
]


def test_routing_live(spark):
    out = rt.route(_event(spark, ROUTING), "0", "R", "zed", "live").orderBy("message_id").collect()
    assert [r.route for r in out] == ["self", "command", "canned", "log", "log", "attachment", "drop", "log"]
    assert [r.logged for r in out] == [True, False, False, True, True, False, False, True]
    assert out[-1].channel_name == "DM"


def test_routing_backfill(spark):
    out = rt.route(_event(spark, ROUTING), "0", "R", "zed", "backfill").orderBy("message_id").collect()
    assert [r.message_id for r in out if r.logged] == [1, 2, 3, 4, 5]


def test_insert_if_absent(spark):
    existing = spark.createDataFrame([("1", "ann")], "user_id string, user_name string")
    arriving = spark.createDataFrame([("1", "annie", 1), ("2", "bob", 2), ("2", "rob", 3)],
                                     "user_id string, user_name string, seq int")
    once = reg.upsert(existing, arriving, "user_id", ["user_name"], ["seq"])
    assert sorted(tuple(r) for r in once.collect()) == [("1", "ann"), ("2", "bob")]
    twice = reg.upsert(once, arriving, "user_id", ["user_name"], ["seq"])
    assert sorted(tuple(r) for r in twice.collect()) == [("1", "ann"), ("2", "bob")]


def test_update_by_name(spark):
    users = spark.createDataFrame([(1, "sam", None), (2, "sam", "old"), (3, "kim", "k")],
                                  "id long, user_name string, primer string")
    upd = spark.createDataFrame([("sam", "new")], "user_name string, primer string")
    got = sorted((r.id, r.primer) for r in reg.update_by_name(users, upd).collect())
    assert got == [(1, "new"), (2, "new"), (3, "k")]


def test_high_water_mark(spark):
    ev = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(seconds=1))], "message_id long, event_ts timestamp")
    empty = spark.createDataFrame([], "message_id long, ts timestamp")
    assert rt.after_mark(ev, empty).count() == 0
    store = spark.createDataFrame([(1, T0)], "message_id long, ts timestamp")
    assert [r.message_id for r in rt.after_mark(ev, store).collect()] == [2]


def test_mention_requests_last_n(spark):
    rows = [(i, "u", "c" if i % 3 else "d", f"m{i}", [("9", "bot")] if i in (7, 12) else [])
            for i in range(1, 16)]
    h = spark.createDataFrame(rows, "message_id long, sender string, channel string, message string, "
                                    "mentions array<struct<id:string,name:string>>")
    got = {r.request_id: r.transcript for r in rt.mention_requests(h, "9", n=3).collect()}
    assert got == {7: "u: m4\nu: m5\nu: m7", 12: "u: m6\nu: m9\nu: m12"}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_dense_ids_tiny_inputs(spark, n):
    from chatlake.operators.ids import dense_ids, group_positions
    df = spark.createDataFrame([(i, "c") for i in range(n)], "k long, g string")
    assert sorted(r.id for r in dense_ids(df, ["k"], start=5).collect()) == list(range(5, 5 + n))
    assert sorted(r.pos for r in group_positions(df, "g", "k").collect()) == list(range(1, n + 1))


def test_dense_ids_hot_timestamp_is_split(spark):
    """A third of the rows share one timestamp: ids stay exact and no bucket
    holds the hot value's rows alone."""
    from pyspark.sql import Window
    from chatlake.operators import ids
    n = 3000
    rows = [(i, T0 if i % 3 == 0 else T0 + dt.timedelta(seconds=i)) for i in range(n)]
    df = spark.createDataFrame(rows, "source_id long, ts timestamp")
    got = ids.dense_ids(df, ["ts", "source_id"], buckets=8)
    want = df.withColumn("id", F.row_number().over(Window.orderBy("ts", "source_id")) - 1)
    assert sorted(tuple(r) for r in got.select("source_id", "id").collect()) == \
        sorted(tuple(r) for r in want.select("source_id", "id").collect())
    b = ids.bucketed(df, "ts", 8, tie_col="source_id")
    sizes = [r["count"] for r in b.groupBy("_cl_bucket").count().collect()]
    assert max(sizes) < n / 3


def test_group_positions_split_a_hot_channel(spark):
    """One channel holds a third of all rows: positions are exact and no
    (channel, bucket) window holds more than a few buckets' share."""
    from pyspark.sql import Window
    from chatlake.operators import ids
    n = 6000
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 50}") for i in range(n)]
    df = spark.createDataFrame(rows, "message_id long, channel string")
    got = ids.group_positions(df, "channel", "message_id", "pos", buckets=16)
    want = df.withColumn("pos", F.row_number().over(
        Window.partitionBy("channel").orderBy("message_id")))
    assert sorted(tuple(r) for r in got.select("message_id", "pos").collect()) == \
        sorted(tuple(r) for r in want.select("message_id", "pos").collect())
    b = ids.bucketed(df, "message_id", 16)
    biggest = b.groupBy("channel", "_cl_bucket").count().agg(F.max("count")).first()[0]
    assert biggest <= 2 * (n / 3) / 16


def test_store_open_and_create(spark):
    """SRC-1: a missing store raises; SRC-2..4: CREATE TABLE IF NOT EXISTS is idempotent."""
    from pyspark.errors import AnalysisException
    from chatlake.session import run_dir
    from chatlake.sources.tables import create_tables, open_store
    with pytest.raises(AnalysisException):
        open_store(spark, run_dir(spark, "missing"), "chat_history").collect()
    import uuid
    db = f"t_{uuid.uuid4().hex[:8]}"
    loc = run_dir(spark, db)
    spark.sql(f"CREATE DATABASE {db} LOCATION '{loc}'")
    prev = spark.catalog.currentDatabase()
    try:
        spark.catalog.setCurrentDatabase(db)
        assert create_tables(spark, loc) == create_tables(spark, loc)
        assert spark.table("chat_history").columns[:6] == ["id", "ts", "sender", "channel",
                                                          "message", "vector"]
        assert spark.table("user_info").count() == 0
    finally:
        spark.catalog.setCurrentDatabase(prev)


def test_empty_store_has_no_mark(spark):
    empty = spark.createDataFrame([], "id long, ts timestamp")
    assert hist.high_water_mark(empty).first().hwm is None


def test_route_rejects_unknown_mode(spark):
    with pytest.raises(ValueError):
        rt.route(_event(spark, ROUTING[:1]), "0", "R", "zed", "replay")


def test_dense_ids_on_string_keys(spark):
    """Bucketing on a string key keeps the string order (multi-byte text too)."""
    from pyspark.sql import Window
    from chatlake.operators import ids
    words = ["a", "ab", "abc", "é", "éa", "z", "日本", "日本語", "Zed", "", "ß", "aé"] * 20
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "k string, i long")
    got = ids.dense_ids(df, ["k", "i"], buckets=6)
    want = df.withColumn("id", F.row_number().over(Window.orderBy("k", "i")) - 1)
    assert sorted(tuple(r) for r in got.select("i", "id").collect()) == \
        sorted(tuple(r) for r in want.select("i", "id").collect())


def test_batch_search_ties_break_by_id(spark):
    """Many equal scores across partitions: the k winners are the smallest ids."""
    rows = [(i, T0, "u", "c", "m", [1.0, 0.0] if i % 2 == 0 else [0.6, 0.8]) for i in range(60)]
    h = spark.createDataFrame(rows, "id long, ts timestamp, sender string, channel string, "
                                    "message string, vector array<float>").repartition(4)
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "qid long, vector array<double>")
    got = srch.vector_search_batch(h, q, k=5, threshold=-1.0)
    by_q = {}
    for r in got.collect():
        by_q.setdefault(r.qid, []).append((r.hit_rank, r.id))
    assert [i for _, i in sorted(by_q[0])] == [0, 2, 4, 6, 8]
    assert [i for _, i in sorted(by_q[1])] == [1, 3, 5, 7, 9]
    single = srch.vector_search(h, [1.0, 0.0], k=5, threshold=-1.0)
    assert sorted(r.id for r in single.collect()) == [0, 2, 4, 6, 8]


def test_normalize_keeps_mentions_whole(spark):
    df = spark.createDataFrame([("Hey @My.Bot, what's UP?!",)], "m string")
    assert df.select(tx.normalize("m").alias("n")).first().n == "hey @my.bot what's up"


def test_vector_codec_roundtrip(spark):
    from chatlake.functions import vectors as vx
    vals = [1e-5, -0.1, 3.4028235e38, 0.0, -2.5e-7, 0.123456789]
    df = spark.createDataFrame([(vals,)], "v array<float>")
    back = df.select(vx.from_text(vx.to_text("v")).alias("b"), "v").first()
    assert [float(x) for x in back.b] == pytest.approx([float(x) for x in back.v], rel=1e-7)
    same = df.select(F.aggregate(F.zip_with("v", vx.from_text(vx.to_text("v")),
                                            lambda a, b: a == b.cast("float")),
                                 F.lit(True), lambda acc, x: acc & x).alias("ok")).first().ok
    assert same


def test_pieces_count_code_points(spark):
    text = "😀" * 2500 + "é"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(ch.reply_pieces(df, ["doc_id"], "text").collect(), key=lambda r: r.pos)
    assert [len(r.piece) for r in rows] == [2000, 501]
    assert [r.piece for r in rows] == [text[:2000], text[2000:]]


def test_transcripts_both_orders(spark):
    h = spark.createDataFrame([(i, "c", "u", f"m{i}") for i in range(1, 6)],
                              "id long, channel string, sender string, message string")
    old = hist.channel_transcripts(h, 3).first().transcript
    new = hist.channel_transcripts(h, 3, newest_first=True).first().transcript
    assert old == "u: m3\nu: m4\nu: m5" and new == "u: m5\nu: m4\nu: m3"


def test_mentions_are_read_once(spark):
    from chatlake.operators import registry as reg
    m = spark.createDataFrame([(1, "<@1> <@2>"), (2, "no one"), (3, "<@9><@2>!"), (4, None)], "message_id long, content string")
    u = spark.createDataFrame([("1", "<@2>"), ("2", "bob"), ("2", "zed")], "user_id string, user_name string")
    got = {r[0]: r[1] for r in reg.resolve_mentions(m, u).collect()}
    assert (got[1], got[2], got[3]) == ("@<@2> @bob", "no one", "<@9>@bob!")


@pytest.mark.parametrize("statement", ["WITH x AS (SELECT 1 AS a) INSERT INTO tgt SELECT a FROM x", "CREATE TABLE t (a INT)",
                                       "DROP VIEW chat_history", "SET x = 1", "", "  "])
def test_sql_is_read_only(spark, statement):
    from chatlake.plans.history_queries import run_sql
    with pytest.raises(ValueError):
        run_sql(spark, statement)


def test_strip_is_linear(spark):
    import time
    from chatlake.functions import text as tx
    t = "a" + " " * 200_000 + "b \n"
    began = time.time()
    assert spark.createDataFrame([(t,)], "t string").select(tx.strip("t")).first()[0] == t[:-2]
    assert time.time() - began < 10


def test_draws_of_equal_lines_go_by_place(spark, tmp_path):
    from chatlake.plans.history_queries import sample_line
    spark.createDataFrame([(i, "x\nx\nx\ny") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    drawn = [sample_line(spark, str(tmp_path), str(s)).first() for s in range(24)]
    assert {r["n_lines"] for r in drawn} == {200} and sum(r["line"] == "x" for r in drawn) > 12


def test_packing_many_chunks_is_linear(spark):
    import time
    text = "\n".join(["a b c"] * 80_000)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    rows = ch.pack_lines(df, ["doc_id"], "text", 3).collect()
    assert len(rows) == 80_000 and {r["n_tokens"] for r in rows} == {3}
    assert time.time() - began < 20
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["chunk"]) for r in ch.pack_lines(nulls, ["doc_id"], "text").collect()] == [(2, "")]
