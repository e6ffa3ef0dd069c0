"""Sinks: user history text files (SNK-6) and the model embedding hook (U-1)."""

import glob
import os

import numpy as np
from pyspark.sql import functions as F

from chatlake.operators import history as hist
from chatlake.operators import ingest as ing
from chatlake.session import run_dir


def test_user_history_files(spark):
    rows = [(1, "a", "x", "m1"), (2, "b", "y", "n1"), (3, "a", "z", "m2"), (4, "a", "x", "m3"),
            (5, "b", "y", "n2")]
    h = spark.createDataFrame(rows, "id long, sender string, channel string, message string")
    path = run_dir(spark, "t_user_docs")
    hist.write_user_history(hist.user_history_lines(h), path)
    local = path.replace("file:", "")

    def doc(sender):
        files = sorted(glob.glob(os.path.join(local, f"sender={sender}", "part-*")))
        return "".join(open(f).read() for f in files)

    assert doc("a") == "--- x ---\na: m1\na: m3\n\n--- z ---\na: m2\n\n"
    assert doc("b") == "--- y ---\nb: n1\nb: n2\n\n"


def test_files_are_read_in_their_order(spark, tmp_path):
    """Part files by number, not by name, and blocks of a file in turn."""
    folder = tmp_path / "k=a"
    folder.mkdir()
    want = [f"line {i}" for i in range(400)] + ["", "last"]
    for number, lines in (("99999", want[:250]), ("100000", want[250:400]), ("100001", want[400:])):
        (folder / f"part-{number}-x.txt").write_text("".join(f"{x}\n" for x in lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = sorted(tuple(r) for r in hist.read_ordered(spark, str(tmp_path), "k").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [("a", i + 1, line) for i, line in enumerate(want)]


def test_model_embed_hook(spark):
    def load():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts])

    embed = ing.model_embed(load)
    df = spark.createDataFrame([("ab",), ("",), ("abcd",)], "message string")
    out = [r.v for r in df.select(embed(F.col("message")).alias("v")).collect()]
    assert out == [[2.0, 1.0], [0.0, 1.0], [4.0, 1.0]]
    prepared = ing.prepare(df.withColumn("message", F.lit("Hello, World")), embed=embed)
    r = prepared.first()
    assert r.message == "hello world" and r.vector == [11.0, 1.0]


def test_primer_text_files(spark):
    from chatlake.operators import digest as dg
    rows = [(1, "a", "x", "tennis tennis ohio"), (2, "b", "x", "chess"), (3, "a", "y", "ohio rain")]
    h = spark.createDataFrame(rows, "id long, sender string, channel string, message string")
    prim = dg.profile_text(dg.user_profiles(h, n_terms=2))
    got = {r.sender: r.primer for r in prim.collect()}
    assert got["a"].startswith("a: 2 messages in 2 channels (ids 1..3); distinctive terms: tennis")
    path = run_dir(spark, "t_primers")
    dg.write_primers(prim, path)
    assert spark.read.text(path).count() == 2


def test_primer_files_are_written_by_many_tasks(spark):
    """The files are few bytes and much work, so that adaptive execution must not put them in one task."""
    from chatlake.operators import digest as dg
    h = spark.range(200).selectExpr("id", "concat('u', id % 40) AS sender", "'x' AS channel", "'chess ohio' AS message")
    path = run_dir(spark, "t_primers")
    dg.write_primers(dg.profile_text(dg.user_profiles(h)), path)
    parts = spark.read.text(path).select("sender", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).alias("part"))
    assert parts.count() == 40 and parts.select("part").distinct().count() > 1


def test_audit_replay_adds_nothing_and_days_are_summed(spark):
    from chatlake.operators import audit
    rows = [("2024-01-01 10:00:00", "a b", "c", 3), ("2024-01-01 23:59:59", "d", "e", 2), ("2024-01-02 00:00:00", "f", None, 1)]
    df = spark.createDataFrame(rows, "t string, content string, response string, tokens_used long").select(
        F.col("t").cast("timestamp").alias("ts"), "content", "response", "tokens_used")
    path = run_dir(spark, "t_audit")
    for batch in ("1", "2", "2"):
        audit.append(df, path, batch)
    got = {str(r.day): (r.n_requests, r.tokens_used) for r in audit.daily(audit.read(spark, path)).collect()}
    assert got == {"2024-01-01": (4, 10), "2024-01-02": (2, 2)}


def test_build_primers_leaves_other_users_alone(spark):
    from chatlake.operators.primers import build_primers
    chat = spark.createDataFrame([(1, "a", "x", "tennis"), (2, "a", "y", "rain\nohio")],
                                 "id long, sender string, channel string, message string")
    users = spark.createDataFrame([(1, "a", None), (2, "b", "kept"), (3, "c", None)], "id long, user_name string, primer string")
    folder = run_dir(spark, "t_build")
    got = {r.id: r.primer for r in build_primers(chat, users, folder).collect()}
    assert got[1].startswith("a: 2 messages in 2 channels") and got[2] == "kept" and got[3] is None
    asked = spark.read.parquet(f"{folder}/requests").collect()
    assert len(asked) == 1 and "=== x ===\ntennis\n=== y ===\nrain\nohio" in asked[0].prompt
    lines = [r.line for r in hist.read_lines(spark, f"{folder}/history", "sender").collect()]
    assert sorted(lines) == sorted(["--- x ---", "a: tennis", "", "--- y ---", "a: rain", "ohio", ""])


def test_string_keys_with_one_prefix_are_spread(spark):
    from chatlake.operators import ids
    df = spark.range(2000).select(F.format_string("customer#%09d", "id").alias("k"), F.col("id").alias("n"))
    b = ids.bucketed(df, "k", buckets=8)
    sizes = [r["count"] for r in b.groupBy("_cl_bucket").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 1000
    out = ids.dense_ids(df, ["k"], buckets=8)
    assert out.where("id <> n").count() == 0
    empty = ids.dense_ids(df.where("n < 0"), ["k"], buckets=8)
    assert empty.count() == 0


def test_reembed_covers_every_event_of_the_store(spark, sf_small):
    from chatlake.operators import store
    from chatlake.plans import catalog
    from chatlake.sources import views
    n = views.chat_event(spark, sf_small).count()
    assert catalog.QUERIES["reembed_store"](spark, sf_small).select("id").distinct().count() == n
    assert views.chat_vec(spark, sf_small).count() == n
    msgs = views.chat_event(spark, sf_small).limit(50).withColumnRenamed("id", "source_id")
    path = run_dir(spark, "t_reembed")
    store.add(msgs, f"{path}/old", "first", embed=lambda m: F.array(F.lit(0.5).cast("float")))
    new = store.reembed(spark, f"{path}/old", f"{path}/new")
    assert new.columns == spark.read.parquet(f"{path}/old").columns
    assert new.count() == new.where(F.size("vector") == 64).count() == 50
    want = ing.prepare(new.select("id", "message"))
    assert new.join(want.select("id", F.col("vector").alias("v"), F.col("norm").alias("n")), "id")\
        .where((F.col("v") != F.col("vector")) | (F.col("n") != F.col("norm"))).count() == 0
    more = msgs.withColumn("source_id", F.col("source_id") + 10**6)
    assert store.add(more, f"{path}/new", "second").agg(F.min("id")).first()[0] == 50
