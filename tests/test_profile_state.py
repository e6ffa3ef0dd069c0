"""Primers kept by batch equal a full rebuild; files that do not change stay."""

import glob
import os

from chatlake.operators import digest, profile_state

SCHEMA = "id long, sender string, channel string, message string"


def _files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/primers/sender=*/part-*")}


def _full(rows):
    return {r.sender: r.primer for r in digest.profile_text(digest.user_profiles(rows)).collect()}


def _kept(spark, folder):
    from chatlake.operators.history import read_lines
    return {r.sender: r.line for r in read_lines(spark, f"{folder}/primers", "sender").collect()}


def test_batches_equal_a_full_rebuild_and_leave_other_files(spark, tmp_path):
    folder = str(tmp_path)
    first = [(1, "ann", "a", "alpha beta"), (2, "ann", "b", "alpha"), (3, "bob", "a", "gamma"), (4, "7", "a", None), (5, "cy", "a", "!?")]
    second = [(6, "bob", "b", "delta delta gamma"), (7, "dee", "a", "beta"), (8, "bob", "a", "")]
    one, two = (spark.createDataFrame(x, SCHEMA) for x in (first, second))
    assert {r.sender for r in profile_state.update_primers(one, folder, "b1").collect()} == {"ann", "bob", "7", "cy"}
    assert _kept(spark, folder) == _full(one)
    before = _files(folder)
    changed = {r.sender for r in profile_state.update_primers(two, folder, "b2").collect()}
    both = _full(one.unionByName(two))
    assert _kept(spark, folder) == both
    assert changed == {s for s, p in both.items() if _full(one).get(s) != p}
    after = _files(folder)
    assert "ann" not in changed and {f: t for f, t in before.items() if "sender=ann/" in f}.items() <= after.items()
    # a replay replaces its own sums and writes no file
    assert profile_state.update_primers(two, folder, "b2").count() == 0
    assert _files(folder) == after and _kept(spark, folder) == both


def test_empty_batches_and_unnamed_senders(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(1, None, "a", "alpha"), (2, "ann", None, "alpha beta")], SCHEMA)
    assert [r.sender for r in profile_state.update_primers(rows, folder, "b1").collect()] == ["ann"]
    assert profile_state.update_primers(rows.limit(0), folder, "b2").count() == 0
    assert list(_kept(spark, folder)) == ["ann"]
