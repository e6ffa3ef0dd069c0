"""Text files by key: Spark's layout without its cost a key."""

import glob
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from chatlake.operators import history as hist
from chatlake.session import run_dir

KEYS = ["a", None, "", "x/y", "a=b", "50%", "q\"s'", "t\tab", "sp ace ", "[z]{", "^", "~}", "back\\s", "c:d", "st*r",
        "ha#h", "q?", "\x7f", ".", "é", "日本", "😀"]


def _tree(path):
    local = path.replace("file:", "")
    return {os.path.basename(d): "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{d}/part-*")))
            for d in glob.glob(f"{local}/*=*")}


def _rows(spark):
    rows = [(k, i, f"line {i}") for i, k in enumerate(KEYS)]
    rows += [("a", 100, None), ("a", 101, ""), ("a", 102, "two\nlines"), ("a", 103, "cr\r"), (None, 104, "last")]
    return spark.createDataFrame(rows, "sender string, seq long, line string").repartition(5)


def test_folders_and_lines_are_those_of_partition_by(spark):
    rows = _rows(spark)
    ours, theirs = run_dir(spark, "t_keyed"), run_dir(spark, "t_keyed")
    hist.write_lines(rows, ours, "sender", ["seq"])
    (rows.repartitionByRange(3, "sender", "seq").sortWithinPartitions("sender", "seq").select("sender", "line")
     .write.partitionBy("sender").text(theirs))
    assert _tree(ours) == _tree(theirs) and len(_tree(ours)) == len(KEYS) - 1
    got = sorted(map(str, hist.read_lines(spark, ours, "sender").collect()))
    assert got == sorted(map(str, hist.read_lines(spark, theirs, "sender").collect()))


def test_a_key_of_many_rows_is_split_over_tasks_in_order(spark):
    rows = spark.range(40000).select(F.when(F.col("id") < 39000, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("sender"),
                                     F.col("id").alias("seq"), F.col("id").cast("string").alias("line"))
    path = run_dir(spark, "t_keyed")
    hist.write_lines(rows.repartition(3), path, "sender", ["seq"])
    assert len(glob.glob(f"{path.replace('file:', '')}/sender=hot/part-*")) > 1
    assert _tree(path)["sender=hot"] == "".join(f"{i}\n" for i in range(39000))
    assert hist.read_lines(spark, path, "sender").count() == 40000


def test_a_key_costs_its_folder_and_its_file(spark):
    """On a local folder every file that Spark's writer makes, checksum files too, starts a chmod."""
    path = run_dir(spark, "t_keyed")
    rows = spark.range(200).select(F.format_string("u%d", "id").alias("sender"), F.col("id").alias("seq"), F.lit("x").alias("line"))
    hist.write_lines(rows, path, "sender", ["seq"])
    made = [os.listdir(d) for d in glob.glob(f"{path.replace('file:', '')}/sender=*")]
    assert len(made) == 200 and all(len(files) == 1 and files[0].startswith("part-") for files in made)


def test_folders_are_listed_by_few_tasks(spark):
    path = run_dir(spark, "t_keyed")
    rows = spark.range(200).select(F.format_string("u%d", "id").alias("sender"), F.col("id").alias("seq"), F.lit("x").alias("line"))
    hist.write_lines(rows, path, "sender", ["seq"])
    sc, conf = spark.sparkContext, spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    sc.setJobGroup("t_listing", "listing")
    try:
        lines = hist.read_lines(spark, path, "sender")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("t_listing") for s in told.getJobInfo(j).stageIds]
    assert sum(s.numTasks for s in stages if s) <= 4 * 8
    assert lines.count() == 200
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == conf


def test_an_old_folder_stays_and_a_failed_write_leaves_none(spark):
    path = run_dir(spark, "t_keyed")
    rows = _rows(spark)
    hist.write_lines(rows, path, "sender", ["seq"])
    before = _tree(path)
    with pytest.raises(AnalysisException):
        hist.write_lines(rows.withColumn("line", F.lit("other")), path, "sender", ["seq"])
    assert _tree(path) == before
    broken = rows.withColumn("line", F.when(F.col("seq") == 101, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    path = run_dir(spark, "t_keyed_broken")
    with pytest.raises(Exception):
        hist.write_lines(broken, path, "sender", ["seq"])
    local = path.replace("file:", "")
    assert not os.path.exists(local) and not glob.glob(f"{os.path.dirname(local)}/_{os.path.basename(local)}*")


def test_no_rows_make_an_empty_folder(spark):
    path = run_dir(spark, "t_keyed")
    hist.write_lines(_rows(spark).where("seq < 0"), path, "sender", ["seq"])
    assert hist.read_lines(spark, path, "sender").count() == 0


@pytest.mark.parametrize("small", [0, 20, 1 << 20])
def test_files_that_tasks_read_have_the_lines_that_spark_reads(spark, small):
    from chatlake.operators import keyed_files as kf
    rows = _rows(spark).unionByName(spark.createDataFrame(
        [("bom", 1, "﻿x"), ("ends", 1, "a\rb\r\nc\x0b\x0c\x1c\x85 d"), ("}", 1, "y" * 30), ("}", 2, ""),
         ("%41", 1, "z"), ("bytes", 1, "x")], "sender string, seq long, line string"))
    rows = rows.withColumn("line", F.when(F.col("sender") == "bytes", F.unhex(F.lit("61FF62")).cast("string")).otherwise(F.col("line")))
    path = run_dir(spark, "t_keyed")
    hist.write_lines(rows, path, "sender", ["seq"])
    as_bytes = ["sender", F.hex(F.col("line").cast("binary")).alias("line")]
    want = kf.scan_by_key(spark, path, "sender").withColumnRenamed("value", "line").select(*as_bytes)
    got = kf.read_by_key(spark, path, "sender", many=1, small=small).select(*as_bytes)
    assert got.schema.fieldNames() == ["sender", "line"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("sender = '%41'").count() == 1


def test_many_small_files_are_read_by_tasks_themselves(spark):
    """Spark's reader opens each file at milliseconds; in the plan there is none of it."""
    path = run_dir(spark, "t_keyed")
    rows = spark.range(2400).select(F.format_string("u%d", F.col("id") % 1200).alias("sender"), F.col("id").alias("seq"), F.lit("x").alias("line"))
    hist.write_lines(rows, path, "sender", ["seq"])
    lines = hist.read_lines(spark, path, "sender")
    assert not [f for f in lines.inputFiles() if "/sender=" in f]
    assert [tuple(r) for r in lines.groupBy("line").agg(F.count("*"), F.countDistinct("sender")).collect()] == [("x", 2400, 1200)]
