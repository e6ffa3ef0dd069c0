"""Text files by key, one folder a key, for many keys of few lines.

The layout is that of Spark's ``partitionBy(key).text(path)``. On a local or
mounted folder Spark's writer starts a ``chmod`` for every folder, file and
checksum file, tens of milliseconds a key. There the tasks write their files
themselves, below a hidden folder that gets its name when all are written, and
read those of many keys themselves.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.session import default_parallelism, run_dir, ship_package

NO_KEY = "__HIVE_DEFAULT_PARTITION__"   # folder of the rows whose key is NULL or empty
_ESCAPES = {c: f"%{c:02X}" for c in (*range(1, 32), 127, *b"\"#%'*/:=?\\{[]^")}
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_FILES = "name string, file string, bytes long"
MANY = 1000         # folders from which tasks read the files themselves
SMALL = 1 << 20     # bytes of a file that they read
BATCH = 1 << 22


def folder_name(key: str, value: bytes | None) -> str:
    """Name of a key's folder, escaped as Spark does."""
    text = (value or b"").decode("utf-8", "replace").translate(_ESCAPES)
    return f"{key.translate(_ESCAPES)}={text or NO_KEY}"


def folder_key(name: str) -> str | None:
    """The key whose folder has that name."""
    value = name.partition("=")[2]
    return None if value == NO_KEY else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), value)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The folder that ``path`` is for Python, if it is one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file" or jvm.java.lang.System.getProperty("sun.jnu.encoding") != "UTF-8":
        return None
    return fs.makeQualified(at).toUri().getPath()


def _file_writer(folder: str, key: str, job: str):
    """A mapInArrow function: (key, line) rows, each key's together, to a part file in
    the folder of each key. A file has its name when it is whole, so that a task may
    be repeated or run twice."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{job}.c000.txt"
        begun = f".{name}.{task.taskAttemptId()}"
        now, out, n, unclear = None, None, 0, set()

        def finish():
            if out is not None:
                out.close()
                os.replace(f"{now}/{begun}", f"{now}/{name}")

        for batch in batches:
            lines = [x or b"" for x in batch.column(1).to_pylist()]
            runs = pc.run_end_encode(batch.column(0))
            start = 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                at = f"{folder}/{folder_name(key, value)}"
                if at != now:
                    finish()
                    if "�" in at:      # keys that are no UTF-8 may share a name
                        if at in unclear:
                            raise ValueError(f"two keys for {at}")
                        unclear.add(at)
                    os.makedirs(at, exist_ok=True)
                    now, out, n = at, open(f"{at}/{begun}", "wb"), n + 1
                out.write(b"\n".join(lines[start:end]) + b"\n")
                start = end
        finish()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})
    return write


def write_by_key(rows: DataFrame, path: str, key: str) -> None:
    """Write the ``line`` of (key, line) rows, in their order in each partition, to a
    new folder ``path``. Rows of a key follow each other in a partition."""
    spark = rows.sparkSession
    if mounted(spark, path) is None:
        rows.select(key, "line").write.mode("errorifexists").partitionBy(key).text(path)
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        raise AnalysisException(f"[PATH_ALREADY_EXISTS] Path {path} already exists.")
    ship_package(spark)
    job = str(uuid.uuid4())
    hidden = jvm.org.apache.hadoop.fs.Path(fs.makeQualified(at).getParent(), f"_{at.getName()}-{job}")
    fs.mkdirs(hidden)
    try:
        (rows.select(F.col(key).cast("string").cast("binary").alias("key"), F.col("line").cast("binary").alias("line"))
         .mapInArrow(_file_writer(hidden.toUri().getPath(), key, job), "files long")
         .write.format("noop").mode("overwrite").save())
        fs.create(jvm.org.apache.hadoop.fs.Path(hidden, "_SUCCESS")).close()
        if not fs.rename(hidden, at):
            raise OSError(f"{hidden} could not be renamed to {path}")
    except BaseException:
        fs.delete(hidden, True)
        raise


def _file_lister(folder: str):
    """A mapInArrow function: names of folders to (name, file, bytes) of their files."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, x.name, x.stat().st_size) for name in batch.column(0).to_pylist()
                    for x in os.scandir(f"{folder}/{name}") if x.name[0] not in "._" and x.is_file()]
            names, files, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "file": pa.array(files, pa.string()),
                                              "bytes": pa.array(sizes, pa.int64())})
    return found


def _file_reader(folder: str, key: str):
    """A mapInArrow function: (name, file) to (key, line) of the files, cut to lines as
    Spark's reader does. A batch holds about ``BATCH`` bytes of lines."""
    def batch_of(keys: list, lines: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({key: pa.array(keys, pa.string()), "line": pa.array(lines, pa.binary())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, size = [], [], 0
        for batch in batches:
            for name, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(f"{folder}/{name}/{file}", "rb") as f:
                    text = f.read()
                got = text.removeprefix(b"\xef\xbb\xbf").splitlines()
                keys += [folder_key(name)] * len(got)
                lines += got
                size += len(text)
                if size > BATCH:
                    yield batch_of(keys, lines)
                    keys, lines, size = [], [], 0
        yield batch_of(keys, lines)
    return read


def scan_by_key(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(value, key) of the lines below ``path`` by Spark's reader, keys as text. The folders
    are listed by a few tasks: with one task a folder, as Spark has it up to 10,000
    folders, starting the tasks is most of the work."""
    most = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(most), 4 * default_parallelism(spark))))
    try:
        return spark.read.schema(f"value string, {key} string").text(path)
    finally:
        spark.conf.set(_LISTING, most)


def read_by_key(spark: SparkSession, path: str, key: str, many: int = MANY, small: int = SMALL) -> DataFrame:
    """(key, line) of the lines below ``path``, keys as text.

    Spark's reader takes milliseconds a file. On a local or mounted folder with
    ``many`` keys or more, tasks read the files of up to ``small`` bytes
    themselves; larger ones stay with Spark, which cuts them to blocks.
    """
    folder = mounted(spark, path)
    start = f"{key.translate(_ESCAPES)}="
    names = [x.name for x in os.scandir(folder) if x.name.startswith(start)] if folder and os.path.isdir(folder) else []
    if len(names) < many:
        return scan_by_key(spark, path, key).select(key, F.col("value").alias("line"))
    ship_package(spark)
    listed = run_dir(spark, "keyed-files")
    (spark.createDataFrame(pa.table({"name": pa.array(names, pa.string())})).repartition(default_parallelism(spark))
     .mapInArrow(_file_lister(folder), _FILES).write.parquet(listed))
    files = spark.read.schema(_FILES).parquet(listed)
    lines = (files.where(F.col("bytes") <= small).select("name", "file").mapInArrow(_file_reader(folder, key), f"{key} string, line binary")
             .select(key, F.col("line").cast("string").alias("line")))
    large = [f"{path.rstrip('/')}/{x['name']}/{x['file']}" for x in files.where(F.col("bytes") > small).collect()]
    if not large:
        return lines
    return lines.unionByName(spark.read.schema(f"value string, {key} string").option("basePath", path).text(large)
                             .select(key, F.col("value").alias("line")))
