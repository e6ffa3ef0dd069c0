"""The chat store as every writer keeps it (SNK-1, ST-6).

``chat_history`` is partitioned by (batch, id_block) and sorted by id in its
files, whether a batch job or a stream wrote it. A batch has a name; writing it
again replaces it. The record beside the table (readers pass it over) says which
batches are finished, with their ids and times: a finished batch is not written
again, the next id and the mark come from the record, and messages that come a
second time are looked up only in the batches that their time falls in. A batch
is read and written by its own folder; the table is never listed or scanned.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from contextlib import ExitStack

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions import vectors as vx
from chatlake.operators import ingest as ing
from chatlake.operators.ids import dense_ids
from chatlake.session import remove_dir, run_dir, staged

RECENT = 512    # batches that the record keeps at hand; older ones are in ``_progress``

# batch rows have no channel; a channel's row is the mark that it is still behind at
_RECORD = "seq long, batch string, first_id long, n long, min_ts timestamp, max_ts timestamp, channel string"
_OLDER = "\0older"      # stands for all batches in ``_progress``


def existing(spark: SparkSession, path: str, base: str | None = None) -> DataFrame | None:
    """The table at ``path``, or None if there is none; other errors pass."""
    try:
        return (spark.read.option("basePath", base) if base else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class Record:
    """What the newest of the record's two slots says: at most 2 * RECENT batches
    and a row for each channel that is behind."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        slots = [s.collect() for k in (0, 1) if (s := existing(spark, f"{path}/_state/slot={k}")) is not None]
        rows = max((s for s in slots if s), key=lambda s: s[0]["seq"], default=[])
        self.seq = rows[0]["seq"] if rows else 0
        self.batches = sorted((r for r in rows if r["channel"] is None), key=lambda r: r["first_id"] + r["n"])
        self.behind = {r["channel"]: r["max_ts"] for r in rows if r["channel"] is not None}

    @property
    def next_id(self) -> int:
        return max((r["first_id"] + r["n"] for r in self.batches), default=0)

    @property
    def mark(self) -> dt.datetime | None:
        """The latest time stored."""
        return max((r["max_ts"] for r in self.batches if r["max_ts"]), default=None)

    def has(self, batch: str) -> bool:
        if any(r["batch"] == batch for r in self.batches):
            return True
        if not any(r["batch"] == _OLDER for r in self.batches):
            return False
        old = existing(self.spark, f"{self.path}/_progress")
        return old is not None and not old.where(F.col("batch") == batch).isEmpty()

    def since(self, ts: dt.datetime) -> list[str]:
        """Batches that hold a row at or after ``ts``."""
        names = [r["batch"] for r in self.batches if r["batch"] != _OLDER and r["max_ts"] and r["max_ts"] >= ts]
        if any(r["batch"] == _OLDER and r["max_ts"] and r["max_ts"] >= ts for r in self.batches):
            old = existing(self.spark, f"{self.path}/_progress").where(F.col("max_ts") >= F.lit(ts))
            names += [r["batch"] for r in old.select("batch").distinct().toLocalIterator()]
        return names

    def put(self, batch: str, first_id: int, n: int, min_ts, max_ts, behind: dict) -> None:
        """Record a finished batch, in the slot that is not the newest."""
        rows = [tuple(r)[1:] for r in self.batches] + [(batch, first_id, n, min_ts, max_ts, None)]
        if len(rows) > 2 * RECENT:
            gone, rows = rows[:-RECENT], rows[-RECENT:]
            named = [(0, *r) for r in gone if r[0] != _OLDER]
            self.spark.createDataFrame(named, _RECORD).coalesce(1).write.mode("append").parquet(f"{self.path}/_progress")
            last = max(gone, key=lambda r: r[1] + r[2])
            rows.insert(0, (_OLDER, last[1], last[2], None, max((r[4] for r in gone if r[4]), default=None), None))
        rows += [(None, 0, 0, None, mark, channel) for channel, mark in behind.items()]
        self.spark.createDataFrame([(self.seq + 1, *r) for r in rows], _RECORD).coalesce(1)\
            .write.mode("overwrite").parquet(f"{self.path}/_state/slot={(self.seq + 1) % 2}")


def _stored(spark: SparkSession, path: str, batch: str) -> DataFrame | None:
    """A batch as it is stored, read from its own folder."""
    rows = existing(spark, f"{path}/batch={batch}", base=path)
    return None if rows is None else rows.withColumn("batch", F.lit(batch))


def _write(rows: DataFrame, path: str) -> None:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartitionByRange(n, "id").sortWithinPartitions("id_block", "id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", "id_block").parquet(path))


def unseen(messages: DataFrame, path: str, record: Record, first: dt.datetime) -> DataFrame:
    """``messages``, each ``source_id`` once and without those that the store has:
    a message that comes again has the time it had, so only stored rows at or after
    ``first``, the earliest time among them, can be the same."""
    spark, out = messages.sparkSession, messages.dropDuplicates(["source_id"])
    for name in record.since(first):
        stored = existing(spark, f"{path}/batch={name}", base=path)
        if stored is not None:
            out = out.join(stored.where(F.col("ts") >= F.lit(first)).select("source_id"), "source_id", "left_anti")
    return out


def add(messages: DataFrame, path: str, batch: str, order_cols=("ts", "source_id"), embed=ing.default_embed,
        block: int | None = None, unique: bool = False, behind: dict | None = None) -> DataFrame | None:
    """Normalise, embed, number and write ``messages`` as ``batch``, with their
    arrival time ``ingest_ts`` beside the event time ``ts`` (ST-6).

    With ``unique`` a ``source_id`` is stored once, however often and through
    whichever batch it comes. ``behind`` replaces the record's channels that are
    behind. Returns the batch as it is stored; None if it has no rows. Ids follow
    the ids of the batches before it. One writer at a time; a batch that was cut
    off is run again before another.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"batch name {batch!r}: letters, digits, '_', '.' and '-' only")
    spark = messages.sparkSession
    record = Record(spark, path)
    if not record.has(batch):
        # the source is read once, and so is what was stored before; numbering reads the staged rows
        with ExitStack() as stages:
            rows = stages.enter_context(staged(messages, "stage"))
            if unique:
                first = rows.agg(F.min("ts")).first()[0]
                if first is not None:
                    rows = stages.enter_context(staged(unseen(rows, path, record, first), "unseen"))
            numbered = dense_ids(ing.prepare(rows, embed), list(order_cols), "id", start=F.lit(record.next_id).cast("long"))
            _write(numbered.withColumn("ingest_ts", F.current_timestamp()).withColumn("batch", F.lit(batch))
                   .withColumn("id_block", F.floor(F.col("id") / (block or ing.ID_BLOCK)).cast("long")), path)
            stored = _stored(spark, path, batch)
            n, low, high = (0, None, None) if stored is None else stored.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
            record.put(batch, record.next_id, n, low, high, record.behind if behind is None else behind)
    return _stored(spark, path, batch)


def catch_up(spark: SparkSession, channels: list[str], load: Callable[[list[str]], DataFrame], path: str,
             batch: str, **how) -> tuple[DataFrame | None, list[str]]:
    """Store what ``channels`` got while nobody listened (SRC-7, ST-4, SET-3): the
    rows of ``load(channels)`` (ts, source_id, sender, channel, message) after the
    store's mark, each message id once, as ``batch``.

    A channel that cannot be read is left out, the others go on (ST-9); it stays
    behind at the mark of this run, so that a later run takes it up from there,
    whatever was stored since. An empty store has no mark, and then nothing is
    read. Returns the stored batch (None without rows) and the channels left out.

    The mark is cut to milliseconds, as the source's clock; what the store has of
    that millisecond is known by its id.
    """
    record = Record(spark, path)
    if record.mark is None:
        return None, []
    if record.has(batch):
        return _stored(spark, path, batch), sorted(c for c in record.behind if c in channels)
    cut = lambda ts: ts.replace(microsecond=ts.microsecond // 1000 * 1000)
    marks = {c: cut(record.behind.get(c, record.mark)) for c in channels}

    def missed(some: list[str]) -> DataFrame:
        # the earliest mark is one literal that the source's scan can push down
        since = F.lit(cut(record.mark))
        for c in some:
            if c in record.behind:
                since = F.when(F.col("channel") == c, F.lit(marks[c])).otherwise(since)
        return load(some).where((F.col("ts") > F.lit(min(marks[c] for c in some))) & (F.col("ts") > since))

    stage = run_dir(spark, "catch-up")
    parts, failed = [], []
    # all at once; one by one only if something in them cannot be read
    for k, some in enumerate([channels, *([c] for c in channels)] if channels else []):
        try:
            missed(some).write.mode("overwrite").parquet(f"{stage}/{k}")
            parts.append(f"{stage}/{k}")
            if not k:
                break
        except (PySparkException, Py4JJavaError, OSError):
            failed += some if k else []
    late = {c: m for c, m in record.behind.items() if c not in channels} | {c: marks[c] for c in failed}
    if not parts:
        record.put(batch, record.next_id, 0, None, None, late)
        return None, failed
    stored = add(spark.read.parquet(*parts), path, batch, unique=True, behind=late, **how)
    remove_dir(spark, stage)
    return stored, failed


def reembed(spark: SparkSession, path: str, target: str, embed=ing.default_embed) -> DataFrame:
    """The store at ``path`` written to ``target`` with every vector and norm
    computed anew from its message (SNK-5); rows, ids, layout and record stay.
    Returns the new store."""
    stored = spark.read.parquet(path)
    redone = stored.withColumn("vector", embed(F.col("message"))).withColumn("norm", vx.norm("vector"))
    _write(redone.select(*stored.columns), target)
    for part in ("_state/slot=0", "_state/slot=1", "_progress"):
        kept = existing(spark, f"{path}/{part}")
        if kept is not None:
            kept.coalesce(1).write.parquet(f"{target}/{part}")
    return spark.read.parquet(target)
