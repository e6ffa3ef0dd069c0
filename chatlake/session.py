"""Session construction and shared scratch locations.

Everything that must survive an executor loss (stream checkpoints, written
intermediate tables) goes under the folder named by ``spark.checkpoint.dir``.
On a cluster that folder is shared storage set by the operator; we only pick
one ourselves when it is unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: adaptive execution re-plans joins from
# measured sizes (runtime broadcast only of a side measured small), splits
# skewed shuffle partitions and coalesces tiny ones.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # MIN/MAX/COUNT from parquet footers (the store's max id without a scan)
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_spark(master: str | None = None, app: str = "chatlake",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    return spark


_OWN_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    Read from the session (``spark.checkpoint.dir``, or a checkpoint dir the
    SparkContext already has); only when neither is set, as in local tests,
    a private folder is created once per application and registered with
    ``setCheckpointDir``.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            root = current.rsplit("/", 1)[0]
        elif not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            root = _OWN_ROOT.setdefault(sc.applicationId,
                                        tempfile.mkdtemp(prefix="chatlake-ckpt-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused location under the checkpoint root."""
    return f"{checkpoint_root(spark)}/runs/{name}-{uuid.uuid4().hex[:12]}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a location that ``run_dir`` gave, on whatever file system it is."""
    if "/runs/" not in path:
        raise ValueError(f"{path} is none of ours")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a table under the checkpoint root, computed once for several
    passes over it; deleted at the end."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_dir(df.sparkSession, path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``chatlake`` importable in the Python workers (pandas UDFs,
    mapInPandas): zip the package once per SparkContext and add it with
    ``addPyFile``, which also distributes it to the executors of a cluster."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="chatlake-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "chatlake"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="chatlake")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def env_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
