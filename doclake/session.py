"""Session factory and the shared scratch folder.

Intermediate tables that several jobs read are written as Parquet under the
folder that ``spark.checkpoint.dir`` names, which every executor shares. That
cuts the lineage: a lost executor costs its running tasks, never a recomputed
chain. Only where the setting is absent (tests, a laptop) does the library pick
a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.doclake.scratch"


def get_session(master: str = "local[8]", app: str = "doclake", **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share."""
    for key in ("spark.checkpoint.dir", _OWN):
        root = spark.conf.get(key, None)
        if root:
            return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {master} share no folder of this machine")
    root = "file://" + tempfile.mkdtemp(prefix="doclake-")
    spark.conf.set(_OWN, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; removed when the driver ends."""
    path = f"{shared_root(spark)}/doclake/{uuid.uuid4().hex}/{name}"
    _paths.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    return cut_at(df, name, *partition_by)[0]


def cut_at(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """As ``cut``, with the path for ``drop_path``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Shuffle files of a finished query go at once, not when the driver happens to collect its garbage; tables take less room.
SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries that run within; afterwards they are as before."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_kept: dict[tuple, DataFrame] = {}


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table's files are still the same: bytes, files and the newest change."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(root)
    files = [status] if status.isFile() else list(fs.listStatus(root))
    return sum(f.getLen() for f in files), len(files), max((f.getModificationTime() for f in files), default=0)


def once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under ``key``, written to the shared folder the first time it is asked for in this session."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As ``cut``, bucketed by ``keys`` into as many buckets as there are shuffle partitions.

    Where ``df`` comes out of an aggregation by just these keys its partitions are the
    buckets, so each is one file; joins on the keys then read it without a shuffle.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"doclake_{name}_{uuid.uuid4().hex}"
    df.write.option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).saveAsTable(table)
    _tables.append((spark, table))
    return spark.table(table)


_paths: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, table in _tables:
        with contextlib.suppress(Exception):  # the JVM may be gone before this interpreter
            if not spark._jsc.sc().isStopped():
                spark.sql(f"DROP TABLE IF EXISTS {table}")
    for spark, path in _paths:
        try:
            if spark._jsc.sc().isStopped():
                continue
            drop_path(spark, path.rsplit("/", 1)[0])
        except Exception:  # the JVM may be gone before this interpreter
            return


#: Bytes of an Arrow batch; batches of texts of usual lengths stay below.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int) -> None:
    """At most ``rows`` rows and about ``BATCH_BYTES`` in an Arrow batch, so long texts cannot fill a Python worker."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
