"""Session settings and the shared scratch folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


#: Rows of a partitioned write go as they come into one open file per partition; with more than so many in a task, Spark
#: sorts the rest by partition, as it sorts all rows without this.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "8"}
#: The JVM leaves longer methods uncompiled; Spark then runs the projection in the smaller methods of its other form.
SHORT_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> None:
    """Settings for speed in a session made elsewhere; they change no result."""
    for name, value in {**OPEN_FILES, **SHORT_METHODS}.items():
        spark.conf.set(name, value)


def at_once(spark: SparkSession, calls: Sequence[Callable[[], T]]) -> list[T]:
    """Results of the calls, in order. Their jobs are independent, so one runs where another's leave cores idle."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


def build_session(app: str = "threatlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        # no call-site capture per column expression: plans build in half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # keyed state on disk, not in the executors' heap
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        # scoring projections compile to long methods; let the JIT compile those too
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
    )
    builder = builder.config(map=OPEN_FILES)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def scratch_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/threatlake/{purpose}-{uuid.uuid4().hex}"


_DATABASES: dict[str, str] = {}


def _database(spark: SparkSession) -> str:
    """Database of this application's scratch tables; its folder lies in the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _DATABASES:
        name = f"scratch_{re.sub('[^a-z0-9]+', '_', app.lower())}_{uuid.uuid4().hex[:8]}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_dir(spark).rstrip('/')}/threatlake/{name}'")
        _DATABASES[app] = name
        atexit.register(_release_quietly, spark)
    return _DATABASES[app]


def scratch_name(spark: SparkSession) -> str:
    """Name of the database of scratch tables; another one after ``release``."""
    return _database(spark)


class Scratch:
    """Written tables that cut lineage, as a context that deletes what it made.

    ``table`` writes a frame and reads it back; those tables go when the block ends. ``keep`` does
    the same for what a returned, not yet computed result reads: it stays until ``release``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._made: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        for name in self._made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._made.clear()

    def table(self, df: DataFrame, purpose: str) -> DataFrame:
        name = _written(df, purpose)
        self._made.append(name)
        return self.spark.table(name)

    def drop(self, purpose: str) -> None:
        """Drop the tables of one purpose before the block ends."""
        mark = f".{purpose}_"
        for name in [n for n in self._made if mark in n]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._made.remove(name)

    def keep(self, df: DataFrame, purpose: str) -> DataFrame:
        return materialise(df, purpose)


def _written(df: DataFrame, purpose: str) -> str:
    spark = df.sparkSession
    name = f"{_database(spark)}.{re.sub('[^a-z0-9]+', '_', purpose.lower())}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").saveAsTable(name)
    return name


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    One computation, readable by every executor, and later reads prune columns. The table stays
    until ``release`` or the end of the program; use ``Scratch`` where it can go earlier.
    """
    return df.sparkSession.table(_written(df, purpose))


def release(spark: SparkSession) -> None:
    """Drop every scratch table of this application. Results not yet written can't be read after it."""
    name = _DATABASES.pop(spark.sparkContext.applicationId, None)
    if name:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def _release_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # at exit the session may be gone
        release(spark)
