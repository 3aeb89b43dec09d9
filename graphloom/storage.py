"""Where intermediate tables live: the folder that every executor of the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
#: the setting as it was, and an entry for each that is within ``swept``
_before: list[str | None] = []
_sweeping = threading.Lock()
#: every table of this process that is still there
_written: dict[str, None] = {}
#: the tables of the step that runs here; each thread has its own
_step: ContextVar[list[str] | None] = ContextVar("step", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder of its own; on a cluster that
    would not be visible to the executors, so a missing setting is an error there.
    """
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {KEY} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    _written[path] = None
    held = _step.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.

    The session's setting is put back by whoever leaves last."""
    with _sweeping:
        if not _before:
            _before[:] = [spark.conf.get(SWEEP, None)]
            spark.conf.set(SWEEP, "true")
        _before.append(None)
    try:
        yield
    finally:
        with _sweeping:
            _before.pop()
            if len(_before) == 1:
                was = _before.pop()
                spark.conf.unset(SWEEP) if was is None else spark.conf.set(SWEEP, was)


def _write(df: DataFrame, label: str, rows_a_file: int = 0) -> tuple[DataFrame, str]:
    path = fresh_path(df.sparkSession, label)
    (df.write.option("maxRecordsPerFile", rows_a_file) if rows_a_file else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    return _write(df, label)[0]


def materialise_at(df: DataFrame, label: str) -> str:
    """Writes ``df`` for tasks that read its files themselves, and says where."""
    return _write(df, label)[1]


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins that must not broadcast either side.

    Spark sizes a table by its files and a projection by its columns: too low after an explode, where values repeat, or
    where they are packed well. What it then takes for small would go through the driver."""
    return df.hint("merge")


def delete_table(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _written.pop(path, None)


def _write_step(make: Callable[[], DataFrame], label: str, rows_a_file: int = 0) -> tuple[DataFrame, str]:
    inner: list[str] = []
    before = _step.set(inner)
    try:
        made = make()
    finally:
        _step.reset(before)
    out = _write(made, label, rows_a_file)
    for path in inner:
        delete_table(made.sparkSession, path)
    return out


def materialise_step(make: Callable[[], DataFrame], label: str, rows_a_file: int = 0) -> DataFrame:
    """Writes what ``make`` gives, then deletes the tables that ``make`` wrote on the way."""
    return _write_step(make, label, rows_a_file)[0]


class Rolling:
    """The tables of an iteration, of which each is made from the one before: only the last one is kept."""

    def __init__(self, label: str):
        self.label, self.path = label, None

    def keep(self, df: DataFrame) -> DataFrame:
        return self._moved(*_write(df, self.label))

    def step(self, make: Callable[[], DataFrame]) -> DataFrame:
        """The same for what ``make`` gives; what it writes on the way goes, too."""
        return self._moved(*_write_step(make, self.label))

    def _moved(self, out: DataFrame, path: str) -> DataFrame:
        if self.path:
            delete_table(out.sparkSession, self.path)
        self.path = path
        return out


def delete_tables(spark: SparkSession) -> None:
    """Deletes every table that this process has written; DataFrames over them can't be read afterwards."""
    for path in list(_written):
        delete_table(spark, path)
