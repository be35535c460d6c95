"""Session helpers shared by every operator: code shipping and the shared work folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Where materialize() wrote the frames that are still referred to.
_paths: dict[int, str] = {}
_local = threading.local()


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, so Python stages can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="lodestrand-")
    target = os.path.join(folder, "lodestrand_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, Path(_PACKAGE.name) / p.relative_to(_PACKAGE))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary one is set on a local master, whose executors share the
    driver's disk; elsewhere it is an error, as executors would write to disks of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lodestrand-checkpoint-")
    sc.setCheckpointDir(folder)
    return "file://" + folder


class _Lifetime:
    """Paths that materialize() wrote inside a with-block of lifetime(), and those of them that outlive it."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def __call__(self, *frames: DataFrame) -> None:
        self.kept.update(p for df in frames if (p := _paths.get(id(df))))


def work_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes with the lifetime around it, if any."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if open_ := _open():
        open_[-1].paths.append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back: cuts lineage, survives lost executors.

    codec is the compression, if not the session's.
    """
    spark = df.sparkSession
    path = work_path(spark, f"{name}.parquet")
    df.write.parquet(path, compression=codec)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[id(back)] = path
    weakref.finalize(back, _paths.pop, id(back), None)
    return back


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def release(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for frames that nothing reads any more."""
    for df in frames:
        if path := _paths.pop(id(df), None):
            _delete(df.sparkSession, path)


def _open() -> list[_Lifetime]:
    if not hasattr(_local, "open"):
        _local.open = []
    return _local.open


@contextlib.contextmanager
def lifetime(spark: SparkSession) -> Iterator[_Lifetime]:
    """Frames that materialize() writes inside go at its end, but for those given to what it yields.

    An operator keeps what its result reads; that passes to the lifetime around it, so a
    caller that writes the result down frees the rest too. At the end of the outermost one
    the driver collects its garbage once, so that Spark drops the shuffles of ended jobs.
    """
    mine, open_ = _Lifetime(), _open()
    open_.append(mine)
    try:
        yield mine
    finally:
        open_.remove(mine)
        gone = [p for p in mine.paths if p not in mine.kept]
        for path in gone:
            _delete(spark, path)
        if open_:
            open_[-1].paths += [p for p in mine.paths if p in mine.kept]
        elif gone:
            spark.sparkContext._jvm.System.gc()
