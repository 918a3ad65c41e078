"""What the library needs of a Spark session: its code on the executors, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of applications that name no shared one: local tests.
_OWN_FOLDERS: dict[str, str] = {}
#: (application, folder) of what `durable` has written and nothing has deleted.
_WRITTEN: list[tuple[str, str]] = []


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application; they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._millrace_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see; a temporary one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN_FOLDERS:
            _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="spark-")
        named = _OWN_FOLDERS[application]
    return named.rstrip("/")


class Scope:
    """Owner of what `durable` writes while it is entered (`with Scope(spark) as own`), in this thread alone.

    It deletes only its own tables, never those of another query of the application. What it still has when it is
    left goes to the scope around it, if there is one, else stays until `drop_written`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        self._around = _SCOPE.set(self)
        return self

    def __exit__(self, *fault: object) -> None:
        _SCOPE.reset(self._around)
        outer = _SCOPE.get()
        if outer is not None:
            outer.paths += self.paths

    def drop(self, but_last: int = 0) -> None:
        """Delete the scope's tables, but for the `but_last` written last. Frames that read the others no longer work."""
        gone = self.paths[: len(self.paths) - but_last]
        _delete(self.spark, gone)
        self.paths = self.paths[len(gone) :]


_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    java = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = java(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        entry = (spark.sparkContext.applicationId, path)
        if entry in _WRITTEN:
            _WRITTEN.remove(entry)


def durable(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    The result no longer depends on the work behind it, so losing executors costs a re-read and
    not a re-computation, and several consumers can use it without computing it again. Files stay
    under `<spark.checkpoint.dir>/millrace/<application>/`, one folder per call, until their scope deletes them.
    With `partition_by`, a column of small whole numbers, a reader that asks for some of its values reads only their folders.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*([partition_by] if partition_by else [])).parquet(path)
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    scope = _SCOPE.get()
    if scope is not None:
        scope.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete all that `durable` has written in this application and nothing has deleted: for its end."""
    application = spark.sparkContext.applicationId
    _delete(spark, [path for owner, path in _WRITTEN if owner == application])
