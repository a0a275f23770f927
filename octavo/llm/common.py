"""What the operators of this subpackage share: the shared folder, materialised steps, rows as structs."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the cluster names no shared folder (tests on one machine).
LOCAL_FOLDER = "file:///tmp/checkpoints/octavo"

#: One space, or \t \n \v \f \r: the white space of every contract here.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see. Only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_FOLDER
    return f"{base.rstrip('/')}/octavo-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch where the session says nothing, so that a batch of long texts stays small. It is a setting of the session, as Spark has none of a query.
BATCH = 8 << 20
_scratch: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch", default=None)


class Workspace:
    """Written tables of one operator call. Each cuts the lineage: a lost executor costs one step, not the chain."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n, self.paths = spark, shared_folder(spark), 0, []
        if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        if (opened := _scratch.get()) is not None:
            opened.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:02d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((found, path))
        return found

    def drop(self, df: DataFrame) -> None:
        """Removes a table that no later step reads."""
        for found, path in self.paths:
            if found is df:
                _delete(self.spark, path)

    def remove(self) -> None:
        """Removes all tables of the call: for callers that have written what they made of them."""
        _delete(self.spark, self.folder)
        self.paths.clear()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch():
    """Workspaces opened within are removed at its end, by when the caller has written the results."""
    opened: list[Workspace] = []
    token = _scratch.set(opened)
    try:
        yield
    finally:
        _scratch.reset(token)
        for space in opened:
            space.remove()


@contextlib.contextmanager
def noted():
    """The workspaces opened within. They stay; a scratch() around it learns of them too."""
    opened: list[Workspace] = []
    outer, token = _scratch.get(), _scratch.set(opened)
    try:
        yield opened
    finally:
        _scratch.reset(token)
        if outer is not None:
            outer.extend(opened)


def name(column: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col(f"`{column}`")


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The input's columns as one struct, so that their names clash with none of an operator's own."""
    return F.struct(*[name(c).alias(c) for c in columns or df.columns])


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(name(column).cast("string"), F.lit(""))
