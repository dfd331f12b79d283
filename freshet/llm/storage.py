"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and the master is local, a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/freshet-shared"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The frame as a table in the shared folder, read back: lineage ends here and lost executors cost nothing that was written."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    made(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_own: ContextVar[list[str] | None] = ContextVar("_own", default=None)


@contextmanager
def own_tables() -> Iterator[list[str]]:
    """Paths of the tables that are written inside the block (by this thread), oldest first; others don't mix with them."""
    found: list[str] = []
    token = _own.set(found)
    try:
        yield found
    finally:
        _own.reset(token)


def made(spark: SparkSession) -> list[str]:
    """Paths of the tables that this session has written outside of `own_tables` and not forgotten, oldest first."""
    inside = _own.get()
    if inside is not None:
        return inside
    context = spark.sparkContext
    if not hasattr(context, "_freshet_tables"):
        context._freshet_tables = []
    return context._freshet_tables


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of `written`; nothing that is still to be read may come from them. Token files are results and stay."""
    for path in list(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in made(spark):
            made(spark).remove(path)


#: Rows of text in one Arrow batch: at Spark's default of 10,000, a batch of long texts is as large as a worker's share of memory.
BATCH_SETTING, DEFAULT_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def shipped(df: DataFrame) -> DataFrame:
    """The frame itself, after this package has been sent to the executors (once a session) for the Python functions that
    follow; Arrow batches get smaller unless their size has been chosen."""
    if df.sparkSession.conf.get(BATCH_SETTING) == DEFAULT_ROWS:
        df.sparkSession.conf.set(BATCH_SETTING, ROWS)
    context = df.sparkSession.sparkContext
    if not getattr(context, "_freshet_shipped", False):
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp()) / "freshet-package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._freshet_shipped = True
    return df
