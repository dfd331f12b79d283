"""Session factory with the settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTC times, ANSI errors, adaptive execution and a recursion limit above the depth of real drainage networks.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "freshet", **settings: str) -> SparkSession:
    """A session with SETTINGS; `settings` (dots written as double underscores) override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; those of a local-cluster need a shared folder like any others."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session of one machine may lack the setting; it gets a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or f"file://{tempfile.mkdtemp(prefix='freshet-')}"


def settled(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the shared folder, so that its rows and their partitions stay as
    they are whoever is lost."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The frame written once, compressed and by column, to the shared folder and read back: for what is looked at several
    times and is large, of which `settled` would keep every row at full width."""
    path = new_folder(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a part that `dealt` makes.
PART_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys, in a part for every PART_ROWS of them (as many as shuffles have partitions at least), so what a task
    holds doesn't grow with the table. The frame's rows are counted, so it should be a scan."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // PART_ROWS)), *keys)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shipped(df: DataFrame) -> DataFrame:
    """The frame itself, after this package has been sent to the executors (once a session) for Python functions."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_freshet_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / "freshet-package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._freshet_shipped = True
    return df


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The frame, to be broadcast if it has `most` rows or fewer (which is counted, no further than that)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
