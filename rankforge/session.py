"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# The plans rely on AQE: it merges small shuffle partitions, splits hot keys and
# picks join strategies from measured sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# Folders handed out within the innermost ``owned_folders``, if any.
_owned: ContextVar[list[str] | None] = ContextVar("owned folders", default=None)


def build_session(
    app_name: str = "rankforge", conf: Mapping[str, str] | None = None
) -> SparkSession:
    """Get or create a session with the defaults and ``conf`` on top."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """Path of a new folder below the one ``spark.checkpoint.dir`` names.

    Executors write here and other executors read it back, so a folder of one
    machine only serves a local master; elsewhere the setting is required. Within
    ``owned_folders`` the folder goes at the end of that.
    """
    base = checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if (mine := _owned.get()) is not None:
        mine.append(path)
    return path


@contextmanager
def owned_folders(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what ``shared_dir`` hands out inside, also when the work fails.

    For work that ends with a written result: DataFrames read from those folders
    cannot be used afterwards. Folders of a scope inside belong to that scope.
    """
    mine: list[str] = []
    outer = _owned.set(mine)
    try:
        yield mine
    finally:
        _owned.reset(outer)
        for path in mine:
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names; a missing one is fine."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to a new shared folder and read back, which cuts their lineage."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; from here on Spark's own checkpoints go there too."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="rankforge-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base
