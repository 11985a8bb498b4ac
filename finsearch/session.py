"""Session defaults and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "finsearch") -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@cache
def _one_machine_folder() -> str:
    return tempfile.mkdtemp(prefix="finsearch-")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder named in ``spark.checkpoint.dir``.

    Every executor must be able to read what another one wrote, so a
    machine-local folder is only accepted when the whole session runs on one machine.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        base = _one_machine_folder()
    path = f"{base.rstrip('/')}/finsearch/{label}-{uuid.uuid4().hex[:12]}"
    for held in _SCRATCH:
        held.append(path)
    return path


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the work folders that the block asked for, once it is done.

    For blocks that write their result elsewhere, such as a batch of a stream: what they held in
    between would pile up.
    """
    held: list[str] = []
    _SCRATCH.append(held)
    try:
        yield
    finally:
        _SCRATCH.remove(held)
        for path in held:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives an exact, cheap row count.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
