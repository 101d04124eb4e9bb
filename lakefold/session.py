"""Session helpers: where shared files go, and the settings that tests and the bench use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, app: str = "lakefold") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_MADE: list[str] = []  # scratch paths of this process, oldest first


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset, which a cluster
    does not allow: its executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        current = context.getCheckpointDir()
        if current:
            return current
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="lakefold-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the scratch paths made inside it, but for those that the given list then has."""
    before, kept = len(_MADE), []
    try:
        yield kept
    finally:
        for path in _MADE[before:]:
            if path not in kept:
                delete(spark, path)
        _MADE[before:] = kept


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table written to the shared folder and read back (its lineage is cut, and lost executors cost nothing), and
    the table's path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of input files for which one more group is made.
GROUP_BYTES = 256 << 20


def group_count(df: DataFrame, least: int = 4) -> int:
    """Groups for hashed work over df: as many as shuffle partitions, and one for each GROUP_BYTES of the files that it
    reads, so that a group's size does not grow with the data."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    known = sum(s for s in sizes if s < 1 << 60)  # an unknown size is said to be enormous
    return max(least, shuffle_partitions(df.sparkSession), -(-known // GROUP_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
