"""Reading the tables of a directory, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: set[str] = set()
_LOCAL = ""


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder if all executors are on this machine, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        # the setting can't be changed in a running session, so the folder is kept here
        global _LOCAL  # noqa: PLW0603
        where = _LOCAL = _LOCAL or "file://" + tempfile.mkdtemp(prefix="stemma-")
    return where


def settle(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, and lost executors cost nothing.

    Results are read lazily, so what is written stays until `drop_settled`, `clean` or the end of this process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stemma-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: set[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in paths:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(conf).delete(p, True)
    _WRITTEN.difference_update(paths)


def drop_settled(df: DataFrame) -> None:
    """Deletes the files behind settled DataFrames and what is read from them; tables that settle did not write stay."""
    folders = {x.rsplit("/", 2)[-2] for x in df.inputFiles()}
    _delete(df.sparkSession, {f for f in _WRITTEN if f.rsplit("/", 1)[1] in folders})


def clean(spark: SparkSession) -> None:
    """Deletes all that this process has settled; for after the results of its queries were written."""
    _delete(spark, set(_WRITTEN))


@atexit.register
def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _WRITTEN else None
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            clean(spark)
    if _LOCAL:
        shutil.rmtree(_LOCAL.removeprefix("file://"), ignore_errors=True)
