"""Session-level helpers: lineage cuts, size checks and null-safe outer joins."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_KEY_SPREAD = 1024
ROWS_PER_TASK = 500_000
MAX_TASKS = 10_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="collabnet-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The application's folder for intermediate tables, emptied when it ends."""
    ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/tables")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return folder.toString()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Columnar and compressed, so later readers take only the columns they need; an
    executor that is lost takes nothing with it.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, n_rows: float, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks that make about ``ROWS_PER_TASK`` of ``n_rows`` rows each.

    A fixed number of partitions, and merging them up to a size in bytes, would let
    the memory of a task grow with the input. What fits one task is left to Spark.
    """
    if n_rows <= ROWS_PER_TASK:
        return df.repartition(*keys)
    tasks = min(MAX_TASKS, math.ceil(n_rows / ROWS_PER_TASK))
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` with the null keys of the left side spread over the partitions.

    Null never matches; without the second key all such rows would hash to one partition.
    """
    plain = [f.name for f in left.schema if not isinstance(f.dataType, T.MapType)]
    salt = F.pmod(F.xxhash64(*plain), F.lit(NULL_KEY_SPREAD))
    none = F.lit(0).cast("bigint")
    spread = left.withColumn("_spread", F.when(F.col(key).isNull(), salt).otherwise(none))
    return spread.join(right.withColumn("_spread", none), [key, "_spread"], "left").drop("_spread")


def full_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on ``key`` that survives hot and null keys.

    A full outer join cannot be split at run time, so it is written as a left
    join, which can, plus the right rows without a partner. ``left`` is read
    twice: cut its lineage first if it is costly.
    """
    alone = right.join(left.select(key).distinct(), key, "left_anti")
    return left_join(left, right, key).unionByName(alone, allowMissingColumns=True)
