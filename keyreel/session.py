"""Session helpers: table access, lineage cuts and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose row count was measured may be broadcast; its rows must be narrow (keys, numbers, short names).
BROADCAST_ROWS = 100_000
#: Rows of one key from which on a join spreads them over SALTS tasks.
HOT_ROWS, SALTS = 200_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a session on one machine may leave it unset: it gets a temporary
    folder, which other machines could not read.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="keyreel-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
            named = "file://" + named
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """A folder in the shared folder that lives as long as the application."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def cut_table(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint, and pruned and pushed down when read."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/keyreel-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_join(rows: DataFrame, state: DataFrame, on: list[str], how: str, *, count: int, hot: DataFrame | None = None, spread: str) -> DataFrame:
    """Rows with the state of their key (one row per key, ``count`` in all).

    Up to BROADCAST_ROWS the state is broadcast. Beyond, both sides are shuffled by key, and the rows of the keys in ``hot``
    (by default those with more than HOT_ROWS rows, so there are few) over SALTS tasks by the column ``spread``; only
    their states are copied.
    """
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(state), on, how)
    if hot is None:
        hot = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(*on)
    hot = cut_table(hot.withColumn("_hot", F.lit(True)))
    if not hot.count():
        return rows.join(state, on, how)
    ours = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    theirs = state.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return ours.drop("_hot").join(theirs, [*on, "_salt"], how).drop("_salt")


def tidy_id(col: Column | str) -> Column:
    """An identifier trimmed and upper-cased; blank becomes null."""
    c = F.upper(F.trim(F.col(col) if isinstance(col, str) else col))
    return F.when(c != "", c)


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    n = cores or os.cpu_count() or 4
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("keyreel")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
