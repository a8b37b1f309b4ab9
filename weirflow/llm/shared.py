"""Storage and graph helpers of the corpus operators: shared folder, lineage cuts, connected components."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder as shared_path
from ..storage import shared_root


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder; lost executors cost nothing but a read."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that are out of use, and their checkpoints where
    spark.cleaner.referenceTracking.cleanCheckpoints is set (elsewhere they stay until the folder is emptied).

    The cleaner follows garbage collection on the driver, which may not happen for long while executors' disks fill.
    What holds a finished execution goes step by step: one or two collections mostly leave its files, three don't.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def fresh(df: DataFrame, *keys: str) -> DataFrame:
    """df with keys that Spark takes for new columns: a join on them gets an exchange of its own on either side, which
    adaptive execution can split when a key is hot; an aggregate's own partitioning would be reused whole."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python so many rows at a time at most: both sides hold a batch, and rows can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def spare(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores after it as make it new to df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete tables in path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return [n for n in names if system.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v); component is the smallest node it can reach.

    Large-star and small-star steps alternate until the edges stay as they are: O(log n) rounds, each a few
    aggregations and equi-joins; every round is cut to the shared folder. Nodes without a link are not returned.
    """
    oriented = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = cut(oriented(links))
    seen = _signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = oriented(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(oriented(small.unionByName(least.select("u", F.col("m").alias("v")))))
        del both, least, large, small
        release(edges.sparkSession)
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
