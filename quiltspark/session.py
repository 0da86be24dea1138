"""Session helpers: a tuned local session for tests/bench and the checkpoint rule.

Lineage is cut with reliable ``checkpoint()`` into the folder the cluster names
in ``spark.checkpoint.dir``.  Only when that is unset *and* the master is local
(tests, bench) do we pick a fresh scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "quiltspark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only for a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; on a cluster it must name a shared folder "
            "(HDFS/S3/ABFS) that survives executor loss"
        )
    path = tempfile.mkdtemp(prefix="quiltspark-ckpt-", dir=os.environ.get("QUILTSPARK_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


ROWS_PER_FIT_PARTITION = 20_000


def spread(df, key: str | None = None):
    """Lay rows out for model fitting by one rule: as many partitions as the row count
    asks for, dealt by hash of ``key`` and sorted, so a seeded fit that samples by
    partition gives the same model on every cluster.
    """
    parts = max(1, -(-df.count() // ROWS_PER_FIT_PARTITION))
    return df.repartition(parts, key).sortWithinPartitions(key) if key else df.repartition(parts)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder of our own under ``spark.checkpoint.dir``."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quiltspark-stage/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def discard(spark: SparkSession, path: str) -> None:
    """Remove what we have written to a ``stage_path`` and no plan reads any more."""
    if "/quiltspark-stage/" not in path:
        raise ValueError(f"{path} is not a folder of ours")
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def materialize(df, name: str = "stage"):
    """Cut lineage by writing a parquet table under ``spark.checkpoint.dir`` and
    reading it back: one job, columnar storage on the shared folder, so a lost
    executor costs nothing and later plans start from the files."""
    path = stage_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
