"""Session construction and shared-folder helpers.

The library never assumes a machine-local folder on a cluster: anything
written (checkpoints, round-trip files) goes below the folder named by
``spark.checkpoint.dir``.  Only a local-mode session without that
setting (tests, laptops) gets a fresh folder under the system temp dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale.  AQE re-plans joins at run time
# (broadcast when a side turns out small, skew-join splitting when one
# key carries a large share of the rows) and coalesces small partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def recommended_conf(input_bytes: int, total_cores: int,
                     partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Spill-aware sizing for a cluster run.  ``input_bytes``: what the largest
    shuffle carries (after projection and partial aggregation), which may be
    far less than the tables read.

    Shuffle partitions ~ input / 128 MB (at least 3 waves of tasks), file
    splits of 128 MB, AQE coalescing toward 128 MB and skew splitting
    for partitions 5x the median.  The largest operator state per task
    is then one shuffle partition, a window over one range of distinct values,
    or a broadcast bounded by its documented size.
    """
    shuffle = max(3 * total_cores, -(-input_bytes // partition_bytes))
    return {
        **DEFAULT_CONF,
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * partition_bytes),
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tractus", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    return sc.getConf().get("spark.checkpoint.dir", None) or None


def checkpoint_base(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Reads ``spark.checkpoint.dir`` from the session.  If it is unset and
    the session runs in local mode, a temp folder is created and set as
    the checkpoint dir (test setting).  On a cluster an unset value is an
    error: a driver-local folder would not be visible to executors.
    """
    base = _checkpoint_dir(spark)
    if not base:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; set it to a shared folder "
                "(HDFS/S3/ABFS) visible to all executors")
        base = tempfile.mkdtemp(prefix="tractus-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base


def scratch_dir(spark: SparkSession, purpose: str = "scratch") -> str:
    """A new, unique folder below the shared checkpoint folder."""
    base = checkpoint_base(spark)
    path = base.rstrip("/") + f"/{purpose}-{uuid.uuid4().hex}"
    if path.startswith("file:"):
        os.makedirs(path[len("file:"):], exist_ok=True)
    elif path.startswith("/"):
        os.makedirs(path, exist_ok=True)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``scratch_dir`` made, through the file system that
    its path names."""
    if "/" not in path or not path.startswith(checkpoint_base(spark).rstrip("/") + "/"):
        raise ValueError(f"not a scratch folder: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Cut lineage by writing the table as parquet into a new folder of
    the shared checkpoint folder and reading it back.

    Used for tables that feed several downstream jobs (the enriched unit
    table): a lost executor then re-reads files instead of recomputing
    the whole enrichment.  Unlike ``checkpoint()`` (which computes its
    input twice unless cached and is read back as opaque rows) the
    table is computed once, and later scans prune columns and push
    filters into the parquet reader.
    """
    return materialize_counted(df, purpose)[0]


def materialize_counted(df: DataFrame, purpose: str = "table") -> tuple[DataFrame, int]:
    """``materialize`` plus the exact row count, observed during the write
    (no extra job)."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    obs = Observation(f"rows_{purpose}")
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    # the schema is known: reading it back needs no inference job
    return spark.read.schema(df.schema).parquet(path), int(obs.get["n"])
