"""Session settings the plans are designed for, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Runtime settings only, so they can be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins on order, product or seller ids may meet a key that owns a large part of
    # all rows: let AQE split it even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Parquet fixtures and the DATETIME columns of the model carry no zone.
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    # The JVM never compiles a method of more than 8000 byte codes, and stages with very many rules or
    # conversions per row become one such method; beyond this length Spark splits it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Only where the session names none: its owner knows how much a task may hold.
DEFAULT_CONF = {
    # What a task merges of small partitions is held in one hash table: 64 MB, the default, of
    # compressed keys and counts take almost 2 GB there.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    for key, value in DEFAULT_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bazaarscope")
        .config("spark.ui.enabled", "false")
        # plans with very many rules per row compile to methods that the JVM would only interpret
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # recording the call site of every column expression slows plan building
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none, as in tests, gets a temporary folder; on a cluster
    executors would each write to a disk of their own.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF, None
    )
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="bazaarscope-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
