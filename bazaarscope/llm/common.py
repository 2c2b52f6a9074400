"""Shared settings, scratch tables and row splits of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT = "spark.checkpoint.dir"
# small Arrow batches bound the memory of Python workers on long documents
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the settings; Python workers find this package where the driver found it.

    Clusters whose nodes lack that path ship the package with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session that names none, as in tests, gets a temporary folder.
    """
    root = spark.conf.get(_CHECKPOINT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_CHECKPOINT} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set(_CHECKPOINT, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket(id_column: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; null ids count as text ''."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, whatever else the table holds."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")
    )
