"""Reader of the nine raw CSV files. Every column arrives as text; cleaning casts it."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarscope.functions import domain as D
from bazaarscope.sources.model import SCHEMAS, Marketplace
from bazaarscope.sources.split_csv import read_split_csv

_SOURCE_NAMES = {clean: raw for raw, clean in D.RENAMED_COLUMNS.items()}

# A doubled quote stands for one quote. A row with more or fewer fields than the table has
# columns stops the job; all columns are parsed, as such rows are not seen otherwise.
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "mode": "FAILFAST", "columnPruning": "false",
}

# Review text holds quoted line breaks: its records are found by their quotes.
MULTILINE_TABLES = frozenset({"reviews"})


def raw_columns(table: str) -> list[str]:
    """Column names of a table as the source file spells them."""
    return [_SOURCE_NAMES.get(f.name, f.name) for f in SCHEMAS[table].fields]


def raw_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in raw_columns(table)])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target)


def _read(
    spark: SparkSession, path: str, table: str, multiline: bool, missing: Collection[str]
) -> DataFrame:
    if multiline:
        rows = read_split_csv(spark, path, raw_schema(table), CSV_OPTIONS)
    else:
        # enforceSchema=false: a file whose header differs from the declared names is an error
        rows = (
            spark.read.options(**CSV_OPTIONS)
            .option("enforceSchema", "false")
            .schema(raw_schema(table))
            .csv(path)
        )
    if not missing:
        return rows
    return rows.select(*[
        F.when(~F.col(name).isin(*missing), F.col(name)).alias(name) for name in rows.columns
    ])


def read_raw(
    spark: SparkSession,
    folder: str,
    files: dict[str, str] | None = None,
    multiline: Collection[str] = MULTILINE_TABLES,
    missing: Collection[str] = D.MISSING_TOKENS,
) -> Marketplace:
    """Read the nine files of a folder, failing with the list of the absent ones.

    Each entry may be a file or a folder of part files. A malformed row, such as a quoted line
    break in a table that is not in ``multiline``, stops the job that meets it. Cells whose text
    is in ``missing`` become NULL; with ``missing=()`` only empty cells do.
    """
    files = files or D.SOURCE_FILES
    paths = {table: f"{folder.rstrip('/')}/{name}" for table, name in files.items()}
    absent = [path for path in paths.values() if not _exists(spark, path)]
    if absent:
        raise FileNotFoundError("source files not found:\n" + "\n".join(absent))
    return Marketplace({t: _read(spark, path, t, t in multiline, missing) for t, path in paths.items()})


def write_raw(raw: Marketplace, folder: str, files: dict[str, str] | None = None) -> None:
    """Write raw text tables as CSV under the source file names."""
    files = files or D.SOURCE_FILES
    for table, df in raw.items():
        (
            df.select(*raw_columns(table))
            .write.options(header="true", quote='"', escape='"')
            .mode("errorifexists")
            .csv(f"{folder.rstrip('/')}/{files[table]}")
        )
