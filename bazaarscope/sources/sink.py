"""Writing the cleaned tables: guarded, parents before children, counted afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarscope.functions import domain as D
from bazaarscope.sources.model import SCHEMAS, Marketplace
from bazaarscope.sources.raw_csv import _exists


class LoadError(RuntimeError):
    """The target or the data is not in the state a load may start from."""


def _table_path(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{table}"


def _check_columns(tables: Marketplace) -> None:
    for table in D.LOAD_ORDER:
        expected = {f.name for f in SCHEMAS[table].fields}
        actual = set(tables[table].columns)
        if actual != expected:
            raise LoadError(
                f"column mismatch for {table}: missing {sorted(expected - actual)}, "
                f"unexpected {sorted(actual - expected)}"
            )
        if not types_match(tables[table].select(*[f.name for f in SCHEMAS[table].fields]), table):
            raise LoadError(f"type mismatch for {table}: {tables[table].schema.simpleString()}")


def check_before_load(tables: Marketplace, spark: SparkSession, folder: str) -> None:
    """Same columns and types as declared, and nothing in the target yet."""
    _check_columns(tables)
    occupied = [t for t in D.LOAD_ORDER if _exists(spark, _table_path(folder, t))]
    if occupied:
        raise LoadError(f"target is not empty: {occupied}")


def _contents(table: str) -> list[Column]:
    """Number of rows and an order-free sum of their hashes, repeated rows included."""
    columns = [f.name for f in SCHEMAS[table].fields]
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return [F.count("*").alias("n"), F.coalesce(total, F.lit(0)).cast("string").alias("h")]


def load(tables: Marketplace, spark: SparkSession, folder: str) -> DataFrame:
    """Write all tables as Parquet and compare what can be read back with what was written.

    Columns: table_name, expected_rows, loaded_rows, same_content, status. Rows and contents are
    observed while they are written, so cleaning runs once.
    """
    check_before_load(tables, spark, folder)
    expected = {}
    for table in D.LOAD_ORDER:
        seen = Observation()
        columns = [f.name for f in SCHEMAS[table].fields]
        tables[table].select(*columns).observe(seen, *_contents(table)).write.mode(
            "errorifexists"
        ).parquet(_table_path(folder, table))
        expected[table] = (F.lit(seen.get["n"]), F.lit(seen.get["h"]))
    return _compared(expected, read_loaded(spark, folder))


def read_loaded(spark: SparkSession, folder: str) -> Marketplace:
    return Marketplace({t: spark.read.parquet(_table_path(folder, t)) for t in D.LOAD_ORDER})


def load_counts(expected: Marketplace, loaded: Marketplace) -> DataFrame:
    """Rows and contents of two marketplaces side by side."""
    wanted = {}
    for table in D.LOAD_ORDER:
        both = expected[table].agg(*_contents(table)).select(F.struct("n", "h").alias("x")).scalar()
        wanted[table] = (both["n"], both["h"])
    return _compared(wanted, loaded)


def _compared(expected: dict[str, tuple[Column, Column]], loaded: Marketplace) -> DataFrame:
    parts = None
    for table, (rows, contents) in expected.items():
        row = loaded[table].agg(*_contents(table)).select(
            F.lit(table).alias("table_name"),
            rows.cast("bigint").alias("expected_rows"),
            F.col("n").alias("loaded_rows"),
            (F.col("h") == contents).alias("same_content"),
        )
        parts = row if parts is None else parts.unionByName(row)
    passed = (F.col("expected_rows") == F.col("loaded_rows")) & F.col("same_content")
    return parts.withColumn("status", F.when(passed, "PASS").otherwise("FAIL"))


def assert_loaded(counts: DataFrame) -> None:
    """Raise when a table lost, gained or changed rows; the report has one row per table."""
    failed = [r.table_name for r in counts.filter(F.col("status") == "FAIL").collect()]
    if failed:
        raise LoadError(f"rows differ after load: {failed}")


def append_jdbc(
    tables: Marketplace,
    url: str,
    properties: dict[str, str],
    batch_size: int = 5000,
    partitions: int | None = None,
) -> None:
    """Append the tables to an existing relational schema; credentials come from the caller.

    ``partitions`` bounds the number of parallel connections; cleaning itself keeps its own
    parallelism. The columns are checked first.
    """
    _check_columns(tables)
    for table in D.LOAD_ORDER:
        df = tables[table].select(*[f.name for f in SCHEMAS[table].fields])
        if partitions:
            df = df.repartition(partitions)
        df.write.option("batchsize", batch_size).jdbc(
            url, table, mode="append", properties=properties
        )


def types_match(df: DataFrame, table: str) -> bool:
    """Whether a cleaned table has the declared names, order and types, scales included.

    The test tables keep integer ids, so a bigint may stand where text is declared.
    """

    def fits(actual: T.DataType, declared: T.DataType) -> bool:
        is_id = isinstance(declared, T.StringType) and isinstance(actual, T.LongType)
        return actual == declared or is_id

    pairs = list(zip(df.schema.fields, SCHEMAS[table].fields, strict=False))
    return len(df.columns) == len(pairs) == len(SCHEMAS[table].fields) and all(
        a.name == b.name and fits(a.dataType, b.dataType) for a, b in pairs
    )
