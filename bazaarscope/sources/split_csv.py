"""CSV files whose quoted cells hold line breaks, read by many tasks.

Spark reads such a file with one task, as a byte range does not tell whether it begins inside
quotes. Here the file is read as lines, in as many splits as any text file, and the quotes decide
afterwards: a cell is open where an odd number of quotes lies before it, and a doubled quote
counts twice and changes nothing. Per split only that parity is needed of all splits before it.

1. Each split gives the parity of its quotes; running sums over the splits of a file (one row a
   split) tell which splits begin inside a cell.
2. Running sums over the lines of a split mark those that begin a record; the other lines belong to
   the record above. This is the only shuffle of the text, by split.
3. What a split has of a record of an earlier split, and its own unfinished last record, are at
   most two pieces a split; they are put together in the order of the splits.
4. Records are parsed by Spark.

Quotes must only open, close or be doubled, as in all CSV. A file that ends inside quotes, a record
with more or fewer fields than the table has, or a header with other names stops the job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
_SPLIT = ("file", "start")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files with their split, their place in it and their quotes."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        c("_metadata.file_path").alias("file"),
        c("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        c("value").alias("line"),
        (F.length("value") - F.length(F.replace(c("value"), F.lit('"'), F.lit("")))).alias("quotes"),
    )


def _opened(lines: DataFrame) -> DataFrame:
    """Per split, whether it begins inside a quoted cell."""
    parity = lines.groupBy(*_SPLIT).agg((F.sum("quotes") % 2).alias("odd"), F.min("place").alias("low"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("odd").over(earlier), F.lit(0))
    return parity.select(*_SPLIT, "low", before.alias("before"))


def _joined_lines(place: str) -> Column:
    """The collected lines of a group in their order."""
    pieces = F.sort_array(F.collect_list(F.struct(place, "line")))
    return F.array_join(F.transform(pieces, lambda p: p["line"]), "\n").alias("line")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, is_head`` per record of the files, line breaks in quotes included; the first
    record of a file is its head."""
    lines = _lines(spark, path)
    order = Window.partitionBy(*_SPLIT).orderBy("place")
    above = F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.join(_opened(lines), list(_SPLIT)).withColumn(
        "begins", (F.coalesce(above, F.lit(0)) + c("before")) % 2 == 0
    )
    first = F.max(F.when(c("begins"), c("place"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    pieces = (
        marked.withColumn("record", first)
        .groupBy(*_SPLIT, "record")
        .agg(
            _joined_lines("place"),
            (F.sum("quotes") % 2 == 1).alias("odd"),
            F.bool_or((c("start") == 0) & (c("place") == c("low"))).alias("is_head"),
        )
    )
    # the rest of an earlier split's record has no first line here
    rest = c("record").isNull()
    whole = pieces.where(~rest & ~c("odd")).select("file", "line", "is_head")
    by_split = Window.partitionBy("file").orderBy("start", c("record").asc_nulls_first())
    begun = F.max(F.when(~rest, c("start"))).over(by_split.rowsBetween(Window.unboundedPreceding, 0))
    cut = pieces.where(rest | c("odd")).withColumn("begun", begun)
    mended = cut.groupBy("file", "begun").agg(
        _joined_lines("start"),
        (F.sum(c("odd").cast("int")) % 2 == 1).alias("open"),
        F.bool_or("is_head").alias("is_head"),
    )
    failed = F.raise_error(F.concat(F.lit("a quoted cell is not closed in "), c("file")))
    mended = mended.select("file", F.when(c("open"), failed).otherwise(c("line")).alias("line"), "is_head")
    return whole.unionByName(mended)


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """The rows of CSV files with a header line, all columns as text."""
    rows = records(spark, path)
    bare = F.regexp_replace("line", "\r$", "")
    bare = F.when(c("is_head"), F.regexp_replace(bare, "^\ufeff", "")).otherwise(bare)
    kept = {k: v for k, v in options.items() if k in ("quote", "escape", "mode")}
    ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
    cells = F.from_csv("bare", ddl, {**kept, "multiLine": "true"})
    rows = rows.select("is_head", "file", bare.alias("bare")).where(F.length("bare") > 0)
    rows = rows.select("is_head", "file", cells.alias("cells"))
    names = F.struct(*(F.lit(f.name).alias(f.name) for f in schema.fields))
    wrong = F.raise_error(F.concat(F.lit("the header differs from the declared names in "), c("file")))
    body = F.when(c("is_head") & ~c("cells").eqNullSafe(names), wrong.cast("boolean")).otherwise(~c("is_head"))
    return rows.where(body).select("cells.*")
