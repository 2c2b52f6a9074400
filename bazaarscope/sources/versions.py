"""Versions of the nine tables: staged loads, one manifest that publishes all of them, appends.

A load writes every table below ``data/<load>/<table>`` first. Nothing reads these folders until a
manifest names them, and one manifest names the folders of all tables, so readers see a load
whole or not at all. A load that dies is started again under its name and goes on with the
tables it had not finished. A load whose content is already published changes nothing.

Geolocation rows get ids that stay: a row that was loaded before keeps its id, new rows get the
next ones behind the highest id ever given, which the manifest remembers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarscope.functions import domain as D
from bazaarscope.operators.keys import dense_ids
from bazaarscope.operators.tally import digest
from bazaarscope.sources import sink
from bazaarscope.sources.model import SCHEMAS, Marketplace
from bazaarscope.sources.raw_csv import _exists

GEO_ID = "geolocation_id"
EMPTY = {"version": 0, "tables": {t: [] for t in D.LOAD_ORDER}, "loads": [], "highest_id": 0}


# -- small files ---------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written beside and renamed, so that it is there whole or not at all; never replaced."""
    fs, target = _fs(spark, path)
    beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")[1]
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(beside, target):
        fs.delete(beside, False)
        raise sink.LoadError(f"another load has written {path}")


def _read_json(spark: SparkSession, path: str) -> dict:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def _manifest_path(folder: str, version: int) -> str:
    return f"{folder.rstrip('/')}/manifests/{version:09d}.json"


def current(spark: SparkSession, folder: str) -> dict:
    """The latest manifest; ``EMPTY`` before the first load."""
    fs, target = _fs(spark, f"{folder.rstrip('/')}/manifests")
    if not fs.exists(target):
        return EMPTY
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    versions = [int(n[:9]) for n in names if n.endswith(".json") and len(n) == 14]
    return _read_json(spark, _manifest_path(folder, max(versions))) if versions else EMPTY


# -- ids -------------------------------------------------------------------------------------
def _matching() -> list[Column]:
    first, second = digest([F.col(f.name) for f in SCHEMAS["geolocation"].fields])
    return [first.alias("d1"), second.alias("d2")]


def with_stable_ids(rows: DataFrame, known: DataFrame | None, highest: int) -> DataFrame:
    """Distinct geolocation rows with their id; rows of ``known`` keep theirs.

    Of a row that ``known`` holds several times, the least id counts.
    """
    names = [f.name for f in SCHEMAS["geolocation"].fields]
    rows = rows.select(*names).dropDuplicates()
    if known is None:
        return dense_ids(rows, GEO_ID).withColumn(GEO_ID, F.col(GEO_ID) + highest).select(*names, GEO_ID)
    ids = known.select(GEO_ID, *_matching()).groupBy("d1", "d2").agg(F.min(GEO_ID).alias(GEO_ID))
    keyed = rows.select("*", *_matching())
    old = keyed.join(ids, ["d1", "d2"]).select(*names, GEO_ID)
    fresh = keyed.join(ids, ["d1", "d2"], "left_anti").select(*names)
    new = dense_ids(fresh, GEO_ID).withColumn(GEO_ID, F.col(GEO_ID) + highest)
    return old.unionByName(new)


def id_checks(stored: DataFrame, highest: int | None = None) -> DataFrame:
    """One row about the stored ids: rows, distinct ids, rows without id, rows that share an id,
    the largest id, and whether it is above the highest id ever given."""
    per_id = stored.groupBy(GEO_ID).agg(F.count("*").alias("n"))
    n = F.col("n")
    missing = F.col(GEO_ID).isNull()
    above = F.coalesce(F.max(GEO_ID) > F.lit(highest), F.lit(False)) if highest is not None else F.lit(False)
    return per_id.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
        F.count(GEO_ID).alias("distinct_ids"),
        F.coalesce(F.sum(F.when(missing, n)), F.lit(0)).alias("rows_without_id"),
        F.coalesce(F.sum(F.when(~missing & (n > 1), n)), F.lit(0)).alias("rows_sharing_an_id"),
        F.max(GEO_ID).alias("largest_id"),
        above.alias("above_highest"),
    )


# -- loads -----------------------------------------------------------------------------------
def _stage(spark: SparkSession, rows: DataFrame, path: str, table: str) -> list:
    """Write a table unless a finished copy is there; its number of rows and content hash."""
    note = f"{path}.done.json"
    if not _exists(spark, note):
        # what an interrupted write has left is not finished and is replaced
        rows.write.mode("overwrite").parquet(path)
        found = spark.read.schema(rows.schema).parquet(path).agg(*sink._contents(table)).first()
        _write_json(spark, note, {"rows": found["n"], "hash": found["h"]})
    done = _read_json(spark, note)
    return [done["rows"], done["hash"]]


def load(tables: Marketplace, spark: SparkSession, folder: str, name: str, append: bool = False) -> dict:
    """Load the tables under a name and publish them together; returns the manifest in force.

    Without ``append`` the new tables take the place of the old ones, which stay readable under
    their version. Starting a load again under its name goes on where it stopped.
    """
    folder = folder.rstrip("/")
    sink._check_columns(tables)
    before = current(spark, folder)
    if any(load["name"] == name for load in before["loads"]):
        return before
    known = _read(spark, folder, before, "geolocation")
    staged, paths = {}, {}
    for table in D.LOAD_ORDER:
        rows = tables[table].select(*[f.name for f in SCHEMAS[table].fields])
        if table == "geolocation":
            rows = with_stable_ids(rows, known, before["highest_id"])
            if append and known is not None:  # known rows are there already
                rows = rows.where(F.col(GEO_ID) > before["highest_id"])
        paths[table] = f"data/{name}/{table}"
        staged[table] = _stage(spark, rows, f"{folder}/{paths[table]}", table)
    mine = {"name": name, "append": append, "tables": staged}
    if _already_published(before, mine):
        return before
    ids = spark.read.parquet(f"{folder}/{paths['geolocation']}").agg(F.max(GEO_ID)).first()[0] or 0
    after = {
        "version": before["version"] + 1,
        "tables": {t: [*(before["tables"][t] if append else []), paths[t]] for t in D.LOAD_ORDER},
        "loads": [*(before["loads"] if append else []), mine],
        "highest_id": max(before["highest_id"], ids),
    }
    _write_json(spark, _manifest_path(folder, after["version"]), after)
    return after


def _already_published(before: dict, mine: dict) -> bool:
    """The same content is in force: as the whole, or as one of the loads appended so far.

    An appended geolocation table holds new rows only, so a repeated one is empty and is not compared.
    """
    def content(load: dict) -> dict:
        return {t: x for t, x in load["tables"].items() if t != "geolocation"}

    if mine["append"]:
        nothing_new = mine["tables"]["geolocation"][0] == 0
        return nothing_new and any(content(load) == content(mine) for load in before["loads"])
    return len(before["loads"]) == 1 and before["loads"][0]["tables"] == mine["tables"]


def _read(spark: SparkSession, folder: str, manifest: dict, table: str) -> DataFrame | None:
    paths = [f"{folder}/{p}" for p in manifest["tables"][table]]
    return spark.read.parquet(*paths) if paths else None


def read(spark: SparkSession, folder: str, version: int | None = None) -> Marketplace:
    """The tables of a version, the latest by default; geolocation has its stored ids."""
    folder = folder.rstrip("/")
    manifest = current(spark, folder) if version is None else _read_json(spark, _manifest_path(folder, version))
    if not manifest["version"]:
        raise sink.LoadError(f"nothing is published in {folder}")
    return Marketplace({t: (lambda t=t: _read(spark, folder, manifest, t)) for t in D.LOAD_ORDER})
