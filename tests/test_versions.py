"""Staged loads: whole or not at all, resumed, repeated, appended; ids that stay."""

import pytest

from bazaarscope.plans import load_checks
from bazaarscope.sources import sink, versions
from bazaarscope.sources.model import SCHEMAS
from tests.market import customer, item, market, one, order, seller

PLACE = ("01000", -23.5, -46.6, "sao paulo", "SP")


def shop(spark, n, places=(PLACE,)):
    return market(
        spark, orders=[order(f"o{n}")], order_items=[item(f"o{n}")], customers=[customer(f"c{n}")],
        sellers=[seller(f"s{n}")], geolocation=list(places),
    )


def ids_of(spark, folder):
    rows = versions.read(spark, folder).geolocation.collect()
    return {r.geolocation_zip_code_prefix: r.geolocation_id for r in rows}


def test_a_load_that_stops_is_published_only_after_it_went_on(spark, tmp_path, monkeypatch):
    folder, real, written = str(tmp_path), versions._stage, []

    def stage(spark_, rows, path, table):
        if len(written) == 4 and not resumed:
            raise OSError("executor lost")
        out = real(spark_, rows, path, table)
        written.append(table)
        return out

    monkeypatch.setattr(versions, "_stage", stage)
    resumed = False
    mk = shop(spark, 1)
    with pytest.raises(OSError):
        versions.load(mk, spark, folder, "first")
    with pytest.raises(sink.LoadError):
        versions.read(spark, folder)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "data" / "first").glob("*.done.json")}
    assert len(before) == 4
    resumed = True
    manifest = versions.load(mk, spark, folder, "first")
    assert manifest["version"] == 1 and len(versions.read(spark, folder).items()) == len(SCHEMAS)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # finished tables stay as they are
    assert {t: n for t, (n, _) in manifest["loads"][0]["tables"].items()}["orders"] == 1


def test_repeated_loads_change_nothing(spark, tmp_path):
    folder, mk = str(tmp_path), shop(spark, 1)
    first = versions.load(mk, spark, folder, "a")
    assert versions.load(mk, spark, folder, "a") == first
    assert versions.load(mk, spark, folder, "b") == first
    second = versions.load(shop(spark, 2), spark, folder, "c", append=True)
    assert second["version"] == 2
    assert versions.load(shop(spark, 2), spark, folder, "d", append=True) == second
    assert sorted(r.order_id for r in versions.read(spark, folder).orders.collect()) == ["o1", "o2"]
    assert versions.read(spark, folder, 1).orders.count() == 1


def test_ids_survive_appends_and_replacements(spark, tmp_path):
    folder = str(tmp_path)
    places = [(str(10000 + i), float(i), -1.0, None if i % 2 else "x", "SP") for i in range(20)]
    versions.load(shop(spark, 1, places[:8] + places[:3]), spark, folder, "a")
    first = ids_of(spark, folder)
    assert sorted(first.values()) == list(range(1, 9))
    versions.load(shop(spark, 2, places[5:12]), spark, folder, "b", append=True)
    second = ids_of(spark, folder)
    assert first.items() <= second.items() and sorted(second.values()) == list(range(1, 13))
    manifest = versions.load(shop(spark, 3, places[10:]), spark, folder, "c")
    third = ids_of(spark, folder)
    assert {k: second[k] for k in ("10010", "10011")}.items() <= third.items()
    assert sorted(third.values())[2:] == list(range(13, 21)) and manifest["highest_id"] == 20
    checks = one(versions.id_checks(versions.read(spark, folder).geolocation, 20))
    assert checks == {"rows": 10, "distinct_ids": 10, "rows_without_id": 0, "rows_sharing_an_id": 0,
                      "largest_id": 20, "above_highest": False}


def test_the_id_check_can_fail(spark):
    schema = "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, " \
             "geolocation_city string, geolocation_state string, geolocation_id long"
    rows = [(*PLACE, 1), (*PLACE[:4], "RJ", 1), (*PLACE[:4], "MG", None), (*PLACE[:4], "BA", 99)]
    stored = spark.createDataFrame(rows, schema)
    checks = one(versions.id_checks(stored, 4))
    assert (checks["rows_without_id"], checks["rows_sharing_an_id"], checks["above_highest"]) == (1, 2, True)
    found = {r.metric: r.actual_value for r in load_checks.geolocation(shop(spark, 1), stored).collect()}
    assert found["unique_geolocation_ids"] == 2 and found["geolocation_rows_sharing_an_id"] == 2
    wrong = load_checks.judged(
        load_checks.geolocation(shop(spark, 1), stored), {"geolocation_rows_sharing_an_id": 0})
    assert {r.status for r in wrong.collect() if r.metric == "geolocation_rows_sharing_an_id"} == {"FAIL"}
