"""A refresh of changed months gives what a full build gives."""

from datetime import timedelta

import pytest

from bazaarscope.functions.periods import PUBLISHED
from bazaarscope.plans import facts, refresh
from tests.market import DAY0, customer, item, market, order, payment, product, review, seller

APRIL, MAY, JUNE, JULY = (DAY0 + timedelta(days=d) for d in (31, 61, 92, 122))


def rows_before():
    return {
        "orders": [order("o1", "c1"), order("o2", "c2", bought=APRIL), order("o3", "c2", bought=MAY),
                   order("o4", "c1", bought=JUNE)],
        "customers": [customer("c1"), customer("c2")],
        "sellers": [seller("s1")],
        "products": [product("p1", "a"), product("p2", "b")],
        "category_translation": [("a", "alpha"), ("b", "beta")],
        "order_items": [item("o1"), item("o2"), item("o3", product="p2"), item("o4", 1), item("o4", 2)],
        "payments": [payment(f"o{n}") for n in (1, 2, 3, 4)],
        "reviews": [review("r1", "o1")],
    }


def changed(spark, **other):
    return market(spark, **{**rows_before(), **other})


def replaced(rows, old, new):
    return [new if r == old else r for r in rows]


BEFORE = rows_before()
CHANGES = {
    # a new order, and a month of its own
    "order": ({"orders": [*BEFORE["orders"], order("o5", "c1", bought=JULY)]}, ["2017-07"]),
    # an order that leaves its month empty
    "moved": ({"orders": replaced(BEFORE["orders"], BEFORE["orders"][2], order("o3", "c2", bought=JUNE))},
              ["2017-05", "2017-06"]),
    "item gone": ({"order_items": BEFORE["order_items"][:-1]}, ["2017-06"]),
    "repeated item row": ({"order_items": [*BEFORE["order_items"], item("o4", 2)]}, ["2017-06"]),
    "payment": ({"payments": [*BEFORE["payments"], payment("o2", 2, "voucher")]}, ["2017-04"]),
    "review": ({"reviews": [review("r1", "o1", 2)]}, ["2017-03"]),
    "customer": ({"customers": [customer("c1"), customer("c2", state="RJ")]}, ["2017-04", "2017-05"]),
    "product": ({"products": [product("p1", "a"), product("p2")]}, ["2017-05"]),
    "translation": ({"category_translation": [("a", "other"), ("b", "beta")]}, ["2017-03", "2017-04", "2017-06"]),
    "no date": ({"orders": [*BEFORE["orders"], ("o6", "c1", "created", None, None, None, None, None)]}, ["none"]),
    "weight only": ({"products": [product("p1", "a", weight=7), product("p2", "b")]}, []),
    "nothing": ({}, []),
}


def same(one, two):
    return one.columns == two.columns and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


@pytest.mark.parametrize("name", CHANGES)
def test_months_that_a_change_reaches(spark, name):
    other, months = CHANGES[name]
    assert refresh.affected_months(changed(spark), changed(spark, **other)) == months


def test_a_chain_of_refreshes_equals_full_builds(spark, tmp_path):
    folder, state = str(tmp_path), changed(spark)
    refresh.refresh(None, state, PUBLISHED, spark, folder, "full")
    for name in ("moved", "customer", "no date", "nothing"):
        other, months = CHANGES[name]
        old, after = refresh.current(spark, folder), changed(spark, **other)
        # the state before differs from this one by two changes, but for the first
        touched = refresh.affected_months(state, after)
        manifest = refresh.refresh(state, after, PUBLISHED, spark, folder, name)
        assert manifest["version"] == old["version"] + 1 and set(months) <= set(touched)
        full, found = facts.Star.of(after, PUBLISHED), refresh.read(spark, folder)
        for table in facts.GRAINS:
            assert same(found[table], full[table]), (name, table)
        for fact in refresh.FACTS:
            kept = {m: p for m, p in old["months"][fact].items() if m not in touched}
            assert kept.items() <= manifest["months"][fact].items()
            assert all(f"data/{name}/" in p for m, p in manifest["months"][fact].items() if m in touched)
        assert refresh.refresh(state, after, PUBLISHED, spark, folder, name) == manifest
        state = after


def test_a_refresh_that_dies_changes_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    folder, before = str(tmp_path), changed(spark)
    refresh.refresh(None, before, PUBLISHED, spark, folder, "full")
    after = changed(spark, **CHANGES["payment"][0])
    with monkeypatch.context() as patched:
        patched.setattr(refresh.versions, "_write_json", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            refresh.refresh(before, after, PUBLISHED, spark, folder, "second")
    assert refresh.current(spark, folder)["version"] == 1
    assert refresh.read(spark, folder)["fact_payments"].count() == 4
    refresh.refresh(before, after, PUBLISHED, spark, folder, "second")
    assert refresh.read(spark, folder)["fact_payments"].count() == 5


def test_only_a_built_star_is_refreshed(spark, tmp_path):
    mk = changed(spark)
    with pytest.raises(ValueError):
        refresh.refresh(mk, mk, PUBLISHED, spark, str(tmp_path), "x")
    with pytest.raises(ValueError):
        refresh.read(spark, str(tmp_path))
