"""The tally of rules, keys and values against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bazaarscope.operators import tally
from bazaarscope.operators.keys import duplicate_profile
from bazaarscope.operators.profile import distinct_counts, when_one_value
from bazaarscope.operators.tally import Key, Source, Tally

c = F.col


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(4)
    # a third of all children refer to one parent
    parents = [(rng.choice([None, *range(50)]), rng.choice(["x", None, " y "])) for _ in range(120)]
    children = [(7 if i % 3 == 0 else rng.choice([None, *range(40, 80)]), rng.choice([1.5, None, 2.0])) for i in range(300)]
    p = spark.createDataFrame(parents, "k int, t string")
    q = spark.createDataFrame(children, "k int, v double")
    sources = [
        Source("parents", p, [("no key", c("k").isNull()), (("a", "b"), F.when(c("t") == "x", 1).when(c("t").isNull(), 3)),
                              ("last", c("t") == " y ")],
               [Key("k", [c("k")]), Key("row", [c("k"), c("t")])]),
        Source("children", q, [("unknown", c("v") > 1.7)], [Key("k", [c("k")], 1, skip_null=True),
                                                            Key("odd", [c("k")], where=c("k") % 2 == 1)],
               [("v", c("v"))], weight=F.lit(2)),
    ]
    summary = Tally(sources).summary().cache()
    counts = {tuple(r)[:3]: r.n for r in tally.counts(summary).collect()}
    return parents, children, counts, tally.histogram(summary).collect()


def test_rules(found):
    parents, children, counts, _ = found
    assert counts["parents", "*", "rows"] == 120 and counts["children", "*", "rows"] == 600
    assert counts["parents", "no key", "rows"] == sum(k is None for k, _ in parents)
    x, null = (sum(t == y for _, t in parents) for y in ("x", None))
    assert (counts["parents", "a", "rows"], counts["parents", "b", "rows"]) == (x + null, null)
    assert counts["parents", "last", "rows"] == 120 - x - null
    assert counts["children", "unknown", "rows"] == 2 * sum(v == 2.0 for _, v in children)


def test_keys(found):
    parents, children, counts, _ = found
    up, down = Counter(k for k, _ in parents), Counter(k for k, _ in children if k is not None)
    assert counts["k", "0", "distinct"] == len(up) and counts["k", "1", "rows"] == 2 * sum(down.values())
    assert counts["k", "0", "repeated_rows"] == sum(n for n in up.values() if n > 1)
    assert counts["k", "1", "largest"] == 2 * max(down.values())
    assert counts["k", "1", "orphan_rows"] == 2 * sum(n for k, n in down.items() if k not in up)
    assert counts["k", "1", "orphans"] == sum(k not in up for k in down)
    assert counts["k", "1", "childless"] == sum(n for k, n in up.items() if k not in down)
    assert counts["row", "0", "distinct"] == len(set(parents))
    assert counts["odd", "0", "distinct"] == len({k for k in down if k % 2})


def test_histogram(found):
    _, children, _, hist = found
    assert {r.value: r.n for r in hist} == {v: 2 * n for v, n in Counter(v for _, v in children if v is not None).items()}
    assert {r.topic for r in hist} == {"v"}


def test_no_rows_and_too_many_rules(spark):
    empty = spark.createDataFrame([], "k int")
    summary = Tally([Source("s", empty, [("r", c("k") == 1)], [Key("k", [c("k")])])]).summary()
    assert tally.counts(summary.cache()).collect() == []
    with pytest.raises(ValueError):
        tally.bits([(str(i), c("k") == i) for i in range(63)])


def test_profiles_by_digest(spark):
    """NULL, empty and shifted cells are different rows; equal ones are copies."""
    rows = [("a", None), (None, "a"), ("", None), (None, None), (None, None), ("a", None), ("x" * 5000, "y")]
    df = spark.createDataFrame(rows, "s string, t string")
    found = duplicate_profile(df).first()
    assert (found.total_rows, found.duplicate_groups, found.rows_in_duplicate_groups, found.excess_duplicate_rows) == (7, 2, 4, 2)
    columns = {r.column_name: (r.non_null_count, r.null_count, r.unique_values) for r in distinct_counts(df).collect()}
    assert columns == {"s": (4, 3, 3), "t": (2, 5, 2)}
    collided = spark.createDataFrame([(1, 2, 3)], "low long, high long, n long").select(when_one_value(c("n")))
    with pytest.raises(Exception, match="share a digest"):
        collided.collect()
