"""Order statistics against plain Python, with ties and with one value on a third of rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaarscope.operators.ordered import (
    decimal_key,
    entities_for_shares,
    fine_bucket,
    histogram,
    ntile_totals,
    order_bucket,
    quantiles,
    running_totals,
)

_FEW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v bigint")


def samples():
    rng = random.Random(7)
    skewed = [rng.randrange(1, 10**6) for _ in range(400)] + [777] * 200
    return [
        [5],
        [3, 3, 3],
        [1, 2],
        list(range(1, 24)),
        [rng.randrange(1, 50) for _ in range(101)],
        skewed,
        [2**k for k in range(1, 40)] + [2**k - 1 for k in range(1, 40)],
    ]


def test_bucket_never_decreases_and_is_bounded(spark):
    rng = random.Random(1)
    edges = [s * (2**k + d) for k in range(0, 61) for d in (-1, 0, 1) for s in (1, -1)]
    values = sorted({*edges, *(rng.randrange(-(10**15), 10**15) for _ in range(2000)), 0})
    rows = frame(spark, values).select("v", order_bucket(F.col("v")).alias("b")).collect()
    buckets = [r.b for r in sorted(rows, key=lambda r: r.v)]
    assert buckets == sorted(buckets)
    assert max(buckets) - min(buckets) < 2**16 + 2


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("values", samples())
def test_running_totals(spark, values, descending):
    hist = histogram(frame(spark, values), "v")
    got = running_totals(
        hist, "v", F.col("v"), {"n": F.col("n"), "s": F.col("n") * F.col("v")},
        descending=descending,
    ).collect()
    assert len(got) == len(set(values))
    for row in got:
        before = [x for x in values if (x > row.v if descending else x < row.v)]
        assert (row.n_before, row.s_before) == (len(before), sum(before))
        assert (row.n_total, row.s_total) == (len(values), sum(values))


@pytest.mark.parametrize("values", samples())
def test_quantiles(spark, values):
    got = quantiles(
        histogram(frame(spark, values), "v"), "v", F.col("v"),
        linear={"q25": 25, "q50": 50}, nearest={"p90": 90, "p95": 95, "p100": 100},
    ).collect()[0]
    ordered = sorted(values)
    n = len(ordered)

    def linear(p):
        scaled = (n - 1) * p
        low, rest = divmod(scaled, 100)
        high = min(low + 1, n - 1)
        return ordered[low] + rest / 100 * (ordered[high] - ordered[low])

    def nearest(p):
        return ordered[-(-n * p // 100) - 1]

    assert got.q25 == pytest.approx(linear(25))
    assert got.q50 == pytest.approx(linear(50))
    assert (got.p90, got.p95, got.p100) == (nearest(90), nearest(95), nearest(100))


def test_quantiles_of_nothing_are_null(spark):
    got = quantiles(
        histogram(frame(spark, []), "v"), "v", F.col("v"), linear={"m": 50}, nearest={"p": 90}
    ).collect()[0]
    assert got.m is None and got.p is None


def brute_ntile(values, tiles):
    ordered = sorted(values)
    size, extra = divmod(len(ordered), tiles)
    out, start = {}, 0
    for tile in range(1, tiles + 1):
        end = start + size + (1 if tile <= extra else 0)
        part = ordered[start:end]
        if part:
            out[tile] = (len(part), part[0], part[-1], sum(part))
        start = end
    return out


@pytest.mark.parametrize("values", samples())
def test_ntile(spark, values):
    got = ntile_totals(frame(spark, values), "v", 10).collect()
    assert {
        r.tile: (r.rows, r.min_cents, r.max_cents, r.sum_cents) for r in got
    } == brute_ntile(values, 10)


@_FEW
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 12))
def test_ntile_any(spark, values, tiles):
    got = ntile_totals(frame(spark, values), "v", tiles).collect()
    assert {
        r.tile: (r.rows, r.min_cents, r.max_cents, r.sum_cents) for r in got
    } == brute_ntile(values, tiles)


def brute_share(values, percent):
    total, running = sum(values), 0
    for rank, v in enumerate(sorted(values, reverse=True), start=1):
        running += v
        if running * 100 >= total * percent:
            return rank
    return None


@pytest.mark.parametrize("values", samples())
def test_entities_for_shares(spark, values):
    got = entities_for_shares(frame(spark, values), "v", {"half": 50, "most": 80}).collect()[0]
    assert got.entities == len(values)
    assert got.half == brute_share(values, 50)
    assert got.most == brute_share(values, 80)


def test_groups_are_independent(spark):
    rows = [("a", v) for v in (1, 2, 3)] + [("b", v) for v in (10, 10, 10, 10)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    got = {r.g: r for r in entities_for_shares(df, "v", {"half": 50}, ["g"]).collect()}
    assert (got["a"].entities, got["a"].half) == (3, 1)
    assert (got["b"].entities, got["b"].half) == (4, 2)


def test_narrow_doubles_spread_over_buckets(spark):
    values = spark.range(100_000).select((F.lit(23.5) + F.col("id") * 8e-7).alias("v"))
    key = decimal_key(F.col("v"))
    sizes = values.groupBy(order_bucket(key), fine_bucket(key)).count().agg(
        F.max("count"), F.count("*")).first()
    assert sizes[0] < 2_000 and sizes[1] > 100
    got = quantiles(histogram(values, "v"), "v", key, linear={"median": 50}).first()
    assert got.median == pytest.approx(23.5 + 49_999.5 * 8e-7, abs=1e-12)
