"""Plans of very many rules per row keep their conversions in one place."""

from bazaarscope.plans import quarantine
from bazaarscope.sources import bindings


def test_filter_on_broken_rules_does_not_repeat_the_conversions(spark, sf_dir):
    raw = bindings.bind_raw(spark, sf_dir)
    rows = quarantine.report(raw, ["orders"], bindings.SHIPPING_LIMIT_FROM)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # five timestamps, each converted once; they stood 15 times more in a filter above the scan
    assert plan.lower().count("gettimestamp(") == 5
