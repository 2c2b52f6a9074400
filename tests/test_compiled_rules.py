"""Rows with very many rules or conversions stay in code that the JVM compiles."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from bazaarscope.functions import metrics as M
from bazaarscope.operators.tally import Key, Source, Tally
from bazaarscope.plans import cleaning
from bazaarscope.sources.model import SCHEMAS

TEXTS = [
    None, "", " ", "  \t", "a", " a", "a ", "a b", "\x1c", "\x1fa", "é", " é", "é ", " ", " x",
    "ab\n", "\n", "x" * 50 + " ", "~", "!", "\x7f", "日本 ",
]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_methods_beyond_the_compilers_limit_are_split(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_elements_need_no_generator_and_leave_nothing_out(spark):
    rows = spark.createDataFrame([(1, None, 2.5), (1, 7, None), (3, 7, 2.5), (3, 7, 4.0)], "a int, b int, v double")
    source = Source(
        "t", rows, [("b missing", F.col("b").isNull())],
        [Key("a", [F.col("a")]), Key("b", [F.col("b")], slot=1, skip_null=True),
         Key("late", [F.col("a")], where=F.col("a") > 1)],
        [("t.v", F.col("v"))],
    )
    tally = Tally([source])
    assert "Generate" not in _plan(tally._elements(source))
    # four sets of rules, four a, three b, two late, three values
    assert tally._elements(source).count() == 16
    found = {(r.topic, r.item, r.value): r for r in tally.summary().collect()}
    assert found["t", "*", None].rows_0 == 4 and found["t", "b missing", None].rows_0 == 1
    assert (found["a", "", None].distinct_0, found["b", "", None].rows_1, found["late", "", None].rows_0) == (2, 3, 2)
    assert (found["t.v", "", 2.5].rows_0, found["t.v", "", 4.0].rows_0) == (2, 1)


def test_untidiness_is_what_the_single_tests_say(spark):
    rows = spark.createDataFrame([Row(t=t) for t in TEXTS], "t string")
    t = F.col("t")
    apart = (
        F.when(t.isNull(), 1).when(t == "", 2).when(t.rlike(rf"(?U)^{M.SPACES}+$"), 12)
        .when(t.rlike(rf"(?U)^{M.SPACES}|{M.SPACES}$"), 8).otherwise(0)
    )
    number = M.untidiness(t, null=1, empty=2, blank=12, padded=8)
    assert rows.where(~number.eqNullSafe(apart)).collect() == []
    bare = F.regexp_replace(t, rf"(?U)^{M.SPACES}+|{M.SPACES}+$", "")
    assert rows.where(~M.stripped(t).eqNullSafe(bare)).collect() == []
    assert _plan(rows.select(number.alias("n"))).count("substring") <= 4  # the ends are looked at once


def test_a_cell_is_converted_once(spark):
    field = next(f for f in SCHEMAS["orders"].fields if f.name == "order_approved_at")
    cells = spark.createDataFrame([("2020-02-29 01:02:03",), (None,)], "order_approved_at string")
    found = cells.repartition(1).select(cleaning._strict("orders", field))
    assert _plan(found).count("gettimestamp(") == 1
    assert sorted(str(r[0]) for r in found.collect()) == ["2020-02-29 01:02:03", "None"]


def test_merged_partitions_stay_small(spark):
    spark.range(1).count()
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_numbers_behind_a_point_are_neither_decimals_nor_failed_casts(spark):
    field = next(f for f in SCHEMAS["products"].fields if f.name == "product_weight_g")
    texts = [
        None, "", " ", "7", " 7 ", "+7", "-7", "007", "7.", "7.0", "-7.000", "+0.0", ".0", "7.5", "7.05",
        "1.2.0", "1 .0", " 7.0", "7.0\n", "7.0 ", "\x7f7.0", "7e2", "7e2.0", "7.0e1", "x.0", "-.0", "٧.0",
        "999999999.0", "2147483647.0", "2147483648.0", "12345678901.0", "7." + "0" * 30, "7." + "0" * 17 + "1",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "product_weight_g string")
    text = F.col("product_weight_g")
    looked_at = F.coalesce(
        text.try_cast("int"), F.when(cleaning._is_whole(text), cleaning._exact(text)).try_cast("int")
    )
    found = rows.select(text, cleaning._parsed("products", field).alias("is"), looked_at.alias("was")).collect()
    assert [r for r in found if r["is"] != r.was] == []
    assert {r[0]: r["is"] for r in found}["-7.000"] == -7
    # a text with a point never reaches the cast that fails with an exception
    plan = _plan(rows.select(cleaning._parsed("products", field)))
    assert "NOT Contains(product_weight_g" in plan


def test_plain_zip_prefixes_are_only_padded(spark):
    field = next(f for f in SCHEMAS["sellers"].fields if f.name == "seller_zip_code_prefix")
    texts = [None, "", "0", "1", "01", "12345", "00012", "123456", " 12", "12 ", "12\n", "12.0", "-1", "+3", "1e2", "١"]
    rows = spark.createDataFrame([(t,) for t in texts], "seller_zip_code_prefix string")
    text = F.col("seller_zip_code_prefix")
    whole = cleaning._is_whole(text) & cleaning._exact(text).between(0, 99999)
    padded = F.when(whole, F.lpad(cleaning._exact(text).cast("int").cast("string"), 5, "0"))
    found = rows.select(text, cleaning._parsed("sellers", field).alias("is"), padded.alias("was")).collect()
    assert [r for r in found if r["is"] != r.was] == []
    assert {r[0]: r["is"] for r in found}["12.0"] == "00012"
    assert "[0-9]{1,5}" in _plan(rows.select(cleaning._parsed("sellers", field)))
