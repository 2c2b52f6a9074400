"""Raw CSV files to cleaned tables, and loading them."""

import pytest

from bazaarscope.functions import domain as D
from bazaarscope.plans import cleaning, register
from bazaarscope.sources import sink
from bazaarscope.sources.model import SCHEMAS
from bazaarscope.sources.raw_csv import read_raw
from tests.market import by

FILES = {
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,"
                 "customer_state\n"
                 'c1,u1,1037,"  sao paulo \t",SP\nc2,u1,99999,rio,RJ\n',
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
              "order_delivered_carrier_date,order_delivered_customer_date,"
              "order_estimated_delivery_date\n"
              "o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,,2017-10-10 21:25:13,"
              "2017-10-18 00:00:00\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,"
                   "freight_value\no1,1,p1,s1,2017-09-19 09:45:35,58.90,13.29\n",
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                "o1,1, credit_card ,8,99.33\n",
    "reviews": "review_id,order_id,review_score,review_comment_title,review_comment_message,"
               "review_creation_date,review_answer_timestamp\n"
               'r1,o1,4,"   ","first line\nsecond ""quoted"" line ",2018-01-18 00:00:00,'
               "2018-01-18 21:46:59\n",
    "products": "product_id,product_category_name,product_name_lenght,product_description_lenght,"
                "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,"
                "product_width_cm\np1,perfumaria,40.0,287.0,1.0,225.0,16.0,10.0,14.0\n"
                "p2,,,,,,,,\n",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,13023,campinas,SP\n",
    "geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,"
                   "geolocation_state\n1037,-23.5,-46.6,sao paulo,SP\n"
                   "1037,-23.5,-46.6,sao paulo,SP\n1037,-23.5,-46.6,são paulo,SP\n",
    "category_translation": "product_category_name,product_category_name_english\n"
                            "perfumaria,perfumery\n",
}


def write(folder, **changed):
    for table, text in {**FILES, **changed}.items():
        if text is not None:
            (folder / D.SOURCE_FILES[table]).write_text(text, encoding="utf-8")
    return str(folder)


@pytest.fixture
def raw(spark, tmp_path):
    return read_raw(spark, write(tmp_path))


def test_values(spark, raw):
    mk = cleaning.clean(raw)
    people = by(mk.customers, "customer_id")
    assert people["c1"]["customer_zip_code_prefix"] == "01037"
    assert people["c1"]["customer_city"] == "sao paulo"
    (review,) = mk.reviews.collect()
    assert review.review_comment_title is None
    assert review.review_comment_message == 'first line\nsecond "quoted" line'
    (order,) = mk.orders.collect()
    assert order.order_delivered_carrier_date is None
    assert str(order.order_purchase_timestamp) == "2017-10-02 10:56:33"
    products = by(mk.products, "product_id")
    assert products["p1"]["product_name_length"] == 40
    assert products["p2"]["product_weight_g"] is None
    assert mk.payments.collect()[0].payment_type == "credit_card"
    assert mk.geolocation.count() == 2
    for table in SCHEMAS:
        assert sink.types_match(mk[table], table), table


def test_missing_files_are_listed(spark, tmp_path):
    folder = write(tmp_path, orders=None, sellers=None)
    with pytest.raises(FileNotFoundError) as error:
        read_raw(spark, folder)
    assert D.SOURCE_FILES["orders"] in str(error.value)
    assert D.SOURCE_FILES["sellers"] in str(error.value)
    assert D.SOURCE_FILES["customers"] not in str(error.value)


def test_unexpected_and_missing_tables_are_refused(raw):
    from bazaarscope.sources.model import Marketplace

    tables = {t: raw[t] for t in SCHEMAS}
    with pytest.raises(KeyError):
        Marketplace({k: v for k, v in tables.items() if k != "orders"})
    with pytest.raises(KeyError):
        Marketplace({**tables, "extra": raw.orders})


def test_misspelt_columns_must_exist(raw):
    with pytest.raises(KeyError):
        cleaning.renamed(raw.products.withColumnsRenamed(D.RENAMED_COLUMNS))


@pytest.mark.parametrize(
    ("table", "good", "bad"),
    [
        ("orders", "2017-10-02 10:56:33", "2017-10-02T10:56"),
        ("customers", "99999", "100000"),
        ("customers", "99999", "12.5"),
        ("customers", "99999", "abc"),
        ("products", "225.0", "225.5"),
    ],
)
def test_values_that_do_not_convert_stop_the_job(spark, tmp_path, table, good, bad):
    raw = read_raw(spark, write(tmp_path, **{table: FILES[table].replace(good, bad)}))
    with pytest.raises(Exception, match="cannot be converted"):
        cleaning.clean(raw)[table].collect()
    failures = cleaning.violations(raw).filter("failures > 0").collect()
    assert [(r.table_name, r.failures) for r in failures] == [(table, 1)]


def test_change_summary(raw):
    changes = {
        (r.table_name, r.column_name): r for r in cleaning.change_summary(raw).collect()
    }
    city = changes[("customers", "customer_city")]
    assert (city.values_changed, city.blank_to_missing) == (1, 0)
    title = changes[("reviews", "review_comment_title")]
    assert (title.blank_to_missing, title.missing_before, title.missing_after) == (1, 0, 1)
    assert changes[("customers", "customer_zip_code_prefix")].values_changed == 1
    removed = cleaning.duplicate_removal(raw).collect()[0]
    assert (removed.rows_before, removed.rows_removed, removed.rows_after) == (3, 1, 2)


def test_assertions_and_readiness(raw):
    mk = cleaning.clean(raw)
    cleaning.assert_clean(raw, mk)
    entries = register.register(raw, mk)
    gate = register.readiness(entries).collect()[0]
    assert gate.critical_failures == 0
    assert gate.database_readiness == "Ready with documented limitations"
    register.require_ready(entries)


def test_orphans_make_it_not_ready(spark, tmp_path):
    broken = FILES["payments"].replace("o1,1,", "o9,1,")
    raw = read_raw(spark, write(tmp_path, payments=broken))
    entries = register.register(raw, cleaning.clean(raw))
    gate = register.readiness(entries).collect()[0]
    assert (gate.critical_failures, gate.database_readiness) == (1, "Not ready")
    with pytest.raises(AssertionError, match="payments"):
        register.require_ready(entries)
    first = register.in_report_order(entries).collect()[0]
    assert (first.severity, first.result) == ("Critical", "Failed")


def test_load_and_its_guards(spark, raw, tmp_path):
    mk = cleaning.clean(raw)
    folder = str(tmp_path / "target")
    counts = sink.load(mk, spark, folder)
    sink.assert_loaded(counts)
    assert by(counts, "table_name")["geolocation"]["loaded_rows"] == 2
    assert spark.read.parquet(f"{folder}/orders").schema["order_purchase_timestamp"].dataType == (
        SCHEMAS["orders"]["order_purchase_timestamp"].dataType
    )
    with pytest.raises(sink.LoadError, match="not empty"):
        sink.load(mk, spark, folder)
    narrow = mk.replaced(orders=mk.orders.drop("order_status"))
    with pytest.raises(sink.LoadError, match="order_status"):
        sink.check_before_load(narrow, spark, str(tmp_path / "other"))


SELLERS = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"


@pytest.mark.parametrize("row", ["s1,13023,campinas,SP,more", "s1,13023", 's1,13023,"cam\npinas",SP'])
def test_malformed_rows_stop_the_reader(spark, tmp_path, row):
    raw = read_raw(spark, write(tmp_path, sellers=f"{SELLERS}s0,1,rio,RJ\n{row}\n"))
    with pytest.raises(Exception, match="MALFORMED"):
        raw.sellers.collect()
    with pytest.raises(Exception, match="MALFORMED"):
        raw.sellers.count()


def test_missing_tokens_become_null_by_default(spark, tmp_path):
    folder = write(tmp_path, sellers=f"{SELLERS}s1,NA,null,SP\ns2,1,NaN,N/A\n")
    plain = by(read_raw(spark, folder, missing=()).sellers, "seller_id")
    assert plain["s1"]["seller_city"] == "null"
    read = by(read_raw(spark, folder).sellers, "seller_id")
    assert read["s1"]["seller_zip_code_prefix"] is read["s1"]["seller_city"] is None
    assert read["s2"]["seller_city"] is read["s2"]["seller_state"] is None


def test_nothing_is_rounded(spark, tmp_path):
    """Weights, prefixes and money that would need rounding are violations."""
    header = FILES["products"].split("\n")[0]
    raw = read_raw(spark, write(
        tmp_path,
        products=f"{header}\np1,a,1e1,2.000,3,1.0000004,4,5,6\n",
        sellers=f"{SELLERS}s1,1037.0000004,x,SP\ns2,1037.0,x,SP\n",
        payments="order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                 "o1,1,voucher,1,12.3456\no1,2,voucher,1,12.3400\n",
    ))
    found = {
        (r.table_name, r.column_name): r.failures
        for r in cleaning.violations(raw).collect() if r.failures
    }
    assert found == {
        ("products", "product_weight_g"): 1, ("sellers", "seller_zip_code_prefix"): 1,
        ("payments", "payment_value"): 1,
    }


def test_unicode_blanks_are_stripped(spark, tmp_path):
    city = "\u00a0 \u3000rio\u2003\x1c"
    raw = read_raw(spark, write(tmp_path, sellers=f"{SELLERS}s1,1,{city},SP\ns2,2,\u00a0,SP\n"))
    rows = by(cleaning.clean(raw).sellers, "seller_id")
    assert rows["s1"]["seller_city"] == "rio" and rows["s2"]["seller_city"] is None


def test_scrambled_load_fails(spark, raw, tmp_path):
    """Equal counts do not hide changed cells."""
    mk = cleaning.clean(raw)
    sink.load(mk, spark, str(tmp_path / "out"))
    changed = mk.replaced(sellers=mk.sellers.selectExpr(
        "seller_id", "seller_zip_code_prefix", "seller_state AS seller_city",
        "seller_city AS seller_state"))
    report = by(sink.load_counts(mk, changed), "table_name")
    assert report["sellers"]["status"] == "FAIL" and report["orders"]["status"] == "PASS"
