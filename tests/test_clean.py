"""Cleaning traps: CSV missing tokens, price coercion, dedup, rejects, audit."""

import math

from vitrine.operators import clean
from vitrine.schemas import RAW_PRODUCTS


def raw_rows(spark, rows):
    full = [(pid, title, None, cat, "B", price, None, None) for pid, title, cat, price in rows]
    return spark.createDataFrame(full, RAW_PRODUCTS)


PRICES = ["5", "", "NA", "x", "NaN", "1d", " 12 ", "inf", "1e2", "1,000", "0x10", "1_0", "-5", "0",
          "Infinity", ".5", "5.", "+3", "1f", "0x1p3", "-inf"]
KEPT = {"5": 5.0, " 12 ": 12.0, "inf": math.inf, "1e2": 100.0, "Infinity": math.inf,
        ".5": 0.5, "5.": 5.0, "+3": 3.0}


def test_price_coercion_keeps_only_numeric_positive(spark):
    rows = [(str(i), f"title {i}", "Home", p) for i, p in enumerate(PRICES)]
    out = clean.clean_products(raw_rows(spark, rows)).collect()
    got = {PRICES[int(r.product_id)]: r.price for r in out}
    assert got == KEPT


def test_reasons_per_price(spark):
    rows = [(str(i), f"title {i}", "Home", p) for i, p in enumerate(PRICES)]
    rej = {PRICES[int(r.product_id)]: r.reason for r in clean.clean_rejects(raw_rows(spark, rows)).collect()}
    assert rej[""] == "missing_field" and rej["NA"] == "missing_field" and rej["NaN"] == "missing_field"
    assert rej["x"] == "bad_price" and rej["1d"] == "bad_price" and rej["0x10"] == "bad_price"
    assert rej["1,000"] == "bad_price" and rej["1_0"] == "bad_price"
    assert rej["-5"] == "non_positive_price" and rej["0"] == "non_positive_price"
    assert rej["-inf"] == "non_positive_price"
    assert set(rej) | set(KEPT) == set(PRICES)


def test_missing_titles_and_dedup_keeps_lowest_id(spark):
    rows = [("7", None, "Home", "10"), ("8", "", "Home", "10"), ("9", "NA", "Home", "10"),
            ("10", "null", "Home", "10"), ("11", "None", "Home", "10"),
            ("21", "Lamp", "Home", "30"), ("20", "Lamp", "Home", "25"), ("3", "Lamp", "Toys", "99"),
            ("4", "Desk", None, "5")]
    df = raw_rows(spark, rows)
    out = clean.clean_products(df).collect()
    assert [(r.product_id, r.title, r.price, r.category) for r in out] == [("20", "Lamp", 25.0, "Home")]
    rej = sorted((r.product_id, r.reason) for r in clean.clean_rejects(df).collect())
    assert rej == [("10", "missing_field"), ("11", "missing_field"), ("21", "duplicate_title"),
                   ("3", "duplicate_title"), ("4", "missing_field"), ("7", "missing_field"),
                   ("8", "missing_field"), ("9", "missing_field")]
    audit = clean.clean_audit(df).first().asDict()
    assert audit == {"n_read": 9, "n_missing_id": 0, "n_missing_field": 6, "n_bad_price": 0, "n_non_positive_price": 0,
                     "n_valid": 3, "n_clean": 1, "n_duplicate_title": 2}


def test_cleaned_schema_is_fixed(spark):
    out = clean.clean_products(raw_rows(spark, [("1", "A", "Home", "3.5")]))
    assert out.columns == ["product_id", "title", "description", "category", "brand", "price",
                           "rating", "num_reviews"]
    assert dict(out.dtypes)["price"] == "double" and dict(out.dtypes)["product_id"] == "string"


def test_dedup_is_one_aggregate(spark):
    """Dedup plans as an aggregate (partial aggregation before the shuffle),
    not as a window over whole title groups."""
    rows = [(str(i), f"t{i % 3}", "Home", "1") for i in range(30)]
    plan = clean.clean_products(raw_rows(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "Aggregate" in plan


def test_audit_counts_add_up(spark):
    from vitrine.sources import tables
    raw = tables.raw_products(spark, "/root/testdata/sf0.001")
    a = clean.clean_audit(raw).first()
    assert a.n_read == raw.count()
    assert a.n_missing_id + a.n_missing_field + a.n_bad_price + a.n_non_positive_price + a.n_valid == a.n_read
    assert a.n_clean == clean.clean_products(raw).count()
    assert clean.clean_rejects(raw).count() == a.n_read - a.n_clean
    assert a.n_missing_id > 0 and a.n_duplicate_title > 0


def test_text_ids_survive_and_copies_are_counted(spark):
    rows = [("P00001", "Lamp", "Home", "5"), ("P00001", "Lamp", "Home", "5"), ("P00002", "Lamp", "Home", "5"),
            ("NA", "Desk", "Home", "5"), (None, "Desk", "Home", "5"), ("P00007", "Desk", "Home", "5")]
    df = raw_rows(spark, rows)
    kept = sorted((r.product_id, r.title) for r in clean.clean_products(df).collect())
    assert kept == [("P00001", "Lamp"), ("P00007", "Desk")]
    rejects = sorted(((r.product_id, r.title, r.reason) for r in clean.clean_rejects(df).collect()), key=str)
    assert rejects == [("P00001", "Lamp", "duplicate_title"), ("P00002", "Lamp", "duplicate_title"),
                       (None, "Desk", "missing_id"), (None, "Desk", "missing_id")]
    assert len(kept) + len(rejects) == len(rows)


def test_ids_that_a_type_cannot_hold_are_rejects(spark):
    df = raw_rows(spark, [("x", "Lamp", "Home", "5"), ("7", "Desk", "Home", "5")])
    assert [r.product_id for r in clean.clean_products(df, "long").collect()] == [7]
    assert [(r.title, r.reason) for r in clean.clean_rejects(df, "long").collect()] == [("Lamp", "missing_id")]
