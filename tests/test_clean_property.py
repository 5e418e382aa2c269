"""Property: the price rule keeps exactly the rows a pandas CSV clean keeps."""

import math

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.functions.cleaning import MISSING_TOKENS
from vitrine.operators import clean
from vitrine.schemas import RAW_PRODUCTS

PIECES = ["1", "2", "0", "9", ".", "e", "E", "+", "-", " ", "inf", "Infinity", "nan", "NaN",
          "x", "d", "_", ",", "0x", "NA", "5"]


def pandas_keeps(text: str | None):
    """Reference rule: CSV missing tokens are absent; coerce; drop NaN; > 0."""
    if text is None or text in MISSING_TOKENS:
        return None
    v = pd.to_numeric(pd.Series([text], dtype=object), errors="coerce").iloc[0]
    if v is None or (isinstance(v, float) and math.isnan(v)) or not (v > 0):
        return None
    return float(v)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), min_size=1, max_size=4).map("".join),
                min_size=20, max_size=60))
def test_price_rule_matches_pandas(spark, texts):
    rows = [(str(i), f"title {i}", None, "Home", "B", t, None, None) for i, t in enumerate(texts)]
    got = {int(r.product_id): r.price for r in clean.clean_products(spark.createDataFrame(rows, RAW_PRODUCTS)).collect()}
    want = {i: pandas_keeps(t) for i, t in enumerate(texts)}
    want = {i: v for i, v in want.items() if v is not None}
    assert set(got) == set(want), [(texts[i], got.get(i), want.get(i)) for i in set(got) ^ set(want)]
    # values agree up to pandas' fast parser, which can be one ulp off for
    # large exponents (Spark's cast is correctly rounded)
    assert all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in got)
