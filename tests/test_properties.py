"""Property tests: exact money and percentages against Python's Decimal / Fraction."""

from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotalake.functions.pricing import estimate_cost
from quotalake.operators.usage import percent_2dp

tokens = st.integers(min_value=0, max_value=10 ** 15)


def _half_up(x: Fraction, dp: int) -> float:
    q = Decimal(x.numerator) / Decimal(x.denominator)
    return float(q.quantize(Decimal(1).scaleb(-dp), ROUND_HALF_UP))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(tokens, tokens), min_size=1, max_size=40), st.sampled_from([2, 4]))
def test_cost_equals_decimal_half_up(spark, pairs, dp):
    df = spark.createDataFrame(pairs, "i long, o long")
    got = [r[0] for r in df.select(estimate_cost(F.col("i"), F.col("o"), dp=dp)).collect()]
    want = [_half_up(Fraction(i * 3 + o * 15, 10 ** 6), dp) for i, o in pairs]
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10 ** 13), st.integers(1, 10 ** 12)), min_size=1, max_size=40))
def test_percent_equals_fraction_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "u long, l long")
    got = [r[0] for r in df.select(percent_2dp(F.col("u"), F.col("l"))).collect()]
    want = [_half_up(Fraction(u * 100, lim), 2) for u, lim in pairs]
    assert got == want


prices = st.decimals(min_value=0, max_value=999, places=6)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(tokens, tokens), min_size=1, max_size=20), prices, prices, st.sampled_from([0, 2, 4]))
def test_cost_of_fractional_prices(spark, pairs, a, b, dp):
    df = spark.createDataFrame(pairs, "i long, o long")
    got = [r[0] for r in df.select(estimate_cost(F.col("i"), F.col("o"), a, b, dp=dp)).collect()]
    assert got == [_half_up((i * Fraction(a) + o * Fraction(b)) / 10 ** 6, dp) for i, o in pairs]


def test_fractional_price_is_rounded_once(spark):
    df = spark.createDataFrame([(199, 0)], "i long, o long")
    row = df.select(estimate_cost(F.col("i"), F.col("o"), 0.25, 0, dp=4), estimate_cost(F.col("i"), F.col("o"), 0.25, 0, dp=None)).first()
    assert tuple(row) == (0.0, 0.00004975)
