import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verilens.functions import kernels as K
from verilens.functions import numbers as N


def test_known_tails():
    assert K.gamma_upper(np.array([4.5]), np.array([16.92 / 2]))[0] == pytest.approx(0.05, abs=2e-4)
    assert K.t_two_tailed(np.array([2.228]), np.array([10.0]))[0] == pytest.approx(0.05, abs=2e-4)
    assert K.f_upper(np.array([3.098]), np.array([3.0]), np.array([20.0]))[0] == pytest.approx(0.05, abs=2e-4)
    assert K.normal_two_tailed(np.array([1.959964]))[0] == pytest.approx(0.05, abs=1e-6)
    assert K.pearson_two_tailed(np.array([0.0]), np.array([20.0]))[0] == pytest.approx(1.0)


def test_discrete_tails_equal_sums():
    for k, n, p in ((0, 5, 0.2), (3, 10, 0.1), (9, 10, 0.5), (11, 10, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert K.binomial_upper([k], [n], [p])[0] == pytest.approx(want, abs=1e-10)
    for k, lam in ((0, 2.0), (4, 2.0), (1, 5.0), (60, 2.0)):
        want = 1 - sum(math.exp(-lam) * lam**i / math.factorial(i) for i in range(k))
        assert K.poisson_upper([k], [lam])[0] == pytest.approx(want, abs=1e-10)
    assert 0 < K.poisson_upper([60], [2.0])[0] < 1e-60


def test_kernels_in_sql_and_even_form(spark):
    K.register_kernels(spark)
    row = spark.sql("SELECT chi2_tail(15.507D, 8D) AS p").first()
    even = spark.range(1).select(K.chi2_tail_even(F.lit(15.507), 8).alias("p")).first()
    assert row.p == pytest.approx(even.p, abs=1e-10)
    assert row.p == pytest.approx(0.05, abs=1e-4)


def test_number_functions(spark):
    rows = [("$1,234.50",), ("45%",), ("n/a",), ("-",), ("1e3",), ("abc",), (" 7. ",), ("-0.5",), ("1-2",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(N.coerce_number(F.col("t"))).collect()]
    assert got == [1234.5, 45.0, None, None, 1000.0, None, 7.0, -0.5, None]
    row = spark.range(1).select(
        N.terminal_digit(F.lit("1.50%")).alias("d"),
        N.decimal_tail(F.lit("12.345")).alias("t"),
        N.fraction_digits(F.lit("1.500")).alias("f"),
        N.fraction_digits(F.lit("1e3")).alias("e"),
        N.terminal_pair(F.lit("3.1459")).alias("p"),
        N.hamming_hex(F.lit("ffffffffffffffff"), F.lit("fffffffffffffff0")).alias("h"),
        N.integer_digit_changes(F.lit("123.4"), F.lit("173.4")).alias("c"),
        N.clean_offset(F.lit("1.15").cast("decimal(38,10)")).alias("o"),
        N.leading_digit(F.lit(0.0042)).alias("l"),
    ).first()
    assert (row.d, row.t, row.f, row.e, row.p, row.h, row.c, row.o, row.l) == ("0", "34", 3, None, "59", 4, 1, True, 4)
