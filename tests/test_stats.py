import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions import stats, tails

def cells():
    return [F.col(c) for c in "abcd"]


def test_wilson(spark):
    rows = spark.createDataFrame([(5, 10), (0, 100), (100, 100), (3, 30), (1, 50), (0, 0), (3, 2)], "k long, n long")
    got = [r[0] for r in rows.select(stats.wilson(F.col("k"), F.col("n"))).collect()]
    want = [(0.2366, 0.7634), (0, 0.0370), (0.9630, 1), (0.0346, 0.2562), (0.0035, 0.1050)]
    for g, (lo, hi) in zip(got, want, strict=False):
        assert g["lo"] == pytest.approx(lo, abs=5e-4) and g["hi"] == pytest.approx(hi, abs=5e-4)
    assert got[1]["lo"] == 0 and got[2]["hi"] == 1 and tuple(got[5]) == (0, 0, 1) and got[6] is None


def test_two_by_two(spark):
    rows = spark.createDataFrame([(50, 50, 50, 9950), (2, 98, 200, 9700), (5, 5, 5, 5), (0, 10, 0, 10)], "a long, b long, c long, d long")
    out = rows.select(
        stats.prr(*cells()).alias("prr"), stats.ror(*cells()).alias("ror"), stats.yates(*cells()).alias("chi2"), stats.information_component(*cells()).alias("ic"),
        stats.ema_signal(F.col("a"), stats.prr(*cells())["point"], stats.yates(*cells())).alias("ema"),
    ).collect()
    assert out[0]["prr"]["point"] == pytest.approx((50.5 / 101) / (50.5 / 10001)) and out[0]["prr"]["lo"] > 2 and out[0]["ema"]
    assert out[1]["prr"]["lo"] < 1 < out[1]["prr"]["hi"] and not out[1]["ema"]
    assert out[2]["chi2"] == 0 and out[3]["chi2"] is None and not out[3]["ema"]
    assert out[0]["ic"]["ic025"] > 0 > out[1]["ic"]["ic025"] and out[2]["ic"]["ic"] == pytest.approx(0)


def test_margins_of_millions(spark):
    row = spark.createDataFrame([(900_000, 9_100_000, 4_000_000, 16_000_000)], "a long, b long, c long, d long")
    assert row.select(stats.yates(*cells())).first()[0] > 0


def test_tails(spark):
    assert tails.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi_square_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi_square_tail(0, 3) == 1 and tails.chi_square_tail(float("nan"), 1) is None
    rows = spark.createDataFrame([(1.959963984540054,), (-1.959963984540054,), (36.0,), (None,)], "z double")
    got = [r[0] for r in rows.select(tails.normal_p("z")).collect()]
    assert got[0] == got[1] == pytest.approx(0.05) and 0 < got[2] < 1e-280 and got[3] is None


def brute_fisher(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    p = {x: math.comb(col, x) * math.comb(n - col, row - x) for x in range(max(0, row + col - n), min(row, col) + 1)}
    return sum(v for v in p.values() if v <= p[a]) / math.comb(n, row)


@settings(max_examples=150, deadline=None)
@given(*[st.integers(0, 40)] * 4)
def test_fisher_against_brute_force(a, b, c, d):
    assert tails.fisher_exact(a, b, c, d) == pytest.approx(brute_fisher(a, b, c, d), rel=1e-7, abs=1e-12)


def test_fisher_large_margins(spark):
    assert 0 < tails.fisher_exact(9, 2_000_000, 40, 14_000_000) < 1
    rows = spark.createDataFrame([(3, 1, 1, 3), (50, 50, 50, 50)], "a long, b long, c long, d long")
    got = [r[0] for r in rows.select(tails.fisher_p(*cells())).collect()]
    assert got[0] == pytest.approx(0.4857142857) and got[1] is None


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.20, 0.03]
    rows = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    q = [r["q"] for r in stats.benjamini_hochberg(rows, "p").orderBy("i").collect()]
    assert q[3] is None and q[0] == pytest.approx(0.05) and q[2] == q[5] == pytest.approx(0.05) and q[1] == pytest.approx(0.05) and q[4] == pytest.approx(0.2)
    assert all(b >= a for a, b in zip(p, q, strict=True) if a is not None)


def test_trends(spark):
    rows = spark.createDataFrame([(2000 + i, k, 100) for i, k in enumerate([1, 5, 10, 20, 40])], "y int, k long, n long")
    ca = stats.cochran_armitage(rows, "y", "k", "n").first()
    s = [0, 1, 2, 3, 4]
    share = 76 / 500
    top = sum(x * (k - 100 * share) for x, k in zip(s, [1, 5, 10, 20, 40], strict=True))
    z = top / math.sqrt(share * (1 - share) * sum(100 * (x - 2) ** 2 for x in s))
    assert ca["z"] == pytest.approx(z) and ca["direction"] == "increasing"
    mk = stats.mann_kendall(rows, "y", "k").first()
    assert mk["S"] == 10 and mk["z"] == pytest.approx(9 / math.sqrt(5 * 4 * 15 / 18)) and mk["tau"] == 1
    tied = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 1, 1])], "y int, k long")
    flat = stats.mann_kendall(tied, "y", "k").first()
    assert flat["S"] == 0 and flat["z"] is None and flat["direction"] == "no trend"
    few = stats.cochran_armitage(rows.filter("y = 2000"), "y", "k", "n").first()
    assert few["z"] is None


def test_chi_square(spark):
    rows = spark.createDataFrame([("x", "yes", 10), ("x", "no", 90), ("y", "yes", 40), ("y", "no", 60)], "r string, c string, n long")
    one = stats.chi_square(rows, "r", "c", "n").first()
    assert one["chi2"] == pytest.approx(24.0) and one["df"] == 1 and one["min_expected"] == 25
    sparse = stats.chi_square(rows.filter("not (r = 'x' and c = 'yes')"), "r", "c", "n").first()
    full = stats.chi_square(rows.withColumn("n", F.when((F.col("r") == "x") & (F.col("c") == "yes"), 0).otherwise(F.col("n"))), "r", "c", "n").first()
    assert sparse["chi2"] == pytest.approx(full["chi2"])


def test_differences(spark):
    rows = spark.createDataFrame([(56, 70, 48, 80), (0, 0, 1, 2)], "a1 long, n1 long, a2 long, n2 long")
    args = [F.col(c) for c in ("a1", "n1", "a2", "n2")]
    got = rows.select(stats.newcombe(*args).alias("n"), stats.risk_difference(*args).alias("r")).collect()
    assert got[0]["n"]["lo"] == pytest.approx(0.0524, abs=1e-4) and got[0]["n"]["hi"] == pytest.approx(0.3339, abs=1e-4)
    assert got[0]["r"]["lo"] < got[0]["n"]["lo"] and got[1]["n"] is None
    assert stats.herfindahl(spark.createDataFrame([("a", 50), ("b", 50)], "m string, n long"), "n").first()["hhi"] == pytest.approx(5000)
    text = spark.range(1).select(stats.percent_text(stats.wilson(F.lit(5), F.lit(10)))).first()[0]
    assert text == "50.0% (23.7-76.3)"


def test_lower_rank_keeps_no_rows_in_one_task(spark, monkeypatch):
    rows = spark.range(3000).select(((F.col("id") * 7919) % 3000).cast("double").alias("v")).union(spark.createDataFrame([(None,), (5.0,)], "v double"))
    want = sorted([float(i) for i in range(3000)] + [5.0])
    for most in (100_000, 40):
        monkeypatch.setattr(stats, "RANK_VALUES", most, raising=False)
        for p in (0.0, 0.37, 0.9, 1.0):
            found = stats.lower_rank(rows, "v", p)
            assert [r[0] for r in found.collect()] == [want[int(p * 3000)]]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "CollectLimit" not in plan and "GlobalLimit" not in plan
    assert stats.lower_rank(rows.filter("v < 0"), "v", 0.9).count() == 0
