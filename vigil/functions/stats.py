"""Signal and proportion statistics as Column expressions and small aggregates.

Counts may be any number type; products are taken as doubles. Results that the statistic leaves
undefined are null, never NaN, so that comparisons with them are false in every engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Two-sided normal quantiles.
Z = {0.05: 1.959963984540054, 0.01: 2.5758293035489004, 0.10: 1.6448536269514722}
#: Different values that one task ranks.
RANK_VALUES = 100_000


def _d(c: Column) -> Column:
    return c.cast("double")


def wilson(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """struct(p, lo, hi); n = 0 gives (0, 0, 1), an impossible k gives null."""
    z = Z[alpha]
    k, n = _d(k), _d(n)
    p = k / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z / scale * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    hi = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    found = F.struct(p.alias("p"), lo.alias("lo"), hi.alias("hi"))
    none = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.when(n <= 0, none).when((k >= 0) & (k <= n), found)


def _ratio(point: Column, variance: Column, alpha: float) -> Column:
    half = Z[alpha] * F.sqrt(variance)
    return F.struct(point.alias("point"), F.exp(F.ln(point) - half).alias("lo"), F.exp(F.ln(point) + half).alias("hi"))


def prr(a: Column, b: Column, c: Column, d: Column, alpha: float = 0.05) -> Column:
    """Proportional reporting ratio with half a report added to each cell."""
    a, b, c, d = (_d(x) + 0.5 for x in (a, b, c, d))
    return _ratio((a / (a + b)) / (c / (c + d)), 1 / a - 1 / (a + b) + 1 / c - 1 / (c + d), alpha)


def ror(a: Column, b: Column, c: Column, d: Column, alpha: float = 0.05) -> Column:
    """Reporting odds ratio with half a report added to each cell."""
    a, b, c, d = (_d(x) + 0.5 for x in (a, b, c, d))
    return _ratio(a * d / (b * c), 1 / a + 1 / b + 1 / c + 1 / d, alpha)


def yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Corrected chi-square of the observed counts, null on an empty margin."""
    a, b, c, d = (_d(x) for x in (a, b, c, d))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, F.pow(F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2), F.lit(2.0)) * n / margins)


def risk_difference(a1: Column, n1: Column, a2: Column, n2: Column, alpha: float = 0.05) -> Column:
    """Difference of proportions, bounds by plain subtraction of the Wilson bounds."""
    x, y = wilson(a1, n1, alpha), wilson(a2, n2, alpha)
    return F.struct((x["p"] - y["p"]).alias("point"), (x["lo"] - y["hi"]).alias("lo"), (x["hi"] - y["lo"]).alias("hi"))


def newcombe(a1: Column, n1: Column, a2: Column, n2: Column, alpha: float = 0.05) -> Column:
    """Hybrid-score interval of a difference of proportions."""
    x, y = wilson(a1, n1, alpha), wilson(a2, n2, alpha)
    gap = x["p"] - y["p"]
    norm = lambda u, v: F.sqrt(u * u + v * v)
    lo = F.greatest(F.lit(-1.0), gap - norm(x["p"] - x["lo"], y["hi"] - y["p"]))
    hi = F.least(F.lit(1.0), gap + norm(x["hi"] - x["p"], y["p"] - y["lo"]))
    return F.when((n1 > 0) & (n2 > 0), F.struct(gap.alias("point"), lo.alias("lo"), hi.alias("hi")))


def information_component(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(expected, ic, ic025, ic975) with shrinkage of one half."""
    a, b, c, d = (_d(x) for x in (a, b, c, d))
    n = a + b + c + d
    expected = (a + b) * (a + c) / n
    seen = a + 0.5
    ic = F.log2(seen / (expected + 0.5))
    root = F.sqrt(seen)
    low = ic - 3.3 / root - 2.0 / (root * seen)
    high = ic + 2.4 / root - 0.5 / (root * seen)
    return F.when(n > 0, F.struct(expected.alias("expected"), ic.alias("ic"), low.alias("ic025"), high.alias("ic975")))


def ema_signal(a: Column, ratio: Column, chi2: Column) -> Column:
    """At least 3 reports, a ratio of 2 and a chi-square of 4."""
    return F.coalesce((a >= 3) & (ratio >= 2.0) & (chi2 >= 4.0), F.lit(False))


def benjamini_hochberg(df: DataFrame, p: str, q: str = "q", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds q; null p are left out of the ranking and keep a null q."""
    ties = [F.col(c) for c in by]
    tested = F.when(F.col(p).isNotNull(), 0).otherwise(1)
    group = W.partitionBy(*ties, tested) if ties else W.partitionBy(tested)
    df = df.withColumn("_rank", F.row_number().over(group.orderBy(p))).withColumn("_tests", F.count("*").over(group))
    step = F.col(p) * F.col("_tests") / F.col("_rank")
    below = group.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    q_value = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(step).over(below)))
    return df.withColumn(q, q_value).drop("_rank", "_tests")


def cochran_armitage(df: DataFrame, score: str, k: str, n: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a group with z; scores are taken from the group's least, which leaves z the same."""
    low = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    rows = df.withColumn("_s", _d(F.col(score)) - F.min(_d(F.col(score))).over(low)).withColumns({"_k": _d(F.col(k)), "_n": _d(F.col(n))})
    s, r, m = F.col("_s"), F.col("_k"), F.col("_n")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("groups"), F.sum(m).alias("N"), F.sum(r).alias("R"), F.sum(s * m).alias("sn"), F.sum(s * r).alias("sr"), F.sum(s * s * m).alias("ssn")
    )
    N, R, sn, sr, ssn = (F.col(x) for x in ("N", "R", "sn", "sr", "ssn"))
    share = R / N
    variance = share * (1 - share) * (ssn - sn * sn / N)
    z = F.when((F.col("groups") >= 2) & (R > 0) & (R < N) & (variance > 0), (sr - share * sn) / F.sqrt(variance))
    return sums.select(*by, "groups", z.alias("z"), direction(z).alias("direction"))


def direction(z: Column) -> Column:
    return F.when(z > 0, "increasing").when(z < 0, "decreasing").otherwise("no trend")


def mann_kendall(df: DataFrame, order: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a group with S, the tie-corrected variance, z and tau; z needs 4 values.

    A group is a series of periods, one row each, so its pairs are few; the join is on the group.
    """
    keys = list(by) or ["_all"]
    rows = (df if by else df.withColumn("_all", F.lit(1))).select(*keys, F.col(order).alias("_t"), F.col(value).alias("_v"))
    left, right = rows.alias("l"), rows.alias("r")
    same = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys])
    pairs = left.join(right, same & (F.col("l._t") < F.col("r._t")), "left").groupBy(*[F.col(f"l.{c}").alias(c) for c in keys])
    s = pairs.agg(F.coalesce(F.sum(F.signum(F.col("r._v") - F.col("l._v"))), F.lit(0.0)).cast("long").alias("S"))
    repeats = rows.groupBy(*keys, "_v").agg(F.count("*").alias("t")).groupBy(*keys)
    t = F.col("t")
    sizes = repeats.agg(F.sum("t").alias("n"), F.sum(t * (t - 1) * (2 * t + 5)).alias("ties"))
    n = F.col("n")
    out = s.join(sizes, keys).withColumn("variance", (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18.0)
    z = F.when((n >= 4) & (F.col("variance") > 0), (F.col("S") - F.signum(F.col("S").cast("double"))) / F.sqrt("variance"))
    tau = F.when(n >= 2, F.col("S") / (n * (n - 1) / 2.0))
    return out.select(*by, "n", "S", "variance", z.alias("z"), tau.alias("tau"), F.when(n >= 4, direction(F.col("S"))).otherwise("no trend").alias("direction"))


def chi_square(df: DataFrame, row: str, column: str, count: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Pearson's chi-square, degrees of freedom and least expected cell of a table in long form.

    Cells that the long form lacks count as zero: their expected counts are what the margins leave over.
    """
    group = list(by)
    over = lambda *c: W.partitionBy(*group, *c) if group or c else W.partitionBy(F.lit(1))
    o = _d(F.col(count))
    cells = df.withColumns({"_r": F.sum(o).over(over(row)), "_c": F.sum(o).over(over(column)), "_n": F.sum(o).over(over())})
    e = F.col("_r") * F.col("_c") / F.col("_n")
    # sum of (o - e)^2 / e over all cells is n * sum of o^2 / (r c) - n
    return cells.groupBy(*group).agg(
        (F.first("_n") * (F.sum(F.when(F.col("_r") * F.col("_c") > 0, o * o / (F.col("_r") * F.col("_c")))) - 1)).alias("chi2"),
        ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("df"),
        (F.min("_r") * F.min("_c") / F.first("_n")).alias("min_expected"),
    )


def squared_shares(count: Column) -> Column:
    """The sum of squared percentage shares, as an aggregate of the counts."""
    return 1e4 * F.sum(_d(count) * _d(count)) / F.pow(F.sum(_d(count)), 2)


def herfindahl(df: DataFrame, count: str, by: tuple[str, ...] = ()) -> DataFrame:
    """T18 of a table of counts, or of each group."""
    return df.groupBy(*by).agg(squared_shares(F.col(count)).alias("hhi"))


def lower_rank(df: DataFrame, value: str, p: float) -> DataFrame:
    """T19, nearest-rank form: the value at floor(p * (n - 1)); `percentile` is the linear form. Values are counted
    first; of more than `RANK_VALUES` different ones only the range that holds the rank is looked into."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    facts = counts.agg(F.sum("_n").alias("n"), F.count("*").alias("values")).first()
    rank, left = int(p * ((facts["n"] or 0) - 1)), facts["values"]
    while left > RANK_VALUES:
        cuts = sorted(set(counts.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.005)))
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value)))
        for row in sorted(counts.groupBy(place.alias("at")).agg(F.sum("_n").alias("n"), F.count("*").alias("values")).collect()):
            if rank < row["n"]:
                break
            rank -= row["n"]
        if row["values"] == left:
            break
        counts, left = counts.filter(place == row["at"]), row["values"]
    upto = F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy(value))
    return counts.withColumn("_upto", upto).filter((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)).select(value)


def percent_text(ci: Column, decimals: int = 1) -> Column:
    """T20: 'p% (lo-hi)'."""
    f = f"%.{decimals}f"
    return F.format_string(f"{f}%% ({f}-{f})", ci["p"] * 100, ci["lo"] * 100, ci["hi"] * 100)
