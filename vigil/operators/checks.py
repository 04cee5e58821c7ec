"""Data-quality checks of a build (Q01-Q09): each is rows (check, severity, metric, detail); 0 ok, 1 warning, 2 error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .build import KEY, orphans

REQUIRED = ("mdr", "device", "patient", "narrative", "reports")


def _row(df: DataFrame, check: str, severity: Column, metric: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), severity.cast("int").alias("severity"), metric.cast("double").alias("metric"), detail.cast("string").alias("detail"))


def filled(tables: dict[str, DataFrame]) -> DataFrame:
    """Q01: an absent or empty required table is an error, an empty optional one a warning."""
    parts = []
    spark = SparkSession.getActiveSession()
    for name in dict.fromkeys([*REQUIRED, *tables]):
        df = tables.get(name)
        if df is None:
            parts.append(_row(spark.range(1), "filled", F.lit(2 if name in REQUIRED else 1), F.lit(0), F.lit(name)))
            continue
        n = df.limit(1).agg(F.count("*").alias("n"))
        parts.append(_row(n, "filled", F.when(F.col("n") > 0, 0).otherwise(2 if name in REQUIRED else 1), F.col("n"), F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def orphan_rows(children: dict[str, DataFrame], mdr: DataFrame) -> DataFrame:
    """Q02"""
    parts = []
    for name, child in children.items():
        n = orphans(child, mdr).agg(F.count("*").alias("n"))
        parts.append(_row(n, "orphans", F.when(F.col("n") > 0, 1).otherwise(0), F.col("n"), F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def dates(reports: DataFrame) -> DataFrame:
    """Q03: dated share (95% ok, 70% a warning) and years outside 1990 to 2030."""
    one = reports.agg((F.count("DATE_PREF") * 100.0 / F.count("*")).alias("share"), F.count_if(~F.year("DATE_PREF").between(1990, 2030)).alias("odd"))
    share = _row(one, "dated", F.when(F.col("share") >= 95, 0).when(F.col("share") >= 70, 1).otherwise(2), F.col("share"), F.lit("percent of reports"))
    return share.unionByName(_row(one, "date_range", F.when(F.col("odd") > 0, 1).otherwise(0), F.col("odd"), F.lit("outside 1990-2030")))


def narratives(parts: DataFrame) -> DataFrame:
    """Q04: blank keys above 0.5% or empty texts above 5% are warnings."""
    rate = lambda c: F.avg(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", 100.0).otherwise(0.0))
    one = parts.agg(rate(KEY).alias("key"), rate("FOI_TEXT").alias("text"))
    first = _row(one, "narrative_key", F.when(F.col("key") > 0.5, 1).otherwise(0), F.col("key"), F.lit("percent blank"))
    return first.unionByName(_row(one, "narrative_text", F.when(F.col("text") > 5, 1).otherwise(0), F.col("text"), F.lit("percent empty")))


def columns(df: DataFrame, name: str, wanted: tuple[str, ...]) -> DataFrame:
    """Q05, Q06: missing columns of a dictionary or of the reports are errors."""
    missing = [c for c in wanted if c not in df.columns]
    one = df.sparkSession.range(1)
    return _row(one, "columns", F.lit(2 if missing else 0), F.lit(len(missing)), F.lit(f"{name}: {', '.join(missing) or 'complete'}"))


def outcomes(reports: DataFrame) -> DataFrame:
    """Q06: no coded outcome at all is a warning."""
    one = reports.agg(F.avg(F.when(F.trim("outcome_codes_raw") != "", 100.0).otherwise(0.0)).alias("share"))
    return _row(one, "outcome_coverage", F.when(F.col("share") > 0, 0).otherwise(1), F.col("share"), F.lit("percent of reports"))


def event_types(reports: DataFrame) -> DataFrame:
    """Q07: each of the three main event types should occur."""
    one = reports.agg(*[F.count_if(F.col("EVENT_TYPE") == t).alias(t) for t in ("D", "IN", "M")])
    long = one.unpivot([], ["D", "IN", "M"], "type", "n")
    return _row(long, "event_type", F.when(F.col("n") > 0, 0).otherwise(1), F.col("n"), F.col("type"))


def year_volume(reports: DataFrame) -> DataFrame:
    """Q08: years of less than a tenth of the median volume, where there are more than two."""
    counts = reports.filter("report_year is not null").groupBy("report_year").agg(F.count("*").alias("n"))
    typical = counts.agg(F.percentile("n", 0.5).alias("median"), F.count("*").alias("years"))  # one row
    rows = counts.join(F.broadcast(typical))
    low = (F.col("years") > 2) & (F.col("n") < 0.1 * F.col("median"))
    return _row(rows, "year_volume", F.when(low, 1).otherwise(0), F.col("n"), F.col("report_year"))


def of_reports(reports: DataFrame) -> DataFrame:
    """Q03, Q06, Q07 and Q08 from one pass: the reports are counted by year, and the rows of all four checks are read off
    these counts."""
    filled_ = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    kinds = ("D", "IN", "M")
    years = reports.groupBy("report_year").agg(
        F.count("*").alias("n"), F.count("DATE_PREF").alias("dated"), F.count_if(~F.year("DATE_PREF").between(1990, 2030)).alias("odd"), F.count_if(filled_("outcome_codes_raw")).alias("coded"),
        *[F.count_if(F.col("EVENT_TYPE") == t).alias(t) for t in kinds],
    )
    listed = F.collect_list(F.when(F.col("report_year").isNotNull(), F.struct("n", "report_year")))
    one = years.agg(*[F.sum(c).alias(c) for c in ("n", "dated", "odd", "coded", *kinds)], F.sort_array(listed).alias("years"))  # a year is a few bytes
    share = lambda c: F.col(c) * 100.0 / F.col("n")
    size = F.size("years")
    at = lambda i: F.get(F.col("years"), i.cast("int"))["n"]
    median = (at(F.floor((size - 1) / 2)) + at(F.floor(size / 2))) / 2.0

    def row(check: str, level: Column, metric: Column, detail: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), level.cast("int").alias("severity"), metric.cast("double").alias("metric"), detail.cast("string").alias("detail"))

    rows = [
        row("dated", F.when(share("dated") >= 95, 0).when(share("dated") >= 70, 1).otherwise(2), share("dated"), F.lit("percent of reports")),
        row("date_range", F.when(F.col("odd") > 0, 1).otherwise(0), F.coalesce("odd", F.lit(0)), F.lit("outside 1990-2030")),
        row("outcome_coverage", F.when(share("coded") > 0, 0).otherwise(1), share("coded"), F.lit("percent of reports")),
        *[row("event_type", F.when(F.col(t) > 0, 0).otherwise(1), F.coalesce(t, F.lit(0)), F.lit(t)) for t in kinds],
    ]
    volume = lambda x: row("year_volume", F.when((size > 2) & (x["n"] < 0.1 * median), 1).otherwise(0), x["n"], x["report_year"])
    return one.select(F.inline(F.concat(F.array(*rows), F.transform("years", volume))))


def severity(checks: DataFrame) -> DataFrame:
    """Q09: 0 clean, 1 warnings, 2 errors."""
    return checks.agg(F.coalesce(F.max("severity"), F.lit(0)).alias("severity"), F.count_if(F.col("severity") > 0).alias("findings"))
