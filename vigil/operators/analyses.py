"""Cohort analyses (A00-A23): each takes reports, already filtered by a cohort, and returns a table.

Where `by` is given, one plan serves every group at once, e.g. a screen over all product codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.functions import enrich, stats, tails

from .build import KEY, counted
from .cohort import Cohort, of_cohort, with_terms

OUTCOMES = [*[f"outcome_{x}" for x in enrich.OUTCOME_LABELS.values()], "any_serious_outcome"]
COMPLETENESS = ("REPORT_NUMBER", "EVENT_TYPE", "DATE_RECEIVED_D", "DATE_OF_EVENT_D", "manufacturer", "product_code",
                "REPORTER_OCCUPATION_CODE", "SOURCE_TYPE", "has_narrative", "age_years_avg", "device_age_days", "outcome_codes_raw")
FLAGS = ("is_supplement", "IS_RWD_SOURCED", "IS_FORWARDED_803_22_B2", "HAS_REDACTION_B4", "HAS_REDACTION_B6")
CLASSES = (("D", "deaths"), ("IN", "injuries"), ("M", "malfunctions"))


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _filled(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "boolean":
        return _true(name)
    return F.trim(name) != "" if kind == "string" else F.col(name).isNotNull()


def landing(reports: DataFrame) -> DataFrame:
    """(report_year, measure, n) for all reports and each event class."""
    yearly = reports.filter("report_year is not null").groupBy("report_year").agg(
        F.count("*").alias("reports"), *[counted(f"EVENT_TYPE = '{c}'", name) for c, name in CLASSES]
    )
    return yearly.unpivot(["report_year"], ["reports", *[n for _, n in CLASSES]], "measure", "n")


def kpis(reports: DataFrame) -> DataFrame:
    """A01"""
    sums = reports.agg(
        F.count("*").alias("n"), F.count_distinct("REPORT_NUMBER").alias("events"), *[counted(f"EVENT_TYPE = '{c}'", name) for c, name in CLASSES],
        counted("outcome_death", "outcome_deaths"), counted("any_serious_outcome", "serious"),
    )
    return with_wilson(sums, "serious", "n")


def with_wilson(df: DataFrame, k: str, n: str) -> DataFrame:
    """Adds rate, lo and hi in percent."""
    ci = stats.wilson(F.col(k), F.col(n))
    return df.withColumn("_ci", ci).select(*df.columns, *[(F.col(f"_ci.{x}") * 100).alias(y) for x, y in (("p", "rate"), ("lo", "lo"), ("hi", "hi"))])


LISTED = (KEY, "REPORT_NUMBER", "DATE_PREF", "EVENT_TYPE", "manufacturer", "BRAND_NAME", "GENERIC_NAME", "MODEL_NUMBER",
          "product_code", "device_count", "patient_count", "any_serious_outcome", "outcome_codes_raw", "implant_flag")


def newest(reports: DataFrame, k: int, columns=LISTED) -> DataFrame:
    """The k newest reports, undated last."""
    return reports.orderBy(F.col("DATE_PREF").desc_nulls_last(), KEY).limit(k).select(*columns)


def yearly_volume(reports: DataFrame) -> DataFrame:
    """Reports a year; the last of three or more is partial if below three quarters of the one before."""
    counts = reports.filter("report_year is not null").groupBy("report_year").agg(F.count("*").alias("reports"))
    w = W.partitionBy(F.lit(1)).orderBy("report_year")
    years = F.count("*").over(W.partitionBy(F.lit(1)))
    last = F.lead("reports").over(w).isNull()
    partial = last & (years >= 3) & (F.col("reports") < 0.75 * F.lag("reports").over(w))
    return counts.withColumn("partial", F.coalesce(partial, F.lit(False)))


def event_types(reports: DataFrame) -> DataFrame:
    """A04"""
    rows = reports.filter(F.col("report_year").isNotNull() & F.col("EVENT_TYPE").isin("D", "IN", "M"))
    counts = rows.groupBy("report_year", "EVENT_TYPE").agg(F.count("*").alias("reports"))
    return counts.withColumn("event", enrich.labelled(F.col("EVENT_TYPE"), enrich.EVENT_LABELS))


def outcome_rates(reports: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each outcome's reports, rate and Wilson interval."""
    sums = reports.groupBy(*by).agg(F.count("*").alias("n"), *[counted(c, c) for c in OUTCOMES])
    return with_wilson(sums.unpivot([*by, "n"], OUTCOMES, "outcome", "k"), "k", "n")


def histogram(reports: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, bin_from, n) of values in [low, high]; the last bin is closed."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = reports.filter(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("bin_from", F.col("bin") * width + low)


def ages(reports: DataFrame) -> DataFrame:
    """Ages of 0 to 110 years in bins of five."""
    return histogram(reports, "age_years_avg", 0.0, 110.0, 22)


def sexes(reports: DataFrame) -> DataFrame:
    return reports.groupBy(enrich.sex(F.col("sex_list")).alias("sex")).agg(F.count("*").alias("n"))


def spread(reports: DataFrame, value: Column, low: float, high: float) -> DataFrame:
    """N, quartiles, mean and 90th percentile of the values in a range."""
    rows = reports.select(value.cast("double").alias("v")).filter(F.col("v").between(low, high))
    q = lambda p, name: F.percentile("v", p).alias(name)
    return rows.agg(F.count("*").alias("n"), q(0.25, "q25"), q(0.5, "median"), q(0.75, "q75"), q(0.9, "p90"), F.avg("v").alias("mean"))


def device_age(reports: DataFrame) -> DataFrame:
    return spread(reports, F.col("device_age_days") / 365.25, 0.0, 100.0)


def cumulative(reports: DataFrame, value: Column, low: float, high: float) -> DataFrame:
    """(value, n, cumulative percent) over the distinct values."""
    counts = reports.select(value.alias("value")).filter(F.col("value").between(low, high)).groupBy("value").agg(F.count("*").alias("n"))
    whole = W.partitionBy(F.lit(1))
    upto = whole.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("cumulative", F.sum("n").over(upto) * 100.0 / F.sum("n").over(whole))


def deaths(reports: DataFrame, k: int) -> DataFrame:
    """The newest death reports, with the count of all of them."""
    found = reports.filter((F.coalesce(F.col("EVENT_TYPE"), F.lit("")) == "D") | _true("outcome_death"))
    total = found.agg(F.count("*").alias("total"))  # one row
    columns = (KEY, "DATE_PREF", "manufacturer", "BRAND_NAME", "GENERIC_NAME", "product_code", "narrative_desc")
    return newest(found, k, columns).join(F.broadcast(total))


def top_problems(reports: DataFrame, pairs: DataFrame, dictionary: DataFrame, k: int = 50, by_term: bool = False) -> DataFrame:
    """The codes of most reports; pairs are distinct. `by_term` merges codes of one term."""
    counts = with_terms(of_cohort(pairs, reports).groupBy("code").agg(F.count("*").alias("n")), dictionary)
    if by_term:
        counts = counts.groupBy("term").agg(F.min("code").alias("code"), F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "code").limit(k).select("code", "term", "n")


def screen(cohort: DataFrame | Column, corpus: DataFrame, pairs: DataFrame, dictionary: DataFrame, eligible: Column, by: tuple[str, ...] = (), least: int = 3, comparator: str = "eligible") -> DataFrame:
    """A10: disproportionality of every code of the cohort (or of each group of `by`) against the corpus.

    a: cohort reports with the code, b: without; c and d: the same outside. Codes of fewer than `least`
    reports are left out, as the rest of the plan needs them in no other way. The cohort is a table of its
    own, or a predicate on the corpus; with a predicate both are counted in one pass over the corpus.
    """
    if comparator == "eligible":
        corpus, cohort = corpus.filter(eligible), cohort if isinstance(cohort, Column) else cohort.filter(eligible)
    if isinstance(cohort, Column):
        marked = corpus.select(KEY, *by, F.coalesce(cohort, F.lit(False)).alias("inside"))
        counts = pairs.join(marked, KEY).groupBy(*by, "code").agg(F.count_if("inside").alias("a"), F.count("*").alias("G"))
        coded = counts.filter(F.col("a") >= least)
        sizes = marked.groupBy(*by).agg(F.count_if("inside").alias("N"), F.count("*").alias("E"))
        if by:  # few rows: groups and codes
            totals, everything = counts.groupBy("code").agg(F.sum("G").alias("G")), sizes.agg(F.sum("E").alias("E"))
            rows = coded.drop("G").join(sizes.drop("E"), list(by)).join(totals, "code").join(F.broadcast(everything))
        else:
            rows = coded.join(F.broadcast(sizes))  # one row
    else:
        inside = cohort.select(KEY, *by)
        coded = pairs.join(inside, KEY).groupBy(*by, "code").agg(F.count("*").alias("a")).filter(F.col("a") >= least)
        sizes = inside.groupBy(*by).agg(F.count("*").alias("N"))
        totals = of_cohort(pairs, corpus).groupBy("code").agg(F.count("*").alias("G"))
        everything = corpus.agg(F.count("*").alias("E"))  # one row
        rows = (coded.join(sizes, list(by)) if by else coded.join(F.broadcast(sizes))).join(totals, "code").join(F.broadcast(everything))
    return _measured(rows, dictionary)


def published_screen(bridge: DataFrame, report_counts: DataFrame, code_counts: DataFrame, dictionary: DataFrame, product_code: str, first: int, last: int | None = None, least: int = 3) -> DataFrame:
    """A10 of one product code on the published bridge, sorted by it, and its two small rollups: only the row groups
    of that code are read, and no report is joined. Undated reports are eligible, as everywhere."""
    years = F.col("y").isNull() | ((F.col("y") >= first) & (F.col("y") <= last if last is not None else F.lit(True)))
    mine = F.col("pc") == product_code
    coded = bridge.filter(mine & years).groupBy("code").agg(F.count("*").alias("a")).filter(F.col("a") >= least)
    sizes = report_counts.filter(years).agg(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias("N"), F.sum("n").alias("E"))
    totals = code_counts.filter(years).groupBy("code").agg(F.sum("n").alias("G"))
    return _measured(coded.join(totals, "code").join(F.broadcast(sizes)), dictionary)  # one row


def _measured(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    N, G, E = F.col("N"), F.col("G"), F.col("E")
    rows = rows.withColumns({"b": N - F.col("a"), "c": G - F.col("a"), "d": E - G - N + F.col("a")})
    cells = [F.col(x) for x in "abcd"]
    return with_terms(rows, dictionary).withColumns(
        {"prr": stats.prr(*cells), "ror": stats.ror(*cells), "ic": stats.information_component(*cells), "chi2": stats.yates(*cells)}
    )


def signals(screened: DataFrame, by: tuple[str, ...] = (), p: Column | None = None) -> DataFrame:
    """A10: adds p, q and the two signal rules to a screen, one flat column a figure."""
    cells = [F.col(x) for x in "abcd"]
    rows = screened.withColumn("p", tails.screen_p(*cells, F.col("chi2")) if p is None else p)
    rows = stats.benjamini_hochberg(rows, "p", "q", by)
    rows = rows.withColumns({"ema": stats.ema_signal(F.col("a"), F.col("prr.point"), F.col("chi2")), "ic_signal": F.coalesce(F.col("ic.ic025") > 0, F.lit(False))})
    return rows.select(*by, "code", "term", "a", "b", "c", "d", *_flat(), "chi2", "p", "q", "ema", "ic_signal")


def _flat() -> list[Column]:
    ratios = [F.col(f"{r}.{x}").alias(r if x == "point" else f"{r}_{x}") for r in ("prr", "ror") for x in ("point", "lo", "hi")]
    return [*ratios, F.col("ic.expected").alias("expected"), F.col("ic.ic").alias("ic"), F.col("ic.ic025").alias("ic025"), F.col("ic.ic975").alias("ic975")]


def flat_screen(screened: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A screen without p values: no Python function in the plan."""
    rows = screened.withColumns({"ema": stats.ema_signal(F.col("a"), F.col("prr.point"), F.col("chi2")), "ic_signal": F.coalesce(F.col("ic.ic025") > 0, F.lit(False))})
    return rows.select(*by, "code", "term", "a", "b", "c", "d", *_flat(), "chi2", "ema", "ic_signal")


def signal_counts(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return found.groupBy(*by).agg(
        counted("ema", "n_ema"), counted("ic_signal", "n_ic"), counted("ema AND ic_signal", "n_both"), counted("q < 0.05", "n_q")
    )


STRATA = {
    "sex": lambda: enrich.sex(F.col("sex_list")),
    "age_band": lambda: enrich.age_band(F.col("age_years_avg")),
    "year": lambda: F.col("report_year").cast("string"),
    "source": lambda: F.upper(F.trim(F.coalesce("SOURCE_TYPE", F.lit("Unknown")))),
    "country": lambda: F.upper(F.trim(F.coalesce("reporter_country_code", F.lit("Unknown")))),
    "occupation": lambda: F.upper(F.trim(F.coalesce("REPORTER_OCCUPATION_CODE", F.lit("UNK")))),
    "implant": lambda: F.when(_true("implant_flag"), "Implant").otherwise("Not implant"),
}


def subgroups(reports: DataFrame, stratum: str, outcome: str) -> DataFrame:
    """All strata's counts."""
    return reports.groupBy(STRATA[stratum]().alias("subgroup")).agg(F.count("*").alias("n"), counted(outcome, "k"))


def subgroup_rates(reports: DataFrame, stratum: str, outcome: str, top: int = 25) -> DataFrame:
    """The largest strata with rate, interval and a mark on those of fewer than 10 reports."""
    rows = subgroups(reports, stratum, outcome)
    total = F.count("*").over(W.partitionBy(F.lit(1)))
    rows = with_wilson(rows.withColumn("strata", total), "k", "n").withColumn("small", F.col("n") < 10)
    return rows.orderBy(F.desc("n"), F.asc_nulls_last("subgroup")).limit(top)


def subgroup_test(reports: DataFrame, stratum: str, outcome: str) -> DataFrame:
    """Chi-square over all strata."""
    rows = subgroups(reports, stratum, outcome).withColumn("rest", F.col("n") - F.col("k"))
    return stats.chi_square(rows.unpivot(["subgroup"], ["k", "rest"], "cell", "count"), "subgroup", "cell", "count")


def yearly_target(reports: DataFrame, target: Column | None = None) -> DataFrame:
    """(report_year, n, k, rate)."""
    k = F.count("*").alias("k") if target is None else counted(target, "k")
    rows = reports.filter("report_year is not null").groupBy("report_year").agg(F.count("*").alias("n"), k)
    return rows.withColumn("rate", 100.0 * F.col("k") / F.col("n"))


def trend(reports: DataFrame, target: Column) -> tuple[DataFrame, DataFrame]:
    """Cochran-Armitage on the yearly proportions, Mann-Kendall on the counts."""
    yearly = yearly_target(reports, target)
    return stats.cochran_armitage(yearly, "report_year", "k", "n"), stats.mann_kendall(yearly, "report_year", "k")


def compared(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Counts and shares of the event classes in two cohorts."""
    keep = lambda df, name: df.select(F.lit(name).alias("cohort"), "EVENT_TYPE")
    rows = keep(a, names[0]).unionByName(keep(b, names[1]))
    sums = rows.groupBy("cohort").agg(F.count("*").alias("n"), *[counted(f"EVENT_TYPE = '{c}'", name) for c, name in CLASSES])
    return sums.withColumns({f"{name}_pct": 100.0 * F.col(name) / F.col("n") for _, name in CLASSES})


def comparison_test(a: DataFrame, b: DataFrame) -> DataFrame:
    long = compared(a, b).unpivot(["cohort"], [name for _, name in CLASSES], "event", "count")
    return stats.chi_square(long, "event", "cohort", "count")


SCENARIOS = (
    ("1 base", {}),
    ("2 without forwarded", {"exclude_forwarded": True}),
    ("3 without rwd", {"exclude_rwd": True}),
    ("4 initial only", {"initial_only": True}),
    ("5 conservative", {"exclude_forwarded": True, "exclude_rwd": True, "initial_only": True}),
)


def sensitivity(reports: DataFrame) -> DataFrame:
    """Five exclusion scenarios in one pass, and the share of the base each keeps."""
    values, tests = [], {name: Cohort(**extra).column() for name, extra in SCENARIOS}
    for i, test in enumerate(tests.values()):
        values += [counted(test, f"n{i}"), counted(test & (F.col("EVENT_TYPE") == "D"), f"d{i}"), counted(test & _true("any_serious_outcome"), f"s{i}")]
    one = reports.agg(*values)
    entries = F.array(*[F.struct(F.lit(name).alias("scenario"), *[F.col(f"{x}{i}").alias(y) for x, y in (("n", "n"), ("d", "deaths"), ("s", "serious"))]) for i, name in enumerate(tests)])
    rows = one.select(F.col("n0").alias("base"), F.inline(entries))
    return with_wilson(rows, "serious", "n").withColumn("retained", F.when(F.col("base") > 0, F.col("n") / F.col("base"))).drop("base")


def reporters(reports: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent occupations, the rest in one row."""
    code = F.coalesce(F.nullif(F.trim("REPORTER_OCCUPATION_CODE"), F.lit("")), F.lit("UNK"))
    counts = reports.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("n"), "code"))
    shown = F.when(rank <= top, F.col("code")).otherwise("All other")
    sums = counts.withColumn("code", shown).groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("codes"))
    return sums.withColumn("occupation", enrich.labelled(F.upper("code"), enrich.OCCUPATION_LABELS))


def sources(reports: DataFrame, top: int = 15) -> DataFrame:
    """Reports for each source of a list."""
    each = reports.select(F.explode(enrich.code_list(F.col("SOURCE_TYPE"))).alias("code"))
    counts = each.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(top)
    return counts.withColumn("source", enrich.labelled(F.col("code"), enrich.SOURCE_LABELS))


def geography(reports: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """Reports for each country, with the dimension's columns where it is given."""
    counts = reports.filter(F.trim("reporter_country_code") != "").groupBy(F.upper(F.trim("reporter_country_code")).alias("country")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("log_n", F.log10(F.col("n") + 1.0))
    return counts if countries is None else counts.join(countries, "country", "left")


def _names(reports: DataFrame) -> DataFrame:
    return reports.filter(F.trim("manufacturer") != "").groupBy("manufacturer").agg(F.count("*").alias("n"))


def manufacturers(reports: DataFrame) -> DataFrame:
    """Each name's reports and share."""
    counts = _names(reports)
    total = counts.agg(F.sum("n").alias("_total"))  # one row, from the same counts
    return counts.join(F.broadcast(total)).select("manufacturer", "n", (F.col("n") * 100.0 / F.col("_total")).alias("share_pct"))


def concentration(reports: DataFrame) -> DataFrame:
    """Names, largest share, Herfindahl index and its class."""
    one = _names(reports).agg(F.count("*").alias("names"), (F.max("n") * 100.0 / F.sum("n")).alias("top_share"), stats.squared_shares(F.col("n")).alias("hhi"))
    return one.withColumn("class", F.when(F.col("hhi") > 2500, "high").when(F.col("hhi") > 1500, "moderate").otherwise("low"))


def reporting_lag(reports: DataFrame) -> DataFrame:
    """Spread of the lags of 0 to 3650 days, and how many are negative."""
    negative = reports.agg(counted("lag_days_raw < 0", "negative"))  # one row
    return spread(reports, F.col("lag_days_raw"), 0.0, 3650.0).join(F.broadcast(negative))


def narratives(reports: DataFrame, parts: DataFrame, kinds: tuple[str, ...], k: int) -> DataFrame:
    """The cohort's untruncated narrative parts of some types."""
    rows = of_cohort(parts, reports).filter(F.upper(F.trim("TEXT_TYPE_CODE")).isin(*kinds))
    return rows.orderBy(KEY, "MDR_TEXT_KEY").limit(k)


def data_quality(reports: DataFrame) -> DataFrame:
    """Percent of reports that fill each field or set each flag; a product code below 95% is marked."""
    rate = lambda c: (F.avg(F.when(F.coalesce(c, F.lit(False)), 100.0).otherwise(0.0)))
    one = reports.agg(*[rate(_filled(reports, c)).alias(c) for c in COMPLETENESS], *[rate(_true(c)).alias(c) for c in FLAGS])
    rows = one.unpivot([], [*COMPLETENESS, *FLAGS], "field", "rate")
    return rows.withColumns({"kind": F.when(F.col("field").isin(*FLAGS), "flag").otherwise("completeness"), "low": (F.col("field") == "product_code") & (F.col("rate") < 95)})


def methods(reports: DataFrame, cohort: Cohort, eligible: Column) -> DataFrame:
    """One row with the criteria, the counts they leave and a paragraph that states them."""
    counts = cohort.of(reports).agg(F.count("*").alias("n"), counted(eligible, "eligible"), F.min("DATE_PREF").alias("first"), F.max("DATE_PREF").alias("last"))
    text = F.format_string(
        "Reports were selected where %s. The selection holds %d reports dated %s to %s; %d of them fall in years with problem codes. "
        "Proportions are of reports, with Wilson 95%% intervals; they are not rates among devices in use.",
        F.lit(cohort.to_sql()), "n", F.col("first").cast("string"), F.col("last").cast("string"), "eligible",
    )
    return counts.withColumns({"criteria": F.lit(cohort.to_sql()), "paragraph": text})
