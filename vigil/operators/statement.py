"""What a study of a cohort reports about itself: criteria in sentences, and a text for each item of a reporting
checklist for observational studies, with the counts that belong there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.enrich import EVENT_LABELS

from .build import counted
from .cohort import Cohort


def criteria(cohort: Cohort) -> list[str]:
    """One sentence for each criterion that is set; a report key stands alone, as in the cohort itself."""
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    if cohort.report_key:
        return [f"The single report with key {cohort.report_key}."]
    lo, hi = cohort.year_lo, cohort.year_hi
    spans = {(True, True): f"Preferred report date in {lo} to {hi}.", (True, False): f"Preferred report date in {lo} or later.", (False, True): f"Preferred report date in {hi} or earlier.", (False, False): ""}
    out = [
        spans[lo is not None, hi is not None],
        f"Product code {cohort.product_code.strip().upper()}." if cohort.product_code else "",
        f"Manufacturer's name contains {quoted([cohort.manufacturer])}, in any case." if cohort.manufacturer else "",
        f"Brand, generic or model name contains one of {quoted(cohort.device_terms)}, in any case." if cohort.device_terms else "",
        f"The kept event description contains {quoted([cohort.narrative])}, in any case." if cohort.narrative else "",
        f"Event type is one of {', '.join(EVENT_LABELS.get(e, e) for e in cohort.event_types)}." if 0 < len(cohort.event_types) < 3 else "",
        "Reports forwarded under 21 CFR 803.22(b)(2) are left out." if cohort.exclude_forwarded else "",
        "Reports from real-world data sources are left out." if cohort.exclude_rwd else "",
        "Supplements are left out, so that an event counts once." if cohort.initial_only else "",
        "The device is marked as an implant." if cohort.implant_only else "",
        "At least one serious outcome (D, L, H, S, C or R) is recorded." if cohort.serious_only else "",
    ]
    return [x for x in out if x] or ["All reports."]


#: (number of the checklist's item, item, text); names in braces stand for counts and for the cohort's criteria.
ITEMS = (
    ("4", "study design", "Retrospective study of published reports of adverse events with medical devices; the newest is dated {vintage}."),
    ("5", "setting", "Every report that the regulator publishes was loaded, {corpus} in all; the selected ones are dated {first} to {last}."),
    ("6", "participants", "Selected were reports as follows. {criteria} {n} reports met this, which name {events} different events."),
    ("7", "variables", "Seven outcomes are told from a report's outcome codes; any of D, L, H, S, C and R is serious. The device is the report's first."),
    ("8", "data sources", "Patients, devices, narratives and problem codes were reduced to one row a report and joined on its key."),
    ("9", "bias", "Reporting is voluntary in part, follows publicity and differs between reporters; supplements may repeat an event."),
    ("10", "study size", "The size is the number of reports that met the criteria, {n}; no sample was drawn."),
    ("11", "quantitative variables", "Ages are in years and days as converted from the reported units; lags beyond 0 to 365 days are missing."),
    ("12", "statistical methods", "Proportions carry Wilson 95% intervals, differences Newcombe intervals, tables Pearson's chi-square. Codes are screened by PRR, ROR and the information component against {eligible_corpus} reports of years with problem codes; p values are adjusted by Benjamini and Hochberg. Trends are tested by Cochran-Armitage and Mann-Kendall."),
    ("13", "participants in numbers", "{n} reports were selected; {eligible} of them are of years with problem codes."),
    ("15", "outcome data", "{deaths} selected reports are of deaths, {injuries} of injuries, {malfunctions} of malfunctions; {serious} have a serious outcome."),
    ("19", "limitations", "No number of devices in use is known: shares are of reports and are no rates. A signal is a question, not a cause."),
    ("22", "reproducibility", "The selection in SQL: {sql}"),
)


def statement(reports: DataFrame, cohort: Cohort, eligible: Column) -> DataFrame:
    """(position, number, item, text): the statement, its counts from one pass over the reports."""
    inside = F.coalesce(cohort.column(), F.lit(False))
    mine = lambda c, name: counted(inside & F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)), name)
    day = lambda f, c: f(c).cast("string")
    one = reports.agg(
        F.count("*").alias("corpus"), counted(eligible, "eligible_corpus"), day(F.max, F.col("DATE_PREF")).alias("vintage"), counted(inside, "n"), mine(eligible, "eligible"),
        day(F.min, F.when(inside, F.col("DATE_PREF"))).alias("first"), day(F.max, F.when(inside, F.col("DATE_PREF"))).alias("last"), F.count_distinct(F.when(inside, F.col("REPORT_NUMBER"))).alias("events"),
        mine("EVENT_TYPE = 'D'", "deaths"), mine("EVENT_TYPE = 'IN'", "injuries"), mine("EVENT_TYPE = 'M'", "malfunctions"), mine("any_serious_outcome", "serious"),
    )
    names = one.columns
    one = one.withColumns({"criteria": F.lit(" ".join(criteria(cohort))), "sql": F.lit(cohort.to_sql())})
    listed = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(no).alias("number"), F.lit(item).alias("item"), F.lit(text).alias("text")) for i, (no, item, text) in enumerate(ITEMS)])
    rows = one.select("*", F.inline(listed))
    filled = reduce(lambda text, name: F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("none"))), [*names, "criteria", "sql"], F.col("text"))
    return rows.select("position", "number", "item", filled.alias("text"))
