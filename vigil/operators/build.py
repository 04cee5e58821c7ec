"""The wide reports table and its rollups.

Every input is reduced to one row a report before the joins, which all use the report key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.functions import enrich

KEY = "MDR_REPORT_KEY"
NARRATIVE_CHARS = 4000
JOINT = " || "
SALTS = 64


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or typed nulls where this vintage lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def first_device(device: DataFrame, lexicographic: bool = False) -> DataFrame:
    """Each report's first device by device key (as a number where it is one), ties by all columns."""
    key = F.col("DEVICE_EVENT_KEY")
    order = [key] if lexicographic else [key.cast("string").try_cast("long").asc_nulls_last(), key]
    rest = [c for c in device.columns if c not in (KEY, "DEVICE_EVENT_KEY")]
    rank = F.row_number().over(W.partitionBy(KEY).orderBy(*order, *rest))
    # keyless devices belong to no report, and all of them would be one group
    return device.filter(F.col(KEY).isNotNull()).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def device_count(device: DataFrame) -> DataFrame:
    """B02"""
    return device.groupBy(KEY).agg(F.count("*").cast("int").alias("device_count"))


def joined(values: str, sep: str = ",") -> Column:
    """Sorted distinct filled values in one string; null if there is none."""
    text = F.trim(values)
    found = F.array_sort(F.collect_set(F.when(text != "", text)))
    return F.when(F.size(found) > 0, F.array_join(found, sep))


def _mean(values: str) -> Column:
    """The mean of doubles, the same in whatever order they are added: they are summed as decimals, which is exact to 20
    places. Values too large for that leave the plain mean."""
    exact = F.col(values).try_cast("decimal(28,20)")
    return F.when(F.count(exact) == F.count(values), F.sum(exact).cast("double") / F.count(values)).otherwise(F.avg(values))


def patient_summary(patient: DataFrame) -> DataFrame:
    """B03"""
    rows = patient.select(KEY, enrich.age_years(F.col("PATIENT_AGE")).alias("age"), F.upper("SEQUENCE_NUMBER_OUTCOME").alias("outcome"), F.upper("PATIENT_SEX").alias("sex"))
    return rows.groupBy(KEY).agg(
        F.count("*").cast("int").alias("patient_count"),
        F.min("age").alias("age_years_min"), F.max("age").alias("age_years_max"), _mean("age").alias("age_years_avg"),
        joined("sex").alias("sex_list"), joined("outcome").alias("outcome_codes_raw"),
    )


def problem_list(problem: DataFrame, name: str) -> DataFrame:
    """B04, B05"""
    return problem.groupBy(KEY).agg(joined("PROBLEM_CODE", ", ").alias(name))


def _beginnings(narrative: DataFrame, chars: int) -> DataFrame:
    """The parts of (report, column) of which the joined text's first `chars` characters hold a piece, if only of the
    separator before it; column is narrative_desc or narrative_mfg. Running lengths go by salt first, so that no task orders all parts of a report."""
    kind = F.upper(F.trim("TEXT_TYPE_CODE"))
    column = F.when(kind == "D", "narrative_desc").when(kind.isin("N", "M"), "narrative_mfg")
    parts = narrative.select(KEY, column.alias("_column"), "MDR_TEXT_KEY", F.substring("FOI_TEXT", 1, chars).alias("FOI_TEXT")).filter("_column is not null and FOI_TEXT is not null")
    parts = parts.withColumn("_salt", F.pmod(F.xxhash64("MDR_TEXT_KEY", "FOI_TEXT"), F.lit(SALTS)))
    group, length = [KEY, "_column"], F.length("FOI_TEXT") + len(JOINT)
    for salt in (["_salt"], []):
        before = W.partitionBy(*group, *salt).orderBy("MDR_TEXT_KEY", "FOI_TEXT").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("_start", F.coalesce(F.sum(length).over(before), F.lit(0))).filter(F.col("_start") < chars + len(JOINT))
    return parts.drop("_salt", "_start")


def narrative_flags(narrative: DataFrame) -> DataFrame:
    """The number of parts and the flags their words set."""
    says = lambda phrase: F.coalesce(F.bool_or(F.lower("FOI_TEXT").contains(phrase)), F.lit(False))
    return narrative.groupBy(KEY).agg(
        F.count("*").cast("int").alias("narr_part_count"),
        says("803.22(b)(2)").alias("IS_FORWARDED_803_22_B2"), says("(b)(4)").alias("HAS_REDACTION_B4"), says("(b)(6)").alias("HAS_REDACTION_B6"),
    )


def narrative_texts(narrative: DataFrame, chars: int = NARRATIVE_CHARS) -> DataFrame:
    """Description and manufacturer text in key order."""

    def cut(column: str) -> Column:
        parts = F.sort_array(F.collect_list(F.when(F.col("_column") == column, F.struct("MDR_TEXT_KEY", "FOI_TEXT"))))
        return F.when(F.size(parts) > 0, F.substring(F.array_join(F.transform(parts, lambda x: x["FOI_TEXT"]), JOINT), 1, chars)).alias(column)

    return _beginnings(narrative, chars).groupBy(KEY).agg(cut("narrative_desc"), cut("narrative_mfg"))


def narrative_summary(narrative: DataFrame, chars: int = NARRATIVE_CHARS) -> DataFrame:
    """One row a report, keyless parts together."""
    texts = narrative_texts(narrative, chars).withColumnRenamed(KEY, "_key")
    both = narrative_flags(narrative).join(texts, F.col(KEY).eqNullSafe(F.col("_key")), "left")
    return both.select(KEY, "narr_part_count", "narrative_desc", "narrative_mfg", "IS_FORWARDED_803_22_B2", "HAS_REDACTION_B4", "HAS_REDACTION_B6")


def bridge(problem: DataFrame) -> DataFrame:
    """Distinct (report, code) pairs."""
    return problem.select(KEY, F.trim("PROBLEM_CODE").alias("code")).filter("code <> ''").distinct()


def bridge_of_lists(reports: DataFrame, column: str) -> DataFrame:
    """B09 from the composed code list."""
    return reports.select(KEY, F.explode(F.split(column, ",")).alias("PROBLEM_CODE")).transform(bridge)


#: The report columns that each input supplies; `compose` leaves out the inputs whose columns nobody asks for.
FROM_DEVICE = {"BRAND_NAME", "GENERIC_NAME", "MODEL_NUMBER", "manufacturer", "product_code", "device_age_days", "device_age_text_raw", "implant_flag",
               "device_operator", "device_evaluated_by_manufacturer", "reprocessed_and_reused"}
FROM_PATIENT = {"patient_count", "age_years_min", "age_years_max", "age_years_avg", "sex_list", "any_serious_outcome", "outcome_codes_raw", "outcome_codes",
                *[f"outcome_{x}" for x in enrich.OUTCOME_LABELS.values()]}
FROM_FLAGS = {"IS_FORWARDED_803_22_B2", "HAS_REDACTION_B4", "HAS_REDACTION_B6", "has_narrative", "narr_part_count"}
FROM_TEXTS = {"narrative_desc", "narrative_mfg"}


def compose(mdr: DataFrame, device: DataFrame, patient: DataFrame, narrative: DataFrame, device_problem: DataFrame, patient_problem: DataFrame, columns: tuple[str, ...] = (), first: DataFrame | None = None) -> DataFrame:
    """One wide row a report, or only the given columns of it. All sides share the key, so each input is
    shuffled once. A left join on a unique key adds no row; Spark sees that of grouped sides, not of the first
    device, so a side is joined only if one of its columns is wanted. `first` is a part of `device` that holds each
    report's first one, where the caller can tell it beforehand."""
    rows = mdr
    sides = (
        (FROM_DEVICE, lambda: first_device(device if first is None else first)),
        ({"device_count"}, lambda: device_count(device)),
        (FROM_PATIENT, lambda: patient_summary(patient)),
        (FROM_FLAGS, lambda: narrative_flags(narrative)),
        (FROM_TEXTS, lambda: narrative_texts(narrative)),
        ({"device_problem_codes"}, lambda: problem_list(device_problem, "device_problem_codes")),
        ({"patient_problem_codes"}, lambda: problem_list(patient_problem, "patient_problem_codes")),
    )
    for supplied, side in sides:
        if not columns or supplied & set(columns):
            rows = rows.join(side(), KEY, "left")
    own = [KEY, "DATE_PREF", "report_year", *columns] if columns else []
    has = lambda name, kind="string": optional(rows, name, kind)
    lag = enrich.lag_raw(has("DATE_OF_EVENT_D", "date"), F.col("DATE_PREF"))
    codes = enrich.code_list(has("outcome_codes_raw"))
    supplement = has("SUPPLEMENT_NUMBER")
    wide = rows.select(
        KEY, has("REPORT_NUMBER").alias("REPORT_NUMBER"), has("EVENT_TYPE").alias("EVENT_TYPE"),
        has("DATE_RECEIVED_D", "date").alias("DATE_RECEIVED_D"), has("DATE_OF_EVENT_D", "date").alias("DATE_OF_EVENT_D"), "DATE_PREF",
        F.year("DATE_PREF").alias("report_year"), enrich.month(F.col("DATE_PREF")).alias("report_month"),
        enrich.within(lag, 0, 365).alias("lag_days"), lag.alias("lag_days_raw"),
        has("SOURCE_TYPE").alias("SOURCE_TYPE"), has("REPORTER_OCCUPATION_CODE").alias("REPORTER_OCCUPATION_CODE"),
        enrich.canonical(has("REPORTER_COUNTRY_CODE")).alias("reporter_country_code"),
        F.coalesce(has("IS_RWD_SOURCED", "boolean"), F.lit(False)).alias("IS_RWD_SOURCED"),
        *[has(c, "boolean").alias(c) for c in ("IS_FORWARDED_803_22_B2", "HAS_REDACTION_B4", "HAS_REDACTION_B6")],
        enrich.yes(has("ADVERSE_EVENT_FLAG")).alias("adverse_event_flag"), enrich.yes(has("PRODUCT_PROBLEM_FLAG")).alias("product_problem_flag"),
        enrich.is_supplement(supplement).alias("is_supplement"), enrich.supplement_number(supplement).alias("supplement_number"),
        (~enrich.is_supplement(supplement)).alias("initial_report"),
        has("BRAND_NAME").alias("BRAND_NAME"), has("GENERIC_NAME").alias("GENERIC_NAME"), has("MODEL_NUMBER").alias("MODEL_NUMBER"),
        enrich.canonical(F.coalesce(has("MANUFACTURER_D_NAME"), has("MANUFACTURER_NAME"))).alias("manufacturer"),
        enrich.canonical(has("DEVICE_REPORT_PRODUCT_CODE")).alias("product_code"), F.coalesce(has("device_count", "int"), F.lit(0)).alias("device_count"),
        enrich.device_age_days(has("DEVICE_AGE_TEXT")).alias("device_age_days"), has("DEVICE_AGE_TEXT").alias("device_age_text_raw"),
        enrich.yes(has("IMPLANT_FLAG")).alias("implant_flag"), has("DEVICE_OPERATOR").alias("device_operator"),
        enrich.yes(has("DEVICE_EVALUATED_BY_MANUFACTURER")).alias("device_evaluated_by_manufacturer"), enrich.yes(has("REPROCESSED_AND_REUSED_FLAG")).alias("reprocessed_and_reused"),
        F.coalesce(has("patient_count", "int"), F.lit(0)).alias("patient_count"), *[has(c, "double").alias(c) for c in ("age_years_min", "age_years_max", "age_years_avg")], has("sex_list").alias("sex_list"),
        *[enrich.has_outcome(codes, c).alias(f"outcome_{label}") for c, label in enrich.OUTCOME_LABELS.items()],
        enrich.is_serious(codes).alias("any_serious_outcome"), has("outcome_codes_raw").alias("outcome_codes_raw"), codes.alias("outcome_codes"),
        has("device_problem_codes").alias("device_problem_codes"), has("patient_problem_codes").alias("patient_problem_codes"),
        (F.coalesce(has("narr_part_count", "int"), F.lit(0)) > 0).alias("has_narrative"), F.coalesce(has("narr_part_count", "int"), F.lit(0)).alias("narr_part_count"),
        has("narrative_desc").alias("narrative_desc"), has("narrative_mfg").alias("narrative_mfg"),
    )
    return wide.select(*dict.fromkeys(own)) if own else wide


def refresh_patient_problems(reports: DataFrame, patient_problem: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports with their patient problems replaced, the new bridge and the new counts. Reports that lost
    all codes lose them here too; other columns pass through."""
    fresh = reports.drop("patient_problem_codes").join(problem_list(patient_problem, "patient_problem_codes"), KEY, "left")
    pairs = bridge(patient_problem)
    return fresh.select(reports.columns), pairs, problem_totals(pairs)


def orphans(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Rows whose report does not exist."""
    return child.join(parent.select(KEY), KEY, "left_anti")


# ---- rollups -------------------------------------------------------------------------------


def counted(c: str | Column, name: str) -> Column:
    return F.count_if(F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False))).alias(name)


def yearly_events(reports: DataFrame) -> DataFrame:
    """R01"""
    return reports.groupBy("report_year", "EVENT_TYPE").agg(
        F.count("*").alias("n"), counted("IS_RWD_SOURCED", "n_rwd"), counted("initial_report", "n_initial"), counted("is_supplement", "n_supplement")
    )


def yearly_outcomes(reports: DataFrame) -> DataFrame:
    """R02"""
    harms = [counted(f"outcome_{x}", f"n_{x}") for x in enrich.OUTCOME_LABELS.values()]
    return reports.groupBy("report_year").agg(F.count("*").alias("n"), *harms, counted("any_serious_outcome", "n_serious"))


def _events() -> list[Column]:
    return [counted(f"EVENT_TYPE = '{code}'", name) for code, name in (("D", "deaths"), ("IN", "injuries"), ("M", "malfunctions"))]


def by_dimension(reports: DataFrame, column: str) -> DataFrame:
    """Counts for each filled value of product_code, manufacturer or reporter_country_code."""
    filled = reports.filter(F.trim(column) != "")
    return filled.groupBy(column).agg(F.count("*").alias("n"), *_events(), F.min("report_year").alias("first_year"), F.max("report_year").alias("last_year"))


def problem_totals(pairs: DataFrame) -> DataFrame:
    """Reports per code; pairs are distinct, so rows are reports."""
    return pairs.groupBy("code").agg(F.count("*").alias("n_reports"))


def corpus_facts(reports: DataFrame, eligible_from: int) -> DataFrame:
    """R08"""
    return reports.agg(
        F.count("*").alias("n"), F.min("report_year").alias("first_year"), F.max("report_year").alias("last_year"), F.max("DATE_PREF").alias("vintage"),
        counted(F.col("report_year").isNull() | (F.col("report_year") >= eligible_from), "eligible"),
        F.count_distinct("REPORT_NUMBER").alias("events"), F.count_distinct("product_code").alias("product_codes"),
        F.count_distinct("manufacturer").alias("manufacturers"), counted("EVENT_TYPE = 'D'", "deaths"), counted("any_serious_outcome", "serious"),
    )
