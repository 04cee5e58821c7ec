"""The registered queries over the driver tables, each beside the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import enrich, stats, tails
from vigil.operators import analyses as an
from vigil.operators import build, checks, publish, search, text
from vigil.operators.build import KEY
from vigil.operators.cohort import Cohort, eligible, of_cohort, saying
from vigil.sources import pipe_files
from vigil.streaming import incremental

from .lens import ELIGIBLE_FROM, Lens

# The twin of `Lens` and `build.compose`.
LENS = """
WITH device AS (
  SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, p_name, p_type, s_name, p_brand, p_size,
    CAST(p_size AS VARCHAR) || ' ' || (['YR', 'mo', 'WK', 'DY', 'HR', 'DEC'])[p_size % 6 + 1] AS age_text
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
first_device AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn FROM device) WHERE rn = 1),
device_count AS (SELECT k, CAST(count(*) AS INTEGER) AS device_count FROM device GROUP BY k),
patient AS (
  SELECT l_orderkey AS k,
    CASE WHEN l_linenumber % 5 IN (0, 1) THEN l_quantity WHEN l_linenumber % 5 = 2 THEN l_quantity * (1 / 12.0::DOUBLE) WHEN l_linenumber % 5 = 3 THEN l_quantity * 10.0 ELSE l_quantity END AS age,
    (['F', 'M', '', 'F'])[l_suppkey % 4 + 1] AS sex,
    CASE WHEN l_quantity >= 49 THEN 'D' WHEN l_quantity >= 47 THEN 'L' WHEN l_quantity >= 44 THEN 'H' WHEN l_quantity >= 42 THEN 'S' WHEN l_quantity >= 41 THEN 'C' WHEN l_quantity >= 36 THEN 'R' WHEN l_quantity >= 31 THEN 'O' END AS outcome
  FROM (SELECT * REPLACE (CAST(floor(l_quantity) AS DOUBLE) AS l_quantity) FROM lineitem)),
patient_agg AS (
  SELECT k, CAST(count(*) AS INTEGER) AS patient_count, min(age) AS age_min, max(age) AS age_max, avg(age) AS age_avg,
    string_agg(DISTINCT sex, ',' ORDER BY sex) FILTER (WHERE sex <> '') AS sex_list, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes
  FROM patient GROUP BY k),
narrative AS (SELECT conv_id AS k, turn, CASE role WHEN 'user' THEN 'D' WHEN 'assistant' THEN 'N' ELSE 'M' END AS kind, text FROM conversations),
narrative_agg AS (
  SELECT k, CAST(count(*) AS INTEGER) AS parts, substr(string_agg(text, ' || ' ORDER BY turn, text) FILTER (WHERE kind = 'D'), 1, 4000) AS narrative_desc,
    substr(string_agg(text, ' || ' ORDER BY turn, text) FILTER (WHERE kind IN ('N', 'M')), 1, 4000) AS narrative_mfg,
    coalesce(bool_or(contains(lower(text), '803.22(b)(2)')), false) AS fwd, coalesce(bool_or(contains(lower(text), '(b)(4)')), false) AS b4, coalesce(bool_or(contains(lower(text), '(b)(6)')), false) AS b6
  FROM narrative GROUP BY k),
pairs AS (SELECT DISTINCT l_orderkey AS k, CAST(p_size AS VARCHAR) AS code FROM lineitem JOIN part ON l_partkey = p_partkey),
problems AS (SELECT k, string_agg(code, ', ' ORDER BY code) AS codes FROM pairs GROUP BY k),
patient_problems AS (SELECT k, string_agg(DISTINCT code, ', ' ORDER BY code) AS codes FROM (SELECT l_orderkey AS k, l_returnflag || l_linestatus AS code FROM lineitem) GROUP BY k),
dictionary AS (SELECT CAST(p_size AS VARCHAR) AS code, min(p_type) AS term FROM part WHERE p_size % 10 <> 0 GROUP BY p_size),
line_facts AS (SELECT l_orderkey AS k, CAST(min(l_shipdate) AS DATE) AS event, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS source FROM lineitem GROUP BY 1),
reports AS (
  SELECT o_orderkey AS k, CASE WHEN o_custkey % 10 = 0 THEN 'RWD-' ELSE 'R-' END || CAST(o_custkey AS VARCHAR) AS report_number,
    CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'IN' ELSE 'M' END AS event_type, CAST(o_orderdate AS DATE) AS date_pref, event AS date_of_event,
    CAST(year(o_orderdate) AS INTEGER) AS report_year, strftime(o_orderdate, '%Y-%m') AS report_month,
    CAST(date_diff('day', event, CAST(o_orderdate AS DATE)) AS INTEGER) AS lag_raw, source AS source_type, left(o_orderpriority, 1) AS occupation, upper(trim(n_name)) AS country,
    o_custkey % 10 = 0 AS is_rwd, fwd, b4, b6, o_totalprice > 150000 AS adverse,
    o_orderkey % 7 IN (1, 5) AS is_supplement, CASE o_orderkey % 7 WHEN 1 THEN 1 WHEN 5 THEN 2 WHEN 2 THEN NULL ELSE 0 END AS supplement_number,
    p_name AS brand, p_type AS generic, upper(trim(s_name)) AS manufacturer, upper(trim(p_brand)) AS product_code, coalesce(device_count, 0) AS device_count,
    CASE p_size % 6 WHEN 0 THEN p_size * 365.25 WHEN 1 THEN p_size * 30.4375 WHEN 2 THEN p_size * 7.0 WHEN 3 THEN p_size * 1.0 WHEN 4 THEN p_size / 24.0 END::DOUBLE AS device_age_days, age_text,
    coalesce(p_size % 3 = 0, false) AS implant, coalesce(patient_count, 0) AS patient_count, age_min, age_max, age_avg, sex_list, outcomes,
    coalesce(contains(outcomes, 'D'), false) AS o_death, coalesce(contains(outcomes, 'L'), false) AS o_life, coalesce(contains(outcomes, 'H'), false) AS o_hosp, coalesce(contains(outcomes, 'S'), false) AS o_dis,
    coalesce(contains(outcomes, 'C'), false) AS o_cong, coalesce(contains(outcomes, 'R'), false) AS o_req, coalesce(contains(outcomes, 'O'), false) AS o_other,
    coalesce(regexp_matches(outcomes, '[DLHSCR]'), false) AS serious,
    problems.codes AS device_problem_codes, patient_problems.codes AS patient_problem_codes, coalesce(parts, 0) AS parts, narrative_desc, narrative_mfg,
    CASE upper(left(coalesce(sex_list, 'U'), 1)) WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' ELSE 'Unknown' END AS sex,
    CASE WHEN age_avg IS NULL THEN 'Unknown' WHEN age_avg < 1 THEN '<1 year' WHEN age_avg < 18 THEN '1-17' WHEN age_avg < 35 THEN '18-34' WHEN age_avg < 50 THEN '35-49' WHEN age_avg < 65 THEN '50-64' WHEN age_avg < 80 THEN '65-79' ELSE '80+' END AS age_band
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN line_facts ON line_facts.k = o_orderkey
    LEFT JOIN first_device ON first_device.k = o_orderkey LEFT JOIN device_count ON device_count.k = o_orderkey LEFT JOIN patient_agg ON patient_agg.k = o_orderkey
    LEFT JOIN narrative_agg ON narrative_agg.k = o_orderkey LEFT JOIN problems ON problems.k = o_orderkey LEFT JOIN patient_problems ON patient_problems.k = o_orderkey)
"""


def _wilson(k: str, n: str) -> str:
    """SQL of the Wilson interval in percent, as rate, lo and hi."""
    z = "1.959963984540054"
    p, k, n = f"(CAST({k} AS DOUBLE) / {n})", f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    centre = f"(({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    half = f"({z} / (1 + {z} * {z} / {n}) * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})))"
    lo, hi = f"CASE WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END", f"CASE WHEN {k} = {n} THEN 1.0 ELSE least(1.0, {centre} + {half}) END"
    return f"round(100 * {p}, 6) AS rate, round(100 * ({lo}), 6) AS lo, round(100 * ({hi}), 6) AS hi"


def _tail(x: str, df: str) -> str:
    """SQL of the chi-square tail, by the series of the lower incomplete gamma function."""
    term = f"exp(({df} / 2.0 + i) * ln({x} / 2) - {x} / 2 - lgamma({df} / 2.0 + i + 1))"
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 200 THEN 0.0 WHEN {x} > 0 THEN 1 - list_sum(list_transform(range(0, 400), lambda i: {term})) END"


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, on both sides of the comparison."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, lens: bool = True):
    def add(f: Callable[[Lens], DataFrame]):
        QUERIES[name] = lambda spark, folder: _rounded(f(Lens(spark, folder)))
        if sql is not None:
            SQL[name] = (LENS if lens else "") + sql
        return f

    return add


BRAND = Cohort(product_code="Brand#2", year_lo=ELIGIBLE_FROM)
_CELLS = "CAST(a AS DOUBLE) AS a1, CAST(b AS DOUBLE) AS b1, CAST(c AS DOUBLE) AS c1, CAST(d AS DOUBLE) AS d1"
_MEASURES = """
ratios AS (
  SELECT *, (a1 + .5) / (a1 + b1 + 1) / ((c1 + .5) / (c1 + d1 + 1)) AS prr0, sqrt(1 / (a1 + .5) - 1 / (a1 + b1 + 1) + 1 / (c1 + .5) - 1 / (c1 + d1 + 1)) AS prr_se,
    (a1 + .5) * (d1 + .5) / ((b1 + .5) * (c1 + .5)) AS ror0, sqrt(1 / (a1 + .5) + 1 / (b1 + .5) + 1 / (c1 + .5) + 1 / (d1 + .5)) AS ror_se,
    (a1 + b1) * (a1 + c1) / (a1 + b1 + c1 + d1) AS expected0,
    CASE WHEN (a1 + b1) * (c1 + d1) * (a1 + c1) * (b1 + d1) > 0 THEN pow(greatest(0.0, abs(a1 * d1 - b1 * c1) - (a1 + b1 + c1 + d1) / 2), 2) * (a1 + b1 + c1 + d1) / ((a1 + b1) * (c1 + d1) * (a1 + c1) * (b1 + d1)) END AS chi20
  FROM cells),
measured AS (
  SELECT *, log2((a1 + .5) / (expected0 + .5)) AS ic0 FROM ratios)
"""
_FLAT = """
round(prr0, 6) AS prr, round(exp(ln(prr0) - 1.959963984540054 * prr_se), 6) AS prr_lo, round(exp(ln(prr0) + 1.959963984540054 * prr_se), 6) AS prr_hi,
round(ror0, 6) AS ror, round(exp(ln(ror0) - 1.959963984540054 * ror_se), 6) AS ror_lo, round(exp(ln(ror0) + 1.959963984540054 * ror_se), 6) AS ror_hi,
round(expected0, 6) AS expected, round(ic0, 6) AS ic, round(ic0 - 3.3 / sqrt(a1 + .5) - 2.0 / pow(a1 + .5, 1.5), 6) AS ic025, round(ic0 + 2.4 / sqrt(a1 + .5) - 0.5 / pow(a1 + .5, 1.5), 6) AS ic975,
round(chi20, 6) AS chi2, coalesce(a >= 3 AND prr0 >= 2 AND chi20 >= 4, false) AS ema, ic0 - 3.3 / sqrt(a1 + .5) - 2.0 / pow(a1 + .5, 1.5) > 0 AS ic_signal
"""


def _measured_sql(cohort: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    sizes = f"sizes AS (SELECT {key}count(*) AS n FROM inside {'GROUP BY ' + by if by else ''})"
    return f""", corpus AS (SELECT * FROM reports WHERE report_year IS NULL OR report_year >= {ELIGIBLE_FROM}),
inside AS (SELECT * FROM corpus WHERE {cohort}), {sizes},
coded AS (SELECT {key}code, count(*) AS a FROM pairs JOIN inside USING (k) GROUP BY {key}code HAVING count(*) >= 3),
totals AS (SELECT code, count(*) AS g FROM pairs JOIN corpus USING (k) GROUP BY code),
tables AS (SELECT {key}code, a, n - a AS b, g - a AS c, (SELECT count(*) FROM corpus) - g - n + a AS d FROM coded JOIN totals USING (code) {'JOIN sizes USING (' + by + ')' if by else ', sizes'}),
cells AS (SELECT *, {_CELLS} FROM tables), {_MEASURES}"""


def _screen_sql(cohort: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return _measured_sql(cohort, by) + f"""
SELECT {key}code, coalesce(term, code) AS term, a, b, c, d, {_FLAT} FROM measured LEFT JOIN dictionary USING (code)"""


@register("flagship_signal_screen", _screen_sql("product_code = 'BRAND#2'"))
def flagship(x: Lens) -> DataFrame:
    rows = x.some("product_code")
    return an.flat_screen(an.screen(BRAND.column(), rows, x.pairs, x.dictionary, eligible(ELIGIBLE_FROM)))


@register("published_signal_screen", _screen_sql("product_code = 'BRAND#2'"))
def screen_published(x: Lens) -> DataFrame:
    reports = x.some("product_code")
    bridge = publish.published_bridge(x.pairs, reports)
    return an.flat_screen(an.published_screen(bridge, publish.report_counts(reports), publish.code_counts(bridge), x.dictionary, "BRAND#2", ELIGIBLE_FROM))


@register("signal_screen_all_products", _screen_sql("product_code IS NOT NULL", "product_code"))
def screen_all(x: Lens) -> DataFrame:
    rows = x.some("product_code")
    return an.flat_screen(an.screen(F.col("product_code").isNotNull(), rows, x.pairs, x.dictionary, eligible(ELIGIBLE_FROM), by=("product_code",)), by=("product_code",))


_TESTED = f"""{_measured_sql("product_code = 'BRAND#2'")},
fisher_x AS (SELECT code, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM measured WHERE least(a, b, c, d) BETWEEN 0 AND 9),
fisher_l AS (SELECT code, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS base,
    lgamma(i + 1) + lgamma(a + b - i + 1) + lgamma(a + c - i + 1) + lgamma(d - a + i + 1) AS at_i, lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1) AS at_a FROM fisher_x),
fisher AS (SELECT code, least(1.0, sum(exp(base - at_i)) FILTER (WHERE at_i >= at_a - 1e-9)) AS p_exact FROM fisher_l GROUP BY code),
tested AS (SELECT measured.*, coalesce(p_exact, {_tail("chi20", "1")}) AS p0 FROM measured LEFT JOIN fisher USING (code)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p0 IS NULL ORDER BY p0) AS rank, count(p0) OVER () AS tests FROM tested),
found AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN least(1.0, min(p0 * tests / rank) OVER (PARTITION BY p0 IS NULL ORDER BY rank DESC)) END AS q0 FROM ranked)
"""


@register("signal_screen_p_values", f"{_TESTED} SELECT code, coalesce(term, code) AS term, a, b, c, d, {_FLAT}, round(p0, 6) AS p, round(q0, 6) AS q FROM found LEFT JOIN dictionary USING (code)")
def screen_p(x: Lens) -> DataFrame:
    rows = x.some("product_code")
    return an.signals(an.screen(BRAND.column(), rows, x.pairs, x.dictionary, eligible(ELIGIBLE_FROM)))


@register("signal_counts", f"""{_TESTED}, flat AS (SELECT {_FLAT}, q0 FROM found)
SELECT count(*) FILTER (WHERE ema) AS n_ema, count(*) FILTER (WHERE ic_signal) AS n_ic, count(*) FILTER (WHERE ema AND ic_signal) AS n_both, count(*) FILTER (WHERE q0 < 0.05) AS n_q FROM flat""")
def counts(x: Lens) -> DataFrame:
    return an.signal_counts(screen_p(x))


@register("first_device", """SELECT k AS "MDR_REPORT_KEY", l_linenumber AS "DEVICE_EVENT_KEY", p_name AS "BRAND_NAME", p_brand AS "DEVICE_REPORT_PRODUCT_CODE", s_name AS "MANUFACTURER_D_NAME" FROM first_device""")
def first_device(x: Lens) -> DataFrame:
    return build.first_device(x.first()).select(KEY, "DEVICE_EVENT_KEY", "BRAND_NAME", "DEVICE_REPORT_PRODUCT_CODE", "MANUFACTURER_D_NAME")


@register("device_count", """SELECT k AS "MDR_REPORT_KEY", device_count FROM device_count""")
def device_count(x: Lens) -> DataFrame:
    return build.device_count(x.device)


@register("patient_summary", """SELECT k AS "MDR_REPORT_KEY", patient_count, round(age_min, 6) AS age_years_min, round(age_max, 6) AS age_years_max, round(age_avg, 6) AS age_years_avg, sex_list, outcomes AS outcome_codes_raw FROM patient_agg""")
def patient_summary(x: Lens) -> DataFrame:
    return build.patient_summary(x.patient)


@register("problem_lists", """SELECT k AS "MDR_REPORT_KEY", problems.codes AS device_problem_codes, patient_problems.codes AS patient_problem_codes FROM problems FULL JOIN patient_problems USING (k)""")
def problem_lists(x: Lens) -> DataFrame:
    return build.problem_list(x.device_problem, "device_problem_codes").join(build.problem_list(x.patient_problem, "patient_problem_codes"), KEY, "full")


@register("problem_bridge", """SELECT k AS "MDR_REPORT_KEY", code FROM pairs""")
def problem_bridge(x: Lens) -> DataFrame:
    return x.pairs


@register("problem_bridge_from_lists", """SELECT k AS "MDR_REPORT_KEY", code FROM pairs JOIN reports USING (k)""")
def bridge_lists(x: Lens) -> DataFrame:
    return build.bridge_of_lists(x.some("device_problem_codes"), "device_problem_codes")


@register("narrative_summary", """SELECT k AS "MDR_REPORT_KEY", parts AS narr_part_count, narrative_desc, narrative_mfg, fwd AS "IS_FORWARDED_803_22_B2", b4 AS "HAS_REDACTION_B4", b6 AS "HAS_REDACTION_B6" FROM narrative_agg""")
def narrative_summary(x: Lens) -> DataFrame:
    return build.narrative_summary(x.narrative)


@register("report_compose", """SELECT k AS "MDR_REPORT_KEY", report_number AS "REPORT_NUMBER", event_type AS "EVENT_TYPE", date_pref AS "DATE_RECEIVED_D", date_of_event AS "DATE_OF_EVENT_D", date_pref AS "DATE_PREF", report_year, report_month,
  CASE WHEN lag_raw BETWEEN 0 AND 365 THEN lag_raw END AS lag_days, lag_raw AS lag_days_raw, source_type AS "SOURCE_TYPE", occupation AS "REPORTER_OCCUPATION_CODE", country AS reporter_country_code,
  is_rwd AS "IS_RWD_SOURCED", fwd AS "IS_FORWARDED_803_22_B2", b4 AS "HAS_REDACTION_B4", b6 AS "HAS_REDACTION_B6", adverse AS adverse_event_flag, false AS product_problem_flag, is_supplement, CAST(supplement_number AS INTEGER) AS supplement_number, NOT is_supplement AS initial_report,
  brand AS "BRAND_NAME", generic AS "GENERIC_NAME", generic AS "MODEL_NUMBER", manufacturer, product_code, device_count, round(device_age_days, 6) AS device_age_days, age_text AS device_age_text_raw, implant AS implant_flag, CAST(NULL AS VARCHAR) AS device_operator,
  false AS device_evaluated_by_manufacturer, false AS reprocessed_and_reused, patient_count, round(age_min, 6) AS age_years_min, round(age_max, 6) AS age_years_max, round(age_avg, 6) AS age_years_avg, sex_list,
  o_death AS outcome_death, o_life AS outcome_life_threatening, o_hosp AS outcome_hospitalization, o_dis AS outcome_disability, o_cong AS outcome_congenital_anomaly, o_req AS outcome_required_intervention, o_other AS outcome_other, serious AS any_serious_outcome, outcomes AS outcome_codes_raw,
  device_problem_codes, patient_problem_codes, parts > 0 AS has_narrative, parts AS narr_part_count, narrative_desc, narrative_mfg FROM reports""")
def compose(x: Lens) -> DataFrame:
    return x.reports.drop("outcome_codes")


@register("rollup_yearly_events", """SELECT report_year, event_type AS "EVENT_TYPE", count(*) AS n, count(*) FILTER (WHERE is_rwd) AS n_rwd, count(*) FILTER (WHERE NOT is_supplement) AS n_initial, count(*) FILTER (WHERE is_supplement) AS n_supplement FROM reports GROUP BY ALL""")
def r01(x: Lens) -> DataFrame:
    return build.yearly_events(x.some("EVENT_TYPE", "IS_RWD_SOURCED", "initial_report", "is_supplement"))


@register("rollup_yearly_outcomes", """SELECT report_year, count(*) AS n, count(*) FILTER (WHERE o_death) AS n_death, count(*) FILTER (WHERE o_life) AS n_life_threatening, count(*) FILTER (WHERE o_hosp) AS n_hospitalization, count(*) FILTER (WHERE o_dis) AS n_disability, count(*) FILTER (WHERE o_cong) AS n_congenital_anomaly, count(*) FILTER (WHERE o_req) AS n_required_intervention, count(*) FILTER (WHERE o_other) AS n_other, count(*) FILTER (WHERE serious) AS n_serious FROM reports GROUP BY ALL""")
def r02(x: Lens) -> DataFrame:
    return build.yearly_outcomes(x.some(*an.OUTCOMES))


def _dimension(column: str, own: str) -> None:
    sql = f"""SELECT {own} AS {column}, count(*) AS n, count(*) FILTER (WHERE event_type = 'D') AS deaths, count(*) FILTER (WHERE event_type = 'IN') AS injuries, count(*) FILTER (WHERE event_type = 'M') AS malfunctions, min(report_year) AS first_year, max(report_year) AS last_year FROM reports WHERE {own} IS NOT NULL GROUP BY ALL"""
    register(f"rollup_{column}", sql)(lambda x: build.by_dimension(x.some(column, "EVENT_TYPE"), column))


for _column, _own in (("product_code", "product_code"), ("manufacturer", "manufacturer"), ("reporter_country_code", "country")):
    _dimension(_column, _own)


@register("problem_totals", "SELECT code, count(*) AS n_reports FROM pairs GROUP BY code")
def r06(x: Lens) -> DataFrame:
    return build.problem_totals(x.pairs)


@register("patient_problem_totals", "SELECT code, count(DISTINCT k) AS n_reports FROM (SELECT l_orderkey AS k, l_returnflag || l_linestatus AS code FROM lineitem) GROUP BY code")
def r07(x: Lens) -> DataFrame:
    return build.problem_totals(build.bridge(x.patient_problem))


@register("corpus_facts", f"""SELECT count(*) AS n, min(report_year) AS first_year, max(report_year) AS last_year, max(date_pref) AS vintage, count(*) FILTER (WHERE report_year >= {ELIGIBLE_FROM}) AS eligible, count(DISTINCT report_number) AS events, count(DISTINCT product_code) AS product_codes, count(DISTINCT manufacturer) AS manufacturers, count(*) FILTER (WHERE event_type = 'D') AS deaths, count(*) FILTER (WHERE serious) AS serious FROM reports""")
def r08(x: Lens) -> DataFrame:
    return build.corpus_facts(x.some("REPORT_NUMBER", "product_code", "manufacturer", "EVENT_TYPE", "any_serious_outcome"), ELIGIBLE_FROM)


@register("refresh_patient_problems", """SELECT k AS "MDR_REPORT_KEY", report_year, string_agg(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_returnflag || l_linestatus END, ', ' ORDER BY CASE WHEN l_linestatus = 'F' THEN l_returnflag || l_linestatus END) AS patient_problem_codes FROM reports LEFT JOIN lineitem ON l_orderkey = k GROUP BY ALL""")
def b10(x: Lens) -> DataFrame:
    return build.refresh_patient_problems(x.some("patient_problem_codes"), x.patient_problem.filter("PROBLEM_CODE like '%F'"))[0].select(KEY, "report_year", "patient_problem_codes")


@register("orphan_narratives", """SELECT k AS "MDR_REPORT_KEY", turn AS "MDR_TEXT_KEY", kind AS "TEXT_TYPE_CODE", text AS "FOI_TEXT" FROM narrative WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def b11(x: Lens) -> DataFrame:
    """Parts that have no report in a table of deaths alone; in the whole table all have one."""
    return build.orphans(x.narrative, x.mdr.filter("EVENT_TYPE = 'D'"))


_COHORTS = {
    "years_events": (Cohort(year_lo=1997, year_hi=1999, event_types=("D", "IN")), "report_year BETWEEN 1997 AND 1999 AND event_type IN ('D', 'IN')", ()),
    "device_terms": (Cohort.from_terms("gizmo; PROMO"), "(contains(lower(brand), 'gizmo') OR contains(lower(generic), 'gizmo') OR contains(lower(brand), 'promo') OR contains(lower(generic), 'promo'))", ("BRAND_NAME", "GENERIC_NAME", "MODEL_NUMBER")),
    "manufacturer": (Cohort(manufacturer="#00000001", serious_only=True), "contains(lower(manufacturer), '#00000001') AND serious", ("manufacturer", "any_serious_outcome")),
    "exclusions": (Cohort(exclude_forwarded=True, exclude_rwd=True, initial_only=True, implant_only=True), "NOT coalesce(fwd, false) AND NOT is_rwd AND NOT is_supplement AND implant", ("IS_FORWARDED_803_22_B2", "IS_RWD_SOURCED", "initial_report", "implant_flag")),
    "report_key": (Cohort(report_key="7", serious_only=True), "k = 7", ()),
}
for _name, (_cohort, _where, _columns) in _COHORTS.items():
    register(f"cohort_{_name}", f"""SELECT k AS "MDR_REPORT_KEY", event_type AS "EVENT_TYPE", report_year FROM reports WHERE {_where}""")(
        lambda x, c=_cohort, columns=_columns: Cohort.from_json(c.to_json()).of(x.some("EVENT_TYPE", *columns)).select(KEY, "EVENT_TYPE", "report_year")
    )


@register("cohort_narrative", """SELECT k AS "MDR_REPORT_KEY", event_type AS "EVENT_TYPE", report_year FROM reports WHERE k IN (SELECT k FROM narrative WHERE kind = 'D' AND contains(lower(text), 'the'))""")
def c06(x: Lens) -> DataFrame:
    return saying(x.some("EVENT_TYPE"), x.narrative, "the").select(KEY, "EVENT_TYPE", "report_year")


@register("cohort_narrative_kept", """SELECT k AS "MDR_REPORT_KEY", event_type AS "EVENT_TYPE", report_year FROM reports WHERE contains(lower(narrative_desc), 'the')""")
def c06_kept(x: Lens) -> DataFrame:
    return Cohort.from_json(Cohort(narrative="the").to_json()).of(x.some("EVENT_TYPE", "narrative_desc")).select(KEY, "EVENT_TYPE", "report_year")


@register("corpus_landing", """SELECT report_year, measure, n FROM (SELECT report_year, count(*) AS reports, count(*) FILTER (WHERE event_type = 'D') AS deaths, count(*) FILTER (WHERE event_type = 'IN') AS injuries, count(*) FILTER (WHERE event_type = 'M') AS malfunctions FROM reports WHERE report_year IS NOT NULL GROUP BY 1) UNPIVOT (n FOR measure IN (reports, deaths, injuries, malfunctions))""")
def a00(x: Lens) -> DataFrame:
    return an.landing(x.some("EVENT_TYPE"))


@register("cohort_kpis", f"""SELECT *, {_wilson("serious", "n")} FROM (SELECT count(*) AS n, count(DISTINCT report_number) AS events, count(*) FILTER (WHERE event_type = 'D') AS deaths, count(*) FILTER (WHERE event_type = 'IN') AS injuries, count(*) FILTER (WHERE event_type = 'M') AS malfunctions, count(*) FILTER (WHERE o_death) AS outcome_deaths, count(*) FILTER (WHERE serious) AS serious FROM reports WHERE product_code = 'BRAND#2')""")
def a01(x: Lens) -> DataFrame:
    return an.kpis(Cohort(product_code="brand#2").of(x.some("REPORT_NUMBER", "EVENT_TYPE", "outcome_death", "any_serious_outcome", "product_code")))


@register("cohort_reports", """SELECT k AS "MDR_REPORT_KEY", report_number AS "REPORT_NUMBER", date_pref AS "DATE_PREF", event_type AS "EVENT_TYPE", manufacturer, brand AS "BRAND_NAME", generic AS "GENERIC_NAME", generic AS "MODEL_NUMBER", product_code, device_count, patient_count, serious AS any_serious_outcome, outcomes AS outcome_codes_raw, implant AS implant_flag FROM reports ORDER BY date_pref DESC NULLS LAST, k LIMIT 500""")
def a02(x: Lens) -> DataFrame:
    return an.newest(x.some(*an.LISTED), 500)


@register("yearly_volume", """, v AS (SELECT report_year, count(*) AS reports FROM reports WHERE report_year IS NOT NULL GROUP BY 1) SELECT report_year, reports, coalesce(lead(reports) OVER w IS NULL AND count(*) OVER () >= 3 AND reports < 0.75 * lag(reports) OVER w, false) AS partial FROM v WINDOW w AS (ORDER BY report_year)""")
def a03(x: Lens) -> DataFrame:
    return an.yearly_volume(x.some("EVENT_TYPE"))


@register("event_types", """SELECT report_year, event_type AS "EVENT_TYPE", count(*) AS reports, CASE event_type WHEN 'D' THEN 'Death' WHEN 'IN' THEN 'Injury' ELSE 'Malfunction' END AS event FROM reports GROUP BY ALL""")
def a04(x: Lens) -> DataFrame:
    return an.event_types(x.some("EVENT_TYPE"))


_OUTCOME_UNPIVOT = "UNPIVOT (k FOR outcome IN (outcome_death, outcome_life_threatening, outcome_hospitalization, outcome_disability, outcome_congenital_anomaly, outcome_required_intervention, outcome_other, any_serious_outcome))"
_OUTCOME_COUNTS = "count(*) AS n, count(*) FILTER (WHERE o_death) AS outcome_death, count(*) FILTER (WHERE o_life) AS outcome_life_threatening, count(*) FILTER (WHERE o_hosp) AS outcome_hospitalization, count(*) FILTER (WHERE o_dis) AS outcome_disability, count(*) FILTER (WHERE o_cong) AS outcome_congenital_anomaly, count(*) FILTER (WHERE o_req) AS outcome_required_intervention, count(*) FILTER (WHERE o_other) AS outcome_other, count(*) FILTER (WHERE serious) AS any_serious_outcome"


@register("outcome_rates", f"SELECT n, outcome, k, {_wilson('k', 'n')} FROM (SELECT {_OUTCOME_COUNTS} FROM reports) {_OUTCOME_UNPIVOT}")
def a05(x: Lens) -> DataFrame:
    return an.outcome_rates(x.some(*an.OUTCOMES))


@register("outcome_rates_by_product", f"SELECT product_code, n, outcome, k, {_wilson('k', 'n')} FROM (SELECT product_code, {_OUTCOME_COUNTS} FROM reports GROUP BY 1) {_OUTCOME_UNPIVOT}")
def a05_by(x: Lens) -> DataFrame:
    return an.outcome_rates(x.some("product_code", *an.OUTCOMES), by=("product_code",))


@register("age_histogram", "SELECT bin, count(*) AS n, bin * 5.0::DOUBLE AS bin_from FROM (SELECT CAST(least(floor(age_avg / 5), 21) AS INTEGER) AS bin FROM reports WHERE age_avg BETWEEN 0 AND 110) GROUP BY bin")
def a06(x: Lens) -> DataFrame:
    return an.ages(x.some("age_years_avg"))


@register("sex_distribution", "SELECT sex, count(*) AS n FROM reports GROUP BY sex")
def a06_sex(x: Lens) -> DataFrame:
    return an.sexes(x.some("sex_list"))


_SPREAD = "count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.9), 6) AS p90, round(avg(v), 6) AS mean"


@register("device_age", f"SELECT {_SPREAD} FROM (SELECT device_age_days / 365.25 AS v FROM reports) WHERE v BETWEEN 0 AND 100")
def a07(x: Lens) -> DataFrame:
    return an.device_age(x.some("device_age_days"))


@register("device_age_cumulative", "SELECT round(value, 6) AS value, n, round(sum(n) OVER (ORDER BY value) * 100.0::DOUBLE / sum(n) OVER (), 6) AS cumulative FROM (SELECT device_age_days AS value, count(*) AS n FROM reports WHERE device_age_days BETWEEN 0 AND 36525 GROUP BY 1)")
def a07_cumulative(x: Lens) -> DataFrame:
    return an.cumulative(x.some("device_age_days"), F.col("device_age_days"), 0.0, 36525.0)


@register("cohort_deaths", """, dead AS (SELECT * FROM reports WHERE event_type = 'D' OR o_death) SELECT k AS "MDR_REPORT_KEY", date_pref AS "DATE_PREF", manufacturer, brand AS "BRAND_NAME", generic AS "GENERIC_NAME", product_code, narrative_desc, (SELECT count(*) FROM dead) AS total FROM dead ORDER BY date_pref DESC NULLS LAST, k LIMIT 200""")
def a08(x: Lens) -> DataFrame:
    return an.deaths(x.some("EVENT_TYPE", "outcome_death", "manufacturer", "BRAND_NAME", "GENERIC_NAME", "product_code", "narrative_desc"), 200)


@register("problem_top", "SELECT code, coalesce(term, code) AS term, n FROM (SELECT code, count(*) AS n FROM pairs JOIN reports USING (k) WHERE product_code = 'BRAND#2' GROUP BY 1) LEFT JOIN dictionary USING (code) ORDER BY n DESC, code LIMIT 20")
def a09(x: Lens) -> DataFrame:
    return an.top_problems(Cohort(product_code="Brand#2").of(x.some("product_code")), x.pairs, x.dictionary, 20)


@register("problem_top_by_term", "SELECT min(code) AS code, term, CAST(sum(n) AS BIGINT) AS n FROM (SELECT code, coalesce(term, code) AS term, n FROM (SELECT code, count(*) AS n FROM pairs JOIN reports USING (k) GROUP BY 1) LEFT JOIN dictionary USING (code)) GROUP BY term ORDER BY n DESC, code LIMIT 50")
def a24(x: Lens) -> DataFrame:
    return an.top_problems(x.some("EVENT_TYPE"), x.pairs, x.dictionary, 50, by_term=True)


_STRATA_COLUMNS = {"sex": "sex_list", "age_band": "age_years_avg", "source": "SOURCE_TYPE", "country": "reporter_country_code", "occupation": "REPORTER_OCCUPATION_CODE", "implant": "implant_flag"}
_STRATA_SQL = {"sex": "sex", "age_band": "age_band", "year": "CAST(report_year AS VARCHAR)", "source": "upper(trim(coalesce(source_type, 'Unknown')))", "country": "upper(trim(coalesce(country, 'Unknown')))", "occupation": "upper(trim(coalesce(occupation, 'UNK')))", "implant": "CASE WHEN implant THEN 'Implant' ELSE 'Not implant' END"}
for _name, _expression in _STRATA_SQL.items():
    register(f"subgroup_rates_{_name}", f"SELECT subgroup, n, k, count(*) OVER () AS strata, {_wilson('k', 'n')}, n < 10 AS small FROM (SELECT {_expression} AS subgroup, count(*) AS n, count(*) FILTER (WHERE serious) AS k FROM reports GROUP BY 1) ORDER BY n DESC, subgroup NULLS LAST LIMIT 25")(
        lambda x, s=_name: an.subgroup_rates(x.some(_STRATA_COLUMNS.get(s, "report_year"), "any_serious_outcome"), s, "any_serious_outcome")
    )


def _chi2_sql(row: str, column: str) -> str:
    return f"""margins AS (SELECT *, sum(o) OVER (PARTITION BY {row}) AS r, sum(o) OVER (PARTITION BY {column}) AS c, sum(o) OVER () AS n FROM cells)
SELECT round(sum(CASE WHEN r * c > 0 THEN pow(o - r * c / n, 2) / (r * c / n) END), 6) AS chi2, CAST((count(DISTINCT {row}) - 1) * (count(DISTINCT {column}) - 1) AS BIGINT) AS df, round(min(r * c / n), 6) AS min_expected FROM margins"""


@register("subgroup_chi2", f""", strata AS (SELECT country AS subgroup, count(*) AS n, count(*) FILTER (WHERE serious) AS k FROM reports GROUP BY 1),
cells AS (SELECT coalesce(subgroup, 'Unknown') AS subgroup, 'k' AS cell, CAST(k AS DOUBLE) AS o FROM strata UNION ALL SELECT coalesce(subgroup, 'Unknown'), 'rest', CAST(n - k AS DOUBLE) FROM strata), {_chi2_sql('subgroup', 'cell')}""")
def a11_test(x: Lens) -> DataFrame:
    return an.subgroup_test(x.some("reporter_country_code", "any_serious_outcome"), "country", "any_serious_outcome")


_YEARLY = ", v AS (SELECT report_year, count(*) AS n, count(*) FILTER (WHERE o_death) AS k FROM reports WHERE report_year IS NOT NULL GROUP BY 1)"


@register("yearly_target", _YEARLY + " SELECT report_year, n, k, round(100.0::DOUBLE * k / n, 6) AS rate FROM v")
def a12(x: Lens) -> DataFrame:
    return an.yearly_target(x.some("outcome_death"), F.col("outcome_death"))


_ARMITAGE = """, m AS (SELECT min(report_year) AS y0 FROM v), s AS (SELECT count(*) AS groups, CAST(sum(n) AS DOUBLE) AS nn, CAST(sum(k) AS DOUBLE) AS r, CAST(sum((report_year - y0) * n) AS DOUBLE) AS sn, CAST(sum((report_year - y0) * k) AS DOUBLE) AS sr, CAST(sum((report_year - y0) * (report_year - y0) * n) AS DOUBLE) AS ssn FROM v, m),
z AS (SELECT groups, (sr - r / nn * sn) / sqrt(r / nn * (1 - r / nn) * (ssn - sn * sn / nn)) AS z FROM s)"""
_KENDALL = """, steps AS (SELECT CAST(sum(sign(b.k - a.k)) AS BIGINT) AS s FROM v a JOIN v b ON a.report_year < b.report_year), t AS (SELECT CAST(sum(t) AS BIGINT) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT k, count(*) AS t FROM v GROUP BY k)),
w AS (SELECT n, s, CAST((n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS DOUBLE) AS variance FROM steps, t)"""


@register("trend_cochran_armitage", _YEARLY + _ARMITAGE + """
SELECT groups, round(z, 6) AS z, CASE WHEN z > 0 THEN 'increasing' WHEN z < 0 THEN 'decreasing' ELSE 'no trend' END AS direction FROM z""")
def a12_ca(x: Lens) -> DataFrame:
    return an.trend(x.some("outcome_death"), F.col("outcome_death"))[0]


@register("trend_mann_kendall", _YEARLY + _KENDALL + """
SELECT n, s AS "S", round(variance, 6) AS variance, round((s - sign(s)) / sqrt(variance), 6) AS z, round(s / (n * (n - 1) / 2.0::DOUBLE), 6) AS tau, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'no trend' END AS direction FROM w""")
def a12_mk(x: Lens) -> DataFrame:
    return an.trend(x.some("outcome_death"), F.col("outcome_death"))[1]


@register("trend_p_values", f"""{_YEARLY}{_ARMITAGE}{_KENDALL}, both_z AS (SELECT 'cochran-armitage' AS test, z FROM z UNION ALL SELECT 'mann-kendall', (s - sign(s)) / sqrt(variance) FROM w)
SELECT test, round(z, 6) AS z, round({_tail("(z * z)", "1")}, 6) AS p FROM both_z""")
def a12_p(x: Lens) -> DataFrame:
    ca, mk = an.trend(x.some("outcome_death"), F.col("outcome_death"))
    rows = ca.select(F.lit("cochran-armitage").alias("test"), "z").unionByName(mk.select(F.lit("mann-kendall").alias("test"), "z"))
    return rows.withColumn("p", tails.normal_p("z"))


_EARLY, _LATE = Cohort(year_hi=1997), Cohort(year_lo=1998)


@register("compare_cohorts", """SELECT cohort, n, deaths, injuries, malfunctions, round(100.0::DOUBLE * deaths / n, 6) AS deaths_pct, round(100.0::DOUBLE * injuries / n, 6) AS injuries_pct, round(100.0::DOUBLE * malfunctions / n, 6) AS malfunctions_pct
FROM (SELECT CASE WHEN report_year <= 1997 THEN 'A' ELSE 'B' END AS cohort, count(*) AS n, count(*) FILTER (WHERE event_type = 'D') AS deaths, count(*) FILTER (WHERE event_type = 'IN') AS injuries, count(*) FILTER (WHERE event_type = 'M') AS malfunctions FROM reports GROUP BY 1)""")
def a13(x: Lens) -> DataFrame:
    rows = x.some("EVENT_TYPE")
    return an.compared(_EARLY.of(rows), _LATE.of(rows))


_TWO_COHORTS = ", cells AS (SELECT CASE WHEN report_year <= 1997 THEN 'A' ELSE 'B' END AS cohort, event_type, CAST(count(*) AS DOUBLE) AS o FROM reports GROUP BY 1, 2), "


@register("compare_cohorts_chi2", _TWO_COHORTS + _chi2_sql("event_type", "cohort"))
def a13_test(x: Lens) -> DataFrame:
    rows = x.some("EVENT_TYPE")
    return an.comparison_test(_EARLY.of(rows), _LATE.of(rows))


@register("compare_cohorts_p", _TWO_COHORTS + _chi2_sql("event_type", "cohort").replace("SELECT round", ", test AS (SELECT round", 1) + f") SELECT *, round({_tail('chi2', 'df')}, 6) AS p FROM test")
def a13_p(x: Lens) -> DataFrame:
    rows = x.some("EVENT_TYPE")
    return an.comparison_test(_EARLY.of(rows), _LATE.of(rows)).withColumn("p", tails.chi_square_p("chi2", "df"))


@register("sensitivity", f""", t AS (SELECT *, coalesce(fwd, false) AS f FROM reports), rows AS (
  SELECT '1 base' AS scenario, * FROM t UNION ALL SELECT '2 without forwarded', * FROM t WHERE NOT f UNION ALL SELECT '3 without rwd', * FROM t WHERE NOT is_rwd UNION ALL SELECT '4 initial only', * FROM t WHERE NOT is_supplement
  UNION ALL SELECT '5 conservative', * FROM t WHERE NOT f AND NOT is_rwd AND NOT is_supplement)
SELECT *, {_wilson('serious', 'n')}, round(CAST(n AS DOUBLE) / (SELECT count(*) FROM reports), 6) AS retained FROM (SELECT scenario, count(*) AS n, count(*) FILTER (WHERE event_type = 'D') AS deaths, count(*) FILTER (WHERE serious) AS serious FROM rows GROUP BY 1)""")
def a14(x: Lens) -> DataFrame:
    return an.sensitivity(x.some("EVENT_TYPE", "any_serious_outcome", "IS_FORWARDED_803_22_B2", "IS_RWD_SOURCED", "initial_report"))


@register("reporter_mix", """, ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, code) AS rank FROM (SELECT coalesce(nullif(trim(occupation), ''), 'UNK') AS code, count(*) AS n FROM reports GROUP BY 1))
SELECT CASE WHEN rank <= 3 THEN code ELSE 'All other' END AS code, CAST(sum(n) AS BIGINT) AS n, count(*) AS codes, upper(CASE WHEN rank <= 3 THEN code ELSE 'All other' END) AS occupation FROM ranked GROUP BY ALL""")
def a15(x: Lens) -> DataFrame:
    return an.reporters(x.some("REPORTER_OCCUPATION_CODE"), 3)


@register("source_mix", """SELECT code, count(*) AS n, CASE code WHEN 'M' THEN 'Manufacturer' WHEN 'U' THEN 'User facility' WHEN 'D' THEN 'Distributor' WHEN 'I' THEN 'Importer' WHEN 'V' THEN 'Voluntary' WHEN 'P' THEN 'Patient' WHEN 'C' THEN 'Consumer' ELSE code END AS source
FROM (SELECT unnest(string_split(upper(source_type), ',')) AS code FROM reports) GROUP BY code ORDER BY n DESC, code LIMIT 15""")
def a15_source(x: Lens) -> DataFrame:
    return an.sources(x.some("SOURCE_TYPE"))


@register("geography", "SELECT country, count(*) AS n, round(log10(count(*) + 1), 6) AS log_n, any_value(r_name) AS region FROM reports LEFT JOIN nation ON upper(n_name) = country LEFT JOIN region ON n_regionkey = r_regionkey WHERE country IS NOT NULL GROUP BY country")
def a16(x: Lens) -> DataFrame:
    countries = x.table("nation").join(x.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.upper("n_name").alias("country"), F.col("r_name").alias("region"))
    return an.geography(x.some("reporter_country_code"), countries)


_MAKERS = ", m AS (SELECT manufacturer, n, n * 100.0::DOUBLE / sum(n) OVER () AS share_pct FROM (SELECT manufacturer, count(*) AS n FROM reports WHERE manufacturer IS NOT NULL GROUP BY 1))"


@register("manufacturers", _MAKERS + " SELECT manufacturer, n, round(share_pct, 6) AS share_pct FROM m")
def a17(x: Lens) -> DataFrame:
    return an.manufacturers(x.some("manufacturer"))


@register("manufacturer_hhi", _MAKERS + " SELECT count(*) AS names, round(max(share_pct), 6) AS top_share, round(sum(share_pct * share_pct), 6) AS hhi, CASE WHEN sum(share_pct * share_pct) > 2500 THEN 'high' WHEN sum(share_pct * share_pct) > 1500 THEN 'moderate' ELSE 'low' END AS class FROM m")
def a17_hhi(x: Lens) -> DataFrame:
    return an.concentration(x.some("manufacturer"))


@register("reporting_lag", f"SELECT {_SPREAD}, (SELECT count(*) FROM reports WHERE lag_raw < 0) AS negative FROM (SELECT CAST(lag_raw AS DOUBLE) AS v FROM reports) WHERE v BETWEEN 0 AND 3650")
def a18(x: Lens) -> DataFrame:
    return an.reporting_lag(x.some("lag_days_raw"))


@register("lag_lower_rank_p90", ", v AS (SELECT CAST(lag_raw AS DOUBLE) AS v FROM reports WHERE lag_raw BETWEEN 0 AND 3650) SELECT v AS p90 FROM v ORDER BY v OFFSET (SELECT CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) FROM v) LIMIT 1")
def t19(x: Lens) -> DataFrame:
    rows = x.some("lag_days_raw").filter("lag_days_raw between 0 and 3650").select(F.col("lag_days_raw").cast("double").alias("p90"))
    return stats.lower_rank(rows, "p90", 0.9)


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z]{{3,}}') AND t NOT IN ({_STOP})) AS w FROM documents WHERE text IS NOT NULL)"""


@register("terms", _TOKENS + " SELECT term, 1 AS n_words, count(*) AS n FROM (SELECT unnest(w) AS term FROM w) GROUP BY term ORDER BY n DESC, term LIMIT 200", lens=False)
def n04(x: Lens) -> DataFrame:
    return text.top(text.counted(x.table("documents"), "text", (1,)), 200)


@register("phrases", _TOKENS + """, g AS (SELECT array_to_string(w[i : i + 1], ' ') AS term, 2 AS n_words FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w) UNION ALL SELECT array_to_string(w[i : i + 2], ' '), 3 FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w))
SELECT term, n_words, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 5 ORDER BY n DESC, term LIMIT 400""", lens=False)
def n04_phrases(x: Lens) -> DataFrame:
    return text.top(text.counted(x.table("documents"), "text", (2, 3)), 400, 5)


@register("bm25", _TOKENS + """, s AS (SELECT doc_id, len(w) AS length, len(list_filter(w, lambda t: t = 'idiot')) AS t0, len(list_filter(w, lambda t: t = 'then')) AS t1 FROM w), f AS (SELECT count(*) AS docs, avg(length) AS mean, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM s)
SELECT doc_id, round(ln(1 + (docs - d0 + .5) / (d0 + .5)) * t0 * 2.2 / (t0 + 1.2 * (.25 + .75 * length / mean)) + ln(1 + (docs - d1 + .5) / (d1 + .5)) * t1 * 2.2 / (t1 + 1.2 * (.25 + .75 * length / mean)), 6) AS score FROM s, f WHERE t0 > 0 OR t1 > 0 ORDER BY ln(1 + (docs - d0 + .5) / (d0 + .5)) * t0 * 2.2 / (t0 + 1.2 * (.25 + .75 * length / mean)) + ln(1 + (docs - d1 + .5) / (d1 + .5)) * t1 * 2.2 / (t1 + 1.2 * (.25 + .75 * length / mean)) DESC, doc_id LIMIT 50""", lens=False)
def n05(x: Lens) -> DataFrame:
    return text.bm25(x.table("documents"), "doc_id", "text", "then idiot", 50)


@register("narrative_parts", """SELECT k AS "MDR_REPORT_KEY", turn AS "MDR_TEXT_KEY", kind AS "TEXT_TYPE_CODE", text AS "FOI_TEXT" FROM narrative WHERE kind = 'D' AND k IN (SELECT k FROM reports WHERE serious) ORDER BY k, turn LIMIT 100""")
def a20(x: Lens) -> DataFrame:
    return an.narratives(x.some("any_serious_outcome").filter("any_serious_outcome"), x.narrative, ("D",), 100)


def _rate(c: str) -> str:
    return f"round(avg(CASE WHEN {c} THEN 100.0::DOUBLE ELSE 0 END), 6)"


_FIELDS = {"REPORT_NUMBER": "report_number <> ''", "EVENT_TYPE": "event_type <> ''", "DATE_RECEIVED_D": "date_pref IS NOT NULL", "DATE_OF_EVENT_D": "date_of_event IS NOT NULL", "manufacturer": "manufacturer <> ''", "product_code": "product_code <> ''",
           "REPORTER_OCCUPATION_CODE": "occupation <> ''", "SOURCE_TYPE": "source_type <> ''", "has_narrative": "parts > 0", "age_years_avg": "age_avg IS NOT NULL", "device_age_days": "device_age_days IS NOT NULL", "outcome_codes_raw": "outcomes <> ''",
           "is_supplement": "is_supplement", "IS_RWD_SOURCED": "is_rwd", "IS_FORWARDED_803_22_B2": "fwd", "HAS_REDACTION_B4": "b4", "HAS_REDACTION_B6": "b6"}


@register("data_quality", " UNION ALL ".join(f"SELECT '{f}' AS field, {_rate(c)} AS rate, '{'flag' if f in an.FLAGS else 'completeness'}' AS kind, {f == 'product_code'} AND {_rate(c)} < 95 AS low FROM reports" for f, c in _FIELDS.items()))
def a21(x: Lens) -> DataFrame:
    return an.data_quality(x.some(*an.COMPLETENESS, *an.FLAGS))


@register("methods", f"""SELECT count(*) AS n, count(*) FILTER (WHERE report_year >= {ELIGIBLE_FROM}) AS eligible, min(date_pref) AS "first", max(date_pref) AS "last" FROM reports WHERE product_code = 'BRAND#2' AND report_year >= {ELIGIBLE_FROM}""")
def a22(x: Lens) -> DataFrame:
    return an.methods(x.some("product_code"), BRAND, eligible(ELIGIBLE_FROM)).drop("criteria", "paragraph")


_DIFFERENCE = """, s AS (SELECT country, CAST(count(*) FILTER (WHERE implant) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE implant AND serious) AS DOUBLE) AS a1, CAST(count(*) FILTER (WHERE NOT implant) AS DOUBLE) AS n2, CAST(count(*) FILTER (WHERE NOT implant AND serious) AS DOUBLE) AS a2 FROM reports WHERE country IS NOT NULL GROUP BY 1),
w AS (SELECT *, 3.8414588206941227::DOUBLE AS zz, a1 / n1 AS p1, a2 / n2 AS p2 FROM s),
b AS (SELECT *, (p1 + zz / (2 * n1)) / (1 + zz / n1) AS m1, sqrt(zz) / (1 + zz / n1) * sqrt(p1 * (1 - p1) / n1 + zz / (4 * n1 * n1)) AS h1, (p2 + zz / (2 * n2)) / (1 + zz / n2) AS m2, sqrt(zz) / (1 + zz / n2) * sqrt(p2 * (1 - p2) / n2 + zz / (4 * n2 * n2)) AS h2 FROM w),
c AS (SELECT *, CASE WHEN a1 = 0 THEN 0 ELSE greatest(0, m1 - h1) END AS l1, CASE WHEN a1 = n1 THEN 1 ELSE least(1, m1 + h1) END AS u1, CASE WHEN a2 = 0 THEN 0 ELSE greatest(0, m2 - h2) END AS l2, CASE WHEN a2 = n2 THEN 1 ELSE least(1, m2 + h2) END AS u2 FROM b)
"""


def _two_groups(x: Lens) -> DataFrame:
    serious = F.col("any_serious_outcome")
    return x.some("reporter_country_code", "implant_flag", "any_serious_outcome").filter("reporter_country_code is not null").groupBy(F.col("reporter_country_code").alias("country")).agg(
        F.count_if("implant_flag").alias("n1"), F.count_if(F.col("implant_flag") & serious).alias("a1"),
        F.count_if(~F.col("implant_flag")).alias("n2"), F.count_if(~F.col("implant_flag") & serious).alias("a2"),
    )


@register("risk_difference", _DIFFERENCE + "SELECT country, round(p1 - p2, 6) AS point, round(l1 - u2, 6) AS lo, round(u1 - l2, 6) AS hi FROM c")
def t06(x: Lens) -> DataFrame:
    return _two_groups(x).withColumn("d", stats.risk_difference(*[F.col(c) for c in ("a1", "n1", "a2", "n2")])).select("country", "d.*")


@register("newcombe_difference", _DIFFERENCE + "SELECT country, round(p1 - p2, 6) AS point, round(greatest(-1, p1 - p2 - sqrt(pow(p1 - l1, 2) + pow(u2 - p2, 2))), 6) AS lo, round(least(1, p1 - p2 + sqrt(pow(u1 - p1, 2) + pow(p2 - l2, 2))), 6) AS hi FROM c")
def t07(x: Lens) -> DataFrame:
    return _two_groups(x).withColumn("d", stats.newcombe(*[F.col(c) for c in ("a1", "n1", "a2", "n2")])).select("country", "d.*")


@register("false_discovery", """, t AS (SELECT country, count(*) AS n, CAST(count(*) FILTER (WHERE serious) AS DOUBLE) / count(*) AS p FROM reports WHERE country IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p) AS rank, count(*) OVER () AS m FROM t)
SELECT country, n, round(p, 6) AS p, round(least(1, min(p * m / rank) OVER (ORDER BY rank DESC)), 6) AS q FROM r""")
def t09(x: Lens) -> DataFrame:
    rows = x.some("reporter_country_code", "any_serious_outcome").filter("reporter_country_code is not null").groupBy(F.col("reporter_country_code").alias("country")).agg(F.count("*").alias("n"), F.avg(F.col("any_serious_outcome").cast("double")).alias("p"))
    return stats.benjamini_hochberg(rows, "p")


@register("fisher_exact", """, s AS (SELECT country, count(*) FILTER (WHERE implant AND o_cong) AS a, count(*) FILTER (WHERE implant AND NOT o_cong) AS b, count(*) FILTER (WHERE NOT implant AND o_cong) AS c, count(*) FILTER (WHERE NOT implant AND NOT o_cong) AS d FROM reports WHERE country IS NOT NULL AND product_code = 'BRAND#2' GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, a + b - (b + d)), least(a + b, a + c) + 1)) AS i FROM s WHERE least(a, b, c, d) < 10),
p AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS base FROM x),
l AS (SELECT *, base - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS lp, base - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS seen FROM p WHERE d - a + i >= 0)
SELECT country, a, b, c, d, round(least(1.0, sum(CASE WHEN lp <= seen + 1e-9 THEN exp(lp) ELSE 0 END)), 6) AS p FROM l GROUP BY ALL""")
def t05(x: Lens) -> DataFrame:
    implant, hit = F.col("implant_flag"), F.col("outcome_congenital_anomaly")
    rows = Cohort(product_code="Brand#2").of(x.some("product_code", "reporter_country_code", "implant_flag", "outcome_congenital_anomaly")).filter("reporter_country_code is not null").groupBy(F.col("reporter_country_code").alias("country")).agg(
        F.count_if(implant & hit).alias("a"), F.count_if(implant & ~hit).alias("b"), F.count_if(~implant & hit).alias("c"), F.count_if(~implant & ~hit).alias("d")
    )
    return rows.withColumn("p", tails.fisher_p(*[F.col(c) for c in "abcd"])).filter("p is not null")


_INDEX = """, useful AS (SELECT * FROM reports WHERE product_code IS NOT NULL AND report_year >= 1996),
names AS (SELECT product_code, nm, row_number() OVER (PARTITION BY product_code ORDER BY count(*) DESC, nm) AS rk FROM (SELECT product_code, upper(trim(generic)) AS nm FROM useful) WHERE length(nm) > 2 GROUP BY 1, 2),
brands AS (SELECT product_code, nm, row_number() OVER (PARTITION BY product_code ORDER BY count(*) DESC, nm) AS rk FROM (SELECT product_code, upper(trim(brand)) AS nm FROM useful) WHERE length(nm) > 2 GROUP BY 1, 2),
ix AS (SELECT s.*, names, brands, coalesce(names[1], brands[1], product_code) AS label
  FROM (SELECT product_code, count(*) AS n, count(*) FILTER (WHERE event_type = 'D') AS deaths, count(*) FILTER (WHERE serious) AS serious, min(report_year) AS y0, max(report_year) AS y1 FROM useful GROUP BY 1) s
  LEFT JOIN (SELECT product_code, list(nm ORDER BY rk) AS names FROM names WHERE rk <= 3 GROUP BY 1) USING (product_code) LEFT JOIN (SELECT product_code, list(nm ORDER BY rk) AS brands FROM brands WHERE rk <= 2 GROUP BY 1) USING (product_code))
"""


@register("product_index", _INDEX + "SELECT product_code, n, deaths, serious, y0, y1, array_to_string(names, '; ') AS names, array_to_string(brands, '; ') AS brands, label FROM ix")
def x01(x: Lens) -> DataFrame:
    rows = search.product_index(x.some("product_code", "GENERIC_NAME", "BRAND_NAME", "EVENT_TYPE", "any_serious_outcome"), ELIGIBLE_FROM)
    return rows.withColumns({c: F.array_join(c, "; ") for c in ("names", "brands")})


@register("product_search", _INDEX + """, t AS (SELECT *, list_max(list_transform(list_concat([label], names, brands), lambda s: CASE WHEN lower(s) = 'st' THEN 300.0 WHEN starts_with(lower(s), 'st') THEN 250.0 WHEN contains(' ' || regexp_replace(lower(s), '[^a-z0-9_]+', ' ', 'g'), ' st') THEN 200.0 WHEN contains(lower(s), 'st') THEN 150.0 ELSE 0.0 END)) AS best FROM ix)
SELECT product_code, n, round(CAST(best + log10(n + 1.0) * 25 AS DOUBLE), 6) AS score FROM t WHERE best > 0 ORDER BY best + log10(n + 1.0) * 25 DESC, product_code LIMIT 10""")
def x03(x: Lens) -> DataFrame:
    return search.product_search(search.product_index(x.some("product_code", "GENERIC_NAME", "BRAND_NAME", "EVENT_TYPE", "any_serious_outcome"), ELIGIBLE_FROM), "st").select("product_code", "n", "score")


_MAKER_INDEX = """, mi AS (SELECT manufacturer, count(*) AS n, count(*) FILTER (WHERE event_type = 'D') AS deaths, min(report_year) AS y0, max(report_year) AS y1 FROM reports WHERE manufacturer <> '' AND report_year >= 1996 GROUP BY 1 ORDER BY n DESC, manufacturer LIMIT 4000)"""


@register("manufacturer_index", _MAKER_INDEX + " SELECT * FROM mi")
def x02(x: Lens) -> DataFrame:
    return search.manufacturer_index(x.some("manufacturer", "EVENT_TYPE"), ELIGIBLE_FROM)


@register("manufacturer_search", _MAKER_INDEX + " SELECT * FROM mi WHERE contains(lower(manufacturer), '1') ORDER BY starts_with(lower(manufacturer), '1') DESC, n DESC, manufacturer LIMIT 10")
def x04(x: Lens) -> DataFrame:
    return search.manufacturer_search(search.manufacturer_index(x.some("manufacturer", "EVENT_TYPE"), ELIGIBLE_FROM, k=None), "1")


@register("check_orphans", """SELECT 'orphans' AS "check", CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS INTEGER) AS severity, CAST(count(*) AS DOUBLE) AS metric, name AS detail FROM (
  SELECT 'narrative' AS name, k FROM narrative UNION ALL SELECT 'device', k FROM device UNION ALL SELECT 'patient', k FROM patient) WHERE k NOT IN (SELECT o_orderkey FROM orders) GROUP BY name
  UNION ALL SELECT 'orphans', 0, 0.0, name FROM (VALUES ('narrative'), ('device'), ('patient')) v(name) WHERE name NOT IN (SELECT name FROM (SELECT 'narrative' AS name, k FROM narrative UNION ALL SELECT 'device', k FROM device UNION ALL SELECT 'patient', k FROM patient) WHERE k NOT IN (SELECT o_orderkey FROM orders))""")
def q02(x: Lens) -> DataFrame:
    return checks.orphan_rows({"narrative": x.narrative, "device": x.device, "patient": x.patient}, x.mdr)


@register("check_year_volume", """, v AS (SELECT report_year, count(*) AS n FROM reports GROUP BY 1), t AS (SELECT quantile_cont(n, 0.5) AS median, count(*) AS years FROM v)
SELECT 'year_volume' AS "check", CAST(CASE WHEN years > 2 AND n < 0.1 * median THEN 1 ELSE 0 END AS INTEGER) AS severity, CAST(n AS DOUBLE) AS metric, CAST(report_year AS VARCHAR) AS detail FROM v, t""")
def q08(x: Lens) -> DataFrame:
    return checks.year_volume(x.some("EVENT_TYPE"))


@register("check_dates", """SELECT 'dated' AS "check", CAST(CASE WHEN s >= 95 THEN 0 WHEN s >= 70 THEN 1 ELSE 2 END AS INTEGER) AS severity, s AS metric, 'percent of reports' AS detail FROM (SELECT count(date_pref) * 100.0::DOUBLE / count(*) AS s FROM reports)
UNION ALL SELECT 'date_range', CAST(count(*) FILTER (WHERE year(date_pref) NOT BETWEEN 1990 AND 2030) > 0 AS INTEGER), CAST(count(*) FILTER (WHERE year(date_pref) NOT BETWEEN 1990 AND 2030) AS DOUBLE), 'outside 1990-2030' FROM reports""")
def q03(x: Lens) -> DataFrame:
    return checks.dates(x.some("EVENT_TYPE"))


@register("check_event_types", """SELECT 'event_type' AS "check", CAST(CASE WHEN count(o_orderkey) > 0 THEN 0 ELSE 1 END AS INTEGER) AS severity, CAST(count(o_orderkey) AS DOUBLE) AS metric, t AS detail
FROM (VALUES ('D', 'F'), ('IN', 'O'), ('M', 'P')) v(t, s) LEFT JOIN orders ON o_orderstatus = s GROUP BY t""")
def q07(x: Lens) -> DataFrame:
    return checks.event_types(x.some("EVENT_TYPE"))


def _bare(name: str) -> str:
    return SQL[name][len(LENS) :]


_ALL_CHECKS = f"""{_bare("check_year_volume")} UNION ALL {_bare("check_dates")} UNION ALL {_bare("check_event_types")}
UNION ALL SELECT 'filled', CAST(CASE WHEN n > 0 THEN 0 WHEN name = 'dictionary' THEN 1 ELSE 2 END AS INTEGER), CAST(least(n, 1) AS DOUBLE), name FROM (
  SELECT 'mdr' AS name, count(*) AS n FROM orders UNION ALL SELECT 'device', count(*) FROM device UNION ALL SELECT 'patient', count(*) FROM patient
  UNION ALL SELECT 'narrative', count(*) FROM narrative UNION ALL SELECT 'reports', count(*) FROM reports UNION ALL SELECT 'dictionary', count(*) FROM dictionary)
UNION ALL SELECT 'orphans', CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS INTEGER), CAST(count(*) AS DOUBLE), 'narrative' FROM narrative WHERE k NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'narrative_key', CAST(CASE WHEN s > 0.5 THEN 1 ELSE 0 END AS INTEGER), round(s, 6), 'percent blank' FROM (SELECT count(*) FILTER (WHERE k IS NULL) * 100.0::DOUBLE / count(*) AS s FROM narrative)
UNION ALL SELECT 'narrative_text', CAST(CASE WHEN s > 5 THEN 1 ELSE 0 END AS INTEGER), round(s, 6), 'percent empty' FROM (SELECT count(*) FILTER (WHERE coalesce(trim(text), '') = '') * 100.0::DOUBLE / count(*) AS s FROM narrative)
UNION ALL SELECT 'columns', 0, 0.0, name || ': complete' FROM (VALUES ('dictionary'), ('reports')) v(name)
UNION ALL SELECT 'outcome_coverage', CAST(CASE WHEN s > 0 THEN 0 ELSE 1 END AS INTEGER), round(s, 6), 'percent of reports' FROM (SELECT count(*) FILTER (WHERE trim(outcomes) <> '') * 100.0::DOUBLE / count(*) AS s FROM reports)
"""


def _all_checks(x: Lens) -> DataFrame:
    tables = {"mdr": x.mdr, "device": x.device, "patient": x.patient, "narrative": x.narrative, "reports": x.some(), "dictionary": x.dictionary}
    parts = [
        checks.filled(tables), checks.orphan_rows({"narrative": x.narrative}, x.mdr), checks.narratives(x.narrative),
        checks.columns(x.dictionary, "dictionary", ("FDA_CODE", "TERM")), checks.columns(x.reports, "reports", tuple(an.OUTCOMES)), checks.of_reports(x.some("EVENT_TYPE", "outcome_codes_raw")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("check_all", _ALL_CHECKS)
def q_all(x: Lens) -> DataFrame:
    return _all_checks(x)


@register("check_severity", _ALL_CHECKS.replace(" SELECT 'year_volume'", ", checks AS (SELECT 'year_volume'", 1).replace("\nSELECT 'year_volume'", ", checks AS (SELECT 'year_volume'", 1) + ") SELECT CAST(coalesce(max(severity), 0) AS INTEGER) AS severity, count(*) FILTER (WHERE severity > 0) AS findings FROM checks")
def q09(x: Lens) -> DataFrame:
    return checks.severity(_all_checks(x))


@register("typed_dates", """SELECT k AS "MDR_REPORT_KEY", date_pref AS "DATE_PREF", date_of_event AS "DATE_OF_EVENT_D", is_rwd AS "IS_RWD_SOURCED" FROM reports""")
def e01(x: Lens) -> DataFrame:
    return x.mdr.select(KEY, "DATE_PREF", "DATE_OF_EVENT_D", "IS_RWD_SOURCED")


@register("labels", """SELECT k AS "MDR_REPORT_KEY", sex, age_band, CASE event_type WHEN 'D' THEN 'Death' WHEN 'IN' THEN 'Injury' ELSE 'Malfunction' END AS event, list_contains(string_split(coalesce(outcomes, ''), ','), 'H') AS hospital FROM reports""")
def e13(x: Lens) -> DataFrame:
    return x.some("sex_list", "age_years_avg", "EVENT_TYPE", "outcome_codes").select(KEY, enrich.sex(F.col("sex_list")).alias("sex"), enrich.age_band(F.col("age_years_avg")).alias("age_band"),
                            enrich.labelled(F.col("EVENT_TYPE"), enrich.EVENT_LABELS).alias("event"), enrich.has_outcome(F.col("outcome_codes"), "H").alias("hospital"))


_JOINED_LINES = "SELECT doc_id, array_to_string(list_transform(string_split('12345|' || text, chr(10)), lambda s: trim(s, ' ')), ' ') AS text FROM documents"


def _reassembled(x: Lens) -> DataFrame:
    """Documents cut into lines and put together again; a document is a block of one file."""
    docs = x.table("documents").select("doc_id", F.posexplode(F.split(F.concat(F.lit("12345|"), "text"), "\n")).alias("at", "line"))
    rows = docs.select("line", (F.col("doc_id") % 16).alias("file"), F.col("doc_id").alias("block"), "at")
    return pipe_files.reassemble(rows, F.col("line").rlike("^[0-9]{4,12}\\|"))


@register("reassembled_lines", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({_JOINED_LINES})", lens=False)
def s04(x: Lens) -> DataFrame:
    return _reassembled(x).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@register("reassembled_texts", f"SELECT md5(text) AS digest, count(*) AS n FROM ({_JOINED_LINES}) WHERE text IS NOT NULL GROUP BY 1", lens=False)
def s04_texts(x: Lens) -> DataFrame:
    return _reassembled(x).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@register("published_bridge", """SELECT k AS "MDR_REPORT_KEY", CAST(k AS INTEGER) AS k_int, code, product_code AS pc, CAST(report_year AS SMALLINT) AS y FROM pairs JOIN reports USING (k)""")
def p03(x: Lens) -> DataFrame:
    return publish.published_bridge(x.pairs, x.some("product_code")).withColumnRenamed("k", "k_int")


@register("summary", f"""SELECT count(*) AS n, min(report_year) AS first_year, max(report_year) AS last_year, max(date_pref) AS vintage, count(*) FILTER (WHERE report_year >= {ELIGIBLE_FROM}) AS eligible, count(DISTINCT report_number) AS events, count(DISTINCT product_code) AS product_codes, count(DISTINCT manufacturer) AS manufacturers, count(*) FILTER (WHERE event_type = 'D') AS deaths, count(*) FILTER (WHERE serious) AS serious, count(DISTINCT report_year) AS years FROM reports""")
def p07(x: Lens) -> DataFrame:
    return publish.summary(x.some("REPORT_NUMBER", "product_code", "manufacturer", "EVENT_TYPE", "any_serious_outcome"), ELIGIBLE_FROM).withColumn("years", F.size("by_year").cast("long")).drop("by_year")


@register("latest_event_per_user", """SELECT user_id, event_id, ts, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""", lens=False)
def i02(x: Lens) -> DataFrame:
    return incremental.latest(x.table("events"), ["user_id"], "event_id")


@register("cohort_code_pairs", """SELECT k AS "MDR_REPORT_KEY", code FROM pairs WHERE k IN (SELECT k FROM reports WHERE product_code = 'BRAND#2')""")
def b12(x: Lens) -> DataFrame:
    return of_cohort(x.pairs, Cohort(product_code="Brand#2").of(x.some("product_code")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
