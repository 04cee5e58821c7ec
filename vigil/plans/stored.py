"""Registered queries that write the driver tables to the shared folder and read them back.

Each run has a folder of its own below the checkpoint folder, where its result is read from afterwards.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import stats
from vigil.functions.stem import DOUBLE, M_OVER_0, M_OVER_1, SHORT, STEP_2, STEP_3, STEP_4, VOWEL
from vigil.operators import analyses, build, publish, statement, text
from vigil.operators.build import KEY
from vigil.operators.cohort import Cohort, eligible
from vigil.sources import files, pipe_files
from vigil.sources.countries import countries
from vigil.sources.folder import load_folder
from vigil.streaming import incremental

from .lens import ELIGIBLE_FROM, Lens
from .queries import _OUTCOME_COUNTS, _OUTCOME_UNPIVOT, _TOKENS, _screen_sql, _wilson, register


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = os.path.join(tempfile.gettempdir(), "vigil-checkpoints")
    return f"{shared}/stored-{uuid.uuid4().hex}"


def _write_pipes(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select(*[F.col(c).cast("string") for c in df.columns]).write.mode(mode).csv(path, header=True, sep="|", quote="", escape="", emptyValue="")


@register("pipe_files_united", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority, o_orderkey % 2 = 0 AS even FROM orders""", lens=False)
def s02(x: Lens) -> DataFrame:
    """Two pipe files of different columns, united by name."""
    folder, orders = _folder(x.spark), x.table("orders")
    _write_pipes(orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus"), f"{folder}/a")
    _write_pipes(orders.filter("o_orderkey % 2 = 1").select("o_orderpriority", "o_orderkey"), f"{folder}/b")
    rows = pipe_files.read_pipe_files(x.spark, [f"{folder}/a", f"{folder}/b"])
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey").cast("long") % 2 == 0).alias("even"))


@register("problem_code_layouts", """SELECT CAST(l_orderkey AS VARCHAR) AS "MDR_REPORT_KEY", CAST(l_linenumber AS VARCHAR) AS "PATIENT_SEQUENCE_NUMBER", l_returnflag AS "PROBLEM_CODE" FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), NULL, l_linestatus FROM lineitem""", lens=False)
def s05(x: Lens) -> DataFrame:
    """A file with a header in one spelling of its names, and a headerless one of two columns."""
    folder, lines = _folder(x.spark), x.table("lineitem")
    named = lines.select(F.col("l_orderkey").alias("REPORT_KEY"), F.col("l_linenumber").alias("PATIENT_SEQUENCE_NO"), F.col("l_returnflag").alias("PATIENT_PROBLEM_CODE"))
    _write_pipes(named, f"{folder}/named")
    lines.select(F.concat_ws("|", "l_orderkey", "l_linestatus")).write.text(f"{folder}/bare")
    read = lambda name: pipe_files.read_problem_codes(x.spark, f"{folder}/{name}").select(KEY, "PATIENT_SEQUENCE_NUMBER", "PROBLEM_CODE")
    return read("named").unionByName(read("bare"))


@register("published_years", """SELECT k AS "MDR_REPORT_KEY", report_year, product_code, event_type AS "EVENT_TYPE" FROM reports WHERE report_year BETWEEN 1995 AND 1997""")
def p02(x: Lens) -> DataFrame:
    """Reports published by year and read back for a range of years."""
    folder = _folder(x.spark)
    publish.write_reports(x.some("product_code", "EVENT_TYPE"), folder, first_year=1994)
    return pipe_files.read_years(x.spark, folder, 1995, 1997).select(KEY, "report_year", "product_code", "EVENT_TYPE")


@register("published_manifest", """SELECT report_year AS year, count(*) AS n_rows, CAST(1 AS INTEGER) AS schema_version FROM reports GROUP BY 1""")
def p06(x: Lens) -> DataFrame:
    """The rows that the manifest counts in the files of each year."""
    folder = _folder(x.spark)
    publish.write_reports(x.some("product_code"), folder, first_year=1990)
    files = publish.manifest(x.spark, folder)
    return files.groupBy(F.col("first_year").alias("year")).agg(F.sum("rows").alias("n_rows"), F.max("schema_version").alias("schema_version"))


@register("loaded_once", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(1 AS BIGINT) AS times FROM orders""", lens=False)
def i01(x: Lens) -> DataFrame:
    """Files that come between two loads are read by the second, the others by the first."""
    folder, orders = _folder(x.spark), x.table("orders").select("o_orderkey", "o_orderstatus")
    for rest in (0, 1):
        _write_pipes(orders.filter(F.col("o_orderkey") % 2 == rest), f"{folder}/in", "append")
        incremental.load_new(x.spark, f"{folder}/in", orders.columns, f"{folder}/out", f"{folder}/log", "*.csv").awaitTermination()
    return x.spark.read.parquet(f"{folder}/out").groupBy(*orders.columns).agg(F.count("*").alias("times"))


@register("loaded_by_header", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS o_orderstatus, o_orderpriority, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS batch FROM orders""", lens=False)
def i01_headers(x: Lens) -> DataFrame:
    """Two loads of files with their columns in another order and with one column missing."""
    folder, orders = _folder(x.spark), x.table("orders")
    for rest, names in enumerate((("o_orderkey", "o_orderstatus", "o_orderpriority"), ("o_orderpriority", "o_orderkey", "o_orderstatus"), ("o_orderkey", "o_orderpriority"))):
        _write_pipes(orders.filter(F.col("o_orderkey") % 3 == rest).select(*names), f"{folder}/in", "append")
        if rest != 1:
            incremental.load_new(x.spark, f"{folder}/in", None, f"{folder}/out", f"{folder}/log", "*.csv").awaitTermination()
    return incremental.loaded(x.spark, f"{folder}/out").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("batch").cast("long").alias("batch"))


@register("amended_orders", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS o_orderpriority FROM orders""", lens=False)
def i02(x: Lens) -> DataFrame:
    """A table of the latest row of each key, changed by a later file that lacks a column."""
    folder, orders = _folder(x.spark), x.table("orders")
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    changed = orders.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    for rows in (orders.select(*columns), changed):
        _write_pipes(rows, f"{folder}/in", "append")
        incremental.amend(x.spark, f"{folder}/in", ["o_orderkey"], columns, f"{folder}/table", f"{folder}/log", "*.csv", buckets=8).awaitTermination()
    return x.spark.read.parquet(f"{folder}/table").select(*columns)


_LATE_YEARS = (1996, 1997)


@register("late_file_refreshed", """, flags AS (SELECT DISTINCT l_orderkey AS k, l_returnflag || l_linestatus AS code FROM lineitem), known AS (
  SELECT f.k, code, report_year FROM flags f JOIN reports r ON r.k = f.k WHERE code NOT LIKE 'R%' OR report_year IN (1996, 1997))
SELECT 'code' AS part, code AS name, count(*) AS n FROM known GROUP BY 2
UNION ALL SELECT 'listed', CAST(report_year AS VARCHAR), count(*) FILTER (WHERE codes IS NOT NULL) FROM (SELECT r.k, any_value(r.report_year) AS report_year, string_agg(code, ', ' ORDER BY code) AS codes FROM reports r LEFT JOIN known USING (k) GROUP BY 1) WHERE codes LIKE '%R%' GROUP BY 2
UNION ALL SELECT 'kept', CAST(report_year AS VARCHAR), CAST(report_year NOT IN (1996, 1997) AS BIGINT) FROM reports GROUP BY ALL""")
def i03_late(x: Lens) -> DataFrame:
    """A late file of patient problems touches two years; all counts are those of a rebuild, and the folders of
    the other years keep their files."""
    folder = _folder(x.spark)
    reports = x.some("patient_problem_codes").drop("patient_problem_codes").withColumn("patient_problem_codes", F.lit(None).cast("string"))
    known = x.patient_problem.filter("PROBLEM_CODE not like 'R%'")
    lists = build.problem_list(known, "_codes")
    store = incremental.Store(x.spark, f"{folder}/store")
    store.create(reports.join(lists, KEY, "left").withColumn("patient_problem_codes", F.col("_codes")).drop("_codes"), known)
    by_year = lambda: {y: {f.path for t in ("reports", "bridge", "totals") for f in files.listed(x.spark, f"{store.path(t)}/year_bucket={y}")} for y in years}
    years = [r[0] for r in store.table("reports").select("year_bucket").distinct().collect()]  # a row a year
    before = by_year()
    late = x.patient_problem.filter("PROBLEM_CODE like 'R%'").join(x.some("EVENT_TYPE").filter(F.col("report_year").isin(*_LATE_YEARS)).select(KEY), KEY)
    late.select(F.concat_ws("|", KEY, "PROBLEM_CODE")).write.text(f"{folder}/in")
    read = lambda spark, path: pipe_files.read_problem_codes(spark, path).withColumn(KEY, F.col(KEY).cast("long"))
    store.watch(f"{folder}/in", read, f"{folder}/log").awaitTermination()
    after = by_year()
    kept = x.spark.createDataFrame([("kept", str(y), int(before[y] == after[y])) for y in years], "part string, name string, n long")
    listed = store.table("reports").filter("patient_problem_codes like '%R%'").groupBy(F.col("report_year").cast("string").alias("name")).agg(F.count("*").alias("n"))
    return store.totals().select(F.lit("code").alias("part"), F.col("code").alias("name"), F.col("n_reports").alias("n")).unionByName(listed.withColumn("part", F.lit("listed"))).unionByName(kept)


def _named(x: Lens, rows: DataFrame, folder: str, name: str, first: str | None = None) -> None:
    """Writes lines as files of this beginning, as many as there are tasks, each with `first` as its first line."""
    if first is None:
        rows.write.text(f"{folder}-parts/{name}")
    else:  # a CSV of one column, which is named by that line; no line has the separator
        rows.toDF(first).write.csv(f"{folder}-parts/{name}", header=True, sep="\x01", quote="", escape="", emptyValue="")
    store = files.store_of(x.spark, folder)
    store.mkdirs(files.path_of(x.spark, folder))
    for i, part in enumerate(files.listed(x.spark, f"{folder}-parts/{name}")):
        if part.length:
            store.rename(files.path_of(x.spark, part.path), files.path_of(x.spark, f"{folder}/{name}{i:05d}.txt"))


@register("raw_folder", """SELECT 'mdr' AS role, count(*) AS n FROM orders UNION ALL SELECT 'device', count(*) FROM lineitem UNION ALL SELECT 'device_problem', count(*) FROM lineitem
UNION ALL SELECT 'patient_problem', count(*) FROM lineitem UNION ALL SELECT 'device_dictionary', count(DISTINCT p_size) FROM part UNION ALL SELECT 'patient_dictionary', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'odd', count(*) FILTER (WHERE l_quantity > 40) FROM lineitem UNION ALL SELECT 'odd_counted', count(*) FILTER (WHERE l_quantity > 40) FROM lineitem""", lens=False)
def s10(x: Lens) -> DataFrame:
    """The files of a folder by role, each read by its role's reader; odd lines are kept and counted."""
    folder, orders, lines, part = _folder(x.spark), x.table("orders"), x.table("lineitem"), x.table("part")
    raw = f"{folder}/raw"
    line = lambda *c: F.concat_ws("|", *c).alias("value")

    _named(x, orders.select(line("o_orderkey", "o_orderstatus")), raw, "mdrfoi", f"{KEY}|EVENT_TYPE")
    odd = F.when(F.col("l_quantity") > 40, F.lit("more")).otherwise(F.lit(None))
    _named(x, lines.select(line("l_orderkey", "l_linenumber", F.lit("name"), odd)), raw, "device2020", f"{KEY}|DEVICE_EVENT_KEY|BRAND_NAME")
    _named(x, lines.select(line(F.col("l_orderkey") + 1_000_000, "l_linenumber")), raw, "foidevproblem")
    _named(x, lines.select(line("l_orderkey", F.lit(1), "l_linenumber")), raw, "patientproblemcode")
    _named(x, part.groupBy("p_size").agg(F.min("p_type").alias("t")).select(line("p_size", "t")), raw, "deviceproblemcodes")
    quoted = part.groupBy("p_brand").count().select(F.format_string('"%s","a, b","C1","A1"', "p_brand").alias("value"))
    _named(x, quoted, raw, "patientproblemdata", '"FDA_CODE","TERM","NCIT_CODE","IMDRF_CODE"')
    found = load_folder(x.spark, raw, f"{folder}/staged")
    roles = ("mdr", "device", "device_problem", "patient_problem", "device_dictionary", "patient_dictionary")
    counts = [getattr(found, r).agg(F.count("*").alias("n")).select(F.lit(r).alias("role"), "n") for r in roles]
    counts.append(found.odd.agg(F.count("*").alias("n")).select(F.lit("odd").alias("role"), "n"))
    counts.append(x.spark.createDataFrame([("odd_counted", found.counts["device"]["odd"])], "role string, n long"))
    return reduce(DataFrame.unionByName, counts)


@register("rollup_refreshed", """SELECT report_year, event_type AS "EVENT_TYPE", count(*) AS n, count(*) FILTER (WHERE is_rwd) AS n_rwd, count(*) FILTER (WHERE NOT is_supplement) AS n_initial, count(*) FILTER (WHERE is_supplement) AS n_supplement FROM reports WHERE report_year >= 1996 OR k % 2 = 0 GROUP BY ALL""")
def i03(x: Lens) -> DataFrame:
    """A rollup of half of the reports, whose later years are recomputed from all."""
    rows = x.some("EVENT_TYPE", "IS_RWD_SOURCED", "initial_report", "is_supplement")
    old, fresh = build.yearly_events(rows.filter(F.col(KEY) % 2 == 0)), build.yearly_events(rows.filter("report_year >= 1996"))
    return incremental.affected(old, fresh, ["report_year"])


_CRITERIA = Cohort(year_lo=1994, year_hi=1997, product_code="brand#2", manufacturer="#0000000", event_types=("D", "IN"), exclude_rwd=True, initial_only=True)


@register("cohort_sql", """SELECT k AS "MDR_REPORT_KEY", event_type AS "EVENT_TYPE", report_year FROM reports WHERE report_year BETWEEN 1994 AND 1997 AND product_code = 'BRAND#2' AND contains(manufacturer, '#0000000') AND event_type <> 'M' AND NOT is_rwd AND NOT is_supplement""")
def c15(x: Lens) -> DataFrame:
    """The SQL of a cohort selects the cohort."""
    rows = x.some("product_code", "manufacturer", "EVENT_TYPE", "IS_RWD_SOURCED", "initial_report")
    return rows.filter(_CRITERIA.to_sql()).select(KEY, "EVENT_TYPE", "report_year")


@register("published_versions", """SELECT k AS "MDR_REPORT_KEY", report_year, product_code, '000002' AS version, CAST(0 AS BIGINT) AS wrong FROM reports WHERE report_year BETWEEN 1996 AND 1997""")
def p08(x: Lens) -> DataFrame:
    """Two versions, the second of all reports; years of the current one by its manifest."""
    root, reports = f"{_folder(x.spark)}/site", x.some("product_code")
    for rows in (reports.filter(F.col(KEY) % 2 == 0), reports):
        publish.publish(x.spark, root, {"reports": lambda path, rows=rows: publish.write_reports(rows, path, first_year=1994)})
    folder = publish.current(x.spark, root)
    wrong = publish.verify(x.spark, folder).agg(F.count("*").alias("wrong"))  # one row
    rows = publish.read_published(x.spark, root, "reports", 1996, 1997).select(KEY, "report_year", "product_code", F.lit(folder.rsplit("/", 1)[1]).alias("version"))
    return rows.join(F.broadcast(wrong))


@register("exported_csv", """SELECT CAST(k AS VARCHAR) AS "MDR_REPORT_KEY", event_type AS "EVENT_TYPE", product_code, brand AS "BRAND_NAME" FROM reports WHERE product_code = 'BRAND#2'""")
def p01(x: Lens) -> DataFrame:
    """A cohort's records as CSV, read back."""
    folder = _folder(x.spark)
    publish.write_csv(x.some("EVENT_TYPE", "product_code", "BRAND_NAME").filter("product_code = 'BRAND#2'"), folder)
    return x.spark.read.csv(folder, header=True, escape='"').select(KEY, "EVENT_TYPE", "product_code", "BRAND_NAME")


@register("whole_narratives", """SELECT n.k AS "MDR_REPORT_KEY", turn AS "MDR_TEXT_KEY", text AS "FOI_TEXT", coalesce(report_year, 0) AS year FROM narrative n JOIN reports r ON r.k = n.k""")
def p05(x: Lens) -> DataFrame:
    """Untruncated narrative parts by year, read back."""
    folder = _folder(x.spark)
    publish.write_narratives(x.narrative, x.some(), folder)
    return x.spark.read.parquet(folder).select(KEY, "MDR_TEXT_KEY", "FOI_TEXT", "year")


@register("screen_whole_corpus", _screen_sql("product_code = 'BRAND#2'").replace(f"WHERE report_year IS NULL OR report_year >= {ELIGIBLE_FROM}", ""))
def a24(x: Lens) -> DataFrame:
    """The screen against reports of all years."""
    rows = x.some("product_code")
    return analyses.flat_screen(analyses.screen(F.col("product_code") == "BRAND#2", rows, x.pairs, x.dictionary, eligible(ELIGIBLE_FROM), comparator="all"))


@register("outcome_rates_text", f"SELECT outcome, printf('%.1f%% (%.1f-%.1f)', rate, lo, hi) AS shown FROM (SELECT outcome, {_wilson('k', 'n')} FROM (SELECT {_OUTCOME_COUNTS} FROM reports) {_OUTCOME_UNPIVOT})")
def t20(x: Lens) -> DataFrame:
    """Rates with their intervals as they are shown."""
    rows = analyses.outcome_rates(x.some(*analyses.OUTCOMES))
    return rows.select("outcome", stats.percent_text(stats.wilson(F.col("k"), F.col("n"))).alias("shown"))


@register("compose_old_vintage", """SELECT k AS "MDR_REPORT_KEY", product_code, CAST(NULL AS INTEGER) AS supplement_number, false AS is_supplement, CAST(NULL AS DOUBLE) AS device_age_days, CAST(NULL AS VARCHAR) AS "REPORTER_OCCUPATION_CODE" FROM reports""")
def b08(x: Lens) -> DataFrame:
    """Reports of a vintage whose files lack some columns."""
    mdr, device = x.mdr.drop("SUPPLEMENT_NUMBER", "REPORTER_OCCUPATION_CODE"), x.device.drop("DEVICE_AGE_TEXT")
    wanted = ("product_code", "supplement_number", "is_supplement", "device_age_days", "REPORTER_OCCUPATION_CODE")
    return build.compose(mdr, device, x.patient, x.narrative, x.device_problem, x.patient_problem, wanted).select(KEY, *wanted)


def _statement_sql(inside: str, criteria: str, sql: str) -> str:
    shown = {
        "corpus": "count(*)", "eligible_corpus": f"count(*) FILTER (WHERE report_year IS NULL OR report_year >= {ELIGIBLE_FROM})", "vintage": "max(date_pref)", "n": f"count(*) FILTER (WHERE {inside})",
        "eligible": f"count(*) FILTER (WHERE {inside} AND (report_year IS NULL OR report_year >= {ELIGIBLE_FROM}))", "first": f"min(date_pref) FILTER (WHERE {inside})", "last": f"max(date_pref) FILTER (WHERE {inside})",
        "events": f"count(DISTINCT report_number) FILTER (WHERE {inside})", "deaths": f"count(*) FILTER (WHERE {inside} AND event_type = 'D')", "injuries": f"count(*) FILTER (WHERE {inside} AND event_type = 'IN')",
        "malfunctions": f"count(*) FILTER (WHERE {inside} AND event_type = 'M')", "serious": f"count(*) FILTER (WHERE {inside} AND serious)",
    }
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    facts = ", ".join(f'coalesce(CAST({e} AS VARCHAR), \'none\') AS "f_{n}"' for n, e in shown.items())
    filled = "text"
    for n in shown:
        filled = f"""replace({filled}, '{{{n}}}', "f_{n}")"""
    filled = f"replace(replace({filled}, '{{criteria}}', {quote(criteria)}), '{{sql}}', {quote(sql)})"
    items = ", ".join(f"({i + 1}, {quote(no)}, {quote(item)}, {quote(t)})" for i, (no, item, t) in enumerate(statement.ITEMS))
    return f"""SELECT position, number, item, {filled} AS text FROM (SELECT {facts} FROM reports), (VALUES {items}) AS v(position, number, item, text)"""


@register("reporting_statement", _statement_sql(
    "(report_year BETWEEN 1994 AND 1997 AND product_code = 'BRAND#2' AND contains(manufacturer, '#0000000') AND event_type <> 'M' AND NOT is_rwd AND NOT is_supplement)",
    "Preferred report date in 1994 to 1997. Product code BRAND#2. Manufacturer's name contains '#0000000', in any case. Event type is one of Death, Injury. Reports from real-world data sources are left out. Supplements are left out, so that an event counts once.",
    "report_year >= 1994 AND report_year <= 1997 AND product_code = 'BRAND#2' AND contains(lower(manufacturer), '#0000000') AND EVENT_TYPE IN ('D', 'IN') AND NOT coalesce(IS_RWD_SOURCED, false) AND coalesce(initial_report, true)",
))
def a22(x: Lens) -> DataFrame:
    """Criteria in sentences and the items of a reporting checklist, with their counts."""
    rows = x.some("product_code", "manufacturer", "EVENT_TYPE", "IS_RWD_SOURCED", "initial_report", "REPORT_NUMBER", "any_serious_outcome")
    return statement.statement(rows, _CRITERIA, eligible(ELIGIBLE_FROM))


@register("methods_paragraph", f"""SELECT 'product_code = ''BRAND#2''' AS criteria, concat('Reports were selected where product_code = ''BRAND#2''. The selection holds ', count(*), ' reports dated ', min(date_pref), ' to ', max(date_pref), '; ',
  count(*) FILTER (WHERE report_year IS NULL OR report_year >= {ELIGIBLE_FROM}), ' of them fall in years with problem codes. Proportions are of reports, with Wilson 95% intervals; they are not rates among devices in use.') AS paragraph FROM reports WHERE product_code = 'BRAND#2'""")
def a22_paragraph(x: Lens) -> DataFrame:
    """The paragraph of a cohort."""
    return analyses.methods(x.some("product_code"), Cohort(product_code="brand#2"), eligible(ELIGIBLE_FROM)).select("criteria", "paragraph")


# ---- N05: the stemmer's steps in DuckDB ----------------------------------------------------


def _cut(n: int) -> str:
    return f"left(w, len(w) - {n})"


def _swap(suffixes: tuple[tuple[str, str], ...]) -> str:
    whens = [f"WHEN ends_with(w, '{s}') THEN CASE WHEN regexp_matches({_cut(len(s))}, '{M_OVER_0}') THEN {_cut(len(s))} || '{new}' ELSE w END" for s, new in sorted(suffixes, key=lambda x: -len(x[0]))]
    return f"CASE {' '.join(whens)} ELSE w END"


def _strip() -> str:
    after = f" AND regexp_matches({_cut(3)}, '[st]$')"
    whens = [f"WHEN ends_with(w, '{s}') THEN CASE WHEN regexp_matches({_cut(len(s))}, '{M_OVER_1}'){after if s == 'ion' else ''} THEN {_cut(len(s))} ELSE w END" for s in sorted(STEP_4, key=len, reverse=True)]
    return f"CASE {' '.join(whens)} ELSE w END"


_SHORT_STEM = f"regexp_matches(r, '{M_OVER_0}') AND NOT regexp_matches(r, '{M_OVER_1}') AND regexp_matches(r, '{SHORT}')"
_STEM_STEPS = (
    "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g')",
    f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2)} WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_cut(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches({_cut(3)}, '{M_OVER_0}') THEN {_cut(1)} ELSE w END WHEN ends_with(w, 'ed') AND regexp_matches({_cut(2)}, '{VOWEL}') THEN {_cut(2)} || '+' WHEN ends_with(w, 'ing') AND regexp_matches({_cut(3)}, '{VOWEL}') THEN {_cut(3)} || '+' ELSE w END",
    f"CASE WHEN ends_with(w, '+') THEN CASE WHEN regexp_matches(r, '(at|bl|iz)$') OR ({_SHORT_STEM} AND NOT regexp_matches(r, '{DOUBLE}')) THEN r || 'e' WHEN regexp_matches(r, '{DOUBLE}') AND NOT regexp_matches(r, '[lsz]$') THEN left(r, len(r) - 1) ELSE r END ELSE w END",
    f"CASE WHEN regexp_matches(w, '[yY]$') AND regexp_matches({_cut(1)}, '{VOWEL}') THEN {_cut(1)} || 'i' ELSE w END",
    _swap(STEP_2), _swap(STEP_3), _strip(),
    f"CASE WHEN ends_with(w, 'e') AND (regexp_matches({_cut(1)}, '{M_OVER_1}') OR (regexp_matches({_cut(1)}, '{M_OVER_0}') AND NOT regexp_matches({_cut(1)}, '{SHORT}'))) THEN {_cut(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'll') AND regexp_matches({_cut(1)}, '{M_OVER_1}') THEN {_cut(1)} ELSE w END",
)
_ASKED = "'clowns', 'idiots', 'pathetically', 'thes'"
_STEMS = f"s0 AS (SELECT word, word AS w FROM (SELECT word FROM t UNION SELECT unnest([{_ASKED}])))" + "".join(
    f", s{i + 1} AS (SELECT word, {step} AS w FROM (SELECT word, w, rtrim(w, '+') AS r FROM s{i}))" for i, step in enumerate(_STEM_STEPS)
) + f", stems AS (SELECT word, CASE WHEN len(word) > 2 THEN lower(w) ELSE word END AS stem FROM s{len(_STEM_STEPS)})"


@register("bm25_stemmed", _TOKENS + f""", t AS (SELECT doc_id, len(w) AS length, unnest(w) AS word FROM w), {_STEMS},
asked AS (SELECT DISTINCT stem FROM stems WHERE word IN ({_ASKED})),
postings AS (SELECT stem, doc_id, length, count(*) AS f FROM t JOIN stems USING (word) JOIN asked USING (stem) GROUP BY ALL),
facts AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w), d AS (SELECT stem, count(*) AS d FROM postings GROUP BY 1)
SELECT doc_id AS key, round(sum(ln(1 + (docs - d + .5) / (d + .5)) * f * 2.2 / (f + 1.2 * (.25 + .75 * length / mean))), 6) AS score FROM postings JOIN d USING (stem), facts GROUP BY doc_id ORDER BY sum(ln(1 + (docs - d + .5) / (d + .5)) * f * 2.2 / (f + 1.2 * (.25 + .75 * length / mean))) DESC, doc_id LIMIT 50""", lens=False)
def n05(x: Lens) -> DataFrame:
    """A search index with stems, written and searched."""
    folder = _folder(x.spark)
    text.write_index(x.table("documents"), "doc_id", "text", folder)
    return text.search_index(x.spark, folder, "clowns, idiots, pathetically thes", 50)


@register("screen_of_published_files", _screen_sql("product_code = 'BRAND#2'"))
def a10_files(x: Lens) -> DataFrame:
    """The screen on a bridge and rollups that were written, sorted by product code, and are read back."""
    folder, reports = _folder(x.spark), x.some("product_code")
    publish.write_bridge(x.pairs, reports, f"{folder}/bridge")
    read = lambda name: x.spark.read.parquet(f"{folder}/{name}")
    publish.write_small(publish.report_counts(reports), f"{folder}/reports")
    publish.write_small(publish.code_counts(read("bridge")), f"{folder}/codes")
    publish.write_small(x.dictionary, f"{folder}/dictionary")
    return analyses.flat_screen(analyses.published_screen(read("bridge"), read("reports"), read("codes"), read("dictionary"), "BRAND#2", ELIGIBLE_FROM))


_CODES = ("us", "DE ", "fr", "gb", "JP", "uk", "xx")


@register("geography_by_country", f"""SELECT country, n, round(log10(n + 1), 6) AS log_n, iso3, name FROM (
  SELECT upper(trim(([{", ".join(f"'{c}'" for c in _CODES)}])[c_nationkey % {len(_CODES)} + 1])) AS country, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
LEFT JOIN (VALUES ('US', 'USA', 'United States'), ('DE', 'DEU', 'Germany'), ('FR', 'FRA', 'France'), ('GB', 'GBR', 'United Kingdom'), ('JP', 'JPN', 'Japan'), ('UK', 'GBR', 'United Kingdom')) AS v(country, iso3, name) USING (country)""", lens=False)
def e16(x: Lens) -> DataFrame:
    """Reports by country with the country's codes and name."""
    rows = x.table("orders").join(x.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("c_nationkey") % len(_CODES) + 1).cast("int"))
    return analyses.geography(rows.select(code.alias("reporter_country_code")), countries(x.spark))


_NARROW = Cohort(device_terms=("ring", "econ"), exclude_forwarded=True, implant_only=True, serious_only=True)


@register("cohort_sql_flags", """SELECT k AS "MDR_REPORT_KEY", '' AS one FROM reports WHERE (contains(lower(brand), 'ring') OR contains(lower(generic), 'ring') OR contains(lower(brand), 'econ') OR contains(lower(generic), 'econ')) AND NOT coalesce(fwd, false) AND implant AND serious
UNION ALL SELECT k, 'key' FROM reports WHERE k = 7""")
def c15_flags(x: Lens) -> DataFrame:
    """The other criteria as SQL, and a report key, which stands alone."""
    rows = x.some("BRAND_NAME", "GENERIC_NAME", "MODEL_NUMBER", "IS_FORWARDED_803_22_B2", "implant_flag", "any_serious_outcome")
    alone = Cohort(report_key="7", implant_only=True)
    return rows.filter(_NARROW.to_sql()).select(KEY, F.lit("").alias("one")).unionByName(rows.filter(alone.to_sql()).select(KEY, F.lit("key").alias("one")))
