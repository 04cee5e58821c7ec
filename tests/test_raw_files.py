import pytest
from pyspark.sql import functions as F
from raw import write

from vigil.functions import enrich
from vigil.operators import analyses, build, checks, publish, search, text
from vigil.operators.build import KEY
from vigil.operators.cohort import Cohort
from vigil.plans import stored
from vigil.plans.lens import Lens
from vigil.sources import pipe_files as pf
from vigil.sources.countries import countries
from vigil.sources.folder import load_folder
from vigil.streaming import incremental


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write(tmp_path_factory.mktemp("raw"))


def reports_inputs(spark, folder):
    read = lambda name: pf.read_pipe(spark, f"{folder}/{name}")
    return [
        pf.typed_reports(read("mdrfoiThru2021.txt")), read("device2019.txt"), read("patient2019.txt"), pf.read_narratives(spark, f"{folder}/foitext2019.txt"),
        pf.read_problem_codes(spark, f"{folder}/foidevproblem.txt"), pf.read_problem_codes(spark, f"{folder}/patientproblemcode.txt"),
    ]


@pytest.fixture(scope="module")
def reports(spark, folder):
    out = build.compose(*reports_inputs(spark, folder)).cache()
    return {r[KEY]: r for r in out.collect()}, out


def test_ragged_lines(spark, folder):
    rows = pf.read_pipe(spark, f"{folder}/mdrfoiThru2021.txt").collect()
    assert len(rows) == 5 and rows[0]["MDR_REPORT_KEY"] == "700001"
    assert rows[-1]["PRODUCT_PROBLEM_FLAG"] is None and rows[3]["MANUFACTURER_NAME"] == "acme medical"
    assert pf.surplus_lines(spark, f"{folder}/mdrfoiThru2021.txt").count() == 1
    # a tab is a delimiter too
    assert pf.read_pipe(spark, f"{folder}/device2019.txt").filter(f"{KEY} = '700004'").first()["DEVICE_EVENT_KEY"] == "13"
    row = spark.createDataFrame([("1| a |b|c",)], "line string").select(pf.fields(F.col("line"), 2)).first()[0]
    assert row == ["1", "a |b|c"]  # what is too much stays in the last field


def test_wrapped_narratives(spark, folder):
    rows = {r["MDR_TEXT_KEY"]: r["FOI_TEXT"] for r in pf.read_narratives(spark, f"{folder}/foitext2019.txt").collect()}
    assert rows == {
        "1": "The pump stopped without alarm and the patient died.",
        "2": 'Evaluation: a|b and a "quote" (b)(4)',
        "3": "Forwarded under 803.22(B)(2) for the record (b)(6)",
    }


def test_many_splits(spark, tmp_path):
    lines = ["KEY|TEXT"]
    for i in range(4000):
        lines += [f"{100000 + i}|record {i}", *[f" part {j}" for j in range(i % 4)]]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {int(r["KEY"]): r["TEXT"] for r in pf.read_narratives(spark, str(tmp_path / "long.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {100000 + i: " ".join([f"record {i}", *[f"part {j}" for j in range(i % 4)]]) for i in range(4000)}


def test_problem_code_layouts(spark, folder, tmp_path):
    five = pf.read_problem_codes(spark, f"{folder}/patientproblemcode.txt")
    assert sorted((r[0], r["PROBLEM_CODE"]) for r in five.collect()) == [("700001", "1802"), ("700002", "2001")]
    assert five.first()["DATE_ADDED"] == "2019/03/14"
    assert sorted(r["PROBLEM_CODE"] for r in pf.read_problem_codes(spark, f"{folder}/patientproblemcode3.txt").collect()) == ["1802", "2001"]
    assert pf.read_problem_codes(spark, f"{folder}/foidevproblem.txt").count() == 5
    (tmp_path / "odd.txt").write_text("1|2|3|4|5|6\n")
    with pytest.raises(ValueError):
        pf.read_problem_codes(spark, str(tmp_path / "odd.txt"))


def test_union_by_name(spark, tmp_path):
    (tmp_path / "a.txt").write_text("K|A\n1|x\n")
    (tmp_path / "b.txt").write_text("K|B\n2|y\n")
    rows = pf.read_pipe_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).orderBy("K").collect()
    assert [tuple(r) for r in rows] == [("1", "x", None), ("2", None, "y")]


def test_dictionary(spark, folder, tmp_path):
    terms = {r["FDA_CODE"]: r["TERM"] for r in pf.read_dictionary(spark, f"{folder}/deviceproblemcodes.csv").collect()}
    assert terms["1670"] == "Leak, or splash" and terms["2993"] == "Adverse event"
    (tmp_path / "d.csv").write_text('"FDA_CODE,TERM,NCIT_CODE,IMDRF_CODE"\n"7,Crack,C7,A7"\n')
    assert tuple(pf.read_dictionary(spark, str(tmp_path / "d.csv")).first()) == ("7", "Crack", "C7", "A7")


def test_inventory(spark, folder):
    found = pf.inventory(spark, str(folder))
    roles = {r["path"].rsplit("/", 1)[1]: r["role"] for r in found.collect()}
    assert roles == {
        "mdrfoiThru2021.txt": "mdr", "device2019.txt": "device", "foitext2019.txt": "narrative", "patient2019.txt": "patient", "patientproblemcode.txt": "patient_problem",
        "patientproblemcode3.txt": "patient_problem", "foidevproblem.txt": "device_problem", "deviceproblemcodes.csv": "device_dictionary",
    }
    status = {r["role"]: r["status"] for r in pf.presence(found).collect()}
    assert status["mdr"] == "PRESENT" and status["patient_dictionary"] == "MISSING"
    assert pf.delimiter(spark, f"{folder}/deviceproblemcodes.csv") == "," and pf.delimiter(spark, f"{folder}/device2019.txt") == "|"


def test_a_whole_folder(spark, folder, reports, tmp_path):
    loaded = load_folder(spark, str(folder))
    by_key = lambda df: {r[KEY]: r for r in df.drop("patient_problem_codes").collect()}  # noqa: E731  of two files here
    assert by_key(loaded.reports()) == by_key(reports[1])
    assert loaded.device_dictionary.count() == 4 and loaded.patient_dictionary.count() == 0
    (tmp_path / "mdrfoi.txt").write_text("MDR_REPORT_KEY|EVENT_TYPE|DATE_RECEIVED\n1|D|20200101\n")
    (only,) = load_folder(spark, str(tmp_path)).reports().collect()
    assert (only[KEY], only["report_year"], only["device_count"], only["has_narrative"]) == ("1", 2020, 0, False)
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        load_folder(spark, str(tmp_path / "none"))


def test_countries(spark):
    found = {r["country"]: (r["iso3"], r["name"]) for r in countries(spark).collect()}
    assert found["US"] == ("USA", "United States") and found["UK"] == found["GB"] == ("GBR", "United Kingdom") and len(found) > 240
    rows = spark.createDataFrame([("us ",), ("US",), ("xx",), (None,)], "reporter_country_code string")
    got = {r["country"]: (r["n"], r["iso3"]) for r in analyses.geography(rows, countries(spark)).collect()}
    assert got == {"US": (2, "USA"), "XX": (1, None)}


def test_composed_reports(reports):
    r, _ = reports
    a, b, c, d, e = (r[f"70000{i}"] for i in range(1, 6))
    assert (a["BRAND_NAME"], a["device_count"], a["device_age_days"]) == ("FLOWMAX", 2, 3 * 365.25)  # key 9 comes before 10
    assert c["device_age_days"] == 14 and d["device_age_days"] is None and e["device_count"] == 0
    assert 0.25 < b["age_years_avg"] < 0.30 and c["age_years_avg"] == 70 and d["age_years_max"] == 67
    assert a["outcome_death"] and a["outcome_required_intervention"] and not a["outcome_hospitalization"] and a["any_serious_outcome"]
    assert d["outcome_other"] and d["outcome_required_intervention"]  # 'O, R' with a blank
    assert sum(x["any_serious_outcome"] for x in r.values()) == 4 and sum(x["EVENT_TYPE"] == "D" for x in r.values()) == 2
    assert d["is_supplement"] and d["supplement_number"] == 1 and [x["initial_report"] for x in r.values()].count(False) == 1
    assert c["IS_RWD_SOURCED"] and c["IS_FORWARDED_803_22_B2"] and c["HAS_REDACTION_B6"] and a["HAS_REDACTION_B4"] and b["HAS_REDACTION_B4"] is None
    assert str(c["DATE_PREF"]) == "2020-01-05" and str(b["DATE_PREF"]) == "2019-03-20"
    assert a["lag_days"] == 13 and d["lag_days"] is None and d["lag_days_raw"] == 405
    assert d["manufacturer"] == "ACME MEDICAL" and a["product_code"] == "FRN" and a["reporter_country_code"] == "US"
    assert a["device_problem_codes"] == "1069, 1670" and d["sex_list"] == "F,M"
    assert a["narrative_mfg"].startswith("Evaluation") and a["narr_part_count"] == 2 and not e["has_narrative"]


def test_cohorts(spark, reports):
    _, df = reports
    assert Cohort(initial_only=True).of(df).count() == 4
    assert Cohort(report_key="700002", serious_only=True, year_lo=2030).of(df).count() == 1
    assert Cohort(narrative="100%").of(df).count() == 0
    both = Cohort.from_terms("flowmax; laser", event_types=("D", "M"))
    assert sorted(r[0] for r in both.of(df).select(KEY).collect()) == ["700001", "700003", "700004"]
    assert Cohort.from_json(both.to_json()) == both and Cohort().to_json() == "{}"
    every = Cohort("FRN", "acme", ("pump",), "o'clock", "", 2000, 2030, ("D",), True, True, True, True, True)
    assert df.filter(every.column()).count() == df.filter(every.to_sql()).count()


def test_refresh_drops_stale_codes(spark, reports):
    _, df = reports
    fresh = spark.createDataFrame([("700003", "9999")], f"{KEY} string, PROBLEM_CODE string")
    out, pairs, totals = build.refresh_patient_problems(df, fresh)
    codes = {r[KEY]: r["patient_problem_codes"] for r in out.collect()}
    assert codes["700001"] is None and codes["700003"] == "9999" and pairs.count() == 1 and totals.first()["n_reports"] == 1


def test_publish_and_read(spark, reports, tmp_path):
    _, df = reports
    publish.write_reports(df, str(tmp_path / "reports"))
    assert pf.read_years(spark, str(tmp_path / "reports"), 2020, 2021).count() == 3
    files = publish.manifest(spark, str(tmp_path / "reports")).collect()
    assert sum(r["rows"] for r in files) == 5 and all(len(r["sha256"]) == 64 and r["bytes"] > 0 for r in files)
    pairs = build.bridge_of_lists(df, "device_problem_codes")
    publish.write_bridge(pairs, df, str(tmp_path / "bridge"))
    assert spark.read.parquet(str(tmp_path / "bridge")).filter("pc = 'FRN'").count() == 4
    publish.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').count() == 5
    publish.write_json(publish.summary(df, 2015), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first()["eligible"] == 5


def test_checks(spark, reports):
    _, df = reports
    mdr = df.select(KEY)
    stray = spark.createDataFrame([("700001", "x"), ("1", "")], f"{KEY} string, FOI_TEXT string")
    found = checks.orphan_rows({"narrative": stray}, mdr).unionByName(checks.narratives(stray)).unionByName(checks.dates(df))
    rows = {r["check"]: (r["severity"], r["metric"]) for r in found.collect()}
    assert rows["orphans"] == (1, 1.0) and rows["narrative_text"] == (1, 50.0) and rows["dated"] == (0, 100.0)
    assert checks.severity(found).first()["severity"] == 1
    assert checks.columns(df, "reports", ("nothing",)).first()["severity"] == 2


def test_new_files_only(spark, tmp_path):
    names = ["K", "V"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("K|V\n1|x\n2|y|z\n")
    run = lambda: incremental.load_new(spark, str(tmp_path / "in"), names, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.txt").write_text("K|V\n2|later\n")
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["K"], r["V"]) for r in rows.collect()) == [("1", "x"), ("2", "later"), ("2", "y|z")]
    last = incremental.latest(rows, ["K"], "file")
    assert {r["K"]: r["V"] for r in last.collect()} == {"1": "x", "2": "later"}
    old = spark.createDataFrame([("a", 1), ("b", 2)], "g string, n long")
    assert sorted(map(tuple, incremental.affected(old, spark.createDataFrame([("b", 5), ("c", 1)], "g string, n long"), ["g"]).collect())) == [("a", 1), ("b", 5), ("c", 1)]
    files = spark.createDataFrame([("p", 1, 1), ("q", 2, 2)], "path string, length long, modificationTime long")
    assert [r["path"] for r in incremental.unseen(files, files.filter("path = 'p'")).collect()] == ["q"]


def test_enrichment_edges(spark):
    ages = ["3 YR", "6 mo", "8 HR", "12", "5 XX", "", None, "abc", "7.5 DEC"]
    df = spark.createDataFrame([(a,) for a in ages], "a string")
    rows = df.select(enrich.age_years(F.col("a")), enrich.device_age_days(F.col("a"))).collect()
    years, days = zip(*rows, strict=True)
    assert years[0] == 3 and years[1] == 0.5 and years[3] == 12 and years[4:8] == (None,) * 4 and years[8] == 75
    assert days[0] == 1095.75 and days[1] == 182.625 and days[3:] == (None,) * 6
    dates = spark.createDataFrame([("20200229",), ("2/29/2020",), ("20210229",), ("13/45/2020",), ("",), (None,)], "d string")
    assert [str(r[0]) for r in dates.select(enrich.parsed_date(F.col("d"))).collect()] == ["2020-02-29", "2020-02-29", "None", "None", "None", "None"]


def test_narratives_of_a_report_with_very_many_parts(spark):
    """The text is formed from a bounded set of parts, whatever their number."""
    rows = [(1, i, "d " if i % 3 else "N", None if i % 11 == 0 else "" if i % 7 == 0 else f"part {i} " * (i % 5)) for i in range(3000)]
    rows += [(2, 1, "D", "x" * 9000), (2, 2, "D", "(B)(4)"), (3, 1, "Q", "y"), (None, 1, "M", "z")]
    df = spark.createDataFrame(rows, "MDR_REPORT_KEY long, MDR_TEXT_KEY long, TEXT_TYPE_CODE string, FOI_TEXT string").repartition(5)
    assert build._beginnings(df, 4000).groupBy("MDR_REPORT_KEY").count().agg({"count": "max"}).first()[0] < 700
    got = {r["MDR_REPORT_KEY"]: r for r in build.narrative_summary(df).collect()}
    for key in (1, 2, 3, None):
        for kinds, column in (("D", "narrative_desc"), ("NM", "narrative_mfg")):
            parts = [t for k, _, kind, t in rows if k == key and kind.strip().upper() in kinds and t is not None]
            assert got[key][column] == (" || ".join(parts)[:4000] if parts else None)
    assert got[1]["narr_part_count"] == 3000 and got[2]["HAS_REDACTION_B4"] and not got[1]["HAS_REDACTION_B4"]


@pytest.mark.parametrize("chars", (6, 8, 10, 11))
def test_a_narrative_cut_within_a_separator_keeps_its_piece(spark, chars):
    rows = [(1, 1, "D", "abcdef"), (1, 2, "D", "gh"), (1, 3, "D", "i")]
    df = spark.createDataFrame(rows, "MDR_REPORT_KEY long, MDR_TEXT_KEY long, TEXT_TYPE_CODE string, FOI_TEXT string")
    assert build.narrative_summary(df, chars).first()["narrative_desc"] == "abcdef || gh || i"[:chars]


def test_a_mean_age_is_the_same_in_any_order(spark):
    ages = ["14 MO", "45", "43", "6", "47 MO", "3", "39", "35 MO"]
    orders = [ages[i:] + ages[:i] for i in range(8)] + [ages[::-1], sorted(ages)]
    rows = [(k, a, None, None) for k, order in enumerate(orders) for a in order] + [(98, "9" * 30, None, None), (98, "1", None, None), (99, "??", None, None)]
    df = spark.createDataFrame(rows, "MDR_REPORT_KEY int, PATIENT_AGE string, PATIENT_SEX string, SEQUENCE_NUMBER_OUTCOME string").coalesce(1)
    got = {r["MDR_REPORT_KEY"]: r["age_years_avg"] for r in build.patient_summary(df).collect()}
    assert got.pop(99) is None and got.pop(98) == 5e29 and set(got.values()) == {18.0}


def test_headed_files_are_as_many_as_the_tasks(spark, tmp_path):
    rows = spark.range(60).repartition(3).selectExpr("concat(id, '|\"a, b\"') as value")
    stored._named(Lens(spark, str(tmp_path)), rows, str(tmp_path / "raw"), "device2020", "KEY|NAME")
    texts = [p.read_text().splitlines() for p in (tmp_path / "raw").glob("device2020*.txt")]
    assert len(texts) == 3 and all(t[0] == "KEY|NAME" for t in texts) and sorted(x for t in texts for x in t[1:]) == sorted(f'{i}|"a, b"' for i in range(60))


def test_search_finds_rare_manufacturers(spark):
    makers = spark.range(4200).select(F.concat(F.lit("MAKER "), "id").alias("manufacturer"), F.explode(F.array(F.lit(1), F.lit(2))))
    rows = makers.select("manufacturer").union(spark.createDataFrame([("ZEBRA RARE",)], "manufacturer string")).selectExpr("manufacturer", "'M' as EVENT_TYPE", "2020 as report_year")
    assert search.manufacturer_index(rows, 1996).count() == 4000
    assert [r["manufacturer"] for r in search.manufacturer_search(search.manufacturer_index(rows, 1996, k=None), "zebra").collect()] == ["ZEBRA RARE"]


def test_csv_values_are_whole_and_manifest_has_years(spark, tmp_path):
    df = spark.createDataFrame([(1, 2019, "x" * 40_000), (2, 2021, "y")], "k long, report_year int, codes string").coalesce(1)
    publish.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).agg(F.max(F.length("codes"))).first()[0] == 40_000
    df.write.parquet(str(tmp_path / "years"))
    row = publish.manifest(spark, str(tmp_path / "years")).first()
    assert (row["rows"], row["first_year"], row["last_year"], row["schema_version"]) == (2, 2019, 2021, publish.SCHEMA_VERSION)


def test_years_before_the_first_folder_are_read(spark, tmp_path):
    years = [2005, 2010, 2012, 2014, 2016, None]
    df = spark.createDataFrame([(str(i), y, "A") for i, y in enumerate(years)], f"{KEY} string, report_year int, product_code string")
    publish.write_reports(df, str(tmp_path / "r"))
    for first, last in [(None, 2012), (2010, 2012), (2006, 2014), (2014, 2015), (2011, None), (2013, 2013), (None, 2000)]:
        got = sorted(r["report_year"] for r in pf.read_years(spark, str(tmp_path / "r"), first, last).collect())
        assert got == [y for y in years if y is not None and (first or 0) <= y <= (last or 9999)]


def test_null_groups_are_replaced(spark):
    old = spark.createDataFrame([(None, 5), (2014, 3)], "y int, n long")
    fresh = spark.createDataFrame([(None, 9)], "y int, n long")
    assert sorted(map(tuple, incremental.affected(old, fresh, ["y"]).collect()), key=str) == [(2014, 3), (None, 9)]


def test_absent_tables_are_errors(spark):
    one = spark.range(1)
    found = {r["detail"]: r["severity"] for r in checks.filled({"mdr": one, "extra": one.limit(0), "gone": None}).collect()}
    assert found == {"mdr": 0, "device": 2, "patient": 2, "narrative": 2, "reports": 2, "extra": 1, "gone": 1}


def test_first_device_of_keyless_rows(spark):
    rows = [(None, str(i), f"b{i}") for i in range(50)] + [("1", "10", "x"), ("1", "9", "y"), ("1", "odd", "a"), ("2", None, "only"), ("3", "odd", "b"), ("3", None, "z")]
    df = spark.createDataFrame(rows, f"{KEY} string, DEVICE_EVENT_KEY string, BRAND_NAME string").repartition(3)
    got = {r[KEY]: r["BRAND_NAME"] for r in build.first_device(df).collect()}
    assert got == {"1": "y", "2": "only", "3": "z"}
    assert {r[KEY]: r["BRAND_NAME"] for r in build.first_device(df, lexicographic=True).collect()}["1"] == "x"


def test_an_empty_query_finds_nothing(spark):
    df = spark.createDataFrame([(1, "pump stopped")], "k long, t string")
    assert text.bm25(df, "k", "t", "  ", 5).count() == 0 and text.bm25(df, "k", "t", "pump", 5).count() == 1


def test_screen_on_the_published_bridge(spark, tmp_path):
    """Equal to the screen with joins, and reads the row groups of one product code without a join of reports."""
    rows = [(str(i), 2010 + i % 9, f"P{i % 7}", i % 5) for i in range(4000)]
    reports = spark.createDataFrame(rows, f"{KEY} string, report_year int, product_code string, x int")
    pairs = spark.createDataFrame([(k, str(c)) for k, _, _, x in rows for c in {x, int(k) % 3}], f"{KEY} string, code string")
    terms = spark.createDataFrame([(str(i), f"term {i}") for i in range(5)], "FDA_CODE string, TERM string")
    publish.write_bridge(pairs, reports, str(tmp_path / "b"))
    bridge = spark.read.parquet(str(tmp_path / "b"))
    want = analyses.flat_screen(analyses.screen(F.col("product_code") == "P3", reports, pairs, terms, F.col("report_year") >= 2012))
    got = analyses.flat_screen(analyses.published_screen(bridge, publish.report_counts(reports), publish.code_counts(bridge), terms, "P3", 2012))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() >= 5
    mine = bridge.filter("pc = 'P3' and y >= 2012").groupBy("code").count()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(pc,P3)" in mine and "Join" not in mine
