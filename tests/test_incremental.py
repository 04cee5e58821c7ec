"""Loads of new files, amendments and refreshes, with what goes wrong on the way."""

import pytest
from pyspark.sql import functions as F

from vigil.operators import build
from vigil.operators.build import KEY
from vigil.sources import files
from vigil.sources import pipe_files as pf
from vigil.sources.folder import load_folder
from vigil.streaming import incremental


def test_fields_go_by_each_files_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, text: (tmp_path / "in" / name).write_text(text)
    run = lambda: incremental.load_new(spark, str(tmp_path / "in"), None, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    put("a.txt", "K|A|B\n1|a1|b1\n")
    put("b.txt", "K|B|A\n2|b2|a2\n")
    run()
    put("c.txt", "B|K|C\nb3|3|c3\n\n")
    put("empty.txt", "")
    run()
    run()
    rows = incremental.loaded(spark, str(tmp_path / "out"))
    got = sorted((r["K"], r["A"], r["B"], r["C"], r["batch"]) for r in rows.collect())
    assert got == [("1", "a1", "b1", None, 0), ("2", "a2", "b2", None, 0), ("3", None, "b3", "c3", 1)]
    assert {r["file"].rsplit("/", 1)[1] for r in rows.collect()} == {"a.txt", "b.txt", "c.txt"}


def test_wrapped_records_of_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("KEY|TEXT\n100001|one\n two\n100002|three\n")
    (tmp_path / "in" / "b.txt").write_text("TEXT_DATE|KEY|TEXT\n20200101|100003|x\n")  # no record starts with such a key
    (tmp_path / "in" / "c.txt").write_text("KEY|DAY|TEXT\n100004|d|four|five\nsix\n")
    incremental.load_new(spark, str(tmp_path / "in"), ["KEY", "TEXT"], str(tmp_path / "out"), str(tmp_path / "cp"), read=pf.read_narrative_files).awaitTermination()
    got = sorted((r["KEY"], r["TEXT"]) for r in incremental.loaded(spark, str(tmp_path / "out")).collect())
    assert got == [("100001", "one two"), ("100002", "three"), ("100003", "x"), ("100004", "four|five six")]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("K|S|V\n1|1|x\n1|2|y\n2|1|z\n")
    columns, keys = ["K", "S", "V"], ["K", "S"]
    run = lambda: incremental.amend(spark, str(tmp_path / "in"), keys, columns, str(tmp_path / "t"), str(tmp_path / "cp"), buckets=4).awaitTermination()
    table = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select(*columns).collect())
    run()
    (tmp_path / "in" / "b.txt").write_text("V|K|S\nnew|1|2\nmore|3|1\n")
    run()
    want = [("1", "1", "x"), ("1", "2", "new"), ("2", "1", "z"), ("3", "1", "more")]
    assert table() == want
    for f in (tmp_path / "cp" / "commits").iterdir():  # as if the last batch had failed after its write
        if f.name in ("1", ".1.crc"):
            f.unlink()
    run()
    assert table() == want


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("K|V\n" + "".join(f"{i}|x\n" for i in range(200)))
    run = lambda: incremental.amend(spark, str(tmp_path / "in"), ["K"], ["K", "V"], str(tmp_path / "t"), str(tmp_path / "cp"), buckets=16).awaitTermination()
    names = lambda: {(p.parent.name, p.name) for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    run()
    before = names()
    (tmp_path / "in" / "b.txt").write_text("K|V\n7|y\n")
    run()
    changed = {d for d, _ in names() ^ before}
    assert len(changed) == 1 and spark.read.parquet(str(tmp_path / "t")).count() == 200


def test_staged_partitions_survive_a_failure(spark, tmp_path):
    """What was staged whole is put in place, even if the table it was made from is half gone."""
    t, staged = str(tmp_path / "t"), str(tmp_path / "s")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "y int, v string").write.partitionBy("y").parquet(t)
    incremental.replace_partitions(spark.read.parquet(t).filter("y = 2").select("v", "y").withColumn("v", F.concat("v", F.lit("!"))), t, ["y"], staged)
    incremental.replace_partitions(spark.read.parquet(t).filter("y = 9").select("v", "y"), t, ["y"], staged)  # again: the staged rows
    assert sorted((r["y"], r["v"]) for r in spark.read.parquet(t).collect()) == [(1, "a"), (2, "b!"), (3, "c")]


@pytest.fixture
def store(spark, tmp_path):
    rows = [(str(i), 2018 + i % 4 if i < 40 else None, f"P{i % 3}") for i in range(44)]
    reports = spark.createDataFrame(rows, f"{KEY} string, report_year int, product_code string")
    problems = spark.createDataFrame([(str(i), str(c)) for i in range(40) for c in {i % 5, i % 2}], f"{KEY} string, PROBLEM_CODE string")
    made = incremental.Store(spark, str(tmp_path / "store"))
    made.create(reports.join(build.problem_list(problems, "patient_problem_codes"), KEY, "left"), problems)
    return made, reports, problems


def test_late_problems_touch_their_years(spark, store, tmp_path):
    made, reports, problems = store
    at = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store").glob("*/year_bucket=*/*.parquet")}
    before = at()
    late = spark.createDataFrame([("1", "77"), ("5", "1"), ("5", "88"), ("41", "77"), ("none", "9"), ("2", " ")], f"{KEY} string, PROBLEM_CODE string")
    assert made.add_patient_problems(late, str(tmp_path / "s1")) == [0, 2019]
    changed = {p for p in at().items() ^ before.items()}
    assert {p.split("year_bucket=")[1].split("/")[0] for p, _ in changed} == {"0", "2019"}
    whole = problems.unionByName(late.filter(f"{KEY} <> 'none'"))
    codes = lambda df: {(r[KEY], r["patient_problem_codes"]) for r in df.collect()}
    assert codes(made.table("reports")) == codes(reports.join(build.problem_list(whole, "patient_problem_codes"), KEY, "left"))
    pairs = build.bridge(whole).join(reports.select(KEY), KEY)
    assert {tuple(r) for r in made.totals().collect()} == {tuple(r) for r in build.problem_totals(pairs).collect()}
    assert {(r[KEY], r["code"]) for r in made.table("bridge").collect()} == {(r[KEY], r["code"]) for r in pairs.collect()}
    again = at()
    assert made.add_patient_problems(late.filter(f"{KEY} = 'none'"), str(tmp_path / "s2")) == [] and at() == again


def test_additive_rollups_merge(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else 2000 + i % 5, "DM"[i % 2], bool(i % 3), f"P{i % 4}") for i in range(300)], "report_year int, EVENT_TYPE string, flag boolean, product_code string")
    rows = rows.withColumns({"IS_RWD_SOURCED": F.col("flag"), "initial_report": ~F.col("flag"), "is_supplement": F.col("flag")})
    old, new = rows.limit(200), rows.exceptAll(rows.limit(200))
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert same(incremental.merged(build.yearly_events(old), build.yearly_events(new), ["report_year", "EVENT_TYPE"]), build.yearly_events(rows))
    by = lambda df: build.by_dimension(df, "product_code")
    assert same(incremental.merged(by(old), by(new), ["product_code"], least=("first_year",), most=("last_year",)), by(rows))


@pytest.mark.parametrize(
    ("name", "text", "role"),
    [
        ("mdrfoiThru2020.txt", "x", "mdr"), ("device2019.txt", "MDR_REPORT_KEY|BRAND_NAME\n", "device"), ("foitext.txt", "1|2\n", "narrative"), ("patientThru.txt", "a|b\n", "patient"),
        ("deviceproblemcodes.txt", "2682|Abdominal Pain\n2683|Other\n", "device_dictionary"), ("patientproblemdata.txt", "2682|Abdominal Pain\n", "patient_dictionary"),
        ("deviceproblemcodes.csv", '"FDA_CODE","TERM","NCIT_CODE","IMDRF_CODE"\n"1","x","C","A"\n', "device_dictionary"), ("patientproblemcode.csv", "FDA_CODE,TERM,NCIT_CODE\n1,x,C\n", "patient_dictionary"),
        ("patientproblemcode.txt", "MDR_REPORT_KEY|PATIENT_SEQUENCE_NO|PROBLEM_CODE|DATE_ADDED|DATE_CHANGED\n1|1|2|x|\n", "patient_problem"), ("problem3.txt", "700001|1|1802\n", "device_problem"),
        ("patientproblem3.txt", "700001|1|1802\n", "patient_problem"), ("foidevproblem.txt", "700001|1069\n", "device_problem"), ("somecodes.txt", "12|1069\n", "device_dictionary"),
        ("somecodes.txt", "12|1069\n" * 140_000, "device_problem"), ("devcodes.txt", "700001|1069\n" * 60_000, "device_problem"), ("devcodes.txt", "7|1069\n" * 90_000, "device_dictionary"),
        ("problem6.txt", "1|2|3|4|5|6\n", "unknown"), ("notes.txt", "hello\n", "unknown"), ("late.txt", "MDR_REPORT_KEY|EVENT_TYPE\n", "mdr"), ("problems.txt", "", "unknown"),
    ],
)
def test_roles_by_content(spark, tmp_path, name, text, role):
    (tmp_path / name).write_text(text)
    (row,) = pf.inventory(spark, str(tmp_path)).collect()
    assert row["role"] == role, row["because"]


def test_a_look_is_bounded_and_long_headers_are_whole(spark, tmp_path):
    names = [f"COLUMN_{i}" for i in range(600)]
    (tmp_path / "wide.txt").write_text("\n\n" + "|".join(names) + "\n" + "|".join("x" * 600) + "\n")
    assert len(files.head(spark, str(tmp_path / "wide.txt"))) == files.HEAD
    assert pf.header(spark, str(tmp_path / "wide.txt")) == names
    assert pf.read_pipe(spark, str(tmp_path / "wide.txt")).count() == 1
    assert pf.headers(spark, [str(tmp_path / "wide.txt")] * 2) == {str(tmp_path / "wide.txt"): names}


def test_odd_lines_are_kept_and_counted_in_one_pass(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "mdrfoi.txt").write_text("MDR_REPORT_KEY|EVENT_TYPE|DATE_RECEIVED\n1|D|20200101\n2|M\n3|D|20200101|more\n")
    (tmp_path / "raw" / "deviceproblemcodes.txt").write_text("2682|Abdominal Pain\n")
    found = load_folder(spark, str(tmp_path / "raw"), str(tmp_path / "staged"))
    assert found.counts == {"mdr": {"rows": 3, "odd": 2}}
    assert sorted((r["role"], r["line"]) for r in found.odd.collect()) == [("mdr", "2|M"), ("mdr", "3|D|20200101|more")]
    assert all("/staged/mdr/" in f for f in found.odd.inputFiles())
    assert sorted(r[KEY] for r in found.reports().collect()) == ["1", "2", "3"]
    assert [tuple(r) for r in found.device_dictionary.select("FDA_CODE", "TERM").collect()] == [("2682", "Abdominal Pain")] and found.device_problem.count() == 0
    assert pf.surplus_lines(spark, str(tmp_path / "raw" / "mdrfoi.txt")).count() == 2
