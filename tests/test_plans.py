"""Plans: what must reach the scan, and what must stay out of Python."""

import os

from pyspark.sql import functions as F

from vigil.operators import analyses, build, publish, text
from vigil.operators.build import KEY
from vigil.operators.cohort import Cohort, eligible
from vigil.plans import queries
from vigil.plans.lens import ELIGIBLE_FROM, Lens
from vigil.sources.pipe_files import read_years

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_screen_stays_in_the_jvm(spark):
    x = Lens(spark, FOLDER)
    reports = x.reports
    screen = analyses.flat_screen(analyses.screen(Cohort(product_code="Brand#2").of(reports), reports, x.pairs, x.dictionary, eligible(ELIGIBLE_FROM)))
    assert "Python" not in plan(screen) and "Pandas" not in plan(screen) and "CartesianProduct" not in plan(screen)


def test_predicate_and_table_cohorts_agree(spark):
    x, brand, old = Lens(spark, FOLDER), Cohort(product_code="Brand#2"), eligible(ELIGIBLE_FROM)
    rows = x.some("product_code")
    for by, inside in (((), brand.column()), (("product_code",), F.col("product_code").isNotNull())):
        one, two = (analyses.flat_screen(analyses.screen(c, rows, x.pairs, x.dictionary, old, by=by), by) for c in (inside, rows.filter(inside)))
        found = [sorted(map(tuple, s.collect()), key=repr) for s in (one, two)]
        assert found[0] and found[0] == found[1]


def test_unused_inputs_are_not_read(spark):
    x = Lens(spark, FOLDER)
    text = plan(analyses.event_types(x.reports)).split("== Physical Plan ==")[1]
    assert "o_totalprice" not in text and "FOI_TEXT" not in text
    some = plan(analyses.event_types(x.some("EVENT_TYPE"))).split("== Physical Plan ==")[1]
    assert "conv_id" not in some and "p_partkey" not in some


def test_year_folders_are_pruned(spark, tmp_path):
    x = Lens(spark, FOLDER)
    publish.write_reports(x.reports, str(tmp_path / "r"), first_year=1995)
    one = read_years(spark, str(tmp_path / "r"), 1997, 1997).filter("product_code = 'BRAND#2'")
    text = plan(one)
    assert "PartitionFilters: [isnotnull(year_bucket" in text and "PushedFilters" in text and "product_code" in text.split("PushedFilters")[1]
    assert one.count() == x.reports.filter("report_year = 1997 and product_code = 'BRAND#2'").count()


def test_lines_are_ranked_before_they_meet_the_wide_tables(spark):
    makers = plan(Lens(spark, FOLDER).some("manufacturer", "EVENT_TYPE")).split("== Physical Plan ==")[1]
    assert "s_name" in makers and "p_name" not in makers and "l_extendedprice" not in makers
    years = plan(queries.QUERIES["cohort_years_events"](spark, FOLDER)).split("== Physical Plan ==")[1]
    assert "o_orderkey" in years and "l_orderkey" not in years


def test_first_devices_where_parts_are_missing_or_twofold(spark):
    class Odd(Lens):
        def table(self, name):
            rows = super().table(name)
            if name == "part":
                return rows.filter("p_partkey % 3 <> 0").union(rows.filter("p_partkey % 5 = 0").withColumn("p_name", F.concat(F.lit("a "), "p_name")))
            return rows.filter("s_suppkey <> 1") if name == "supplier" else rows

    x, shown = Odd(spark, FOLDER), (KEY, "DEVICE_EVENT_KEY", "l_partkey", "l_suppkey", "BRAND_NAME", "MANUFACTURER_D_NAME", "DEVICE_AGE_TEXT")
    few, all_lines = (sorted(map(tuple, build.first_device(d).select(*shown).collect())) for d in (x.first(), x.device))
    assert few and few == all_lines


def test_phrases_take_words_by_place(spark):
    df = spark.createDataFrame([("pump alarm pump alarm",), ("pump",), ("",), (None,), ("Alarm, pump!",)], "t string")
    counts = text.counted(df, "t", (2, 3))
    assert {(r["term"], r["n_words"]): r["n"] for r in counts.collect()} == {("pump alarm", 2): 2, ("alarm pump", 2): 2, ("pump alarm pump", 3): 1, ("alarm pump alarm", 3): 1}
    assert "slice(" not in counts._jdf.queryExecution().optimizedPlan().toString()  # a pass over the whole text for each run
