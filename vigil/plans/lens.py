"""The driver's order tables seen as report tables.

An order is a report, its lines are devices and patients, part sizes are problem codes, conversations are
narrative parts. Raw text fields (dates, ages, flags) are formed here so that the parsing operators have
work to do. Every expression has its twin in `queries.LENS`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import build
from vigil.operators.build import KEY
from vigil.sources.pipe_files import typed_reports

ELIGIBLE_FROM = 1996


def _pick(number, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


@dataclass
class Lens:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def mdr(self) -> DataFrame:
        key = F.col("o_orderkey")
        orders = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        orders = orders.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        facts = self.lines.groupBy(F.col("l_orderkey").alias(KEY)).agg(
            F.date_format(F.min("l_shipdate"), "yyyyMMdd").alias("DATE_OF_EVENT"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("SOURCE_TYPE")
        )
        day = F.col("o_orderdate")
        raw = orders.select(
            key.alias(KEY),
            F.concat(F.when(F.col("o_custkey") % 10 == 0, "RWD-").otherwise("R-"), F.col("o_custkey").cast("string")).alias("REPORT_NUMBER"),
            F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "IN").otherwise("M").alias("EVENT_TYPE"),
            F.when(key % 2 == 0, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "MM/dd/yyyy")).alias("DATE_RECEIVED"),
            F.substring("o_orderpriority", 1, 1).alias("REPORTER_OCCUPATION_CODE"),
            F.lower("n_name").alias("REPORTER_COUNTRY_CODE"),
            _pick(key, "0", "1", "", "0", "0", "2", " 0 ").alias("SUPPLEMENT_NUMBER"),
            F.when(F.col("o_totalprice") > 150000, "y").otherwise("N").alias("ADVERSE_EVENT_FLAG"),
        )
        return typed_reports(raw.join(facts, KEY, "left"))

    def _shown(self, rows: DataFrame, part: bool = True, supplier: bool = True) -> DataFrame:
        """Lines as devices, with the columns of their part, of their supplier or of both."""
        out = [F.col("l_orderkey").alias(KEY), F.col("l_linenumber").alias("DEVICE_EVENT_KEY"), *[c for c in rows.columns if c not in ("l_orderkey", "l_linenumber")]]
        if part:
            rows, size = rows.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")), F.col("p_size")
            out += [
                F.col("p_name").alias("BRAND_NAME"), F.col("p_type").alias("GENERIC_NAME"), F.col("p_type").alias("MODEL_NUMBER"), F.col("p_brand").alias("DEVICE_REPORT_PRODUCT_CODE"),
                F.concat(size.cast("string"), F.lit(" "), _pick(size, "YR", "mo", "WK", "DY", "HR", "DEC")).alias("DEVICE_AGE_TEXT"),
                F.when(size % 3 == 0, "Y").otherwise("N").alias("IMPLANT_FLAG"),
            ]
        if supplier:
            rows = rows.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            out.append(F.col("s_name").alias("MANUFACTURER_D_NAME"))
        return rows.select(*out)

    @cached_property
    def device(self) -> DataFrame:
        return self._shown(self.lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"))

    def first(self, *columns: str) -> DataFrame:
        """The devices that come first in their report, with all columns or those that these report columns are made of.

        Part and supplier settle what a device shows, so lines are ranked by these numbers alone, among those whose part and
        supplier exist, and only the first of each report meets the wide tables.
        """
        rows = self.lines.select(F.col("l_orderkey").alias(KEY), F.col("l_linenumber").alias("DEVICE_EVENT_KEY"), "l_partkey", "l_suppkey")
        for table, own, key in (("part", "p_partkey", "l_partkey"), ("supplier", "s_suppkey", "l_suppkey")):
            rows = rows.join(self.table(table).select(own), F.col(key) == F.col(own), "left_semi")
        rows = build.first_device(rows).withColumnsRenamed({KEY: "l_orderkey", "DEVICE_EVENT_KEY": "l_linenumber"})
        wanted = build.FROM_DEVICE & set(columns)
        return self._shown(rows, part=not wanted or wanted != {"manufacturer"}, supplier=not wanted or "manufacturer" in wanted)

    @cached_property
    def patient(self) -> DataFrame:
        q = F.col("l_quantity")
        outcome = F.when(q >= 49, "D").when(q >= 47, "L").when(q >= 44, "H").when(q >= 42, "S").when(q >= 41, "C").when(q >= 36, "R").when(q >= 31, "O")
        return self.lines.select(
            F.col("l_orderkey").alias(KEY), F.concat(q.cast("int").cast("string"), F.lit(" "), _pick(F.col("l_linenumber"), "YR", "", "MO", "DEC", "??")).alias("PATIENT_AGE"),
            _pick(F.col("l_suppkey"), "F", "M", "", "f").alias("PATIENT_SEX"), outcome.alias("SEQUENCE_NUMBER_OUTCOME"),
        )

    @cached_property
    def device_problem(self) -> DataFrame:
        rows = self.lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(F.col("l_orderkey").alias(KEY), F.col("p_size").cast("string").alias("PROBLEM_CODE"))

    @cached_property
    def patient_problem(self) -> DataFrame:
        return self.lines.select(F.col("l_orderkey").alias(KEY), F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("PROBLEM_CODE"))

    @cached_property
    def narrative(self) -> DataFrame:
        kind = F.when(F.col("role") == "user", "D").when(F.col("role") == "assistant", "N").otherwise("M")
        return self.table("conversations").select(F.col("conv_id").alias(KEY), F.col("turn").alias("MDR_TEXT_KEY"), kind.alias("TEXT_TYPE_CODE"), F.col("text").alias("FOI_TEXT"))

    @cached_property
    def dictionary(self) -> DataFrame:
        rows = self.table("part").groupBy("p_size").agg(F.min("p_type").alias("TERM"))
        return rows.filter("p_size % 10 <> 0").select(F.col("p_size").cast("string").alias("FDA_CODE"), "TERM")

    @cached_property
    def reports(self) -> DataFrame:
        return build.compose(self.mdr, self.device, self.patient, self.narrative, self.device_problem, self.patient_problem, first=self.first())

    def some(self, *columns: str) -> DataFrame:
        """Reports with the key, date, year and these columns, composed from the inputs that supply them."""
        first = self.first(*columns) if not columns or build.FROM_DEVICE & set(columns) else None
        return build.compose(self.mdr, self.device, self.patient, self.narrative, self.device_problem, self.patient_problem, columns, first)

    @cached_property
    def pairs(self) -> DataFrame:
        return build.bridge(self.device_problem)
