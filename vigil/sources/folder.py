"""A raw folder as the inputs of a build: files are told by role (S10) and read by their role's reader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigil.operators import build

from . import pipe_files as pf

#: The columns that the build reads of an input without files.
_EMPTY = {
    "device": ("DEVICE_EVENT_KEY",),
    "patient": ("PATIENT_AGE", "PATIENT_SEX", "SEQUENCE_NUMBER_OUTCOME"),
    "narrative": ("MDR_TEXT_KEY", "TEXT_TYPE_CODE", "FOI_TEXT"),
    "device_problem": ("PROBLEM_CODE",),
    "patient_problem": ("PROBLEM_CODE",),
    "device_dictionary": ("FDA_CODE", "TERM"),
    "patient_dictionary": ("FDA_CODE", "TERM"),
}


@dataclass
class Inputs:
    mdr: DataFrame
    device: DataFrame
    patient: DataFrame
    narrative: DataFrame
    device_problem: DataFrame
    patient_problem: DataFrame
    device_dictionary: DataFrame
    patient_dictionary: DataFrame
    #: S03, of a staged folder: (role, file, line) of lines with more or fewer fields than their header, and by role the
    #: rows and odd lines that were counted while they were staged.
    odd: DataFrame | None = None
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def reports(self) -> DataFrame:
        """B07 on the whole folder."""
        return build.compose(self.mdr, self.device, self.patient, self.narrative, self.device_problem, self.patient_problem)


def _united(read: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, list[str]], DataFrame]:
    return lambda spark, paths: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(spark, p) for p in paths])


_PIPED = ("mdr", "device", "patient")
_READERS = {
    **{role: pf.read_pipe_files for role in _PIPED}, "narrative": pf.read_narrative_files,
    "device_problem": _united(pf.read_problem_codes), "patient_problem": _united(pf.read_problem_codes),
    "device_dictionary": _united(pf.read_dictionary), "patient_dictionary": _united(pf.read_dictionary),
}


def _staged(spark: SparkSession, paths: list[str], out: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows, odd lines and their counts of pipe files that are read once and kept as a table in `out`."""
    seen = Observation()
    rows = pf.read_pipe_files(spark, paths, file="_file", odd="_odd")
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("_odd").alias("odd")).write.mode("overwrite").parquet(out)
    kept = spark.read.schema(rows.schema).parquet(out)
    return kept.drop("_file", "_odd"), kept.filter("_odd is not null").select(F.col("_file").alias("file"), F.col("_odd").alias("line")), seen.get


def load_folder(spark: SparkSession, folder: str, staged: str | None = None) -> Inputs:
    """All files of a folder by role. Reports must be there; any other input may be absent and is then empty.

    With a folder for staged tables the report, device and patient files are read once and kept there, their odd lines
    beside them and counted in the same pass.
    """
    paths: dict[str, list[str]] = {}
    for row in pf.inventory(spark, folder).orderBy("path").collect():  # a row a file
        paths.setdefault(row["role"], []).append(row["path"])
    if "mdr" not in paths:
        raise ValueError(f"no report files in {folder}")
    found, odd, counts = {}, [], {}
    for role, read in _READERS.items():
        if role not in paths:
            keys = () if role.endswith("dictionary") else (build.KEY,)
            found[role] = spark.createDataFrame([], ", ".join(f"{c} string" for c in (*keys, *_EMPTY[role])))
        elif staged and role in _PIPED:
            found[role], lines, counts[role] = _staged(spark, paths[role], f"{staged}/{role}")
            odd.append(lines.select(F.lit(role).alias("role"), "file", "line"))
        else:
            found[role] = read(spark, paths[role])
    strange = reduce(DataFrame.unionByName, odd) if odd else None
    return Inputs(**found | {"mdr": pf.typed_reports(found["mdr"])}, odd=strange, counts=counts)
