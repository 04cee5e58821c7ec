"""Incremental loads (I01-I03): Structured Streaming's file source hands over each file once, and what late files touch is
rewritten by partition.

Every batch may be run again after a failure. A load writes its rows into a partition of its own number; a change of
existing partitions is first written whole beside the table and then put in their place, from there again if need be.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from vigil.operators import build
from vigil.operators.build import KEY
from vigil.sources import files
from vigil.sources.pipe_files import read_pipe_files

_LISTED = "path string, modificationTime timestamp, length long, content binary"
BUCKETS = 64


def new_files(spark: SparkSession, folder: str, checkpoint: str, take: Callable[[list[str], int], None], glob: str = "*.txt", most: int | None = None) -> StreamingQuery:
    """Calls `take(paths, batch)` with files that no earlier batch had; contents are not read for it."""
    stream = spark.readStream.format("binaryFile").schema(_LISTED).option("pathGlobFilter", glob)
    if most:
        stream = stream.option("maxFilesPerTrigger", most)

    def each(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").collect())  # a row a file
        if paths:
            take(paths, number)

    return stream.load(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_new(
    spark: SparkSession, folder: str, names: list[str] | None, out: str, checkpoint: str, glob: str = "*.txt",
    read: Callable[..., DataFrame] = read_pipe_files, most: int | None = None,
) -> StreamingQuery:
    """Append the rows of files not seen before, with the columns `file` and `batch`.

    Fields go by each file's own header, whatever the order of its columns; files of one header are one scan. `names`
    are the columns to keep, null where a file has none of that name, or None for all, which `loaded` unites.
    `read_narrative_files` as `read` puts wrapped records together.
    """

    def take(paths: list[str], number: int) -> None:
        rows = read(spark, paths, file="file")
        if names is not None:
            has = {c.upper(): c for c in rows.columns}
            rows = rows.select(*[(F.col(f"`{has[n.upper()]}`") if n.upper() in has else F.lit(None).cast("string")).alias(n) for n in names], "file")
        rows = rows.withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return new_files(spark, folder, checkpoint, take, glob, most)


def loaded(spark: SparkSession, out: str) -> DataFrame:
    """All rows of a load, columns united over the batches."""
    return spark.read.option("mergeSchema", "true").parquet(out)


def replace_partitions(df: DataFrame, path: str, by: list[str], staged: str) -> None:
    """Puts the partitions of `df` in the place of those of the same values; others keep their files. `df` may read from
    the table. If `staged` is whole already, from a run that failed later, it is used as it is."""
    spark = df.sparkSession
    if not files.exists(spark, f"{staged}/_SUCCESS"):
        df.write.mode("overwrite").partitionBy(*by).parquet(staged)
    if not [f for f in files.listed(spark, f"{staged}/*")]:
        return  # no rows
    ready = spark.read.schema(df.schema).parquet(staged)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """I02, option: of amended rows, the last by `order` for each key."""
    others = [c for c in rows.columns if c not in (*keys, order)]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order), *others))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def amend(
    spark: SparkSession, folder: str, keys: list[str], columns: list[str], table: str, checkpoint: str, glob: str = "*.txt",
    buckets: int = BUCKETS, most: int | None = None,
) -> StreamingQuery:
    """A table of the latest row of each key. A file's rows replace those of files handed over before it, later
    names those of earlier ones in a batch; only the buckets of the keys that occur are rewritten.

    The table has `columns`, `version` (batch and file, what `latest` goes by) and `bucket`. A batch that runs again
    finds its own rows there, no older than themselves, and changes nothing.
    """

    def take(paths: list[str], number: int) -> None:
        rows = read_pipe_files(spark, paths, file="_file")
        version = F.format_string("%012d %s", F.lit(number), F.element_at(F.split("_file", "/"), -1))
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        named = [(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in columns]
        rows = rows.select(*named, version.alias("version")).withColumn("bucket", bucket)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        if files.exists(spark, table):
            rows = spark.read.schema(rows.schema).parquet(table).filter(F.col("bucket").isin(touched)).unionByName(rows)
        staged = f"{checkpoint}/staged-{number}"
        replace_partitions(latest(rows, keys, "version"), table, ["bucket"], staged)

    query = new_files(spark, folder, checkpoint, take, glob, most)
    return query


def unseen(found: DataFrame, log: DataFrame) -> DataFrame:
    """I01 in batch: listed files (path, length, modificationTime) that the load log lacks as they now are."""
    return found.join(log, ["path", "length", "modificationTime"], "left_anti")


def affected(rollup: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """A rollup with the groups that `fresh` has recomputed replaced; null is a group like any other."""
    new = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rollup.join(new, same, "left_anti").unionByName(fresh)


def merged(rollup: DataFrame, delta: DataFrame, keys: list[str], least: tuple[str, ...] = (), most: tuple[str, ...] = ()) -> DataFrame:
    """An additive rollup with that of the new rows: counts add up, `least` and `most` keep their bounds."""
    rows = rollup.unionByName(delta)
    merge = {c: F.min(c) if c in least else F.max(c) if c in most else F.sum(c) for c in rows.columns if c not in keys}
    return rows.groupBy(*keys).agg(*[f.alias(c) for c, f in merge.items()]).select(rollup.columns)


class Store:
    """Published reports with what hangs on their patient problems, all by `year_bucket`: `reports`, `bridge` (pairs) and
    `totals` (reports by code, to be summed over the years), so that a late file rewrites the years it touches alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def totals(self) -> DataFrame:
        """R07 from the years' counts; a report is of one year."""
        return self.table("totals").groupBy("code").agg(F.sum("n_reports").alias("n_reports"))

    def create(self, reports: DataFrame, patient_problem: DataFrame) -> None:
        rows = reports.drop("outcome_codes").withColumn("year_bucket", F.coalesce("report_year", F.lit(0)))
        rows.repartitionByRange("year_bucket", KEY).sortWithinPartitions("year_bucket", KEY).write.mode("error").partitionBy("year_bucket").parquet(self.path("reports"))
        pairs = build.bridge(patient_problem).join(rows.select(KEY, "year_bucket"), KEY)
        self._write(pairs, "bridge")
        self._write(self._count(self.table("bridge")), "totals")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.repartition("year_bucket").write.mode("error").partitionBy("year_bucket").parquet(self.path(name))

    @staticmethod
    def _count(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("year_bucket", "code").agg(F.count("*").alias("n_reports"))

    def add_patient_problems(self, late: DataFrame, staged: str) -> list[int]:
        """The rows of late problem files join those that are there. Returns the years that were rewritten.

        Reads the keys of all reports, then the affected years alone. Pairs that are there already change nothing.
        """
        pairs = build.bridge(late).join(self.table("reports").select(KEY, "year_bucket"), KEY)
        years = sorted(r[0] for r in pairs.select("year_bucket").distinct().collect())  # a row a year
        if not years:
            return []
        within = F.col("year_bucket").isin(years)
        whole = self.table("bridge").filter(within).select(KEY, "code", "year_bucket").unionByName(pairs).distinct()
        replace_partitions(whole, self.path("bridge"), ["year_bucket"], f"{staged}/bridge")
        now = self.table("bridge").filter(within)
        replace_partitions(self._count(now), self.path("totals"), ["year_bucket"], f"{staged}/totals")
        lists = build.problem_list(now.withColumnRenamed("code", "PROBLEM_CODE"), "patient_problem_codes")
        old = self.table("reports").filter(within)
        fresh = old.drop("patient_problem_codes").join(lists, KEY, "left").select(old.columns)
        replace_partitions(fresh.repartitionByRange("year_bucket", KEY).sortWithinPartitions("year_bucket", KEY), self.path("reports"), ["year_bucket"], f"{staged}/reports")
        return years

    def watch(self, folder: str, read: Callable[[SparkSession, str], DataFrame], checkpoint: str, glob: str = "*.txt") -> StreamingQuery:
        """Adds each problem file that comes into the folder, once."""

        def take(paths: list[str], number: int) -> None:
            late = reduce(DataFrame.unionByName, [read(self.spark, p) for p in paths])
            self.add_patient_problems(late, f"{checkpoint}/staged-{number}")

        return new_files(self.spark, folder, checkpoint, take, glob)
