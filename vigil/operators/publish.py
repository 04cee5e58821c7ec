"""The published layout (P01-P08): partitioned, sorted Parquet, bridges, manifest and summary."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources import files

from .build import KEY, corpus_facts

FIRST_YEAR = 2014
SCHEMA_VERSION = 1
ROW_GROUP_BYTES = 16 << 20


def write_csv(reports: DataFrame, path: str) -> None:
    """Values are written whole."""
    flat = reports.drop(*[c for c, kind in reports.dtypes if kind.startswith(("array", "struct"))])
    flat.write.mode("overwrite").csv(path, header=True, escape='"')


def write_reports(reports: DataFrame, path: str, first_year: int = FIRST_YEAR) -> None:
    """One folder a year (earlier and undated ones share the first), sorted by product code and key,
    so that a query of one code skips all other row groups. Spark's commit replaces the table as a whole."""
    bucket = F.greatest(F.coalesce("report_year", F.lit(first_year - 1)), F.lit(first_year - 1))
    rows = reports.withColumn("year_bucket", bucket).drop("outcome_codes")
    # ranges of (year, code): a large year gets many files, a small one few
    spread = rows.repartitionByRange("year_bucket", "product_code", KEY)
    ordered = spread.sortWithinPartitions("year_bucket", F.asc_nulls_last("product_code"), KEY)
    ordered.write.mode("overwrite").partitionBy("year_bucket").option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def published_bridge(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """Pairs with their report's product code and year, which a pair's reader filters on; keys are kept as
    they are, and as an int where they are one."""
    facts = reports.select(KEY, F.col("product_code").alias("pc"), F.col("report_year").cast("short").alias("y"))
    return pairs.join(facts, KEY).select(KEY, F.col(KEY).cast("string").try_cast("int").alias("k"), "code", "pc", "y")


def write_bridge(pairs: DataFrame, reports: DataFrame, path: str) -> None:
    rows = published_bridge(pairs, reports)
    rows.repartitionByRange("pc", "y").sortWithinPartitions("pc", "y", "code", "k").write.mode("overwrite").option("compression", "zstd").parquet(path)


def report_counts(reports: DataFrame) -> DataFrame:
    """Reports by product code and year, the sizes that a screen on the bridge needs."""
    return reports.groupBy(F.col("product_code").alias("pc"), F.col("report_year").cast("short").alias("y")).agg(F.count("*").alias("n"))


def code_counts(bridge: DataFrame) -> DataFrame:
    """Reports by problem code and year."""
    return bridge.groupBy("code", "y").agg(F.count("*").alias("n"))


def write_small(df: DataFrame, path: str) -> None:
    """A dictionary or rollup, in one file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_narratives(parts: DataFrame, reports: DataFrame, path: str) -> None:
    """Untruncated narrative parts by year."""
    rows = parts.join(reports.select(KEY, F.coalesce("report_year", F.lit(0)).alias("year")), KEY)
    rows.repartitionByRange("year", KEY).sortWithinPartitions("year", KEY).write.mode("overwrite").partitionBy("year").parquet(path)


#: Bytes of a file that a task holds while it hashes it.
CHUNK = 8 << 20


def _spelt(path):
    """The readers spell local paths with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the Parquet files below a path. A task reads a file of any size chunk by chunk; only a store
    that pyarrow cannot open is hashed from whole contents."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    found = listing.select("path", F.col("length").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                sha = hashlib.sha256()
                try:
                    store, at = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                    with store.open_input_stream(at) as stream:
                        while part := stream.read(CHUNK):
                            sha.update(part)
                    out.append(sha.hexdigest())
                except (ImportError, NotImplementedError, pa.ArrowInvalid, OSError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["path", "bytes", "sha256"])

    sums = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, "path string, bytes long, sha256 string")
    whole = listing.select("path", F.sha2("content", 256).alias("whole"))
    if sums.filter("sha256 is null").take(1):
        sums = sums.join(whole, "path").withColumn("sha256", F.coalesce("sha256", "whole"))
    return sums.select(_spelt("path").alias("file"), "bytes", "sha256")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, bytes, sha256, first and last report_year, schema version) of each Parquet file below a path;
    the years are null where the files have none."""
    table = spark.read.parquet(path)
    year = F.col("report_year").cast("int") if "report_year" in table.columns else F.lit(None).cast("int")
    undated = F.count_if(year.isNull()) if "report_year" in table.columns else F.lit(0)
    rows = table.groupBy(_spelt("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), undated.cast("long").alias("undated"))
    return file_sums(spark, path).join(rows, "file", "left").withColumns({"rows": F.coalesce("rows", F.lit(0)), "undated": F.coalesce("undated", F.lit(0)), "schema_version": F.lit(SCHEMA_VERSION)})


def publish(spark: SparkSession, root: str, tables: dict[str, Callable[[str], None]]) -> str:
    """A new version of all tables, each written by its function to the folder it is given. The version is listed,
    read again and compared with its list; only then do readers see it (`current`). What fails leaves the version
    before in its place. Returns the version's name."""
    versions = [f.rsplit("/", 1)[-1] for f in files.folders(spark, f"{root}/versions")]
    name = f"{max([int(v) for v in versions if v.isdigit()], default=0) + 1:06d}"
    folder = f"{root}/versions/{name}"
    for table, write in tables.items():
        write(f"{folder}/tables/{table}")
    listed = [manifest(spark, f"{folder}/tables/{t}").withColumn("table", F.lit(t)) for t in tables]
    reduce(DataFrame.unionByName, listed).write.parquet(f"{folder}/manifest")
    wrong = verify(spark, folder)
    if wrong.take(1):
        raise ValueError(f"{folder} is not as its manifest says: {wrong.first()}")
    files.write_small(spark, f"{root}/CURRENT", name)
    return name


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(file, problem): files of a version that its manifest lacks, that are gone, or that are not as listed."""
    listed = spark.read.parquet(f"{folder}/manifest").select("file", F.col("bytes").alias("bytes_"), F.col("sha256").alias("sha256_"))
    both = file_sums(spark, f"{folder}/tables").join(listed, "file", "full")
    problem = (
        F.when(F.col("sha256_").isNull(), "not listed").when(F.col("sha256").isNull(), "gone")
        .when((F.col("bytes") != F.col("bytes_")) | (F.col("sha256") != F.col("sha256_")), "changed")
    )
    return both.select("file", problem.alias("problem")).filter("problem is not null")


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that readers see."""
    name = files.read_small(spark, f"{root}/CURRENT")
    return f"{root}/versions/{name}" if name else None


def read_published(spark: SparkSession, root: str, table: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A table of the current version; with years, of those files alone whose rows, by the manifest, may be within them.
    No other file is opened or even listed."""
    folder = current(spark, root)
    if folder is None:
        raise ValueError(f"nothing is published in {root}")
    if first is None and last is None:
        return spark.read.parquet(f"{folder}/tables/{table}")
    low, high = (-(1 << 31) if first is None else first), ((1 << 31) - 1 if last is None else last)
    listed = spark.read.parquet(f"{folder}/manifest").filter((F.col("table") == table) & (F.col("rows") > 0))
    chosen = [r["file"] for r in listed.filter((F.col("first_year") <= high) & (F.col("last_year") >= low)).select("file").collect()]  # a row a file
    within = F.col("report_year").between(low, high)
    if not chosen:
        return spark.read.parquet(f"{folder}/tables/{table}").filter(within).limit(0)
    return spark.read.option("basePath", f"{folder}/tables/{table}").parquet(*chosen).filter(within)


def summary(reports: DataFrame, eligible_from: int) -> DataFrame:
    """Corpus facts with the counts by year, one row."""
    years = reports.filter("report_year is not null").groupBy("report_year").agg(F.count("*").alias("n"))
    listed = years.agg(F.sort_array(F.collect_list(F.struct("report_year", "n"))).alias("by_year"))
    return corpus_facts(reports, eligible_from).join(F.broadcast(listed))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
