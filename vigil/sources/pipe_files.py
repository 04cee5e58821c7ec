"""Readers of the ragged pipe-delimited distributions.

Lines are read by Spark's text source; its bytes are decoded as Latin-1 and split by expressions, so files
of any size are read in splits and nothing is rewritten first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.functions import enrich

from . import files

_BOM = "^(\\u00EF\\u00BB\\u00BF|\\uFEFF)"

#: The spellings under which problem-code files name their columns.
PROBLEM_COLUMNS = {
    "MDR_REPORT_KEY": ("MDR_REPORT_KEY", "REPORT_KEY"),
    "PROBLEM_CODE": ("PROBLEM_CODE", "PATIENT_PROBLEM_CODE", "DEVICE_PROBLEM_CODE", "FDA_CODE"),
    "PATIENT_SEQUENCE_NUMBER": ("PATIENT_SEQUENCE_NUMBER", "PATIENT_SEQUENCE_NO", "SEQUENCE_NUMBER"),
    "DATE_ADDED": ("DATE_ADDED",),
    "DATE_CHANGED": ("DATE_CHANGED",),
}
#: Name patterns by role.
ROLE_GLOBS = {
    "mdr": "mdrfoi*.txt",
    "device": "device[0-9]*.txt",
    "narrative": "foitext*.txt",
    "patient": "patient[!p]*.txt",
    "device_problem": "foidevproblem*.txt",
    "patient_problem": "patientproblemcode*.txt",
}


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, file, block, at): decoded lines; (file, block, at) keeps the order within a file.

    The text source keeps a line's raw bytes, so decoding them afterwards is exact.
    """
    rows = spark.read.text(paths).select(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    return rows.withColumn("line", F.regexp_replace(F.regexp_replace("line", _BOM, ""), "\\t", "|"))


def fields(line: Column, n: int) -> Column:
    """N trimmed fields; missing ones are blank, surplus ones stay in the last."""
    parts = F.split(line, "\\|", n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.trim(F.coalesce(F.get(parts, i), F.lit(""))))


def named(names: list[str]) -> list[Column]:
    """The fields in column `f` as columns; a blank field is null."""
    return [F.nullif(F.col("f")[i], F.lit("")).alias(name) for i, name in enumerate(names)]


def _first_line(text: str) -> str | None:
    """The first filled line of a file's beginning; None if it may go on behind it."""
    text = text.removeprefix("\u00ef\u00bb\u00bf").removeprefix("\ufeff")
    at = next((i for i, x in enumerate(text.split("\n")) if x.strip()), None)
    if at is None or (len(text) >= files.HEAD - 3 and at == text.count("\n")):
        return None
    return text.split("\n")[at].strip("\r").replace("\t", "|")


def headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The field names of each file's first filled line, from a bounded look at all of them."""
    out = {}
    for path, text in files.heads(spark, paths).items():
        line = _first_line(text)
        if line is None and len(text) >= files.HEAD - 3:  # blank lines or a line beyond the look
            first = lines(spark, path).filter(F.trim("line") != "").select("line").first()
            line = first and first[0]
        out[path] = [] if line is None else [x.strip() for x in line.split("|")]
    return out


def header(spark: SparkSession, path: str) -> list[str]:
    return headers(spark, [path])[path]


def read_pipe(spark: SparkSession, path: str | list[str], names: list[str] | None = None, file: str | None = None, odd: str | None = None) -> DataFrame:
    """Files of one header as text columns. Blank lines are dropped, the header line too if it names them.

    `file` and `odd` name two more columns: the file a row is from, and its line as it was if it has more or fewer
    fields than the header (null otherwise), so that what was folded or padded can be looked up.
    """
    own = names or header(spark, path if isinstance(path, str) else path[0])
    rows = lines(spark, path).filter(F.trim("line") != "").withColumn("f", fields(F.col("line"), len(own)))
    if names is None:
        rows = rows.filter(F.col("f") != F.array(*[F.lit(x) for x in own]))
    more = [F.col("file").alias(file)] if file else []
    if odd:
        more.append(F.when(F.size(F.split("line", "\\|", -1)) != len(own), F.col("line")).alias(odd))
    return rows.select(*named(own), *more)


def by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Paths by their header; files without a filled line are left out."""
    out: dict[tuple[str, ...], list[str]] = {}
    for path, names in headers(spark, paths).items():
        if names:
            out.setdefault(tuple(names), []).append(path)
    return out


def read_pipe_files(spark: SparkSession, paths: list[str], file: str | None = None, odd: str | None = None) -> DataFrame:
    """Files united by column name; files of one header are one scan."""
    parts = [read_pipe(spark, group, file=file, odd=odd) for group in by_header(spark, paths).values()]
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (file, odd) if c) or "line string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def surplus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with more or fewer fields than the header, for the record: (line, n_fields, expected)."""
    n = len(header(spark, path))
    count = F.size(F.split("line", "\\|", -1))
    return lines(spark, path).filter((F.trim("line") != "") & (count != n)).select("line", count.alias("n_fields"), F.lit(n).alias("expected"))


def reassemble(rows: DataFrame, start: Column) -> DataFrame:
    """(file, text) from lines, each record from one starting line up to the next, joined by a blank.

    Starts are counted in each block and summed over the blocks before it, so that no window is larger than
    a split. Lines before a file's first start are dropped.
    """
    rows = rows.withColumn("is_start", F.when(start, 1).otherwise(0))
    blocks = rows.groupBy("file", "block").agg(F.sum("is_start").alias("starts"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("starts").over(earlier), F.lit(0))).drop("starts")
    inside = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("own", F.sum("is_start").over(inside)).join(blocks, ["file", "block"])
    numbered = numbered.withColumn("record", F.col("before") + F.col("own")).filter("record > 0")
    pieces = F.sort_array(F.collect_list(F.struct("block", "at", F.trim("line").alias("line"))))
    return numbered.groupBy("file", "record").agg(F.array_join(F.transform(pieces, lambda x: x["line"]), " ").alias("text"))


def read_narratives(spark: SparkSession, path: str | list[str], file: str | None = None) -> DataFrame:
    """Wrapped narrative records of files of one header as rows; a record starts with its numeric key."""
    names = header(spark, path if isinstance(path, str) else path[0])
    rows = lines(spark, path).withColumn("line", F.regexp_replace("line", "\\r", "")).filter(F.trim("line") != "")
    whole = reassemble(rows, F.col("line").rlike("^[0-9]{4,12}\\|")).withColumn("f", fields(F.col("text"), len(names)))
    return whole.select(*named(names), *([F.col("file").alias(file)] if file else []))


def read_narrative_files(spark: SparkSession, paths: list[str], file: str | None = None) -> DataFrame:
    """Narrative files united by column name."""
    parts = [read_narratives(spark, group, file) for group in by_header(spark, paths).values()]
    if not parts:
        return spark.createDataFrame([], f"{file or 'line'} string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_problem_codes(spark: SparkSession, path: str) -> DataFrame:
    """(MDR_REPORT_KEY, PATIENT_SEQUENCE_NUMBER, PROBLEM_CODE, DATE_ADDED, DATE_CHANGED) from any known
    layout: with a header, or without in 2 columns (key, code) or 3 (key, sequence, code)."""
    first = header(spark, path)
    wanted = list(PROBLEM_COLUMNS)
    if first and first[0] and not first[0].isdigit():
        rows, upper = read_pipe(spark, path), {x.upper(): x for x in first}
        found = {w: next((upper[s] for s in spellings if s in upper), None) for w, spellings in PROBLEM_COLUMNS.items()}
    elif len(first) in (2, 3):
        found = dict(zip(["MDR_REPORT_KEY", "PATIENT_SEQUENCE_NUMBER", "PROBLEM_CODE"], ["k", "s", "c"], strict=True))
        rows = read_pipe(spark, path, ["k", "c"] if len(first) == 2 else ["k", "s", "c"])
        if len(first) == 2:
            found.pop("PATIENT_SEQUENCE_NUMBER")
    else:
        raise ValueError(f"unknown problem-code layout with {len(first)} columns")
    if not found.get("MDR_REPORT_KEY") or not found.get("PROBLEM_CODE"):
        raise ValueError(f"no key or code column among {first}")
    out = rows.select(*[(F.col(found[w]) if found.get(w) else F.lit(None).cast("string")).alias(w) for w in wanted])
    return out.filter((F.trim("MDR_REPORT_KEY") != "") & (F.trim("PROBLEM_CODE") != ""))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A code dictionary: quoted with a header, its lines quoted whole, or headerless pairs of code and term."""
    names = ["FDA_CODE", "TERM", "NCIT_CODE", "IMDRF_CODE"]
    first = _first_line(files.head(spark, path)) or ""
    if "FDA_CODE" not in first.upper():
        rows = read_pipe(spark, path, names) if "|" in first else spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), quote='"', escape='"')
    else:
        rows = spark.read.csv(path, header=True, quote='"', escape='"', sep="|" if "|" in first else ",")
        if len(rows.columns) == 1:
            parts = F.split(F.col(f"`{rows.columns[0]}`"), ",")
            rows = rows.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])
        else:
            rows = rows.toDF(*[c.strip().upper() for c in rows.columns])
    out = [F.trim(n).alias(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names]
    return rows.select(*out).filter(F.col("FDA_CODE") != "")


def delimiter(spark: SparkSession, path: str) -> str:
    """A comma only if the first two lines have one and no pipe."""
    first = [x for x in files.head(spark, path).split("\n")[:2]]
    return "," if any("," in x for x in first) and not any("|" in x for x in first) else "|"


#: A headerless pair of numbers is data above the first size and a dictionary below the second.
DATA_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 19
KEY_LENGTH = 6


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, delimiter, columns, role, because) of each text or csv file of a folder, from its name, its
    size and the first `files.HEAD` bytes, whatever its size.

    Reports, devices, narratives and patients go by name. Files named after problems or codes go by content: a header
    with FDA_CODE or a second field in words is a dictionary, a header with a key and a code is data, as are three
    fields; two numbers are told by size, then by the length of the first. (A file by the name of the device data is
    data if it is small, too.) Other names go by the header's columns.
    """
    found = [f for f in files.listed(spark, folder) if f.name.lower().endswith((".txt", ".csv"))]
    seen = files.heads(spark, [f.path for f in found])
    rows = [(f.path, f.name.lower(), f.length, _first_line(seen[f.path] + "\n") or "") for f in found]
    table = spark.createDataFrame(rows, "path string, name string, length long, line string")  # a row a file
    name, line = F.col("name"), F.col("line")
    many = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c)))
    table = table.withColumn("delimiter", F.when(many("|") >= many(","), "|").otherwise(","))
    parts = F.transform(F.split(F.upper("line"), F.when(F.col("delimiter") == "|", "\\|").otherwise(",")), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    table = table.withColumn("f", parts).withColumn("columns", F.size("f"))
    second, has = F.coalesce(F.get("f", F.lit(1)), F.lit("")), lambda c: F.array_contains("f", c)
    numbers, in_words = second.rlike("^[0-9]+$"), second.rlike("\\p{L}")
    side = lambda kind: F.concat(F.when(name.contains("patient"), "patient_").otherwise("device_"), F.lit(kind))
    pair = F.col("columns") == 2
    coded = name.contains("problem") | name.contains("code")
    rules = [
        (name.contains("mdrfoi"), F.lit("mdr"), "name"),
        (name.startswith("device") & ~name.contains("problem"), F.lit("device"), "name"),
        (name.contains("foitext"), F.lit("narrative"), "name"),
        (name.startswith("patient") & ~name.contains("problem"), F.lit("patient"), "name"),
        (coded & has("FDA_CODE") & (F.col("columns") >= 3), side("dictionary"), "header of a dictionary"),
        (coded & (F.col("columns") >= 3) & has("MDR_REPORT_KEY") & F.exists("f", lambda x: x.contains("PROBLEM_CODE") | (x == "PROBLEM")), side("problem"), "header of data"),
        (coded & pair & in_words, side("dictionary"), "second field in words"),
        (coded & pair & numbers & (F.col("length") > DATA_BYTES), side("problem"), "size of data"),
        (coded & pair & numbers & name.startswith("foidevproblem"), side("problem"), "name of data"),
        (coded & pair & numbers & (F.col("length") < DICTIONARY_BYTES), side("dictionary"), "size of a dictionary"),
        (coded & pair & numbers & (F.length(F.get("f", F.lit(0))) >= KEY_LENGTH), side("problem"), "length of the key"),
        (coded & pair & numbers, side("dictionary"), "length of the key"),
        (coded & (F.col("columns") == 3), side("problem"), "three fields"),
        (coded, F.lit("unknown"), "problem file of no known form"),
        (has("FOI_TEXT"), F.lit("narrative"), "header"),
        (has("EVENT_TYPE"), F.lit("mdr"), "header"),
        (has("BRAND_NAME"), F.lit("device"), "header"),
        (F.exists("f", lambda x: x.contains("PATIENT_SEQUENCE")) & (F.col("columns") > 5), F.lit("patient"), "header"),
    ]
    chain = lambda at: reduce(lambda c, r: c.when(r[0], r[at] if at == 1 else F.lit(r[2])), rules[1:], F.when(rules[0][0], rules[0][1] if at == 1 else F.lit(rules[0][2])))
    return table.select("path", "length", "delimiter", "columns", chain(1).otherwise("unknown").alias("role"), chain(2).otherwise("no rule").alias("because"))


def presence(found: DataFrame) -> DataFrame:
    """One row a role with its files and whether it is there."""
    spark = found.sparkSession
    roles = [*ROLE_GLOBS, "device_dictionary", "patient_dictionary"]
    wanted = spark.createDataFrame([(r,) for r in roles], "role string")
    counted = found.groupBy("role").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    status = F.when(F.col("files").isNull(), "MISSING").otherwise("PRESENT")
    return wanted.join(counted, "role", "left").select("role", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), status.alias("status"))


def read_years(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Published reports of a range of years; whole year folders outside it are never opened."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter((F.col("year_bucket") >= first) & (F.col("report_year") >= first))
    if last is not None:
        # the first folder holds earlier years too
        rows = rows.filter((F.col("year_bucket") <= max(last, _first_bucket(spark, path))) & (F.col("report_year") <= last))
    return rows


def _first_bucket(spark: SparkSession, path: str) -> int:
    """The least year among the names of the year folders."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = [f.getPath().getName() for f in found]
    return min((int(n.split("=")[1]) for n in names if n.startswith("year_bucket=")), default=0)


def typed_reports(raw: DataFrame) -> DataFrame:
    """E01, E02, E05 on raw report rows; either spelling of the report date serves."""
    column = lambda *names: next((F.col(n) for n in names if n in raw.columns), F.lit(None).cast("string"))
    out = raw.withColumns(
        {
            "DATE_RECEIVED_D": enrich.parsed_date(column("DATE_RECEIVED")),
            "DATE_REPORT_D": enrich.parsed_date(column("REPORT_DATE", "DATE_REPORT")),
            "DATE_OF_EVENT_D": enrich.parsed_date(column("DATE_OF_EVENT")),
            "IS_RWD_SOURCED": F.coalesce(enrich.is_rwd(column("REPORT_NUMBER")), F.lit(False)),
        }
    )
    return out.withColumn("DATE_PREF", F.coalesce("DATE_RECEIVED_D", "DATE_REPORT_D"))
