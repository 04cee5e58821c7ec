"""Product and manufacturer indexes and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .build import counted

# Names that say nothing.
JUNK_NAMES = (
    "", "UNKNOWN", "UNK", "N/A", "NA", "NONE", "NOT APPLICABLE", "NOT AVAILABLE",
    "NO DATA", "NULL", "SEE NARRATIVE", "SEE ABOVE", "DEVICE", "UNKNOWN DEVICE",
    "*", "-", "--", "...", "REDACTED",
)


def product_index(reports: DataFrame, from_year: int, k_names: int = 3, k_brands: int = 2) -> DataFrame:
    """Each code's counts, years, commonest useful names and label (the commonest name), ties by name.

    One pass over the reports: they are counted by (code, generic name, brand), and all else comes from these counts.
    """
    rows = reports.filter((F.trim("product_code") != "") & (F.col("report_year") >= from_year))
    name = lambda c: F.upper(F.trim(c))
    grouped = rows.groupBy("product_code", name("GENERIC_NAME").alias("generic"), name("BRAND_NAME").alias("brand")).agg(
        F.count("*").alias("n"), counted("EVENT_TYPE = 'D'", "deaths"), counted("any_serious_outcome", "serious"), F.min("report_year").alias("y0"), F.max("report_year").alias("y1")
    )
    kinds = (("names", F.col("generic"), k_names), ("brands", F.col("brand"), k_brands), ("all", F.lit(None).cast("string"), 1))
    each = grouped.select("*", F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), of.alias("name"), F.lit(k).alias("k")) for kind, of, k in kinds])))
    useful = (F.col("kind") == "all") | (~F.col("name").isin(*JUNK_NAMES) & (F.length("name") > 2))
    sums = each.filter(useful).groupBy("product_code", "kind", "name", "k").agg(*[F.sum(c).alias(c) for c in ("n", "deaths", "serious")], F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    rank = F.row_number().over(W.partitionBy("product_code", "kind").orderBy(F.desc("n"), "name"))
    best = sums.withColumn("rank", rank).filter(F.col("rank") <= F.col("k"))
    whole = lambda c: F.max(F.when(F.col("kind") == "all", F.col(c))).alias(c)

    def listed(kind: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "name"))))
        return F.when(F.size(found) > 0, F.transform(found, lambda x: x["name"])).alias(kind)

    both = best.groupBy("product_code").agg(*[whole(c) for c in ("n", "deaths", "serious", "y0", "y1")], listed("names"), listed("brands"))
    return both.withColumn("label", F.coalesce(F.get("names", F.lit(0)), F.get("brands", F.lit(0)), "product_code"))


def manufacturer_index(reports: DataFrame, from_year: int, k: int | None = 4000) -> DataFrame:
    """The manufacturers of most reports, or with k=None all of them in no order."""
    rows = reports.filter((F.trim("manufacturer") != "") & ~F.upper(F.trim("manufacturer")).isin(*JUNK_NAMES) & (F.col("report_year") >= from_year))
    sums = rows.groupBy("manufacturer").agg(F.count("*").alias("n"), counted("EVENT_TYPE = 'D'", "deaths"), F.min("report_year").alias("y0"), F.max("report_year").alias("y1"))
    return sums if k is None else sums.orderBy(F.desc("n"), "manufacturer").limit(k)


def _match(name: Column, query: str) -> Column:
    text = F.lower(name)
    return (
        F.when(text == query, 300.0).when(text.startswith(query), 250.0)
        .when(F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9_]+", " ")).contains(" " + query), 200.0)
        .when(text.contains(query), 150.0).otherwise(0.0)
    )


def product_search(index: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Codes by how well a name matches (whole, prefix, word, inside), then volume."""
    query = query.strip().lower()
    names = F.concat(F.array("label"), F.coalesce("names", F.array().cast("array<string>")), F.coalesce("brands", F.array().cast("array<string>")))
    best = F.array_max(F.transform(names, lambda n: _match(n, query)))
    code = F.lower("product_code")
    best = F.when(best > 0, best).when(code.startswith(query), 275.0).otherwise(0.0)
    score = F.when(code == query, 1e6).when(best > 0, best + F.log10(F.col("n") + 1.0) * 25)
    return index.withColumn("score", score).filter("score is not null").orderBy(F.desc("score"), "product_code").limit(k)


def manufacturer_search(index: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Names that contain the query, those that begin with it first, then by volume."""
    query = query.strip().lower()
    name = F.lower("manufacturer")
    return index.filter(name.contains(query)).orderBy(F.when(name.startswith(query), 0).otherwise(1), F.desc("n"), "manufacturer").limit(k)
