"""Narrative text: terms, phrases and ranked keyword search."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.stem import stemmed

# Words that carry nothing in this kind of narrative.
STOPWORDS = (
    "the", "and", "was", "were", "for", "that", "this", "with", "not", "has",
    "have", "had", "been", "are", "from", "which", "there", "their", "them",
    "patient", "device", "report", "reported", "event", "manufacturer",
    "information", "unknown", "date", "received", "stated", "indicated",
    "reportedly", "additional", "will", "also", "one", "two", "product",
    "returned", "evaluation", "complaint", "customer", "user", "facility",
    "further", "follow", "review", "time", "approximately", "due", "found",
    "noted", "none", "unk",
)
#: Words stand between runs of anything that is no letter, digit or underscore in Unicode.
_BETWEEN = "[^\\p{L}\\p{N}_]+"


def tokens(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Lower-case words of three or more letters a-z, in order, stopwords removed."""
    stop = [*STOPWORDS, *[w.strip().lower() for w in extra if w.strip()]]
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(stop))


def _grams(words: Column, n: int) -> Column:
    """Each word with the n - 1 after it. Words are taken by place: slice() turns the whole array over for each run."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))


def counted(texts: DataFrame, column: str, sizes: tuple[int, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """(term, n_words, n) of all word runs of the given sizes, formed after stopwords went."""
    words = texts.filter(F.col(column).isNotNull()).select(tokens(F.col(column), extra).alias("w"))
    grams = words.select("w", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n_words"))
    # one size of one text at a time
    each = [F.when(F.col("n_words") == n, _grams(F.col("w"), n)) for n in sizes]
    return grams.select(F.explode(F.coalesce(*each)).alias("term"), "n_words").groupBy("term", "n_words").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int, least: int = 1) -> DataFrame:
    """Ties by text."""
    return counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(k)


def bm25(texts: DataFrame, key: str, column: str, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best texts for a query. Only the query's words are exploded and counted.

    Words are matched whole, without stemming (`search_index` stems); stop words and words of one or two letters match
    nothing, nor does a query without words.
    """
    wanted = query_words(query)
    if not wanted:
        return texts.select(key, F.lit(0.0).alias("score")).limit(0)
    words = texts.filter(F.col(column).isNotNull()).select(key, tokens(F.col(column)).alias("w"))
    sized = words.select(key, F.size("w").alias("length"), *[F.size(_only(t)).alias(f"t{i}") for i, t in enumerate(wanted)])
    facts = sized.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(wanted))])
    rows = sized.filter(" OR ".join(f"t{i} > 0" for i in range(len(wanted)))).join(F.broadcast(facts))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        f, d = F.col(f"t{i}").cast("double"), F.col(f"d{i}").cast("double")
        idf = F.ln(1 + (F.col("docs") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def _only(term: str) -> Column:
    return F.filter("w", lambda w: w == term)


def query_words(query: str) -> list[str]:
    """The distinct words of a query, told apart as those of the texts."""
    return sorted({w for w in re.split(r"\W+", query.lower()) if w})


def write_index(texts: DataFrame, key: str, column: str, path: str) -> None:
    """A search index as two tables: `postings` (stem, key, f, length), sorted by stem so that a search reads the row
    groups of its stems alone, and `facts` (docs, mean), one row. The stemmer sees each distinct word once."""
    words = texts.filter(F.col(column).isNotNull()).select(F.col(key).alias("key"), tokens(F.col(column)).alias("w"))
    # an empty word stands for the text itself; kept while it is read, so that texts are split and their words summed once
    each = words.select("key", F.size("w").alias("length"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("word"))
    counts = each.groupBy("key", "length", "word").agg(F.count("*").alias("f")).persist(StorageLevel.DISK_ONLY)
    texts_ = counts.filter("word = ''").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("docs"), (F.sum(F.col("f") * F.col("length")) / F.sum("f")).alias("mean"))
    texts_.write.mode("overwrite").parquet(f"{path}/facts")
    stems = stemmed(counts.select("word").filter("word <> ''").distinct(), "word", "stem")
    postings = counts.join(stems, "word").groupBy("stem", "key", "length").agg(F.sum("f").alias("f"))
    ordered = postings.repartitionByRange("stem", "key").sortWithinPartitions("stem", "key")
    ordered.write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
    counts.unpersist()


def search_index(spark: SparkSession, path: str, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best texts (key, score) of an index for the stems of a query, by BM25."""
    asked = spark.createDataFrame([(w,) for w in query_words(query)], "word string")
    stems = sorted({r["stem"] for r in stemmed(asked, "word", "stem").collect()})  # the words of a query
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("stem").isin(stems))
    facts = spark.read.parquet(f"{path}/facts")
    found = hits.groupBy("stem").agg(F.count("*").alias("d")).join(F.broadcast(facts))  # a row a stem of the query
    idf = F.ln(1 + (F.col("docs") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    weight = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = hits.join(F.broadcast(found), "stem").groupBy("key").agg(F.sum(weight).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(k)
