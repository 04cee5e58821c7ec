"""How far the sources of a language lie apart in their words, and which words set each source apart.

The vectors are those of Spark's `CountVectorizer`, fitted on each language with `min_df` and the largest integer as
vocabulary size, so that no term is cut: a term's place and count for each document, exact. A task makes them for the
documents it reads and sums them by (lang, source) at once, as a summarizer would, but sparse; a sum also knows in how
many documents its term is. One shuffle by (lang, term) then gives the vocabulary and the group sums together. The
class itself would keep the vocabulary on the driver, send all of it to each task and read the texts twice; the test
compares with it.

With `count` of a term in a group, N the group's sum of counts and V kept terms, each term has the integer share
p = 1 + floor(1000000000 (count + 5) / (N + 5 V)). Pairs of sources are evaluated by tiles: `SOURCES` sources against as
many others over a slice of `TERMS` terms, so that no task holds more, however many sources, terms or rows a language
has. A tile adds |p - q| over the terms that one of its sources has; for all other kept terms every share is the one
of count 0, and their number is enough.

Defined cases: null text, lang and source are ''; repeated rows are documents each; a document without terms, or a
language without kept terms, still has its group, with value 0 to every other; an empty table gives an empty result;
ties rank by UTF-8 item; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import byte_class, prefix_sums, saved, span_hash, text_steps, words

MIN_DF = 30
VOCABULARY = 2**31 - 1
SCALE, ADDED = 1_000_000_000, 5
SOURCES, TERMS = 64, 1 << 14
BEST = 50
#: Sums that a task holds before it passes them on.
HELD = 1 << 19
#: Letters are A-Z, of which the lower case counts, and all that is not ASCII.
_LETTER = byte_class("[A-Za-z]")
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def _empty(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def vectors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, term, count) in order, and for each term its hash, start and end in the bytes."""
    doc, start, end = words(buf, offsets, _LETTER)
    marks, first, term = np.unique(span_hash(prefix_sums(buf), start, end), return_index=True, return_inverse=True)
    pair, count = np.unique(doc * max(len(marks), 1) + term, return_counts=True)
    return pair // max(len(marks), 1), pair % max(len(marks), 1), count, marks, start[first], end[first]


class _Sums:
    """Counts and documents of (group, term), added up."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[int, int] = {}
        self.text: list[bytes] = []
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros((2, 0), dtype=np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, group: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> None:
        doc, term, count, marks, start, end = vectors(buf, offsets)
        places = np.zeros(len(marks), dtype=np.int64)
        for i, mark in enumerate(marks.tolist()):
            at = self.terms.setdefault(mark, len(self.text))
            if at == len(self.text):
                self.text.append(buf[start[i] : end[i]].tobytes())
            places[i] = at
        keys, of = np.unique((group[doc] << 32) + places[term], return_inverse=True)
        self.new.append((keys, np.stack([np.bincount(of, weights=w, minlength=len(keys)).astype(np.int64) for w in (count, None)])))
        if sum(len(k) for k, _ in self.new) > HELD:
            self.merge()

    def merge(self) -> None:
        self.new.append((self.keys, self.counts))
        self.keys, of = np.unique(np.concatenate([k for k, _ in self.new]), return_inverse=True)
        held = np.concatenate([c for _, c in self.new], axis=1)
        self.counts = np.stack([np.bincount(of, weights=c, minlength=len(self.keys)).astype(np.int64) for c in held])
        self.new = []

    def batch(self) -> pa.RecordBatch:
        self.merge()
        names, at, term = list(self.groups), self.keys >> 32, self.keys & 0xFFFFFFFF
        columns = [pa.array([n[k] for n in names] or [""], pa.string()).take(pa.array(at)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(self.text or [b""], pa.string()).take(pa.array(term)), *map(pa.array, self.counts)], ["lang", "source", "term", "n", "df"])


def counted(docs: DataFrame, min_df: int = MIN_DF, size: int = VOCABULARY) -> DataFrame:
    """(lang, source, term, n): the summed vectors of each group, of the terms in at least `min_df` documents of their
    language; if these are more than `size`, of those with most occurrences."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            group = np.array([sums.groups.setdefault(p, len(sums.groups)) for p in pairs], dtype=np.int64)
            for first, buf, offsets in text_steps(batch.column(2)):
                sums.add(group[first:], _LOWER[buf], offsets)
            if len(sums.keys) > HELD:
                yield sums.batch()
                sums = _Sums()
        yield sums.batch()

    # what a task has summed goes by term, so that the sums of groups and of the language need no other shuffle
    partial = _empty(docs).mapInArrow(gather, "lang string, source string, term string, n long, df long").repartition("lang", "term")
    sums = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_lang = W.partitionBy("lang", "term")
    kept = sums.withColumn("df", F.sum("df").over(of_lang)).filter(F.col("df") >= min_df)
    if size < VOCABULARY:
        kept = saved(kept.select("lang", "source", "term", "n"))
        most = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).withColumn("_at", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "term")))
        kept = kept.join(most.filter(F.col("_at") <= size).select("lang", "term"), ["lang", "term"], "left_semi")
    return saved(kept.select("lang", "source", "term", "n"))


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE (count + ADDED) / (total + ADDED size)), exact for any counts; 0 without terms."""
    whole = lambda c: c.cast("decimal(27,0)")
    up, down = (whole(count) + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), whole(total) + whole(size) * ADDED
    return F.when(size > 0, F.expr("1").cast("long") + F.call_function("div", up, down)).otherwise(0)


def groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, total, size, zero, number): a row a group; `zero` is the share of count 0."""
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("size"))
    every = _empty(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "size"])
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    return every.select("lang", "source", "total", "size", share(F.lit(0), F.col("total"), F.col("size")).alias("zero"), number.alias("number"))


def distances(counts: DataFrame, every: DataFrame, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """(lang, a, b, value): the summed difference of shares of each two sources a < b of a language."""
    sized = every.groupBy("lang").agg(F.max("number").alias("last"), F.max("size").alias("size"))
    sized = sized.select("lang", "size", F.floor(F.col("last") / sources).alias("last_block"), F.ceil(F.greatest("size", F.lit(1)) / terms).alias("slices"))
    block = F.floor(F.col("number") / sources)
    own = every.join(sized.drop("size"), "lang").withColumn("block", block)
    p = share(F.col("n"), F.col("total"), F.col("size"))
    have = counts.join(own, ["lang", "source"]).select("lang", "number", "block", "last_block", F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"), "term", p.alias("p"))
    # a row without a term tells each tile of a source and its share of count 0
    told = own.select("lang", "number", "block", "last_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"))
    dealt = have.unionByName(told).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_block"))))
    dealt = dealt.select("lang", "slice", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", F.col("number").cast("long").alias("number"), "term", F.col("p").cast("long").alias("p"))

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        number, p = (table.column(c).to_numpy() for c in ("number", "p"))
        term = table.column("term").combine_chunks().dictionary_encode()
        place = term.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        head = place < 0
        names, first = np.unique(number[head], return_index=True)
        zero = p[head][first]
        seen = len(term.dictionary)
        shares = np.repeat(zero[:, None], seen, axis=1)
        shares[np.searchsorted(names, number[~head]), place[~head]] = p[~head]
        low, high = key[2].as_py(), key[3].as_py()
        left = np.flatnonzero(names // sources == low)
        right = np.flatnonzero(names // sources == high)
        a, b, part, apart = [], [], [], []
        for i in left:
            with_ = right[right > i]
            a.append(np.full(len(with_), names[i]))
            b.append(names[with_])
            part.append(np.abs(shares[with_] - shares[i]).sum(axis=1))
            apart.append(np.abs(zero[with_] - zero[i]))
        joined = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (a, b, part, apart)]
        n = len(joined[0])
        return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "a": joined[0], "b": joined[1], "part": joined[2], "apart": joined[3], "seen": np.full(n, seen, dtype=np.int64)})

    parts = dealt.groupBy("lang", "slice", "low", "high").applyInArrow(tile, "lang string, a long, b long, part long, apart long, seen long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.max("apart").alias("apart"), F.sum("seen").alias("seen"))
    return sums.join(sized.select("lang", "size"), "lang").select("lang", "a", "b", (F.col("part") + (F.col("size") - F.col("seen")) * F.col("apart")).alias("value"))


def audit(docs: DataFrame, min_df: int = MIN_DF, size: int = VOCABULARY, best: int = BEST) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance to each other source of the language, and the `best` terms
    of greater share than in the language."""
    counts = counted(docs, min_df, size)
    every = saved(groups(docs, counts))
    name = every.select("lang", F.col("number").cast("long").alias("number"), "source")
    found = distances(counts, every)
    both = found.select("lang", "a", "b", "value").unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = both.join(name.withColumnRenamed("number", "a"), ["lang", "a"]).join(name.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    totals = every.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    sums = counts.withColumn("lang_n", F.sum("n").over(W.partitionBy("lang", "term")))
    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("lang_n"), F.col("lang_total"), F.col("size"))
    above = sums.join(every, ["lang", "source"]).join(totals, "lang").withColumn("value", p - q).filter("value > 0").withColumnRenamed("term", "item")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))
    return out(pairs, "pair").unionByName(out(above, "term").filter(F.col("rank") <= best))


def op13(docs: DataFrame) -> DataFrame:
    return audit(docs.select("text", "lang", "source"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
every AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total, coalesce(any_value(v), 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) LEFT JOIN sizes USING (lang) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM every JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
langs AS (SELECT lang, term, sum(n) AS n FROM shares GROUP BY 1, 2),
lang_shares AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS q
  FROM langs JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM every GROUP BY 1) USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(f.value), 0) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
