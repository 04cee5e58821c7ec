"""Toxicity by class-conditional Kneser-Ney models of word pairs, backing off to words and to shared counts.

A class k is toxic or ordinary, j the other. c(k, vw) counts the labelled documents of class k in which w follows v,
C(k, v) is their sum over w; N(k, w) is the continuation count, the number of different words before w in class k, and
N(k) its sum. Both levels are discounted and interpolated with what is left over:

    P(w | k, v) = y(k, vw) / C(k, v) + b(k, v) P(w | k),    b(k, v) = 1 - sum of y(k, v.) / C(k, v),
    P(w | k)    = x(k, w) / N(k)     + l(k) P(w),           l(k) = 1 - sum of x(k, .) / N(k).

P(w), shared by the classes, is the share of w in the words of all documents, labelled or not, each counted once a
document. The discount of a count is D = n1 / (n1 + 2 n2) of its class and level and, as toxic documents are ordinary
but for a few words, `RHO` times what the other class leads one to expect:

    x(k, w)  = max(N(k, w) - D - RHO N(k) N(j, w) / N(j), 0)               y(k, vw) = max(c(k, vw) - D - RHO C(k, v) r, 0)

with r = c(j, vw) / C(j, v), and for a w that the classes share no less than P(w | k). A word's x is 0 where a
log-likelihood ratio test of its two counts stays below `WORD_TEST`; so is y, for a w of x = 0, below 2 log(number of
pairs), which chance exceeds about once. What is discounted goes to the next level by b and l, so each model remains a
distribution over all words.

A document's evidence is log P(document | toxic) - log P(document | ordinary) over all its words, by their number. For a
word of x = 0 in a pair of y = 0 both models leave l(k) b(k, v) P(w), where P(w) cancels: tasks therefore look up
the words, pairs and histories with a count left, or join them if they are more than `HELD`, with the same sums. A
logistic curve of this one figure, of slope 0 or more and fitted on labelled documents that the counts left out, makes it
a score. Words are 64-bit hashes. All counts are tables that grow with the corpus.

Defined cases: null or wordless texts have evidence 0; repeated documents count each, repeated labels of a document as
its highest; null labels teach nothing; where no entry is left or the curve does not rise (no toxic label, say), nothing is
told and all scores are 0; without an ordinary label all other documents count as ordinary; where the calibration
lacks a class, the score is the prior log-odds plus `SLOPE` times the evidence; very long texts are read whole; extra
columns are kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import byte_class, digest, fmix, free, fresh, prefix_sums, saved, scratch, span_hash, text_steps, words

WORD_TEST, RHO = 12.0, 7.4
#: Entries of the model, or words whose documents are counted, that tasks look up; more are joined.
HELD = 2_000_000
#: Labels that are sent to the documents; the documents are shuffled to more.
MAX_SENT = 2_000_000
#: Labelled documents of each class that fit the curve of two figures; all others count.
MAX_CALIBRATION = 10_000
SLOPE = 100.0
THRESHOLD = 0.3
#: Pairs that a task sums before it passes them on.
KEYS = 1 << 19
_WORD = byte_class("[0-9A-Za-z]")


def _tokens(column: pa.Array) -> Iterator[tuple]:
    """(first row, rows, document, word before or 0, word) step by step."""
    # lower-cased step by step, so that no second copy of a whole batch lies beside it
    for at, buf, offsets in text_steps(column):
        step = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(buf))
        for first, buf, offsets in text_steps(pc.utf8_lower(step), len(buf) * 4):
            doc, start, end = words(buf, offsets, _WORD)
            w = span_hash(prefix_sums(buf), start, end).view(np.int64)
            v = np.concatenate((np.zeros(1, dtype=np.int64), w))[: len(w)]
            v[np.flatnonzero(np.diff(doc, prepend=-1))] = 0
            yield at + first, len(offsets) - 1, doc, v, w


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return fmix(v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)).view(np.int64)


class _Sums:
    """Columns of counts (the last `counts`) summed by the first; `add` gives back what grows too large.

    Rows are summed and given back one column at a time, as copies of all columns are what takes a task's memory.
    """

    def __init__(self, columns: int, counts: int):
        self.columns, self.rows = columns, [[] for _ in range(columns + counts)]
        self.n = 0

    def add(self, *arrays: np.ndarray) -> Iterator[list[np.ndarray]]:
        for held, array in zip(self.rows, arrays, strict=True):
            held.append(array)
        self.n += len(arrays[0])
        if self.n > 2 * KEYS:
            self._sum()
            if self.n > KEYS:
                yield self.all()

    def _sum(self) -> None:
        if not self.n:
            return
        keys = np.concatenate(self.rows[0])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.n, self.rows[0] = len(at), [keys[at]]
        del keys
        for i in range(1, len(self.rows)):
            column = np.concatenate(self.rows[i])
            self.rows[i] = []
            column = column[order]
            self.rows[i] = [column[at] if i < self.columns else np.add.reduceat(column, at)]

    def all(self) -> list[np.ndarray]:
        """The sums, which are held no longer."""
        self._sum()
        out = [held[0] if held else np.zeros(0, dtype=np.int64) for held in self.rows]
        self.n, self.rows = 0, [[] for _ in self.rows]
        return out


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Rows sorted by word and word before, so that equal words lie side by side. The columns are used up."""
    order = np.lexsort((columns[0], columns[1]))
    return pa.RecordBatch.from_arrays([pa.array(columns.pop(0)[order]) for _ in names], names)


def pairs(texts: DataFrame) -> DataFrame:
    """(v, w, t, o): toxic and ordinary documents of (text, toxic) in which w follows v."""
    names = ["v", "w", "t", "o"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(3, 2)
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, doc, v, w in _tokens(batch.column(0)):
                keys, at, code = np.unique(_pair(v, w), return_index=True, return_inverse=True)
                m = max(len(keys), 1)
                each = np.unique(doc * m + code)
                t = toxic[first + each // m] > 0
                counts = [np.bincount(each[x] % m, minlength=len(keys)) for x in (t, ~t)]
                for full in sums.add(keys, v[at], w[at], *counts):
                    del full[0]
                    yield _batch(full, names)
        yield _batch(sums.all()[1:], names)

    rows = texts.select("text", "toxic").mapInArrow(gather, ", ".join(f"{c} long" for c in names))
    return rows.groupBy("v", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def shares(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(w, p) of each wanted word: its share in the words of all documents, each counted once a document."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(np.sort(_column(wanted, "w"))) if wanted.count() <= HELD else None

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = _Sums(1, 1), 0
        for batch in batches:
            for _, _, doc, _, w in _tokens(batch.column(0)):
                keys, code = np.unique(w, return_inverse=True)
                each = np.unique(doc * max(len(keys), 1) + code) % max(len(keys), 1)
                total += len(each)
                n = np.bincount(each, minlength=len(keys))
                mine = _found(held.value, keys)[1] if held else np.ones(len(keys), dtype=bool)
                for full in sums.add(keys[mine], n[mine]):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, full), pa.nulls(len(full[0]), pa.int64())], ["w", "n", "total"])
        rest = sums.all()
        yield pa.RecordBatch.from_arrays([*map(pa.array, rest), pa.nulls(len(rest[0]), pa.int64())], ["w", "n", "total"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([total])], ["w", "n", "total"])

    counted = saved(docs.select("text").mapInArrow(gather, "w long, n long, total long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = counted.agg(F.sum("total")).first()[0] or 0
    return wanted.join(counted, "w").select("w", (F.col("n") / F.lit(max(total, 1))).alias("p"))


def _column(df: DataFrame, name: str) -> np.ndarray:
    return df.select(name).toPandas()[name].to_numpy()


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the key is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool))


# ---- the model -----------------------------------------------------------------------------


def discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


def told_apart(a: Column, of_a: Column, b: Column, of_b: Column) -> Column:
    """Log-likelihood ratio test of a in of_a against b in of_b."""
    x = lambda c: F.when(c > 0, c * F.log(c.cast("double"))).otherwise(0.0)
    return 2 * (x(a) + x(b) + x(of_a - a) + x(of_b - b) - x(of_a) - x(of_b) - x(a + b) - x(of_a + of_b - a - b) + x(of_a + of_b))


def _facts(c: str) -> list[Column]:
    col = F.col(c)
    return [F.sum(c).alias(f"{c}_sum"), F.count_if(col == 1).alias(f"{c}_1"), F.count_if(col == 2).alias(f"{c}_2"), F.count_if(col > 0).alias(f"{c}_any")]


def excess(count: Column, of: Column, other: Column, of_other: Column, less: float, at_least: Column | None = None) -> Column:
    """A count without its discount: `less`, and RHO times what the other class, or `at_least`, leads one to expect."""
    expected = F.when(of_other > 0, other / of_other).otherwise(0.0)
    expected = F.greatest(expected, at_least) if at_least is not None else expected
    return F.greatest(count - less - RHO * of * expected, F.lit(0.0))


def model(docs: DataFrame, learned: DataFrame, folder: str) -> tuple[float, DataFrame]:
    """What a word adds to the evidence by itself, and (kind, v, w, e): what it adds more if it is w ("word"), comes
    after v ("history"), or is w after v ("pair").

    `learned`: (text, toxic). Intermediate tables are written to the folder.
    """
    spark = docs.sparkSession
    of = pairs(learned)
    each = [
        of.groupBy("w").agg(F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o")).withColumn("kind", F.lit("word")),
        of.groupBy("v").agg(*_facts("t"), *_facts("o"), F.count("*").alias("kinds")).withColumn("kind", F.lit("history")),
    ]
    # one count of all pairs feeds both tables
    each[0].unionByName(each[1], allowMissingColumns=True).write.partitionBy("kind").parquet(f"{folder}/counts")
    del of, each
    free(spark)
    schema = "v long, w long, t long, o long, kinds long, " + ", ".join(f"{c}_{x} long" for c in "to" for x in ("sum", "1", "2", "any")) + ", kind string"
    table = spark.read.schema(schema).parquet(f"{folder}/counts")
    word, history = (table.filter(F.col("kind") == k) for k in ("word", "history"))
    pair = pairs(learned)  # counted again where they are looked at: a table of all of them would double the disk

    f = word.agg(*_facts("t"), *_facts("o")).first()
    g = history.agg(*[F.sum(f"{c}_{x}").alias(f"{c}_{x}") for c in "to" for x in "12"], F.sum("kinds").alias("kinds"), F.max(F.col("t_sum") + F.col("o_sum")).alias("most")).first()
    total = {c: F.lit(f[f"{c}_sum"] or 0) for c in "to"}
    sides = (("t", "o"), ("o", "t"))
    told = word.filter(told_apart(F.col("t"), total["t"], F.col("o"), total["o"]) >= WORD_TEST)
    told = told.select("w", *[excess(F.col(c), total[c], F.col(d), total[d], discount(f[f"{c}_1"], f[f"{c}_2"])).alias(f"x_{c}") for c, d in sides])
    told = saved(told.filter("x_t > 0 or x_o > 0"))
    left = told.agg(*[F.sum(f"x_{c}").alias(c) for c in "to"]).first()
    left = {c: 1 - (left[c] or 0.0) / max(f[f"{c}_sum"] or 0, 1) for c in "to"}

    # pairs of told words, and those of others that pass the test; N I(class; pair) bounds the test by the pair's count,
    # so most of the others need no look at their history
    least = 2 * float(np.log(max(g["kinds"] or 0, 2)))
    n = F.col("t") + F.col("o")
    can = 2 * n * (F.log(F.lit(float(max(g["most"] or 0, 1))) / n) + 1) >= least
    sums = history.select("v", "t_sum", "o_sum")
    known = pair.select("v", "w", "t", "o").join(F.broadcast(told.select("w")) if told.count() <= HELD else told.select("w"), "w", "left_semi").join(sums, "v")
    others = pair.select("v", "w", "t", "o").filter(can).join(sums, "v").filter(told_apart(F.col("t"), F.col("t_sum"), F.col("o"), F.col("o_sum")) >= least)
    others = others.join(told.select("w"), "w", "left_anti")
    candidates = saved(known.withColumn("told", F.lit(True)).unionByName(others.withColumn("told", F.lit(False))))
    wanted = saved(told.select("w").union(candidates.select("w")).distinct())
    share = {c: F.coalesce(f"x_{c}", F.lit(0.0)) / F.greatest(total[c], F.lit(1)) + left[c] * F.col("p") for c in "to"}
    words_ = saved(shares(docs, wanted).join(told, "w", "left").select("w", *[share[c].alias(f"p_{c}") for c in "to"]))

    rows = candidates.join(words_, "w")
    y = lambda c, d: excess(F.col(c), F.col(f"{c}_sum"), F.col(d), F.col(f"{d}_sum"), discount(g[f"{c}_1"], g[f"{c}_2"]), F.when(F.col("told"), 0.0).otherwise(F.col(f"p_{c}")))
    rows = saved(rows.withColumns({f"y_{c}": y(c, d) for c, d in sides}).filter("y_t > 0 or y_o > 0"))
    goes_on = lambda c: 1 - F.sum(f"y_{c}") / F.greatest(F.first(f"{c}_sum"), F.lit(1))
    after = saved(rows.groupBy("v").agg(*[goes_on(c).alias(f"b_{c}") for c in "to"]))
    base = float(np.log(left["t"] / left["o"]))
    ratio = lambda a: F.log(F.col(f"{a}_t") / F.col(f"{a}_o"))
    whole = [F.col(f"y_{c}") / F.greatest(F.col(f"{c}_sum"), F.lit(1)) + F.col(f"b_{c}") * F.col(f"p_{c}") for c in "to"]
    none = F.lit(None).cast("long")
    entries = (
        words_.select(F.lit("word").alias("kind"), none.alias("v"), "w", (ratio("p") - base).alias("e"))
        .unionByName(after.select(F.lit("history").alias("kind"), "v", none.alias("w"), ratio("b").alias("e")))
        .unionByName(rows.join(after, "v").select(F.lit("pair").alias("kind"), "v", "w", (F.log(whole[0] / whole[1]) - ratio("b") - ratio("p")).alias("e")))
    )
    return base, entries.filter("e <> 0")


def evidence(docs: DataFrame, base: float, entries: DataFrame, name: str) -> DataFrame:
    """docs with the evidence of their words in a column of that name: `base` and the sum of the entries of each word,
    history and pair, by the number of words; 0 without words."""
    if entries.count() <= HELD:
        return _looked_up(docs, base, entries, name)
    _id = fresh(docs, "_id")
    marked = docs.withColumn(_id, digest(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, doc, v, w in _tokens(batch.column(1)):
                many = np.bincount(doc, minlength=rows)
                _, at, n = np.unique(np.stack((doc, v, w)), axis=1, return_index=True, return_counts=True)
                which = pa.array(doc[at] + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(v[at]), pa.array(w[at]), pa.array(n / many[doc[at]])], ["id", "v", "w", "n"])

    tokens = marked.select(_id, "text").dropDuplicates([_id]).mapInArrow(run, "id binary, v long, w long, n double")
    # a row for the document itself, so that `base` counts wherever there is a word
    hits = tokens.select("id", "n", F.lit(base).alias("e"))
    for kind, key in (("word", ["w"]), ("history", ["v"]), ("pair", ["v", "w"])):
        hits = hits.unionByName(tokens.join(entries.filter(F.col("kind") == kind).select(*key, "e"), key).select("id", "n", "e"))
    sums = hits.groupBy(F.col("id").alias(_id)).agg(F.sum(F.col("n") * F.col("e")).alias(name))
    return marked.join(sums, _id, "left").withColumn(name, F.coalesce(name, F.lit(0.0))).drop(_id)


def _looked_up(docs: DataFrame, base: float, entries: DataFrame, name: str) -> DataFrame:
    known = entries.select("kind", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("w", F.lit(0)).alias("w"), "e").toPandas()  # HELD at most
    sides = []
    for kind in ("word", "history", "pair"):
        part = known[known["kind"] == kind]
        v, w = part["v"].to_numpy(), part["w"].to_numpy()
        keys = {"word": w, "history": v, "pair": _pair(v, w)}[kind]
        order = np.argsort(keys)
        sides.append((keys[order], part["e"].to_numpy()[order]))
    held = docs.sparkSession.sparkContext.broadcast(sides)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for first, rows, doc, v, w in _tokens(batch.column(place)):
                here = slice(first, first + rows)
                many[here] = np.bincount(doc, minlength=rows)
                for (keys, e), key in zip(held.value, (w, v, _pair(v, w)), strict=True):
                    at, found = _found(keys, key)
                    if found.any():
                        total[here] += np.bincount(doc[found], weights=e[at[found]], minlength=rows)
            mean = np.where(many > 0, base + total / np.maximum(many, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


# ---- the score -----------------------------------------------------------------------------


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Level and slope, 0 or more, of a logistic curve: damped Newton steps on a convex loss with a slight ridge."""
    scale = max(float(np.sqrt(np.mean(x**2))), 1e-12)
    z = np.stack([np.ones(len(x)), x / scale], axis=1)

    def loss(w: np.ndarray) -> float:
        return float(np.sum(weight * (np.logaddexp(0, z @ w) - y * (z @ w)))) + 1e-2 * float(w @ w)

    w = np.zeros(2)
    for _ in range(200):
        p = 0.5 * (1 + np.tanh(z @ w / 2))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 2e-2 * np.eye(2), z.T @ (weight * (y - p)) - 2e-2 * w)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w + size * step
        if size <= 1e-9 or np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0) / scale


def _log_odds(share: float) -> float:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def _labelled(docs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(text, toxic, fits) of all documents, nulls where there is no label."""
    rows = docs.select(F.col("doc_id").alias("_doc_id"), "text")
    return rows.join(F.broadcast(labels) if n <= MAX_SENT else labels, F.col("_doc_id") == F.col("doc_id"), "left").select("text", "toxic", "fits")


def score(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """docs with a score between 0 and 1 in a column of that name."""
    spark = docs.sparkSession
    named = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic"))
    named = saved(named)
    found = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = [found.get(0, 0), found.get(1, 0)]
    if not n[1]:
        return docs.withColumn(name, F.lit(0.0))
    chosen = []
    for k in (0, 1):
        some = min(max(n[k] // 5, min(n[k] - 1, 1)), MAX_CALIBRATION)
        chosen.append(named.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(max(some, 0)))
    fits = chosen[0].union(chosen[1]).select("doc_id", F.lit(True).alias("fits"))
    marked = saved(named.join(fits, "doc_id", "left"))
    rows = _labelled(docs, marked, sum(n))
    learned = rows.filter("fits is null")
    learned = learned.filter("toxic is not null") if n[0] else learned.withColumn("toxic", F.coalesce("toxic", F.lit(0)))
    with scratch(spark, "toxicity") as folder:
        base, entries = model(docs, learned, folder)
        entries = saved(entries)
    if not entries.take(1):
        return docs.withColumn(name, F.lit(0.0))
    sample = evidence(rows.filter("fits"), base, entries, "x").select("toxic", "x").toPandas()  # two classes of MAX_CALIBRATION
    x, y = sample["x"].to_numpy(dtype=float), sample["toxic"].to_numpy(dtype=float)
    if 0 < y.sum() < len(y):
        # each class weighs as much as its labels
        weight = np.where(y > 0, n[1] / y.sum(), n[0] / (len(y) - y.sum()))
        level, slope = fit(x, y, weight * len(y) / weight.sum())
    else:
        level, slope = _log_odds(n[1] / sum(n) if n[0] else n[1] / max(docs.count(), n[1])), SLOPE
    if slope <= 0:
        return docs.withColumn(name, F.lit(0.0))
    return evidence(docs, base, entries, name).withColumn(name, 1 / (1 + F.exp(-(F.lit(level) + F.lit(slope) * F.col(name)))))


def _fold(doc_id: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 4


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns kept."""
    name = fresh(docs, "_score")
    return score(docs, labels.filter(_fold("doc_id") != 2), name).filter(F.col(name) < threshold).drop(name)


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), labels.filter(_fold("doc_id") != 2), "score")
    return scored.select("doc_id", (_fold("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
