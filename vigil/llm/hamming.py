"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the signs of a vector's components, cut into m segments of about log2(codes) - 2 bits, so that a
segment value has a few codes, each an index of its own. Steps (r, j) in order look up, for each unresolved
query, the values at distance r exactly in segment j, and verify the found codes' full distance. A pair
that no step up to (r, j) has found differs in r + 1 bits or more in segments 0 to j and in r or more in the
others, so in more than m * r + j: a query is resolved once its k-th distance is at most that. A pair is
taken only from the step that finds it first, so none is counted twice.

Equal codes are one index entry that keeps its k + 1 lowest ids: a higher id can't be among the k nearest,
as ties go to the lower id. Equal queries are searched once. A query's own row is not its neighbour.

Defined cases: null vectors and null ids are left out; null or NaN components count as not positive; with
fewer than k other rows all of them are returned; repeated ids of one code count once; vectors of another
length than `dims` are left out; extra columns are ignored.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved

K = 10
SALTS = 64


def codes(vectors: DataFrame, dims: int, m: int) -> DataFrame:
    """(vec_id, segs): the code as m integers."""
    x = F.col("embedding")
    cut = [dims * j // m for j in range(m + 1)]

    def segment(a: int, b: int) -> Column:
        bits = [F.when(F.coalesce(F.get(x, F.lit(i)), F.lit(0.0)) > 0, ~F.isnan(F.get(x, F.lit(i)))).otherwise(False).cast("int") * F.lit(1 << (i - a)) for i in range(a, b)]
        out = bits[0]
        for one in bits[1:]:
            out = out + one
        return out

    right = F.array(*[segment(a, b) for a, b in zip(cut, cut[1:], strict=False)])
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size(x) == dims)).select("vec_id", right.alias("segs"))


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def _entries(coded: DataFrame, keep: int) -> DataFrame:
    """One row a code with its lowest ids, ranked first in salted parts of a frequent code."""
    salted = coded.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    low = salted.withColumn("r", F.row_number().over(W.partitionBy("segs", "salt").orderBy("vec_id"))).filter(F.col("r") <= keep)
    low = low.withColumn("r", F.row_number().over(W.partitionBy("segs").orderBy("vec_id"))).filter(F.col("r") <= keep)
    return low.groupBy("segs").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, dims: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, distance) of the k nearest codes, ties to the lower id."""
    n = vectors.count()
    m = max(1, round(dims / max(4.0, min(16.0, log2(max(n, 2)) - 2))))
    cut = [dims * j // m for j in range(m + 1)]
    widths = [b - a for a, b in zip(cut, cut[1:], strict=False)]
    index = saved(_entries(codes(vectors, dims, m), k + 1))
    asked = saved(codes(queries, dims, m).distinct())
    # a query's bound is its (k + 1)-th distance so far: what lies beyond is not taken
    todo = saved(asked.select("segs").distinct().withColumn("bound", F.lit(dims)))
    hashed = index.select("segs", "ids", F.posexplode("segs").alias("seg", "value"))
    found = None
    near = F.zip_with("query", "segs", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    steps = [(r, j) for r in range(max(widths) + 1) for j in range(m)]
    # the first two radii are cheap and resolve few queries: one batch
    batches = [steps[: 2 * m], *[[s] for s in steps[2 * m :]]]
    # every value's distance from 0: at most 2**16 rows, the largest segment
    masks = F.broadcast(vectors.sparkSession.range(1 << max(widths)).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").alias("r")))
    for batch in batches:
        r, j = batch[-1]
        if all(step[0] > widths[step[1]] for step in batch):
            continue
        each = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("seg"), F.lit(1 << widths[b]).alias("size")) for a, b in batch])).alias("step")
        probes = (
            todo.select(F.col("segs").alias("query"), "bound", each)
            .select("query", "bound", "step.*")
            .join(masks, "r")
            .filter("mask < size")
            .select("query", "bound", "r", "seg", F.col("mask").bitwiseXOR(F.element_at("query", F.col("seg") + 1)).alias("value"))
        )
        earlier = F.exists(F.transform("near", lambda d, i: (d < F.col("r")) | ((d == F.col("r")) & (i < F.col("seg")))), lambda x: x)
        distance = F.aggregate("near", F.lit(0), lambda s, v: s + v)
        pairs = (
            probes.join(hashed, ["seg", "value"])
            .withColumn("near", near)
            .filter(~earlier & (distance <= F.col("bound")))
            .select("query", "ids", distance.alias("distance"))
        )
        best = pairs if found is None else pairs.unionByName(found)
        # every entry has at least one id, so a query needs no more than k + 1 entries; the order by
        # distance and lowest id keeps those that hold the k + 1 nearest ids
        order = W.partitionBy("query").orderBy("distance", F.col("ids")[0])
        best = best.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1).drop("at")
        found = saved(best)
        # the distance by which k + 1 ids are reached: k remain without the query itself
        start = F.struct(F.lit(0).alias("n"), F.lit(dims).alias("d"))
        reached = F.aggregate("got", start, lambda s, x: F.when(s["n"] > k, s).otherwise(F.struct((s["n"] + x["n"]).alias("n"), x["distance"].alias("d"))))
        kth = (
            found.groupBy(F.col("query").alias("segs"))
            .agg(F.sort_array(F.collect_list(F.struct("distance", F.size("ids").alias("n")))).alias("got"))
            .select("segs", reached.alias("reached"))
            .filter(F.col("reached.n") > k)
            .select("segs", F.col("reached.d").alias("kth"))
        )
        bounds = todo.drop("bound").join(kth, "segs", "left").select("segs", F.coalesce("kth", F.lit(dims)).alias("bound"))
        todo = saved(bounds.filter(F.col("bound") > m * r + j))
        if not todo.take(1):
            break
    ids = (
        found.select("query", "distance", F.explode("ids").alias("vec_id"))
        .withColumn("at", F.row_number().over(W.partitionBy("query").orderBy("distance", "vec_id")))
        .filter(F.col("at") <= k + 1)
        .drop("at")
    )
    answers = asked.withColumnRenamed("vec_id", "query_id").join(ids, F.col("segs") == F.col("query")).filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op7(vectors: DataFrame) -> DataFrame:
    vectors = vectors.select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))


SQL = """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS c FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM codes q JOIN codes d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
