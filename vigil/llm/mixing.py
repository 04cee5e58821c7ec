"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame operations only.

Slot i of the schedule maps the golden-ratio point frac((i + 1) * phi) through the cumulative target weights to a source,
and slots are ranked within their source. Each source's documents, shuffled by a hash, form a stream of words, which
starts again after its last word and ends at the source's target. It is cut into as many blocks as the source was dealt
slots, equal to a word, and rank r takes block r: what the mix takes of a document are its words in blocks that a slot
names, nothing else. A document's `first_slot` is the slot that begins it, so documents ordered by it are the mix in the
order in which it is dealt. A source whose share is so small that it is dealt no slot is not taken.

There is a slot for `BLOCK` words, or more slots where the corpus is so small that its sources would get less than
`SLOTS` each on average. Points are whole numbers modulo 2**62, so they are as even at 10**12 slots as at a thousand.

Targets share all words by weight; none exceeds `max_epochs` times its source's size, and the excess is reshared by
weight until none is above. All windows run over a bounded bucket of documents, a chunk of slots, or the per-bucket and
per-source totals; a source that holds most rows is spread over many buckets.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, the last; repeated rows each
count; an empty table gives an empty result; a source without words has target 0; columns other than doc_id, text and
source are ignored by `plan` and kept by `mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import digest, fresh, n_words, saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 64
#: Slots a source at least, on average, while there are words for them.
SLOTS = 2048
#: Documents in one ordering window, and slots in one ranking window, on average.
BUCKET_ROWS = 2048
CHUNK_SLOTS = 8192
GRID = 1024
#: The golden ratio's fraction in units of 2**-62, by halves of 31 bits.
BITS, HALF = 62, (1 << 31) - 1
GOLDEN = 2850178704830799621


def targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source with its size.

    With the sources ordered by size over weight, the first k that are held at their limit leave
    lambda_k = (all words - their limits) / (weight of the others) for each unit of weight; the right k
    is the first whose next source stays below its limit.
    """
    everything = W.partitionBy(F.lit(1))
    position = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(position, F.lit(len(weights))) + 1).cast("int"))
    by_need = everything.orderBy(F.col("limit") / F.col("weight"), "position").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        totals.withColumn("position", position)
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(max_epochs))
        .withColumn("held", F.coalesce(F.sum("limit").over(by_need), F.lit(0)))
        .withColumn("held_weight", F.coalesce(F.sum("weight").over(by_need), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("all") - F.col("held")) / (F.col("all_weight") - F.col("held_weight")))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    by_rank = everything.orderBy(F.col("limit") / F.col("weight"), "position").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        ranked.withColumn("level", F.first(fits, ignorenulls=True).over(by_rank))
        .withColumn("target", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))
    )


def _key(source: Column) -> Column:
    """A source as a join key; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit("n"))


def golden(slot: Column) -> Column:
    """frac((slot + 1) * phi) in units of 2**-62, by products of 31-bit halves that a long can hold."""
    i = slot + 1
    low, high = i.bitwiseAND(HALF), F.shiftright(i, 31).bitwiseAND(HALF)
    cross = (low * F.lit(GOLDEN >> 31) + high * F.lit(GOLDEN & HALF)).bitwiseAND(HALF)
    return (low * F.lit(GOLDEN & HALF) + F.shiftleft(cross, 31)).bitwiseAND((1 << BITS) - 1)


def schedule(goals: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """(source key, rank, slot): the slots that each source is dealt, ranked within it; (key, dealt): their number.

    A source owns an interval of the points. The intervals are cut at a fixed grid, so that a point meets its source by
    an equi-join on the grid cell and a comparison, whatever the number of sources.
    """
    steps = W.partitionBy(F.lit(1)).orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    whole = F.sum("target").over(W.partitionBy(F.lit(1)))
    upto = F.sum("target").over(steps)
    place = lambda c: F.floor(c / whole * F.lit(float(1 << BITS))).cast("long")
    shares = goals.filter("target > 0").select(
        "key", place(upto - F.col("target")).alias("low"), F.when(upto < whole, place(upto)).otherwise(F.lit(1 << BITS)).alias("high")
    )
    cell = lambda c: F.least(F.shiftright(c, BITS - 10), F.lit(GRID - 1))
    shares = shares.select("key", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    points = goals.sparkSession.range(0, slots).select(F.col("id").alias("slot"), golden(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.shiftright("point", BITS - 10))
    dealt = (
        points.join(shares, "cell")
        .filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        .select("slot", "key", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    )
    counts = dealt.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = saved(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    inside = F.row_number().over(W.partitionBy("key", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).join(counts.select("key", "chunk", "before"), ["key", "chunk"])
    return ranked.select("key", (F.col("before") + F.col("inside")).alias("rank"), "slot"), counts.groupBy("key").agg(F.sum("n").alias("dealt"))


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK, row_id: Column | None = None) -> DataFrame:
    """One row per document: size, its source's size and target, words taken, copies begun, and the slots that begin it."""
    rows = docs.select(
        "doc_id", "source", _key(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(20)).alias("h"), F.xxhash64("doc_id", "text", F.lit(21)).alias("h_text"),
        (F.lit(None) if row_id is None else row_id).alias("row_id"),
    )
    rows = saved(rows)
    totals = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    goals = saved(targets(totals.select("source", "source_size"), weights, max_epochs).withColumn("key", _key(F.col("source"))))
    facts = totals.agg(F.sum("source_size"), F.max("n_rows"), F.count("*")).first()
    words, most = facts[0] or 0, facts[1] or 0
    n_slots = max(-(-words // block), min(words, SLOTS * facts[2]))
    buckets = max(1, -(-most // BUCKET_ROWS))
    # where each document starts in its source's shuffled stream
    placed = rows.withColumn("bucket", F.pmod("h_text", F.lit(buckets)))
    before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = (
        placed.groupBy("key", "bucket")
        .agg(F.sum("size").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(goals.select("key", "source_size", "target", F.floor("target").cast("long").alias("goal")), "key")
        .drop("n")
    )
    inside = W.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", "h_text").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["key", "bucket"])
        .withColumn("start", F.col("before") + F.col("inside"))
        .drop("before", "inside", "bucket")
    )
    placed = saved(placed)
    slots, sizes = schedule(goals, n_slots)
    # each pass over a source's stream, cut into the blocks that its slots take: block r is [edge(r), edge(r + 1))
    edge = lambda r: F.when(r >= F.col("dealt"), F.col("goal")).otherwise(F.floor(r.cast("double") * F.col("goal") / F.col("dealt")).cast("long"))
    near = lambda word: F.floor(word.cast("double") * F.col("dealt") / F.col("goal"))  # noqa: E731  the rank, or one beside it
    pieces = (
        placed.filter("size > 0 and goal > 0")
        .join(sizes, "key")
        .select("key", "start", "size", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"), "source_size", "dealt", "goal")
        .withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
        .filter(F.col("from") < F.col("goal"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("goal")))
        .withColumn("rank", F.explode(F.sequence(F.greatest(near(F.col("from")) - 1, F.lit(0)), F.least(near(F.col("to")) + 1, F.col("dealt") - 1))))
        .withColumn("n", F.least(F.col("to"), edge(F.col("rank") + 1)) - F.greatest(F.col("from"), edge(F.col("rank"))))
        .filter("n > 0")
        .select("key", "start", "rank", "n", (edge(F.col("rank")) <= F.col("from")).alias("begins"))
    )
    took = (
        pieces.join(slots, ["key", "rank"])
        .groupBy("key", F.col("start").alias("at"))
        .agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list(F.when(F.col("begins"), F.col("slot")))).alias("slots"))
    )
    # a document without words takes up no place in the stream, so it can't share one here
    at = F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.pmod("h", F.lit(1 << 40)))
    none = F.array().cast("array<long>")
    return (
        placed.withColumn("at", at)
        .join(took, ["key", "at"], "left")
        .select(
            "doc_id", "size", "source_size", "target", "row_id", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            F.size(F.coalesce("slots", none)).cast("long").alias("copies"), F.coalesce("slots", none).alias("slots"),
        )
    )


def mix(docs: DataFrame, slot: str | None = None, **options) -> DataFrame:
    """The documents as often as the mix begins them, all columns kept; `slot` names a column for the slot that does, by
    which the rows stand in the order of the mix."""
    row_id, slots = fresh(docs, "_row_id"), fresh(docs, "_slots")
    mark = digest(*[F.col(f"`{c}`") for c in docs.columns])
    # rows alike in every column become one, repeated as often as all of them together are taken
    taken = plan(docs.select("doc_id", "text", "source", mark.alias("_mark")), row_id=F.col("_mark"), **options).filter("copies > 0")
    taken = taken.select(F.col("row_id").alias(row_id), F.explode("slots").alias("slot")).groupBy(row_id).agg(F.collect_list("slot").alias(slots))
    whole = docs.withColumn(row_id, mark).join(taken, row_id).dropDuplicates([row_id])
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(slots).alias(slot or fresh(docs, "_slot"))).select(*[F.col(f"`{c}`") for c in docs.columns], *([slot] if slot else []))


def op2(docs: DataFrame) -> DataFrame:
    planned = plan(docs.select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))
