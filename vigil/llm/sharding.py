"""Sharding of indivisible groups into near-equal shards by best-fit-decreasing bin packing.

A group is the set of documents with equal texts; it never splits. Packing runs in two levels, so that
no task holds all groups:

1. Groups are dealt by digest into cells. In each cell, one pass over the groups by falling size puts
   each into the open bundle with the tightest remaining room (a balanced tree of rooms); bundles hold
   `total / (shards * BUNDLES)` bytes. A group larger than that is a bundle of its own.
2. The bundles, at most `2 * shards * BUNDLES + MAX_CELLS` in number whatever the input, are packed the
   same way into shards; a bisection finds the smallest capacity at which the shards suffice.

Slots number each shard's documents from 0 without gaps: documents are spread over sub-buckets by hash,
counted, and ranked inside their sub-bucket, so a large shard or group is never ordered in one task.

Defined cases: null text has no bytes and is a group of its own (crc32 0); equal documents repeated are
placed and numbered each; an empty table gives an empty result; a group larger than the average shard
gets a shard that is larger by that much; other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import digest, n_bytes, saved

SHARDS = 24
#: Bundles in a shard: the packing of the second level is exact to about one part in so many.
BUNDLES = 128
MAX_CELLS = 1024
CELL_GROUPS = 4096
SLOT_ROWS = 4096
ROW_BYTES = 8


class Room:
    """Open bins in a balanced search tree (a treap) by remaining room, for the tightest fit in log steps.

    A node is (room, bin), priority, left, right; priorities are a fixed scramble of a counter, so that equal
    inputs build equal trees.
    """

    def __init__(self) -> None:
        self.tree: list | None = None
        self.n = self.made = 0

    def put(self, size: int, capacity: int) -> int:
        below, fits = _split(self.tree, (size, -1))
        if fits is None:
            room, name = max(capacity, size), self.n
            self.n += 1
        else:
            (room, name), fits = _pop_least(fits)
        self.tree = _merge(below, fits)
        if room > size:
            self.made += 1
            low, high = _split(self.tree, (room - size, name))
            node = [(room - size, name), self.made * 2654435761 % 4294967296, None, None]
            self.tree = _merge(_merge(low, node), high)
        return name


def _split(tree: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
    """The nodes below the key, and the others."""
    if tree is None:
        return None, None
    if tree[0] < key:
        tree[3], right = _split(tree[3], key)
        return tree, right
    left, tree[2] = _split(tree[2], key)
    return left, tree


def _merge(a: list | None, b: list | None) -> list | None:
    """One tree of two, all of whose keys are in order."""
    if a is None or b is None:
        return b if a is None else a
    if a[1] > b[1]:
        a[3] = _merge(a[3], b)
        return a
    b[2] = _merge(a, b[2])
    return b


def _pop_least(tree: list) -> tuple[tuple[int, int], list | None]:
    if tree[2] is None:
        return tree[0], tree[3]
    key, tree[2] = _pop_least(tree[2])
    return key, tree


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """The bin of each size; sizes fall. An item above the capacity gets a bin to itself."""
    room = Room()
    return [room.put(int(s), capacity) for s in sizes]


def fit(sizes: list[int], bins: int) -> list[int]:
    """Best-fit-decreasing at the smallest capacity, by bisection, that needs no more than `bins`."""
    low = max([-(-sum(sizes) // bins), *sizes[:1]], default=0)
    high = low + max(sizes, default=0) + 1
    best = best_fit_decreasing(sizes, high)
    while max(best, default=0) >= bins:
        low, high = high, 2 * high
        best = best_fit_decreasing(sizes, high)
    while low < high:
        mid = (low + high) // 2
        tried = best_fit_decreasing(sizes, mid)
        if max(tried, default=0) < bins:
            best, high = tried, mid
        else:
            low = mid + 1
    return best


def _bundled(frames: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """Rows come by cell and falling size; only the open bins of one cell are held."""
    cell, room = None, Room()
    for frame in frames:
        names = []
        for c, size in zip(frame["cell"], frame["bytes"], strict=True):
            if c != cell:
                cell, room = c, Room()
            names.append(room.put(int(size), capacity))
        yield frame.assign(bundle=names)[["grp", "cell", "bundle", "bytes"]]


def pack(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(grp, shard) from distinct groups (grp, bytes)."""
    facts = groups.agg(F.count("*"), F.sum("bytes")).first()
    n, total = facts[0], facts[1] or 0
    cells = max(1, min(MAX_CELLS, -(-n // CELL_GROUPS)))
    capacity = max(1, -(-total // (shards * BUNDLES)))
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("grp"), F.lit(cells)))
    ordered = dealt.repartition(cells, "cell").sortWithinPartitions("cell", F.desc("bytes"), "grp")
    bundled = saved(
        ordered.mapInPandas(lambda frames: _bundled(frames, capacity), "grp binary, cell long, bundle int, bytes long")
    )

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "cell", "bundle"], ascending=[False, True, True])
        return frame.assign(shard=fit([int(x) for x in frame["bytes"]], shards))[["cell", "bundle", "shard"]]

    bundles = bundled.groupBy("cell", "bundle").agg(F.sum("bytes").alias("bytes"))
    # bounded: see the module's docstring
    placed = bundles.groupBy(F.lit(1).alias("one")).applyInPandas(place, "cell long, bundle int, shard int")
    return bundled.join(placed, ["cell", "bundle"]).select("grp", "shard")


def numbered(df: DataFrame, n: int, *order: str) -> DataFrame:
    """`slot` from 0 without gaps within each shard."""
    buckets = max(1, -(-n // SLOT_ROWS))
    df = df.withColumn("sub", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("shard", "sub").orderBy(*order)) - 1
    ranked = df.withColumn("inside", inside).join(counts, ["shard", "sub"])
    return ranked.withColumn("slot", (F.col("before") + F.col("inside")).cast("long")).drop("before", "inside", "sub")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (n_bytes(text) + ROW_BYTES).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        digest(text).alias("grp"),
    )
    rows = saved(rows)
    groups = saved(rows.groupBy("grp").agg(F.sum("size").alias("bytes")))
    # one row a group on one side: a large group's rows are split by adaptive execution
    packed = saved(pack(groups, shards))
    spread = rows.join(packed, "grp")
    return numbered(spread, rows.count(), "doc_id", "grp").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "grp"
    )


def op5(docs: DataFrame) -> DataFrame:
    return place(docs.select("doc_id", "text")).drop("grp")
