"""Similarity join on word 5-gram sets with Jaccard similarity of at least 0.8, and its classes.

Words are runs of anything but ASCII blanks; a text of one to four words has one shingle, all of them.

1. Equal texts become one node. A node's MinHash values (160) are cut into 32 bands; nodes that share a
   band are candidates of each other. At similarity 0.8 a pair shares none with probability 3e-6.
2. Connected candidates form groups. A group is dealt into sides of about `SIDE` nodes and `SIDE_BYTES` of
   text, and every pair of sides is one tile, so a large group is spread over many tasks. A large group whose bands
   hold fewer pairs than the group itself (loosely alike texts, chained) is compared band by band instead, each
   pair in the first band that it shares.
3. In a tile, Bayesian pruning compares MinHash values 32 at a time and drops a pair when the posterior
   probability (uniform prior) that its similarity reaches the threshold falls below 1e-9. What is left is
   verified exactly on the shingle sets.
4. A tile gives, instead of pairs, each node's number of linked documents and its component among the tile's
   links; sums and connected components of these make the result. No link is lost, none is listed.

A text is identified by its MD5 digest.

Defined cases: null and blank texts have no shingle, no link, and each row's class is its own doc_id; ties
go to the lowest doc_id; repeated rows are copies; texts of any length are read whole; null doc_ids sort
before others; empty tables give empty results; extra columns are ignored by `classes`, kept by `distinct`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_WORDS, digest, fmix, fresh, mixed, n_bytes, n_words, prefix_sums, saved, span_hash, text_steps, words
from .components import stars

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-9
#: Nodes of either side that numpy compares at a time.
BLOCK = 128
#: Nodes, and about so many bytes of text, of either side of a tile.
SIDE, SIDE_BYTES = 1024, 16 << 20
_NO_ID = -(2**63)
_A, _B = mixed(HASHES, 401) | np.uint64(1), mixed(HASHES, 402) | np.uint64(1)
_Q = mixed(SHINGLE, 403) | np.uint64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word 5-gram; repeats within a document are not removed."""
    doc, start, end = words(buf, offsets, BLANK_WORDS)
    if not len(doc):
        return doc, np.zeros(0, dtype=np.uint64)
    h = span_hash(prefix_sums(buf), start, end)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)))[doc]
    at = np.flatnonzero(np.arange(len(doc)) - first <= np.maximum(count[doc] - SHINGLE, 0))
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(SHINGLE):
        there = np.minimum(at + j, len(doc) - 1)
        same = (at + j < len(doc)) & (doc[there] == doc[at])
        out += np.where(same, h[there] * _Q[j], np.uint64(0))
    return doc[at], fmix(out)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = 1 << 15
    for batch in batches:
        ids, sigs = [], []
        for first, buf, offsets in text_steps(batch.column(1)):
            doc, h = shingles(buf, offsets)
            if not len(doc):
                continue
            best: dict[int, np.ndarray] = {}
            for a in range(0, len(h), chunk):
                part, of = h[a : a + chunk], doc[a : a + chunk]
                begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                least = np.empty((HASHES, len(begin)), dtype=np.uint32)
                mixed_part, high = np.empty_like(part), np.empty_like(part)
                for k in range(HASHES):
                    # two multiplications with a shift between: one alone leaves the minima of different k dependent
                    np.multiply(part, _A[k], out=mixed_part)
                    np.right_shift(mixed_part, np.uint64(32), out=high)
                    np.bitwise_xor(mixed_part, high, out=mixed_part)
                    np.multiply(mixed_part, _B[k], out=mixed_part)
                    np.right_shift(mixed_part, np.uint64(32), out=mixed_part)
                    least[k] = np.minimum.reduceat(mixed_part, begin)
                for i, d in enumerate(of[begin]):
                    one = least[:, i]
                    best[d] = np.minimum(best[d], one) if d in best else one
            ids.extend(first + d for d in best)
            sigs.extend(s.astype("<u4").tobytes() for s in best.values())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sigs, pa.binary())], ["key", "sig"])


@lru_cache
def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among n values at which the posterior of reaching the threshold is tolerable.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at t is the chance of at
    most m successes in n + 1 trials of probability t.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def candidates(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that survive the pruning of signature rows a against b."""
    n = (a[:, None, :STEP] == b[None, :, :STEP]).sum(axis=2)
    if same:
        n = np.triu(n + 1, 1) - 1
    i, j = np.nonzero(n >= least_matches(STEP))
    n = n[i, j]
    for upto in range(2 * STEP, HASHES + 1, STEP):
        n = n + (a[i, upto - STEP : upto] == b[j, upto - STEP : upto]).sum(axis=1)
        keep = n >= least_matches(upto)
        i, j, n = i[keep], j[keep], n[keep]
    return i, j


def overlaps(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common shingles of the pairs (a[i], b[j]) of sorted distinct sets, exactly."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], dtype=np.int64)
    sets = [*a, *b]
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[place] > 1
    of, place = of[shared], np.unique(place[shared], return_inverse=True)[1]
    total = np.zeros((len(a), len(b)), dtype=np.float64)
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    width = 8192
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        lo, hi = np.searchsorted(place, [low, low + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[of[lo:hi], place[lo:hi] - low] = 1
        total += m[: len(a)] @ m[len(a) :].T
    return total[i, j].astype(np.int64)


class _Side:
    """One block of a tile: rows of (node, copies, sig, text)."""

    def __init__(self, rows: list[tuple]):
        self.node = np.array([r[0] for r in rows], dtype=np.int64)
        self.copies = np.array([r[1] for r in rows], dtype=np.int64)
        self.sig = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u4").reshape(len(rows), HASHES)
        self.text = [r[3] for r in rows]
        self.sets: list[np.ndarray | None] = [None] * len(rows)

    def read(self, wanted: np.ndarray) -> None:
        """The shingle sets of some rows, a step of text at a time."""
        new = [k for k in wanted.tolist() if self.sets[k] is None]
        for first, buf, offsets in text_steps(pa.array([self.text[k] for k in new], pa.string())):
            doc, h = shingles(buf, offsets)
            at = np.searchsorted(doc, np.arange(len(offsets)))
            for d, k in enumerate(new[first : first + len(offsets) - 1]):
                self.sets[k] = np.unique(h[at[d] : at[d + 1]])


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Brings `label`, the least place of each place's component, up to the links (x, y)."""
    while True:
        apart = label[x] != label[y]
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        # one link for each place is enough to try before looking again
        for k in {*np.unique(x, return_index=True)[1].tolist(), *np.unique(y, return_index=True)[1].tolist()}:
            p, q = label[x[k]], label[y[k]]
            if p != q:
                label[label == max(p, q)] = min(p, q)


def _tile(left: _Side, right: _Side, band: int, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(0, node, another of its component) for each but one of a component, and (1, node, linked documents)."""
    same = left is right
    offset = 0 if same else len(left.node)
    node = left.node if same else np.concatenate((left.node, right.node))
    label, linked = np.arange(len(node)), np.zeros(len(node), dtype=np.int64)
    for a in range(0, len(left.node), BLOCK):
        for b in range(a if same else 0, len(right.node), BLOCK):
            i, j = candidates(left.sig[a : a + BLOCK], right.sig[b : b + BLOCK], same and a == b)
            i, j = i + a, j + b
            if band > 0 and len(i):
                before = (left.sig[i, : band * ROWS] == right.sig[j, : band * ROWS]).reshape(len(i), band, ROWS).all(axis=2).any(axis=1)
                i, j = i[~before], j[~before]
            if not len(i):
                continue
            left.read(np.unique(i))
            right.read(np.unique(j))
            none = np.zeros(0, dtype=np.uint64)
            sets = [[x if x is not None else none for x in side.sets[k : k + BLOCK]] for side, k in ((left, a), (right, b))]
            common = overlaps(*sets, i - a, j - b)
            size = [np.array([len(x) for x in side]) for side in sets]
            keep = common >= threshold * (size[0][i - a] + size[1][j - b] - common) - 1e-9
            i, j = i[keep], j[keep] + offset
            copies = right.copies[j - offset], left.copies[i]
            linked += np.bincount(i, weights=copies[0], minlength=len(node)).astype(np.int64)
            linked += np.bincount(j, weights=copies[1], minlength=len(node)).astype(np.int64)
            _unite(label, i, j)
    for k in np.flatnonzero(label != np.arange(len(node))):
        yield 0, int(node[k]), int(node[label[k]])
    for k in np.flatnonzero(linked):
        yield 1, int(node[k]), int(linked[k])


def _tiles(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit and tile; one tile, two blocks of nodes, is held at a time."""
    key, held = None, {}

    def out() -> pa.RecordBatch:
        _, low, high, band = key
        sides = {block: _Side(rows) for block, rows in held.items()}
        made = list(_tile(sides[low], sides[high], band, threshold)) if low in sides and high in sides else []
        return pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], pa.int64()) for c in range(3)], ["kind", "x", "y"])

    # a few rows at a time become Python objects: a batch may hold tens of MB of text
    for part in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
        cols = [part.column(c).to_pylist() for c in range(part.num_columns)]
        for unit, low, high, band, block, *row in zip(*cols, strict=True):
            if key != (unit, low, high, band):
                if held:
                    yield out()
                key, held = (unit, low, high, band), {}
            held.setdefault(block, []).append(row)
    if held:
        yield out()


def _members(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), digest(F.col("text")).alias("key"), "text")


def _loose() -> Column:
    """Whether a group of several sides is compared band by band, by its nodes and the pairs in its bands."""
    return (F.col("blocks") > 1) & (F.col("pairs") < F.col("n") * F.col("n").cast("double"))


def links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per different text: key, node, rep (lowest id), copies, linked documents of other texts, class root."""
    rows = _members(docs).filter(n_words(F.col("text")) > 0)
    signed = rows.select("key", "text").mapInArrow(_signatures, "key binary, sig binary").groupBy("key").agg(F.any_value("sig").alias("sig"))
    copies = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max(n_bytes(F.col("text"))).alias("bytes"))
    # numbers from a saved table stay what they are
    reps = saved(signed.join(copies, "key").withColumn("node", F.monotonically_increasing_id()))
    band = F.posexplode(F.array(*[F.xxhash64(F.substring("sig", 4 * ROWS * j + 1, 4 * ROWS), F.lit(j)) for j in range(BANDS)]))
    bands = reps.select("node", band.alias("k", "band"))
    shared = saved(bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.count("*").alias("n")).filter("hub <> far").drop("far"))
    near = bands.join(shared, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = stars(near)
    groups = saved(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()))
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(SIDE)), F.ceil(F.sum("bytes") / F.lit(SIDE_BYTES))).alias("blocks")
    member = reps.select("node", "rep", "copies", "bytes", "key", "sig").join(groups, "node")
    in_bands = shared.join(groups, F.col("hub") == F.col("node")).groupBy("root").agg(F.sum(F.col("n") * F.col("n").cast("double")).alias("pairs"))
    sizes = member.groupBy("root").agg(F.count("*").alias("n"), blocks).join(in_bands, "root")
    sizes = saved(sizes.withColumn("banded", _loose()))
    whole = member.join(sizes.filter("not banded").select("root", "blocks"), "root").select(F.col("root").alias("unit"), F.lit(0).alias("band"), "blocks", *member.drop("root").columns)
    loose = member.join(sizes.filter("banded").select("root"), "root")
    loose = loose.join(bands, "node").join(shared.select("band"), "band").withColumn("unit", F.col("band")).withColumn("band", F.col("k"))
    loose = loose.join(loose.groupBy("unit").agg(blocks), "unit").select(whole.columns)
    placed = whole.unionByName(loose).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))).drop("bytes")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiles = (
        rows.withColumnRenamed("id", "rep").join(placed, ["key", "rep"])
        .dropDuplicates(["unit", "band", "node"])
        .withColumn("other", other)
        .select("unit", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "band", "block", "node", "copies", "sig", "text")
        .repartition("unit", "low", "high")
        .sortWithinPartitions("unit", "low", "high", "band", "node")
    )
    verified = saved(tiles.mapInArrow(lambda batches: _tiles(batches, threshold), "kind long, x long, y long"))
    counts = verified.filter("kind = 1").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("linked"))
    classes = stars(verified.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
    return (
        reps.drop("sig", "bytes")
        .join(counts, "node", "left")
        .join(classes, "node", "left")
        .select("key", "node", "rep", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "node").alias("root"))
    )


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id (lowest id of its class), copy_of, n_links."""
    nodes = saved(links(docs, threshold))
    lowest = saved(nodes.groupBy("root").agg(F.min("rep").alias("class_id")))
    known = nodes.join(lowest, "root").select("key", "rep", "class_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"))
    rows = _members(docs).select("id", "key", (n_words(F.col("text")) > 0).alias("has_words"))
    blank = rows.filter("not has_words").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    found = rows.filter("has_words").join(known, "key").select("id", "class_id", F.col("rep").alias("copy_of"), "n_links")
    return found.unionByName(blank)


def distinct(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class (that of the lowest doc_id), and every blank one; all columns kept."""
    nodes = saved(links(docs, threshold))
    lowest = nodes.groupBy("root").agg(F.min(F.struct("rep", "key")).alias("first"))
    key, rep = fresh(docs, "_key"), fresh(docs, "_rep")
    kept = lowest.select(F.col("first.key").alias(key), F.col("first.rep").alias(rep))
    has_words = n_words(F.col("text")) > 0
    marked = docs.filter(has_words).withColumn(key, digest(F.col("text"))).withColumn(rep, F.coalesce("doc_id", F.lit(_NO_ID)))
    chosen = marked.join(kept, [key, rep], "left_semi").dropDuplicates([key, rep])
    return chosen.select(docs.columns).unionByName(docs.filter(~has_words))


def op4(docs: DataFrame) -> DataFrame:
    no_id = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return classes(docs.select("doc_id", "text")).select(
        no_id("id").alias("doc_id"), no_id("class_id").alias("class_id"), no_id("copy_of").alias("copy_of"), "n_links"
    )


#: Every pair of different texts that share a shingle, and classes by following links; for small tables.
SQL = rf"""
WITH RECURSIVE rows AS (SELECT doc_id, coalesce(doc_id, {_NO_ID}) AS id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
nodes AS (SELECT text, any_value(w) AS w, min(id) AS rep, count(*) AS copies FROM rows WHERE len(w) > 0 GROUP BY text),
shingles AS (SELECT DISTINCT rep, array_to_string(w[k : k + {SHINGLE - 1}], ' ') AS s FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS k FROM nodes)),
sizes AS (SELECT rep, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
near AS (SELECT a, b FROM pairs JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reached AS (SELECT rep AS a, rep AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS rep, min(b) AS class_id FROM reached GROUP BY 1),
linked AS (SELECT a AS rep, sum(copies) AS n FROM links JOIN nodes ON nodes.rep = b GROUP BY 1)
SELECT r.doc_id, nullif(coalesce(c.class_id, r.id), {_NO_ID}) AS class_id, nullif(coalesce(n.rep, r.id), {_NO_ID}) AS copy_of,
       CAST(CASE WHEN n.rep IS NULL THEN 0 ELSE coalesce(l.n, 0) + n.copies - 1 END AS BIGINT) AS n_links
FROM rows r LEFT JOIN nodes n ON n.text = r.text LEFT JOIN classes c ON c.rep = n.rep LEFT JOIN linked l ON l.rep = n.rep
"""
