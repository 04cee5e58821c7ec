"""Merkle fixity audit of record archives (WARC): find damaged records by comparing two replicas' trees.

A leaf covers one (archive, offset): the SHA-256 of the record's bytes. Equal places may hold several
records (copies, or rows without a place), so a leaf is the SHA-256 of the count and of eight sums over
32-bit lanes of their digests, a multiset hash that aggregates before the shuffle. Leaves are ordered by
offset and cut into ranges of `RANGE_BYTES`; a range's hash covers its leaves in order, and every further
level covers `FANOUT` nodes of the level below, up to one root an archive. An audit compares roots and
descends, level by level, only below nodes that differ, down to the damaged leaves.

Defined cases: a null archive or offset is a place of its own; null content differs from empty content;
repeated records count; an archive that only one replica has is all missing or all extra; empty tables
give an empty report; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved

RANGE_BYTES = 1 << 18
FANOUT = 16
LANES = 8
RECORDS_PER_ARCHIVE = 1000


def leaves(records: DataFrame) -> DataFrame:
    """(archive, offset, n, leaf, first_id) from records (archive, offset, content, record_id)."""
    sha = F.sha2(F.coalesce(F.concat(F.lit("v"), F.col("content")), F.lit("n")), 256)
    lanes = [F.sum(F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long")).cast("string").alias(f"s{i}") for i in range(LANES)]
    sums = (
        records.select("archive", F.col("offset").cast("long").alias("offset"), "record_id", sha.alias("sha"))
        .groupBy("archive", "offset")
        .agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"), *lanes)
    )
    parts = [F.col("n").cast("string"), *[F.col(f"s{i}") for i in range(LANES)]]
    return sums.select("archive", "offset", "n", "first_id", F.sha2(F.concat_ws(",", *parts), 256).alias("leaf"))


def _parent(children: DataFrame, hash_column: str, order: str) -> DataFrame:
    inside = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(hash_column).alias("h"))))
    text = F.concat_ws(",", F.transform(inside, lambda x: F.concat_ws(":", F.coalesce(x["o"].cast("string"), F.lit("n")), x["h"])))
    return children.groupBy("archive", "node").agg(F.sha2(text, 256).alias("hash"))


def tree(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, int]:
    """(leaves, nodes, top level): nodes are (archive, level, node, hash), level 0 the offset ranges."""
    own = saved(leaves(records).withColumn("node", F.coalesce(F.floor(F.col("offset") / range_bytes), F.lit(-1))))
    level0 = _parent(own, "leaf", "offset")
    # a null offset is range -1; one more keeps parents non-negative
    nodes = saved(level0.select("archive", F.lit(0).alias("level"), (F.col("node") + 1).alias("node"), "hash"))
    last = nodes.agg(F.max("node")).first()[0] or 0
    levels, top, below = [nodes], 0, nodes
    while last > 0:
        top, last = top + 1, last // fanout
        up = below.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / fanout))
        below = _parent(up, "hash", "child").select("archive", F.lit(top).alias("level"), "node", "hash")
        levels.append(below)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return own, saved(out), top


def _differing(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value is not the same on both sides, or that one side lacks."""
    both = a.select(*keys, F.lit(0).alias("side"), value).unionByName(b.select(*keys, F.lit(1).alias("side"), value))
    sides = both.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col(value))).alias("x"), F.max(F.when(F.col("side") == 1, F.col(value))).alias("y"))
    return sides.filter(~F.col("x").eqNullSafe(F.col("y"))).select(*keys)


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Damaged places of the replica: archive, offset, record_id, status, records on both sides."""
    a_leaves, a_nodes, a_top = tree(primary, range_bytes, fanout)
    b_leaves, b_nodes, b_top = tree(replica, range_bytes, fanout)
    top = max(a_top, b_top)
    keys = ["archive", "node"]
    suspect = None
    for level in range(top, -1, -1):
        a, b = (x.filter(F.col("level") == level) for x in (a_nodes, b_nodes))
        if suspect is not None:
            parent = suspect.withColumnRenamed("node", "up").withColumnRenamed("archive", "of")
            near = lambda x, parent=parent: x.join(parent, x["archive"].eqNullSafe(parent["of"]) & (F.floor(x["node"] / fanout) == parent["up"]), "left_semi")
            a, b = near(a), near(b)
        # levels that only one replica has (its archive is longer) differ at the top anyway
        suspect = _differing(a, b, keys, "hash")
        if level == min(a_top, b_top) and a_top != b_top:
            a, b = (x.filter(F.col("level") == level) for x in (a_nodes, b_nodes))
            suspect = _differing(a, b, keys, "hash")
    suspect = suspect.select(F.col("archive").alias("of"), (F.col("node") - 1).alias("range"))
    inside = lambda x: x.join(suspect, x["archive"].eqNullSafe(suspect["of"]) & (x["node"] == suspect["range"]), "left_semi")
    side = lambda x, k: inside(x).select("archive", "offset", F.lit(k).alias("side"), "n", "leaf", "first_id")
    both = side(a_leaves, 0).unionByName(side(b_leaves, 1))
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    places = both.groupBy("archive", "offset").agg(
        of(0, "leaf").alias("x"), of(1, "leaf").alias("y"), of(0, "n").alias("n_primary"), of(1, "n").alias("n_replica"), F.min("first_id").alias("record_id")
    )
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed")
    return places.filter(~F.col("x").eqNullSafe(F.col("y"))).select(
        "archive", "offset", "record_id", status.alias("status"),
        F.coalesce("n_primary", F.lit(0)).alias("n_primary"), F.coalesce("n_replica", F.lit(0)).alias("n_replica"),
    )


def archived(pages: DataFrame, per_archive: int = RECORDS_PER_ARCHIVE) -> DataFrame:
    """Pages as WARC response records (archive, offset, content, record_id).

    An archive holds the pages of `per_archive` consecutive ids in order; equal ids share one place, as long
    as the longest of them. Offsets are running sums over an archive's places, so no window is larger.
    """
    page_id = F.col("page_id").cast("long")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n\r\n"),
    )
    rows = pages.select(
        page_id.alias("record_id"),
        F.format_string("crawl-%06d", F.floor(page_id / per_archive)).alias("archive"),
        F.concat(head, F.coalesce("html", F.lit("")), F.lit("\r\n\r\n")).alias("content"),
    ).withColumn("archive", F.when(F.col("record_id").isNotNull(), F.col("archive")))
    places = rows.groupBy("archive", "record_id").agg(F.max(F.octet_length("content")).cast("long").alias("length"))
    before = W.partitionBy("archive").orderBy("record_id").rowsBetween(W.unboundedPreceding, -1)
    places = places.filter("record_id is not null").select(
        F.col("record_id").alias("id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    )
    return rows.join(places, rows["record_id"] == places["id"], "left").select("archive", "offset", "content", "record_id")


def damaged_copy(records: DataFrame) -> DataFrame:
    """A replica with faults by a fixed rule: of 101 ids, one has its last letters overwritten, one is
    missing, and one has a second record at its place."""
    k = F.pmod(F.col("record_id") * 7919, F.lit(101))
    content = F.when(k == 0, F.concat(F.expr("substring(content, 1, length(content) - 4)"), F.lit("#"), F.lit("\r\n\r"))).otherwise(F.col("content"))
    copies = F.when(k == 1, F.array()).when(k == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    changed = records.withColumn("content", content).withColumn("copy", F.explode(F.coalesce(copies, F.array(F.lit(1)))))
    return changed.drop("copy")


def op1(pages: DataFrame) -> DataFrame:
    records = archived(pages)
    return audit(records, damaged_copy(records))


SQL = r"""
WITH places AS (
  SELECT page_id, printf('crawl-%06d', page_id // 1000) AS archive,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS content
  FROM pages),
placed AS (
  SELECT *, coalesce(sum(strlen(content)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset",
         (page_id * 7919) % 101 AS k
  FROM places)
SELECT archive, CAST("offset" AS BIGINT) AS "offset", page_id AS record_id,
       CASE k WHEN 1 THEN 'missing' ELSE 'changed' END AS status,
       CAST(1 AS BIGINT) AS n_primary, CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS BIGINT) AS n_replica
FROM placed WHERE k IN (0, 1, 2)
"""
