"""Prefix trie of conversations by burst tries: which openings are shared, by whom, and what sharing them saves.

A conversation is a sequence of turns, a turn's id the MD5 of its role and text, so that texts are read once and never
shuffled. Equal sequences are one with their number of conversations. A container holds the rests of all sequences
below one trie head. The first head is the root. A container of more than `CONTAINER` turns is burst: the turns that all
its rests begin with become one edge of the trie with a head at its end, and the rests go on by their next turn id into
containers below that head. The others are dealt to shards, where a container's rests are sorted and swept once, each
rest against the one before: what it no longer shares is closed, and each closed node knows its members and its subtree.
Sums of containers and edges are added to the heads above them.

No task holds more than a container: a long sequence by itself is an edge, whose nodes are rows that know their place
by sums over blocks of turns. Rounds are as many as branchings lie above each other in containers that are too large.
The list of a node's ends is hashed as a stream of sorted ids.

Defined cases: null conversation ids are left out; null turns come first; turns of one number follow by turn id; null
role or text is empty; repeated rows are turns of their own; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import n_partitions, saved

#: Turns in a container that a task holds while it sweeps it.
CONTAINER = 1 << 15
#: Turns of a conversation in one window.
BLOCK = 1024
ROOT = hashlib.md5(b"").digest()
_NODE = "box binary, path array<binary>, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_seq long"


def _running(rows: DataFrame, key: str, block: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """rows with the running sum of `value` in the order of block and `order`; no window is longer than a block."""
    rows = rows.withColumn("_block", block).withColumn("_value", value)
    sums = rows.groupBy(key, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = W.partitionBy(key).orderBy(F.asc_nulls_first("_block")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum("_value").over(W.partitionBy(key, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("_inside", inside).join(sums, (F.col(key) == F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")))
    return placed.withColumn(out, F.col("_before") + F.col("_inside")).drop("_block", "_value", "_key", "_of", "_before", "_inside")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, n_bytes): the turns of each conversation in order, pos from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.col("turn").cast("long")
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    block = F.col("turn") - F.pmod(F.col("turn"), F.lit(BLOCK))
    return _running(rows, "conv_id", block, [F.asc_nulls_first("turn"), F.col("id")], F.lit(1).cast("long"), "pos").drop("turn")


def sequences(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, conv_id) for each conversation, seq the least with the same turns; (seq, len, n): the distinct sequences."""
    # sums of hashes that know the place: the same for equal sequences, whatever the order of adding
    lanes = [F.sum(F.xxhash64("id", "pos", F.lit(k)).bitwiseAND(0xFFFFFFFF)).alias(f"_{k}") for k in range(4)]
    marks = rows.groupBy("conv_id").agg(F.count("*").alias("len"), *lanes)
    marks = convs.select("conv_id").join(marks, "conv_id", "left").na.fill(0)
    key = ["len", *[f"_{k}" for k in range(4)]]
    kinds = saved(marks.groupBy(*key).agg(F.min("conv_id").alias("seq"), F.count("*").alias("n")))
    return saved(marks.join(kinds.drop("n"), key).select("seq", "conv_id")), kinds.select("seq", "len", "n")


def ends(members: DataFrame) -> DataFrame:
    """(end_seq, sha): SHA-256 of the ascending ids of the conversations that are this sequence, hashed as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            out = []
            for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq != last:
                    out += [(last, sha.hexdigest())] if sha else []
                    last, sha = seq, hashlib.sha256(b"%d" % conv)
                else:
                    sha.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["end_seq", "sha"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["end_seq", "sha"])

    return members.repartition(n_partitions(members.sparkSession), "seq").sortWithinPartitions("seq", "conv_id").mapInArrow(run, "end_seq long, sha string")


def burst(rows: DataFrame, kinds: DataFrame, container: int) -> tuple[DataFrame, DataFrame]:
    """(containers, edges). Containers: (box, path, up, depth, seq, n), a row for each rest below the head that ends
    `path`, `up` its smallest member. Edges: (box, path, up, first, depth, conv_id, n_convs, end_seq), those of the heads:
    the nodes at depths first + 1 to depth with all of a container's members."""
    root = F.lit(bytearray(ROOT))
    start = kinds.agg(F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs"), F.min(F.when(F.col("len") == 0, F.col("seq"))).alias("end_seq"))
    start = saved(start.filter("conv_id is not null")).select(
        root.alias("box"), F.array().cast("array<binary>").alias("path"), F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", "end_seq"
    )
    edges, done = [start], []
    first = rows.filter("pos = 1").select(F.col("seq"), F.unhex(F.md5(F.concat(root, F.col("id")))).alias("box"))
    least = start.first()
    up = F.lit(least and least["conv_id"]).cast("long").alias("up")
    live = saved(kinds.filter("len > 0").join(first, "seq").select("box", F.array(root).alias("path"), up, F.lit(0).cast("long").alias("depth"), "seq", "len", "n"))
    while True:
        sizes = live.groupBy("box").agg(F.sum(F.col("len") - F.col("depth")).alias("size"), F.count("*").alias("rests"), F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs"))
        large = saved(sizes.filter(F.col("size") > container))
        if not large.take(1):
            done.append(live.drop("len"))
            break
        done.append(live.join(large, "box", "left_anti").drop("len"))
        over = live.join(large.drop("n_convs", "size"), "box")
        rest = over.select("box", "seq", "depth", "rests").join(rows.select("seq", "pos", "id"), "seq").filter("pos > depth")
        level = rest.groupBy("box", "pos").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("m"), F.first("rests").alias("rests"))
        apart = F.when((F.col("least") != F.col("most")) | (F.col("m") < F.col("rests")), F.col("pos") - 1)
        shared = saved(level.groupBy("box").agg(F.coalesce(F.min(apart), F.max("pos")).alias("to")))
        over = over.join(shared, "box")
        edge = over.groupBy("box").agg(*[F.first(c).alias(c) for c in ("path", "up")], F.first("depth").alias("first"), F.first("to").alias("depth"), F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.min(F.when(F.col("len") == F.col("to"), F.col("seq"))).alias("end_seq"))
        edges.append(saved(edge))
        following = over.filter("len > to").join(rows.select("seq", "pos", "id"), "seq").filter("pos = to + 1")
        live = saved(following.select(F.unhex(F.md5(F.concat("box", "id"))).alias("box"), F.concat("path", F.array("box")).alias("path"), F.col("conv_id").alias("up"), F.col("to").alias("depth"), "seq", "len", "n"))
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, edges)


def _member(node: dict, conv: int) -> None:
    node["conv_id"] = conv if node["conv_id"] is None else min(node["conv_id"], conv)


def _close(open_: list, out: list) -> None:
    """Ends the last open node: its children get their parent, and it is added to the node above."""
    node = open_.pop()
    if not node["n_children"]:
        node["n_leaves"] = 1
    node["saved_tokens"] += (node["n_convs"] - 1) * node.pop("bytes")
    for child in node.pop("children"):
        out.append(child | {"parent_conv_id": node["conv_id"]})
    above = open_[-1]
    _member(above, node["conv_id"])
    for c in ("n_convs", "n_leaves", "saved_tokens"):
        above[c] += node[c]
    above["n_children"] += 1
    above["children"].append(node)


def _open(box: bytes, depth: int, n_bytes: int) -> dict:
    return {"box": box, "path": None, "depth": depth, "conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "end_seq": None, "bytes": n_bytes, "children": []}


def swept(rests: list[dict]) -> list[dict]:
    """The nodes of a container from its rests in order of their turn ids. Its top node carries the path."""
    head = rests[0]
    open_, out, before = [_open(head["box"], head["depth"], 0)], [], []
    for rest in rests:
        ids = rest["ids"]
        same = next((i for i, (a, b) in enumerate(zip(ids, before, strict=False)) if a != b), min(len(ids), len(before)))
        while len(open_) > same + 1:
            _close(open_, out)
        for i in range(same, len(ids)):
            open_.append(_open(head["box"], head["depth"] + i + 1, rest["sizes"][i]))
        last = open_[-1]
        last["end_seq"], last["n_convs"] = rest["seq"], last["n_convs"] + rest["n"]
        _member(last, rest["seq"])
        before = ids
    while len(open_) > 1:
        _close(open_, out)
    return out + [top | {"parent_conv_id": head["up"], "path": head["path"]} for top in open_[0]["children"]]


def sweep(containers: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of all containers, those of a shard one after the other."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "id", "n_bytes")))
    rests = containers.join(rows.select("seq", "pos", "id", "n_bytes"), "seq").filter("pos > depth")
    rests = rests.groupBy("box", "path", "up", "depth", "seq", "n").agg(parts.alias("parts"))
    rests = rests.select("box", "path", "up", "depth", "seq", "n", F.transform("parts", lambda p: p["id"]).alias("ids"), F.transform("parts", lambda p: p["n_bytes"]).alias("sizes"))
    shards = rests.repartition(n_partitions(rows.sparkSession), "box").sortWithinPartitions("box", "ids")
    names = [c.split(" ")[0] for c in _NODE.split(", ")]
    kinds = pa.schema([(n, pa.list_(pa.binary()) if n == "path" else pa.binary() if n == "box" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for rest in batch.to_pylist():
                if held and held[0]["box"] != rest["box"]:
                    out += swept(held)
                    held = []
                held.append(rest)
            yield pa.RecordBatch.from_pylist(out, kinds)
        yield pa.RecordBatch.from_pylist(swept(held) if held else [], kinds)

    return shards.mapInArrow(run, _NODE)


def trie(rows: DataFrame, convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of (conv_id, pos, id, n_bytes) over all conv_id of `convs`: smallest member, depth, its
    parent's smallest member, members, children, leaves and saved bytes below, and the hash of those that end here."""
    members, kinds = sequences(rows, convs)
    rows = rows.join(kinds.select(F.col("seq").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "seq")
    rows = saved(_running(rows, "seq", F.col("pos") - F.pmod("pos", F.lit(BLOCK)), [F.col("pos")], F.col("n_bytes"), "upto"))
    containers, edges = burst(rows, kinds, container)
    inner = saved(sweep(containers, rows))
    # an edge's own bytes, then the sums of all that lies below each head
    along = edges.join(rows.select("seq", "pos", "n_bytes"), (F.col("conv_id") == F.col("seq")) & (F.col("pos") <= F.col("depth")), "left")
    bytes_ = lambda when: F.coalesce(F.sum(F.when(when, F.col("n_bytes"))), F.lit(0))
    along = saved(along.groupBy("box").agg(bytes_(F.col("pos") > F.col("first")).alias("own"), bytes_(F.col("pos") <= F.col("first")).alias("above")))
    heads = edges.join(along, "box")
    tops = inner.filter("path is not null").select("path", "n_leaves", "saved_tokens")
    children = tops.select("path").union(heads.filter(F.size("path") > 0).select("path")).groupBy(F.try_element_at("path", F.lit(-1)).alias("box")).agg(F.count("*").alias("n_children"))
    heads = saved(heads.join(children, "box", "left").na.fill(0, ["n_children"]))
    own = heads.select(F.concat("path", F.array("box")).alias("path"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("own")).alias("saved_tokens"))
    below = tops.union(own).select(F.explode("path").alias("box"), "n_leaves", "saved_tokens").groupBy("box").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    heads = heads.join(below, "box")
    last = F.col("pos") == F.col("depth")
    passed = (F.col("n_convs") - 1) * (F.col("upto") - F.col("n_bytes") - F.col("above"))
    nodes = heads.join(rows.select("seq", "pos", "n_bytes", "upto"), (F.col("conv_id") == F.col("seq")) & (F.col("pos") > F.col("first")) & (F.col("pos") <= F.col("depth")))
    nodes = nodes.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("first") + 1, F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("saved_tokens") - passed).alias("saved_tokens"), F.when(last, F.col("end_seq")).alias("end_seq"),
    )
    top = heads.filter(F.size("path") == 0).select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "end_seq")
    every = top.unionByName(nodes).unionByName(inner.select(*top.columns))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(ends(members), "end_seq", "left").select(*top.columns[:-1], F.coalesce("sha", none).alias("ends_sha256"))


def rebuilt(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns of (conv_id, pos, id, n_bytes) as op11 wants them: the first h of the conversation c - c % 5, then c's own
    after its first h, h the CRC-32 of c in decimals modulo 9."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("size"))
    asked = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 9).alias("h"))
    asked = asked.join(sizes.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("taken", F.least("h", F.coalesce("size", F.lit(0))))
    heads = rows.filter("pos <= 8").withColumnRenamed("conv_id", "base")
    opening = asked.select("conv_id", "base", "h").join(heads, "base").filter("pos <= h").select("conv_id", "pos", "id", "n_bytes")
    own = rows.join(asked.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    return opening.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "n_bytes"))


def op11(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    rows = saved(turns(conversations.select("conv_id", "turn", "role", "text")))
    convs = rows.select("conv_id").distinct()
    return trie(saved(rebuilt(rows, convs)), convs, container)


SQL = r"""
WITH own AS (
  SELECT conv_id, turn, md5(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS id, strlen(coalesce(text, '')) AS n_bytes
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, id, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM own),
sizes AS (SELECT conv_id, count(*) AS size FROM own GROUP BY 1),
asked AS (
  SELECT s.conv_id, s.conv_id - s.conv_id % 5 AS base, coalesce(b.size, 0) AS size, xor(4294967295::UBIGINT,
    list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(s.conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)::UBIGINT[]), lambda p, q: xor(p >> 1, CASE WHEN p % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))) % 9 AS h
  FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 5),
rebuilt AS (
  SELECT a.conv_id, p.pos, p.id, p.n_bytes FROM asked a JOIN placed p ON p.conv_id = a.base AND p.pos <= a.h
  UNION ALL SELECT a.conv_id, p.pos - a.h + least(a.h, a.size), p.id, p.n_bytes FROM asked a JOIN placed p ON p.conv_id = a.conv_id AND p.pos > a.h),
places AS (
  SELECT conv_id, CAST(pos AS BIGINT) AS depth, string_agg(id, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path, n_bytes FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM asked),
lengths AS (SELECT conv_id, max(depth) AS len FROM places GROUP BY 1),
nodes AS (
  SELECT depth, path, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE len = depth) AS ends
  FROM places p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY 1, 2),
children AS (SELECT depth - 1 AS depth, left(path, -32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path),
below AS (
  SELECT a.depth, a.path, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved_tokens
  FROM full_nodes n JOIN places a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN below b ON b.depth = n.depth AND b.path = n.path LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.path = left(n.path, -32)
"""
