"""Exact removal of 50-byte strings that start in a document with a lower id.

Column-wise construction over many documents: aligned strings take in one symbol each per round, from the
right; each round updates, in one sequential pass, the order of all strings by what they have taken in so
far (the Burrows-Wheeler order of that column) and the common prefix of neighbours. After a round,
neighbours with a common prefix of 50 share a 50-byte string. Run on whole texts this would take as many
rounds as the longest text has bytes, so texts are first cut, without loss, into short aligned strings:

A. Each 50-byte window names as its anchor the leftmost 26-byte gram of least hash in it. Equal windows
   have equal anchors at equal offsets, so windows are compared only around equal anchors. Documents are
   dealt into units of a few MB; a unit sends the distinct 32-bit rests of its anchors' hashes to buckets.
B. A bucket answers each unit with one bit an anchor: whether another document may have it.
C. Units send the strings (74 bytes: an anchor with 24 bytes on both sides) around anchors that repeat, each
   different string once with the lowest doc_id that has it.
D. A bucket runs the column-wise construction and answers with 25 bits a string: the windows that start in
   a lower document elsewhere.
E. Units turn the bits into removed spans.

Units and buckets grow in number, not in size, with the input, and a unit writes to the buckets that its
anchors name, so there are never more messages than anchors. A passage that most documents share is one
string a unit. Hashes only sort strings; what is equal is told by the bytes. The texts are shuffled once, and
read from that shuffle in A, C and E.

Defined cases: null and empty texts have no bytes; texts below 50 bytes lose nothing; rows that share a
doc_id are one document in the order; a null doc_id comes after all others; matches are of bytes, so a cut
may split a character and `kept` is binary; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fmix, mixed, n_bytes, powers, prefix_sums

WINDOW = 50
GRAM = 26
REACH = WINDOW - GRAM  # 24: how far an anchor may stand from its window's start
WIDTH = GRAM + 2 * REACH
UNIT_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
STEP = 1 << 17
_LAST = 2**63 - 1
_TOP = np.uint32(2**32 - 1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width]; past the end stands the largest number."""
    out, have = x, 1
    while have < width:
        by = min(have, width - have)
        moved = np.full_like(out, _TOP)
        moved[:-by] = out[by:]
        out, have = np.minimum(out, moved), have + by
    return out


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, hash, first window, last window) of each anchor; its windows are consecutive."""
    n = len(buf)
    none = np.zeros(0, dtype=np.int64)
    if n < WINDOW:
        return none, none, none.astype(np.uint64), none, none
    at = np.arange(n)
    stop = np.repeat(offsets[1:], np.diff(offsets))  # of each byte's document
    grams = n - GRAM + 1
    sums = prefix_sums(buf)
    h = (sums[GRAM:] - sums[:grams]) * powers(n)[1][:grams]
    # the upper halves order the grams; the whole hashes tell them apart
    x = np.full(n, _TOP, dtype=np.uint32)
    x[:grams] = np.minimum(h >> np.uint64(32), _TOP - 1)
    x[at + GRAM > stop] = _TOP
    valid = at + WINDOW <= stop
    least = _sliding_least(x, REACH + 1)
    begins = np.empty(n, dtype=bool)
    begins[0] = valid[0]
    begins[1:] = valid[1:] & (~valid[:-1] | (least[1:] != least[:-1]) | (x[:-1] == least[:-1]))
    ends = np.empty(n, dtype=bool)
    ends[-1] = valid[-1]
    ends[:-1] = valid[:-1] & (~valid[1:] | begins[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    # a least value below the one before has just come in at the window's end; else look for it
    place = first + REACH
    before = np.maximum(first - 1, 0)
    search = np.flatnonzero((first == 0) | ~valid[before] | (least[first] >= least[before]))
    some = first[search]
    place[search] = some + np.argmax(x[some[:, None] + np.arange(REACH + 1)] == least[some][:, None], axis=1)
    # documents touch, but the last windows of one are not valid: no run crosses
    return np.searchsorted(offsets, first, side="right") - 1, place, fmix(h[place]), first, last


_WEIGHTS = mixed(16, 606) | np.uint64(1)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """64 bits that stand for each row of bytes (a multiple of 8 wide)."""
    wide = np.ascontiguousarray(rows).view(np.uint64)
    out = np.zeros(len(rows), dtype=np.uint64)
    for i in range(wide.shape[1]):
        out = (out ^ fmix(wide[:, i] + _WEIGHTS[i])) * _WEIGHTS[i]
    return fmix(out)


def _unlike(rows: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before; the first does."""
    out = np.ones(len(rows), dtype=bool)
    out[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return out


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    if not len(sorted_values):
        return []
    begin = np.flatnonzero(np.diff(sorted_values, prepend=sorted_values[0] - 1))
    return list(zip(sorted_values[begin].tolist(), begin.tolist(), np.append(begin[1:], len(sorted_values)).tolist(), strict=True))


class Unit:
    """The documents of one unit and their anchors."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        self.ids = table["id"].to_numpy()
        column = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
        raw = [x.as_buffer() if x.is_valid else b"" for x in column.cast(pa.large_binary())]
        self.buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        parts, row = [], 0
        while row < len(raw):
            end = max(row + 1, int(np.searchsorted(self.offsets, self.offsets[row] + STEP, side="right")) - 1)
            base = self.offsets[row]
            doc, place, h, first, last = anchors(self.buf[base : self.offsets[end]], self.offsets[row : end + 1] - base)
            parts.append((doc + row, place + base, h, first + base, last + base))
            row = end
        self.doc, self.place, h, self.first, self.last = (
            np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64 if k == 2 else np.int64) for k in range(5)
        )
        q = np.uint64(buckets)
        self.key = ((h % q) << np.uint64(32)) | ((h // q) & np.uint64(0xFFFFFFFF))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The different keys, and whether more than one document of this unit has them."""
        order = np.argsort(self.key, kind="stable")
        key, owner = self.key[order], self.ids[self.doc[order]]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        if not len(begin):
            return key, np.zeros(0, bool)
        return key[begin], np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)

    def repeated(self, answers: pa.Table) -> np.ndarray:
        """The anchors that step B marked."""
        keys, _ = self.distinct()
        marks = np.zeros(len(keys), dtype=bool)
        for bucket, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            lo, hi = np.searchsorted(keys, [np.uint64(bucket) << np.uint64(32), np.uint64(bucket + 1) << np.uint64(32)])
            marks[lo:hi] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=hi - lo).astype(bool)
        return np.flatnonzero(marks[np.searchsorted(keys, self.key)])

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket + string + window range as sorted distinct rows, row of each chosen anchor, lowest ids).

        A string has zeros outside the bytes of its windows, and its last two bytes are the range of
        offsets from window start to anchor.
        """
        place, first, last = self.place[chosen], self.first[chosen], self.last[chosen]
        cols = place[:, None] - REACH + np.arange(WIDTH)
        inside = (cols >= first[:, None]) & (cols < last[:, None] + WINDOW)
        made = np.empty((len(chosen), 4 + WIDTH + 2), dtype=np.uint8)
        made[:, :4] = (self.key[chosen] >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
        made[:, 4:-2] = np.where(inside, self.buf[np.clip(cols, 0, max(len(self.buf) - 1, 0))], 0) if len(chosen) else 0
        made[:, -2], made[:, -1] = place - last, place - first
        # rows by bucket, then by hash: equal neighbours, byte by byte, become one. Rows that a clash of hashes
        # keeps from meeting stay several; the rounds find what they have in common
        bucket, mark = made[:, :4].copy().view(">u4").ravel(), _row_hash(made)
        order = np.lexsort((mark, bucket))
        new = _unlike(made[order])
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        low = np.full(int(new.sum()), _LAST, dtype=np.int64)
        np.minimum.at(low, which, self.ids[self.doc[chosen]])
        return made[order[new]], which, low


def common_windows(strings: np.ndarray, near: np.ndarray, far: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bit o of row i: the window that starts o bytes before the anchor is valid in string i (near <= o <=
    far) and is also a valid window of a string with a lower id.

    One column a round, from the right: a stable distribution by symbol gives the new order; neighbours with
    the same symbol have one more than the least common prefix between their former places.
    """
    n = len(strings)
    order = np.arange(n)
    common = np.zeros(n, dtype=np.uint8)  # with the string before, up to WINDOW
    out = np.zeros(n, dtype=np.uint32)
    for column in range(WIDTH - 1, -1, -1):
        symbol = strings[order, column]
        moved = np.argsort(symbol, kind="stable")
        same = np.concatenate(([False], symbol[moved[1:]] == symbol[moved[:-1]]))
        # least of common[previous place + 1 .. place], by a table of power-of-two ranges
        begin, stop = np.where(same, np.concatenate(([0], moved[:-1])) + 1, moved), moved + 1
        level = np.frexp((stop - begin).astype(np.float64))[1] - 1
        least, table = np.zeros(n, dtype=np.uint8), common
        for k in range(int(level.max(initial=0)) + 1):
            if k:
                half = 1 << (k - 1)
                table = np.minimum(table[:-half], table[half:])
            here = np.flatnonzero(level == k)
            least[here] = np.minimum(table[begin[here]], table[stop[here] - (1 << k)])
        order = order[moved]
        common = np.where(same, np.minimum(least + 1, WINDOW), 0).astype(np.uint8)
        offset = REACH - column
        if offset < 0:
            continue
        member = (near[order] <= offset) & (far[order] >= offset)
        group = np.cumsum(common < WINDOW) - 1
        group, string = group[member], order[member]
        if not len(string):
            continue
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        low = np.repeat(np.minimum.reduceat(ids[string], start), np.diff(np.append(start, len(string))))
        out[string] |= (low < ids[string]).astype(np.uint32) << np.uint32(offset)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, spans): what remains of each text, and the removed byte ranges."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "text")
    total = rows.agg(F.sum(n_bytes(F.col("text")))).first()[0] or 0
    units = max(1, -(-total // UNIT_BYTES))
    q = max(1, -(-total // BUCKET_BYTES))
    dealt = rows.withColumn("unit", F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(units)).cast("long"))

    def ask(table: pa.Table) -> pa.Table:
        unit = Unit(table, q)
        keys, here = unit.distinct()
        out: list[tuple] = []
        rests = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        for b, lo, hi in _runs((keys >> np.uint64(32)).astype(np.int64)):
            out.append((b, rests[lo:hi].tobytes(), np.packbits(here[lo:hi]).tobytes()))
        name = table["unit"][0].as_py()
        kinds = (pa.int64(), pa.binary(), pa.binary())
        cols = [pa.array([x[k] for x in out], kinds[k]) for k in range(3)]
        return pa.Table.from_arrays([cols[0], pa.array([name] * len(out), pa.int64()), *cols[1:]], ["bucket", "unit", "rests", "here"])

    def answer(table: pa.Table) -> pa.Table:
        rests = [np.frombuffer(x, dtype="<u4") for x in table["rests"].to_pylist()]
        here = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(r)).astype(bool) for x, r in zip(table["here"].to_pylist(), rests, strict=True)]
        values, at, n = np.unique(np.concatenate(rests), return_inverse=True, return_counts=True)
        marked = n > 1
        marked[at[np.concatenate(here)]] = True
        bits, begin = [], 0
        for r in rests:
            bits.append(np.packbits(marked[at[begin : begin + len(r)]]).tobytes())
            begin += len(r)
        return pa.Table.from_arrays([table["unit"], table["bucket"], pa.array(bits, pa.binary())], ["unit", "bucket", "bits"])

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        name = None
        if table.num_rows and answers.num_rows:
            name, unit = table["unit"][0].as_py(), Unit(table, q)
            strings, _, low = unit.strings(unit.repeated(answers))
            bucket = strings[:, :4].copy().view(">u4").ravel().astype(np.int64)
            for b, lo, hi in _runs(bucket):
                out.append((b, strings[lo:hi, 4:].tobytes(), low[lo:hi].tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary())
        cols = [pa.array([x[k] for x in out], kinds[k]) for k in range(3)]
        return pa.Table.from_arrays([cols[0], pa.array([name] * len(out), pa.int64()), *cols[1:]], ["bucket", "unit", "strings", "low"])

    def compare(table: pa.Table) -> pa.Table:
        made = [np.frombuffer(x, dtype=np.uint8).reshape(-1, WIDTH + 2) for x in table["strings"].to_pylist()]
        ids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table["low"].to_pylist()])
        whole = np.concatenate(made)
        # units send the same strings: each is compared once, with its lowest document; equal by their bytes
        order = np.argsort(_row_hash(np.pad(whole, ((0, 0), (4, 0)))), kind="stable")
        new = _unlike(whole[order])
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        distinct = whole[order[new]]
        low = np.full(len(distinct), _LAST, dtype=np.int64)
        np.minimum.at(low, which, ids)
        bits = common_windows(np.asfortranarray(distinct[:, :-2]), distinct[:, -2], distinct[:, -1], low)[which]
        # a lower document with the same string has all of its windows
        bits = np.where(low[which] < ids, np.uint32(0xFFFFFFFF), bits)
        out, begin = [], 0
        for x in made:
            out.append(bits[begin : begin + len(x)].tobytes())
            begin += len(x)
        return pa.Table.from_arrays([table["unit"], table["bucket"], pa.array(out, pa.binary())], ["unit", "bucket", "windows"])

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        unit = Unit(table, q)
        covered = np.zeros(len(unit.buf) + 1, dtype=np.int32)
        asked = replies.filter(replies["bits"].is_valid()) if replies.num_rows else replies
        told = replies.filter(replies["windows"].is_valid()) if replies.num_rows else replies
        if told.num_rows:
            chosen = unit.repeated(asked)
            strings, which, low = unit.strings(chosen)
            bucket = strings[:, :4].copy().view(">u4").ravel().astype(np.int64)
            bits = np.zeros(len(strings), dtype=np.uint32)
            for b, raw in zip(told["bucket"].to_pylist(), told["windows"].to_pylist(), strict=True):
                lo, hi = np.searchsorted(bucket, [b, b + 1])
                bits[lo:hi] = np.frombuffer(raw, dtype=np.uint32)
            # a lower document of this unit with the same string has all its windows
            mine = np.where(unit.ids[unit.doc[chosen]] > low[which], np.uint32(0xFFFFFFFF), bits[which])
            for offset in range(REACH + 1):
                start = unit.place[chosen] - offset
                gone = start[((mine >> np.uint32(offset)) & 1).astype(bool) & (start >= unit.first[chosen]) & (start <= unit.last[chosen])]
                np.add.at(covered, gone, 1)
                np.add.at(covered, gone + WINDOW, -1)
        inside = np.cumsum(covered[:-1]) > 0
        kept, spans = [], []
        for d in range(len(unit.ids)):
            a, b = unit.offsets[d], unit.offsets[d + 1]
            step = np.diff(np.concatenate(([0], inside[a:b].astype(np.int8), [0])))
            spans.append([[int(x), int(y)] for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
            kept.append(unit.buf[a:b][~inside[a:b]].tobytes())
        return pa.Table.from_arrays(
            [table["doc_id"], pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(np.diff(unit.offsets))],
            ["doc_id", "kept", "spans", "n_bytes"],
        )

    marks = dealt.groupBy("unit").applyInArrow(ask, "bucket long, unit long, rests binary, here binary")
    marks = marks.groupBy("bucket").applyInArrow(answer, "unit long, bucket long, bits binary")
    sent = dealt.groupBy("unit").cogroup(marks.groupBy("unit")).applyInArrow(send, "bucket long, unit long, strings binary, low binary")
    windows = sent.groupBy("bucket").applyInArrow(compare, "unit long, bucket long, windows binary")
    none = F.lit(None).cast("binary")
    replies = marks.withColumn("windows", none).unionByName(windows.select("unit", "bucket", none.alias("bits"), "windows"))
    kind = dict(docs.dtypes)["doc_id"]
    return dealt.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(remove, f"doc_id {kind}, kept binary, spans array<array<long>>, n_bytes long")


def op6(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), with every window in one dictionary; for tests."""
    low: dict[bytes, int] = {}
    raws = {i: (t or "").encode() for i, t in docs}
    for i in sorted(raws):
        for p in range(len(raws[i]) - WINDOW + 1):
            low.setdefault(raws[i][p : p + WINDOW], i)
    out = {}
    for i, raw in raws.items():
        gone = np.zeros(len(raw), dtype=np.int8)
        for p in range(len(raw) - WINDOW + 1):
            if low[raw[p : p + WINDOW]] < i:
                gone[p : p + WINDOW] = 1
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {_LAST}) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT r, id, b, substr(h, 400 * b + 1, {400 + 2 * WINDOW - 2}) AS x FROM (SELECT r, id, h, unnest(range(0, (len(h) // 2 - {WINDOW}) // 200 + 1)) AS b FROM d WHERE len(h) >= {2 * WINDOW})),
strings AS (SELECT r, id, 200 * b + j AS i, substr(x, 2 * j + 1, {2 * WINDOW}) AS s FROM (SELECT r, id, b, x, unnest(range(0, len(x) // 2 - {WINDOW - 1})) AS j FROM blocks)),
low AS (SELECT s, min(id) AS least FROM strings GROUP BY s HAVING min(id) < max(id)),
hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM strings JOIN low USING (s) WHERE id > least),
numbered AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + {WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hits),
runs AS (SELECT r, min(i) AS a, max(i) + {WINDOW} AS b FROM numbered GROUP BY r, run),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS free FROM runs),
cut AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) AS kept
  FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
