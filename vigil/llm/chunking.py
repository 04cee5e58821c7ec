"""Substring deduplication by content-defined chunks with a gear rolling hash.

The gear hash of a position adds one fixed random number for each of the 16 bytes up to it, each doubled
once more for every byte that follows. A chunk ends where the hash is the least within `REACH` positions on
both sides, so cuts depend only on nearby bytes: an insertion moves no cut further than 2 * REACH + 16 bytes
away, chunks are at least REACH + 1 bytes long and about twice that on average. Chunks are compared by
128-bit digest; the occurrence in the lowest doc_id (there, the first) stays, every other is removed.

Cuts never split a UTF-8 character. A head or tail shorter than `REACH` joins its neighbour; a shorter
document is one chunk.

Defined cases: null and empty texts have no chunk; rows that share a doc_id are one document in the order,
so a repeated row removes nothing from its twin; a null doc_id comes after all others; a text without a
cut (one repeated byte) is one chunk; texts of any length are read whole; empty tables give empty results;
`dedup` keeps extra columns, replacing `kept`, `spans` and `n_chunks`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, mixed, saved, text_steps

REACH = 32
GEAR_BYTES = 16
_GEAR = (mixed(256, 77) >> np.uint64(32)).astype(np.uint32)
_LAST = 2**63 - 1


def _behind(x: np.ndarray, by: int, fill) -> np.ndarray:
    """x moved to higher positions by `by`."""
    out = np.full_like(x, fill)
    out[by:] = x[:-by] if by < len(x) else x[:0]
    return out


def cuts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each chunk, in order, as positions of the buffer."""
    docs = len(offsets) - 1
    gap = 2 * REACH  # between documents, so that neither hashes nor minima reach across
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    at = np.arange(len(buf)) + gap * (doc + 1)
    size = len(buf) + gap * (docs + 1)
    hashes = np.zeros(size, dtype=np.uint32)
    hashes[at] = _GEAR[buf]
    step = 1
    while step < GEAR_BYTES:
        hashes = hashes + (_behind(hashes, step, 0) << np.uint32(step))
        step *= 2
    top = np.uint32(0xFFFFFFFF)
    own = np.full(size, top, dtype=np.uint32)
    own[at] = np.minimum(hashes[at], top - np.uint32(1))
    least, width = own, 1  # least of the width positions up to here
    while width < REACH:
        by = min(width, REACH - width)
        least, width = np.minimum(least, _behind(least, by, top)), width + by
    before = _behind(least, 1, top)
    after = np.full(size, top, dtype=np.uint32)
    after[:-REACH] = least[REACH:]
    inside = np.arange(len(buf)) - offsets[doc]
    end = np.flatnonzero((own[at] < before[at]) & (own[at] <= after[at]) & (inside >= GEAR_BYTES)) + 1
    of = doc[end - 1]
    for _ in range(3):
        end = end + ((end < offsets[of + 1]) & ((buf[np.minimum(end, len(buf) - 1)] & 0xC0) == 0x80))
    keep = (offsets[of + 1] - end >= REACH) & (end - offsets[of] >= REACH)
    keep[1:] &= (end[1:] > end[:-1]) | (of[1:] != of[:-1])
    full = np.flatnonzero(np.diff(offsets) > 0)
    ends = np.sort(np.concatenate((end[keep], offsets[full + 1])))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def _digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    whole, f = memoryview(buf), xxhash.xxh3_128_digest
    raw = b"".join([f(whole[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def _first_of_document(doc: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Whether a chunk is the first of its digest in its document."""
    order = np.lexsort((digests[:, 1], digests[:, 0], doc))
    d, o = digests[order], doc[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1) | (o[1:] != o[:-1]))) if len(o) else np.zeros(0, bool)
    out = np.zeros(len(doc), dtype=bool)
    out[order[new]] = True  # lexsort is stable: the first of equals is the earliest
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "row", "d1", "d2", "start", "stop"]
    for batch in batches:
        ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, buf, offsets in text_steps(batch.column(2)):
            doc, start, end = cuts(buf, offsets)
            digests = _digests(buf, start, end)
            one = _first_of_document(doc, digests)
            doc, start, end, digests = doc[one], start[one] - offsets[doc[one]], end[one] - offsets[doc[one]], digests[one]
            values = [ids[first + doc], rows[first + doc], digests[:, 0], digests[:, 1], start.astype(np.int32), end.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values], names)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """(id, row, d1, d2, start, stop): each document's different chunks; row is the text's 64-bit hash."""
    rows = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(_chunks, "id long, row long, d1 long, d2 long, start int, stop int")


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with kept (the remaining text), spans (removed byte ranges) and n_chunks."""
    own = chunks(docs)
    repeated = saved(
        own.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("d1", "d2", "first")
    )
    # one row a digest on one side: adaptive execution may split a frequent chunk's rows on the other
    gone = own.join(repeated, ["d1", "d2"]).filter("id > first")
    _id, _row, _gone = (fresh(docs, c) for c in ("_id", "_row", "_gone"))
    spans = gone.groupBy(F.col("id").alias(_id), F.col("row").alias(_row)).agg(F.collect_set(F.struct("start", "stop")).alias(_gone))
    out = [c for c in docs.columns if c not in ("kept", "spans", "n_chunks")]
    keyed = docs.select(*out, F.coalesce("doc_id", F.lit(_LAST)).alias(_id), F.xxhash64("text").alias(_row))
    keyed = keyed.join(spans, [_id, _row], "left").select(*out, _gone)
    schema = T.StructType(
        [
            *[docs.schema[c] for c in out],
            T.StructField("kept", T.StringType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("n_chunks", T.LongType()),
        ]
    )
    text_at = out.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(len(out)).to_pylist()
            kept, spans, count = [], [], []
            for first, buf, offsets in text_steps(batch.column(text_at)):
                doc, start, end = cuts(buf, offsets)
                again = ~_first_of_document(doc, _digests(buf, start, end))
                count.extend(np.bincount(doc, minlength=len(offsets) - 1).tolist())
                local: dict[int, list[tuple[int, int]]] = {}
                for d, a, b in zip(doc[again].tolist(), start[again].tolist(), end[again].tolist(), strict=True):
                    local.setdefault(d, []).append((a - int(offsets[d]), b - int(offsets[d])))
                for d in range(len(offsets) - 1):
                    raw = buf[offsets[d] : offsets[d + 1]].tobytes()
                    cut = _merged(local.get(d, []) + [(s["start"], s["stop"]) for s in gone[first + d] or []])
                    edges = [0, *[x for span in cut for x in span], len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode())
                    spans.append(cut)
            null = batch.column(text_at).is_null().to_pylist()
            kept = [None if n else k for n, k in zip(null, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(out)], pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(count, pa.int64())],
                [*out, "kept", "spans", "n_chunks"],
            )

    return keyed.mapInArrow(run, schema)


def op3(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", size.alias("n_bytes"), "n_chunks", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, str]:
    """doc_id -> kept text, one document and chunk at a time; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        buf = np.frombuffer(raw, dtype=np.uint8)
        _, start, end = cuts(buf, np.array([0, len(raw)]))
        kept = []
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            name = hashlib.sha256(raw[a:b]).digest()
            if name not in seen:
                kept.append(raw[a:b])
            seen.add(name)
        out[doc_id] = b"".join(kept).decode()
    return out
