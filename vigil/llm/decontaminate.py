"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Words are runs of bytes other than ASCII punctuation, blanks and controls, A-Z lower-cased. A window
is ten consecutive words of an item; an item of one to nine words is one window. One automaton holds
every window, and each document is scanned once. The automaton is broadcast only up to
`MAX_WINDOWS`, what a worker may hold. Windows of a larger benchmark stay a table: each different text is
read once, tasks pass on the word runs whose hash a bitmap of `BITS` bits has, which is all that is broadcast whatever
the number of windows, and a join by the run's words finds the windows among them.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no
window; repeated items count once by id, a null id is listed as "null"; documents of any length are
scanned whole; repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest, fmix, fresh, powers, prefix_sums, saved, span_hash

WINDOW = 10
#: Windows in one automaton: some 60 characters each, so at most about 150 MB in a worker.
MAX_WINDOWS = 50_000
#: Of the bitmap that tells which runs may be windows beyond that: 2**BITS bits.
BITS = 28
PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        # hit runs as [start, end) byte offsets into the original UTF-8 text
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)

_automata: dict = {}


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window, items): the distinct windows, words joined by one blank, with the ids they come from."""
    # only A-Z may be folded, so translate rather than lower()
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    folded = F.translate(F.col("text"), upper, upper.lower())
    return (
        benchmark.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
            F.regexp_extract_all(folded, F.lit(PATTERN), F.lit(0)).alias("w"),
        )
        .filter(F.size("w") > 0)
        .select(
            "item",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))),
                    lambda i: F.array_join(F.slice("w", i, width), " "),
                )
            ).alias("window"),
        )
        .groupBy("window")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _automaton(key: str, windows):
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        made = ahocorasick.Automaton()
        for text, items in windows.value:
            # bytes as characters: positions then are byte positions
            made.add_word(f" {text.encode().decode('latin-1')} ", (text.count(" ") + 1, items))
        if len(made):
            made.make_automaton()
        _automata[key] = made
    return _automata[key]


def _spans(mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Byte ranges of the runs of marked words."""
    step = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    return [[int(a), int(b)] for a, b in zip(start[first], end[last], strict=True)]


def _words(text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The folded words of a text, and where they start and end in its bytes."""
    raw = (text or "").encode()
    inside = _WORD[np.frombuffer(raw, dtype=np.uint8)]
    step = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return raw.translate(_FOLD).split(), np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _scan_text(text: str | None, found) -> dict:
    parts, start, end = _words(text)
    hits = list(found.iter(f" {b' '.join(parts).decode('latin-1')} ")) if len(found) and parts else []
    if not hits:
        return {"n_words": len(parts), "n_hit": 0, "spans": [], "items": []}
    blanks = np.concatenate(([0], np.cumsum(end - start + 1)))  # of the joined text
    last = np.searchsorted(blanks, [at for at, _ in hits])  # words that end before this blank
    return _covered(parts, start, end, last - [n for _, (n, _) in hits], last, set().union(*[ids for _, (_, ids) in hits]))


def _covered(parts: list[bytes], start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, items: set[str]) -> dict:
    """The words from `first` to before `last` of any hit, as they lie in the text."""
    mark = np.bincount(first, minlength=len(parts) + 1) - np.bincount(last, minlength=len(parts) + 1)
    covered = np.cumsum(mark[:-1]) > 0
    return {"n_words": len(parts), "n_hit": int(covered.sum()), "spans": _spans(covered, start, end), "items": sorted(items)}


_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, out: str = "hits", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` with a struct column `out`: words, hit words, hit byte spans and the items found."""
    spark = docs.sparkSession
    windows = saved(benchmark_windows(benchmark, width))
    docs = docs.drop(out)
    if windows.count() > max_windows:
        return _joined(docs, windows, text, out)
    # bounded by max_windows: what one automaton may hold
    held = spark.sparkContext.broadcast([(r["window"], r["items"]) for r in windows.collect()])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _automaton(key, held)
            hits = [_scan_text(t.as_py(), found) for t in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, type=_KIND)], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, HITS)]))


def _runs(parts: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of every run of n words."""
    buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    word = span_hash(prefix_sums(buf), np.concatenate(([0], ends[:-1])), ends)
    up, down = powers(len(word) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(word * up[: len(word)], dtype=np.uint64)))
    return fmix((sums[n:] - sums[:-n]) * down[: len(word) - n + 1])


def _joined(docs: DataFrame, windows: DataFrame, text: str, out: str) -> DataFrame:
    spark = docs.sparkSession

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [w.encode().split(b" ") for w in batch.column(0).to_pylist()]
            at = np.array([int(_runs(p, len(p))[0] >> np.uint64(64 - BITS)) for p in parts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([len(p) for p in parts], pa.int64())], ["at", "n"])

    bits = windows.select("window").mapInArrow(mark, "at long, n long")
    lengths = [r["n"] for r in bits.select("n").distinct().collect()]  # at most `width`
    lanes = bits.groupBy(F.shiftright("at", 6).alias("lane")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()  # 2**(BITS - 6) at most
    bitmap = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    bitmap[lanes["lane"].to_numpy()] = lanes["bits"].to_numpy().astype(np.int64).view(np.uint64)
    held = spark.sparkContext.broadcast(bitmap)
    _id = fresh(docs, "_id")
    marked = docs.withColumn(_id, digest(F.col(f"`{text}`")))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts, _, _ = _words(t)
                found = []
                for n in lengths:
                    if len(parts) >= n:
                        at = _runs(parts, n) >> np.uint64(64 - BITS)
                        may = (held.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
                        found += [(k, n, b" ".join(parts[k : k + n]).decode()) for k in np.flatnonzero(may).tolist()]
                same = batch.column(0).slice(i, 1).take(pa.array([0] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([same, *[pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]], ["id", "first", "n", "window"])

    texts = marked.select(F.col(_id).alias("id"), F.col(f"`{text}`").alias("text")).dropDuplicates(["id"])
    runs = texts.mapInArrow(candidates, "id binary, first long, n long, window string").join(windows, "window")
    hits = runs.groupBy("id").agg(F.collect_list(F.struct("first", "n")).alias("runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    hits = hits.select(F.col("id").alias(_id), F.struct("runs", "items").alias(out))
    both = marked.join(hits, _id, "left").drop(_id)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t, hit in zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index(out)).to_pylist(), strict=True):
                first = np.array([r["first"] for r in hit["runs"]] if hit else [], dtype=np.int64)
                last = first + np.array([r["n"] for r in hit["runs"]] if hit else [], dtype=np.int64)
                made.append(_covered(*_words(t), first, last, set(hit["items"]) if hit else set()))
            keep = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in keep], pa.array(made, type=_KIND)], [*keep, out])

    return both.mapInArrow(place, T.StructType([*docs.schema.fields, T.StructField(out, HITS)]))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    hits = fresh(docs, "_hits")
    return scan(docs, benchmark, out=hits).filter(F.col(f"{hits}.n_hit") == 0).drop(hits)


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = scan(docs.select("doc_id", "text"), benchmark)
    return hits.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, p.n, item FROM places p JOIN windows x ON p.win = x.win AND p.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
