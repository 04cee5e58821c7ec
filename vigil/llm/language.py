"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle's out-of-place distance).

N-grams are one to three characters of lower-cased letter runs, a blank standing before and after each
run. A language's profile is its 300 most frequent n-grams over all training texts, counted whole. A
document's 300 most frequent n-grams are compared with each profile: an n-gram adds the distance between
its two ranks, or `PROFILE` if the profile lacks it. The nearest profile wins; ties go to the language
that sorts first. The score is 1 minus the distance over the largest possible one.

Defined cases: null texts and texts without a letter are `und` with score 0, as is every text when
nothing could be learned; null languages teach nothing; equal counts rank by n-gram; repeated rows count
each; documents of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import text_steps

PROFILE = 300
SALTS = 64
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or 0."""
    if not _letters:
        points = map(chr, range(0x110000))
        _letters.append(np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in points], dtype=np.int64))
    return _letters[0]


def _letter_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, letters with one 1 for each blank between, before and after runs)."""
    table = _letter_table()
    for first, buf, offsets in text_steps(column):
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        place = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offsets]
        letters = table[points]
        for i in range(len(offsets) - 1):
            x = letters[place[i] : place[i + 1]]
            if not x.any():
                continue
            x = np.concatenate(([0], x, [0]))
            x = x[(x != 0) | np.concatenate(([True], x[:-1] != 0))]
            x[x == 0] = 1
            yield first + i, x


def _grams(x: np.ndarray) -> np.ndarray:
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.concatenate((x[x > 1], two, three[x[1:-1] > 1]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        held: dict[str, list[np.ndarray]] = {}
        for row, x in _letter_runs(batch.column(0)):
            held.setdefault(langs[row], []).append(_grams(x))
            if sum(map(len, held[langs[row]])) > 1 << 22:
                yield from _counted(langs[row], held.pop(langs[row]))
        for lang, parts in held.items():
            yield from _counted(lang, parts)


def _counted(lang: str, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    grams, n = np.unique(np.concatenate(parts), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def profiles(training: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place) from (text, lang): each language's most frequent n-grams, place from 0."""
    counts = (
        training.filter("lang is not null and text is not null")
        .select("text", "lang")
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = (F.desc("n"), F.asc("gram"))
    # first within salted parts of a language, so that no task ranks all n-grams of a frequent one
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    counts = counts.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= size)
    ranked = counts.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("place"))


def predict(docs: DataFrame, learned: DataFrame, size: int = PROFILE) -> DataFrame:
    """`docs` with lang_pred and score. The profiles, 300 rows a language, go to every worker."""
    rows = learned.collect()
    langs = sorted({r["lang"] for r in rows})
    known = np.array(sorted({r["gram"] for r in rows}), dtype=np.int64)
    places = np.full((len(known), len(langs)), -1, dtype=np.int32)
    for r in rows:
        places[np.searchsorted(known, r["gram"]), langs.index(r["lang"])] = r["place"]
    at = docs.schema.fieldNames().index("text")

    def one(x: np.ndarray) -> tuple[str, float]:
        grams, n = np.unique(_grams(x), return_counts=True)
        grams = grams[np.argsort(-n, kind="stable")[:size]]
        where = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        theirs = np.where((known[where] == grams)[:, None], places[where], -1)
        mine = np.arange(len(grams), dtype=np.int32)[:, None]
        distance = np.where(theirs < 0, size, np.abs(theirs - mine)).sum(axis=0)
        best = int(np.argmin(distance))
        return langs[best], 1 - float(distance[best]) / (size * len(grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            if langs:
                for row, x in _letter_runs(batch.column(at)):
                    lang[row], score[row] = one(x)
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                [*[batch.schema.names[i] for i in keep], "lang_pred", "score"],
            )

    from pyspark.sql import types as T

    fields = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op8(docs: DataFrame) -> DataFrame:
    held_out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 3 == 1
    learned = profiles(docs.filter(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), learned)
