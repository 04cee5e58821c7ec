"""What several operators share: shared-folder checkpoints, text keys and vectorised words."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 18
SPACES = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, that is in tests on one machine, our own."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "vigil-checkpoints"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder in the shared one for intermediate tables, gone afterwards."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        remove(spark, folder)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one if `df` has such a column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def saved(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, lineage cut; the shuffles behind it may go."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    free(df.sparkSession)
    return out


def free(spark: SparkSession) -> None:
    """Spark drops shuffle files when their plans are collected as garbage, which a large driver heap puts off."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def digest(*columns: Column) -> Column:
    """16 bytes that stand for the values of the columns; null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.concat(*sized) if len(sized) > 1 else parts[0]))


# ---- vectorised text -----------------------------------------------------------------------


def fmix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the bits of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def mixed(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return fmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_VALUE = mixed(256, 11)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums, from which `span_hash` takes the hash of any byte range."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return fmix((sums[end] - sums[start]) * down[start])


def text_steps(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    ends = lambda c: np.frombuffer(c.buffers()[1], dtype=np.int64)[c.offset : c.offset + len(c) + 1]
    offsets = ends(column)
    if column.null_count and np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)].any():
        column = column.fill_null(b"")  # a copy of all texts; most writers leave no bytes under a null
        offsets = ends(column)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + step, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each maximal run of word bytes; runs end with their document."""
    inside = is_word[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(buf) else inside
    after = np.concatenate((inside[1:], [False])) if len(buf) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def byte_class(pattern: str) -> np.ndarray:
    """Which single bytes match; bytes of multi-byte characters always do."""
    import re

    return np.array([b >= 128 or bool(re.match(pattern, chr(b))) for b in range(256)])


BLANK_WORDS = byte_class("[^\x20\x09-\x0d]")
