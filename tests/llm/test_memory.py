"""What a task of an operator holds beside its rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

from vigil.llm import common, toxicity


def test_sums_of_pairs_hold_little_beside_their_rows(monkeypatch):
    monkeypatch.setattr(toxicity, "KEYS", 1 << 16)
    keys = np.arange(5 << 16, dtype=np.int64) % 200_003  # the last of them occur again
    sums, names, found = toxicity._Sums(3, 2), ["v", "w", "t", "o"], {}
    pa.array(keys[:1])  # loads what it loads once

    def keep(batch):
        for v, w, t, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = found.setdefault((v, w), [0, 0])
            x[0], x[1] = x[0] + t, x[1] + o

    most, batches = 0, []
    for at in range(0, len(keys), 1 << 13):
        k = keys[at : at + (1 << 13)]
        tracemalloc.start()
        before = tracemalloc.get_traced_memory()[0]
        for full in sums.add(k, k // 7, k % 1000, np.ones(len(k), dtype=np.int64), k % 3):
            batches.append(toxicity._batch(full[1:], names))
        most = max(most, tracemalloc.get_traced_memory()[1] - before)
        tracemalloc.stop()
    batches.append(toxicity._batch(sums.all()[1:], names))
    for batch in batches:
        keep(batch)
    assert most < 2.2 * 5 * 8 * (2 << 16)  # of the bytes of the rows that are summed at once
    want = {}
    for k in keys.tolist():
        x = want.setdefault((k // 7, k % 1000), [0, 0])
        x[0], x[1] = x[0] + 1, x[1] + k % 3
    assert found == want


def test_words_are_lower_cased_step_by_step():
    column = pa.array(["WORD İstanbul K " * 4000, None, "", "Été à"] * 60)
    before, most, got = pa.total_allocated_bytes(), 0, []
    for first, rows, doc, _, w in toxicity._tokens(column):
        most = max(most, pa.total_allocated_bytes() - before)
        got += [(first + int(d), int(x)) for d, x in zip(doc[:2], w[:2], strict=True)]
    assert most < column.nbytes / 4
    assert {d for d, _ in got} <= {i for i in range(240) if i % 4 in (0, 3)} and len({x for _, x in got}) <= 4


def test_bytes_under_nulls_are_no_text():
    data = pa.array(["abc", "def", None, "gh"]).buffers()
    hidden = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(b"\x05"), *data[1:]])
    steps = list(common.text_steps(hidden))
    assert [(first, buf.tobytes(), offsets.tolist()) for first, buf, offsets in steps] == [(0, b"abc", [0, 3, 3, 3])]
    (first, buf, offsets), = common.text_steps(pa.array(["x", "ab", None, "c"])[1:])
    assert (first, buf.tobytes(), offsets.tolist()) == (0, b"abc", [0, 2, 2, 3])
