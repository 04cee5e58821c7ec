"""The operators of vigil.llm against brute force on small tables, with the awkward rows in each."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.llm import chunking, decontaminate, fixity, hamming, language, mixing, near_duplicates, sharding, suffixes, toxicity
from vigil.llm.common import text_steps, words
from vigil.llm.components import stars

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, kept int, hits int, node int"


def make(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    n = len(texts)
    rows = [
        ((ids or range(n))[i], t, (langs or [None] * n)[i], (sources or ["s"] * n)[i], len(t) if t is not None else None, 1, "x", 2, 3, 4)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rnd, n, lexicon=None):
    lexicon = lexicon or ["ka", "lomi", "tuva", "res", "bento", "quil", "mar", "dosi", "fen", "harpo", "zet", "ulm", "ivra", "nopal", "gesti", "wodu"]
    return " ".join(rnd.choice(lexicon) + rnd.choice(["", "n", "ra", "sti", "o"]) for _ in range(n))


def awkward(rnd):
    """Texts with nulls, empties, repeats, copies, shared passages, a very long one and junk."""
    base = [prose(rnd, rnd.choice([3, 5, 40, 120, 300])) for _ in range(30)]
    passage = prose(rnd, 60)
    long = prose(rnd, 6000)
    return [
        None, "", " \n ", "one", "one", *base, base[4], base[4], base[7] + " extra words", *[prose(rnd, 30) + " " + passage + " " + prose(rnd, 20) for _ in range(6)],
        long, long[:-40] + " changed end", "a" * 500, "a" * 400, "é" * 300, "Ünï çødé " * 30, None, "",
    ]


@pytest.fixture(scope="module")
def texts():
    return awkward(random.Random(7))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make(spark, texts).repartition(5)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- helpers -------------------------------------------------------------------------------


def test_words_and_steps():
    column = pa.array(["ab c", None, "", "déf  g", "x"])
    found = []
    for first, buf, offsets in text_steps(column, step=4):
        doc, start, end = words(buf, offsets, near_duplicates.BLANK_WORDS)
        found += [(first + d, bytes(buf[a:b]).decode()) for d, a, b in zip(doc, start, end, strict=True)]
    assert found == [(0, "ab"), (0, "c"), (3, "déf"), (3, "g"), (4, "x")]


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in stars(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked if find(x) != x}
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 Merkle fixity -----------------------------------------------------------------------


def test_fixity_finds_exactly_the_damage(spark):
    rnd = random.Random(1)
    records = [(f"a{i % 3}", 100 * i, prose(rnd, 20), i) for i in range(400)] + [(None, None, "lost", 900), ("a0", 0, None, 901), ("a0", 0, None, 901)]
    schema = "archive string, offset long, content string, record_id long, leaf int, n int"
    build = lambda rs: spark.createDataFrame([(*r, 0, 0) for r in rs], schema)
    good = build(records)
    assert fixity.audit(good, good.repartition(7), 1024, 4).count() == 0
    bad = [r for r in records if r[3] != 17]
    bad = [(a, o, "x" + c[1:] if i == 250 else c, i) for a, o, c, i in bad] + [("a9", 5, "new", 950), ("a0", 0, None, 901)]
    found = fixity.audit(good, build(bad), 1024, 4).collect()
    assert {(r["archive"], r["offset"], r["status"]) for r in found} == {("a2", 1700, "missing"), ("a1", 25000, "changed"), ("a9", 5, "extra"), ("a0", 0, "changed")}
    empty = build([]).limit(0)
    assert fixity.audit(empty, empty).count() == 0
    assert {r["status"] for r in fixity.audit(good, empty).collect()} == {"missing"}


def test_fixity_roots_depend_on_content_only(spark):
    rnd = random.Random(2)
    data = [("a", 10 * i, prose(rnd, 5), i) for i in range(200)]
    schema = "archive string, offset long, content string, record_id long"
    roots = []
    for shuffled in (data, data[::-1], data[:-1]):
        _, nodes, top = fixity.tree(spark.createDataFrame(shuffled, schema).repartition(3), 256, 4)
        roots.append(nodes.filter(F.col("level") == top).collect())
    assert roots[0] == roots[1] != roots[2]


def test_fixity_query_with_nulls(spark):
    pages = spark.createDataFrame([(None, "u", "h"), (1, None, None), (1, None, None), (5000, "u", "x" * 9)], "page_id long, url string, html string")
    assert fixity.op1(pages).filter("status is null").count() == 0


# ---- 2 mixing ------------------------------------------------------------------------------


def fill(sizes):
    """Targets by resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in held)
        w = sum(weight[s] for s in names if s not in held)
        target = {s: 3 * sizes[s] if s in held else rest * weight[s] / w for s in names}
        above = {s for s in names if s not in held and target[s] > 3 * sizes[s]}
        if not above:
            return target
        held |= above


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_targets_and_taken(spark, seed):
    rnd = random.Random(seed)
    names = ["s1", "s10", "s2", None, "ä", "Z"]
    texts = [prose(rnd, rnd.choice([0, 1, 7, 60, 900])) for _ in range(250)] + [None, ""]
    sources = [rnd.choice(names[:2] * 6 + names) for _ in texts]
    frame = make(spark, texts, sources=sources)
    got = mixing.op2(frame).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += size(t)
    want = fill(dict(sizes))
    taken = Counter()
    assert len(got) == len(texts)
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == size(texts[r["doc_id"]]) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= 1
    again = mixing.op2(frame.repartition(6)).collect()
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(again, key=lambda r: r["doc_id"])


def test_mixing_edges(spark):
    assert mixing.op2(make(spark, []).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.op2(make(spark, [None, ""])).collect()] == [0, 0]
    frame = make(spark, ["a b c", "a b c", "d"], ids=[1, 1, 2])
    assert sum(r["taken"] for r in mixing.op2(frame).collect()) == 7
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and sorted(r["text"] for r in mixed.collect()) == ["a b c", "a b c", "d"]


def test_schedule_is_low_discrepancy(spark):
    goals = spark.createDataFrame([("a", 500.0, 500), ("b", 300.0, 300), ("c", 200.0, 200)], "key string, target double, source_size long")
    slots, sizes = mixing.schedule(goals, 1000)
    ranks = slots.groupBy("key").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("rank").alias("d")).collect()
    for r in ranks:
        assert abs(r["n"] - {"a": 500, "b": 300, "c": 200}[r["key"]]) <= 5 and r["lo"] == 0 and r["hi"] + 1 == r["n"] == r["d"]
    assert {r["key"]: r["dealt"] for r in sizes.collect()} == {r["key"]: r["n"] for r in ranks}
    # every stretch of slots has its share of each source
    got = {r["slot"]: r["key"] for r in slots.collect()}
    for at in range(0, 1000, 50):
        assert abs(sum(got[i] == "a" for i in range(at, at + 50)) - 25) <= 3


def test_points_are_exact_at_any_slot(spark):
    ids = [0, 1, 2, 12345, 2**31 - 1, 2**31, 10**12, 2**60]
    phi = mixing.GOLDEN
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", mixing.golden(F.col("i")).alias("p")).collect()
    assert all(r["p"] == (r["i"] + 1) * phi % 2**62 for r in got)


def plain_mix(table):
    """(taken, first slot) of each (doc_id, text, source), a word and a slot at a time."""
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    streams = defaultdict(list)
    for i, t, s, h in table:
        streams[s].append((h, i, size(t)))
    goals = fill({s: sum(n for _, _, n in v) for s, v in streams.items()})
    names = sorted((s for s in goals if goals[s] > 0), key=lambda s: "n" if s is None else "v" + s)
    words = sum(sum(n for _, _, n in v) for v in streams.values())
    slots = max(-(-words // mixing.BLOCK), min(words, mixing.SLOTS * len(streams)))
    dealt, whole = defaultdict(list), sum(goals.values())
    for slot in range(slots):
        point = (slot + 1) * mixing.GOLDEN % 2**62 / 2**62
        upto = 0.0
        for s in names:
            upto += goals[s]
            if point < upto / whole or s == names[-1]:
                dealt[s].append(slot)
                break
    taken, first = Counter(), {}
    for s, stream in streams.items():
        goal, n = int(goals[s] + 1e-9), len(dealt[s])
        pass_ = [i for _, i, size_ in sorted(stream) for _ in range(size_)]
        begins = {sum(x[2] for x in sorted(stream)[:k]) for k in range(len(stream))}
        for r, slot in enumerate(dealt[s]):
            for word in range(r * goal // n, (r + 1) * goal // n):
                at = word % len(pass_)
                taken[pass_[at]] += 1
                if at in begins:
                    first.setdefault(pass_[at], slot)
    return {i: (taken[i], first.get(i)) for i, *_ in table}


@pytest.mark.parametrize("block", [mixing.BLOCK, 7])
def test_mixing_takes_what_slots_name(spark, block, monkeypatch):
    """Word by word; fails if any other schedule, such as each source's ranks one after the other, takes its place."""
    monkeypatch.setattr(mixing, "SLOTS", 20)
    monkeypatch.setattr(mixing, "BLOCK", block)
    rnd = random.Random(4)
    texts = [prose(rnd, rnd.choice([0, 1, 7, 60, 300])) for _ in range(150)] + [None]
    frame = make(spark, texts, sources=[rnd.choice(["a", "a", "a", "b", None]) for _ in texts])
    table = [tuple(r) for r in frame.select("doc_id", "text", "source", F.xxhash64("doc_id", F.lit(20))).collect()]
    want = plain_mix(table)
    planned = mixing.plan(frame, block=block).select("doc_id", "taken", F.get("slots", F.lit(0)).alias("first_slot")).collect()
    assert {r["doc_id"]: (r["taken"], r["first_slot"]) for r in planned} == want
    assert len({s for _, s in want.values()}) > 50
    dealt = mixing.schedule
    in_turn = lambda goals, n: (dealt(goals, n)[0].withColumn("slot", F.row_number().over(W.orderBy("key", "rank")).cast("long") - 1), dealt(goals, n)[1])
    monkeypatch.setattr(mixing, "schedule", in_turn)
    other = mixing.plan(frame, block=block).select("doc_id", "taken", F.get("slots", F.lit(0)).alias("first_slot")).collect()
    assert {r["doc_id"]: (r["taken"], r["first_slot"]) for r in other} != want


def test_mix_keeps_columns_of_any_name(spark):
    frame = make(spark, ["a b c", "a b c", "d", None], ids=[1, 1, None, None]).withColumns({c: F.lit(7) for c in ("_row_id", "_copy", "_copies", "_slots", "_slot", "_mark", "h", "key")})
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and sorted(r["text"] for r in mixed.collect()) == ["a b c", "a b c", "d"]
    assert all(r["_row_id"] == r["_slot"] == r["_mark"] == 7 for r in mixed.collect())
    ordered = mixing.mix(frame, slot="at").orderBy("at").collect()
    assert len({r["at"] for r in ordered}) == 3


# ---- 3 content-defined chunks --------------------------------------------------------------


def test_chunks_match_brute_force(docs, texts):
    want = chunking.brute_force(list(enumerate(texts)))
    for i, r in rows(chunking.op3(docs)).items():
        assert r["kept_sha256"] == hashlib.sha256(want[i].encode()).hexdigest(), i
        assert r["n_bytes"] - r["n_removed"] == len(want[i].encode())
    full = chunking.dedup(docs)
    assert set(full.columns) == {*docs.columns, "kept", "spans", "n_chunks"}


def plain_cuts(raw):
    """Ends of chunks, a byte at a time."""
    gear, mask, top = [int(x) for x in chunking._GEAR], 2**32 - 1, 2**32 - 1
    own = [min(sum(gear[raw[i - d]] << d for d in range(min(16, i + 1))) & mask, top - 1) for i in range(len(raw))]
    ends = []
    for i in range(16, len(raw)):
        before, after = own[max(i - 32, 0) : i], own[i + 1 : i + 33]
        if own[i] < min(before, default=top) and own[i] <= min(after, default=top):
            end = i + 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            if end >= 32 and len(raw) - end >= 32 and end not in ends:
                ends.append(end)
    return [*ends, len(raw)] if raw else []


def test_cuts_are_the_plain_ones(texts):
    raws = [(t or "").encode() for t in texts] + ["naïve café Ünï çødé ".encode() * 40, b"ab" * 300]
    buf = np.frombuffer(b"".join(raws), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, raws)])
    doc, start, end = chunking.cuts(buf, offsets)
    for i, raw in enumerate(raws):
        mine = doc == i
        assert (end[mine] - offsets[i]).tolist() == plain_cuts(raw)
        assert (start[mine] - offsets[i]).tolist() == [0, *plain_cuts(raw)[:-1]][: mine.sum()]


def test_chunks_resist_insertions():
    rnd = random.Random(5)
    raw = prose(rnd, 2000).encode()
    moved = raw[:500] + b"something new" + raw[500:]
    cut = lambda x: {x[a:b] for a, b in zip(*(v.tolist() for v in chunking.cuts(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[1:]), strict=True)}
    assert len(cut(raw) - cut(moved)) <= 4
    doc, start, end = chunking.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert start[0] == 0 and end[-1] == len(raw) and (start[1:] == end[:-1]).all() and (end - start).min() > chunking.REACH


def test_chunks_edges(spark):
    twin = prose(random.Random(9), 80)
    got = chunking.op3(make(spark, [twin, twin, twin, None], ids=[3, 3, None, None])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"] == r["n_bytes"], r["n_bytes"] > 0) for r in got) == [(False, False, True), (False, False, True), (True, True, False), (True, True, True)]
    assert chunking.op3(make(spark, []).limit(0)).count() == 0


# ---- 4 n-gram Jaccard join -----------------------------------------------------------------


def brute_classes(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = defaultdict(set)
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    lowest = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        lowest[i] = min(seen)
    return lowest, links


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = rnd.choice(["alpha", "beta", "gamma"])
    return " ".join(w)


def test_classes_match_brute_force(spark):
    rnd = random.Random(11)
    base = [prose(rnd, 150) for _ in range(12)]
    texts = awkward(rnd) + base + [edited(rnd, rnd.choice(base), rnd.choice([1, 2, 3, 4, 5])) for _ in range(420)]
    lowest, links = brute_classes(texts)
    got = rows(near_duplicates.op4(make(spark, texts).repartition(4)))
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (lowest[i], len(links[i])) for i in lowest}
    assert max(Counter(lowest.values()).values()) > near_duplicates.BLOCK / 8


def test_a_group_larger_than_a_block(spark, monkeypatch):
    rnd = random.Random(12)
    base = prose(rnd, 200)
    texts = [edited(rnd, base, rnd.choice([1, 2, 3])) for _ in range(90)]
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    lowest, links = brute_classes(texts)
    got = rows(near_duplicates.op4(make(spark, texts)))
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (lowest[i], len(links[i])) for i in lowest}


@pytest.mark.parametrize("banded", [False, True])
def test_a_group_of_many_tiles(spark, monkeypatch, banded):
    """Whole, or band by band, where nodes meet in many bands and each pair counts once."""
    rnd = random.Random(14)
    base = prose(rnd, 120)
    texts = [edited(rnd, base, rnd.choice([1, 2, 4, 9])) for _ in range(120)] + [None, "", base, base]
    monkeypatch.setattr(near_duplicates, "SIDE", 20)
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    if banded:
        monkeypatch.setattr(near_duplicates, "_loose", lambda: F.lit(True))
    lowest, links = brute_classes(texts)
    frame = make(spark, texts)
    got = rows(near_duplicates.op4(frame))
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (lowest[i], len(links[i])) for i in lowest}


def test_distinct_keeps_one_of_each_class(docs, texts):
    lowest, _ = brute_classes(texts)
    kept = near_duplicates.distinct(docs)
    assert kept.columns == docs.columns
    blank = {i for i, t in enumerate(texts) if not (t or "").split()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({v for i, v in lowest.items() if i not in blank} | blank)


def test_near_duplicate_edges(spark):
    twin = prose(random.Random(13), 30)
    frame = make(spark, [twin, twin, twin, None], ids=[4, 4, None, None])
    assert near_duplicates.distinct(frame).count() == 2
    assert sorted(r["n_links"] for r in near_duplicates.op4(frame).collect()) == [0, 2, 2, 2]
    assert near_duplicates.op4(make(spark, []).limit(0)).count() == 0


def test_pruning_bounds():
    assert near_duplicates.least_matches(32) < 20 and near_duplicates.least_matches(160) > 80
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**32, (40, near_duplicates.HASHES), dtype=np.uint32)
    b = a.copy()
    b[:, ::6] += 1
    i, j = near_duplicates.candidates(a, b, False)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(k, k) for k in range(40)]


# ---- 5 sharding ----------------------------------------------------------------------------


def test_shards(spark):
    rnd = random.Random(21)
    texts = [prose(rnd, rnd.choice([1, 10, 50, 400])) for _ in range(1500)] + [None, None, "", "ü"] + ["same text here"] * 40
    frame = make(spark, texts)
    got = sharding.op5(frame).collect()
    assert len(got) == len(texts) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode())
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert set(load) == set(range(24)) and max(load.values()) < 1.02 * min(load.values()) + 3000
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.op5(frame.repartition(5)).collect()
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(again, key=lambda r: r["doc_id"])


def test_shard_edges(spark):
    assert sharding.op5(make(spark, []).limit(0)).count() == 0
    big = sharding.op5(make(spark, ["x" * 1000] * 50 + [f"t{i}" for i in range(50)], ids=[1] * 100)).collect()
    assert len({r["shard"] for r in big if r["size"] == 1008}) == 1 and {r["shard"] for r in big} <= set(range(24))


def test_best_fit_decreasing():
    sizes = sorted([7, 6, 5, 4, 3, 3, 2, 2, 2, 1], reverse=True)
    bins = sharding.best_fit_decreasing(sizes, 10)
    load = Counter()
    for s, b in zip(sizes, bins, strict=True):
        load[b] += s
    assert max(load.values()) <= 10 and len(load) == 4
    rnd = random.Random(4)
    for _ in range(30):
        sizes = sorted((rnd.randrange(1, 400) for _ in range(rnd.randrange(1, 60))), reverse=True)
        # by scanning all bins
        slow, out = [], []
        for s in sizes:
            fits = [(room, i) for i, room in enumerate(slow) if room >= s]
            i = min(fits)[1] if fits else len(slow)
            slow = slow if fits else [*slow, 400]
            slow[i] -= s
            out.append(i)
        assert sharding.best_fit_decreasing(sizes, 400) == out
        assert max(sharding.fit(sizes, 5)) < 5
    assert sharding.fit([], 3) == []


# ---- 6 column-wise suffix order ------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup_matches_brute_force(docs, texts, monkeypatch, small):
    if small:
        monkeypatch.setattr(suffixes, "UNIT_BYTES", 9000)
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20000)
    want = suffixes.brute_force(list(enumerate(texts)))
    got = {i: tuple(r)[1:] for i, r in rows(suffixes.op6(docs)).items()}
    assert got == want


def test_suffix_edges(spark):
    twin = prose(random.Random(31), 40)
    got = suffixes.op6(make(spark, [twin, twin, twin, None, twin[:49], twin[3:53]], ids=[8, 8, None, None, 9, 9])).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in got) == sorted([(8, len(twin), 0)] * 2 + [(-1, len(twin), len(twin)), (-1, 0, 0), (9, 49, 0), (9, 50, 50)])
    assert suffixes.op6(make(spark, []).limit(0)).count() == 0


def test_strings_with_one_hash_stay_apart(texts, monkeypatch):
    monkeypatch.setattr(suffixes, "_row_hash", lambda rows: np.zeros(len(rows), dtype=np.uint64))
    unit = suffixes.Unit(pa.table({"id": range(len(texts)), "text": texts}), 3)
    chosen = np.arange(len(unit.place))
    made, which, low = unit.strings(chosen)
    assert len({bytes(r) for r in made}) > 100
    for i in chosen[::7]:
        row, at = made[which[i]], unit.place[i]
        a, b = max(unit.first[i], at - suffixes.REACH), min(unit.last[i] + suffixes.WINDOW, at + suffixes.GRAM + suffixes.REACH)
        shift = 4 + a - (at - suffixes.REACH)
        assert bytes(row[shift : shift + b - a]) == bytes(unit.buf[a:b])
        assert low[which[i]] <= unit.ids[unit.doc[i]]


def test_columns_give_common_windows():
    rnd = np.random.default_rng(3)
    strings = rnd.integers(0, 2, (300, suffixes.WIDTH)).astype(np.uint8)
    strings[100:200] = strings[:100]
    strings[150:200, :10] = 7
    near, far = np.zeros(300, np.uint8), np.full(300, suffixes.REACH, np.uint8)
    ids = rnd.permutation(300)
    got = suffixes.common_windows(np.asfortranarray(strings), near, far, ids)
    for o in range(suffixes.REACH + 1):
        low = {}
        cut = [bytes(s[suffixes.REACH - o : suffixes.REACH - o + suffixes.WINDOW]) for s in strings]
        for w, i in zip(cut, ids, strict=True):
            low[w] = min(low.get(w, 10**9), i)
        assert [int(g >> o) & 1 for g in got] == [int(low[w] < i) for w, i in zip(cut, ids, strict=True)]


# ---- 7 Hamming search ----------------------------------------------------------------------


def test_hamming_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(300, 32)).astype(np.float32)
    x[50:90] = x[0]
    x[3, 0] = np.nan
    data = [(int(i), [float(v) for v in row], 1) for i, row in enumerate(x)] + [(None, [0.0] * 32, 1), (999, None, 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in hamming.search(frame, frame.filter("vec_id % 20 = 0"), 10, 32).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    bits = np.where(np.isnan(x), False, x > 0)
    want = {q: sorted((int((bits[q] != bits[v]).sum()), v) for v in range(300) if v != q)[:10] for q in range(0, 300, 20)}
    assert dict(got) == want


def test_hamming_with_few_rows(spark):
    frame = spark.createDataFrame([(20, [1.0] * 8), (21, [-1.0] * 8), (20, [1.0] * 8)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hamming.search(frame, frame.filter("vec_id = 20"), 5, 8).collect()] == [(20, 1, 21, 8)]
    assert hamming.search(frame.limit(0), frame.limit(0), 5, 8).count() == 0


def test_hamming_leaves_out_other_lengths(spark):
    frame = spark.createDataFrame([(i, [float(i >> b & 1) for b in range(8)]) for i in range(40)], "vec_id long, embedding array<float>")
    odd = spark.createDataFrame([(100, [1.0]), (101, []), (102, None), (103, [1.0] * 9), (0, [1.0] * 3)], "vec_id long, embedding array<float>")
    found = lambda df: sorted(map(tuple, hamming.search(df, df.filter("vec_id % 20 = 0"), 5, 8).collect()))
    assert found(frame.union(odd)) == found(frame)


# ---- 8 language ----------------------------------------------------------------------------


def test_language(spark):
    rnd = random.Random(41)
    lex = {"aa": ["thing", "with", "shall", "ough"], "bb": ["über", "schön", "nicht", "ich"], "cc": ["être", "même", "où", "ça"]}
    langs = [rnd.choice(list(lex)) for _ in range(120)]
    texts = [prose(rnd, rnd.choice([4, 30, 200]), lex[g]) for g in langs] + [None, "", "123 !!", "THING With 9"]
    labels = [g if rnd.random() < 0.8 else None for g in langs] + [None, "aa", None, None]
    got = rows(language.op8(make(spark, texts, langs=labels)))
    assert len(got) == 124 and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (120, 121, 122)) and got[123]["lang_pred"] == "aa"
    assert sum(got[i]["lang_pred"] == g for i, g in enumerate(langs)) >= 117
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    none = rows(language.op8(make(spark, ["hello there"])))
    assert none[0]["lang_pred"] == "und"
    assert language.op8(make(spark, []).limit(0)).count() == 0


def plain_grams(text):
    """An n-gram's code points, blanks as 1, read as one number of base 2**21."""
    low = [ord(c.lower()[0]) if c.isalpha() else 32 for c in text]
    out = Counter()
    for run in re.findall("[^ ]+", "".join(map(chr, low))):
        x = [1, *map(ord, run), 1]
        for n in (2, 3):
            for i in range(len(x) - n + 1):
                out[sum(p << (21 * (n - 1 - k)) for k, p in enumerate(x[i : i + n]))] += 1
        out.update(map(ord, run))
    return out


def test_out_of_place_distance(spark):
    """Predictions and scores of every kind of text against plain dictionaries, ties included."""
    rnd = random.Random(42)
    lex = {"aa": ["thing", "with", "shall"], "bb": ["über", "schön", "nicht"], "zz": ["thing", "with", "shall"]}
    learn = []
    for k in range(60):
        g = ["aa", "bb"][k % 2]
        text = prose(rnd, rnd.choice([2, 20, 90]), lex[g])
        learn += [(text, g)] + ([(text, "zz")] if g == "aa" else [])  # zz has the profile of aa
    texts = [prose(rnd, n, lex[g]) for g in ("aa", "bb") for n in (1, 7, 60)] + ["THING!", "ü", "qqq xyz", "4 !", "", None, prose(rnd, 20_000), prose(rnd, 9, lex["bb"])]
    texts.append(texts[0])
    counts = defaultdict(Counter)
    for text, g in learn:
        counts[g] += plain_grams(text)
    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:300]]
    places = {g: {x: i for i, x in enumerate(ranked(c))} for g, c in counts.items()}
    learned = language.profiles(spark.createDataFrame(learn, "text string, lang string").repartition(3))
    rows_ = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learned).collect()
    for r in rows_:
        mine = ranked(plain_grams(texts[r["doc_id"]] or ""))
        if not mine:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        distance = {g: sum(abs(p[x] - i) if x in p else 300 for i, x in enumerate(mine)) for g, p in places.items()}
        best = min(sorted(distance), key=distance.get)
        assert r["lang_pred"] == best and abs(r["score"] - (1 - distance[best] / (300 * len(mine)))) < 1e-12
    assert len(rows_) == len(texts)


def test_profile_is_the_plain_ranking(spark):
    text = "Abc abd, ab"
    frame = spark.createDataFrame([(text, "x")], "text string, lang string")
    padded = [" abc ", " abd ", " ab "]
    want = Counter()
    for w in ["abc", "abd", "ab"]:
        want.update(w)
    spaced = " abc abd ab "
    want.update(spaced[i : i + 2] for i in range(len(spaced) - 1))
    want.update(spaced[i : i + 3] for i in range(len(spaced) - 2) if spaced[i + 1] != " ")
    code = lambda g: sum((1 if ch == " " else ord(ch)) << (21 * (len(g) - 1 - k)) for k, ch in enumerate(g))
    ranked = sorted(want, key=lambda g: (-want[g], code(g)))
    got = [r["gram"] for r in language.profiles(frame).orderBy("place").collect()]
    assert got == [code(g) for g in ranked] and len(padded) == 3


# ---- 9 toxicity ----------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rnd = random.Random(51)
    bad = ["vilko", "grazt", "murdo", "plimk"]
    texts, toxic = [], []
    for _ in range(1500):
        w = prose(rnd, rnd.choice([15, 60, 200])).split()
        t = rnd.random() < 0.2
        if t:
            for _ in range(max(1, len(w) // 40)):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        texts.append(" ".join(w))
        toxic.append(int(t))
    texts += [None, ""]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(3, 0, toxic[3]), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = rows(toxicity.op9(make(spark, texts), labels))
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(1500)) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert sum(got[i]["predicted"] == toxic[i] for i in held) / len(held) > 0.95
    assert got[1500]["score"] == got[1501]["score"]
    kept = toxicity.clean(make(spark, texts), labels)
    assert kept.columns == make(spark, texts).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.op9(make(spark, ["a b", None]), none).collect()} == {0}
    assert toxicity.op9(make(spark, []).limit(0), none).count() == 0


def _toxicity_case(spark, texts, toxic):
    """Ids outside the held-out fold for labelled texts (toxic 0 or 1), so that all labels teach."""
    ids = [i for i in range(10 * len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    labels = spark.createDataFrame([(i, 1, t) for i, t in zip(ids, toxic, strict=True) if t is not None], "doc_id long, quality int, toxic int")
    got = rows(toxicity.op9(make(spark, texts, ids), labels))
    return [got[i]["predicted"] for i in ids]


def test_toxicity_with_many_different_words(spark):
    rnd = random.Random(5)
    junk = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    texts, toxic = [], []
    for i in range(1400):
        t = i % 14 == 0
        w = prose(rnd, 10).split() + [junk() for _ in range(1200)]
        texts.append(" ".join(w + (["vilkograzt"] if t else [])))
        toxic.append(int(t) if i < 1000 else None)
    got = _toxicity_case(spark, texts, toxic)
    assert got == [int(i % 14 == 0) for i in range(1400)]


@pytest.mark.parametrize("clean", [0, 800])
def test_toxicity_with_few_toxic_labels(spark, clean):
    """A single toxic label, or none but toxic ones, still teaches its words."""
    rnd = random.Random(6)
    bad = " ".join(["vilko grazt murdo plimk"] * 3)
    texts = [prose(rnd, 40) for _ in range(1000)] + [prose(rnd, 10) + " " + bad for _ in range(20)]
    toxic = [0] * clean + [None] * (1000 - clean) + [1] * (1 if clean else 10) + [None] * (19 if clean else 10)
    got = _toxicity_case(spark, texts, toxic)
    assert sum(got[:1000]) == 0 and sum(got[1000:]) == 20


def test_toxicity_of_word_pairs(spark):
    """Two ordinary words that are toxic only side by side."""
    rnd = random.Random(7)
    texts, toxic = [], []
    for i in range(1600):
        w = prose(rnd, 30).split()
        bad = i % 5 == 0
        extra = ["tuvaxo", "lomixo"] * 3 if bad else ["lomixo", "fen", "tuvaxo", "res"] * 3
        texts.append(" ".join(w[:15] + extra + w[15:]) if bad else " ".join(w[:11] + extra + w[11:]))
        toxic.append(int(bad) if i < 1200 else None)
    got = _toxicity_case(spark, texts, toxic)
    assert sum(g == int(i % 5 == 0) for i, g in enumerate(got)) > 1570


def plain_models(texts, toxic):
    """P(w | k, v) of both classes by the docstring's formulas, for any word and history of the labelled texts."""
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    pairs = [set(zip(["^", *w], w, strict=False)) for w in map(split, texts)]
    shared = Counter(w for t in texts for w in set(split(t)))
    share = {w: n / sum(shared.values()) for w, n in shared.items()}
    c = {k: Counter(p for each, x in zip(pairs, toxic, strict=True) if x == k for p in each) for k in (0, 1)}
    d = lambda counts: (lambda a, b: a / (a + 2 * b) if a else 0.5)(*[sum(n == i for n in counts.values()) for i in (1, 2)])
    before = {k: Counter(w for _, w in c[k]) for k in (0, 1)}
    n = {k: sum(before[k].values()) for k in (0, 1)}
    x = lambda v: v * np.log(v) if v else 0.0

    def test(a, na, b, nb):
        return 2 * (x(a) + x(b) + x(na - a) + x(nb - b) - x(na) - x(nb) - x(a + b) - x(na + nb - a - b) + x(na + nb))

    words = before[0].keys() | before[1].keys()
    own = {k: Counter() for k in (0, 1)}
    for w in words:
        if test(before[1][w], n[1], before[0][w], n[0]) >= toxicity.WORD_TEST:
            for k in (0, 1):
                own[k][w] = max(before[k][w] - d(before[k]) - toxicity.RHO * n[k] * before[1 - k][w] / n[1 - k], 0)
    told = {w for w in words if own[0][w] > 0 or own[1][w] > 0}
    left = {k: 1 - sum(own[k].values()) / n[k] for k in (0, 1)}
    word = lambda k, w: own[k][w] / n[k] + left[k] * share[w]
    total = {k: Counter() for k in (0, 1)}
    for k in (0, 1):
        for (v, _), m in c[k].items():
            total[k][v] += m
    every = c[0].keys() | c[1].keys()
    pair, gone = {k: Counter() for k in (0, 1)}, {k: Counter() for k in (0, 1)}
    for v, w in every:
        if w in told or test(c[1][v, w], total[1][v], c[0][v, w], total[0][v]) >= 2 * np.log(len(every)):
            for k in (0, 1):
                r = c[1 - k][v, w] / total[1 - k][v] if total[1 - k][v] else 0
                r = r if w in told else max(r, word(k, w))
                pair[k][v, w] = max(c[k][v, w] - d(c[k]) - toxicity.RHO * total[k][v] * r, 0)
                gone[k][v] += pair[k][v, w]
    p = lambda k, v, w: (pair[k][v, w] / total[k][v] + (1 - gone[k][v] / total[k][v]) * word(k, w)) if total[k][v] else word(k, w)
    return split, share, p, pair, told


@pytest.fixture(scope="module")
def spoken():
    """Toxic words, a toxic pair of ordinary words, and words of the ordinary class."""
    rnd = random.Random(61)
    texts, toxic = [None, "", "Ka-KA ka", "ka ka ka"], [0, 1, 0, None]
    for i in range(500):
        w, t = prose(rnd, rnd.choice([3, 12, 40])).split(), i % 4 == 0
        for _ in range(2):
            at = rnd.randrange(len(w))
            w[at:at] = rnd.choice([["vilko"], ["you", "grazt"], ["shut", "up"]]) if t else rnd.choice([["shut", "it"], ["wake", "up"], ["kindly"], ["so"]])
        texts.append(" ".join(w))
        toxic.append(int(t) if i % 5 else None)
    return texts, toxic


def test_evidence_is_the_likelihood_ratio_of_all_words(spark, spoken, tmp_path):
    """At the settings as shipped, each document by plain sums over its words; both models are distributions."""
    texts, toxic = spoken
    split, share, p, pair, told = plain_models(texts, toxic)
    assert "vilko" in told and {("shut", "up")} <= {x for x, y in pair[1].items() if y > 0 and x[1] not in told} and any(pair[0].values())
    for k in (0, 1):
        for v in ("^", "shut", "you", "nowhere"):
            assert sum(p(k, v, w) for w in share) == pytest.approx(1)
    want = []
    for t in texts:
        w = split(t)
        want.append(sum(np.log(p(1, a, b) / p(0, a, b)) for a, b in zip(["^", *w], w, strict=False)) / max(len(w), 1))
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(texts, toxic, strict=True))], "doc_id long, text string, toxic long").repartition(3)
    base, entries = toxicity.model(frame, frame.filter("toxic is not null").select("text", "toxic"), str(tmp_path / "m"))
    entries = entries.cache()
    got = {r["doc_id"]: r["x"] for r in toxicity.evidence(frame, base, entries, "x").collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got) and len(got) == len(texts)
    without = {r["doc_id"]: r["x"] for r in toxicity.evidence(frame, base, entries.filter("kind = 'word'"), "x").collect()}
    assert sum(abs(got[i] - without[i]) > 1e-6 for i in got) > len(texts) / 4


def test_pairs_change_scores_of_the_documents(spark, tmp_path):
    """On the driver's documents, too, histories and pairs take part in the evidence."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    base, entries = toxicity.model(docs, docs.join(labels, "doc_id").select("text", F.col("toxic").cast("long")), str(tmp_path / "m"))
    entries = entries.cache()
    kinds = {r["kind"]: r["count"] for r in entries.groupBy("kind").count().collect()}
    assert min(kinds[k] for k in ("word", "history", "pair")) > 9
    x = [{r["doc_id"]: r["x"] for r in toxicity.evidence(docs, base, e, "x").collect()} for e in (entries, entries.filter("kind = 'word'"))]
    assert sum(x[0][i] != x[1][i] for i in x[0]) > 100


def test_toxicity_joined_as_looked_up(spark, monkeypatch):
    rnd = random.Random(62)
    texts, toxic = [None, "", " . "], [0, 1, 0]
    for i in range(600):
        w = prose(rnd, 30).split()
        texts.append(" ".join(w[:9] + ["vilko", "grazt"] * (2 * (i % 6 == 0)) + w[9:]))
        toxic.append(int(i % 6 == 0) if i < 400 else None)
    texts += [prose(rnd, 30_000), texts[3], texts[3]]
    toxic += [None, None, 1]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if t is not None], "doc_id long, quality int, toxic int")
    frame = make(spark, texts).withColumn("score", F.lit("mine")).withColumn("_score", F.lit(1)).withColumn("_id", F.lit(2))
    got = rows(toxicity.op9(frame, labels))
    assert [got[i]["predicted"] for i in range(3, 603)] == [int(i % 6 == 0) for i in range(600)]
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] < 0.3 and not got[603]["predicted"] and got[604]["score"] == got[3]["score"]
    kept = toxicity.clean(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(not r["predicted"] for r in got.values())
    monkeypatch.setattr(toxicity, "HELD", 0)
    monkeypatch.setattr(toxicity, "MAX_SENT", 0)
    joined = rows(toxicity.op9(frame, labels))
    assert all(abs(got[i]["score"] - joined[i]["score"]) < 1e-9 and got[i]["predicted"] == joined[i]["predicted"] for i in got)


# ---- 10 decontamination --------------------------------------------------------------------


def brute_hits(texts, items, width=10):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(upper))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add("null" if i is None else str(i))
    out = []
    for t in texts:
        w = split(t)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("most", [50_000, 7])
def test_decontamination(spark, most):
    rnd = random.Random(61)
    items = [(i, prose(rnd, rnd.choice([3, 9, 10, 25]))) for i in range(12)] + [(3, "Shared Ünit, TEST"), (12, None), (13, "?!"), (None, "rare nullword item")]
    texts = [prose(rnd, 40) for _ in range(10)] + [None, "", "..."]
    for i, t in items[:8]:
        texts.append(prose(rnd, 10) + "; " + t.upper().replace(" ", " - ") + ". " + prose(rnd, 5) + " " + t)
    texts += ["x shared ünit test y", "shared Ünit test", "shared-ünit-TESTS", "a rare nullword item", " ".join(items[0][1].split() * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.scan(make(spark, texts), bench, max_windows=most)
    got = [tuple(r)[1:] for r in sorted(decontaminate.op10(make(spark, texts), bench).collect())] if most > 100 else None
    want = brute_hits(texts, items)
    if got:
        assert got == want
    by_id = rows(hits)
    assert [(r["hits"]["n_words"], r["hits"]["n_hit"], len(r["hits"]["items"])) for r in (by_id[i] for i in range(len(texts)))] == [w[:3] for w in want]
    # only A-Z is folded: the text before this one, with a small ü, is no hit
    assert by_id[len(texts) - 4]["hits"]["spans"] == [[0, len("shared Ünit test".encode())]] and not by_id[len(texts) - 5]["hits"]["spans"]
    if most > 100:
        kept = decontaminate.clean(make(spark, texts), bench)
        assert kept.columns == make(spark, texts).columns and {r["doc_id"] for r in kept.collect()} == {i for i, w in enumerate(want) if not w[4]}


def test_decontamination_by_join_is_that_of_the_automaton(spark):
    """Spans and items of every text, repeated ones and columns of the operator's names too; texts are scanned by one
    Python operator and their runs placed by another, whatever the number of windows."""
    rnd = random.Random(62)
    items = [(i, prose(rnd, rnd.choice([2, 5, 10, 11, 30]))) for i in range(40)]
    texts = [None, "", "  ", *[" ".join(rnd.choice([prose(rnd, 8), i[1], "-- " + i[1].upper()]) for i in rnd.sample(items, 3)) for _ in range(60)]]
    frame = make(spark, [*texts, *texts[:9]]).withColumns({"_id": F.lit(1), "id": F.lit(2), "first": F.lit(3)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    few = decontaminate.scan(frame, bench, max_windows=7)
    one = sorted(map(tuple, decontaminate.scan(frame, bench).select("doc_id", "_id", "hits").collect()))
    assert sorted(map(tuple, few.select("doc_id", "_id", "hits").collect())) == one and len(one) == len(texts) + 9
    assert few.columns == [*[c for c in frame.columns if c != "hits"], "hits"]
    assert few._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("MapInArrow") == 2


def test_decontamination_edges(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.op10(make(spark, ["a b", None]), empty).collect()} == {0}
    assert decontaminate.op10(make(spark, []).limit(0), empty).count() == 0
