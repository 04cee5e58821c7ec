"""The whole pipeline on the smallest driver tables, each stage against its own input, and the registered SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import awkward, brute_classes, brute_hits, fill, make

import corpus_pipeline
from vigil.llm import registry, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["input"] = docs
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, FOLDER).write.parquet(str(base / name))
        out[name] = docs = spark.read.parquet(str(base / name))
    return out


def test_columns_and_rows(stages):
    want = stages["input"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == want
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in stages.items()}
    order = ["input", *[n for n, _ in corpus_pipeline.STAGES]]
    for a, b in zip(order, order[1:], strict=False):
        assert ids[b] <= ids[a]
    assert ids["sharding"] and len(ids["near_duplicates"]) == stages["near_duplicates"].count()


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "size", "shard", "slot").collect()))
    assert key(got) == key(stages["sharding"])


def test_no_copies_or_benchmark_text_remain(spark, stages):
    kept = stages["decontamination"]
    assert kept.filter(F.length("text") > 0).groupBy("text").count().filter("count > 1").count() == 0


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "source").collect()))


def test_toxicity_stage_drops_what_scores_high(spark, stages):
    scored = toxicity.op9(stages["input"], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    low = {r["doc_id"] for r in scored.filter("predicted = 0").collect()}
    assert rows_of(stages["toxicity"]) == [r for r in rows_of(stages["input"]) if r[0] in low] and low


def test_near_duplicate_stage_keeps_one_of_each_plain_class(stages):
    before = rows_of(stages["toxicity"])
    assert len({r[0] for r in before}) == len(before)
    lowest, _ = brute_classes([r[1] for r in before])  # by place, which is in order of doc_id
    want = [r for i, r in enumerate(before) if lowest[i] == i or not (r[1] or "").split()]
    assert rows_of(stages["near_duplicates"]) == want


def test_decontamination_stage_drops_plain_hits(spark, stages):
    before = rows_of(stages["near_duplicates"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = brute_hits([r[1] for r in before], items)
    assert rows_of(stages["decontamination"]) == [r for r, h in zip(before, hits, strict=True) if not h[4]]


def test_mixing_stage_begins_documents_in_stream_order(stages):
    """Each source's documents in order of their hash, again and again, until its target's words are taken."""
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    before = stages["decontamination"].select("doc_id", "text", "source", F.xxhash64("doc_id", F.lit(20)).alias("h")).collect()
    streams = defaultdict(list)
    for r in before:
        streams[r["source"]].append(r)
    assert max(map(len, streams.values())) <= 2048  # one bucket: the order is the hash's
    goals = fill({s: sum(size(r["text"]) for r in docs) for s, docs in streams.items()})
    want = Counter()
    for s, docs in streams.items():
        at = 0
        for r in sorted(docs, key=lambda r: r["h"]) * 3:
            if size(r["text"]) and at < int(goals[s] + 1e-6):
                want[r["doc_id"]] += 1
            at += size(r["text"])
    assert Counter(r["doc_id"] for r in stages["mixing"].select("doc_id").collect()) == want


def test_sharding_stage(stages):
    got = stages["sharding"].collect()
    assert len(got) == stages["mixing"].count()
    slots, sizes, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        homes[r["doc_id"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in homes.values())
    whole = Counter()  # copies of a text stay together
    for r in got:
        whole[r["doc_id"]] += r["size"]
    assert max(sizes.values()) - min(sizes[i] for i in range(24)) <= max(whole.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    texts = awkward(random.Random(5))
    odd = make(spark, texts, ids=[None, 3, 3, *range(4, len(texts) + 1)], sources=[None, "a", "b"] * len(texts))
    # columns of the names that the operators give their own
    odd = odd.withColumns({c: F.lit("mine") for c in ("_hits", "_row_id", "_copy", "_copies", "_slots", "_slot", "_id", "_row", "_gone", "_score", "_mark", "grp", "h", "key", "id", "taken")})
    got = stage(spark, odd, FOLDER)
    if name != "sharding":
        assert got.columns == odd.columns
        assert {tuple(r) for r in got.select("_hits", "_row_id", "_copies", "_id", "_row", "_gone", "_score", "_mark", "key", "id").distinct().collect()} <= {("mine",) * 10}
    assert {r["text"] for r in got.select("text").collect()} <= set(texts) if "text" in got.columns else got.count() == len(texts)
    assert stage(spark, odd.limit(0), FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = registry.queries()[name](spark, FOLDER)
    want = con.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    expected = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(repr([r[c] for c in order]) for r in expected)
