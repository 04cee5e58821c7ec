"""Conversation tries, personal data and source divergence against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from vigil.llm import divergence, pii, prefixes

# ---- op11 ----------------------------------------------------------------------------------

CONVERSATION = "conv_id long, turn long, role string, text string, box string, path int, seq string, depth int"


def plain_trie(table):
    own = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = Counter(path[:-1] for path in nodes if path)
    leaves, saved = Counter(), Counter()
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(members) - 1) * (len(path[-1][1].encode()) if path else 0)
    sha = lambda path, members: hashlib.sha256(",".join(str(c) for c in members if whole[c] == path).encode()).hexdigest()
    return {
        (m[0], len(p)): (nodes[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(p, m)) for p, m in nodes.items()
    }


def built(df):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(11)
    said = ["", "hi", "été", "a long answer " * 5, None, "so"]
    rows = []
    for c in range(-7, 40):
        for t in range(rnd.choice([0, 1, 2, 4, 9, 12])):
            rows.append((c, rnd.choice([t, t, None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(said)))
    same = [(None, "system", "rules"), *[(t, "user", f"step {t}") for t in range(30)]]
    rows += [(c, *x) for c in (100, 105, 110, 101, 202) for x in same]  # copies, and a long shared opening
    rows += [(115, *x) for x in same[:20]] + [(120, *x) for x in same] + [(120, 50 + i, "user", str(i)) for i in range(250)]
    rows += [(None, 1, "user", "nobody's"), rows[3], rows[3]]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("container", [8, prefixes.CONTAINER])
def test_trie_equals_plain_nodes(spark, talks, container):
    df = spark.createDataFrame([(*r, "b", 1, "s", 2) for r in talks], CONVERSATION).repartition(5)
    found = prefixes.op11(df, container)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = built(found)
    assert got == plain_trie(talks)
    assert found.count() == len(got)


def test_trie_of_nothing_and_of_empty_conversations(spark):
    assert prefixes.op11(spark.createDataFrame([], CONVERSATION)).count() == 0
    # h is 5 for 3 and 6: no base, and nothing of their own is left
    rows = [(c, 1, "user", "x") for c in (3, 6) if zlib.crc32(str(c).encode()) % 9 > 0]
    assert built(prefixes.op11(spark.createDataFrame([(*r, "b", 1, "s", 2) for r in rows], CONVERSATION))) == plain_trie(rows)


def test_containers_are_bounded_and_bursts_are_few(spark, talks):
    df = spark.createDataFrame([(*r, "b", 1, "s", 2) for r in talks], CONVERSATION)
    rows = prefixes.turns(df).cache()
    convs = rows.select("conv_id").distinct()
    _, kinds = prefixes.sequences(rows, convs)
    of = rows.join(kinds.select(F.col("seq").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "seq")
    containers, edges = prefixes.burst(of, kinds, 20)
    sizes = containers.join(of, "seq").filter("pos > depth").groupBy("box").count()
    assert sizes.agg(F.max("count")).first()[0] <= 20
    assert edges.agg(F.max(F.size("path"))).first()[0] <= 12  # 250 turns in one edge, not 250 rounds
    rows.unpersist()


# ---- op12 ----------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain_base(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            found += [(kind, *m.span())] if ok else []
    return found


def odd_texts():
    rnd = random.Random(12)
    pieces = ["a.b@c.d", "@", "@@", "x@y", "x@y.", "u@h-1.example.com.", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "001.02.3.255", "1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "49302 82347 79928 81 3", "+1 (017) 555-7713",
              "+49", "+4--", "+1.5", "++12345678", "é", "日本", " ", "-", ".", "+", "12", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "ssn 078-05-1120", "order 078-05-1120", "call 555-123-4567", "tel (212) 555-0100", "DE89370400440532013000", "%_+@a-.b-"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", "x", "1"]) for _ in range(rnd.randrange(1, 12))) for _ in range(3000)]
    return [None, "", *pieces, *texts, *["".join(rnd.choice("0123456789.-+@ (a") for _ in range(rnd.randrange(60))) for _ in range(3000)]]


def test_base_spans_equal_plain_patterns():
    for text in odd_texts():
        found = pii.spans(text)
        assert [(x["kind"], x["start"], x["end"]) for x in found if x["kind"] in pii.BASE] == plain_base(text), text
        assert all(x["value"] == text[x["start"] : x["end"]] for x in found)


def test_added_spans_need_checksum_or_context():
    kinds = lambda text: [x["kind"] for x in pii.spans(text)]
    assert kinds("pay GB82 WEST 1234 5698 7654 32 now") == ["iban"] and kinds("pay GB82 WEST 1234 5698 7654 33 now") == []
    assert kinds("my SSN: 078-05-1120.") == ["ssn"] and kinds("078-05-1120") == [] and kinds("SSN 666-05-1120") == []
    assert kinds("ssn of order 078-05-1120") == []
    assert kinds("please call (212) 555-0100") == ["local_phone"] and kinds("see (212) 555-0100") == []
    assert kinds("call +1 (212) 555-0100") == ["phone"]
    near, far = pii.spans("card 4111111111111111")[0], pii.spans("invoice 4111111111111111")[0]
    assert near["score"] > far["score"]
    assert pii.masked("to a@b.co, +1 (212) 555-0100!") == "to <email>, <phone>!" and pii.masked(None) is None


def test_hostile_texts_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "@" * 300_000, "1." * 300_000, "+1(" * 300_000, "1 " * 300_000, "A1" * 300_000, "a@b" * 200_000):
        pii.spans(text)
    assert time.perf_counter() - began < 30


def test_op12_rows(spark):
    texts = odd_texts()[:400]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(5, texts[5], 1, "x")], "doc_id long, text string, n_email int, score string").repartition(4)
    got = pii.op12(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        base = plain_base(texts[r["doc_id"]])
        listed = lambda spans: ",".join(":".join(map(str, x)) for x in spans)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert r["spans"] == listed((x["kind"], x["start"], x["end"]) for x in pii.spans(texts[r["doc_id"]]))
    masked = pii.redact(df.filter("doc_id = 2"))
    assert masked.columns == df.columns and pii.find(df.limit(0)).count() == 0


def test_op12_sql_on_odd_texts():
    """The DuckDB twin against the operator where it is hardest."""
    con, texts = duckdb.connect(), odd_texts()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts[:2000])))
    got = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, spans, n_added FROM ({pii.SQL})").fetchall()}
    for i, (listed, added) in got.items():
        found = pii.spans(texts[i])
        assert listed == ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in found) and added == sum(x["kind"] in pii.ADDED for x in found), texts[i]
    assert len(got) == 2000 and sum(n for _, n in got.values()) > 50


# ---- op13 ----------------------------------------------------------------------------------


def plain_audit(docs, min_df):
    terms = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))) for text, lang, source in docs]
    out = []
    for lang in {x[0] for x in terms}:
        mine = [x for x in terms if x[0] == lang]
        df = Counter(t for _, _, words in mine for t in set(words))
        kept = [t for t, n in df.items() if n >= min_df]
        counts = {s: Counter() for _, s, _ in mine}
        for _, s, words in mine:
            counts[s].update(t for t in words if df[t] >= min_df)
        share = lambda c, t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept))
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(o, sum(abs(share(c, t) - share(counts[o], t)) for t in kept)) for o in counts if o != s]
            above = [(t, share(c, t) - share(whole, t)) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items, k in (("pair", pairs, None), ("term", above, 50)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:k]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(13)
    lexicon = ["ka", "Lomi", "tuva", "résumé", "ÉTÉ", "日本", "x1y", "mar2dosi", "fen", "😀", "zet"]
    docs = [(" ".join(rnd.choice(lexicon[i % 4 :]) for _ in range(rnd.randrange(20))), ["en", "fr", None, "\0odd"][i % 4], f"s{i % 7}" if i % 9 else None) for i in range(300)]
    return [*docs, (None, None, "lonely"), ("", "en", ""), ("unique", "rare", "a"), (None, "rare", "b"), docs[0], docs[0]]


def audited(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("held", [divergence.HELD, 3])
def test_audit_equals_plain_shares(spark, corpus, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    df = spark.createDataFrame([(*d, 1, 2, "z") for d in corpus], "text string, lang string, source string, place int, n int, item string").repartition(5)
    assert audited(divergence.audit(df, min_df=5)) == plain_audit(corpus, 5)


def test_audit_by_tiles(spark, corpus):
    df = spark.createDataFrame(corpus, "text string, lang string, source string")
    counts = divergence.counted(df, 5)
    every = divergence.groups(df, counts).cache()
    tiles = lambda **x: sorted(tuple(r) for r in divergence.distances(counts, every, **x).collect())
    assert tiles(sources=2, terms=3) == tiles()


def test_audit_of_nothing_kept(spark):
    docs = [("one two", "en", "a"), ("three", "en", "b"), (None, "en", "c")]
    assert audited(divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string"))) == plain_audit(docs, 30)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@pytest.mark.parametrize("size", [2**31 - 1, 4])
def test_sums_are_those_of_the_count_vectorizer(spark, corpus, size):
    df = spark.createDataFrame(corpus, "text string, lang string, source string")
    found = defaultdict(Counter)
    for r in divergence.counted(df, 5, size).collect():
        found[r["lang"]][r["source"], r["term"]] += r["n"]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), "")
    for lang in ("en", "fr"):
        rows = df.filter(F.col("lang") == lang).select(F.coalesce("source", F.lit("")).alias("source"), words.alias("w"))
        model = CountVectorizer(inputCol="w", outputCol="v", minDF=5.0, vocabSize=size).fit(rows)
        want = Counter()
        for r in model.transform(rows).collect():
            want.update({(r["source"], model.vocabulary[i]): int(n) for i, n in zip(r["v"].indices, r["v"].values, strict=True)})
        assert found[lang] == want if size > 4 else sum(found[lang].values()) == sum(want.values())


def test_shares_beyond_long(spark):
    n = 9_000_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(1000)).alias("p")).first()
    assert row["p"] == 1 + (10**9 * (n + 5)) // (3 * n + 5000)
