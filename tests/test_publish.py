"""Versions of published tables, files by manifest, and the search index."""

import pytest
from pyspark.sql import functions as F

from vigil.functions.stem import stemmed
from vigil.operators import publish, text
from vigil.operators.build import KEY


def reports(spark, n, years=(2010, 2012, 2016, None)):
    rows = [(str(i), years[i % len(years)], f"P{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, f"{KEY} string, report_year int, product_code string")


def test_a_publish_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "site")
    assert publish.current(spark, root) is None
    write = lambda n: {"reports": lambda path: publish.write_reports(reports(spark, n), path, 2011), "small": lambda path: publish.write_small(reports(spark, n).groupBy("product_code").count(), path)}
    assert publish.publish(spark, root, write(40)) == "000001"

    def dies(path):
        reports(spark, 9).write.parquet(path)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        publish.publish(spark, root, write(80) | {"late": dies})
    assert publish.read_published(spark, root, "reports").count() == 40
    # written whole, but changed before it was compared
    sums = publish.file_sums
    monkeypatch.setattr(publish, "verify", lambda s, folder: sums(s, f"{folder}/tables").limit(1))
    with pytest.raises(ValueError):
        publish.publish(spark, root, write(80))
    monkeypatch.undo()
    assert publish.read_published(spark, root, "reports").count() == 40
    assert publish.publish(spark, root, write(80)) == "000004"
    assert publish.read_published(spark, root, "reports").count() == 80 and publish.current(spark, root).endswith("000004")


def test_verify_names_what_is_wrong(spark, tmp_path):
    root = tmp_path / "site"
    publish.publish(spark, str(root), {"t": lambda path: reports(spark, 40).repartition(3).write.parquet(path)})
    folder = publish.current(spark, str(root))
    assert publish.verify(spark, folder).count() == 0
    a, b, _ = sorted((root / "versions" / "000001" / "tables" / "t").glob("*.parquet"))
    a.write_bytes(a.read_bytes()[:-1] + b"x")
    b.rename(b.with_name("other.parquet"))
    for crc in a.parent.glob(".*.crc"):
        crc.unlink()
    got = {r["file"].rsplit("/", 1)[1]: r["problem"] for r in publish.verify(spark, folder).collect()}
    assert got == {a.name: "changed", b.name: "gone", "other.parquet": "not listed"}


def test_sums_are_of_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    spark.range(5000).selectExpr("id", "uuid() as u").coalesce(1).write.parquet(str(tmp_path / "t"))
    (path,) = (tmp_path / "t").glob("*.parquet")
    monkeypatch.setattr(publish, "CHUNK", 1000)
    (row,) = publish.file_sums(spark, str(tmp_path / "t")).collect()
    assert row["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest() and row["bytes"] == path.stat().st_size


def test_files_by_manifest(spark, tmp_path):
    root, rows = str(tmp_path / "site"), reports(spark, 400, (2005, 2010, 2012, 2014, 2016, 2019, None))
    publish.publish(spark, root, {"reports": lambda path: publish.write_reports(rows, path, 2011)})
    whole = publish.read_published(spark, root, "reports")
    for first, last in [(2012, 2014), (None, 2010), (2019, None), (2030, None), (2006, 2011)]:
        some = publish.read_published(spark, root, "reports", first, last)
        want = sorted(y for (y,) in rows.select("report_year").collect() if y is not None and (first or 0) <= y <= (last or 9999))
        assert sorted(r["report_year"] for r in some.collect()) == want
        assert len(some.inputFiles()) < len(whole.inputFiles())
    assert whole.count() == 400


def test_stems(spark):
    # from the publication
    want = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "bled": "bled", "sing": "sing", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
            "relational": "relat", "vietnamization": "vietnam", "decisiveness": "decis", "electrical": "electr", "replacement": "replac", "adoption": "adopt", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
            "controll": "control", "roll": "roll", "saying": "sai", "generalizations": "gener", "oscillators": "oscil", "by": "by", "as": "as", "sensibiliti": "sensibl", "dependent": "depend"}
    rows = stemmed(spark.createDataFrame([(w,) for w in want], "w string"), "w", "s").collect()
    assert {r["w"]: r["s"] for r in rows} == want


def test_search_reads_the_row_groups_of_its_stems(spark, tmp_path):
    texts = [(i, ["The pumps stopped, alarming!", "a pump is stopping", "nothing of it", None, "pumping pumped PUMP"][i % 5] + (f" word{chr(97 + i % 26)}x" if i % 5 != 3 else "") if i % 5 != 3 else None) for i in range(300)]
    df = spark.createDataFrame(texts, "k long, t string")
    text.write_index(df, "k", "t", str(tmp_path / "i"))
    found = text.search_index(spark, str(tmp_path / "i"), "Pump, stops?", 500).collect()
    assert {r["key"] for r in found} == {i for i, t in texts if t and "ump" in t.lower()}
    assert found[0]["key"] % 5 in (0, 1) and all(a["score"] >= b["score"] for a, b in zip(found, found[1:], strict=False))
    plan = text.search_index(spark, str(tmp_path / "i"), "pumps", 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(stem" in plan or "EqualTo(stem,pump)" in plan
    assert text.search_index(spark, str(tmp_path / "i"), " ,", 5).count() == 0
    assert [r["k"] for r in text.bm25(df, "k", "t", "pumps,", 500).collect()] != [] and text.bm25(df, "k", "t", "pump,", 500).count() == text.bm25(df, "k", "t", "pump", 500).count()


def test_index_splits_each_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(1, "pump pumps alarm"), (1, "pump pumps alarm"), (2, ""), (3, None), (4, "the a")]
    text.write_index(spark.createDataFrame(rows, "k long, t string").mapInArrow(look, "k long, t string"), "k", "t", str(tmp_path / "i"))
    assert seen.value == len(rows)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "i/facts")).select("docs", "mean").collect()] == [(4, 1.5)]
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "i/postings")).select("stem", "key", "length", "f").collect()} == {("pump", 1, 3, 4), ("alarm", 1, 3, 2)}


def test_manifest_counts_undated_rows(spark, tmp_path):
    reports(spark, 8).coalesce(1).write.parquet(str(tmp_path / "t"))
    row = publish.manifest(spark, str(tmp_path / "t")).first()
    assert (row["rows"], row["undated"], row["first_year"], row["last_year"]) == (8, 2, 2010, 2016)
    assert publish.manifest(spark, str(tmp_path / "t")).filter(F.col("rows") == 8).count() == 1


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_checks_from_one_pass_are_the_checks(spark, n):
    from vigil.operators import checks

    rows = [(f"2{i % 7:03d}-05-01" if i % 9 else None, (2000 + i % 7 if i < 55 else 2050) if i % 9 else None, "DM*"[i % 3], "D" if i % 4 == 0 else " ") for i in range(n)]
    df = spark.createDataFrame(rows, "day string, report_year int, EVENT_TYPE string, outcome_codes_raw string").withColumn("DATE_PREF", F.col("day").cast("date"))
    each = [checks.dates(df), checks.outcomes(df), checks.event_types(df), checks.year_volume(df)] if n else []
    got = checks.of_reports(df).collect()
    if n:
        assert sorted(map(tuple, got)) == sorted(tuple(r) for part in each for r in part.collect())
    else:
        assert {r["check"]: r["severity"] for r in got} == {"dated": 2, "date_range": 0, "outcome_coverage": 1, "event_type": 1}
