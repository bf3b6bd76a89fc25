"""Trigram search against a scan, sentence chunks against a loop, checked rows, and ranges read from a database."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import search, text, validate
from caseloom.sources.registry import Sources

# --- search -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vertices(spark):
    r = random.Random(3)
    rows = [(f"v{i}", f"l{i % 3}", {"name": "".join(r.choice("abcx ") for _ in range(r.randint(0, 12))), "no": str(r.randint(0, 10**6)), "odd": None if i % 5 else "한글 계좌 é"}) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "v_id string, label string, props map<string,string>").repartition(4)


def test_search_matches_a_scan(spark, vertices, tmp_path):
    rows, df = vertices
    index = search.Index(spark, str(tmp_path), 16).build(df)
    for keyword in ("abc", "abcx", "a", "", "1234", "글 계좌", "xxxxxxxxxx", "not there", "c a"):
        for names in (None, ["name"], ["no", "missing"]):
            want = {v for v, _, p in rows if any(x is not None and keyword in x for n, x in p.items() if names is None or n in names)}
            found = [r["v_id"] for r in index.search(keyword, names).collect()]
            assert set(found) == want and len(found) == len(want), (keyword, names)


def test_search_reads_few_rows(spark, vertices, tmp_path):
    rows, df = vertices
    index = search.Index(spark, str(tmp_path), 64).build(df)
    keyword = next(p["no"] for _, _, p in rows if len(p["no"]) == 6)
    found = index.candidates(keyword)
    buckets = {r[0] for r in found.select("bucket").distinct().collect()}
    assert 0 < found.count() < 60
    read = index.elements().filter(F.col("bucket").isin(list(buckets))).count()
    assert read < len(rows) / 2  # the other buckets' folders are not opened
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_around_has_edges_and_missing_ends(spark):
    v = spark.createDataFrame([("a:1", "a"), ("a:2", "a"), ("b:1", "b")], "v_id string, label string")
    e = spark.createDataFrame([("a:1", "b:9", "x"), ("a:2", "b:1", "x"), ("c:1", "c:2", "x"), ("c:3", "a:1", "y")], "src string, dst string, label string")
    assert sorted(tuple(r) for r in search.around(v, e).collect()) == sorted([("node", "a:1", "a"), ("node", "a:2", "a"), ("node", "b:1", "b"), ("edge", "a:1>b:9", "x"), ("edge", "a:2>b:1", "x"), ("edge", "c:3>a:1", "y"), ("end", "b:9", "b"), ("end", "c:3", "c")])
    assert {r["kind"] for r in search.around(v, e, 1, 1).collect()} == {"node", "edge", "end"} and search.around(v, e, 1, 1).filter("kind = 'node'").count() == 2


# --- chunks -------------------------------------------------------------------------------------


def cut_points(t, size, overlap):
    out, start, n = [], 0, len(t)
    while start < n:
        end = start + size
        piece = t[start:end]
        if end < n:
            stop = max(piece.rfind("."), piece.rfind("\n"))
            if stop > size // 2:
                piece, end = piece[: stop + 1], start + stop + 1
        if piece.strip():
            out.append(piece.strip())
        start = end - overlap
        if end >= n:
            break
    return out


def test_chunks_match_a_loop(spark, monkeypatch):
    r = random.Random(7)
    texts = ["", None, ".", "x" * 1000, " \n" * 700, "한" * 501, "🙂." * 400, "a" * 251 + "." + "b" * 600, "a" * 250 + "." + "b" * 600] + ["".join(r.choice(["a", "b", " ", ".", "\n", "word ", "é"]) for _ in range(r.randint(0, 4000))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(i, k): p for i, t in enumerate(texts) for k, p in enumerate(cut_points(t or "", 500, 50))}
    for chars in (1 << 20, 700):
        monkeypatch.setattr(text, "CHARS", chars)
        rows = text.chunks(df).collect()
        assert {(r["doc_id"], r["chunk_index"]): r["text"] for r in rows} == want and len(rows) == len(want)


# --- validation ---------------------------------------------------------------------------------


def test_valid_and_rejected_rows_are_told_apart(spark):
    rows = [
        ("2024-000123", "123-456-7890", "+82 10 1234 5678", "1,200.50", "2024-02-29 10:00:00", 1), ("2024-123", "123", "12", "0", "2023-02-29T10:00", 2), (None, "", None, "", " ", 3),
        (" 2024-000001 ", "1234567890", "02 123 4567", "5", "2024-01-01T00:00", 4), ("2024-000001", "-234567890-", "010-12-567", "1.005", "01.01.2024 10:00", 5), ("2024-000001", "12345678901234567890", "031 123 4567", "-5", "2024-01-01", 6),
    ]
    df = spark.createDataFrame(rows, "case_no string, account string, phone string, amount string, reported string, line long").withColumns({"errors_": F.lit(1), "ok_": F.lit(2)})
    rules = [validate.case_number("case_no"), validate.account("account"), validate.phone("phone"), validate.amount("amount"), validate.iso_time("reported")]
    valid, rejected, counts = validate.split(df, rules)
    assert sorted((r["line"], r["case_no"], r["phone"], r["amount"], r["reported"]) for r in valid.collect()) == [(1, "2024-000123", "010-1234-5678", "1200.50", "2024-02-29T10:00:00"), (4, "2024-000001", "02-123-4567", "5", "2024-01-01T00:00")]
    every = ["case_number", "account", "phone", "amount", "iso_time"]
    assert {r["line"]: list(r["errors"]) for r in rejected.collect()} == {2: every, 3: every, 5: ["account", "phone", "amount", "iso_time"], 6: ["amount", "iso_time"]}
    assert counts == {"rows": 6, "valid": 2, "case_number": 2, "account": 3, "phone": 3, "amount": 4, "iso_time": 4}
    assert valid.columns == df.columns
    loose = validate.Rule("account", "account", lambda c: c, lambda c: c.rlike("^[0-9]+$"), required=False)
    assert validate.checked(df, [loose]).filter("size(errors) = 0").count() == 4
    assert [x.count() for x in validate.split(df.limit(0), rules)[:2]] == [0, 0]


# --- sources ------------------------------------------------------------------------------------


def test_ranges_of_a_database_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"), F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    rows = rows.unionAll(spark.range(3).select(F.lit(None).cast("long"), F.lit("none"), F.lit(None).cast("timestamp")))
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows.coalesce(1).write.format("jdbc").options(url=url, driver=driver, dbtable="people").save()
    rows.limit(0).write.format("jdbc").options(url=url, driver=driver, dbtable="nobody").save()
    sources = Sources()
    sources.add("db", url=url, driver=driver)
    sources.add("files", path=str(tmp_path / "files"))
    spark.range(5).write.parquet(str(tmp_path / "files" / "five.parquet"))
    with pytest.raises(ValueError):
        sources.add("no spaces", url=url)
    assert sources.names() == ["db", "files"] and sources.tables(spark, "files") == ["five"] and sources.read(spark, "files", "five").count() == 5
    tables = sources.tables(spark, "db", "SELECT tablename FROM sys.systables WHERE tabletype = 'T'")
    assert tables == ["NOBODY", "PEOPLE"]
    for by in ("k", "at"):
        df = sources.read(spark, "db", "people", by, rows=251)
        assert df.rdd.getNumPartitions() == 4 and df.count() == 1003 and df.filter("k is null").count() == 3
    one = sources.read(spark, "db", "people", "k", rows=251).filter("k = 77").select("name")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(K,77)" in plan.replace("k", "K") and [r["name"] for r in one.collect()] == ["name 77"]
    assert sources.read(spark, "db", "nobody", "k").count() == 0 and sources.read(spark, "db", "people").count() == 1003
    sources.remove("db")
    assert sources.names() == ["files"]
