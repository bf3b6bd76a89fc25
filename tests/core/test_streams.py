"""Streams over tables of several files, whose order is not that of time."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from caseloom.plans import catalog


def test_cash_out_keeps_pairs_of_shuffled_files(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i * i % 13 % 5, ("purchase", "error", "view")[i * i % 11 % 3], 1.0, '{"k": 1}') for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.repartition(10, F.xxhash64("event_id") % 10).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 8
    got = sorted((r["first_id"], r["second_id"]) for r in catalog.QUERIES["m3_cash_out_stream"](spark, str(tmp_path)).collect())
    first, second = ([r for r in rows if r[3] == t] for t in ("purchase", "error"))
    want = sorted((a[0], b[0]) for a in first for b in second if a[2] == b[2] and timedelta(0) <= b[1] - a[1] <= timedelta(hours=2))
    assert want and got == want
