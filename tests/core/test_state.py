"""The stateful mule tracker and the bucketed edge store: several batches, out of order, restarts, replays."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from caseloom.streaming import edge_store, mules

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def write_batch(spark, path, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/batch={n}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA + ", batch int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in").drop("batch")


def wanted(rows, hours=24, least=3):
    ins = [(u, t) for _, t, u, kind in rows if kind == "in"]
    out = {}
    for i, t, u, kind in rows:
        if kind == "out":
            n = sum(v == u and t - timedelta(hours=hours) <= s <= t for v, s in ins)
            if n >= least:
                out[u, i] = n
    return out


def tracked(spark, path):
    kind = F.col("event_type")
    rows = mules.mules(stream(spark, path), kind == "in", kind == "out", 24, 3, f"{path}/state").collect()
    return {(r["user_id"], r["out_id"]): r["ins"] for r in rows}


def test_mules_over_batches_out_of_order_and_a_restart(spark, tmp_path):
    """Within the hour that the watermark allows, rows come in any order, before and after a restart from the checkpoint."""
    r, path = random.Random(4), str(tmp_path)
    rows = [(i, START + timedelta(minutes=i * 10), r.randint(0, 4), r.choice(["in", "in", "in", "out", "other"])) for i in range(600)]
    late = sorted(rows, key=lambda x: x[1] + timedelta(minutes=r.randint(0, 50)))
    for n in range(3):
        write_batch(spark, path, n, late[n * 100 : (n + 1) * 100])
    assert tracked(spark, path) == wanted(late[:300])
    for n in range(3, 6):
        write_batch(spark, path, n, late[n * 100 : (n + 1) * 100])
    got = tracked(spark, path)
    assert got == wanted(late) and len(got) > 100
    assert tracked(spark, path) == got  # nothing new: nothing changes


def test_old_payments_leave_the_state(spark):
    """What is kept of an account is the last day's payments and the payouts that a late payment can still come before."""

    class Handle:
        def __init__(self):
            self.value, self.timers = None, []

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def listTimers(self):
            return list(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    import pandas as pd

    m, handle = mules.Mules(100, 1), Handle()
    m.init(handle)
    for k in range(50):
        rows = pd.DataFrame({"ms": [k * 30, k * 30 + 1], "event_id": [2 * k, 2 * k + 1], "is_in": [True, False]})
        list(m.handleInputRows((1,), iter([rows]), Now(max(0, k * 30 - 60))))
        assert len(handle.value[0]) <= 7 and len(handle.value[1]) <= 4 and len(handle.timers) == 1
    list(m.handleExpiredTimer((1,), Now(handle.timers[0]), None))
    assert handle.value is None and handle.timers == []


def edges(spark, pairs):
    return spark.createDataFrame([(f"a{x}", f"b{y}", "knows") for x, y in pairs], "src string, dst string, label string")


def test_what_a_batch_reads_does_not_grow(spark, tmp_path):
    store, r, seen, read = edge_store.EdgeStore(spark, str(tmp_path), bucket_rows=20), random.Random(1), set(), []
    for n in range(12):
        batch = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(40)] + list(seen)[:3]
        done = store.merge(edges(spark, batch + batch[:5]), n)
        seen |= set(batch)
        read.append(done["read"])
        assert done["buckets"] <= 43 and done["read"] <= 43 * 40
        rows = [(x["src"], x["dst"]) for x in store.edges(n).collect()]
        assert len(rows) == len(seen) and set(rows) == {(f"a{x}", f"b{y}") for x, y in seen}
        assert max(e[3] for e in store.manifest(n)) <= 40  # twice at most, by the luck of the hash
    before = store.manifest(11)
    assert sum(e[3] for e in before) == len(seen)
    again = store.merge(edges(spark, batch + batch[:5]), 11)  # a replay
    assert sorted(e[:2] + e[3:] for e in store.manifest(11)) == sorted(e[:2] + e[3:] for e in before) and again["read"] == read[-1]
    assert store.merge(edges(spark, []), 12) == {"read": 0, "written": 0, "buckets": 0} and store.edges(12).count() == len(seen)


def test_one_bucket_is_read_for_one_edge(spark, tmp_path):
    store = edge_store.EdgeStore(spark, str(tmp_path), bucket_rows=50)
    store.merge(edges(spark, [(i, i) for i in range(3000)]), 0)
    done = store.merge(edges(spark, [(7, 7), (9999, 1)]), 1)
    assert done["buckets"] <= 2 and done["read"] <= 200 and store.edges(1).count() == 3001


def test_load_edges_from_a_stream_and_again(spark, tmp_path):
    path = str(tmp_path)
    schema = "src string, dst string, label string"
    for n in range(3):
        edges(spark, [(i, n // 2) for i in range(30)]).coalesce(1).write.parquet(f"{path}/in/batch={n}")
    source = lambda: spark.readStream.schema(schema + ", batch int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in").drop("batch")
    assert edge_store.load_edges(source(), f"{path}/store", 10).count() == 60
    assert edge_store.load_edges(source(), f"{path}/store", 10).count() == 60
