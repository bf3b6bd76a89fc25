import base64
import hashlib

from caseloom.llm import warc


def test_round_trip_with_copies_nulls_and_repeated_rows(spark):
    big = "<p>" + "x y " * 50_000
    rows = [(5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (3, "http://b", None), (4, None, ""), (7, "http://c\r\n", "é\r\n\r\nWARC/1.1"), (7, "http://c\r\n", "é\r\n\r\nWARC/1.1"), (8, "http://d", big), (None, "http://e", "same")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, offset string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 8
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (h or "").encode()
        first.setdefault(raw, i)
        r = got[i]
        assert r["payload_bytes"] == len(raw)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[raw] == i else ("revisit", first[raw]))


def test_small_payloads_stay_responses_and_ranges_select(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "same" if i < 3 else "long payload" if i < 5 else str(i)) for i in range(40)], "page_id long, url string, html string")
    index = warc.build_index(pages, min_bytes=5, pages_per_archive=10)
    assert {r["page_id"] for r in index.filter("record_type = 'revisit'").collect()} == {4}
    files = warc.write_archives(pages, index, pages_per_archive=10)
    want = index.filter("page_id % 7 = 0")
    read = warc.read_records(want, files, gap=0).collect()
    assert sorted(int(r["page"]) for r in read) == [i for i in range(40) if i % 7 == 0]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_row_is_a_record(spark):
    """Repeated rows, one page with two URLs, and copies of a null id; each row comes back, and so do its bytes."""
    rows = [(1, "http://a", "same")] * 5 + [(1, "http://b", "same"), (4, "http://a", "same"), (4, "http://a", "same"), (6, "http://c", "z"), (None, "http://d", "z"), (None, "http://d", "z"), (7, None, None), (7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.round_trip(pages).collect()))
    want = [(1, "response", 0, 4)] * 6 + [(4, "revisit", 1, 4)] * 2 + [(6, "response", 0, 1)] + [(0, "revisit", 6, 1)] * 2 + [(7, "response", 0, 0)] * 2
    assert got == sorted(want)
    index = warc.build_index(pages, pages_per_archive=4)
    files = warc.write_archives(pages, index, pages_per_archive=4)
    read = warc.read_records(index, files).collect()
    assert len(read) == len(rows) and sum(bytes(r["payload"]) == b"same" for r in read) == 6
