from __future__ import annotations

import hashlib

import pytest

from tessera.llm.warc import arc_records, pages_through_warc, read_warc, warc_records

SCHEMA = "page_id long, url string, html string, URL string, kind string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "u", "k") for r in rows], SCHEMA)
    return pages_through_warc(df, payloads=True).collect()


def test_round_trip_and_revisits(spark):
    big, small = "<p>héllo</p>" * 20, "tiny"
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nfiledesc://x 0 0 0 3\n" * 4
    rows = [(5, "http://a/", big), (3, "http://b c/", big), (9, None, big), (1, "http://d/", small), (2, "http://e/", small), (4, "http://f/", None), (6, "http://g/", tricky), (7, "http://h/", "z" * 300_000), (None, "http://i/", big)]
    got = run(spark, rows)
    by_id = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert by_id[i]["payload_bytes"] == len(raw) and by_id[i]["payload_digest"] == hashlib.sha256(raw).hexdigest()
        if by_id[i]["record_type"] == "response":
            assert by_id[i]["payload"] == raw
    assert by_id[3]["record_type"] == "response" and by_id[3]["refers_to"] is None
    for i in (5, 9, None):
        assert by_id[i]["record_type"] == "revisit" and by_id[i]["refers_to"] == 3 and by_id[i]["refers_to_id"] == by_id[3]["record_id"]
    assert by_id[1]["record_type"] == by_id[2]["record_type"] == "response"


def test_repeated_rows_and_an_empty_table(spark):
    same = (1, "http://a/", "y" * 200)
    assert [r["record_type"] for r in run(spark, [same, same])] == ["response", "response"]
    assert run(spark, []) == []


def test_both_versions_of_arc():
    v1 = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 3\n1 0\n\nhttp://x/ y 1.2.3.4 20010203040506 text/html 5\nhello\n"
    v2 = b"filedesc://b.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 b.arc 3\n2 0\n\ndns:x 1.2.3.4 20010203040506 text/dns 200 abc - 99 b.arc 4\nab\nc\n"
    a, b, c, d = [*arc_records(v1, "a"), *arc_records(v2, "b")]
    assert (a["kind"], c["kind"]) == ("warcinfo", "warcinfo")
    assert (b["url"], b["kind"], b["payload"], b["date"]) == ("http://x/ y", "resource", b"hello", "2001-02-03T04:05:06Z")
    assert (d["url"], d["payload"]) == ("dns:x", b"ab\nc")
    assert len(list(arc_records(v1 + v2, "both"))) == 4
    with pytest.raises(ValueError):
        list(arc_records(v1[:-4], "cut"))
    with pytest.raises(ValueError):
        list(warc_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", "cut"))


def test_archives_are_warc_files(spark, tmp_path):
    import gzip

    from tessera.llm.warc import archives_of, convert_arc

    df = spark.createDataFrame([(1, "http://a/", "<b>x</b>")], "page_id long, url string, html string")
    archives_of(df, f"file://{tmp_path}/arc")
    convert_arc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "warc").glob("part-*.gz")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and b"WARC-Type: warcinfo" in raw
    assert read_warc(spark, f"file://{tmp_path}/warc").count() == 2


def test_pages_that_share_the_smallest_id_all_stay_responses(spark):
    body = "w" * 300
    got = run(spark, [(1, "http://a/", body), (1, "http://b/", body), (2, "http://c/", body), (None, "http://d/", body)])
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got)
    assert kinds == [("1", "response", "None"), ("1", "response", "None"), ("2", "revisit", "1"), ("None", "revisit", "1")] and all(r["intact"] for r in got)


def test_a_revisit_of_something_else_is_not_intact(spark, tmp_path):
    import gzip

    from tessera.llm.warc import archives_of, convert_arc

    df = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200)], "page_id long, url string, html string")
    archives_of(df, f"file://{tmp_path}/arc")
    convert_arc(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "warc").glob("part-*.gz")))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.warc.gz").write_bytes(gzip.compress(raw.replace(b"x" * 200, b"y" * 200)))
    got = {r["record_type"]: r["intact"] for r in read_warc(spark, f"file://{tmp_path}/other").collect()}
    assert got == {"warcinfo": True, "response": False, "revisit": False}


def test_each_archive_is_a_file(spark, tmp_path):
    from tessera.llm.warc import archives_of

    df = spark.createDataFrame([(i % 3, "http://a/", "z" * 1000) for i in range(400)], "page_id long, url string, html string")
    archives_of(df, f"file://{tmp_path}/arc", 40_000)
    files = sorted((tmp_path / "arc").glob("part-*.gz"))
    import gzip

    tops = [gzip.decompress(f.read_bytes()).count(b"filedesc://") for f in files]
    assert tops == [1] * 11
