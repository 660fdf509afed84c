import hashlib
import json

import pytest

from examlytics.llm import warc as m


def test_records_round_trip():
    made = [m.response("http://a/é", "<p>x</p>"), m.response("", "")]
    data = b"".join(m.to_bytes(*r) for r in made)
    assert list(m.parse(data)) == made
    with pytest.raises(ValueError):
        list(m.parse(b"nonsense\r\n\r\n"))


def test_derivatives_are_linked():
    headers, block = m.response("http://a/", "<title>T</title><nav><a href='/b'>B</a></nav><p>One &amp; two</p><script>x</script>")
    (meta, facts), (conv, text) = m.derivatives(headers, block)
    source = m.field(headers, "WARC-Record-ID")
    assert m.field(meta, "WARC-Refers-To") == m.field(conv, "WARC-Refers-To") == source
    assert m.field(conv, "WARC-Concurrent-To") == m.field(meta, "WARC-Record-ID") != source
    assert text == b"B\nOne & two\n"
    body = json.loads(facts)
    assert body["source"] == dict(headers) and body["html"] == {"title": "T", "links": ["/b"]}
    assert body["http"]["status"].startswith("HTTP/1.1 200") and body["payload"]["digest"] == m.field(headers, "WARC-Payload-Digest")
    assert m.field(conv, "WARC-Block-Digest") == m.digest(text)
    assert m.derivatives([("WARC-Type", "warcinfo")], b"") == []
    assert [b for _, b in m.derivatives([("WARC-Type", "response")], b"no head <p>x")][1] == b"no head\nx\n"


def test_pages_and_files(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>", 5), (2, None, None, 5), (None, "http://b/", "", 5), (1, "http://a/", "<p>x</p>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id long")
    records = m.responses(pages)
    out = m.derive(records, "page_id").collect()
    assert len(out) == 8 and sorted({r.record_type for r in out}) == ["conversion", "metadata"]
    assert len({r.record_id for r in out}) == 6
    for r in out:
        ((headers, block),) = m.parse(bytes(r.record))
        assert len(block) == r.content_length and m.digest(block) == r.block_digest and m.field(headers, "WARC-Record-ID") == r.record_id
    data = b"".join(bytes(r.record) for r in records.select("record").collect())
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(b"")
    again = m.read_records(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(bytes(r.record) for r in again.collect()) == sorted(bytes(r.record) for r in records.select("record").collect())
    assert m.derive(again, "path").count() == 8
    assert m.derive(m.responses(pages.limit(0)), "page_id").count() == 0


def test_query_reads_every_page(spark):
    d = "/root/testdata/sf0.001"
    out = m.op9_warc_derivatives(spark, d)
    assert out.count() == 2 * spark.read.parquet(f"{d}/pages.parquet").count()
    page = spark.read.parquet(f"{d}/pages.parquet").first()
    source = dict(m.response(page.url, page.html)[0])
    row = out.filter((out.page_id == page.page_id) & (out.record_type == "conversion")).first()
    assert row.refers_to == source["WARC-Record-ID"] and row.source_digest == "sha1:" + __import__("base64").b32encode(
        hashlib.sha1(page.html.encode()).digest()).decode()


def test_repeated_fields_all_stay(spark, tmp_path):
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Concurrent-To", "<urn:uuid:2>"),
               ("WARC-Target-URI", "http://a/"), ("WARC-Concurrent-To", "<urn:uuid:3>")]
    http = [["Set-Cookie", "a=1"], ["Content-Type", "text/html"], ["Set-Cookie", "b=2"]]
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http) + "\r\n<p>x</p>").encode()
    (tmp_path / "a.warc").write_bytes(m.to_bytes(headers, block))
    out = m.derive(m.read_records(spark.read.format("binaryFile").load(str(tmp_path))), "path")
    ((_, body),) = m.parse(bytes(out.filter("record_type = 'metadata'").first().record))
    facts = json.loads(body)
    assert facts["source_fields"] == [list(h) for h in headers] and facts["http"]["headers"] == http


def test_broken_records_do_not_stop_the_others(spark):
    good = m.to_bytes(*m.response("http://a/", "<p>text</p>"))
    head = b"WARC/1.1\r\nWARC-Type: response\r\n"
    broken = [b"garbage", head + b"\r\nx\r\n\r\n", head + b"Content-Length: ten\r\n\r\nx", head + b"Content-Length: -9\r\n\r\nx", good[:-20], good + b"rest"]
    rows = [(i, None if b is None else bytearray(b)) for i, b in enumerate([good, *broken, b"", None])]
    got = m.derive(spark.createDataFrame(rows, "id long, record binary"), "id").collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.id, []).append(r.record_type)
    assert kinds == {0: ["metadata", "conversion"], **{i: ["broken"] for i in range(1, 6)}, 6: ["metadata", "conversion", "broken"]}
    assert all((r.record is None) == (r.record_type == "broken") for r in got)
    files = spark.createDataFrame([("f", bytearray(good + good + b"garbage" + good))], "path string, content binary")
    read = [bytes(r.record) for r in m.read_records(files).collect()]
    assert read == [good, good, b"garbage" + good]
