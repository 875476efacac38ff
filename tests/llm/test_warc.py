import base64
import hashlib

import pytest

from loomline.llm import warc
from loomline.llm.common import Scratch


def run(spark, rows, least=0, chunk=7):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest")
    chunks = Scratch(spark, "test").save(warc.write_records(warc.plan_records(pages, least), chunk), "chunks")
    return chunks, warc.read_records(chunks).collect()


def test_records_and_revisits(spark):
    rows = [(1, "http://a/", "same é body"), (2, "http://b/\r\nX: y", "same é body"), (3, None, "longer payload " * 40), (4, "u", None), (5, "u", ""), (6, "u", "x"), (None, "u", "same é body"), (2, "u", "same é body")]
    chunks, got = run(spark, rows)
    largest = {}
    for page, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), page if page is not None else -1)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = page != largest[html or ""]
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", largest[html or ""] if revisit else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert chunks.where("chunk_no > 0").count() > 50


def test_smaller_payloads_than_the_bound_are_responses(spark):
    _, got = run(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], least=3)
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: 4, 4: None}


def test_chunks_join_to_an_archive(spark):
    chunks, _ = run(spark, [(1, "http://a/", "payload " * 30)], chunk=10)
    data = b"".join(r.data for r in chunks.orderBy("chunk_no").collect())
    head, _, block = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and data.endswith(b"\r\n\r\n")
    length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    assert len(block) == length + 4 and block.split(b"\r\n\r\n", 1)[1][:-4] == b"payload " * 30
    digests = [r.digest for r in chunks.orderBy("chunk_no").collect()]
    assert digests[0] == hashlib.sha1(b"payload pa").digest() and digests[-1] == hashlib.sha1(b"payload " * 30).digest()


def test_damage_is_found_and_empty_table(spark):
    chunks, _ = run(spark, [(1, "http://a/", "payload")])
    rows = [(r.record_id, r.chunk_no, r.last, bytes(r.data).replace(b"payload\r", b"pbyload\r")) for r in chunks.collect()]
    with pytest.raises(warc.WarcError):
        list(warc.parse_records(rows))
    assert run(spark, [(1, "u", "x")])[1] and not warc.read_records(chunks.limit(0)).collect()


def test_payload_of_many_chunks_at_the_real_size(spark):
    text = "".join(chr(97 + i % 26) for i in range(9973)) * 5400 + "é\U0001f600\r\n"
    chunks, got = run(spark, [(1, "http://a/", text), (2, "u", "x")], chunk=warc.CHUNK_CHARS)
    data = text.encode()
    by_page = {r.page_id: r for r in got}
    assert by_page[1].payload_bytes == len(data) and by_page[1].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert chunks.where("chunk_no > 0").count() == (len(text) - 1) // warc.CHUNK_CHARS and chunks.selectExpr("max(length(data)) AS n").first().n < 5 * warc.CHUNK_CHARS
