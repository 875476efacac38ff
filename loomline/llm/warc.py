"""WARC archives as a table of record chunks, written and read as streams with incremental digests."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Characters of a payload in one chunk row.
CHUNK_CHARS = 1 << 18
#: Groups of equal payloads (36 bytes each) that may be broadcast; beyond it payloads are shuffled by digest.
MOST_BROADCAST = 100_000
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CHUNKS = "record_id string, chunk_no int, last boolean, data binary, digest binary"


class WarcError(ValueError):
    """An archive whose bytes don't match its headers or digests."""


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with payload digest and size, and `refers_to` for those that become revisits.

    Of records with equal payloads of at least `least_bytes`, the one with the largest page_id is the response. Groups
    are found from digests that are combined before they are shuffled, and only groups of two or more are joined back;
    a digest that a large share of rows have is split by the adaptive join. A null html is an empty payload; a row
    without page_id revisits its group's response where there is one; rows with the response's own page_id are
    responses too.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = keyed.withColumn("sha1", F.unhex(F.sha1("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    groups = keyed.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    groups = Scratch(pages.sparkSession, "warc-groups").save(groups.where("n > 1 and response is not null").drop("n"), "groups")
    small = groups.count() <= MOST_BROADCAST  # then payloads stay where they are
    joined = keyed.join(F.broadcast(groups) if small else groups, ["sha1", "bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))).drop("response")


def write_records(planned: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunk rows whose `data`, joined in order, is an archive.

    Payloads are cut in the JVM, so Python never holds more than a batch of chunks; each row carries the payload's
    SHA-1 so far, and the last must be the digest that the record's header names.
    """
    # one pass cuts a payload at every chunk_chars characters; only the pieces go on from here
    cut = F.regexp_extract_all("html", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    cut = F.when(F.col("refers_to").isNull() & (F.col("bytes") > 0), cut).otherwise(F.array(F.lit("")))
    pieces = planned.select("page_id", "url", "sha1", "bytes", "refers_to", cut.alias("pieces")).withColumn("last_no", F.size("pieces") - 1)
    pieces = pieces.select("page_id", "url", "sha1", "bytes", "refers_to", "last_no", F.posexplode("pieces").alias("no", "piece"))
    number = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  pandas would make nullable integers floats
    pieces = pieces.select(number("page_id"), "url", "sha1", "bytes", number("refers_to"), "no", "last_no", "piece")

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record, state = "", hashlib.sha1()
        for batch in batches:
            out = []
            for page, url, sha1, size, refers, no, last_no, text in batch.itertuples(index=False, name=None):
                body = text.encode("utf-8")
                parts = []
                if no == 0:
                    record, state = str(uuid.uuid4()), hashlib.sha1()
                    parts.append(_opening(record, page, url, bytes(sha1), int(size), refers))
                state.update(body)
                parts.append(body)
                if no == last_no:
                    parts.append(b"\r\n\r\n")
                    if refers is None and state.digest() != bytes(sha1):
                        raise WarcError(f"record {record}: the payload written isn't the one planned")
                out.append((record, no, no == last_no, b"".join(parts), state.digest()))
            yield pd.DataFrame(out, columns=["record_id", "chunk_no", "last", "data", "digest"])

    return pieces.mapInPandas(written, CHUNKS)


def _opening(record: str, page: str | None, url: str | None, sha1: bytes, size: int, refers: str | None) -> bytes:
    common = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{record}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(sha1)}"),
        ("X-Payload-Length", size),
        ("X-Page-Id", page),
    ]
    if refers is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        kind = [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + size)]
    else:
        http = b"HTTP/1.1 200 OK\r\n\r\n"
        kind = [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", refers), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http))]
    return _head(common + kind) + http


def parse_records(chunks: Iterable[tuple[str, int, bool, bytes]]) -> Iterator[dict]:
    """Records of chunk rows that come in order. Holds one chunk and a digest's state, never a whole payload."""
    record, fields, left, state, size = None, {}, 0, hashlib.sha1(), 0
    for name, no, last, data in chunks:
        if no == 0:
            head, _, rest = data.partition(b"\r\n\r\n")
            if not head.startswith(b"WARC/"):
                raise WarcError(f"record {name} doesn't begin with a version line")
            record, fields = name, _fields(head)
            left = int(fields["Content-Length"])
            http, _, body = rest.partition(b"\r\n\r\n")
            left -= len(http) + 4
            state, size = hashlib.sha1(), 0
        else:
            if name != record:
                raise WarcError(f"record {name}: chunk {no} comes without chunk 0")
            body = data
        payload = body[:left]
        left -= len(payload)
        size += len(payload)
        state.update(payload)
        if last:
            if left or body[len(payload) :] != b"\r\n\r\n":
                raise WarcError(f"record {name} isn't as long as its header says")
            yield _record(fields, size, base32_sha1(state.digest()))


def _record(fields: dict[str, str], size: int, digest: str) -> dict:
    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda k: int(fields[k]) if k in fields else None
    if kind == "response" and (named != digest or number("X-Payload-Length") != size):
        raise WarcError(f"record {fields['WARC-Record-ID']} has another payload than its digest says")
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": number("X-Payload-Length"),
        "payload_digest": named, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"),
    }


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(chunks: DataFrame) -> DataFrame:
    """One row a record. Records of one chunk are parsed where they lie; only longer ones are dealt out by record and
    sorted by chunk number, and then streamed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch[["record_id", "chunk_no", "last", "data"]].itertuples(index=False, name=None))
        held: list[dict] = []
        for record in parse_records(rows):
            held.append(record)
            if len(held) == 5000:
                yield _frame(held)
                held = []
        yield _frame(held)

    whole = chunks.where("chunk_no = 0 and last")
    cut = chunks.where("not (chunk_no = 0 and last)").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return whole.mapInPandas(read, RECORDS).unionByName(cut.mapInPandas(read, RECORDS))


def _frame(records: list[dict]) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pd.DataFrame({n: pd.Series([r[n] for r in records], dtype="Int64" if n in ("page_id", "payload_bytes", "refers_to") else object) for n in names})


ORACLE = r"""
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS h FROM pages
), g AS (
  SELECT *, MAX(page_id) OVER (PARTITION BY html) AS response FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM g
"""
