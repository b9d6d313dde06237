"""op13: archives of awkward pages, of other writers, and with lost parts."""
import base64
import gzip
import hashlib
import uuid

import pytest
from pyspark.sql import types as T

from guestflow.llm import warc as W

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       *(T.StructField(c, T.StringType()) for c in ("sha", "payload", "n", "met", "value"))])


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(3)


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(rows, min_bytes=0):
    """Sorted (page_id, bytes, digest, type, refers_to) of every row."""
    out, groups = [], {}
    for k, (i, url, html) in enumerate(rows):
        b = (html or "").encode()
        groups.setdefault(b if len(b) >= min_bytes else (b, k), []).append((i is None, i or 0, url is not None, url or "", i, b))
    for group in groups.values():
        first = min(group)
        for k, g in enumerate(sorted(group)):
            out.append((g[4], len(g[5]), digest(g[5]), "revisit" if k else "response", first[4] if k else None))
    return sorted(out, key=str)


def read(spark, rows, folder, **kw):
    got = W.archived(pages(spark, rows), str(folder / uuid.uuid4().hex), **kw).collect()
    assert {r["state"] for r in got} <= {"ok"}
    return got, sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str)


MARKED = "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1" * 40 + "WARC/1.1"
ROWS = [(1, "http://a/", None), (2, "http://b/", ""), (3, None, "x"), (4, "http://c/WARC/1.1", MARKED), (5, "http://d/\r\nX: y", "0\r\n\r\n\r\n\r\nWARC/1.1\r\n"),
        (6, "http://e/ü", "é😀" * 40_000), (7, "http://f/", "é😀" * 40_000), (8, "http://g/", "a" * (W.SEGMENT - len(W.HTTP_HEAD))),
        (None, "http://h/", "x"), (None, None, "only one without an id"), (9, "http://i/", "twice"), (9, "http://i/", "twice"), (9, "http://j/", "twice"),
        (-4, "http://k/", "twice"), (10, "http://l/", "same id"), (10, "http://l/", "other text"), (11, "http://m/", "whole copy"), (11, "http://m/", "whole copy"),
        (11, "http://m/", "whole copy")]


@pytest.mark.parametrize("kw", [{}, {"segment": 100}, {"min_bytes": 3}])
def test_round_trip(spark, tmp_path, kw):
    got, flat = read(spark, ROWS, tmp_path, **kw)
    assert flat == brute(ROWS, kw.get("min_bytes", 0))
    assert len({r["record_id"] for r in got}) == len(ROWS)


def test_hot_payload_and_empty_table(spark, tmp_path):
    rows = [(i, f"u{i}", "common" if i % 3 == 0 else f"own {i // 2}") for i in range(3000)]
    assert read(spark, rows, tmp_path)[1] == brute(rows)
    assert read(spark, [], tmp_path)[1] == []


def test_payloads_come_back_whole(spark, tmp_path):
    W.write_archives(pages(spark, ROWS).select("page_id", "url", "html"), str(tmp_path / "a"), segment=1000)
    records = W.read_records(spark, str(tmp_path / "a"))
    assert records.where("record_type = 'continuation'").count() > 100 and records.where("not intact").count() == 0
    got = {bytes(r["payload"]) for r in W.assembled(records, keep_payload=True).where("record_type = 'response'").collect()}
    assert got == {(h or "").encode() for _, _, h in ROWS}
    assert records.where("record_type = 'response'").select("target_uri").where("target_uri = 'http://d/%0D%0AX: y'").count() == 1


def test_segments_of_many_files_in_any_order(spark, tmp_path):
    """Lost, repeated, cut and wrong segments are told apart, and do not touch other records."""
    def response(name, payload, **kw):
        row = {"page_id": name, "url": "http://x/", "sha": hashlib.sha256(payload).hexdigest(), "payload": payload}
        return [r + W.ENDS.encode() for r in W.page_records(row, "2024-01-01T00:00:00Z", 50)]

    good, lost, headless, cut, wrong, bad = (response(n, f"payload of {n} ".encode() * 20) for n in ("good", "lost", "headless", "cut", "wrong", "bad"))
    del lost[2], headless[0]
    cut[1] = cut[1][:-30]
    wrong[-1] = wrong[-1].replace(b"Total-Length: ", b"Total-Length: 9")
    bad[0] = bad[0].replace(b"sha1:", b"sha1:A")
    shuffled = [*good[::-1], good[1], *lost, *headless, *wrong[::-1], *bad]
    for k in range(3):
        opened = gzip.open if k else open
        with opened(tmp_path / f"{k}.warc{'.gz' if k else ''}", "wb") as f:
            f.write(b"".join(shuffled[k::3]))
    with open(tmp_path / "cut.warc", "wb") as f:
        f.write(b"".join([*cut[:1], *cut[2:], cut[1]]))
    got = W.assembled(W.read_records(spark, str(tmp_path))).collect()
    assert {r["page_id"]: r["state"] for r in got} == {"good": "ok", "lost": "missing segment", None: "missing segment", "cut": "damaged", "wrong": "length", "bad": "digest"}


def test_blocks_of_other_writers(spark, tmp_path):
    """Blocks that hold the opening of a record themselves, unframed bodies, own header order."""
    body = b"before WARC/1.1\r\nWARC-Type: fake\r\n\r\nafter" * 3
    block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    raw = (b"WARC/1.1\r\nContent-Length: 5\r\nwarc-type: warcinfo\r\n\r\nhello\r\n\r\n"
           + b"WARC/1.1\r\nContent-Length: %d\r\nWARC-record-ID: <urn:x>\r\nWARC-Type: response\r\n\r\n" % len(block) + block + b"\r\n\r\n")
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(raw)
    (r,) = W.assembled(W.read_records(spark, str(tmp_path)), keep_payload=True).collect()
    assert (r["state"], bytes(r["payload"]), r["payload_digest"]) == ("ok", body, digest(body))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_framing_is_taken_off_whatever_the_parts(size):
    payload = bytes(range(256)) * 50 + MARKED.encode()
    wire = W.HTTP_HEAD + W.framed(payload, 300)
    assert W.MARK not in wire[len(W.HTTP_HEAD):]
    p = W.Payload(keep=True)
    for i in range(0, len(wire), size):
        p.feed(wire[i:i + size])
    assert p.whole and b"".join(p.parts) == payload and p.digest() == digest(payload) and p.wire == len(wire)
    p = W.Payload()
    p.feed(wire[:-20])
    assert not p.whole
