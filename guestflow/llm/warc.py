"""WARC archives of pages: written by Spark's text sink, read back with segments put together."""
from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestflow.llm.common import met, slots, stored

#: --- FIXED VALUES of the format: what opens a record, what ends it, the revisit profile.
MARK = b"WARC/1.1"
OPENS, ENDS = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

#: Bytes of a block from which it is cut into segments, of a chunk of the transfer
#: framing, records per file, and bytes that a task sends to Spark at once.
SEGMENT, CHUNK, FILE_RECORDS, OUT_BYTES = 16_384, 4_096, 20_000, 4_000_000
#: Own header fields: the page's id.
PAGE = "Page-ID"


# --- writing ---------------------------------------------------------------

def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """Chunked transfer framing. A chunk also ends inside every MARK, so that no
    block of ours holds one and records can be told apart by OPENS alone."""
    cuts, at = {0, len(payload), *range(0, len(payload), chunk)}, payload.find(MARK)
    while at >= 0:
        cuts.add(at + 4)
        at = payload.find(MARK, at + 4)
    ends = sorted(cuts)
    parts = [b"%x\r\n%s\r\n" % (b - a, payload[a:b]) for a, b in zip(ends, ends[1:])]
    return b"".join([*parts, b"0\r\n\r\n"])


def record(kind: str, rid: str, block: bytes, **fields) -> bytes:
    """One record, without the ENDS after it; fields that are None are left out."""
    named = {"WARC-Type": kind, "WARC-Record-ID": rid, **{k.replace("_", "-"): v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    head = "".join(f"{k}: {clean(str(v))}\r\n" for k, v in named.items())
    return OPENS.encode() + head.encode() + b"\r\n" + block


def clean(value: str) -> str:
    """A header value: control characters and the slash of a MARK are percent-encoded."""
    value = value.replace(MARK.decode(), MARK.decode().replace("/", "%2F"))
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def urn(hexes: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hexes[:32])}>"


def page_records(rows: dict, date: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response with its continuations."""
    common = {"WARC_Date": date, "WARC_Target_URI": rows["url"], "Page_ID": rows["page_id"]}
    if rows["payload"] is None:
        yield record("revisit", urn(uuid.uuid4().hex), b"", WARC_Profile=PROFILE, WARC_Refers_To=urn(rows["sha"]), **common)
        return
    payload = rows["payload"]
    block, rid = HTTP_HEAD + framed(payload), urn(rows["sha"])
    pieces = [block[i:i + segment] for i in range(0, len(block), segment)]
    yield record("response", rid, pieces[0], **common, Content_Type="application/http; msgtype=response",
                 WARC_Payload_Digest="sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                 WARC_Segment_Number=1 if len(pieces) > 1 else None)
    for k, piece in enumerate(pieces[1:], 2):
        yield record("continuation", urn(uuid.uuid4().hex), piece, WARC_Date=date, WARC_Segment_Origin_ID=rid, WARC_Segment_Number=k,
                     WARC_Segment_Total_Length=len(block) if k == len(pieces) else None)


def first_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, groups): the distinct (sha, page_id, url) with their number of copies,
    and per payload of several rows its first page and how many copies that has.

    Both are counted map-side; payloads stay where they are. Null page_ids come last."""
    keys = stored(pages.groupBy("sha", "page_id", "url").agg(F.count("*").alias("copies")), "warc-keys")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "copies")
    groups = (keys.groupBy("sha").agg(F.sum("copies").alias("n"), F.min(order).alias("first")).where("n > 1")
              .select("sha", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.copies").alias("first_copies")))
    return keys, stored(groups, "warc-groups")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT) -> None:
    """WARC files (gzip) under ``path`` with one record set per page.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at
    least ``min_bytes`` that with the smallest page_id (null ids last, then by url) is
    a response, the others are revisits that refer to it; a page that is there several
    times in full is one response and else revisits. Only responses carry payloads, and
    those move only where the join with the groups of equal payloads is not broadcast."""
    date = pages.sparkSession.sql("select date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    small = F.octet_length("payload") < min_bytes
    alone = rows.where(small).withColumn("sha", F.replace(F.uuid(), F.lit("-"), F.lit("")))  # never grouped
    rows = rows.where(~small).withColumn("sha", F.sha2("payload", 256))
    keys, groups = first_pages(rows)
    joined = met(rows, groups, "sha", F.xxhash64("page_id", "url"))
    first = ~F.col("met") | (F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")))
    once = F.coalesce("first_copies", F.lit(1)) == 1
    cols = ["page_id", "url", "sha", "payload"]
    out = joined.where(first & once).select(cols)
    if not groups.where("first_copies > 1").isEmpty():  # a first page is there several times: one of its rows is the response
        out = out.unionByName(joined.where(first & ~once).select(cols).dropDuplicates(["sha"]))
    if min_bytes:
        out = out.unionByName(alone.select(cols))
    again = met(keys, groups, "sha", F.xxhash64("page_id", "url")).where("met")
    left = F.col("copies") - F.when(F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")), 1).otherwise(0)
    revisits = again.where(left > 0).select("page_id", "url", "sha", F.explode(F.sequence(F.lit(1), left)).alias("_")).drop("_")
    out = out.unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info, size = [record("warcinfo", urn(uuid.uuid4().hex), b"format: WARC File Format 1.1\r\n", WARC_Date=date, Content_Type="application/warc-fields")], 0
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in cols}
                for r in page_records(row, date, segment):
                    info.append(r)
                    size += len(r)
                    if size > OUT_BYTES:
                        yield pa.record_batch([pa.array(info, pa.binary())], names=["value"])
                        info, size = [], 0
        yield pa.record_batch([pa.array(info, pa.binary())], names=["value"])

    (out.mapInArrow(archive, "value binary").select(F.col("value").cast("string"))  # the cast keeps the bytes
     .write.option("lineSep", ENDS).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


# --- reading ---------------------------------------------------------------

class Payload:
    """Takes a response's block in parts: HTTP head, then the body, whose transfer
    framing is taken off. Keeps a digest and a count, and the payload if asked to."""

    def __init__(self, keep: bool = False):
        self.sha, self.size, self.parts, self.keep = hashlib.sha1(), 0, [], keep
        self.held, self.state, self.left, self.wire = b"", "head", 0, 0

    def body(self, data: bytes) -> None:
        self.sha.update(data)
        self.size += len(data)
        if self.keep:
            self.parts.append(data)

    def feed(self, data: bytes) -> None:
        self.wire += len(data)
        data, self.held = self.held + data, b""
        at = 0
        while at < len(data) or self.state == "head":
            if self.state == "head":
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    self.held = data
                    return
                names = dict(line.split(":", 1) for line in data[:end].decode("latin-1").split("\r\n")[1:] if ":" in line)
                chunked = "chunked" in {k.strip().lower(): v for k, v in names.items()}.get("transfer-encoding", "").lower()
                at, self.state = end + 4, "size" if chunked else "plain"
            elif self.state == "plain":
                self.body(data[at:])
                return
            elif self.state == "data":
                take = min(self.left, len(data) - at)
                self.body(data[at:at + take])
                at, self.left = at + take, self.left - take
                self.state = "size" if not self.left else "data"
                if not self.left:
                    self.skip = True
            elif self.state in ("size", "trailer"):
                end = data.find(b"\r\n", at)
                if end < 0:
                    self.held = data[at:]
                    return
                line, at = data[at:end], end + 2
                if self.state == "trailer":
                    self.state = "end" if not line else "trailer"
                elif getattr(self, "skip", False) and not line:  # the line end after a chunk
                    self.skip = False
                else:
                    try:
                        self.left = int(line.split(b";")[0], 16)
                    except ValueError:
                        self.state = "broken"
                        return
                    self.state = "data" if self.left else "trailer"
            else:  # after the end, or broken
                return

    @property
    def whole(self) -> bool:
        return self.state in ("plain", "end")

    def digest(self) -> str:
        return base64.b32encode(self.sha.digest()).decode()


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes, bool]]:
    """(headers, block, intact) of each record in rows (value, file) of pieces between
    OPENS. A block that holds OPENS itself came as several pieces: they are put together
    until Content-Length is reached or the file ends."""
    held, of = None, None

    def done(piece: bytes):
        head, _, rest = piece.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
        size = fields.get("content-length", "")
        if not size.isdigit():
            return fields, rest, False, True
        return fields, rest[:int(size)], len(rest) >= int(size), len(rest) >= int(size)

    for b in batches:
        for i in range(b.num_rows):
            piece, file = b.column("value")[i].as_py(), b.column("file")[i].as_py()
            if held is not None and file == of:
                held = held + OPENS.encode() + piece
            else:
                if held is not None:
                    fields, block, _, _ = done(held)
                    yield fields, block, False
                held = piece
            of = file
            if not held.strip():
                held = None
                continue
            fields, block, intact, over = done(held)
            if over:
                yield fields, block, intact
                held = None
    if held is not None:
        fields, block, _, _ = done(held)
        yield fields, block, False


RECORD = ("record_id string, record_type string, target_uri string, page_id string, refers_to string, digest string, "
          "segment int, origin string, total long, block binary, intact boolean")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path`` (RECORD), one row each.

    Archives are read by Spark's text source, cut at OPENS, so files stream through
    tasks record by record. gzip files are one task each; plain ones split too (there a
    block that holds OPENS must not lie on a split: it comes out as not intact)."""
    pieces = spark.read.option("lineSep", OPENS).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    names = [f.strip().split(" ")[0] for f in RECORD.split(",")]
    kinds = [pa.string()] * 6 + [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        whole = lambda v: int(v) if v and v.isdigit() else None
        for f, block, intact in parsed(batches):
            rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get(PAGE.lower()), f.get("warc-refers-to"),
                         f.get("warc-payload-digest"), whole(f.get("warc-segment-number")), f.get("warc-segment-origin-id") or f.get("warc-record-id"),
                         whole(f.get("warc-segment-total-length")), block, intact))
            size += len(block)
            if size > OUT_BYTES:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return pieces.mapInArrow(read, RECORD)


ASSEMBLED = ("record_id string, record_type string, target_uri string, page_id string, refers_to string, "
             "payload_bytes long, payload_digest string, payload binary, state string")


def assembled(records: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Responses with their payload's size and SHA-1 (base32), and revisits (ASSEMBLED).

    Segments meet by origin id, sorted by segment number, and pass one at a time, so a
    record of any length needs the memory of one segment (more only if the payload is
    kept). ``state`` is "ok", or what is wrong: "damaged" (a block shorter than
    announced), "missing segment", "length" (not WARC-Segment-Total-Length), "framing",
    "digest" (not WARC-Payload-Digest). A segment found twice counts once."""
    rows = (records.where(F.col("record_type").isin("response", "revisit", "continuation"))
            .repartition(slots(records), "origin").sortWithinPartitions("origin", F.coalesce("segment", F.lit(1)), "record_id"))
    names = [f.strip().split(" ")[0] for f in ASSEMBLED.split(",")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary(), pa.string()]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now = [], 0, None

        def close():
            first, p = now["first"], now["payload"]
            state = now["state"]
            if state == "ok" and now["total"] is not None and now["total"] != p.wire:
                state = "length"
            elif state == "ok" and first["segment"] is not None and now["total"] is None:
                state = "missing segment"
            elif state == "ok" and not p.whole:
                state = "framing"
            elif state == "ok" and (first["digest"] or "sha1:" + p.digest()).upper() != "SHA1:" + p.digest():
                state = "digest"
            out.append((first["record_id"], "response", first["target_uri"], first["page_id"], None, p.size, p.digest(),
                        b"".join(p.parts) if keep_payload else None, state))

        def batch():
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if r["record_type"] == "revisit":
                    out.append((r["record_id"], "revisit", r["target_uri"], r["page_id"], r["refers_to"], None, None, None, "ok" if r["intact"] else "damaged"))
                    continue
                if now and r["origin"] != now["origin"]:
                    close()
                    now = None
                at = r["segment"] or 1
                if now is None:
                    if r["record_type"] != "response":  # its first segment is nowhere: a response of unknown page
                        r = {**r, "record_id": r["origin"], "page_id": None, "target_uri": None, "digest": None, "segment": at}
                    now = {"origin": r["origin"], "first": r, "payload": Payload(keep_payload), "next": 1, "total": None, "state": "ok"}
                if at < now["next"]:
                    continue
                if at > now["next"] and now["state"] == "ok":
                    now["state"] = "missing segment"
                if not r["intact"] and now["state"] == "ok":
                    now["state"] = "damaged"
                now["next"] = at + 1
                now["total"] = r["total"] if r["total"] is not None else now["total"]
                now["payload"].feed(r["block"])
                size += len(r["block"])
                if len(out) > 5_000 or keep_payload and size > OUT_BYTES and out:
                    yield batch()
                    out, size = [], 0
        if now:
            close()
        if out:
            yield batch()

    return rows.mapInArrow(assemble, ASSEMBLED)


def resolved(found: DataFrame) -> DataFrame:
    """Per response and revisit: record_id, page_id, target_uri, payload_bytes,
    payload_digest, record_type, refers_to (the response's page_id) and state.

    A revisit takes size and digest from its response; "unresolved" if that is not there."""
    slim = stored(found.drop("payload"), "warc-records")
    referred = slim.where("record_type = 'revisit'").groupBy(F.col("refers_to").alias("record_id")).agg(F.count("*").alias("n"))
    origins = stored(slim.where("record_type = 'response'").join(referred, "record_id")
                     .select(F.col("record_id").alias("refers_to"), "n", F.col("page_id").alias("to_id"), F.col("payload_bytes").alias("b"),
                             F.col("payload_digest").alias("d"), F.col("state").alias("of")), "warc-origins")
    both = met(slim, origins, "refers_to", F.xxhash64("record_id"))
    again = F.col("record_type") == "revisit"
    return both.select("record_id", "page_id", "target_uri", F.coalesce("payload_bytes", "b").alias("payload_bytes"),
                       F.coalesce("payload_digest", "d").alias("payload_digest"), "record_type", F.col("to_id").alias("refers_to"),
                       F.when(again & ~F.col("met"), "unresolved").when(again & (F.col("of") != "ok"), F.col("of")).otherwise(F.col("state")).alias("state"))


def archived(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Writes the pages' archives under ``path`` and returns what reading them back gives.

    One row per page, page_id in its own type. Null ids, urls and html are kept as what
    they are (html as an empty payload); an empty table gives no rows; other columns of
    ``pages`` are ignored."""
    write_archives(pages.select("page_id", "url", "html"), path, min_bytes, segment)
    back = resolved(assembled(read_records(pages.sparkSession, path)))
    kind = pages.schema["page_id"].dataType
    return back.select("record_id", F.col("page_id").cast(kind), F.col("target_uri").alias("url"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind), "state")
