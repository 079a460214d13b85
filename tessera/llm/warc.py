"""WARC: a converter for legacy ARC archives, with a writer of ARC archives and a reader of WARC archives.

Archives are whole gzip files, written by Spark's text writer (its line separator is what ends a record) and read by
Spark's binaryFile reader, so any store that Spark reaches will do. Records are told apart by their declared lengths
only, never by what their content looks like.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pick, remove, shared_path, written

#: Payloads of at least this many bytes can be revisited.
LEAST_BYTES = 100
#: Bytes of content for each archive file.
ARCHIVE_BYTES = 32 << 20
#: Rows given back by a parser are sent on in batches of about this many bytes.
BATCH_BYTES = 8 << 20
#: The field lines of the two versions of the ARC format.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: Fixed value: the profile of a revisit record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_SCHEMA = "kind string, page_id long, url string, ip string, date string, mime string, record_id string, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string"
WARC_SCHEMA = "record_type string, page_id long, url string, date string, record_id string, refers_to_id string, refers_to long, payload binary, payload_bytes long, payload_digest string, intact boolean"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 500 + len(r.get("payload") or b"")
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _headers(head: bytes) -> dict[str, str]:
    """The fields after the first line, names in lower case."""
    lines = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in lines if k}


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def archives_of(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, level: str = "DEFAULT_COMPRESSION", *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes pages as legacy ARC archives, the even ones in version 1 of the format, the odd ones in version 2. Each archive
    is a partition of its own. Pages are dealt to archives by their place as well, so that pages that repeat spread."""
    base = pick(pages, page_id=id_col, url=url_col, html=html_col)
    html = F.coalesce("html", F.lit(""))
    total = base.agg(F.coalesce(F.sum(F.octet_length(html)), F.lit(0))).first()[0]
    n = int(total // archive_bytes) + 1
    name = F.format_string("pages-%06d.arc", F.col("file"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    content = F.concat(head, html)
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    first = F.concat_ws(" ", url, F.lit("0.0.0.0 20240101000000 text/html"))
    line = F.when(F.col("file") % 2 == 0, first).otherwise(F.concat_ws(" ", first, F.lit("200"), F.sha1(html), F.lit("- 0"), name))
    records = base.withColumn("file", F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(n)).cast("int")).select("file", F.lit(1).alias("order"), F.concat(line, F.lit(" "), F.octet_length(content).cast("string"), F.lit("\n"), content).alias("value"))
    body = F.when(F.col("file") % 2 == 0, f"1 0 tessera\n{ARC_FIELDS[1]}\n").otherwise(f"2 0 tessera\n{ARC_FIELDS[2]}\n")
    line = F.when(F.col("file") % 2 == 0, F.concat(F.lit("filedesc://"), name, F.lit(" 0.0.0.0 20240101000000 text/plain"))).otherwise(F.concat(F.lit("filedesc://"), name, F.lit(" 0.0.0.0 20240101000000 text/plain 200 - - 0 "), name))
    tops = pages.sparkSession.range(n).select(F.col("id").cast("int").alias("file"), F.lit(0).alias("order")).select("file", "order", F.concat(line, F.lit(" "), F.octet_length(body).cast("string"), F.lit("\n"), body).alias("value"))
    records.union(tops).repartitionById(n, F.col("file")).sortWithinPartitions("order").select("value").write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", level).text(path)


def arc_records(content: bytes, name: str, payloads: bool = True) -> Iterator[dict]:
    """The records of one ARC archive, or of several put one after the other.

    Each begins with a line whose fields depend on the version, which the last filedesc record states; the last field is
    the length of the content. Fields are split from the right, as a URL may hold spaces. A content that begins with
    HTTP has a head up to the first empty line; its payload is the rest.
    """
    at, version = 0, 1
    while at < len(content):
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].rstrip(b"\r")
        if not line.strip():
            at += len(line) + 1
            continue
        fields = line.rsplit(b" ", len(ARC_FIELDS[version].split()) - 1)
        if line.startswith(b"filedesc:"):  # the version isn't known before its content is read
            fields = line.split(b" ")
        length = _whole(fields[-1].decode("latin-1"))
        if length is None or len(fields) < 5:
            raise ValueError(f"{name}: no ARC header at byte {at}: {line[:80]!r}")
        start = end + 1
        block = content[start : start + length]
        if len(block) < length:
            raise ValueError(f"{name}: the record at byte {at} declares {length} bytes, {len(block)} are left")
        url, ip, date, mime = (x.decode("utf-8", "replace") for x in fields[:4])
        row = {"kind": "response", "url": url, "ip": ip, "date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z", "mime": mime, "head": b"", "payload": block}
        if line.startswith(b"filedesc:"):
            version = int(block[:1]) if block[:1] in (b"1", b"2") else 1
            row["kind"] = "warcinfo"
        elif block.startswith(b"HTTP/") and (cut := block.find(b"\r\n\r\n")) >= 0:
            row |= {"head": block[: cut + 4], "payload": block[cut + 4 :], "page_id": _whole(_headers(block[:cut]).get("x-page-id"))}
        else:
            row["kind"] = "resource"
        row |= {"payload_bytes": len(row["payload"]), "payload_digest": hashlib.sha256(row["payload"]).hexdigest()}
        row["record_id"] = f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{url} {date} {row.get("page_id")} {row["payload_digest"]}'.encode()).digest()[:16], version=4)}"
        if payloads:
            row["block_digest"] = hashlib.sha256(block).hexdigest()
        else:
            row["payload"] = row["head"] = None
        yield row
        at = start + length


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all ARC archives in a folder, of either version, gzip or plain."""
    schema = _arrow(ARC_SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                raw = content.as_py()
                yield from _batches(arc_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw, name, payloads), schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, ARC_SCHEMA)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Writes the records of ARC archives as WARC 1.1 archives.

    A filedesc record becomes a warcinfo record, an HTTP record a response, any other a resource. Identifiers are
    UUIDs made from the URL, the date, the page's id and the payload's digest, so a rerun makes the same ones.
    Of responses with equal payloads of at least LEAST_BYTES bytes, that with the smallest page id stays a response, and
    the others become revisits of it that hold only the HTTP head. A missing page id counts as the largest. Records that
    share the smallest id all stay responses, whatever their URLs; revisits refer to the one whose identifier comes first.
    Groups of equal payloads are found by digest, on rows without payloads.
    """
    heads = read_arc(spark, arc_path, payloads=False).where("kind = 'response'").where(F.col("payload_bytes") >= LEAST_BYTES)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "date")).alias("first")
    groups = written(heads.groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1").select("payload_digest", "first"), "warc-groups")
    r = read_arc(spark, arc_path).join(groups, "payload_digest", "left")
    revisit = F.coalesce((F.col("kind") == "response") & (F.col("payload_bytes") >= LEAST_BYTES) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.lit(False))
    text = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block: Column = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    lines = F.concat(
        F.lit("WARC/1.1\r\n"),
        text("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("kind"))),
        text("WARC-Target-URI", F.col("url")),
        text("WARC-Date", F.col("date")),
        text("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        text("WARC-IP-Address", F.col("ip")),
        text("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.lit("")).otherwise(text("WARC-Block-Digest", F.concat(F.lit("sha256:"), "block_digest"))),
        F.when(
            revisit,
            F.concat(
                text("WARC-Profile", F.lit(PROFILE)),
                text("WARC-Refers-To", F.concat(F.lit("<"), "first.record_id", F.lit(">"))),
                text("WARC-Refers-To-Target-URI", F.col("first.url")),
                text("WARC-Refers-To-Date", F.col("first.date")),
                F.coalesce(text("X-Refers-To-Page-Id", F.col("first.page_id").cast("string")), F.lit("")),
            ),
        ).otherwise(F.lit("")),
        text("Content-Type", F.when(F.col("kind") == "response", F.lit("application/http;msgtype=response")).when(F.col("kind") == "warcinfo", F.lit("application/warc-fields")).otherwise(F.col("mime"))),
        text("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    r.select(F.concat(lines.cast("binary"), block).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path)


def warc_records(content: bytes, name: str, payloads: bool = True) -> Iterator[dict]:
    """The records of one WARC archive; of HTTP records the payload is what follows the HTTP head."""
    at = 0
    while at < len(content):
        cut = content.find(b"\r\n\r\n", at)
        if cut < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"{name}: no WARC header at byte {at}")
        h = _headers(content[at:cut])
        length = _whole(h.get("content-length"))
        if length is None or cut + 4 + length > len(content):
            raise ValueError(f"{name}: the record at byte {at} declares {h.get('content-length')} bytes")
        block = content[cut + 4 : cut + 4 + length]
        head, payload = b"", block
        if h.get("content-type", "").startswith("application/http") and (end := block.find(b"\r\n\r\n")) >= 0:
            head, payload = block[: end + 4], block[end + 4 :]
        http, told = _headers(head[:-4]), h.get("warc-payload-digest", "").removeprefix("sha256:")
        row = {"record_type": h.get("warc-type"), "page_id": _whole(http.get("x-page-id")), "url": h.get("warc-target-uri"), "date": h.get("warc-date"), "record_id": h.get("warc-record-id", "").strip("<>")}
        if row["record_type"] == "revisit":
            row |= {"refers_to_id": h.get("warc-refers-to", "").strip("<>"), "refers_to": _whole(h.get("x-refers-to-page-id")), "payload_bytes": _whole(http.get("content-length")), "payload_digest": told}
        else:
            digest = hashlib.sha256(payload).hexdigest()
            row |= {"payload": payload if payloads else None, "payload_bytes": len(payload), "payload_digest": digest, "intact": digest == told}
        yield row
        at = cut + 4 + length + 4


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC archives in a folder. intact: the payload has the digest that its record states; of a
    revisit, the response that it refers to is there, is intact and has that digest."""
    found = _parsed(spark, path, payloads)
    there = _parsed(spark, path, False).where("record_type = 'response' AND intact").select(F.col("record_id").alias("refers_to_id"), F.col("payload_digest").alias("_digest"))
    asked = _parsed(spark, path, False).where("record_type = 'revisit'").select("refers_to_id", "payload_digest").distinct()
    good = asked.join(there.distinct(), "refers_to_id").where(F.col("payload_digest") == F.col("_digest")).select(F.col("refers_to_id").alias("_id"), F.col("payload_digest").alias("_of"))
    both = found.join(good, (F.col("refers_to_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_of")), "left")
    return both.withColumn("intact", F.coalesce("intact", F.col("_id").isNotNull())).drop("_id", "_of")


def _parsed(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """The records as each says of itself; a revisit leaves `intact` open."""
    schema = _arrow(WARC_SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                raw = content.as_py()
                yield from _batches(warc_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw, name, payloads), schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, WARC_SCHEMA)


def pages_through_warc(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Pages written as ARC archives, converted to WARC, and read back: the records of pages, as read_warc gives them.

    A null html has an empty payload, a null url becomes about:blank; white space in a url becomes %20. A null page id
    comes back as null. Rows that repeat give a record each. An empty table gives no records. Other columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    archives_of(pages, arc, level="BEST_SPEED")  # they are read twice and removed
    convert_arc(spark, arc, warc)
    remove(spark, arc)
    return read_warc(spark, warc, payloads).where("record_type in ('response', 'revisit')")
