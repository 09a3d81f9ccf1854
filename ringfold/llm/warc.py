"""WARC archives: written with one request, response or revisit, and metadata record a capture; read back as one row a capture.

Writing is DataFrame functions and Spark's text writer, whose line separator is the two line ends that close a record; files
are gzip and hold a bounded number of records. Reading parses each file by its records' lengths, a piece at a time, and puts
the transactions together again: request and metadata records name their response in WARC-Concurrent-To, revisits name theirs
in WARC-Refers-To.

Every row is a capture of its own. Which rows are revisits is found without their payloads, so payloads are dealt only where
there are many revisits, and then by row: copies of one payload are no hot key.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import met, workspace, written

END = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of a file at most, and about how many bytes of payload.
RECORDS_A_FILE, FILE_BYTES = 12_000, 256 << 20
_PIECE = 1 << 20


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of the text's UTF-8: five hex digits are four digits of base 32."""
    of = F.sha1(text)
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(of, 1 + 5 * k, 5), 16, 10).cast("int"))
    digit = lambda v: F.substring(F.lit(BASE32), v.bitwiseAND(F.lit(31)) + 1, 1)
    return F.concat_ws("", F.transform(five, lambda v: F.concat(*(digit(F.shiftright(v, s)) for s in (15, 10, 5, 0)))))


def _record(kind: str, of: Column, fields: dict[str, Column | str], block: Column) -> Column:
    lines: list[Column] = [F.lit(f"WARC/1.1{END}WARC-Type: "), F.lit(kind), F.lit(f"{END}WARC-Record-ID: <urn:uuid:"), of, F.lit(">")]
    for name, value in fields.items():
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{END}{name}: "), value), F.lit("")))
    return F.concat(*lines, F.lit(f"{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block)


def _uuid(kind: str, capture: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), capture))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_a_file: int | None = None, key: Column | None = None) -> None:
    """Writes pages (page_id, url, html) to a new folder of gzip WARC files, three records a row.

    Of rows with equal payloads of at least min_bytes bytes, that with the largest page_id (then url, then key) is the
    response, and the others are revisits of it, without the payload; that also holds for rows that repeat all columns. A
    null html is an empty payload; a null url is urn:page:<page_id>, and stays apart from an empty one. Null page_ids are
    smaller than all others. Payloads are written whole; a record must fit a task's memory, and a text of Spark (2 GB).

    key: a string that names each row, the same whenever the rows are read; without it rows are numbered in a written copy.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), (F.monotonically_increasing_id().cast("string") if key is None else key).alias("key"))
    rows = written(rows, "pages") if key is None else rows
    rows = rows.withColumn("html", F.coalesce("html", F.lit("")))
    facts_of = {"digest": base32_sha1(F.col("html")), "n": F.octet_length("html").cast("long")}
    slim = written(rows.withColumns(facts_of).drop("html"), "payloads")
    count, size = slim.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.col("key").alias("first"))
    first = slim.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max(order).alias("of"), F.count("*").alias("copies")).where("copies > 1").select("digest", F.col("of.first").alias("first"), "copies")
    revisits = written(met(slim, first, "digest", count).where("key <> first"), "revisits")
    responses = rows.join(revisits.select("key"), "key", "left_anti").withColumns(facts_of)

    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), r"[\x00-\x20\x7F]", "%20")
    common = {"WARC-Date": date, "WARC-Target-URI": uri}
    named = lambda of: F.concat(F.lit("<urn:uuid:"), _uuid("main ", F.col(of)), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    ask = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}User-Agent: ringfold{END}{END}"))
    http = lambda kind: f"application/http; msgtype={kind}"
    answer = common | {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")), "Content-Type": http("response")}
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    facts = F.to_json(F.struct("page_id", "url", F.col("n").alias("payload_bytes")), {"ignoreNullFields": "false"})

    def records_of(rows: DataFrame, main: Column) -> DataFrame:
        ids = {"WARC-Concurrent-To": named("key")}
        asked = _record("request", _uuid("request ", F.col("key")), common | ids | {"Content-Type": http("request")}, ask)
        told = _record("metadata", _uuid("metadata ", F.col("key")), common | ids | {"Content-Type": "application/json"}, facts)
        return rows.select(F.explode(F.array(asked, main, told)).alias("value"))

    again = records_of(revisits, _record("revisit", _uuid("main ", F.col("key")), answer | {"WARC-Profile": profile, "WARC-Refers-To": named("first")}, head))
    lines = records_of(responses, _record("response", _uuid("main ", F.col("key")), answer, F.concat(head, "html"))).unionByName(again)
    most = records_a_file or min(RECORDS_A_FILE, 3 * max(1, FILE_BYTES * max(count, 1) // max(size, 1)))
    lines.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _plain(archive: bytes) -> Iterator[bytes]:
    """An archive's bytes, unpacked piece by piece: a gzip member for the file, or one for each record, or none."""
    rest = memoryview(archive)
    while rest[:2] == b"\x1f\x8b":
        member, at = zlib.decompressobj(31), 0
        while not member.eof:
            if at >= len(rest):
                raise ValueError("the archive is cut off")
            yield member.decompress(rest[at : at + _PIECE])
            at += _PIECE
        rest = rest[min(at, len(rest)) - len(member.unused_data) :]
    yield from (bytes(rest[a : a + _PIECE]) for a in range(0, len(rest), _PIECE))


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and the block of each record of a gzip or plain WARC file."""
    pieces, have, done = _plain(archive), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            have.extend(piece)
        return piece is not None

    while have or more():
        while len(have) < 5 and more():
            pass
        if not have:
            return
        if have[:5] != b"WARC/":
            raise ValueError(f"no record at byte {done}")
        body, looked = -1, 0
        while (body := have.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(have) - 3)
            if not more():
                raise ValueError(f"the record at byte {done} is cut off")
        body += 4
        fields = {}
        for line in bytes(have[: body - 4]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        end = body + int(fields["content-length"])
        while len(have) < end + 4 and more():
            pass
        if have[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {done} is cut off")
        yield fields, bytes(have[body:end])
        del have[: end + 4]
        done += end + 4


_RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, digest string, intact boolean, bytes long, head binary, payload binary, facts string"


def records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row a record. digest is what the record states, without sha1:; intact is whether a response's payload has it.

    bytes and payload are those of the part after the HTTP header; payload is null if not asked for.
    """
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.string())
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def each(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for f, block in parse(archive.as_py()):
                    head, body = block, b""
                    if f["warc-type"] != "metadata":
                        head, _, body = block.partition(b"\r\n\r\n")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    intact = None
                    if f["warc-type"] == "response":
                        intact = base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                    facts = block.decode() if f["warc-type"] == "metadata" else None
                    rows.append((f["warc-type"], f["warc-record-id"], f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), digest, intact, len(body), head if facts is None else None, body if payload else None, facts))
                    if len(rows) == 2000:
                        yield _batch(rows, kinds, names)
                        rows = []
                if rows:
                    yield _batch(rows, kinds, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(each, _RECORD)


def _batch(rows, kinds, names):
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _captures(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    """(id, response, request, metadata) of each response or revisit record."""
    found = records(spark, path, payload)
    kind = lambda *k: found.where(F.col("type").isin(*k))
    sound = F.when(F.coalesce("intact", F.lit(True)), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("payload of another digest in "), F.col("id"))))
    answers = kind("response", "revisit").select("id", F.struct(sound.alias("type"), "id", "uri", "digest", F.col("bytes").alias("stored_bytes"), "head", "payload", "refers_to").alias("response"))
    asked = kind("request").groupBy(F.col("concurrent_to").alias("id")).agg(F.min(F.struct(F.col("id").alias("id"), "uri", "head")).alias("request"))
    facts = F.from_json("facts", "page_id long, url string, payload_bytes long")
    told = kind("metadata").groupBy(F.col("concurrent_to").alias("id")).agg(F.min(F.struct("id", facts.alias("facts"))).alias("told")).select("id", F.col("told.facts").alias("metadata"))
    return answers.join(asked, "id", "left").join(told, "id", "left")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row a capture: page_id, url, request, response, metadata (nested), payload_bytes, refers_to_page.

    payload_bytes is counted in the response, for a revisit in the response it refers to. A response without a request or
    metadata record has null there, and of several the one with the smallest id; a revisit of no response in the archives
    has null payload_bytes and refers_to_page. A payload that doesn't have its digest, or has another size than its metadata
    record says, raises an error. Captures that repeat a record's id are told apart by nothing and all stay.
    """
    whole = _captures(spark, path, payload)
    slim = written((whole if not payload else _captures(spark, path, False)).select("id", "response.type", "response.refers_to", "response.stored_bytes", "metadata.page_id"), "captures")
    asked = slim.where("type = 'revisit' and refers_to is not null").select("id", F.col("refers_to").alias("to"))
    main = slim.where("type <> 'revisit'").groupBy(F.col("id").alias("to")).agg(F.max(F.struct("page_id", "stored_bytes")).alias("main"))
    # A response that many revisits refer to is no hot key.
    targets = asked.groupBy("to").agg(F.count("*").alias("copies")).join(main, "to")
    refers = met(asked, targets, "to", asked.count()).groupBy("id").agg(F.max("main").alias("main"))
    out = whole.join(refers, "id", "left")
    size = F.when(F.col("response.type") == "revisit", F.col("main.stored_bytes")).otherwise(F.col("response.stored_bytes"))
    stated = F.col("metadata.payload_bytes")
    size = F.when(F.coalesce(stated == size, F.lit(True)), size).otherwise(F.raise_error(F.concat(F.lit("payload of another size in "), F.col("id"))))
    return out.select(F.col("metadata.page_id").alias("page_id"), F.col("metadata.url").alias("url"), "request", "response", "metadata", size.alias("payload_bytes"), F.col("main.page_id").alias("refers_to_page"))


def query(spark, sf_dir: str) -> DataFrame:
    path = workspace(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_warc(pages, path, key=F.concat_ws(":", "_metadata.file_path", "_metadata.row_index"))
    found = read_warc(spark, path, payload=False)
    return found.select("page_id", "payload_bytes", F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


#: Five hex digits of the SHA-1 are four digits of base 32. Where rows repeat page_id and payload the one that is the response doesn't show.
SQL = f"""
WITH hashed AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, url, strlen(html) AS payload_bytes,
         array_to_string([substr('{BASE32}', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::INT >> (15 - 5 * (k % 4))) & 31), 1) FOR k IN range(32)], '') AS payload_digest
  FROM hashed
), numbered AS (
  SELECT *, row_number() OVER w AS nth, first(page_id) OVER w AS main
  FROM named WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, coalesce(url, '') DESC)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN main END AS refers_to
FROM numbered"""
