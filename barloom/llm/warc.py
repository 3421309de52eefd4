"""Web archives of Zstandard frames: one frame per record, after a skippable frame that holds the dictionary.

Writing: each task fills archives of bounded size, trains the dictionary of each on a bounded sample of its payloads, and
Spark's text writer puts the frames into one file per task. Its line separator is an empty skippable frame, so a file is a plain
sequence of Zstandard frames that any reader of the format opens. Reading: Spark's binaryFile source hands over each archive
whole, wherever it is stored; the dictionary is loaded from the leading frame and records are decoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import scratch, small

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
FRAME_MAGIC = 0xFD2FB528
CRLF = b"\r\n"

#: Payloads of at least so many bytes are worth a revisit record.
MIN_REVISIT_BYTES = 1000
#: Payload bytes that a task trains its dictionary on, and the dictionary's size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
#: Payload bytes of an archive, about; archives are read whole, so this bounds a reader's memory.
ARCHIVE_BYTES = 32 << 20

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, valid boolean"


class ArchiveError(ValueError):
    """An archive that breaks the format: what and where."""


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set where a page with a larger id has the same payload.

    Null payloads are empty; null urls stay null; a null page_id counts as smallest, and is a response only where its payload
    has no other page. Payloads are the same where their SHA-1 is, the digest that revisit records name. Rows with the same page_id
    and payload count as the same page. Keys are counted without payloads, before
    any shuffle of them; the join back is by page, so no group of copies lands in one task.
    """
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 AND response IS NOT NULL").drop("n")
    later = keys.join(first, "digest").where("page_id IS NULL OR page_id <> response").dropDuplicates(["page_id", "digest"])
    later = later.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("response").alias("refers_to"))
    on = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    return rows.join(later, on, "left").drop("p", "d")


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: headers, HTTP headers, and the payload of a response."""
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    name = lambda p: f"<urn:page:{'null' if p is None else p}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {sha}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c not in "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def write_archives(rows: DataFrame, path: str) -> None:
    """Writes rows of revisits() as archives below path."""

    def archive(held):
        """One archive: the dictionary's frame, then a frame for each row."""
        import zstandard

        texts, size = [], 0
        for r in held:
            if size < SAMPLE_BYTES and r[2]:
                texts.append(r[2][: SAMPLE_BYTES // 8])
                size += len(texts[-1])
        words = b""
        if len(texts) >= 8:
            try:
                words = zstandard.train_dictionary(DICTIONARY_BYTES, texts, k=256, d=8).as_bytes()
            except zstandard.ZstdError:
                words = b""  # too little to learn from: the frame holds an empty dictionary
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdCompressor(level=3)
        frames = [struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words, *(press.compress(record_bytes(*r)) for r in held)]
        cell = EMPTY_FRAME.encode().join(frames)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.binary())], names=["frames"])

    def run(batches):
        held, size = [], 0
        for batch in small(batches):
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(r)
                size += len(r[2])
                if size >= ARCHIVE_BYTES:
                    yield archive(held)
                    held, size = [], 0
        if held:
            yield archive(held)

    frames = rows.mapInArrow(run, "frames binary")  # payloads stay where the join of revisits() put them
    writer = frames.select(F.col("frames").cast("string").alias("value")).write
    writer.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def frames_of(content: bytes):
    """(offset, frame) of each data frame; skippable frames between them are passed over."""
    at, n = 0, len(content)
    while at < n:
        if n - at < 8:
            raise ArchiveError(f"truncated frame at {at}")
        magic, size = struct.unpack_from("<II", content, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ArchiveError(f"no frame at {at}")
        end = at + frame_length(content, at)
        yield at, content[at:end]
        at = end


def frame_length(content: bytes, at: int) -> int:
    """Bytes of the Zstandard frame that starts at `at`, from its header and block headers."""
    start, flags = at, content[at + 4]
    single, check, dict_size = flags >> 5 & 1, flags >> 2 & 1, (0, 1, 2, 4)[flags & 3]
    at += 5 + (not single) + dict_size + (single, 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(content):
            raise ArchiveError(f"truncated frame at {start}")
        block = int.from_bytes(content[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 * check
    if at > len(content):
        raise ArchiveError(f"truncated frame at {start}")
    return at - start


def parse(record: bytes) -> tuple:
    """A row of RECORD; raises ArchiveError where headers or lengths don't hold."""
    head, gap, rest = record.partition(CRLF * 2)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"header without a colon: {line[:40]!r}")
        fields[key.strip().lower()] = value.strip()
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        raise ArchiveError(f"missing headers: {missing}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != CRLF * 2:
        raise ArchiveError("the block's length differs from Content-Length")
    http, gap, payload = rest[:-4].partition(CRLF * 2)
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not gap or not http.startswith(b"HTTP/") or not length:
        raise ArchiveError("no HTTP headers in the block")
    kind, n = fields["warc-type"], int(length[1])
    digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError("the payload differs from its length or digest")
    if kind == "revisit" and "warc-refers-to" not in fields:
        raise ArchiveError("a revisit without WARC-Refers-To")
    of = lambda k: None if (x := fields[k].removeprefix("<urn:page:").removesuffix(">")) == "null" else int(x)
    url = fields.get("warc-target-uri")
    if url is not None:
        url = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url.encode()).decode("utf-8", "replace")
    return of("warc-record-id"), url, kind, of("warc-refers-to") if kind == "revisit" else None, n, digest, payload if kind == "response" else None, True


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of RECORD from every archive below path. A record that breaks the format raises, or with strict=False has valid=false."""

    def run(batches):
        import zstandard

        for batch in batches:
            for cell in batch.column(0):
                content = cell.as_buffer().to_pybytes()
                if len(content) < 8 or struct.unpack_from("<I", content)[0] != DICTIONARY_MAGIC:
                    raise ArchiveError("no leading dictionary frame")
                size = struct.unpack_from("<I", content, 4)[0]
                words = content[8 : 8 + size]
                if words[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                    words = zstandard.ZstdDecompressor().decompress(words)
                open_ = (zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()).decompressobj
                rows, held = [], 0
                for at, frame in frames_of(content):
                    try:
                        rows.append(parse(open_().decompress(frame)))
                    except (ArchiveError, zstandard.ZstdError, ValueError) as e:
                        if strict:
                            raise ArchiveError(f"{e} (frame at {at})") from e
                        rows.append((None,) * 7 + (False,))
                    held += len(rows[-1][6] or b"")
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def contract(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    write_archives(revisits(pages), path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
