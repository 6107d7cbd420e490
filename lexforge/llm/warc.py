"""WARC archives as Zstandard files with a dictionary, written and read by Spark jobs.

File format: a skippable frame (magic 0x184D2A5D) holds the dictionary, plain or as a
zstd frame of its own; then every record is one zstd frame that uses it. Readers step
over other skippable frames and padding frames.

Writing. An archive of about `FILE_BYTES` is one row of Spark's text sink, which writes
a row a file, so archives go to whatever store the path names, under the sink's commit
protocol, and no task or reader holds more than one of them (or one record, if larger). The
sink puts its line separator after the row; the separator chosen here is an empty
skippable frame, which every reader of the format steps over. Each file's dictionary is
built from the file's own first payloads.

Records: of records with equal payloads of at least `LEAST` bytes the one with the
smallest id is a response, the others are revisits that name it; smaller ones are all
responses. A payload is the text in UTF-8; null is empty. Rows without an id are
responses and refer to nothing. Rows that repeat an id are records of their own; all
rows with the smallest id are responses. An empty table gives no archive rows.

Reading. Each file is one row of the binaryFile source and one decoder at a time; a
record's frame, header lines, lengths and digests are checked, and a record that
fails gives a row with `error` set instead of ending the job. Length and digest of a
revisit's payload are those that the record itself declares, so they need no join.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.storage import run_folder, stored

LEAST = 100
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame, as text.
PAD = "P*M\x18\0\0\0\0"
#: Payload bytes that a file's dictionary is made of.
DICT_BYTES = 32_768
#: Compressed bytes at which a file ends.
FILE_BYTES = 32_000_000
#: Digests of 40 bytes each that are sent to every executor at most.
BROADCAST_ROWS = 200_000


def digest_header(sha: bytes) -> str:
    return "sha256:" + base64.b32encode(sha).decode().rstrip("=")


def digest_hex(header: str | None) -> str | None:
    """Hexadecimal form of a digest header, None if it is none of SHA-256."""
    kind, _, text = (header or "").partition(":")
    try:
        sha = base64.b32decode(text + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return sha.hex() if kind == "sha256" and len(sha) == 32 else None


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, sha: bytes, refers_to: int | None, length: int | None = None) -> bytes:
    """One WARC/1.1 record: header lines, blank line, block, two line ends. `length` is that of a revisit's payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {target}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: {digest_header(sha)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
    block = head + (payload if kind == "response" else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_frames(data: bytes) -> tuple[bytes | None, list[tuple[int, int]], str | None]:
    """(dictionary, (start, end) of each record's frame, error) of an archive."""
    at, found, frames = 0, None, []
    while at < len(data):
        if at + 8 > len(data):
            return found, frames, "truncated frame"
        magic, size = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(data):
                return found, frames, "truncated skippable frame"
            if magic == DICT_MAGIC and at == 0:
                found = data[8 : 8 + size]
                if found[:4] == struct.pack("<I", FRAME_MAGIC):
                    found = zstandard.ZstdDecompressor().decompressobj().decompress(found)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            if end < 0:
                return found, frames, "truncated frame"
            frames.append((at, end))
            at = end
        else:
            return found, frames, "bad frame magic"
    return found, frames, None


def frame_end(data: bytes, at: int) -> int:
    """End of the zstd frame at `at`, by its block headers; -1 if it is cut off."""
    head = data[at + 4]
    single, checksum = head >> 5 & 1, head >> 2 & 1
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[head & 3] + ((1 if single else 0), 2, 4, 8)[head >> 6]
    while True:
        if at + 3 > len(data):
            return -1
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            at += 4 * checksum
            return at if at <= len(data) else -1


def parse_record(raw: bytes) -> dict:
    """Fields of one record; `error` says what is wrong with it."""
    out = {"record_type": None, "page_id": None, "url": None, "refers_to": None, "declared": None, "payload": None, "error": None}
    head, blank, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            return out | {"error": "bad header line"}
        fields[name.lower()] = value.strip()
    if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "bad version line"}
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        return out | {"error": f"no {missing[0]}"}
    out |= {"record_type": fields["warc-type"], "url": fields.get("warc-target-uri"), "declared": fields.get("warc-payload-digest")}
    for k, name in (("page_id", "warc-record-id"), ("refers_to", "warc-refers-to")):
        if m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, "")):
            out[k] = int(m[1])
    if not fields["content-length"].isdigit() or len(block) != int(fields["content-length"]) + 4 or not block.endswith(b"\r\n\r\n"):
        return out | {"error": "content length"}
    http, blank, payload = block[:-4].partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        return out | {"error": "bad http head"}
    size = re.search(rb"(?im)^content-length: *(\d+) *\r?$", http)
    out["payload"] = payload if out["record_type"] == "response" else None
    out["length"] = int(size[1]) if size else len(payload)
    if out["record_type"] == "response":
        if size and int(size[1]) != len(payload):
            return out | {"error": "payload length"}
        if out["declared"] and out["declared"] != digest_header(hashlib.sha256(payload).digest()):
            return out | {"error": "payload digest"}
    elif out["record_type"] == "revisit" and "warc-refers-to" not in fields:
        return out | {"error": "no warc-refers-to"}
    elif out["record_type"] == "revisit" and (size is None or digest_hex(out["declared"]) is None):
        return out | {"error": "no declared payload"}
    return out


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) -> rows with record_type, refers_to and sha.

    Digests are pre-aggregated, and only those of two records or more come back to the
    payloads: by broadcast if they are at most BROADCAST_ROWS, else by a join on the
    digest, in which Spark splits hot digests.
    """
    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "encode(coalesce(cast(html as string), ''), 'UTF-8') as payload").withColumn("sha", F.unhex(F.sha2("payload", 256)))
    rows = rows.withColumn("big", F.octet_length("payload") >= least)
    heads = stored(rows.filter("big and page_id is not null").groupBy("sha").agg(F.min("page_id").alias("head"), F.max("page_id").alias("last")).filter("head < last").select("sha", "head"), "heads")
    out = rows.join(F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads, "sha", "left")
    revisit = F.expr("coalesce(big and page_id > head, false)")
    return out.select("page_id", "url", "payload", "sha", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("head")).alias("refers_to"))


def _archives(file_bytes: int):
    """Rows of record fields -> whole archives: the dictionary first, then a frame a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        frames: list[bytes] = []
        size, press = 0, None

        def begin() -> None:
            """Start a file with the records held back for its dictionary."""
            nonlocal press
            sample = b"".join(r[2] for r in held if r[4] == "response")[:DICT_BYTES]
            # record headers are what every frame repeats
            sample += record_bytes("response", 0, "http://www.example.com/en/", b"", b"\0" * 32, None)
            book = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            press = zstandard.ZstdCompressor(level=3, dict_data=book, write_checksum=True, write_content_size=True)
            frames.append(struct.pack("<II", DICT_MAGIC, len(sample)) + sample)
            for r in held:
                add(r)
            held.clear()

        def add(record: tuple) -> None:
            nonlocal size
            page_id, url, payload, sha, kind, refers_to, length = record
            frames.append(press.compress(record_bytes(kind, page_id, url, payload, sha, refers_to, length)))
            size += len(frames[-1])

        def end() -> pa.RecordBatch:
            nonlocal press, size
            archive = pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], names=["archive"])
            frames.clear()
            press, size = None, 0
            return archive

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for record in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                    if press is not None:
                        add(record)
                    else:
                        held.append(record)
                        size += len(record[2])
                        if size >= DICT_BYTES:
                            size = 0
                            begin()
                    if press is not None and size >= file_bytes:
                        yield end()
        if held:
            size = 0
            begin()
        if frames:
            yield end()

    return run


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write planned records as archives of about file_bytes below path; nothing is exchanged for it."""
    sent = records.withColumn("length", F.octet_length("payload")).withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    archives = sent.select("page_id", "url", "payload", "sha", "record_type", "refers_to", "length").mapInArrow(_archives(file_bytes), "archive binary")
    archives.selectExpr("cast(archive as string) as value").write.option("lineSep", PAD).option("maxRecordsPerFile", 1).text(path)


SCHEMA = "file string, page_id long, url string, record_type string, refers_to long, declared string, payload binary, payload_bytes long, payload_digest string, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    for batch in batches:
        for k in range(batch.num_rows):
            file, data = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
            try:
                book, frames, error = split_frames(data)
            except zstandard.ZstdError as e:
                book, frames, error = None, [], f"bad dictionary: {e}"
            unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_AUTO)) if book else zstandard.ZstdDecompressor()
            rows, size = [], 0
            for a, b in frames:
                try:
                    raw = unpress.decompressobj().decompress(data[a:b])
                    row = parse_record(raw)
                except zstandard.ZstdError as e:
                    row = {"error": f"bad frame: {e}"}
                row["file"] = file
                if row.get("record_type") == "revisit" and row["error"] is None:
                    row |= {"payload_bytes": row["length"], "payload_digest": digest_hex(row["declared"])}
                elif row.get("payload") is not None:
                    row |= {"payload_bytes": len(row["payload"]), "payload_digest": hashlib.sha256(row["payload"]).hexdigest()}
                rows.append(row)
                size += len(row.get("payload") or b"") + 500
                if size > 4_000_000:
                    yield out(rows)
                    rows, size = [], 0
            if error:
                rows.append({"file": file, "error": error})
            if rows:
                yield out(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below path, see SCHEMA; a revisit's payload is null, its length and digest are the declared ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read, SCHEMA)


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive every row of pages(page_id, url, html), read the archives back, and return a row a record."""
    import uuid

    spark = pages.sparkSession
    path = path or f"{run_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(plan_records(pages), path)
    got = read_warc(spark, path)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error")
