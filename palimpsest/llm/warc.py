"""Web archives in Zstandard with an embedded dictionary.

An archive file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary
built from the records of that file; each record follows as a frame of its own, compressed with it,
so that one record can be read without the others. Files whose records are too few or too alike for
a dictionary have none, and start with their first record.

Records: of those with equal payloads of at least ``least`` bytes the one with the largest id is
written as response, the others as revisits that refer to it; all smaller ones are responses.

Defined results: a null payload is empty; a null id keeps its record, and is a group's response only
if all the group's ids are null; rows that repeat an id are all written, and where they have the
group's largest id all of them are responses; an empty table gives no files; further columns don't
matter. Executors write each file under a temporary name and move it, and only files that a finished
task reports are read: what a lost or repeated task wrote stays unread, and goes with ``unreported``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, hot_join, settle, small_batches, table

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids are UUIDs of this upper half, with the page's id below.
NAMESPACE = 0x70616C696D707365_0000000000000000
CRLF = b"\r\n"
#: A dictionary's bytes at most, the bytes of records of the file it is built from, and a file's payload bytes.
DICTIONARY, SAMPLE, FILE = 1 << 16, 1 << 22, 1 << 26


def record_id(page_id: int | None, url: str | None) -> str:
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url or '')}>"
    return f"<urn:uuid:{uuid.UUID(int=NAMESPACE | page_id & 0xFFFFFFFFFFFFFFFF)}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.strip("<>")[9:]).int & 0xFFFFFFFFFFFFFFFF
    return low - (1 << 64) if low >> 63 else low


def _clean(value: str) -> str:
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in value.encode("utf-8", "surrogatepass"))


def encode_record(page_id, url, payload: bytes, refers_to=None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response, or with ``refers_to`` a revisit, whose block ends after the HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    sha = hashlib.sha1(payload).digest()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or '') or 'about:blank'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if page_id is None:
        head.append("X-Page-Id: none")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, None)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def decode_record(data: bytes) -> dict:
    """The fields of a record; digests and lengths are checked."""
    head, _, rest = data.partition(CRLF + CRLF)
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != CRLF + CRLF:
        raise ValueError("not a whole WARC/1.1 record")
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(CRLF + CRLF)
    size = next(int(x[16:]) for x in http.split(CRLF) if x.startswith(b"Content-Length: "))
    sha, kind = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")), fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != sha):
        raise ValueError("payload digest differs")
    return {
        "page_id": None if "x-page-id" in fields else page_of(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": sha.hex(),
        "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def build_dictionary(records: list[bytes]) -> bytes | None:
    """A dictionary from records spread over the file, or None if they don't make one."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE))
    # every step-th piece of all records' pieces, wherever in its record it stands
    samples = [r[i : i + 2048] for r, i in islice(((r, i) for r in records for i in range(0, len(r), 2048)), 0, None, step)]
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 10)), samples, k=256, d=8, f=18, accel=4, level=3).as_bytes()
    except zstandard.ZstdError:
        return None


def encode_archive(records: list[bytes], level: int = 3) -> bytes:
    """An archive file of the records."""
    words = build_dictionary(records)
    out = [] if words is None else [DICTIONARY_MAGIC.to_bytes(4, "little"), len(words).to_bytes(4, "little"), words]
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True)
    return b"".join(out + [press.compress(r) for r in records])


def decode_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive file, one after another."""
    at, words = 0, None
    if int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        words = data[8:at]
        if words[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
            words = zstandard.ZstdDecompressor().decompress(words)
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    view = memoryview(data)
    while at < len(data):
        if 0x184D2A50 <= int.from_bytes(view[at : at + 4], "little") <= 0x184D2A5F:
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            continue
        one = open_.decompressobj()
        record = one.decompress(view[at:])
        if not one.eof:
            raise ValueError("the archive ends within a record")
        at = len(data) - len(one.unused_data)
        yield record


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the response's page_id for revisits, else null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha2(F.encode("html", "utf-8"), 256))).withColumn("u", F.xxhash64("page_id", "url"))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    total = rows.count()
    met = hot_join(rows, settle(groups.select("digest", "first", "n")), "digest", "n", total, "u")
    return met.select("page_id", "url", "html", F.col("first").alias("winner"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, file_bytes: int = FILE) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as ``.warc.zst`` files below ``path``, which executors share.

    Returns (file, records, payload_bytes): the files of the finished tasks.
    """
    small_batches(pages.sparkSession)
    marked = with_revisits(pages, least)

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        records, size, total = [], 0, 0

        def flush():
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{root}/.{name}.tmp", compression=None) as f:
                f.write(encode_archive(records))
            store.move(f"{root}/.{name}.tmp", f"{root}/{name}.warc.zst")
            return pa.RecordBatch.from_pylist([{"file": f"{name}.warc.zst", "records": len(records), "payload_bytes": total}])

        for x in batches:
            for row in x.to_pylist():
                payload = row["html"].encode("utf-8", "surrogatepass")
                mine = row["winner"] is None or row["winner"] == row["page_id"]
                records.append(encode_record(row["page_id"], row["url"], payload, None if mine else row["winner"]))
                size, total = size + len(records[-1]), total + len(payload)
                if size >= file_bytes:
                    yield flush()
                    records, size, total = [], 0, 0
        if records:
            yield flush()

    # the list of files is settled before they are read: what is in it was written to its end
    return settle(marked.select("page_id", "url", "html", "winner").mapInArrow(run, "file string, records long, payload_bytes long"))


def unreported(files: DataFrame, path: str) -> int:
    """Deletes the files below ``path`` that no finished task has reported; how many these were."""
    store, root = fs.FileSystem.from_uri(path)
    there = [f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    told = files.sparkSession.createDataFrame([(x,) for x in there], "file string").join(files.select("file"), "file", "left_anti")
    gone = [r["file"] for r in told.collect()]
    for name in gone:
        store.delete_file(f"{root}/{name}")
    return len(gone)


def read_archives(files: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records of the files (column ``file``) below ``path``."""
    kinds = {"page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "payload": "binary"}
    keep = [k for k in kinds if payloads or k != "payload"]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(k, types[kinds[k]]) for k in keep])

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        for x in batches:
            for name in x.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                rows, size = [], 0
                for r in decode_archive(data):
                    rows.append({k: v for k, v in decode_record(r).items() if k in keep})
                    size += len(r) if payloads else 200
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep))


def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(files, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS winner
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM d
"""
