r"""WARC archives of pages, compressed record by record with a dictionary of their own.

An archive is one file of Zstandard frames: a skippable frame (magic 0x184D2A5D) that holds the
dictionary, then one frame for each record (a ``warcinfo`` record first), so that any record can be read
alone once the dictionary is known.  The dictionary is built from the archive's own records.

Among pages with equal payloads of ``MIN_REVISIT`` bytes or more the one with the largest id is
written as ``response``; the others are ``revisit`` records without a payload that name the
response they repeat.  Smaller payloads are always written.

How Spark writes the files: each row of the text writer is one frame, and the line separator is an empty
skippable frame, which decoders pass over; so every file is a whole series of frames, on any store that
Spark can write to.  A file holds the pages of one shuffle partition.

Scale: payloads are hashed in one scan; equal ones are found by a grouped maximum over (digest, id), a
copy group's size does not matter to it, and a group of more than 1/256 of all rows is dealt into pieces for the
join back.  Payloads move once, when they are dealt to archives of ``ARCHIVE`` bytes by a key that is unique to
id and payload, so copies spread over all archives.  Rows of an archive are ordered by payload digest, which makes
its first records a random sample: the dictionary is fitted on the first ``SAMPLE`` bytes (a bounded sample; it
decides how small the files get and nothing else), and what follows streams through.

Cases: a null payload is empty; a null url gives no ``WARC-Target-URI``; null ids are smaller than all others and are
written without an id; rows with the same id and payload are the same record written twice, of one type; an archive with
too few records to fit a dictionary has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import urllib.parse
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.llm import hot
from vendora.llm.registry import query, table, written
from vendora.session import scratch_path

MIN_REVISIT = 1000         # payload bytes from which equal payloads are written once
ARCHIVE = 64 << 20         # payload bytes of an archive
SAMPLE = 4 << 20           # bytes of records that a dictionary is fitted on
DICTIONARY = 64 << 10      # bytes of a dictionary
LEVEL = 3                  # Zstandard's own default
DATE = "1970-01-01T00:00:00Z"   # pages carry no date of their own

# fixed values of the WARC and Zstandard formats
DICTIONARY_MAGIC = b"\x5D\x2A\x4D\x18"
SEPARATOR = "P*M\x18\x00\x00\x00\x00"                  # a skippable frame (0x184D2A50) of no bytes
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-archive")


# --- which record repeats which -----------------------------------------------------------------

def _source(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """page, url, payload as bytes, its SHA-256, and a text of both that is never null."""
    body = F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b""))
    out = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    out = out.withColumn("same", F.sha2("payload", 256))
    return out.withColumn("ident", F.concat("same", F.lit(":"), F.coalesce(F.col("page").cast("string"), F.lit("-"))))


def revisits(source: DataFrame, min_bytes: int = MIN_REVISIT) -> tuple[DataFrame, int]:
    """(ident, refers_to) of the pages that repeat another page's payload, and the bytes of all payloads."""
    rows = written(source.select("page", "same", "ident", F.octet_length("payload").cast("long").alias("bytes")), "warc-digests")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    rows = rows.filter(F.col("bytes") >= min_bytes).select("page", "same", "ident").distinct()
    copies = written(rows.groupBy("same").agg(F.max("page").alias("keep"), F.count("*").alias("n")).filter("n > 1"), "warc-copies")
    n = copies.agg(F.sum("n")).first()[0] or 0
    # pages without copies have nothing to meet
    again = hot.left_join(rows, copies, "same", "n", n, ["ident"]).filter("keep IS NOT NULL AND NOT (page <=> keep)")
    return written(again.select("ident", F.col("keep").alias("refers_to")), "warc-revisits"), total


# --- records --------------------------------------------------------------------------------------

def record_id(page, same: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{same}:{page}')}>"


def _record(fields: list, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page, url, payload: bytes, same: str, refers_to, date: str) -> bytes:
    """A response, or where ``refers_to`` is given a revisit with the payload left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page, same)), ("WARC-Date", date),
              # white space, controls and what isn't ASCII can't stand in a header line
              ("WARC-Target-URI", None if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
              ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"), ("WARC-Payload-Length", len(payload)),
              ("WARC-Profile", REVISIT_PROFILE if again else None), ("WARC-Refers-To", record_id(refers_to, same) if again else None),
              ("Page-Id", page), ("Refers-To-Page-Id", refers_to), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, http if again else http + payload)


# --- archives -------------------------------------------------------------------------------------

def fitted(samples: list):
    """A dictionary of the records, or None where they are too few."""
    import zstandard
    size = min(DICTIONARY, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, f=18, accel=4)
    except zstandard.ZstdError:                        # records too alike or too short
        return None


def frames(date: str = DATE):
    """Rows of a partition (page, url, payload, same, refers_to) in, frames of its archive out."""

    def run(batches):
        import zstandard
        waiting, size, press = [], 0, None

        def started():
            """The dictionary's frame and the records that were waiting for it."""
            nonlocal press
            words = fitted(waiting)
            # levels and window are read from the frame; the dictionary's id is in it too
            press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True) if words else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
            out = []
            if words:
                data = words.as_bytes()
                out.append(DICTIONARY_MAGIC + struct.pack("<I", len(data)) + data)
            info = b"software: page archive writer\r\nformat: WARC File Format 1.1\r\n"
            name = record_id("info", hashlib.sha256(b"".join(waiting)).hexdigest())
            out.append(press.compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", date),
                                               ("Content-Type", "application/warc-fields")], info)))
            return out + [press.compress(r) for r in waiting]

        for batch in batches:
            out = []
            for row in zip(*(batch.column(i) for i in range(5))):
                page, url, payload, same, refers_to = (x.as_py() for x in row)
                record = page_record(page, url, payload, same, refers_to, date)
                if press:
                    out.append(press.compress(record))
                    continue
                waiting.append(record)
                size += len(record)
                if size >= SAMPLE:
                    out += started()
                    waiting = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(started(), pa.binary())], names=["frame"])
    return run


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   min_bytes: int = MIN_REVISIT, archive_bytes: int = ARCHIVE, date: str = DATE) -> None:
    """Write one record for each row of ``pages`` into archives under the new folder ``path``."""
    source = _source(pages, key, url, payload)
    again, total = revisits(source, min_bytes)
    n = max(1, -(-total // archive_bytes))
    rows = source.repartition(n, "ident").sortWithinPartitions("ident").join(again, "ident", "left")
    rows = rows.select("page", "url", "payload", "same", "refers_to").mapInArrow(frames(date), "frame binary")
    # each row's bytes go to the file as they are
    (rows.select(F.col("frame").cast("string").alias("value")).write
     .option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", 0).text(path))


def dictionary_of(archive: bytes):
    """The dictionary in an archive's leading skippable frame and the place after it."""
    import zstandard
    if archive[:4] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack_from("<I", archive, 4)[0]
    return zstandard.ZstdCompressionDict(archive[8:8 + size]), 8 + size


def records(archive: bytes):
    """(fields, block) of each record of an archive, decoded frame after frame."""
    import zstandard
    words, at = dictionary_of(archive)
    unpack = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    body = io.BufferedReader(unpack.stream_reader(io.BytesIO(memoryview(archive)[at:]), read_across_frames=True), 1 << 18)
    while line := body.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := body.readline().decode().rstrip("\r\n")):
            name, value = line.split(":", 1)
            fields[name.lower()] = value.strip()
        block = body.read(int(fields["content-length"]))
        if body.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, block


READ = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
        "record_id string, warc_refers_to string, payload binary")


def _read(batches):
    number = lambda x: None if x in (None, "None") else int(x)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in READ.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for f, block in records(content.as_py()):
                if f["warc-type"] == "warcinfo":
                    continue
                payload = block.split(b"\r\n\r\n", 1)[1] if f["warc-type"] == "response" else None
                # a revisit's payload is the one it refers to
                digest = hashlib.sha1(payload).hexdigest() if payload is not None else f["warc-payload-digest"].split(":")[1]
                n = len(payload) if payload is not None else int(f["warc-payload-length"])
                rows.append((number(f.get("page-id")), f.get("warc-target-uri"), f["warc-type"], n, digest, number(f.get("refers-to-page-id")),
                             f["warc-record-id"], f.get("warc-refers-to"), payload))
                size += len(block)
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The page records of all archives under ``path``; a revisit's payload is null."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(_read, READ)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= {MIN_REVISIT} AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= {MIN_REVISIT} AND page_id <> keep THEN keep END AS refers_to
FROM m
"""


@query("op11_warc_dictionary", ORACLE)
def op11(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
