"""WARC archives in Zstandard frames: writing and reading.

An archive starts with a skippable frame that holds a dictionary; behind it, each record is one frame
of its own compressed with that dictionary. The writer stores one response per distinct payload (that
of the largest page id) and a revisit record that names it for each other page. The reader loads the
dictionary from the leading skippable frame, decodes frame by frame and validates version line,
headers, lengths, block ends and digests.

Archives are rows (archive, content) of bounded size; as tables they live in any store that Spark
writes, ``export_files`` puts them out as ``.warc.zst`` files.

Nulls: a null payload is empty; a null page id writes its own response, with no page id in the header,
and none refers to it unless all copies lack an id. Repeated rows write repeated records. Payloads of
any length make one record. An empty table makes no archive. Extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

#: Magic numbers of the dictionary's skippable frame and of a plain frame (fixed values).
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None, payload_bytes: int | None = None, digest: str | None = None) -> bytes:
    """One WARC/1.1 record; with ``refers_to``, a revisit without the payload's bytes."""
    digest = digest or payload_digest(payload)
    revisit = refers_to is not None
    block = b"" if revisit else payload
    url = "".join(c for c in url if c >= " ")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "X-Payload-Length": str(len(payload) if payload_bytes is None else payload_bytes),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-Id": str(refers_to)}
    head |= {"Content-Type": "text/html", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def write_archive(records: list[bytes], dictionary_bytes: int = 16_384, samples: int = 256, level: int = 3) -> bytes:
    """An archive of the records. The dictionary is trained on ``samples`` of them at most, evenly
    spaced; where training has too little to learn from, the first record's start serves as one."""
    import zstandard

    some = [r[:4096] for r in records[:: max(1, len(records) // samples)]][:samples]
    try:
        dictionary = zstandard.train_dictionary(dictionary_bytes, some)
    except zstandard.ZstdError:
        dictionary = zstandard.ZstdCompressionDict(records[0][:dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    body = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(body)), body, *map(compressor.compress, records)])


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, validated; ValueError says what is wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("no end of headers")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC version: {first[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise ValueError("content-length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, not {size}, or no end")
    block = rest[:size]
    for name in ("warc-block-digest", *(["warc-payload-digest"] if headers["warc-type"] == "response" else [])):
        if headers.get(name, "sha1:").startswith("sha1:") and name in headers and headers[name] != f"sha1:{payload_digest(block)}":
            raise ValueError(f"{name} does not match")
    return headers, block


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; one frame holds one whole record."""
    import zstandard

    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if at == 0 and magic == DICTIONARY_MAGIC:
            body = bytes(view[8 : 8 + size])
            if len(body) < size:
                raise ValueError("the dictionary is cut off")
            if body[:4] == struct.pack("<I", FRAME_MAGIC):  # it may be compressed itself
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            dictionary = zstandard.ZstdCompressionDict(body)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        # Frames are found by decoding: give the decoder growing pieces until it has the frame's end.
        out, step = [], 1 << 16
        while not frame.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("the archive ends within a frame")
            out.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
            step = min(step * 2, 1 << 22)
        yield parse_record(b"".join(out))


def deduplicated(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_sha1, refers_to): refers_to is null for responses.

    A revisit's payload is null from here on, so that copies are not moved or archived.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})
    firsts = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_sha1").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = rows.join(firsts, "payload_sha1", "left")
    refers = F.when((F.col("payload_bytes") >= min_bytes) & (F.col("page_id") < F.col("_first")), F.col("_first"))
    return out.withColumn("refers_to", refers).drop("_first").withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def write_archives(pages: DataFrame, archive_bytes: int = 8 << 20, **options) -> DataFrame:
    """Archives (archive string, content binary, n_records int) of about ``archive_bytes`` of payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            content = write_archive(held)
            name = f"{hashlib.sha1(content).hexdigest()}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([len(held)], pa.int32())], names=["archive", "content", "n_records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, length, sha1, refers_to = (batch.column(k)[i].as_py() for k in range(6))
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                held.append(record(page_id, url, payload or b"", refers_to, length, digest))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    rows = deduplicated(pages, **options).select("page_id", "url", "payload", "payload_bytes", "payload_sha1", "refers_to")
    return rows.mapInArrow(run, "archive string, content binary, n_records int")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives (column content): page_id, url, record_type, payload_bytes, payload_digest,
    refers_to and, if asked for, payload."""
    fields = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * with_payload]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for head, block in read_archive(batch.column(0)[i].as_py()):
                    revisit = head["warc-type"] == "revisit"
                    length = int(head["x-payload-length"]) if revisit else len(block)
                    digest = head["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(block)
                    rows.append((number(head.get("x-page-id")), head.get("warc-target-uri", ""), head["warc-type"], length, digest, number(head.get("x-refers-to-page-id")), block)[: len(names)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return archives.select("content").mapInArrow(run, fields)


def export_files(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file of its name below ``folder``, which all executors must share."""
    import os

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            path = os.path.join(folder, row.archive)
            with open(f"{path}.part", "wb") as f:
                f.write(row.content)
            os.replace(f"{path}.part", path)

    archives.select("archive", "content").foreachPartition(put)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    archives = materialize(write_archives(load(spark, sf_dir, "pages")))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1 is 32 groups of 5 bits of its 40 hexadecimal digits.
OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
x AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(h, (k * 5 + 1)::INT, 5))::BIGINT) AS parts, max(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((parts[(k // 4 + 1)::INT] >> (15 - 5 * (k % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""
