"""WARC archives with a Zstandard dictionary in a leading skippable frame and one frame per record."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shipped, staged

#: Magic numbers of Zstandard frames, dictionaries, the dictionary's skippable frame and the first of the
#: sixteen numbers of skippable frames.
FRAME, DICTIONARY, DICTIONARY_FRAME, SKIPPABLE = 0xFD2FB528, 0xEC30A437, 0x184D2A5D, 0x184D2A50
#: What Spark's text writer puts between records: an empty skippable frame, which every reader passes over.
BETWEEN = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
#: Payloads are hot beyond this share of all rows and this number of rows.
HOT_SHARE, HOT_ROWS = 1e-5, 1000
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header without the payload. Control characters and spaces of the
    url are percent-encoded, so that no text can begin a header line."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c not in "\x7f\x85  " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Page-Refers-To: {refers_to}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    block = http if refers_to is not None else http + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary of at most ``size`` bytes trained on records; too few or too plain records are taken as raw content."""
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: Iterator[bytes], *, level: int, dictionary_bytes: int, sample_bytes: int) -> Iterator[bytes]:
    """The frames of one archive: the skippable frame with the dictionary, then a frame per record. The dictionary is
    built from the archive's first records, ``sample_bytes`` of them; only those are held."""
    held: list[bytes] = []
    size = 0
    for item in records:
        held.append(item)
        size += len(item)
        if size >= sample_bytes:
            break
    if not held:
        return
    built = dictionary(held, dictionary_bytes)
    packed = zstandard.ZstdCompressor(level=level).compress(built.as_bytes())
    yield struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    compressor = zstandard.ZstdCompressor(level=level, dict_data=built, write_checksum=True)
    for item in held:
        yield compressor.compress(item)
    for item in records:
        yield compressor.compress(item)


def with_reference(pages: DataFrame, id_col: str, url_col: str, payload_col: str, broadcast_revisits: int = 200_000) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the smallest page_id of the equal payloads, null for that row itself.

    Only ids and digests are grouped and joined; groups of over ``HOT_SHARE`` of all rows (and ``HOT_ROWS``) meet their
    rows by broadcast. The revisits are staged and counted: up to ``broadcast_revisits`` of them
    (some 100 bytes each) are broadcast, and payloads are written where they are read; more of them are met by a
    join that moves payloads once, by id and digest.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    keys = staged(rows.where(F.octet_length("payload") >= LEAST_BYTES).select("page_id", "digest").distinct(), "digests")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    hot = F.col("n") > max(HOT_ROWS, int(keys.count() * HOT_SHARE))
    # at most 1 / HOT_SHARE groups can be hot
    marked = keys.join(F.broadcast(groups.where(hot)), "digest", "left")
    others = marked.where("n is null").select("page_id", "digest").join(groups.where(~hot), "digest")
    again = marked.where("n is not null").select("page_id", "digest", "refers_to").unionByName(others.select("page_id", "digest", "refers_to"))
    revisits = again.where("not (page_id <=> refers_to)").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    revisits = staged(revisits, "revisits")
    revisits = F.broadcast(revisits) if revisits.count() <= broadcast_revisits else revisits
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    return rows.join(revisits, same, "left").drop("r_id", "r_digest")


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", level: int = 3, dictionary_bytes: int = 64 << 10, sample_bytes: int = 4 << 20, broadcast_revisits: int = 200_000) -> None:
    """Writes one record per row of ``pages`` to archives in ``folder``, one archive per task, that is per input split
    (spark.sql.files.maxPartitionBytes) or, after a join, per shuffle partition.

    Spark's text writer commits the files (so they are named ``.txt``), so any file system that Spark writes to will do
    and a lost executor's files are written again. It is given bytes that are no valid text, which it keeps as they are
    (a test fails where it does not). Of records with equal payloads of at least 100 bytes, that with the smallest page_id is the
    response and others revisit it; rows that share this smallest id are all responses. A null payload is empty; a row
    with a null id revisits where it can and is never referred to; a null url has no target header. An empty table
    gives no archive. Extra columns are ignored.
    """
    rows = with_reference(pages, id_col, url_col, payload_col, broadcast_revisits).select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (
            record(i, u, p, d, r, date)
            for b in batches
            for i, u, p, d, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True)
        )
        out: list[bytes] = []
        size = 0
        for frame in archive(records, level=level, dictionary_bytes=dictionary_bytes, sample_bytes=sample_bytes):
            out.append(frame)
            size += len(frame)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    shipped(pages.sparkSession)
    # the cast keeps the bytes as they are; the "line separator" is an empty skippable frame
    rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN).text(folder)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of one archive, decompressed one by one."""
    view, at = memoryview(data), 0
    decompressor = zstandard.ZstdDecompressor()
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_FRAME:
                raw = bytes(view[at + 8 : at + 8 + size])
                if int.from_bytes(raw[:4], "little") == FRAME:
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                kind = zstandard.DICT_TYPE_FULLDICT if int.from_bytes(raw[:4], "little") == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
            at += 8 + size
            continue
        frame, parts, step = decompressor.decompressobj(), [], 4096
        while not frame.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(chunk))
            at += len(chunk)
            step = min(step * 2, 1 << 20)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parsed(item: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of a record. A response's length and digest
    are those of the payload in the archive, and must be those of its headers; a revisit's come from its headers."""
    head, _, rest = item.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload of its digest")
    number = {k: int(v) if (v := fields.get(k)) is not None else None for k in ("Page-ID", "Page-Refers-To")}
    return number["Page-ID"], size, digest, fields["WARC-Type"], number["Page-Refers-To"], fields.get("WARC-Target-URI")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder``. A task holds one archive at a time, and one record of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [parsed(x) for x in frames(content.as_py())]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    shipped(spark)
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, OUT)
