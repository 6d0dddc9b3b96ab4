"""WARC archives of Zstandard frames: one frame a record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, with_facts

# Fixed values of the formats: a skippable frame that holds a dictionary, a frame, a dictionary.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
#: An archive ends once its records' frames have so many bytes.
ARCHIVE_BYTES = 4 << 20
#: Pages, and characters of each, that a dictionary is fitted on. It changes sizes only, never what is read back.
DICTIONARY_PAGES, DICTIONARY_CHARS = 256, 8192

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def fit_dictionary(pages: DataFrame) -> bytes:
    """A Zstandard dictionary from a bounded sample of pages; empty if they are too few."""
    full = pages.where("html is not null and html <> '' and page_id is not null")
    ids = [r[0] for r in full.select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(DICTIONARY_PAGES).collect()]
    sample = full.where(F.col("page_id").isin(ids)).select("page_id", F.substring("html", 1, DICTIONARY_CHARS)).orderBy("page_id")
    texts = [r[1].encode() for r in sample.limit(DICTIONARY_PAGES).collect()]
    try:
        return zstandard.train_dictionary(32 << 10, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    heads = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        *([("WARC-Target-URI", "".join(url.split()))] if url and url.split() else []),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and block headers."""
    p = zstandard.get_frame_parameters(data[at : at + 18])
    pos = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[pos : pos + 3], "little")
        if pos + 3 > len(data) or head >> 1 & 3 == 3:
            raise ValueError("bad block")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * p.has_checksum
    if pos > len(data):
        raise ValueError("cut frame")
    return pos


def read_records(content: bytes) -> Iterator[bytes]:
    """The records of an archive: the leading frame's dictionary, then one record from each frame."""
    data, at, dictionary = memoryview(content), 0, b""
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary, at = bytes(data[8 : 8 + size]), 8 + size
        if dictionary[:4] == FRAME:  # the dictionary may itself be compressed
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 8 <= len(data) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        end = frame_end(data, at)
        yield reader.decompressobj().decompress(data[at:end])
        at = end


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ``problem`` says what is wrong with its headers, lengths or digests, else null."""
    out: dict = dict.fromkeys(("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "problem"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        return out | {"problem": "no WARC header"}
    fields = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, c, v in (x.partition(b":") for x in lines[1:]) if c}
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]:
        return out | {"problem": f"no {missing[0]}"}
    kind, length = fields["warc-type"], fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"record_type": kind, "problem": "length"}
    block = rest[:-4]
    number = lambda x: int(x[10:-1]) if x.startswith("<urn:page:") and x[10:-1].lstrip("-").isdigit() else None
    out |= {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number(fields.get("warc-refers-to", ""))}
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + sha1_base32(block):
        return out | {"problem": "block digest"}
    http, gap, payload = block.partition(b"\r\n\r\n")
    stated = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"), None)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out |= {"payload_bytes": stated, "payload_digest": digest, "payload": payload if kind == "response" else None}
    if kind == "response" and (stated != len(payload) or digest != sha1_base32(payload)):
        return out | {"problem": "payload"}
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        return out | {"problem": "revisit"}
    return out


def link_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, refers_to)``: of equal payloads the page with the largest id is the response."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    narrow = cut(own.select("page_id", F.sha2("html", 256).alias("sha")))
    last = cut(narrow.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")))
    total = last.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # one payload, such as the empty one, may be that of a third of all pages
    links = with_facts(narrow, last.where("n > 1"), "sha", "n", total).where("page_id < last").select("page_id", "sha", "last").distinct()
    keyed = own.withColumn("sha", F.sha2("html", 256))
    return keyed.join(links, ["page_id", "sha"], "left").select("page_id", "url", "html", F.col("last").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write every row of ``pages(page_id, url, html)`` as a record, in archives under ``folder``.

    An archive is a row ``(path, content)`` of a Parquet table, as the ``binaryFile`` source reads files, so it reaches any
    store that Spark writes to. A null html is an empty payload, a null url leaves its header out; rows with a null id
    are responses; repeated rows are records of their own; an empty table gives no archives. More columns are left out.
    """
    dictionary = fit_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        head = dictionary_frame(dictionary) if dictionary else b""
        frames: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.zst"]), pa.array([head + b"".join(frames)], pa.binary())], names=["path", "content"])

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in b.columns)
                payload = html.encode()
                frame = writer.compress(record_bytes(page_id, url, payload, sha1_base32(payload), refers_to, date))
                if frames and size + len(frame) > ARCHIVE_BYTES:
                    yield archive()
                    frames, size = [], 0
                frames.append(frame)
                size += len(frame)
        if frames:
            yield archive()

    link_revisits(pages).mapInArrow(run, "path string, content binary").write.option("compression", "uncompressed").parquet(folder)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ``archives(path, content)``, a table written above or the ``binaryFile`` source.

    A record whose header, lengths or digests are wrong is kept, with ``problem`` set; so is the rest of an archive whose
    frames can't be read on, as one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                try:
                    for raw in read_records(content.as_py() or b""):
                        rows.append(parse_record(raw) | ({} if with_payload else {"payload": None}))
                        size += len(raw)
                        if size > 8 << 20:
                            yield out(rows)
                            rows, size = [], 0
                except (ValueError, struct.error, zstandard.ZstdError) as e:
                    rows.append(dict.fromkeys(names) | {"problem": f"archive: {e}"})
                if rows:
                    yield out(rows)

    return archives.select("content").mapInArrow(run, RECORD)


def through_archives(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back, without payloads."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark.read.parquet(folder), with_payload=False)
