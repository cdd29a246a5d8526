"""WARC archives compressed with Zstandard: a frame per record, the dictionary in a leading skippable frame.

Archives are written by Spark's text writer, so they are committed like any output and may lie in any store
that Spark writes to: each row is a frame, and the line separator is an empty skippable frame, which readers
of the format pass over. They are read as binary files, frame by frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import textbytes as tb
from tokenmill.llm.common import stage, with_row
from tokenmill.session import work_dir

LEAST_REVISIT = 1000  # bytes from which an equal payload is written once
LEVEL = 3
# bounds of the sample that an archive's dictionary is trained on
SAMPLE_RECORDS = 128
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16_384
# Fixed values of the Zstandard and WARC formats.
MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
WARC_DICTIONARY = 0x184D2A5D
SKIPPABLE = 0x184D2A50
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"
_NO_ID = 1 << 64
NAMES = ["WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"]


def record_id(page_id: int | None) -> str:
    """A record's id holds its page's id, also a null one."""
    return f"<urn:uuid:{uuid.UUID(int=_NO_ID if page_id is None else page_id & (_NO_ID - 1))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    return None if n == _NO_ID else n - (_NO_ID if n >> 63 else 0)


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit with the response's header alone."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _frames(batches):
    """The frames of one archive: the dictionary first. A few records are held back to train it on."""
    def rows():
        for b in batches:
            for part, raw, offsets in tb.slices([b], "html"):
                data = raw.tobytes()
                others = (part.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
                for page, url, refers, a, z in zip(*others, offsets[:-1].tolist(), offsets[1:].tolist()):
                    yield record(page, url, data[a:z], refers)

    held, size, source = [], 0, rows()
    for r in source:
        held.append(r)
        size += len(r)
        if len(held) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    out = []
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, held, k=256, d=8)
        packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
        out.append(WARC_DICTIONARY.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        coder = zstandard.ZstdCompressor(LEVEL, dict_data=dictionary)
    except zstandard.ZstdError:  # too few records to learn from: an archive without a dictionary
        coder = zstandard.ZstdCompressor(LEVEL)

    def frames():
        yield from out
        for r in held:
            yield coder.compress(r)
        for r in source:
            yield coder.compress(r)

    full: list[bytes] = []
    if held:
        for f in frames():
            full.append(f)
            if len(full) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.binary())], ["frame"])
                full = []
    if full:
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.binary())], ["frame"])


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds refers_to: the largest page id with the same payload, where that is another page.

    Payloads meet by digest and length; only digests that occur twice are looked up again, and only ids
    and digests are grouped. A null id is never referred to and refers to nothing.
    """
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = with_row(pages.select("page_id", "url", "html"), "row").withColumn("bytes", F.octet_length(data))
    keyed = sized.select("row", "page_id", F.when(F.col("bytes") >= least, F.sha1(data)).alias("digest"), "bytes")
    keyed = stage(keyed.filter("digest is not null and page_id is not null"), "payloads")
    last = keyed.groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    last = stage(last.drop("n"), "copied-payloads")
    copies = keyed.join(last, ["digest", "bytes"]).filter("page_id <> last").select("row", F.col("last").alias("refers_to"))
    return sized.join(copies, "row", "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Writes page_id, url and html as archives below ``path``, one per partition.

    A null html is an empty payload; a null url leaves the target out; a null page id is written as such.
    Equal payloads of at least ``least`` bytes are written once, at the largest page id; the other pages are
    revisits. Rows with that largest id that are there twice are both responses. Other columns are dropped.
    """
    frames = with_revisits(pages, least).mapInArrow(_frames, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("latin-1")).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame that begins at ``at``, by its block headers. ValueError if it is cut off."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    here = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if here + 3 > len(data):
            raise ValueError("cut frame")
        head = int.from_bytes(data[here : here + 3], "little")
        here += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    here += 4 if flags >> 2 & 1 else 0
    if here > len(data):
        raise ValueError("cut frame")
    return here


def frames_of(data: memoryview):
    """Records of an archive: (offset, bytes, error). The archive's dictionary is loaded from its first frame."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            yield at, b"", "cut frame"
            return
        magic, size = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 + size > len(data):
                yield at, b"", "cut frame"
                return
            if at == 0 and magic == WARC_DICTIONARY:
                content = bytes(data[8 : 8 + size])
                if content[:4] == MAGIC:
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                if content[:4] != DICTIONARY_MAGIC:
                    yield 0, b"", "bad dictionary"
                    return
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        if bytes(data[at : at + 4]) != MAGIC:
            yield at, b"", "no frame"  # nothing says where the next one begins
            return
        try:
            end = frame_end(data, at)
        except (ValueError, IndexError):
            yield at, b"", "cut frame"
            return
        try:
            yield at, reader.decompressobj().decompress(data[at:end]), None
        except zstandard.ZstdError:
            yield at, b"", "bad frame"
        at = end


def parse(content: bytes) -> dict:
    """Fields of one record; ``error`` names what is wrong with its headers or lengths."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        return {"error": "no WARC header"}
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return {"error": "bad header line"}
        fields[name.strip().lower()] = value.strip()
    out = {"record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "error": None}
    missing = [n for n in NAMES if n.lower() not in fields]
    if missing:
        return out | {"error": f"no {missing[0]}"}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"error": "wrong Content-Length"}
    try:
        out["page_id"] = page_of(fields["warc-record-id"])
        out["refers_to"] = page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    except ValueError:
        return out | {"error": "bad record id"}
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    size = re.search(rb"\r\ncontent-length: *(\d+)", http, re.I)
    if not mark or not size:
        return out | {"error": "no HTTP header"}
    out["payload_bytes"] = int(size[1])
    try:
        digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
    except ValueError:
        return out | {"error": "bad digest"}
    out["payload_digest"] = digest
    if out["record_type"] == "revisit":
        return out | ({} if out["refers_to"] is not None and not payload else {"error": "bad revisit"})
    if len(payload) != out["payload_bytes"]:
        return out | {"error": "wrong payload length"}
    if hashlib.sha1(payload).hexdigest() != digest:
        return out | {"error": "wrong digest"}
    return out | {"payload": payload}


_FIELDS = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
])


def _read(batches):
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            rows, size = [], 0
            for offset, data, error in frames_of(memoryview(content.as_buffer())):
                rows.append({"file": path, "offset": offset} | ({"error": error} if error else parse(data)))
                size += len(data)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: file, offset, page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload, error.

    ``error`` is null for valid records. A record with a wrong header, length or digest is returned with its
    error; after a frame that is cut off or not a frame the rest of that archive can't be read, which is one
    row with an error. Sizes and digests of revisits are those of the payload they stand for; their payload is
    null. An archive is read whole by one task, so archives should stay at some hundred megabytes.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
    return files.mapInArrow(_read, kinds)


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    path = work_dir(pages.sparkSession, "archives")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
