"""WARC archives with a Zstandard dictionary.

Each archive is written by one task: the records that go into it train its dictionary, which stands in a skippable
frame at the file's head; every record is a frame of its own, compressed with the dictionary. Records are buffered up to
a fixed size, so an archive's memory is bounded. Files get names of their own and count only if the task that wrote them
is committed: the table of archives names them, and whatever a lost or repeated task left behind is not in it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: The head of the frame that holds a dictionary, and the profile of records of known payloads.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

REVISIT_BYTES = 1000
ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 16_000_000, 64_000, 6
#: Archives are read in pieces of so many bytes: what a piece holds beyond a record is copied once.
READ_BYTES = 16_384
BATCH_ROWS = 256


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Per page that has a twin: page_id, digest (hex SHA-1), refers_to (the largest page_id with that payload)."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    known = pages.select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("n")).filter(F.col("n") >= least)
    twins = known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).filter("refers_to <> _least")
    return known.select("page_id", "digest").distinct().join(twins.drop("_least"), "digest").filter(F.col("page_id") != F.col("refers_to"))


def _record(kind: str, fields: list[tuple[str, str]], http: bytes, payload: bytes) -> bytes:
    body = http + payload
    head = [("WARC-Type", kind), *fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def _id_of(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record_of(page_id, url: str | None, payload: bytes, digest: bytes, refers_to) -> bytes:
    """A page as a response record, or as a revisit record without payload if ``refers_to`` names a page."""
    fields = [("WARC-Record-ID", _id_of(page_id)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", fields, http, payload)
    return _record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _id_of(refers_to))], http, b"")


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstd.ZstdCompressionDict | None:
    """A dictionary from an archive's own records; None where they are too few or too small for one."""
    try:
        return zstd.train_dictionary(min(size, sum(map(len, records)) // 8), records, k=512, d=8, level=LEVEL)
    except (zstd.ZstdError, ValueError):
        return None


def archive(records: list[bytes], known: zstd.ZstdCompressionDict | None) -> bytes:
    """The bytes of an archive: the dictionary, if there is one, in a skippable frame, then a frame per record."""
    out = io.BytesIO()
    if known is not None:
        raw = known.as_bytes()
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    tool = zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
    for r in records:
        out.write(tool.compress(r))
    return out.getvalue()


def records_in(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time, in time that grows with its bytes."""
    known, start = None, 0
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", raw, 4)[0]
        known, start = zstd.ZstdCompressionDict(raw[8 : 8 + size]), 8 + size
    tool = zstd.ZstdDecompressor(dict_data=known) if known is not None else zstd.ZstdDecompressor()
    view = memoryview(raw)
    while start < len(view):
        frame, parts = tool.decompressobj(), []
        while not frame.eof:
            piece = view[start : start + READ_BYTES]
            if not len(piece):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(piece))
            start += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields (names in lower case) and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _where(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, for the stores that Arrow opens: local, hdfs, s3 (also as s3a or s3n), gs, abfs(s)."""
    scheme, _, rest = path.partition("://")
    if not rest:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    try:
        return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"archives can't be written to {scheme}: set spark.checkpoint.dir to a local, hdfs, s3, gs or abfs folder") from e


def write(pages: DataFrame, ws: Workspace, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the table of archives: path, n_records, n_bytes, dictionary_bytes.

    An archive with too few or too small records to train on has no dictionary: its dictionary_bytes are 0.
    A null html is an empty payload; a null url leaves its field out. Repeated rows are records each; of equal payloads
    all rows of the largest page_id are responses. Rows with a null page_id are responses. An empty table has no archives.
    """
    folder = ws.folder("archives")
    known = ws.keep(revisits(pages, least).select("page_id", "refers_to", "digest"), "revisits")
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    plain = pages.select("page_id", url.cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # each page has one row at most in ``known`` for its payload
    rows = plain.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).join(known, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _where(folder)
        store.create_dir(at, recursive=True)
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            known = train(held)
            raw = archive(held, known)
            with store.open_output_stream(f"{at}/{name}", compression=None) as out:
                out.write(raw)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [len(held)], "n_bytes": [len(raw)], "dictionary_bytes": [0 if known is None else len(known.as_bytes())]})

        for batch in batches:
            for i in range(batch.num_rows):
                page, link, html, refers = (batch.column(c)[i].as_py() for c in range(4))
                payload = html.encode()
                r = record_of(page, link, payload, hashlib.sha1(payload).digest(), refers)
                if held and size + len(r) > archive_bytes:
                    yield close()
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield close()

    return ws.keep(rows.mapInArrow(save, "path string, n_records bigint, n_bytes bigint, dictionary_bytes bigint"), "manifest")


def read(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Reads every record back: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url.

    A response's length and digest are those of the payload read, and must be what its record says; a revisit has only
    what the record says.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _where(path)
                with store.open_input_stream(at, compression=None) as f:
                    raw = f.read()
                rows: list[dict] = []
                for record in records_in(raw):
                    rows.append(_row(*parse(record)))
                    if len(rows) == BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string())])
    n = max(1, archives.count())
    spread = archives.select("path").repartition(min(n, 4096))
    out = spread.mapInArrow(load, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _page_of(said: str | None) -> str | None:
    page = said.removeprefix("<urn:page:").removesuffix(">") if said else "null"
    return None if page == "null" else page


def _row(fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != said):
        raise ValueError(f"a damaged record: {fields['warc-record-id']}")
    return {"page_id": _page_of(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": said, "record_type": fields["warc-type"], "refers_to": _page_of(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri")}
