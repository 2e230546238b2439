"""WARC archives: writing pages as records, and a splittable reader.

Writer: every record is a gzip member of its own. Records with equal payloads
of at least ``least_bytes`` become one response (the smallest page id) and
revisits, found by joins on narrow rows of ids and digests. Each write task puts
its members into one new file below a folder that all executors share and
returns the file's path and size, so files of failed or repeated attempts are
never read.

Reader: files are cut into byte ranges, one row each. A task scans its range
for the gzip magic, and takes a place as a member only if it inflates to a WARC
header; compressed data that happens to hold the magic is thereby passed over.
A task owns the records that start inside its range and reads past its end to
finish the last one.

Both use ``pyarrow.fs``, so the folder may be on any store pyarrow can open.

Defined cases: a null page has an empty payload; payloads under the limit are
always responses; rows with the smallest id of their payload are all responses,
also where the row is repeated; rows without id come last (with nothing to
refer to, they are responses); line breaks in urls are written as spaces.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourseflow.session import cut_lineage, new_table_path

LEAST_BYTES = 100
RANGE_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_DATE = "1970-01-01T00:00:00Z"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Date": _DATE, **fields, "Content-Length": str(len(block))}.items())
    data = b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _page_record(page_id, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to) -> bytes:
    response = refers_to is None
    fields = {
        "WARC-Type": "response" if response else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if not response:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"
        fields["X-Refers-To-Page"] = str(refers_to)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return record(fields, http + (payload if response else b""))


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, payload, n_bytes, digest, refers_to``: what to write. Payloads of revisits are left out."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    long = rows.where(F.col("n_bytes") >= least_bytes)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # narrow rows: ids and digests, none of the payloads
    revisits = long.select("page_id", "digest").join(firsts, "digest").where("page_id is null or page_id > first")
    named = revisits.where("page_id is not null").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    nameless = revisits.where("page_id is null").select("digest", F.col("first").alias("refers_to")).distinct()
    with_id = rows.where("page_id is not null").join(named, ["page_id", "digest"], "left")
    without = rows.where("page_id is null").join(nameless, "digest", "left")
    both = with_id.unionByName(without)
    return both.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def _write(folder: str):
    def step(batches):
        store, base = file_system(folder)
        name = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
        size = count = 0
        out = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, url, payload, n_bytes, digest, refers_to = row
                if out is None:
                    out = store.open_output_stream(name, compression=None)
                    size += out.write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.0\r\n"))
                size += out.write(_page_record(page_id, url, payload or b"", n_bytes, digest, refers_to))
                count += 1
        if out is not None:
            out.close()
            head = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
            yield pa.RecordBatch.from_arrays([pa.array([head + name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])

    return step


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archives; returns the stored list of files: ``path, bytes, records``."""
    store, base = file_system(folder)
    store.create_dir(base, recursive=True)
    order = ["page_id", "url", "payload", "n_bytes", "digest", "refers_to"]
    return cut_lineage(planned(pages, least_bytes).select(order).mapInArrow(_write(folder), "path string, bytes bigint, records bigint"))


class _Window:
    """Bytes of a file from a place on, read in steps."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        new = self.file.read(_READ)
        self.data += new
        return bool(new)

    def forget(self, at: int) -> None:
        self.data, self.base = self.data[at - self.base :], at


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """Content of the gzip member at a place and where it ends; None if there is none or it is no WARC record."""
    inflate = zlib.decompressobj(31)
    out, place, checked = [], at - window.base, False
    while not inflate.eof:
        piece = window.data[place : place + _READ]
        if not piece:
            if not window.more():
                return None
            continue
        place += len(piece)
        try:
            out.append(inflate.decompress(piece))
        except zlib.error:
            return None
        if not checked and sum(map(len, out)) >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = True
    return (b"".join(out), window.base + place - len(inflate.unused_data)) if checked else None


def members(file, begin: int, end: int) -> Iterator[bytes]:
    """WARC records whose members start in ``begin .. end - 1``."""
    window = _Window(file, begin)
    at = begin
    while at < end:
        found = window.data.find(_MAGIC, at - window.base)
        if found < 0:
            at = max(at, window.base + len(window.data) - len(_MAGIC) + 1)
            window.forget(min(at, window.base + len(window.data)))
            if at >= end or not window.more():
                return
            continue
        at = window.base + found
        if at >= end:
            return
        member = _member(window, at)
        if member is None:
            at += 1
            continue
        yield member[0]
        at = member[1]
        if at <= window.base + len(window.data):
            window.forget(at)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    return fields, rest[: int(fields["content-length"])]


_ROW = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def _read(batches):
    for batch in batches:
        for path, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
            store, name = file_system(path)
            rows: list[tuple] = []
            with store.open_input_file(name) as file:
                for data in members(file, begin, end):
                    fields, block = parse(data)
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest, payload = fields["warc-payload-digest"].removeprefix("sha256:"), None
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), fields.get("warc-target-uri"), kind, n, digest, number("x-refers-to-page"), payload))
                    if len(rows) >= 500:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _ROW.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def read(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of archives listed as ``path, bytes``; payloads of responses with them."""
    places = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("bigint")), F.lit(range_bytes).cast("bigint")))
    ranges = files.select("path", "bytes", places.alias("begin")).select("path", "begin", F.least(F.col("begin") + range_bytes, "bytes").alias("end"))
    # a row is a task's work: deal them out one by one
    total = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes)).alias("n")).first()["n"] or 1
    tasks = int(min(total, 100_000))
    dealt = ranges.repartition(tasks) if tasks > 1 else ranges
    return dealt.mapInArrow(_read, _ROW)


def report(pages: DataFrame) -> DataFrame:
    """The registered query: write the pages, read the archives back."""
    files = write(pages, new_table_path(pages.sparkSession, "warc"))
    return read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


REPORT_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first < p.page_id then f.first end as refers_to
from p left join f on p.payload_bytes >= 100 and p.payload_digest = f.payload_digest
"""
