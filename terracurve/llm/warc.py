"""WARC archives with an index that comes first: written in tasks, read back by coalesced byte ranges.

Every page becomes a record, a gzip member of its own, in the archive of the task that
wrote it. The task returns, for each record, the file, offset and length, beside URL,
digest and type; this index is a table, committed by Spark, and it alone says which
archives and records exist. What a failed attempt of a task wrote stays in a file
that no row of the index names.

To read records back, rows of the index are selected like those of any table, dealt by file and
stretch of the file, sorted by offset, and neighbours no more than ``GAP`` bytes apart
are fetched in one read of at most ``SPAN`` bytes (a larger record is a read of its own). A
task holds one such range. The digest of every payload is checked.

Of records with equal payloads of at least ``LEAST`` bytes the one with the largest
page_id is a response and the others are revisits, which have the header of the reply
(with the payload's length), the digest and the id of the response, but no payload. Pages
whose digest certainly has no second page, by a bitmap of the digests, are archived where
they lie; only the others are shuffled.

Null payloads are empty, null URLs are left out of the record. Rows without page_id get a
random record id and are responses only if all pages with their payload have no
page_id. Several rows with the largest page_id are responses all. Characters that can't stand in a header line
are percent-encoded in URLs; the index has them as they were. Very long payloads are held
whole, one at a time. Columns besides the three named ones aren't read, whatever their names. An
empty table gives an empty result.

Tasks reach the archives through ``pyarrow.fs``, so the folder is one it knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_dir, sieve, sieved, table, written

LEAST = 1000
#: Bytes between two wanted records that are read with them; bytes of a read; bytes of a stretch; bytes of an archive; bytes that a task reads, if that makes more tasks than a shuffle has.
GAP, SPAN, STRETCH, ARCHIVE, TASK = 64 << 10, 4 << 20, 16 << 20, 1 << 30, 256 << 20
#: Bytes of payloads that go to or from Spark at a time.
OUT_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _header_safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:x-page:{page_id}>"


def _page(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def _lines(kind: str, record_id: str, headers: dict[str, str | None], block: bytes) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE} | headers | {"Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n" + block + END


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit if ``refers_to`` isn't null."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    headers = {"WARC-Target-URI": None if url is None else _header_safe(url), "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type": HTTP}
    headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": _id(refers_to)} if again else {}
    return gzip.compress(_lines("revisit" if again else "response", _id(page_id), headers, http if again else http + payload), 6, mtime=0)


def parsed(member: bytes) -> dict:
    """The fields of ``RECORD`` from a record's bytes; the payload's digest is checked."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(END)
    lines = head.decode().split("\r\n")
    if lines[0] + "\r\n" != VERSION.decode():
        raise ValueError(f"no record starts with {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block, tail = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if tail != END:
        raise ValueError(f"{fields['WARC-Record-ID']} doesn't end where its length says")
    http, _, payload = block.partition(END)
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    again = fields["WARC-Type"] == "revisit"
    if not again and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its digest says")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload_bytes": size, "payload_digest": digest, "payload": None if again else payload,
    }


def coalesced(rows: Iterable[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """file, start, end and the (offset, length) of its records, for each read; ``rows`` are sorted by file and offset."""
    now = None
    for file, offset, length in rows:
        if now and file == now[0] and offset - now[2] <= gap and offset + length - now[1] <= span:
            now[2] = max(now[2], offset + length)
            now[3].append((offset, length))
            continue
        if now:
            yield tuple(now)
        now = [file, offset, offset + length, [(offset, length)]]
    if now:
        yield tuple(now)


class _Archive:
    """An archive under its own name that is opened when its first record comes."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        store, path = fs.FileSystem.from_uri(self.name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size = store.open_output_stream(path, compression=None), 0
        self.add(gzip.compress(_lines("warcinfo", _id(None), {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), 6, mtime=0))

    def add(self, member: bytes) -> int:
        at = self.size
        self.out.write(member)
        self.size += len(member)
        return at


def _archived(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    archive = None
    for batch in batches:
        rows = []
        columns = [batch.column(c) for c in ("page_id", "url", "digest", "refers_to")]
        for *own, payload in zip(*columns, batch.column("payload"), strict=True):
            page_id, url, digest, refers_to = (x.as_py() for x in own)
            if archive is not None and archive.size >= most:
                archive.out.close()
                archive = None
            archive = archive or _Archive(folder)
            member = record(page_id, url, payload.as_buffer().to_pybytes() if payload.is_valid else b"", digest, refers_to)
            rows.append((archive.name, archive.add(member), len(member), page_id, url, digest, "response" if refers_to is None else "revisit", refers_to))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
    if archive is not None:
        archive.out.close()


_NAMES = [f.split()[0] for f in INDEX.split(", ")]
_TYPES = [pa.string() if f.endswith("string") else pa.int64() for f in INDEX.split(", ")]


def typed(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload (binary), digest and refers_to: null for responses, the response's page_id for revisits."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_ = F.octet_length("payload") >= least
    many = rows.where(long_).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    many = written(many.select(F.col("digest").alias("_digest"), "first"), "payloads")
    marked = sieved(rows, sieve(many, F.col("_digest"), again=F.lit(True)), F.col("digest"), "again")
    lone = marked.where(~F.col("again") | ~long_).select(*rows.columns, F.lit(None).cast("long").alias("refers_to"))
    met = marked.where(F.col("again") & long_).join(many, F.col("digest") == F.col("_digest"), "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return lone.unionByName(met.select(*rows.columns, other.alias("refers_to")))


def archive(records: DataFrame, folder: str | None = None, most: int = ARCHIVE) -> DataFrame:
    """Writes archives into ``folder`` (one in the shared folder if there is none) and returns their index."""
    folder = folder or f"{own_dir(records.sparkSession)}/warc-{uuid.uuid4().hex}"
    return written(records.mapInArrow(lambda batches: _archived(batches, folder, most), INDEX), "warc-index")


def _fetched(batches: Iterator[pa.RecordBatch], gap: int, span: int, payloads: bool) -> Iterator[pa.RecordBatch]:
    wanted = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
    kinds = [pa.binary() if f.endswith("binary") else pa.string() if f.endswith("string") else pa.int64() for f in RECORD.split(", ")]
    schema = pa.schema([(f.split()[0], t) for f, t in zip(RECORD.split(", "), kinds, strict=True)])
    name = store = source = None
    rows, size = [], 0
    for file, start, end, members in coalesced(wanted, gap, span):
        if file != name:
            if source is not None:
                source.close()
            store, path = fs.FileSystem.from_uri(file)
            name, source = file, store.open_input_file(path)
        source.seek(start)
        data = memoryview(source.read(end - start))
        for offset, length in members:
            rows.append(parsed(data[offset - start : offset - start + length]) | ({} if payloads else {"payload": None}))
            size += len(rows[-1]["payload"] or b"")
            if size >= OUT_BYTES or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
    if source is not None:
        source.close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def fetched(index: DataFrame, payloads: bool = True, gap: int = GAP, span: int = SPAN, stretch: int = STRETCH) -> DataFrame:
    """The records (columns of ``RECORD``) that the rows of ``index`` name, URLs as they stand in the archive; without
    ``payloads`` these are read and checked, but not returned."""
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))  # the index is small, what it leads to isn't
    part = F.expr(f"offset div {stretch}")
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", part).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(lambda batches: _fetched(batches, gap, span, payloads), RECORD)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(typed(table(spark, sf_dir, "pages")))
    return fetched(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d from pages),
m as (select d, max(page_id) first from p where n >= 1000 group by d)
select p.page_id, p.n::bigint payload_bytes, p.d payload_digest, case when first is null or p.page_id = first then 'response' else 'revisit' end record_type,
 case when p.page_id is distinct from first then first end refers_to
from p left join m on p.d = m.d and p.n >= 1000
"""
