"""WARC archives with an index: write records, keep offset, length, URL and digest of each, read selected byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.common import group_winner, map_arrow, scratch, written

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
#: An archive is closed and another begun beyond this many bytes.
ROLL_BYTES = 1 << 30
#: Ranges nearer than GAP bytes are read together, up to SPAN bytes at once.
GAP, SPAN = 1 << 16, 8 << 20
#: Index rows of one file are dealt out by blocks of this many bytes, so that a large archive is read by many tasks.
BLOCK = 64 << 20


def _line(value: str) -> str:
    """A header value: control characters percent-encoded, so that it can't end the line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member that holds one WARC/1.1 record; a revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple:
    """(page_id, payload_bytes, digest, type, refers_to, url, payload) of one gzip member; digest and size of a response are those of the bytes read."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(named["Content-Length"])].partition(b"\r\n\r\n")
    own = named["WARC-Record-ID"][10:-1]
    page_id, told = int(own) if own else None, named["WARC-Payload-Digest"].removeprefix("sha256:")
    if named["WARC-Type"] == "revisit":
        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        return page_id, size, told, "revisit", int(named["WARC-Refers-To"][10:-1]), named.get("WARC-Target-URI"), None
    if (digest := hashlib.sha256(payload).hexdigest()) != told:
        raise ValueError(f"record {own}: payload digest {digest}, header has {told}")
    return page_id, len(payload), digest, "response", None, named.get("WARC-Target-URI"), payload


class _Writer:
    """Writes a partition's records to archives of its own; a file's name is new for each attempt, so a repeated task never meets a half-written one."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches):
        context = TaskContext.get()
        out, offset, files, path, name = None, 0, None, "", ""
        for batch in batches:
            rows = []
            for page_id, url, html, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or offset >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    files, path = pafs.FileSystem.from_uri(self.folder)
                    files.create_dir(path, recursive=True)
                    name = f"{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, offset = files.open_output_stream(f"{path}/{name}", compression=None), 0
                data = record_bytes(page_id, url, (html or "").encode(), digest, size, refers_to)
                out.write(data)
                rows.append((page_id, f"{self.folder}/{name}", offset, len(data), url, digest, "response" if refers_to is None else "revisit", refers_to))
                offset += len(data)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()


def write_warc(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the index, itself written beside the archives.

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are responses and the
    others revisit it; a null page_id is never referred to unless all are null, and such rows are all responses.
    A null html is an empty payload, a null url leaves its header out; other columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    keys = written(sized.where(F.col("size") >= least).select("page_id", F.unhex("digest").alias("digest"), (-F.col("page_id")).alias("order")), "payloads")
    groups = group_winner(keys, "digest", "order").where("group_size > 1 AND page_id > -winner")
    revisits = written(groups.select("page_id", F.lower(F.hex("digest")).alias("digest"), (-F.col("winner")).alias("refers_to")).distinct(), "revisits")
    # written, so that Spark knows its size: it is broadcast only under spark.sql.autoBroadcastJoinThreshold
    marked = sized.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "size", "refers_to")
    return written(map_arrow(marked, _Writer(folder), INDEX), "warc-index")


def _ranges(rows: list[tuple]) -> list[list[tuple]]:
    """Sorted (file, offset, length) rows in runs that are read together."""
    runs: list[list[tuple]] = []
    for row in rows:
        last = runs[-1] if runs else None
        if last and last[-1][0] == row[0] and row[1] - (last[-1][1] + last[-1][2]) <= GAP and row[1] + row[2] - last[0][1] <= SPAN:
            last.append(row)
        else:
            runs.append([row])
    return runs


class _Reader:
    """Reads the records that index rows (file, offset, length) name; rows arrive sorted."""

    def __init__(self, payloads: bool):
        self.payloads = payloads

    def __call__(self, batches):
        now, stream = None, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for run in _ranges(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                if run[0][0] != now:
                    if stream is not None:
                        stream.close()
                    now = run[0][0]
                    files, path = pafs.FileSystem.from_uri(now)
                    stream = files.open_input_file(path)
                start = run[0][1]
                stream.seek(start)
                data = stream.read(run[-1][1] + run[-1][2] - start)
                rows = [parse_record(data[o - start : o - start + n]) for _, o, n in run]
                if not self.payloads:
                    rows = [(*r[:6], None) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])
        if stream is not None:
            stream.close()


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of an index select, by coalesced byte ranges of sorted offsets; any filtered index will do."""
    chosen = index.select("file", "offset", "length", F.floor(F.col("offset") / BLOCK).alias("block"))
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK))
    # a stated number: index rows are few bytes, and adaptive execution would gather them in one task
    dealt = chosen.repartition(tasks, "file", "block").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return map_arrow(dealt, _Reader(payloads), RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write_warc(pages, f"{scratch(spark)}/warc-{uuid.uuid4().hex}")
    return read_warc(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES = {"op1_warc": op1_warc}
SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, url FROM g"""
}
