"""WARC files: written with an index, indexed where there is none, and read by coalesced byte ranges of selected records."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._shared import ensure_workers, new_folder, written

INDEX = "file string, offset long, length long, record_type string, url string, record_id string, digest string, content_type string"
#: Bytes between two selected records that are read along rather than skipped, and bytes of a read.
GAP, READ = 64 << 10, 4 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, record_id: str, payload: bytes, content_type: str, date: str, extra: tuple[tuple[str, str], ...] = ()) -> bytes:
    """One uncompressed WARC/1.0 record; line breaks in ``url`` are percent-encoded."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest_of(payload)), *extra, ("Content-Type", content_type), ("Content-Length", str(len(payload)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with lower-case names, and the payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return h, rest[: int(h["content-length"])]


def _line(file: str, offset: int, length: int, h: dict[str, str], payload: bytes) -> tuple:
    return file, offset, length, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-record-id", "").strip("<>"), h.get("warc-payload-digest") or digest_of(payload), h.get("content-type")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.int64() if n in ("offset", "length") else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def write_warc(pages: DataFrame, folder: str | None = None, level: int = 1) -> DataFrame:
    """``pages`` (page_id, url, html) as .warc.gz files, one for each partition, and their index (columns of INDEX, page_id).

    Each record is a gzip member of its own, so that it can be read alone.  A
    task writes to a name of its attempt and renames when it is through, so
    attempts that are lost leave no half file under a final name; the index is
    written as Parquet beside the files and names the one that holds the record.
    Null urls are written as empty and read as null again, null texts as records
    of type ``metadata`` without a payload; repeated rows are records of their own.
    """
    spark = pages.sparkSession
    ensure_workers(spark)
    folder = folder or new_folder(spark, "warc")
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fs, path = _open(folder)
        at, out = 0, None
        for batch in batches:
            rows, ids = [], []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{path}/.{name}", compression=None)
                kind, payload = ("metadata", b"") if html is None else ("resource", html.encode())
                rid = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page}\0{url}\0{task.partitionId()}\0{at}"))
                raw = record(kind, url or "", rid, payload, "text/html", "1970-01-01T00:00:00Z", () if page is None else (("X-Page-ID", str(page)),))
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(raw) + z.flush()
                out.write(member)
                rows.append((f"{folder}/{name}", at, len(member), kind, url, f"urn:uuid:{rid}", digest_of(payload), "text/html"))
                ids.append(page)
                at += len(member)
            if rows:
                b = _batch(rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], [*b.schema.names, "page_id"])
        if out is not None:
            out.close()
            fs.move(f"{path}/.{name}", f"{path}/{name}")

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return written(rows.mapInArrow(run, INDEX + ", page_id long"), "warc-index")


def _members(stream: pa.NativeFile, gz: bool) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of every record of a file, read front to back in constant memory but for the record at hand."""
    if gz:
        at, data = 0, b""
        while True:
            if not data and not (data := stream.read(1 << 20)):
                return
            z, used, parts = zlib.decompressobj(31), 0, []
            while not z.eof:
                if not data and not (data := stream.read(1 << 20)):
                    raise ValueError(f"the record at {at} is cut off")
                parts.append(z.decompress(data))
                used += len(data) - len(z.unused_data)
                data = z.unused_data if z.eof else b""
            yield at, used, b"".join(parts)
            at += used
    else:
        at, data, ended = 0, b"", False
        while True:
            while (head := data.find(b"\r\n\r\n")) < 0 and not ended:
                more = stream.read(1 << 20)
                ended, data = not more, data + more
            if head < 0:
                return
            size = head + 4 + int(next(x.split(b":")[1] for x in data[:head].split(b"\r\n") if x.lower().startswith(b"content-length"))) + 4
            while len(data) < size and not ended:
                more = stream.read(max(1 << 20, size - len(data)))
                ended, data = not more, data + more
            yield at, size, data[:size]
            at, data = at + size, data[size:]


def index_warc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The index (columns of INDEX) of WARC files that have none: each is read once, front to back, by one task."""
    ensure_workers(spark)
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = _open(file)
                with fs.open_input_stream(path, compression=None) as s:
                    rows = []
                    for at, n, raw in _members(s, path.endswith(".gz")):
                        rows.append(_line(file, at, n, *parse(raw)))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return files.repartition(F.col("file")).select("file").mapInArrow(run, INDEX)


def _spans(rows: pd.DataFrame) -> Iterator[tuple[str, int, int, pd.DataFrame]]:
    """Reads that cover rows sorted by file and offset: neighbours within GAP share one of up to READ bytes."""
    a, n = 0, len(rows)
    file, offset, stop = rows["file"].to_numpy(), rows["offset"].to_numpy(), (rows["offset"] + rows["length"]).to_numpy()
    while a < n:
        b, end = a + 1, stop[a]
        while b < n and file[b] == file[a] and offset[b] - end <= GAP and max(end, stop[b]) - offset[a] <= READ:
            end = max(end, stop[b])
            b += 1
        yield file[a], int(offset[a]), int(end), rows.iloc[a:b]
        a = b


def read_records(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """The records that ``index`` selects (rows of an index, filtered or joined at will): its columns and ``payload``, ``verified``.

    The rows are sorted by file and offset, a range of them to a task; records
    that lie near each other come with one read.  ``verified`` says whether the
    payload has the digest of the index.  Only the index is shuffled.
    """
    ensure_workers(index.sparkSession)
    rows = index.repartitionByRange(*([partitions] if partitions else []), "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            for file, a, b, part in _spans(batch.select(["file", "offset", "length"]).to_pandas()):
                if opened is None or opened[0] != file:
                    if opened:
                        opened[1].close()
                    fs, path = _open(file)
                    opened = file, fs.open_input_file(path)
                opened[1].seek(a)
                data = opened[1].read(b - a)
                payloads, ok = [], []
                want = batch.column("digest").slice(part.index[0], len(part)).to_pylist()
                for at, n, digest in zip(part["offset"], part["length"], want, strict=True):
                    raw = data[at - a : at - a + n]
                    payload = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)[1]
                    payloads.append(payload)
                    ok.append(digest_of(payload) == digest)
                own = batch.slice(part.index[0], len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(payloads, pa.binary()), pa.array(ok)], [*own.schema.names, "payload", "verified"])
        if opened:
            opened[1].close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + ", payload binary, verified boolean")


def pages_by_warc(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) written as WARC, indexed, and read back by the index: rows (page_id, url, html, n_bytes, sha256, verified)."""
    got = read_records(write_warc(pages))
    html = F.when(F.col("record_type") == "resource", F.decode("payload", "UTF-8"))
    return got.select("page_id", "url", html.alias("html"), F.length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("sha256"), "verified")


WARC_SQL = """
SELECT page_id, url, html, STRLEN(COALESCE(html, ''))::BIGINT AS n_bytes, SHA256(COALESCE(html, '')) AS sha256, TRUE AS verified
FROM pages"""
