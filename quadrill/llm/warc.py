"""WARC archives with revisit resolution.

``write_pages`` writes one response record per page. ``deduplicate`` reads the headers of archives, shuffles
them by payload digest, turns every later copy of a payload into a revisit of the first one and writes new
archives with fresh headers; revisit records that the input already holds are joined to their responses by
record id. ``read`` reads archives back. Each record is a gzip member of its own, so readers can seek.

Archives are written through ``pyarrow.fs`` to the folder that the cluster shares. A task writes under a name
of its attempt and renames at its end, so a lost executor leaves no half-written archive behind.

Null payloads are empty payloads, payloads of any length are one record; one record is held at a time. Page ids of any text come back as
they were (percent-encoded in their header); urls are put on one line. Rows with equal or null page ids get records of their own (a record's id comes
from its archive and its place in it); among equal payloads the first is the one with the smallest page id, nulls
last, then the smallest record id. An empty table gives no archives, and no archives give no rows. Other columns of the input are not read,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrill.llm.common import forget, new_path, table, written

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PLACE = "file string, offset long, length long"
HEADER = f"{PLACE}, record_id string, record_type string, page_id string, url string, payload_digest string, payload_bytes long, refers_to_id string"
_PLAIN = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def clean(value: object) -> str:
    """A header value on one line."""
    return "" if value is None else " ".join(str(value).split())


def fields_of(kind: str, record_id: str, page_id: str, url: str, digest: str, size: int) -> list[tuple[str, str]]:
    return [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Bytes", str(size)),
        ("X-Page-ID", quote(page_id, safe=_PLAIN)),
        ("Content-Type", "application/http; msgtype=response"),
    ]


class Archive:
    """Writes one archive under a name of this attempt; ``close`` gives it its final name."""

    def __init__(self, uri: str, name: str):
        self.fs, folder = open_fs(uri)
        self.fs.create_dir(folder, recursive=True)
        self.name, self.path = name, f"{folder}/{name}"
        ctx = TaskContext.get()
        self.tmp = f"{folder}/.{name}.{ctx.taskAttemptId() if ctx else 0}"
        self.out = self.fs.open_output_stream(self.tmp, compression=None, buffer_size=1 << 20)
        self.offset = 0

    def add(self, data: bytes) -> tuple[int, int]:
        at = self.offset
        self.out.write(data)
        self.offset += len(data)
        return at, len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.tmp)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one decompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields.get("content-length", 0))]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def members(uri: str, name: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, decompressed record) of every gzip member; only one record is held at a time."""
    fs, folder = open_fs(uri)
    with fs.open_input_stream(f"{folder}/{name}", compression=None, buffer_size=1 << 20) as source:
        unpack, start, at, parts, buffer = zlib.decompressobj(31), 0, 0, [], memoryview(b"")
        while True:
            if not buffer and not (buffer := memoryview(source.read(1 << 20))):
                return
            # what a member doesn't use of a piece is copied, so pieces are small
            piece = buffer[: 1 << 14]
            parts.append(unpack.decompress(piece))
            used = len(piece) - len(unpack.unused_data)
            at, buffer = at + used, buffer[used:]
            if unpack.eof:
                yield start, at - start, b"".join(parts)
                unpack, start, parts = zlib.decompressobj(31), at, []


def write_pages(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One response record per row; returns the names of the archives written (file, records)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, archive, n = f"pages-{TaskContext.get().partitionId():06d}.warc.gz", None, 0
        try:
            for pdf in batches:
                for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                    archive = archive or Archive(uri, name)
                    payload = html.encode("utf-8", "replace") if isinstance(html, str) else b""
                    page = page_id if isinstance(page_id, str) else ""
                    identity = f"urn:uuid:{uuid.uuid5(_SPACE, f'{name}/{n}/{page}')}"
                    archive.add(record(fields_of("response", identity, page, clean(url), sha1_base32(payload), len(payload)), HTTP % len(payload) + payload))
                    n += 1
        except BaseException:
            if archive:
                archive.abort()
            raise
        if archive:
            archive.close()
            yield pd.DataFrame({"file": [name], "records": [n]})

    picked = pages.selectExpr(f"CAST(`{id_col}` AS STRING) AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    return written(picked.mapInPandas(run, "file string, records long"), "archives")


def headers(files: DataFrame, uri: str, verify: bool = False) -> DataFrame:
    """One row per record of the archives named in ``files``; ``verify`` recomputes digest and size of every response."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                rows = []
                for offset, length, data in members(uri, name):
                    f, block = parse(data)
                    digest, size = f.get("warc-payload-digest", "").rpartition(":")[2], f.get("x-payload-bytes", "")
                    if f.get("warc-type") == "response" and (verify or not digest or not size):
                        payload = payload_of(f, block)
                        digest, size = sha1_base32(payload), str(len(payload))
                    rows.append((name, offset, length, f.get("warc-record-id", "").strip("<>"), f.get("warc-type"), unquote(f.get("x-page-id", "")) or None, f.get("warc-target-uri", ""), digest or None, int(size) if size else None, f.get("warc-refers-to", "").strip("<>") or None))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in HEADER.split(", ")]
    tasks = max(1, files.count())
    spread = files.select("file").repartitionByRange(min(tasks, 4096), "file") if tasks > 1 else files.select("file")
    return spread.mapInPandas(run, HEADER)


def deduplicate(spark: SparkSession, files: DataFrame, uri: str, to: str, least_bytes: int = 0, id_type: str = "long") -> DataFrame:
    """Write archives to ``to`` in which only the first record of each payload of at least ``least_bytes`` keeps it.

    Headers alone are shuffled. The first record of each digest comes from a pre-aggregation and is kept only for
    digests that repeat; it is read back from a written table, so the join has an exchange on either side and
    adaptive execution can split a digest that a third of all records share. Each new archive is then written by
    a task that reads one old archive in order and the decisions for it, which are as many as that archive's records.
    """
    head = written(headers(files, uri), "headers")
    old = head.where("record_type = 'revisit'").select("file", "offset", F.col("refers_to_id").alias("first_id"))
    new = head.where("record_type = 'response'")
    key = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").cast(id_type).alias("page"), "record_id")
    first = (
        new.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("payload_digest", F.col("first.record_id").alias("first_id"))
    )
    first = written(first, "first")
    choice = (
        new.where(F.col("payload_bytes") >= least_bytes).select("file", "offset", "record_id", "payload_digest")
        .join(first, "payload_digest").where("record_id <> first_id").select("file", "offset", "first_id")
    )
    every = files.select("file", F.lit(-1).cast("long").alias("offset"), F.lit(None).cast("string").alias("first_id"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, revisits = key[0], {o: i for o, i in zip(pdf["offset"], pdf["first_id"], strict=True) if o >= 0}
        archive, n = Archive(to, name), 0
        try:
            for offset, _, data in members(uri, name):
                f, block = parse(data)
                size = int(f.get("x-payload-bytes") or len(payload_of(f, block)))
                digest = f.get("warc-payload-digest", "").rpartition(":")[2] or sha1_base32(payload_of(f, block))
                ours, first_id = f.get("warc-record-id", "").strip("<>"), revisits.get(offset)
                out = fields_of("revisit" if first_id else f.get("warc-type", "response"), ours, unquote(f.get("x-page-id", "")), f.get("warc-target-uri", ""), digest, size)
                if first_id:
                    out += [("WARC-Refers-To", f"<{first_id}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
                archive.add(record(out, block))
                n += 1
        except BaseException:
            archive.abort()
            raise
        archive.close()
        return pd.DataFrame({"file": [name], "records": [n]})

    # by number: the decisions are small, so adaptive execution would give all archives to one task
    tasks = max(1, min(files.count(), 4096))
    out = written(every.unionByName(old).unionByName(choice).repartition(tasks, "file").groupBy("file").applyInPandas(run, "file string, records long"), "deduplicated")
    forget(head, first)
    return out


def resolve(head: DataFrame, id_type: str = "long") -> DataFrame:
    """Per record: the page of its response; revisits are joined to their responses by record id."""
    revisits = head.where("record_type = 'revisit'")
    wanted = written(revisits.groupBy("refers_to_id").agg(F.count("*").alias("revisits")), "wanted")
    responses = (
        head.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
        .join(wanted, "refers_to_id", "left_semi")
    )
    responses = written(responses, "responses")
    own = ["page_id", "payload_bytes", "payload_digest", "record_type", "url"]
    out = head.where("record_type = 'response'").select(*own, F.lit(None).cast("string").alias("refers_to")).unionByName(
        revisits.join(responses, "refers_to_id", "left").select(*own, "refers_to")
    )
    return out.select(F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type), "url")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, final = new_path(spark, "raw"), new_path(spark, "final")
    files = write_pages(table(spark, sf_dir, "pages"), raw)
    out = deduplicate(spark, files, raw, final)
    return resolve(written(headers(out, final, verify=True), "read")).drop("url")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT *, array_to_string([lpad(bin(('0x' || substr(h, i, 1))::INTEGER), 4, '0') FOR i IN range(1, 41)], '') AS b FROM p
), d AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY html) AS first_id,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
      16 * substr(b, 5 * i + 1, 1)::INTEGER + 8 * substr(b, 5 * i + 2, 1)::INTEGER + 4 * substr(b, 5 * i + 3, 1)::INTEGER
      + 2 * substr(b, 5 * i + 4, 1)::INTEGER + substr(b, 5 * i + 5, 1)::INTEGER, 1) FOR i IN range(0, 32)], '') AS payload_digest
  FROM bits
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
