"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing: each task writes one archive of gzipped records to the shared folder,
under a name of its own attempt, and returns an index row (archive, offset,
length, url, digest and the record's fields) for each record. The index is
committed as Parquet; it names only archives of tasks that ended well, so files
of lost attempts are never read.

Reading: index rows are dealt out by archive and block of bytes, sorted by
offset, and neighbours closer than a gap are read in one range. Files are
opened through pyarrow's file systems, so the shared folder may be local,
HDFS or an object store.

Of records with equal payloads of at least `min_bytes` bytes, that with the
smallest page id is a response and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import shuffle_partitions, staged, workspace

INDEX = "page_id long, url string, archive string, offset long, length long, record_type string, refers_to long, payload_bytes long, payload_digest string"
PAGE = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed name space of URLs
DATE = "1970-01-01T00:00:00Z"  # a fixed date keeps archives reproducible
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def record(page_id, url: str, payload: bytes, kind: str, refers, digest: str) -> bytes:
    """One WARC/1.1 record; the block is an HTTP response, without its payload in a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)), ("X-Page-Id", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", len(payload))]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers)), ("X-Refers-To-Page", "" if refers is None else refers)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and HTTP payload of one record; a damaged record is a ValueError."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields.get("Content-Length", -1))
    if not first.startswith("WARC/") or not mark or len(rest) != size + 4:
        raise ValueError(f"not a whole WARC record: {first[:40]!r}")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archives of pages(page_id, url, html) below `folder`; returns their index.

    A null html or url counts as empty. A null page_id is larger than any other;
    where all copies have none, one of them is the response. Of rows that repeat
    page_id and payload, one is the response and the rest revisit it. Other
    columns are left behind. The html is shuffled once, by page_id and digest;
    which page comes first is found on digests alone. No pages give no archives and an
    empty index; a payload may have any length.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("hex", F.sha1("html"))
    ids = rows.select("page_id", "hex", F.length("html").alias("size"))
    first = ids.where(F.col("size") >= min_bytes).groupBy("hex").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # A null id loses to any other; only repeated payloads are joined.
    heads = ids.distinct().join(first, "hex").select(F.coalesce("page_id", F.lit(-1)).alias("key"), F.col("page_id").isNull().alias("no_id"), "hex", "first_id")
    rows = rows.withColumns({"key": F.coalesce("page_id", F.lit(-1)), "no_id": F.col("page_id").isNull()})
    placed = rows.join(heads.withColumn("shared", F.lit(True)), ["key", "no_id", "hex"], "left")
    nth = Window.partitionBy("key", "no_id", "hex").orderBy("url")
    placed = placed.withColumn("nth", F.row_number().over(nth))
    own = F.col("first_id").eqNullSafe(F.col("page_id")) & (F.col("nth") == 1)
    # Ids travel as text: pandas would make a column of whole numbers with a null one of floats.
    placed = placed.select(F.col("page_id").cast("string"), "url", "html", "hex", F.when(F.col("shared") & ~own, "revisit").otherwise("response").alias("record_type"), F.when(F.col("shared") & ~own, F.col("first_id")).cast("string").alias("refers_to"))

    def run(frames):
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        name, out, at = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        for frame in frames:
            rows = []
            for page_id, url, html, hexed, kind, refers in frame.itertuples(index=False, name=None):
                page_id, refers = (None if x is None else int(x) for x in (page_id, refers))
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                made = zlib.compressobj(3, zlib.DEFLATED, 31)
                packed = made.compress(record(page_id, url, html, kind, refers, digest)) + made.flush()
                if out is None:
                    out = files.open_output_stream(name, compression=None)
                out.write(packed)
                rows.append((page_id, url, name, at, len(packed), kind, refers, len(html), digest))
                at += len(packed)
            got = pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])
            yield got.astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()

    return staged(placed.mapInPandas(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, gap: int = 65_536, block: int = 8 << 20, most: int = 4 << 20) -> DataFrame:
    """The pages of the selected index rows, in the columns of PAGE.

    Rows are dealt out by archive and block of offsets, to as many tasks as their bytes
    need, and sorted; ranges at most `gap` bytes apart are read at once, up to `most` bytes a read. Payloads are held against their digests;
    a damaged record stops the task. A revisit's payload is empty here: its
    bytes are those of the record it refers to.
    """
    keyed = index.select("archive", "offset", "length").withColumn("block", F.floor(F.col("offset") / block))
    size = index.agg(F.sum("length")).first()[0] or 0  # the index is small and written already
    parts = max(shuffle_partitions(index.sparkSession), -(-size // block))
    keyed = keyed.repartition(parts, "archive", "block").sortWithinPartitions("archive", "offset")

    def spans(frames):
        held: list[tuple[str, int, int]] = []
        for frame in frames:
            for item in frame[["archive", "offset", "length"]].itertuples(index=False, name=None):
                if held and (item[0] != held[-1][0] or item[1] - held[-1][1] - held[-1][2] > gap or item[1] + item[2] - held[0][1] > most):
                    yield held
                    held = []
                held.append(item)
        if held:
            yield held

    def run(frames):
        files = _files(folder)[0]
        opened, name = None, None
        for span in spans(frames):
            if span[0][0] != name:
                name = span[0][0]
                opened = files.open_input_file(name)
            start = span[0][1]
            held = opened.read_at(max(o + n for _, o, n in span) - start, start)
            rows = []
            for _, offset, length in span:
                fields, payload = parse(zlib.decompress(held[offset - start : offset - start + length], 31))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {name} at {offset} does not match its digest")
                rows.append((int(x) if (x := fields["X-Page-Id"]) else None, fields["WARC-Target-URI"], payload, int(fields["X-Payload-Bytes"]), digest, kind, int(x) if (x := fields.get("X-Refers-To-Page")) else None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAGE.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return keyed.mapInPandas(run, PAGE)


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes archives and reads every record back; the columns of PAGE."""
    folder = folder or workspace(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives."""
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
b AS (SELECT *, CAST('0x' || hex[1:10] AS BIGINT) AS b1, CAST('0x' || hex[11:20] AS BIGINT) AS b2, CAST('0x' || hex[21:30] AS BIGINT) AS b3, CAST('0x' || hex[31:40] AS BIGINT) AS b4 FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform([b1, b2, b3, b4], lambda b: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((b >> s) & 31) + 1]), '')), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
