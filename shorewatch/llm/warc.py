"""WARC archives with a two-level capture index.

Records are written as gzip members into archive files.  The index holds one line per capture, sorted by
reversed-host URL key and cut into compressed blocks; a sparse directory has the first key and the byte
range of each block.  A look-up searches the directory, reads one block by its range, searches the
block, and reads one record by its range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any, NamedTuple
from urllib.parse import quote, urlsplit
from uuid import uuid4

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorewatch.llm.common import materialize

#: Bytes after which an archive file is closed, capture lines per index block, archive files open for reading.
ARCHIVE_BYTES, BLOCK_LINES, OPEN_FILES = 1 << 30, 512, 32
#: The number of pages without id.
NO_ID = (1 << 63) - 1
#: Pages carry no time of capture, so every record has this one.
CAPTURED = "1970-01-01T00:00:00Z"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")


class Archive(NamedTuple):
    """A written archive: its folder, its capture lines' directory and the first key of each index file."""

    folder: str
    directory: DataFrame


def url_key(url: str | None) -> str:
    """Lower-cased host parts in reverse, then path and query; a URL that can't be split is its own key."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return quote(url or "", safe="/?&=:#%")
    tail = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~") + (f"?{quote(parts.query, safe='/?%&=+,;:@')}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){tail}" if host else quote(url or "", safe="/?&=:#%")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response, or one revisit that names the response with the same payload and holds no payload itself."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = quote(url, safe="/:?&=#%+,;@!$'()*~[]") if url else f"urn:x-page:{page}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{page}>",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:x-page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict[str, Any]:
    """A record's fields; payload is that of the record itself, so empty for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_LENGTH.search(http + b"\r\n").group(1))
    refers = fields.get("WARC-Refers-To")
    number = lambda uri: int(uri.strip("<>").rsplit(":", 1)[1])
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "record_type": fields["WARC-Type"],
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number(refers) if refers else None,
    }


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the folder's path there; the folder is made if it is missing."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return store, root


def archive_writer(folder: str, archive_bytes: int):
    """Writes the records of a partition; every attempt has files of its own, and only its index lines name them."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        out = name = None
        at = 0
        for batch in batches:
            lines = []
            for page, url, html, refers in zip(batch["page"], batch["url"], batch["html"], batch["refers"], strict=True):
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                url = url if isinstance(url, str) else None
                member = gzip.compress(record(int(page), url, payload, None if pd.isna(refers) else int(refers)), 5, mtime=0)
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                lines.append((url_key(url), int(page), name, at, len(member)))
                at += len(member)
            yield pd.DataFrame(lines, columns=["key", "page", "file", "at", "length"])
        if out is not None:
            out.close()

    return write


def index_writer(folder: str, block_lines: int):
    """Writes a partition of sorted capture lines as compressed blocks, and yields a directory row for each block."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        name, out, at, block, rows = f"{uuid4().hex}.idx.gz", None, 0, [], []

        def close_block():
            nonlocal out, at
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            packed = gzip.compress("\n".join(map(json.dumps, block)).encode(), 6, mtime=0)
            out.write(packed)
            rows.append((block[0][0], block[0][1], name, at, len(packed)))
            at += len(packed)
            block.clear()

        for batch in batches:
            for line in zip(batch["key"], batch["page"], batch["file"], batch["at"], batch["length"], strict=True):
                block.append((line[0], int(line[1]), line[2], int(line[3]), int(line[4])))
                if len(block) == block_lines:
                    close_block()
            yield pd.DataFrame(rows, columns=["key", "page", "file", "at", "length"])
            rows.clear()
        if block:
            close_block()
        if out is not None:
            out.close()
        yield pd.DataFrame(rows, columns=["key", "page", "file", "at", "length"])

    return write


def first_of_equal(pages: DataFrame, digest: Column, size: Column, min_bytes: int) -> DataFrame:
    """Digests of payloads that more than one page has, with the smallest of their pages; written, so that a
    join with it can split a digest of any number of pages."""
    counted = pages.where(size >= min_bytes).groupBy(digest.alias("digest")).agg(F.min("page").alias("first"), F.count("*").alias("n"))
    return materialize(counted.where("n > 1").select("digest", "first"), "equal")


def write_archive(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    block_lines: int = BLOCK_LINES,
) -> Archive:
    """Archives and index of all pages below a shared folder.

    Of pages with equal payloads of at least ``min_bytes`` that of the smallest id is a response and the
    others are revisits of it.  A null html is an empty payload.  A null URL gets a name from the page's
    id.  Rows that repeat an id are records of their own.  Rows without id are records under a number of
    their own, the greatest there is; nothing can refer to them, so each is a response unless a row with an id
    has its payload.  Of an empty table there are no records; other columns are ignored.
    """
    page = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = page.withColumn("digest", F.sha2(payload, 256))
    equal = first_of_equal(page, F.col("digest"), F.octet_length(payload), min_bytes)
    marked = page.join(equal, "digest", "left").select(
        "page", "url", "html", F.when(F.col("first") < F.col("page"), F.col("first")).alias("refers")
    )
    lines = materialize(
        marked.mapInPandas(archive_writer(folder, archive_bytes), "key string, page long, file string, at long, length long"),
        "lines",
    )
    # Keys are ranged together with the page, so that a URL of very many captures spans partitions too.
    order = ["key", "page"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order, "file", "at")
    directory = ranged.mapInPandas(
        index_writer(folder, block_lines), "key string, page long, file string, at long, length long"
    )
    return Archive(folder, materialize(directory, "directory"))


class RangeReader:
    """Byte ranges of files, with the files used last kept open."""

    def __init__(self, folder: str, limit: int = OPEN_FILES):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.limit, self.open = limit, OrderedDict()

    def read(self, name: str, at: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) == self.limit:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.store.open_input_file(f"{self.root}/{name}")
        self.open.move_to_end(name)
        return self.open[name].read_at(length, at)


def reader(folder: str):
    """Answers look-ups that come sorted, each behind the directory of the index file that covers it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, directory, current, block = RangeReader(folder), [], None, []
        for batch in batches:
            found = []
            for name, key, page, blocks in zip(batch["file"], batch["key"], batch["page"], batch["blocks"], strict=True):
                if blocks is not None:
                    directory = sorted((b["key"], b["page"], b["at"], b["length"]) for b in blocks)
                    current = None
                    continue
                want = (key, int(page))
                # The last block that begins before the key, then on while blocks begin with it.
                n = max(0, bisect_left(directory, want, key=lambda b: b[:2]) - 1)
                while n < len(directory) and directory[n][:2] <= want:
                    if current != (name, n):
                        raw = gzip.decompress(files.read(name, *directory[n][2:]))
                        block, current = [json.loads(x) for x in raw.decode().split("\n")], (name, n)
                    for line in block[bisect_left(block, want, key=lambda x: (x[0], x[1])) :]:
                        if (line[0], line[1]) != want:
                            break
                        found.append(parse(gzip.decompress(files.read(*line[2:]))))
                    n += 1
            out = pd.DataFrame(
                found, columns=["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )
            out["refers_to"] = out["refers_to"].astype("Int64")
            yield out

    return read


def read_archive(archive: Archive, wanted: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Records of the wanted (URL, page id) pairs, found through the index.

    Returns page_id, payload, payload_bytes, payload_digest, record_type and refers_to as the records
    state them.  Records are looked up once for each page and key of a URL, so rows that repeat an id with one key
    get as many records as were written.  What the archive does not hold gives no row; rows without id get theirs,
    with a null page_id.
    """
    files = archive.directory.groupBy("file").agg(F.min(F.struct("key", "page")).alias("first"))
    # One entry for each index file, so as many as the index has partitions.
    starts = sorted(((r["first"]["key"], r["first"]["page"]), r["file"]) for r in files.collect())
    firsts, names = [s for s, _ in starts], [n for _, n in starts]
    spark = archive.directory.sparkSession

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [url_key(u if isinstance(u, str) else None) for u in batch["url"]]
            at = [max(0, bisect_right(firsts, (k, p)) - 1) for k, p in zip(keys, batch["page"], strict=True)]
            yield pd.DataFrame({"file": [names[i] for i in at], "key": keys, "page": batch["page"]})

    schema = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not names:
        return spark.createDataFrame([], schema)
    asked = wanted.select(F.col(url_col).alias("url"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("page"))
    # Different URLs of a page can have one key; those are one look-up.
    look_ups = asked.distinct().mapInPandas(place, "file string, key string, page long").distinct()
    # A directory travels as the first row of its file's look-ups; it is sparse and as long as one partition's index.
    heads = archive.directory.groupBy("file").agg(
        F.collect_list(F.struct("key", "page", "at", "length")).alias("blocks")
    )
    # No page is null there: a column of numbers and nulls would come to the task as doubles.
    rows = heads.select("file", F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("page"), "blocks")
    rows = rows.unionByName(look_ups, allowMissingColumns=True)
    sorted_rows = rows.repartition("file").sortWithinPartitions("file", F.col("key").asc_nulls_first(), "page")
    found = sorted_rows.mapInPandas(reader(archive.folder), schema)
    return found.withColumn("page_id", F.when(F.col("page_id") != NO_ID, F.col("page_id")))


__all__ = ["Archive", "parse", "read_archive", "record", "url_key", "write_archive"]
