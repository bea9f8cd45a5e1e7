"""WARC archives of pages, with a two-level capture index.

A record is a gzip member of its own, so that it can be read by its range. Each
write task makes archives of its own; what it reports (key, archive, offset,
length) is sorted by reversed-host URL key over the cluster, and each range of
keys becomes one index part: lines in compressed blocks, and a sparse directory
of the blocks' first keys beside them. A lookup finds the part among the parts'
bounds, the block in the part's directory and the line in the block, each by
binary search, and then reads ranges of archives. What a task or the driver holds
is one part's directory, one block, and the bounds of all parts (a row for each
partition of the sort).

Files go to the folder ``spark.checkpoint.dir`` through Arrow's file systems
(local or mounted paths, hdfs, s3, gcs). Names are random, so a task that is run
again writes other files, and only those that a finished task has reported are
in the index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import shared_folder
from .common import cut, small, table, whole
from .encode import tidy

#: Bytes after which a task begins another archive, lines of an index block, bytes that one read of an archive covers at most, and gaps that it bridges.
ARCHIVE_BYTES, BLOCK_LINES, READ_BYTES, GAP_BYTES = 1 << 30, 2048, 4 << 20, 64 << 10
#: Payloads of fewer bytes are kept in each record.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
LEVEL = 5
#: What stays as it is in a URL; blanks, controls and all that isn't ASCII are percent-encoded.
_PRINTED = "".join(map(chr, range(0x21, 0x7F)))
CAPTURE_NAMES = ["key", "page", "archive", "offset", "length"]
CAPTURE = "key string, page string, archive string, offset long, length long"
#: Stands for a null page_id in the index; others are percent-encoded.
NO_PAGE = "%"


def capture_key(url: str | None) -> str:
    """``https://a.Example.com:80/x?y#z`` is ``com,example,a:80)/x?y``; a url without ``://`` is taken as a path, null as an empty one."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        scheme, rest = "", "/" + scheme
    rest = rest.partition("#")[0]
    at = min([i for i in map(rest.find, "/?") if i >= 0], default=len(rest))
    host, _, port = rest[:at].lower().partition(":")
    turned = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return quote(f"{turned}){rest[at:] or '/'}", safe=_PRINTED)


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record; fields without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("ascii") + block + b"\r\n\r\n"


def _record_id(page: str | None, kind: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {kind} {digest}')}>"


def page_record(page: str | None, url: str | None, payload: bytes, digest: str, refers: str | None, refers_url: str | None) -> bytes:
    """A response, or a revisit of the response of ``refers``: its block then ends with the HTTP header. ``page`` and ``refers`` are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    target = quote(url, safe=_PRINTED) if url is not None else None
    fields: list[tuple[str, str | None]] = [
        ("WARC-Record-ID", _record_id(page, "response" if refers is None else "revisit", digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha-256:{digest}"), ("WARC-Page-ID", page),
    ]
    if refers is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers, "response", digest)), ("WARC-Refers-To-Page-ID", refers),
            ("WARC-Refers-To-Target-URI", quote(refers_url, safe=_PRINTED) if refers_url is not None else None), ("WARC-Refers-To-Date", DATE),
        ]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return _record("response" if refers is None else "revisit", fields, http + (payload if refers is None else b""))


class Record(NamedTuple):
    kind: str
    fields: dict[str, str]  # names in lower case
    http: dict[str, str]
    payload: bytes


def parse_record(data: bytes) -> Record:
    """A record of its bytes, decompressed; an error if it isn't whole."""
    head, _, rest = data.partition(b"\r\n\r\n")

    def fields(text: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode("ascii").split("\r\n")[1:])}

    own = fields(head)
    n = int(own["content-length"])
    if not head.startswith(b"WARC/1.") or len(rest) != n + 4:
        raise ValueError("a damaged WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n") if own.get("content-type", "").startswith("application/http") else (b"", b"", rest[:n])
    return Record(own["warc-type"], own, fields(http), payload)


def judged(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page, url, payload, digest, refers, refers_url: of equal payloads of ``least`` bytes or more, those with the smallest page_id are responses, others refer to it."""
    payload = whole("html").cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    same = p.where(F.octet_length("payload") >= least).groupBy(F.unhex("digest").alias("d"))
    many = same.agg(F.min("page_id").alias("first"), F.min_by("url", F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first_url"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # Written first, so that it is broadcast if it is small, and a payload with very many copies can be split if it isn't.
    first = small(cut(many.select(F.lower(F.hex("d")).alias("digest"), "first", "first_url")), F.lit(120) + F.coalesce(F.octet_length("first_url"), F.lit(0)))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(first, "digest", "left").select(
        F.col("page_id").cast("string").alias("page"), "url", "payload", "digest", F.when(other, F.col("first").cast("string")).alias("refers"), F.when(other, F.col("first_url")).alias("refers_url")
    )


class Archive(NamedTuple):
    """Archives in ``folder`` and their index; ``parts`` has (first key, last key, name) in order."""

    folder: str
    parts: list[tuple[str, str, str]]
    captures: int

    def lookup(self, urls: DataFrame) -> DataFrame:
        """key, page, archive, offset, length of all captures of the urls in the one column of ``urls``; repeats and nulls are fine."""
        folder, parts = self.folder, self.parts
        firsts, lasts = [p[0] for p in parts], [p[1] for p in parts]

        def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(p, key) for key in {capture_key(u) for u in batch.column(0).to_pylist()} for p in range(bisect_left(lasts, key), bisect_right(firsts, key))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], ["part", "key"])

        def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _files(folder)
            part, index = -1, None
            for batch in batches:
                lines: list[list[str]] = []
                for p, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if p != part:
                        part, index = p, _Index(fs, f"{root}/{parts[p][2]}")
                    lines += index.find(key)
                columns = [[x[i] for x in lines] for i in range(5)]
                columns[1] = [None if x == NO_PAGE else unquote(x) for x in columns[1]]
                yield pa.RecordBatch.from_arrays([pa.array([*map(int, c)], pa.int64()) if i > 2 else pa.array(c, pa.string()) for i, c in enumerate(columns)], CAPTURE_NAMES)

        wanted = urls.mapInArrow(parts_of, "part int, key string").distinct()
        return wanted.repartition("part").sortWithinPartitions("part", "key").mapInArrow(captures, CAPTURE)

    def records(self, captures: DataFrame, payloads: bool = True) -> DataFrame:
        """page, url, record_type, payload, payload_bytes, payload_digest, refers_to, intact of the records at ``captures``, read by ranges.

        ``payload`` is null for revisits, and for all where it isn't asked for.
        ``payload_digest`` is that of the bytes read, for revisits that of the
        record; ``intact`` tells whether the bytes and the record agree.
        """
        folder = self.folder
        fields = "page string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, intact boolean"

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _files(folder)
            names = [x.split()[0] for x in fields.split(", ")]
            types = [pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.bool_() if n == "intact" else pa.string() for n in names]

            def packed(rows: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

            for batch in batches:
                places = [*zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
                rows, held = [], 0
                for data in _ranges(fs, root, places):
                    r = parse_record(zlib.decompress(data, 31))
                    said = r.fields["warc-payload-digest"].removeprefix("sha-256:")
                    revisit = r.kind == "revisit"
                    digest = said if revisit else hashlib.sha256(r.payload).hexdigest()
                    n = int(r.http["content-length"])
                    page, refers, url = r.fields.get("warc-page-id"), r.fields.get("warc-refers-to-page-id"), r.fields.get("warc-target-uri")
                    rows.append((page and unquote(page), url, r.kind, r.payload if payloads and not revisit else None, n, digest, refers and unquote(refers), digest == said and (revisit or n == len(r.payload))))
                    held += len(r.payload) if payloads else 0
                    if held > READ_BYTES:
                        yield packed(rows)
                        rows, held = [], 0
                yield packed(rows)

        return captures.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(tidy(read), fields)


class _Index:
    """One index part: the directory is held, and the block last read."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str) -> None:
        with fs.open_input_stream(f"{path}.idx") as f:
            directory = [x.split(" ") for x in f.read().decode("ascii").splitlines()]
        self.firsts = [x[0] for x in directory]
        self.places = [(int(x[1]), int(x[2])) for x in directory]
        self.file, self.block, self.keys, self.lines = fs.open_input_file(f"{path}.cdx.gz"), -1, [], []

    def find(self, key: str) -> Iterator[list[str]]:
        """The lines of a key; it may go on over several blocks."""
        for block in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            if block != self.block:
                offset, length = self.places[block]
                self.lines = [x.split(" ") for x in zlib.decompress(self.file.read_at(length, offset), 31).decode("ascii").splitlines()]
                self.block, self.keys = block, [x[0] for x in self.lines]
            yield from self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]


def _ranges(fs: pyarrow.fs.FileSystem, root: str, places: list[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes of each (archive, offset, length), in order; neighbours are read together."""
    i, name, file = 0, None, None
    while i < len(places):
        archive, start, length = places[i]
        if archive != name:
            name, file = archive, fs.open_input_file(f"{root}/{archive}")
        j, end = i + 1, start + length
        while j < len(places) and places[j][0] == archive and start <= places[j][1] <= end + GAP_BYTES and places[j][1] + places[j][2] - start <= READ_BYTES:
            end = max(end, places[j][1] + places[j][2])
            j += 1
        data = file.read_at(end - start, start)
        for _, offset, n in places[i:j]:
            yield data[offset - start : offset - start + n]
        i = j


def _write_records(rows: DataFrame, folder: str, archive_bytes: int) -> DataFrame:
    """``rows`` of ``judged`` written as archives; their captures."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                found: list[tuple] = []
                for i in range(batch.num_rows):
                    page, url, payload, digest, refers, refers_url = (c[i].as_py() for c in batch.columns)
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        info = _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        at += out.write(_member(info))
                    code = lambda x: quote(x, safe="") if x is not None else None
                    n = out.write(_member(page_record(code(page), url, payload, digest, code(refers), refers_url)))
                    found.append((capture_key(url), NO_PAGE if page is None else code(page), name, at, n))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64() if i > 2 else pa.string()) for i in range(5)], CAPTURE_NAMES)
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(tidy(write), CAPTURE)


def _write_index(captures: DataFrame, folder: str, block_lines: int) -> DataFrame:
    """The captures sorted over the cluster; each range of keys written as one part. (first, last, part, captures) of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        part, data, at, total, directory, lines = uuid.uuid4().hex, None, 0, 0, [], []

        def block() -> None:
            nonlocal at
            n = data.write(_member("".join(lines).encode("ascii")))
            directory.append(f"{lines[0].partition(' ')[0]} {at} {n}\n")
            at += n

        last = ""
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = data or fs.open_output_stream(f"{root}/{part}.cdx.gz", compression=None)
                lines.append(" ".join(map(str, row)) + "\n")
                last, total = row[0], total + 1
                if len(lines) >= block_lines:
                    block()
                    lines = []
        if total:
            if lines:
                block()
            data.close()
            with fs.open_output_stream(f"{root}/{part}.idx") as f:
                f.write("".join(directory).encode("ascii"))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].partition(" ")[0]]), pa.array([last]), pa.array([part]), pa.array([total])], ["first", "last", "part", "captures"])

    order = ["key", "page", "archive", "offset"]
    return captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(write), "first string, last string, part string, captures long")


def write_warc(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """``pages`` (page_id, url, html; other columns play no part) written as WARC archives, with their index, to ``folder`` (by default a new one in ``spark.checkpoint.dir``).

    A null html is an empty payload. Of equal payloads of ``least`` bytes or more
    the one with the smallest page_id is a response and others are revisits of it;
    rows that tie (repeated with id and payload) are responses both. Rows without
    an id revisit those with one, and are all responses where none has. Any text may be
    a url; a null one is the key of an empty path. Texts are written whole. An
    empty table gives an archive without captures.
    """
    folder = folder or shared_folder(pages.sparkSession)
    fs, root = _files(folder)
    fs.create_dir(root)
    captures = cut(_write_records(judged(pages, least), folder, archive_bytes))
    parts = cut(_write_index(captures, folder, block_lines)).orderBy("first", "last").collect()  # a row for each partition of the sort
    return Archive(folder, [(p["first"], p["last"], p["part"]) for p in parts], sum(p["captures"] for p in parts))


def query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """A row for each page, read back from the archives through the index by the pages' urls."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = write_warc(pages)
    read = archive.records(archive.lookup(pages.select("url")), payloads=False)
    kind = pages.schema["page_id"].dataType
    return read.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to, TRUE AS intact
FROM q
"""
