"""WARC archives with a two-level capture index.

Writing: each task writes its rows as WARC/1.1 records, one gzip member each,
to its own archives in the shared folder and returns an index line for each
record: reversed-host URL key, archive, offset, length.  Of records with equal
payloads of at least ``least_bytes`` only the one with the largest page id
carries the payload (``response``); the others are ``revisit`` records that
name it.  Smaller payloads are always written.

Index: the lines are range-sorted by key and cut into blocks of ``BLOCK_LINES``,
each one zlib-compressed.  A block file ends with the sparse directory of its
blocks (first key, offset, length), and one row for each block file says which
keys it holds and where its directory lies.  So what a searcher keeps is a row
for about two million captures; it bisects those rows, the file's directory and
the block, each read by range, and the records are read by range, too.  Block
files and archives roll over at ``ROLL_BYTES``.

Reading many: keys are sorted, so a task reads each directory once; the blocks
found are dealt to tasks and give lines; the lines are dealt by stretches of
archives and sorted, so a task reads archives from front to back.  A URL with
any number of captures is spread over its blocks.

Recovery: file names carry a random part for each attempt, and lines are
written as a table, so a repeated task writes new files and only the winning
attempt's lines count.

Cases: page ids are whole numbers (other kinds are cast to them); a null html is an empty payload, a null URL an empty one; a null id is
written empty, is never referred to, and its records are responses unless an id
refers them elsewhere; rows with equal id and payload are all responses if that
id is the largest (and share a record id); a very long payload is one record;
an empty table gives no archive and an empty index; other columns are never
read, whatever their names.  Folders have to be reachable from Python, by path or by
a pyarrow file system.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, work_dir

BLOCK_LINES = 256
ROLL_BYTES = 64 << 20
#: Up to so many digests of payloads that occur again (counted) go to the executors; beyond that payloads are shuffled once.
BROADCAST_DIGESTS = 300_000
#: Lines are dealt by stretches of an archive; a reading task gets about FETCH_BYTES, more where that made over FETCH_TASKS tasks.
STRETCH = 1 << 20
FETCH_BYTES = 4 << 20
FETCH_TASKS = 1024
DATE = "2024-01-01T00:00:00Z"

INDEX = "key string, page_id long, archive string, offset long, length long"
DIRECTORY = "first_key string, last_key string, block_file string, n_lines long, offset long, length long"
BLOCKS = "key string, block_file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def url_key(url: str) -> str:
    """Host labels reversed and comma-joined, then a bracket and the rest: org,example,www)/path?query."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return ")" + url
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + rest


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _clean(value: str) -> str:
    """A header value on one line; percent signs and line breaks are escaped."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record_bytes(page_id, url: str, payload: bytes, refers_to=None) -> bytes:
    """One gzip member with one record; with ``refers_to`` a revisit, without a payload of its own."""
    revisit = refers_to is not None
    digest = payload_digest(payload)
    own = f"<urn:uuid:{uuid.uuid4()}>" if revisit or page_id is None else _record_id(page_id, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else payload)
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    data = ("\r\n".join([*headers, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(member: bytes) -> dict:
    """The fields of ``RECORD``; a response's digest and length are of the payload as read, a revisit's as recorded."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = field["WARC-Type"] == "revisit"
    page = field["X-Page-Id"].strip()
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"payload of page {page} doesn't match its digest")
    return {
        "page_id": int(page) if page else None, "url": unquote_header(field["WARC-Target-URI"]), "record_type": field["WARC-Type"], "payload_bytes": int(field["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": digest, "refers_to": int(field["X-Refers-To-Page-Id"]) if revisit else None, "payload": None if revisit else payload,
    }


def unquote_header(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


class _Roller:
    """Appends members to archives of about ``ROLL_BYTES`` in a folder."""

    def __init__(self, folder: str, suffix: str, roll: int = ROLL_BYTES):
        self.fs, self.folder = _filesystem(folder)
        self.suffix, self.roll, self.out, self.at = suffix, roll, None, 0

    def append(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= self.roll:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _read_at(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


@dataclass(frozen=True)
class Archives:
    """Where the archives, the index lines (a table), the block files and the directory (a table) are."""

    root: str

    @property
    def warcs(self) -> str:
        return f"{self.root}/warc"

    @property
    def lines(self) -> str:
        return f"{self.root}/lines"

    @property
    def blocks(self) -> str:
        return f"{self.root}/blocks"

    @property
    def directory(self) -> str:
        return f"{self.root}/directory"


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, root: str | None = None) -> Archives:
    """Write archives and index of all rows."""
    spark = pages.sparkSession
    place = Archives(root or work_dir(spark, "warc"))
    for folder in (place.warcs, place.blocks):
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("hash", F.sha1(F.col("html").cast("binary")))
    # narrow: which payloads are shared, and who has the largest id
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("hash").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("hash", "first")
    shared = saved(shared, "shared-digests")
    own = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared, "hash", "left").select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")).alias("refers_to"))
    warcs = place.warcs

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Roller(warcs, ".warc.gz")
        try:
            for b in batches:
                lines = []
                for page, u, h, ref in zip(b["page_id"].astype("Int64"), b["url"], b["html"], b["refers_to"].astype("Int64")):
                    page, ref = (None if x is pd.NA else int(x) for x in (page, ref))
                    data = record_bytes(page, u, h.encode("utf-8"), ref)
                    name, at = out.append(data)
                    lines.append((_escaped(url_key(u)), page, name, at, len(data)))
                frame = pd.DataFrame(lines, columns=["key", "page_id", "archive", "offset", "length"])
                frame["page_id"] = frame["page_id"].astype("Int64")
                yield frame
        finally:
            out.close()

    own.mapInPandas(save, INDEX).write.parquet(place.lines)
    _index(spark.read.schema(INDEX).parquet(place.lines), place)
    return place


def _escaped(key: str) -> str:
    return key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


class _BlockFile:
    """A block file that is being written."""

    def __init__(self, folder: str):
        fs, path = _filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.cdx"
        self.out = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.at, self.n, self.entries, self.last = 0, 0, [], ""

    def add(self, block: list[tuple[str, str]]) -> None:
        data = zlib.compress("\n".join(line for _, line in block).encode())
        self.entries.append(f"{block[0][0]}\t{self.at}\t{len(data)}")
        self.last = block[-1][0]
        self.out.write(data)
        self.at += len(data)
        self.n += len(block)

    def close(self) -> pd.DataFrame:
        data = zlib.compress("\n".join(self.entries).encode())
        self.out.write(data)
        self.out.close()
        return pd.DataFrame([(self.entries[0].split("\t")[0], self.last, self.name, self.n, self.at, len(data))], columns=["first_key", "last_key", "block_file", "n_lines", "offset", "length"])


def _index(lines: DataFrame, place: Archives) -> None:
    blocks = place.blocks

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, held = None, []
        for b in batches:
            for key, page, archive, offset, length in zip(b["key"], b["page_id"].astype("Int64"), b["archive"], b["offset"], b["length"]):
                held.append((key, "\t".join((key, "" if page is pd.NA else str(page), archive, str(offset), str(length)))))
                if len(held) == BLOCK_LINES:
                    file = file or _BlockFile(blocks)
                    file.add(held)
                    held = []
                    if file.at >= ROLL_BYTES:
                        yield file.close()
                        file = None
        if held:
            file = file or _BlockFile(blocks)
            file.add(held)
        if file:
            yield file.close()

    # keys tie (one URL can have any number of captures), so the id takes part in the ranges
    lines.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInPandas(pack, DIRECTORY).write.parquet(place.directory)


class _Search:
    """Bisects block files, their directories and blocks; what was read last is kept, as keys come sorted."""

    def __init__(self, place: Archives, files: list[tuple[str, str, str, int, int]]):
        self.place, self.files = place, files
        self.first, self.last = [f[0] for f in files], [f[1] for f in files]
        self.directories: dict[str, tuple[list[str], list[tuple[int, int]]]] = {}

    def directory(self, name: str, offset: int, length: int) -> tuple[list[str], list[tuple[int, int]]]:
        if name not in self.directories:
            fs, path = _filesystem(self.place.blocks)
            rows = [x.split("\t") for x in zlib.decompress(_read_at(fs, f"{path}/{name}", offset, length)).decode().split("\n")]
            self.directories = {name: ([r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows])}
        return self.directories[name]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """The blocks that can hold the (escaped) key."""
        for _, _, name, offset, length in self.files[bisect.bisect_left(self.last, key) : bisect.bisect_right(self.first, key)]:
            keys, where = self.directory(name, offset, length)
            for at, size in where[max(bisect.bisect_left(keys, key) - 1, 0) : bisect.bisect_right(keys, key)]:
                yield name, at, size


def _files(spark, place: Archives) -> list[tuple[str, str, str, int, int]]:
    """One row for each block file (of ``ROLL_BYTES``), in the order of keys."""
    rows = spark.read.schema(DIRECTORY).parquet(place.directory).orderBy("first_key", "last_key", "block_file")
    return [tuple(r) for r in rows.select("first_key", "last_key", "block_file", "offset", "length").toPandas().itertuples(index=False)]


def _lines(data: bytes) -> list[tuple[str, int | None, str, int, int]]:
    rows = (x.split("\t") for x in zlib.decompress(data).decode().split("\n"))
    return [(key, int(page) if page else None, archive, int(offset), int(length)) for key, page, archive, offset, length in rows]


def _found_lines(spark, place: Archives, blocks: DataFrame) -> DataFrame:
    """The index lines with the blocks' keys (all lines of a block whose key is null)."""
    folder = place.blocks

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _filesystem(folder)
        now, lines, keys = None, [], []
        for b in batches:
            out = []
            for key, name, offset, length in zip(b["key"], b["block_file"], b["offset"], b["length"]):
                if (name, offset) != now:
                    now, lines = (name, offset), _lines(_read_at(fs, f"{path}/{name}", offset, length))
                    keys = [x[0] for x in lines]
                out += lines if key is None or key is pd.NA else lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            frame = pd.DataFrame(out, columns=["key", "page_id", "archive", "offset", "length"])
            frame["page_id"] = frame["page_id"].astype("Int64")
            yield frame

    dealt = blocks.repartition("block_file", "offset").sortWithinPartitions("block_file", "offset", "key")
    return saved(dealt.mapInPandas(search, INDEX), "found-lines")


def _fetched(place: Archives, lines: DataFrame, payloads: bool) -> DataFrame:
    """The records of index lines."""
    folder = place.warcs

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _filesystem(folder)
        name, file = None, None
        for b in batches:
            for lo in range(0, len(b), BLOCK_LINES):
                rows = []
                for archive, offset, length in zip(*(b[c].iloc[lo : lo + BLOCK_LINES] for c in ("archive", "offset", "length"))):
                    if archive != name:
                        if file is not None:
                            file.close()
                        name, file = archive, fs.open_input_file(f"{path}/{archive}")
                    file.seek(offset)
                    rows.append(parse_record(file.read(length)))
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
                frame["page_id"], frame["refers_to"] = frame["page_id"].astype("Int64"), frame["refers_to"].astype("Int64")
                if not payloads:
                    frame["payload"] = None
                yield frame
        if file is not None:
            file.close()

    size = lines.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-size // FETCH_BYTES), max(FETCH_TASKS, -(-size // (128 << 20)))))
    stretch = F.floor(F.col("offset") / STRETCH)
    return lines.repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset").mapInPandas(fetch, RECORD)


def lookup(spark, place: Archives, urls: DataFrame, url: str = "url", payloads: bool = True) -> DataFrame:
    """All records (``RECORD``) whose URL is among ``urls`` (a null URL is an empty one), each once however often it is asked for."""
    search = _Search(place, _files(spark, place))
    columns = [x.split()[0] for x in BLOCKS.split(", ")]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": [_escaped(url_key(u)) for u in b["u"]]})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key in b["key"]:
                for x in search.blocks(key):
                    rows.append((key, *x))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    asked = urls.select(F.coalesce(F.col(url), F.lit("")).alias("u")).distinct().mapInPandas(keys, "key string").distinct()
    found = asked.repartitionByRange("key").sortWithinPartitions("key").mapInPandas(blocks, BLOCKS)
    return _fetched(place, _found_lines(spark, place, found), payloads)


def read(spark, place: Archives, payloads: bool = True) -> DataFrame:
    """All records (``RECORD``), by way of the index: directories, blocks, archives."""

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b[["first_key", "last_key", "block_file", "offset", "length"]].itertuples(index=False):
                where = _Search(place, []).directory(*row[2:])[1]
                yield pd.DataFrame([(None, row[2], *x) for x in where], columns=["key", "block_file", "offset", "length"]).astype({"key": "string"})

    blocks = spark.read.schema(DIRECTORY).parquet(place.directory).mapInPandas(every, BLOCKS)
    return _fetched(place, _found_lines(spark, place, blocks), payloads)


class Index:
    """Lookups of single URLs from one machine."""

    def __init__(self, spark, place: Archives):
        self.search = _Search(place, _files(spark, place))
        self.fs, self.blocks = _filesystem(place.blocks)
        _, self.archives = _filesystem(place.warcs)

    def lookup(self, url: str) -> list[dict]:
        """Every record of the URL, by page id."""
        key, met = _escaped(url_key(url)), []
        for name, offset, length in self.search.blocks(key):
            lines = _lines(_read_at(self.fs, f"{self.blocks}/{name}", offset, length))
            keys = [x[0] for x in lines]
            met += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
        met.sort(key=lambda x: (x[1] is not None, x[1] or 0))
        return [parse_record(_read_at(self.fs, f"{self.archives}/{archive}", where, size)) for _, _, archive, where, size in met]
