"""Web archives: WARC files, their two-level capture index, and range reads through it."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns
from pairloom.llm.common import arrow_batches, partitions
from pairloom.storage import materialize, new_path

#: Payloads shorter than this are never revisited.
REVISIT_BYTES = 100
#: Payload sizes up to which so many records share a file, so that none outgrows a task's memory.
FILE_CLASSES = ((64 << 10, 2000), (4 << 20, 32), (None, 1))
#: Captures of a compressed index block.
BLOCK_LINES = 3000

#: Fixed values of the formats: an empty gzip member, the revisit profile.
EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_ENTRY = "file string, offset long, length long"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(
    kind: str, record_id: int | None, url: str | None, payload: bytes, digest: str,
    refers_to: int | None,
) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP head and leaves the payload out."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if kind == "revisit" else head + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Target-URI", _clean(url or "")), ("WARC-Date", DATE),
        ("WARC-Record-ID", f"<urn:pages:{'' if record_id is None else record_id}>"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:pages:{refers_to}>")]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return gzip_member(f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _number(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:pages:").removesuffix(">")
    return int(digits) if digits else None


def members(data: bytes):
    """``(offset, length, content)`` of each gzip member that is not empty."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker, start, content = zlib.decompressobj(31), at, []
        while not unpacker.eof:
            window = view[at : at + 8192]
            if not len(window):
                raise ValueError("a gzip member is cut off")
            content.append(unpacker.decompress(window))
            at += len(window) - len(unpacker.unused_data)
        if any(content):
            yield start, at - start, b"".join(content)


def host_key(url: str | None) -> str:
    """The reversed host, then path and query: pages of a site, and sites of a domain, sort together."""
    url = _clean(url or "")
    try:
        parts = urlsplit(url.lower() if "://" not in url else url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    place = ",".join(reversed(host.split(".")))
    if port not in (None, 80, 443):
        place += f":{port}"
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def with_record_types(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``key, url, html, digest, kind, refers_to``.

    Digests are counted per task before they are shuffled; only those that recur are joined back.
    """
    need_columns(pages, key, url, html)
    payload = F.coalesce(named(html).cast("binary"), F.lit(b""))
    rows = pages.select(
        named(key).cast("long").alias("key"), named(url).cast("string").alias("url"),
        payload.alias("html"), F.sha2(payload, 256).alias("digest"),
    )
    again = materialize(
        rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(
            F.min("key").alias("refers_to"), F.count("*").alias("n")
        ).where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to"),
        "digests",
    )
    revisit = F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to"))
    return rows.join(again, "digest", "left").select(
        "key", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html"
) -> None:
    """Write a WARC record per row below ``folder``, each one a gzip member.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes, those with the least key are
    responses and the others revisit it. Spark writes the members as lines whose separator is an empty member, so the
    files are plain multi-member gzip. Large payloads go to files of fewer records.

    A null payload is empty; a null URL is an empty target; a null key is no key, and revisits where
    another row with the payload has one; repeated rows are written each; an empty table writes no record.
    """
    typed = with_record_types(pages, key, url, html)
    build = arrow_batches({"record": pa.binary()})

    def pack(batches):
        names = ("kind", "key", "url", "html", "digest", "refers_to")
        for batch in batches:
            yield build([
                record_bytes(*row) for row in zip(*(batch.column(n).to_pylist() for n in names))
            ])

    least = -1
    for most, count in FILE_CLASSES:
        size = F.octet_length("html")
        mine = typed.where(size > least if most is None else (size > least) & (size <= most))
        records = mine.mapInArrow(pack, "record binary")
        records.select(F.col("record").cast("string").alias("value")).write.option(
            "maxRecordsPerFile", count
        ).option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(
            f"{folder}/upto={most or 'any'}"
        )
        least = most


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.col("path").alias("file"), "content"
    )


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``host_key, file, offset, length`` of every record, from the archives."""
    build = arrow_batches({
        "host_key": pa.string(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64(),
    })

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                found = [
                    (host_key(parse_record(data)[0]["WARC-Target-URI"]), file, offset, length)
                    for offset, length, data in members(content.as_buffer())
                ]
                yield build(*(list(zip(*found)) or [[]] * 4))

    return _files(spark, folder).mapInArrow(scan, "host_key string, " + _ENTRY)


def build_index(captures: DataFrame) -> DataFrame:
    """The capture index: ``shard, block, first_key, last_key, lines (compressed)``.

    Captures are sorted by key over the shards, then cut into blocks of ``BLOCK_LINES`` lines. Without its
    lines the table is the sparse directory.
    """
    keys = ["host_key", "file", "offset"]
    ordered = captures.repartitionByRange(partitions(captures.sparkSession), *keys)
    ordered = ordered.sortWithinPartitions(*keys)
    build = arrow_batches({
        "shard": pa.int32(), "block": pa.int32(), "first_key": pa.string(), "last_key": pa.string(),
        "lines": pa.binary(),
    })

    def cut(batches):
        shard, number, lines = TaskContext.get().partitionId(), 0, []

        def close():
            text = "\n".join("\t".join(map(str, line)) for line in lines)
            return build([shard], [number], [lines[0][0]], [lines[-1][0]], [zlib.compress(text.encode())])

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("host_key", "file", "offset", "length"))
            for line in zip(*columns):
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    yield close()
                    number, lines = number + 1, []
        if lines:
            yield close()

    return ordered.mapInArrow(
        cut, "shard int, block int, first_key string, last_key string, lines binary"
    )


class IndexShard:
    """Blocks of one shard, opened on demand."""

    def __init__(self, blocks: list[tuple[str, str, bytes]]):
        self.first = [b[0] for b in blocks]
        self.last = [b[1] for b in blocks]
        self.packed = [b[2] for b in blocks]
        self.opened: tuple[int, list[str], list[list[str]]] = (-1, [], [])

    def open(self, at: int) -> tuple[list[str], list[list[str]]]:
        if self.opened[0] != at:
            lines = [x.split("\t") for x in zlib.decompress(self.packed[at]).decode().split("\n")]
            self.opened = (at, [x[0] for x in lines], lines)
        return self.opened[1:]

    def find(self, key: str):
        """``(file, offset, length)`` of all captures of the key: the directory's first block that can
        hold it, then on while blocks begin with it."""
        for at in range(bisect_left(self.last, key), len(self.first)):
            if self.first[at] > key:
                break
            keys, lines = self.open(at)
            for line in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                yield line[1], int(line[2]), int(line[3])


def look_up(index: DataFrame, urls: DataFrame) -> DataFrame:
    """``host_key, file, offset, length`` of all captures of the urls (one column), each key asked once.

    The shards' bounds, one pair per partition of the index, come to the driver. A key is sent to the shards
    that can hold it; there the directory is searched, then one block.
    """
    column = urls.columns[0]
    bounds = sorted(
        (row["shard"], row["low"], row["high"]) for row in index.groupBy("shard").agg(
            F.min("first_key").alias("low"), F.max("last_key").alias("high")
        ).collect()
    )
    shards, lows, highs = ([x[i] for x in bounds] for i in range(3))
    build = arrow_batches({"host_key": pa.string(), "shard": pa.int32()})

    def route(batches):
        for batch in batches:
            found = []
            for key in set(map(host_key, batch.column(0).to_pylist())):
                for at in range(bisect_left(highs, key), bisect_right(lows, key)):
                    found.append((key, shards[at]))
            yield build(*(list(zip(*found)) or [[]] * 2))

    asked = urls.select(named(column).cast("string")).distinct().mapInArrow(
        route, "host_key string, shard int"
    ).distinct()
    none = F.lit(None)
    rows = index.select(
        "shard", "block", "first_key", "last_key", "lines", none.cast("string").alias("host_key")
    ).unionByName(asked.select(
        "shard", none.cast("int").alias("block"), none.cast("string").alias("first_key"),
        none.cast("string").alias("last_key"), none.cast("binary").alias("lines"), "host_key",
    ))
    rows = rows.repartition(partitions(index.sparkSession), "shard").sortWithinPartitions(
        "shard", F.col("host_key").asc_nulls_first(), "block"
    )
    answer = arrow_batches({
        "host_key": pa.string(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64(),
    })

    def search(batches):
        current, blocks, shard = None, [], None
        names = ("shard", "first_key", "last_key", "lines", "host_key")
        for batch in batches:
            found = []
            for number, first, last, lines, key in zip(*(batch.column(n).to_pylist() for n in names)):
                if number != current:
                    current, blocks, shard = number, [], None
                if key is None:
                    blocks.append((first, last, lines))
                    continue
                shard = shard or IndexShard(blocks)
                found += [(key, *entry) for entry in shard.find(key)]
            if found:
                yield answer(*zip(*found))

    return rows.mapInArrow(search, "host_key string, " + _ENTRY)


def read_records(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """The records at the given places: ``page_id, kind, url, payload, digest, refers_to``.

    ``digest`` is the header's; a revisit has a null payload.
    """
    ranges = entries.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    build = arrow_batches({
        "page_id": pa.int64(), "kind": pa.string(), "url": pa.string(), "payload": pa.binary(),
        "digest": pa.string(), "refers_to": pa.int64(),
    })

    def read(batches):
        for batch in batches:
            for content, places in zip(batch.column("content"), batch.column("ranges").to_pylist()):
                data, rows = memoryview(content.as_buffer()), []
                for place in places:
                    start = place["offset"]
                    fields, payload = parse_record(
                        zlib.decompress(data[start : start + place["length"]], 31)
                    )
                    revisit = fields["WARC-Type"] == "revisit"
                    rows.append((
                        _number(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Target-URI"],
                        None if revisit else payload, fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                        _number(fields["WARC-Refers-To"]) if revisit else None,
                    ))
                    if len(rows) == 256:
                        yield build(*zip(*rows))
                        rows = []
                if rows:
                    yield build(*zip(*rows))

    return _files(spark, folder).join(ranges, "file").select("content", "ranges").mapInArrow(
        read, "page_id long, kind string, url string, payload binary, digest string, refers_to long"
    )


def archive_digests(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Write the pages, index the archives, look every URL up and read its records back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record. A response's size and
    digest come from the payload that was read, a revisit's from the response that it refers to.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    write_archives(pages, folder, key, url, html)
    index = materialize(build_index(read_captures(spark, folder)), "index")
    entries = look_up(index, pages.select(named(url)))
    records = materialize(
        read_records(spark, folder, entries).select(
            "page_id", "kind", F.octet_length("payload").cast("long").alias("bytes"),
            F.sha2("payload", 256).alias("read"), "digest", "refers_to",
        ),
        "records",
    )
    originals = records.where("kind = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("refers_to"), F.col("read").alias("digest"),
        F.col("bytes").alias("original_bytes"),
    ).distinct()
    return records.join(originals, ["refers_to", "digest"], "left").select(
        "page_id", F.coalesce("bytes", "original_bytes").alias("payload_bytes"),
        F.coalesce("read", "digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        "refers_to",
    )
