"""WARC archives with revisit records, and a two-level capture index over them.

Writing: one response record for each distinct payload, revisit records for its copies, each a gzip member of its
own. Spark's text sink writes them, so any file system Spark writes to will do and its committer deals with lost
tasks. The sink wants a separator after each record: it is the zero byte that ends a gzip member of less than 16 MiB
(the top byte of its length); larger ones are followed by an empty member, which ends in zero too.

Index: captures sorted by reversed-host URL key, cut into blocks that are gzip members of plain files as well; the
sparse directory has the first and last key and the byte range of each block. Lookups binary-search the directory,
read the byte ranges of the blocks that may hold their keys, binary-search those, and read the records' byte ranges.
Byte ranges are read by pyarrow's file systems, which know local paths, HDFS and the common object stores. A single
lookup takes from the directory only the rows that may hold its key. Many lookups run as tasks, with BLOCKS_AT_ONCE
directory entries at a time, each block being read by one task for all keys that it may hold.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotloom.llm.common import BROADCAST_ROWS, new_path, quoted, small_batches, text_or_empty, written

CRLF = "\r\n"
END = CRLF * 2
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures in an index block; directory entries that tasks of lookups hold at once.
BLOCK_LINES, BLOCKS_AT_ONCE = 1000, 1 << 16
#: Byte ranges of a file that lie so near to each other are read at once, up to so many bytes.
NEAR, READ = 1 << 16, 8 << 20

RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32(digest: Column) -> Column:
    """A SHA-1 digest in hexadecimal as upper-case base 32: five digits of eight bits are eight of five."""
    digits = []
    for i in range(4):
        group = F.conv(F.substring(digest, 10 * i + 1, 10), 16, 10).cast("long")
        for shift in range(35, -1, -5):
            digits.append(F.substring(F.lit(ALPHABET), F.shiftright(group, shift).bitwiseAND(31).cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field that is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF)), F.lit("")) for k, v in fields])


def _clean(url: Column) -> Column:
    """Control characters would end a header line."""
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "_")


def write_archives(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
    min_bytes: int = 0,
) -> None:
    """Writes a WARC/1.1 record for each row of df into archives below path.

    The payload is the text in UTF-8, null being empty. Of equal payloads of min_bytes bytes or more the row with the
    largest id becomes the response and the others revisits of it; smaller payloads are all responses. Rows without
    id write no id; they are responses only if no row with an id has the payload. A row that repeats the response's
    id and payload is a response too. Control characters and spaces of a URL become underscores; a null URL is left out.
    """
    id_, url, text = F.col(quoted(id_col)).cast("long"), F.col(quoted(url_col)).cast("string"), text_or_empty(quoted(text_col))
    pages = df.select(id_.alias("id"), _clean(url).alias("url"), text.alias("text")).withColumns(
        {"bytes": F.octet_length("text").cast("long"), "sha": F.sha1(F.col("text").cast("binary"))}
    )
    groups = (
        pages.where(F.col("bytes") >= min_bytes)
        .groupBy("sha")
        .agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    groups = written(groups, "repeated")
    # payloads are shuffled only if very many are repeated
    rows = pages.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "sha", "left").withColumn("digest", base32(F.col("sha")))
    revisit = (F.col("bytes") >= min_bytes) & F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
    )
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit("page:"), c.cast("string")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    content = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("text")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header(
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.lit("<urn:lotloom:page-without-id>"))),
            ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(revisit, urn(F.col("last")))),
            ("X-Page-Id", F.col("id")),
            ("X-Payload-Length", F.when(revisit, F.col("bytes"))),
            ("X-Refers-To-Page-Id", F.when(revisit, F.col("last"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(content)),
        ),
        F.lit(CRLF),
        content,
        F.lit(END),
    )
    small_batches(df.sparkSession)
    packed = rows.select(record.cast("binary").alias("value")).mapInArrow(_gzip, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


def member(record: bytes) -> bytes:
    """A record as a gzip member, or as one and an empty one, so that the last byte is zero."""

    def gzip(data: bytes) -> bytes:
        c = zlib.compressobj(6, wbits=31)
        return c.compress(data) + c.flush()

    out = gzip(record)
    return out if out[-1] == 0 else out + gzip(b"")


def _gzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"value": pa.array([member(r)[:-1] for r in batch.column(0).to_pylist()], pa.binary())})


def members(content: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and data of each gzip member; an empty member is counted to the one before."""
    view, at, held = memoryview(content), 0, None
    while at < len(view):
        d, parts, to = zlib.decompressobj(wbits=31), [], at
        while not d.eof:
            if to >= len(view):
                raise ValueError(f"the member at byte {at} has no end")
            parts.append(d.decompress(view[to : to + step]))
            to += min(step, len(view) - to)
        to -= len(d.unused_data)
        data = b"".join(parts)
        if data or held is None:
            if held:
                yield held
            held = (at, to - at, data)
        else:
            held = (held[0], to - held[0], held[2])
        at = to
    if held:
        yield held


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields (lower-case names) and payload of each record of an archive."""
    for at, size, record in members(content):
        head_end = record.index(b"\r\n\r\n") + 4
        lines = record[:head_end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}
        end = head_end + int(head["content-length"])
        if record[end:] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it should")
        body = record[head_end:end]
        yield at, size, head, body[body.index(b"\r\n\r\n") + 4 :]


def _row(archive: str, offset: int, length: int, head: dict[str, str], payload: bytes, with_payload: bool = False) -> tuple:
    """The fields of RECORDS; an error if a response's payload does not have the digest its header names."""
    kind, told, size = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), len(payload)
    if kind == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != told:
            raise ValueError(f"{archive}, byte {offset}: the payload does not have its digest")
    else:
        size = int(head["x-payload-length"])
    number = lambda k: int(head[k]) if k in head else None
    return number("x-page-id"), head.get("warc-target-uri"), kind, told, size, number("x-refers-to-page-id"), archive, offset, length, payload if with_payload else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record below path, with the fields of RECORDS; payload is null unless asked for.

    Raises an error if a response's payload does not have the digest or length its header names. A revisit's
    payload_bytes is what its own header names: the length of the payload it refers to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py(), []
                for offset, length, head, payload in parse(batch.column(1)[i].as_py()):
                    rows.append(_row(name, offset, length, head, payload, with_payload))
                    if len(rows) >= 5000 or with_payload and len(rows) >= 200:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())]) for c, f in zip(zip(*rows, strict=True), RECORDS, strict=True)],
        names=RECORDS.names,
    )


# --- index ---


def url_key(url: str) -> str:
    """Reversed-host key: https://www.Example.net:80/a?b -> net,example)/a?b. A null URL has the key of an empty one."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    host = re.sub(r"^www\d*\.", "", m[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def _keys(url: Column) -> Column:
    @F.pandas_udf("string")
    def keys(urls):
        return urls.map(url_key)

    return keys(F.coalesce(url, F.lit("")))


def write_index(records: DataFrame, path: str) -> None:
    """Index blocks of the records (as of read_archives) below path: key-sorted lines, compressed, and a directory.

    Keys are dealt by range together with the record's place, so that one URL with many captures spreads over blocks.
    """
    lines = records.select(_keys(F.col("url")).alias("key"), "page_id", "url", "record_type", "payload_digest", "archive", "offset", "length")
    ordered = lines.repartitionByRange("key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"value": pa.array([member("\n".join(map(json.dumps, rows)).encode())[:-1]], pa.binary())})

        rows: list[dict] = []
        for batch in batches:
            rows += batch.to_pylist()
            while len(rows) >= BLOCK_LINES:
                yield block(rows[:BLOCK_LINES])
                rows = rows[BLOCK_LINES:]
        if rows:
            yield block(rows)

    ordered.mapInArrow(cut, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(f"{path}/blocks")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py(), []
                for at, size, data in members(batch.column(1)[i].as_py()):
                    rows.append((json.loads(data[: data.find(b"\n") % (len(data) + 1)])["key"], json.loads(data[data.rfind(b"\n") + 1 :])["key"], name, at, size))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["first_key", "last_key", "file", "offset", "length"])

    blocks = records.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("path", "content")
    directory = blocks.mapInArrow(places, "first_key string, last_key string, file string, offset long, length long")
    directory.orderBy("first_key", "last_key", "file", "offset").write.option("parquet.block.size", 1 << 20).parquet(f"{path}/directory")


class Ranges:
    """Reads byte ranges of files, on any file system that pyarrow knows by the path's scheme."""

    def __init__(self) -> None:
        self.name, self.file = None, None

    def __call__(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            store, where = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", name))
            self.name, self.file = name, store.open_input_file(where)
        return self.file.read_at(length, offset)


class CaptureIndex:
    """Lookups by URL. Nothing of the index is held; a lookup reads the directory rows that may hold its key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.directory, self.read = spark, spark.read.parquet(f"{path}/directory"), Ranges()

    def captures(self, url: str) -> Iterator[dict]:
        """All captures of a URL, block by block."""
        key = url_key(url)
        found = self.directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "last_key", "file", "offset")
        for r in found.toLocalIterator():
            yield from _with_key(_lines(self.read(r.file, r.offset, r.length)), key)

    def payload(self, capture: dict) -> bytes:
        """Reads a capture's byte range and returns its payload (empty for a revisit)."""
        return next(parse(self.read(capture["archive"], capture["offset"], capture["length"])))[3]

    def look_up(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """The records (RECORDS, without payload) of all captures of the URLs of a table, from their own byte ranges.

        A capture comes once, however often its URL is in the table; null counts as an empty URL.
        """
        wanted = written(urls.select(_keys(_clean(F.col(quoted(url_col)).cast("string"))).alias("key")).distinct(), "keys")
        out, entries = None, []
        for r in self.directory.orderBy("first_key", "last_key").toLocalIterator():
            entries.append(tuple(r))
            if len(entries) == BLOCKS_AT_ONCE:
                out = self._found(wanted, entries, out)
                entries = []
        out = self._found(wanted, entries, out)
        # a number, so that adaptive execution does not take the small rows for little work
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return _fetched(out.repartition(parts, "archive").sortWithinPartitions("archive", "offset"))

    def _found(self, wanted: DataFrame, entries: list[tuple], before: DataFrame | None) -> DataFrame:
        """before, and the captures (archive, offset, length) that the directory entries lead to."""
        # last keys do not decrease with first keys, as blocks lie one after another
        first, last = [e[0] for e in entries], [e[1] for e in entries]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for key in batch.column(0).to_pylist():
                    for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                        rows.append((key, *entries[i][2:]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "file", "offset", "length"])

        def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read, at, block = Ranges(), None, []
            for batch in batches:
                rows = []
                for key, *place in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if place != at:
                        at, block = place, _lines(read(*place))
                    rows += [(c["archive"], c["offset"], c["length"]) for c in _with_key(block, key)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["archive", "offset", "length"])

        near = wanted.mapInArrow(search, "key string, file string, offset long, length long")
        near = near.repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
        got = near.mapInArrow(open_, "archive string, offset long, length long")
        return got if before is None else before.unionByName(got)


def _lines(block: bytes) -> list[dict]:
    return [json.loads(x) for x in next(members(block))[2].decode().split("\n")]


def _with_key(lines: list[dict], key: str) -> list[dict]:
    of = lambda r: r["key"]
    return lines[bisect.bisect_left(lines, key, key=of) : bisect.bisect_right(lines, key, key=of)]


def _fetched(places: DataFrame) -> DataFrame:
    """The records at (archive, offset, length), which come by archive and offset."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Ranges()
        for batch in batches:
            runs: list[list] = []  # archive, begin, end, ranges
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not runs or runs[-1][0] != archive or offset - runs[-1][2] > NEAR or offset + length - runs[-1][1] > READ:
                    runs.append([archive, offset, offset, []])
                runs[-1][2] = offset + length
                runs[-1][3].append((offset, length))
            for archive, begin, end, ranges in runs:
                data = read(archive, begin, end - begin)
                yield _batch([_row(archive, offset, length, *next(parse(data[offset - begin : offset - begin + length]))[2:]) for offset, length in ranges])

    return places.mapInArrow(fetch, RECORDS)


def archive_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes df's archives and their index to the shared folder, looks up every URL of df and returns the records found."""
    path = new_path(df.sparkSession, "warc")
    write_archives(df, f"{path}/archives", id_col, url_col, text_col, min_bytes)
    write_index(read_archives(df.sparkSession, f"{path}/archives"), f"{path}/index")
    return CaptureIndex(df.sparkSession, f"{path}/index").look_up(df, url_col)
