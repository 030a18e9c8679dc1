"""WARC archives with a two-level capture index, and look-ups through it.

Writing: captures are dealt by ranges of their index key (the url with its host reversed, then the page
id) and sorted, so that every task writes one archive and its part of the index, and the parts in order
are the index. An archive holds a gzip member for each record. Its index file holds the captures'
lines in compressed blocks and, behind them, the sparse directory: each block's first line and place.

Looking up: requests are sorted the same way; the archive, the block and the line are each
found by binary search, and records come by range reads, those that lie next to each other by one.

A payload that several captures share is stored once, in that of the largest page id; the others are
revisits, a header without a payload. Which is decided on digests alone before any payload moves.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeledger.llm.common import filesystem, shared_folder, ship_package, steps, stored

RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Lines of an index block, and bytes that one range read takes at most (a longer record stands alone).
BLOCK_LINES, READ_BYTES = 1024, 4_000_000
#: A payload shared by more than one in so many captures is met by a broadcast of at most as many digests.
HOT_SHARE = 1000
LEVEL = 6
#: The foot of an index file: where its directory begins, that directory's length, blocks.
FOOT = struct.Struct("<QQQ8s")
MAGIC = b"capturix"
END = "\r\n"

ARCHIVES = "part int, archive string, index string, first string, last string, captures long, blocks long"
_ARCHIVES = pa.schema(
    [("part", pa.int32()), ("archive", pa.string()), ("index", pa.string()), ("first", pa.string()), ("last", pa.string()), ("captures", pa.int64()), ("blocks", pa.int64())]
)
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def url_key(url: Column) -> Column:
    """The url under which its captures are sorted: ``http://www.a.com:80/x?y`` as ``com,a,www:80)/x?y``.

    The host is lower-cased and reversed, the scheme left out. A text without ``://`` stands for
    itself behind a ``)``; a null one is empty. Control characters and spaces are percent-encoded.
    """
    plain = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(plain, r"(?s)^[^/?#]*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(plain, r"(?s)^[^/?#]*?://(?:[^/?#@]*@)?[^/?#:]*(.*)$", 1)
    port = F.regexp_extract(rest, r"^(:[^/?#]*)", 1)
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    key = F.when(F.contains(plain, F.lit("://")), F.concat(reversed_host, port, F.lit(")"), F.substr(rest, F.length(port) + 1))).otherwise(F.concat(F.lit(")"), plain))
    return F.regexp_replace(F.regexp_replace(key, "%(?=20|0[0-9A-F]|1[0-9A-F])", "%25"), r"[\x00-\x20]", "%20")


def place(key: Column, page_id: Column) -> Column:
    """An index line's sorting part: the url's key and the page id, as text whose order is that of both."""
    # Ids as unsigned numbers of twenty digits, shifted so that negative ones come first; null ids before all.
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(key, F.lit(" "), F.coalesce(number, F.lit("-")))


# --- Records ----------------------------------------------------------------------------------------


def digest_text(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(kind: str, digest: str, page_id: int | None, n: int | str = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {digest} {page_id} {n}')}>"


def _quoted(url: str) -> str:
    """A url as one header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None, date: str, n: int | str) -> bytes:
    """One record: a response with its payload, or (payload None) a revisit of the response of ``refers_to``."""
    kind = REVISIT if payload is None else RESPONSE
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {size}{END}{END}".encode()
    block = http + (payload or b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(kind, digest, page_id, n)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _quoted(url)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == REVISIT:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(RESPONSE, digest, refers_to))]
        if refers_to is not None:
            fields.append(("Refers-To-Page-ID", str(refers_to)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{name}: {value}{END}" for name, value in fields)
    return f"WARC/1.1{END}{head}{END}".encode() + block + (END + END).encode()


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's fields, its HTTP fields, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split(END)
    if not version.startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where it should")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split(END)[1:]), payload


def _packed(data: bytes) -> bytes:
    """One gzip member."""
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


# --- Writing ----------------------------------------------------------------------------------------


class IndexWriter:
    """Blocks of index lines as they come, in order; the directory behind them."""

    def __init__(self, out) -> None:
        self.out, self.at, self.lines, self.directory = out, 0, [], []
        self.first = self.last = None

    def add(self, place: str, entry: list) -> None:
        self.first = place if self.first is None else self.first
        self.last = place
        self.lines.append(f"{place}\t{json.dumps(entry)}")
        if len(self.lines) == BLOCK_LINES:
            self._block()

    def _block(self) -> None:
        data = zlib.compress("\n".join(self.lines).encode(), LEVEL)
        self.directory.append([self.lines[0].split("\t")[0], self.at, len(data)])
        self.out.write(data)
        self.at, self.lines = self.at + len(data), []

    def close(self) -> None:
        if self.lines:
            self._block()
        data = zlib.compress(json.dumps(self.directory).encode(), LEVEL)
        self.out.write(data + FOOT.pack(self.at, len(data), len(self.directory), MAGIC))
        self.out.close()


def _written(batches: Iterable[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    # Each attempt writes files of its own; the table of archives names those of the attempt that counts.
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    out = before = None
    for batch in steps(batches, "payload"):
        for row in batch.to_pylist():
            # Of equal rows, which follow each other, the first has the payload.
            same = (row["place"], row["sha1"], row["url"])
            row["revisit"] = row["revisit"] or (row["shared"] and same == before)
            before = same
            if out is None:
                out, index, at, n = store.open_output_stream(f"{path}/{name}.warc.gz", compression=None), IndexWriter(store.open_output_stream(f"{path}/{name}.idx", compression=None)), 0, 0
            digest = digest_text(row["sha1"])
            payload = None if row["revisit"] else row["payload"].encode()
            data = _packed(record(row["page_id"], row["url"], digest, row["size"], payload, row["refers_to"], date, 0 if row["shared"] and payload is not None else f"{part} {n}"))
            out.write(data)
            index.add(row["place"], [at, len(data), RESPONSE if payload is not None else REVISIT, digest])
            at, n = at + len(data), n + 1
    if out is not None:
        index.close()
        out.close()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "archive": f"{name}.warc.gz", "index": f"{name}.idx", "first": index.first, "last": index.last, "captures": n, "blocks": len(index.directory)}], _ARCHIVES
        )


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The pages with their place, digest and the page that they revisit; a revisit has no payload any more.

    Of rows with one payload of at least ``min_bytes``, that of the largest page id is the response, of
    such rows that with the largest url. Digests are counted before they meet the rows
    again; those of more than one in HOT_SHARE rows, fewer than HOT_SHARE in number, come by a
    broadcast, the others by a join.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.unhex(F.sha1(F.encode("payload", "utf-8")))})
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("named"), "url"))
    shared = rows.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.count("*").alias("n"), last.alias("last")).filter("n > 1")
    shared = stored(shared.select("sha1", "n", "last.page_id", "last.url"), "warc-shared")
    limit = pages.count() // HOT_SHARE

    def of(prefix: str, which: Column) -> DataFrame:
        return shared.filter(which).select(*(F.col(name).alias(f"{prefix}_{name}") for name in ("sha1", "page_id", "url")))

    met = rows.join(F.broadcast(of("hot", F.col("n") > limit)), F.col("sha1") == F.col("hot_sha1"), "left")
    # Rows that have met their digest go anywhere: a key of other length equals no digest.
    key = F.when(F.col("hot_sha1").isNull(), F.col("sha1")).otherwise(F.unhex(F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), "url"))))
    met = met.withColumn("_key", key).join(of("mild", F.col("n") <= limit), F.col("_key") == F.col("mild_sha1"), "left")
    found = F.coalesce("hot_sha1", "mild_sha1").isNotNull()
    page, url = (F.when(F.col("hot_sha1").isNotNull(), F.col(f"hot_{name}")).otherwise(F.col(f"mild_{name}")) for name in ("page_id", "url"))
    revisit = found & (F.col("size") >= min_bytes) & ~(F.col("page_id").eqNullSafe(page) & F.col("url").eqNullSafe(url))
    told = met.withColumns({"place": place(url_key(F.col("url")), F.col("page_id")), "revisit": revisit, "shared": found & (F.col("size") >= min_bytes), "refers_to": page})
    return told.select("place", "page_id", "url", "size", "sha1", "revisit", "shared", "refers_to", F.when(~F.col("revisit"), F.col("payload")).alias("payload"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the pages' archives and index to the folder; returns the table of archives, in order.

    ``pages`` has page_id, url and html (null: empty); other columns are not read. The folder must be one
    that all executors reach. A task that runs twice harms nothing: the table of archives names the
    files that count. ``date`` is the date of capture of all records.
    """
    ship_package(pages.sparkSession)
    order = ["place", "sha1", "url"]
    dealt = captures(pages, min_bytes).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(partial(_written, folder=folder, date=date), ARCHIVES), "warc-archives")


# --- Reading ----------------------------------------------------------------------------------------


class Archive:
    """One archive and its part of the index. Holds the directory and the block last read."""

    def __init__(self, store, path: str, row: dict) -> None:
        self.records, self.index = (store.open_input_file(f"{path}/{row[name]}") for name in ("archive", "index"))
        size = self.index.size()
        at, length, _, magic = FOOT.unpack(self.index.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC:
            raise ValueError("no index file")
        self.directory = json.loads(zlib.decompress(self.index.read_at(length, at)))
        self.firsts, self.held = [entry[0] for entry in self.directory], (-1, [], [])

    def _block(self, k: int) -> tuple[list[str], list[str]]:
        if self.held[0] != k:
            _, at, length = self.directory[k]
            lines = [line.split("\t", 1) for line in zlib.decompress(self.index.read_at(length, at)).decode().split("\n")]
            self.held = (k, [line[0] for line in lines], [line[1] for line in lines])
        return self.held[1:]

    def find(self, wanted: str) -> Iterator[tuple[int, int]]:
        """Place and length of the records at a place. Equal places may run over several blocks."""
        k = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while k < len(self.firsts) and self.firsts[k] <= wanted:
            places, entries = self._block(k)
            for n in range(bisect.bisect_left(places, wanted), bisect.bisect_right(places, wanted)):
                at, length, *_ = json.loads(entries[n])
                yield at, length
            k += 1

    def read(self, at: int, length: int) -> bytes:
        return self.records.read_at(length, at)

    def close(self) -> None:
        self.records.close()
        self.index.close()


def _ranges(found: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, list[int]]]:
    """Records (archive, place, length) that follow each other, as one range of at most READ_BYTES."""
    now = None
    for archive, at, length in found:
        if now and now[0] == archive and now[1] + now[2] == at and now[2] + length <= READ_BYTES:
            now = (archive, now[1], now[2] + length, now[3] + [length])
        else:
            if now:
                yield now
            now = (archive, at, length, [length])
    if now:
        yield now


def _result(data: bytes) -> dict:
    fields, http, payload = parsed(zlib.decompress(data, 31))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == RESPONSE and digest_text(hashlib.sha1(payload).digest()) != digest:
        raise ValueError("a payload has another digest than its record says")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("Page-ID"),
        "payload_bytes": len(payload) if fields["WARC-Type"] == RESPONSE else int(http["Content-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("Refers-To-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload,
    }


def _read(batches: Iterable[pa.RecordBatch], folder: str, archives: list[dict]) -> Iterator[pa.RecordBatch]:
    store, path = filesystem(folder)
    lasts, opened = [row["last"] for row in archives], {}

    def archive(k: int) -> Archive:
        if k not in opened:
            while opened:  # requests come in order: what lies behind is not needed again
                opened.popitem()[1].close()
            opened[k] = Archive(store, path, archives[k])
        return opened[k]

    def found(places: list[str]) -> Iterator[tuple[int, int, int]]:
        for wanted in places:
            k = bisect.bisect_left(lasts, wanted)
            while k < len(archives) and archives[k]["first"] <= wanted:
                for at, length in archive(k).find(wanted):
                    yield k, at, length
                k += 1

    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_LINES):
            rows = []
            for k, at, length, parts in _ranges(found(batch.column("place").slice(start, BLOCK_LINES).to_pylist())):
                data, first = archive(k).read(at, length), 0
                for part in parts:
                    rows.append(_result(data[first : first + part]))
                    first += part
                    del rows[-1]["payload"]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RESULT)
    for left in opened.values():
        left.close()


def look_up(requests: DataFrame, archives: DataFrame, folder: str) -> DataFrame:
    """The records (RESULT) of the requested ``url, page_id``, each once however often it is asked for.

    Requests are sorted as the index is; the table of archives, one row for each task that wrote, goes
    to every task. A request without a capture has no row.
    """
    asked = requests.select(place(url_key(F.col("url").cast("string")), F.col("page_id").cast("long")).alias("place")).distinct()
    listed = [row.asDict() for row in archives.orderBy("part").collect()]
    return asked.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(partial(_read, folder=folder, archives=listed), RESULT)


def archive_and_read(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages and read each back through the index: see write and look_up.

    One row per page row, null and repeated ids and urls included; an empty table gives an empty result.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return look_up(pages.select("url", "page_id"), write(pages, folder, min_bytes), folder)
