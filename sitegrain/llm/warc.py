"""WARC archives: a writer with revisit records, and a salvage reader for damaged files.

The writer makes every record a gzip member of its own; the reader takes members of any number of records.  It checks
each record (gzip checksum, header block, length, block or payload digest).  Where a check fails it searches for the
next gzip member or version line that starts a valid record, inside a member as well as behind it, goes on from there,
and reports the bytes between as a quarantined gap.  An intact archive is read once, front
to back, by a window that moves with the records; after damage the search begins again behind the failed start.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, open_output, scratch_path, write_atomically

#: Payloads below this many bytes are always stored.
REVISIT_BYTES = 100
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REQUIRED = {"warc-type", "warc-record-id", "content-length"}
_CONTROL = re.compile(r"[\x00-\x08\x0a-\x1f\x7f]")
_RUN_ON = re.compile(r"WARC/1\.[0-9]$")
#: What is read from the store at once, and what is first taken of a record; more is taken as it proves longer.
_READ, _TAKE = 1 << 18, 1 << 11
#: Bytes of a member that are kept while it is checked.
_KEPT = 1 << 24
#: Bytes that no header line may hold.
_NEVER = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


# -- writing ------------------------------------------------------------------------------------------------------


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {re.sub('[\x00-\x1f\x7f]+', ' ', v)}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record without the payload."""
    digest = hashlib.sha256(payload).hexdigest()
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(f"page:{page_id}"),
        "WARC-Date": "2026-01-01T00:00:00Z",
        "WARC-Target-URI": url or "",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is None:
        return record_bytes(headers, _HTTP + payload)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(f"page:{refers_to}"), "X-Refers-To-Page": str(refers_to)}
    return record_bytes(headers, _HTTP)


# -- reading ------------------------------------------------------------------------------------------------------


class Damaged(Exception):
    """A record that fails a check."""


class Headers(dict):
    """The named fields, names in lower case; of one that repeats the first, and all of them in ``every``."""

    def __init__(self):
        super().__init__()
        self.every: dict[str, list[str]] = {}


def _parse(data: bytes) -> tuple[Headers, bytes]:
    end = data.find(b"\r\n\r\n")
    if not data.startswith(_VERSION) or end < 0:
        raise Damaged("no header block")
    try:
        lines = data[:end].decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise Damaged("header bytes") from e
    headers = Headers()
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or _CONTROL.search(line):
            raise Damaged("header line")
        if _RUN_ON.search(line) and not _REQUIRED & headers.keys():  # a cut header block and the next record's version
            raise Damaged("header line")
        k = k.strip().lower()
        headers.setdefault(k, v.strip())
        headers.every.setdefault(k, []).append(v.strip())
    if not _REQUIRED <= headers.keys() or any(len(headers.every[k]) > 1 for k in _REQUIRED):  # two records run into one
        raise Damaged("header fields")
    length = headers["content-length"]
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        raise Damaged("no length")
    return headers, data[end + 4 : end + 4 + int(length)]


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What a block holds: all of it, or what follows the HTTP header."""
    if not block.startswith(b"HTTP/"):
        return block
    end = block.find(b"\r\n\r\n")
    return block[end + 4 :] if end >= 0 else b""


def digest_holds(labelled: str, data: bytes) -> bool | None:
    """Whether ``algorithm:value``, in hex or base32, is the digest of the data; None where the algorithm is unknown."""
    name, _, value = labelled.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    found = hashlib.new(name, data).digest()
    return value.strip().lower() == found.hex() or value.strip().upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _checked(headers: Headers, block: bytes) -> tuple[Headers, bytes]:
    """A block digest decides; only without one is the payload digest of a whole record looked at, which writers take
    before or after the transfer coding."""
    if len(block) != int(headers["content-length"]):
        raise Damaged("short block")
    whole = digest_holds(headers.get("warc-block-digest", ""), block)
    if whole is False:
        raise Damaged("block digest")
    if whole is None and headers["warc-type"] in ("response", "resource") and "warc-truncated" not in headers:
        if digest_holds(headers.get("warc-payload-digest", ""), payload_of(headers, block)) is False:
            raise Damaged("payload digest")
    return headers, block


class Window:
    """Bytes of a file by position, read forward in large pieces, of which the last is kept."""

    def __init__(self, source, size: int):
        self.source, self.size, self.start, self.data = source, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        end = min(at + n, self.size)
        kept = self.data[at - self.start :] if self.start <= at <= self.start + len(self.data) else b""
        if at + len(kept) < end:
            self.source.seek(at + len(kept))
            self.data = kept + self.source.read(min(max(end - at - len(kept), _READ), self.size - at - len(kept)))
            self.start = at
            kept = self.data
        return kept[: end - at]


def _gzip_header(data: bytes) -> int:
    """The length of the header that a member begins with."""
    flags, n = data[3] if len(data) > 3 else 0, 10
    if flags & 4:
        n += 2 + int.from_bytes(data[n : n + 2], "little")
    for flag in (8, 16):  # name and comment, each up to a zero byte
        if flags & flag:
            n = data.find(b"\0", n) + 1 or len(data)
    return min(len(data), n + (2 if flags & 2 else 0))


class Inflated:
    """The content of the gzip member that begins at ``start``, inflated as far as it is asked for.

    A member that is cut or fails its checks ends where that is noticed, and ``fault`` says why; ``end`` is where an
    intact one ends in the file.  Where ``unchecked``, it is inflated in small pieces and without its checksum, so
    that nothing before a fault is lost.
    """

    def __init__(self, window: Window, start: int, unchecked: bool = False):
        self.window, self.at, self.take, self.most = window, start, _TAKE, _TAKE if unchecked else _READ
        self.z = zlib.decompressobj(-15 if unchecked else 31)
        self.data, self.fault, self.end = bytearray(), "", None
        if unchecked:
            self.at += _gzip_header(window.get(start, _READ))

    def more(self) -> bool:
        """Inflate some more; no where there is none."""
        while self.end is None and not self.fault:
            if self.z.unconsumed_tail:
                piece = self.z.unconsumed_tail
            elif self.at >= self.window.size:
                self.fault = "cut member"
                break
            else:
                piece = self.window.get(self.at, self.take)
                self.at += len(piece)
                self.take = min(2 * self.take, _READ)
            try:
                out = self.z.decompress(piece, self.most)
            except zlib.error:
                self.fault = "member data"
                break
            if self.z.eof:
                self.end = self.at - len(self.z.unused_data)
            if out:
                self.data += out
                return True
        return False

    def get(self, n: int) -> bytes:
        """The next ``n`` bytes, or what there is."""
        while len(self.data) < n and self.more():
            pass
        return bytes(self.data[:n])

    def drop(self, n: int) -> None:
        del self.data[:n]


def _inside(content: Inflated) -> Iterator[tuple]:
    """("record", headers, block) and ("gap", reason, None) of a member's content, one record at a time in memory."""
    gap = ""
    while content.get(1):
        try:
            take = _TAKE
            head = content.get(take)
            while head.find(b"\r\n\r\n") < 0 and not _NEVER.search(head) and len(head) == take:
                take *= 2
                head = content.get(take)
            headers, _ = _parse(head)
            first, length = head.find(b"\r\n\r\n") + 4, int(headers["content-length"])
            whole = content.get(first + length + 4)
            if whole[first + length :] != b"\r\n\r\n":
                raise Damaged("no record end")
            found = _checked(headers, whole[first : first + length])
        except Damaged as e:
            gap = gap or str(e)
            content.drop(1)
            while (k := content.data.find(_VERSION)) < 0:
                content.drop(max(0, len(content.data) - len(_VERSION) + 1))
                if not content.more():
                    content.drop(len(content.data))
                    break
            else:
                content.drop(k)
            continue
        if gap:
            yield "gap", gap, None
            gap = ""
        yield "record", *found
        content.drop(first + length + 4)
    if gap:
        yield "gap", gap, None


def _vouched(headers: Headers, block: bytes) -> bool:
    """Whether a digest of the record itself says that it is whole."""
    if digest_holds(headers.get("warc-block-digest", ""), block):
        return True
    return headers["warc-type"] in ("response", "resource") and digest_holds(headers.get("warc-payload-digest", ""), payload_of(headers, block)) is True


def _sound(window: Window, start: int) -> tuple[int | None, str, Inflated]:
    """(end, fault, content) of the member at ``start``, which is inflated to its end to see whether it is whole; where that
    takes more than ``_KEPT`` bytes, or there is a fault, ``content`` begins anew."""
    content, large = Inflated(window, start), False
    while content.more():
        if len(content.data) > _KEPT:
            content.data.clear()
            large = True
    return content.end, content.fault, Inflated(window, start, bool(content.fault)) if large or content.fault else content


def _header_block(window: Window, start: int) -> bytes:
    """The bytes from ``start`` to beyond the blank line, however far; less where no header block can go on."""
    data, take = b"", _TAKE
    while data.find(b"\r\n\r\n") < 0 and not _NEVER.search(data) and start + len(data) < window.size:
        data = window.get(start, take)
        take *= 2
    return data


def _read_plain(window: Window, start: int) -> tuple[int, Headers, bytes]:
    data = _header_block(window, start)
    headers, _ = _parse(data)
    first = start + data.find(b"\r\n\r\n") + 4
    length = int(headers["content-length"])
    if first + length + 4 > window.size:
        raise Damaged("cut record")
    whole = window.get(first, length + 4)
    if whole[length:] != b"\r\n\r\n":
        raise Damaged("no record end")
    return first + length + 4, *_checked(headers, whole[:length])


def _next_start(window: Window, start: int) -> int:
    """Where the next member or version line may begin, from ``start`` on; the size if nowhere."""
    take = _TAKE
    while start < window.size:
        piece = window.get(start, take)
        found = [k for k in (piece.find(_MEMBER), piece.find(_VERSION)) if k >= 0]
        if found:
            return start + min(found)
        if start + len(piece) >= window.size:
            break
        start += len(piece) - len(_VERSION) + 1
        take = min(2 * take, _READ)
    return window.size


def salvage(source, size: int) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, None) of one archive, in order.

    Gaps and records cover the file.  They do not overlap, but for those of one gzip member, which may hold any number of
    records and, between them, damage: all of these have the member's start and end.  A member that fails its own checks
    is a gap; of its records those stay that have a digest which holds, with an empty place at its start.  One record at
    a time is in memory, beside at most 16 MB of a member.
    """
    at, gap, reason = 0, None, ""
    window = Window(source, size)
    while at < size:
        head = window.get(at, len(_VERSION))
        found, end = [], None
        try:
            if head.startswith(_MEMBER):
                end, fault, content = _sound(window, at)
                found = _inside(content)
                if fault:
                    for kind, headers, block in found:
                        if kind == "record" and _vouched(headers, block):
                            if gap is not None and gap < at:
                                yield "gap", gap, at, reason, None
                                gap = None
                            yield "record", at, at, headers, block
                    raise Damaged(fault)
            elif head == _VERSION:
                end, headers, block = _read_plain(window, at)
                found = [("record", headers, block)]
            else:
                raise Damaged("no member or version line")
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = _next_start(window, at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        for kind, x, y in found:
            yield (kind, at, end, x, y)
        at = end
    if gap is not None:
        yield "gap", gap, size, reason, None


# -- on tables ----------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to): rows whose payload of at least ``least`` bytes equals that of a smaller
    page_id refer to the smallest such id.  Rows that share the smallest id are all responses; rows without an id
    refer to the smallest id there is.  Only ids and digests are grouped; payloads meet them on the unique pair."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    digest = F.sha2(payload, 256)
    marked = pages.select("page_id", digest.alias("digest")).filter(F.octet_length(payload) >= least)
    copies = marked.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = materialize(marked.join(copies, "digest").filter("not (page_id <=> first)").select("page_id", "digest", "first").distinct(), "revisits")
    later = later.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), digest.alias("digest")).join(later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, path: str | None = None, least: int = REVISIT_BYTES) -> DataFrame:
    """Write one archive a task below ``path`` from ``pages`` (page_id, url, html); returns (file, records, bytes)."""
    spark = pages.sparkSession
    bounded_batches(spark)
    path = path or scratch_path(spark, "warc", kept=True)

    def run(batches):
        from pyspark import TaskContext

        name = f"{path}/part-{TaskContext.get().partitionId():07d}.warc.gz"
        n = [0, 0]

        def write(sink):
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    data = member(page_record(page_id, url, payload, refers_to))
                    sink.write(data)
                    n[0] += 1
                    n[1] += len(data)

        write_atomically(name, write)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n[0]], "bytes": [n[1]]})

    return materialize(with_revisits(pages, least).mapInArrow(run, "file string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record and gap of the files in ``archives`` (file): file, start, end, kind, reason, page_id, uri,
    record_type, payload_bytes, payload_digest, refers_to, payload."""
    schema = "file string, start long, end long, kind string, reason string, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def number(x):
        return int(x) if x and x.lstrip("-").isdigit() else None

    def rows(file):
        store, name = open_output(file)
        size = store.get_file_info(name).size
        with store.open_input_file(name) as source:
            for kind, start, end, headers, block in salvage(source, size):
                if kind == "gap":
                    yield (file, start, end, kind, headers, None, None, None, None, None, None, None)
                    continue
                payload = payload_of(headers, block) if headers.get("warc-type") == "response" else None
                digest = headers.get("warc-payload-digest", "")
                digest = digest[7:] if digest.startswith("sha256:") or payload is None else hashlib.sha256(payload).hexdigest()
                length = number(headers.get("x-payload-length")) if payload is None else len(payload)
                yield (file, start, end, kind, None, number(headers.get("x-page-id")), headers.get("warc-target-uri"), headers.get("warc-type"), length, digest, number(headers.get("x-refers-to-page")), payload)

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(file):
                    held.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    by_name = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [by_name[x.split()[1]] for x in schema.split(", ")]
    return archives.select("file").repartition(max(1, min(archives.count(), 100_000)), "file").mapInArrow(run, schema)


def is_hurt(page_id) -> bool:
    """Whether :func:`damaged_copies` damages the record of a page: md5 of its id begins with the digit 0."""
    return hashlib.md5(str(page_id).encode()).hexdigest()[0] == "0"


def damaged_copies(archives: DataFrame) -> DataFrame:
    """(file, hurt): copies of the files in ``archives`` (file) in which records are damaged, each in one of five ways:
    bytes overwritten, its second half cut off, its first bytes lost, all of it turned into noise, or cut in half
    inside a member that it shares with the record behind it."""

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, name = open_output(file)
                copy, hurt = re.sub(r"(\.warc(\.gz)?)?$", r"-damaged\1", file, count=1), [0]

                def write(sink, store=store, name=name, hurt=hurt):
                    with store.open_input_file(name) as source:
                        size, half = source.size(), b""
                        copied = Window(source, size)
                        with store.open_input_file(name) as again:
                            for _, start, end, headers, _ in salvage(again, size):
                                data = copied.get(start, end - start)
                                if isinstance(headers, dict) and is_hurt(headers.get("x-page-id")):
                                    n, middle = hurt[0] % 5, len(data) // 2
                                    hurt[0] += 1
                                    if n == 4:
                                        whole = zlib.decompress(data, 31)
                                        half += whole[: len(whole) // 2]
                                        continue
                                    data = (data[:middle] + bytes(255 - x for x in data[middle : middle + 9]) + data[middle + 9 :], data[:middle], data[20:], b"\x1f\x8b noise " * (len(data) // 9))[n]
                                elif half:
                                    data, half = member(half + zlib.decompress(data, 31)), b""
                                sink.write(data)
                        if half:
                            sink.write(member(half))

                write_atomically(copy, write)
                yield pa.RecordBatch.from_pydict({"file": [copy], "hurt": pa.array(hurt, pa.int64())})

    return materialize(archives.select("file").repartition(max(1, min(archives.count(), 100_000)), "file").mapInArrow(run, "file string, hurt long"), "damaged")


def salvage_damaged(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, recovered) of every row of ``pages`` (page_id, url, html), written to archives whose
    copies are damaged and read by the salvage reader: what is not hurt comes back, what is hurt does not.

    Null html is an empty payload; an empty table gives no rows; rows that repeat an id are recovered if one of them
    is; rows without an id are hurt or not together; further columns are ignored.
    """
    found = read_archives(damaged_copies(write_archives(pages)).select("file")).filter("kind = 'record'").select("page_id").distinct()
    bytes_of = F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))).cast("long")
    rows = pages.select("page_id", bytes_of.alias("payload_bytes"))
    found = materialize(found, "recovered").withColumnRenamed("page_id", "_found").withColumn("_hit", F.lit(True))
    return rows.join(found, F.col("page_id").eqNullSafe(F.col("_found")), "left").select("page_id", "payload_bytes", F.col("_hit").isNotNull().alias("recovered"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and read the archives back: (page_id, payload_bytes, payload_digest,
    record_type, refers_to) of every row.

    Null html is an empty payload; null urls are empty; null ids come back null; rows that repeat an id give a record
    each; an empty table gives no rows; further columns are ignored.  A gap in a file just written is an error.
    """
    found = read_archives(write_archives(pages))
    sound = F.when(F.col("kind") == "record", F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("damaged archive "), F.col("file"))).cast("long"))
    return found.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
