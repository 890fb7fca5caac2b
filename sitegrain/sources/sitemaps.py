"""Sitemaps and sitemap indexes, read as a stream of XML events.

A file is decompressed, decoded and parsed piece by piece, so that what is held of it does not grow with its size.
Whatever stands before the first ``urlset`` or ``sitemapindex`` tag - declarations, document types, an HTML page - is
passed over, and so is what follows its end.
"""

from __future__ import annotations

import codecs
import html
import re
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crawl_folders import _store
from .shared import discard, written

PIECE = 1 << 16
#: Rows of a batch; characters that an unfinished tag, entity or CDATA section may hold back, and a text may have.
BATCH, HELD = 2000, 1 << 20
SCHEMA = "url string, pos long, kind string, loc string, lastmod string"
_ROOT = re.compile(r"<(?:[\w.-]+:)?(urlset|sitemapindex)(?=[\s>/])")
_ENCODING = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([\w.-]+)["']""")
_MARKS = re.compile(r"<!\[CDATA\[.*?\]\]>|&(#[0-9]+;|#x[0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", re.S)
_OPEN = re.compile(r"<(?:!(?:\[(?:C(?:D(?:A(?:T(?:A)?)?)?)?)?)?)?$|<!\[CDATA\[(?:(?!\]\]>).)*$|&[#A-Za-z0-9]{0,31}$", re.S)


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces as they are, or decompressed where they begin as gzip does; members may follow one another."""
    inflate = None
    for n, piece in enumerate(pieces):
        if n == 0 and piece[:2] == b"\x1f\x8b":
            inflate = zlib.decompressobj(47)
        if inflate is None:
            yield piece
            continue
        while piece:
            out = inflate.decompress(piece, PIECE)
            if out:
                yield out
            if inflate.eof:
                piece, inflate = inflate.unused_data, zlib.decompressobj(47)
            else:
                piece = inflate.unconsumed_tail


def _decoded(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text, by the byte order mark or the declaration, else as UTF-8."""
    decoder = None
    for piece in pieces:
        if decoder is None:
            named = _ENCODING.match(piece[:200])
            name = named[1].decode() if named else "utf-8-sig"
            if piece[:2] in (b"\xff\xfe", b"\xfe\xff"):
                name = "utf-16"
            try:
                decoder = codecs.getincrementaldecoder(name)("replace")
            except LookupError:
                decoder = codecs.getincrementaldecoder("utf-8-sig")("replace")
        yield decoder.decode(piece)


def _mended(mark: re.Match) -> str:
    """Entities of XML as they are, those of HTML as characters, and ampersands that begin none as such."""
    text = mark[0]
    if text.startswith("<") or text in ("&amp;", "&lt;", "&gt;", "&quot;", "&apos;") or text.startswith("&#"):
        return text
    plain = html.unescape(text) if len(text) > 1 else text
    return plain if plain != text and "&" not in plain and "<" not in plain else "&amp;" + text[1:]


def _document(texts: Iterator[str]) -> Iterator[str]:
    """The text from the root tag on, with its entities mended; marks are never cut in two."""
    rest, inside = "", False
    for text in texts:
        rest += text
        if not inside:
            root = _ROOT.search(rest)
            if root is None:
                rest = rest[-256:]
                continue
            rest, inside = rest[root.start() :], True
        unfinished = _OPEN.search(rest, max(0, len(rest) - HELD))
        cut = unfinished.start() if unfinished else len(rest)
        whole, rest = rest[:cut], rest[cut:]
        if len(rest) >= HELD:
            raise ValueError("a section without end")
        if whole:
            yield _MARKS.sub(_mended, whole)
    if inside and rest:
        yield _MARKS.sub(_mended, rest)


class _Events:
    """What the parser has met: entries that are complete, and whether the root has ended."""

    def __init__(self):
        self.path, self.found, self.text, self.entry = [], [], None, {}
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.start, self.end
        self.parser.CharacterDataHandler = self.data
        self.ended = False

    def start(self, name, attributes):
        name = name.rsplit(":", 1)[-1].lower()
        self.path.append(name)
        if name in ("url", "sitemap") and len(self.path) == 2:
            self.entry = {}
        self.text = [] if name in ("loc", "lastmod") and len(self.path) == 3 else None

    def data(self, text):
        if self.text is not None:
            self.text.append(text)
            if sum(map(len, self.text)) > HELD:
                raise ValueError("a text of more than a megabyte")

    def end(self, name):
        name = self.path.pop()
        if self.text is not None and name in ("loc", "lastmod"):
            self.entry[name] = "".join(self.text).strip()
            self.text = None
        elif len(self.path) == 1 and name in ("url", "sitemap"):
            if self.entry.get("loc"):
                self.found.append(("page" if name == "url" else "sitemap", self.entry["loc"], self.entry.get("lastmod") or None))
            self.entry = {}
        self.ended = not self.path


def entries(pieces: Iterator[bytes]) -> Iterator[tuple[str, str, str | None]]:
    """(kind, loc, lastmod) of a sitemap's entries, in order: page or sitemap; where it breaks off, a last one, error, with
    the reason.  Entries before a fault stand; a file without a root tag has none."""
    events = _Events()
    try:
        for text in _document(_decoded(_inflated(pieces))):
            for at in range(0, len(text), PIECE):
                try:
                    events.parser.Parse(text[at : at + PIECE], False)
                except expat.ExpatError:
                    if not events.ended:
                        raise
                found, events.found = events.found, []
                yield from found
                if events.ended:
                    return
        try:
            events.parser.Parse("", True)  # what the parser has put off until more comes
        except expat.ExpatError:
            if events.path:
                raise
        yield from events.found
    except (expat.ExpatError, ValueError, zlib.error, UnicodeError) as e:
        found, events.found = events.found, []
        yield from found
        yield "error", str(e), None


def _pieces(content) -> Iterator[bytes]:
    data = content.encode() if isinstance(content, str) else content or b""
    for at in range(0, len(data), PIECE):
        yield data[at : at + PIECE]


def _read(path: str) -> Iterator[bytes]:
    store, name = _store(path)
    with store.open_input_stream(name, compression=None) as f:
        while piece := f.read(PIECE):
            yield piece


def read_entries(files: DataFrame) -> DataFrame:
    """(url, pos, kind, loc, lastmod): what the sitemaps ``files`` hold, see :func:`entries`.

    ``files`` (url, content) are fetched texts or bytes, or (url, path) files that are opened where they are read; either may be
    compressed.  Null contents hold nothing.
    """
    column = "path" if "path" in files.columns else "content"
    opened = _read if column == "path" else _pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch():
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["url", "pos", "kind", "loc", "lastmod"])
            rows.clear()
            return out

        for b in batches:
            for i in range(len(b)):
                value = b.column(1)[i].as_py()
                if value is None:
                    continue
                url = b.column(0)[i].as_py()
                for n, found in enumerate(entries(opened(value))):
                    rows.append((url, n, *found))
                    if len(rows) >= BATCH:
                        yield batch()
            if rows:
                yield batch()

    return files.select("url", column).mapInArrow(run, SCHEMA)


def sitemap_listing(files: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(url, lastmod, level, sitemap): every page entry of the sitemaps that ``roots`` (url) lead to, over indexes of any
    depth; a page that is listed again has a row each time.

    ``files`` are as for :func:`read_entries`, each read once.  ``level`` is the least number of indexes above the sitemap.
    Indexes may form cycles; the walk ends when no new sitemap is met, or after ``max_depth`` levels.
    """
    found = written(read_entries(files), "entries")
    links = written(found.filter("kind = 'sitemap'").select(F.col("url").alias("src"), F.col("loc").alias("url")).distinct(), "indexes")
    frontier = roots.select("url").filter("url is not null").distinct()
    reached, level = written(frontier.withColumn("level", F.lit(0)), "reached"), 1
    while max_depth is None or level < max_depth:
        last = reached.filter(F.col("level") == level - 1).select(F.col("url").alias("src"))
        fresh = links.join(last, "src").select("url").distinct().join(reached.select("url"), "url", "left_anti").withColumn("level", F.lit(level))
        following = written(reached.unionByName(fresh), "reached")
        discard(reached)
        reached, level = following, level + 1
        if not reached.filter(F.col("level") == level - 1).limit(1).count():
            break
    pages = found.filter("kind = 'page'").select(F.col("url").alias("sitemap"), F.col("loc").alias("url"), "lastmod")
    return pages.join(reached.withColumnRenamed("url", "sitemap"), "sitemap").select("url", "lastmod", "level", "sitemap")


def sitemap_pages(files: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(url, lastmod, level, sitemap): the pages of :func:`sitemap_listing`, one row each.

    ``level`` is the least number of indexes above a page's sitemap, ``sitemap`` the least of those at that level,
    ``lastmod`` the latest that any reached sitemap names.
    """
    held = sitemap_listing(files, roots, max_depth)
    return held.groupBy("url").agg(F.max("lastmod").alias("lastmod"), F.min(F.struct("level", "sitemap")).alias("by")).select("url", "lastmod", "by.level", "by.sitemap")


def sitemap_urls(files: DataFrame, roots: DataFrame, max_depth: int | None = 3, limit: int | None = None) -> DataFrame:
    """(url) of :func:`sitemap_pages`; in URL order where a report's ``limit`` is given."""
    found = sitemap_pages(files, roots, max_depth).select("url")
    return found if limit is None else found.orderBy("url").limit(limit)
