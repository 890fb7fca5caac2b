"""Fuzzy line deduplication by MinHash.

A line is compared lower-cased, its tabs and the like as spaces, without outer spaces, as the set of its five-character
shingles from every position, whatever the characters; a shorter line is one shingle.  Lines are similar when the
Jaccard similarity of their sets is 0.8 or more.

Signatures are taken over longer shingles, of nine characters in short lines and twelve in long ones: lines that differ
in a few places still share most of them, unrelated lines hardly any, so that two minimum hashes make a band that
few unrelated lines share.  Eight bands make a signature.  Where every fifth shingle of nine is not shared, as at a
similarity of 0.8 with scattered edits (0.67 over nine characters, 0.58 over twelve), two lines share a band with
probability 0.99 or 0.96.  A short line has sixteen hash functions over all its shingles.  A long line has one hash
function and sixteen bins, and a bin's minimum is its smallest hash; hashes that are surely too large to be a minimum
are left out beforehand.  Lines of a middle length have both signatures, so that similar lines have one in common; long
lines that repeat themselves so much that bins stay empty are signed by their distinct shingles, as both if they are
few.

Lines of few symbols or words - zeros and ones, four letters, a handful of words - have nearly all of the
shingles of five characters that they can have, and hardly share a longer one, however similar they are.  Where fewer than three quarters of a line's
places of five characters are distinct, it also has twelve bands of five minima over its distinct shingles of
five.

Lines that share a band are compared exactly, links go to a distributed union-find, and of every component the first
line stays.  Bands are not expanded into all pairs: every band is known by its least line, and a line goes once to the
group of each such lead.  In a group all lines are compared with the lead, then lines of different components with one
another, less those that an exact bound rules out: of each set a bitmap of 1,024 hashed places is kept, and every place
that one bitmap has and the other lacks is at least one shingle that is not shared.  What stays uncompared lies in one
component or is too far apart, so no link that could join two is lost.  A group returns a spanning forest of its links.
A line that has many left to meet is compared with all of them at once, by counting which lines hold its shingles.
In groups of more than GROUP_LIMIT lines all are first compared with the lead, each on its own.  Those that it links
are one component and need not meet one another; they only meet the rest.  So the rest is cut into chunks, and every
chunk of it meets every other, and every chunk of the linked ones, in a task's group of their own; where all are linked,
nothing more is to do.

The shingles of all positions are hashed, sampled and compared in numpy, over Arrow batches; joins, counts and
components are DataFrame operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, free_prefix, materialize
from .graph import connected_components

SIMILARITY = 0.8
#: Characters of a shingle that is compared, and of those that signatures of short and of long lines are taken over.
SHINGLE, SHORT_SHINGLE, LONG_SHINGLE = 5, 9, 12
ROWS, BANDS = 2, 8
BINS = ROWS * BANDS
#: Lines of up to SHORT_MOST shingles of SHORT_SHINGLE characters have the short signature, those from LONG_LEAST of
#: LONG_SHINGLE on the long one: similar lines differ in length by less than that.
LONG_LEAST, SHORT_MOST = 90, 125
#: Hashes that a bin of a long line keeps, on average, before its minimum is taken.
KEPT = 5
#: A long line with more empty bins than this is signed by its distinct shingles.
EMPTY_BINS = BINS // 3
#: Bands and rows of the signature of a line with few distinct shingles, the share of places below which they are few, and
#: what is looked at first, in lines of so many characters and more: whether it has this share of characters to the shingles
#: that its symbols can make, or the share of its words that are distinct.
FEW_BANDS, FEW_ROWS, FEW_SHARE, FEW_SYMBOLS, FEW_WORDS, FEW_LEAST = 12, 5, 0.75, 0.3, 0.4, 24
#: 64-bit words of a bitmap.
WORDS = 16
#: Characters that are hashed at once.
SLICE = 1 << 18
#: Lines of a group that are compared in one task.
GROUP_LIMIT = 2048
#: A line that may be similar to so many others of its group is compared with all of them at once, by counting.
MANY = 64
#: Hashes of lines that need their texts are broadcast up to this many (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_NONE = np.uint64(0xFFFFFFFF)
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_FEW_SEEDS = np.array([(n + 41) * _BASE % (1 << 64) for n in range(FEW_BANDS * FEW_ROWS)], np.uint64)[:, None]
_BAND_SEEDS = np.array([[(2 * b + 3 + long) * _BASE % (1 << 64) for b in range(BANDS)] for long in (0, 1)], np.uint64)
#: What the first bytes of a word of so many, up to eight, leave of eight bytes.
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Between lines stand more characters than a shingle has, of a code that no text holds.
_GAP = "\U0010ffff" * LONG_SHINGLE


def normal_lines(text: str | None) -> list[str]:
    """The lines of a text as they are compared; a blank line is empty."""
    folded = (text or "").lower()
    for blank in "\t\r\x0b\x0c":
        folded = folded.replace(blank, " ")
    return [line.strip(" ") for line in folded.split("\n")]


def _mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with their bits spread, in place."""
    other = np.empty_like(h)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        np.right_shift(h, np.uint64(shift), out=other)
        np.bitwise_xor(h, other, out=h)
        np.multiply(h, np.uint64(factor), out=h)
    np.right_shift(h, np.uint64(32), out=other)
    return np.bitwise_xor(h, other, out=h)


def _windows(codes: np.ndarray, size: int, mixed: bool = True) -> np.ndarray:
    """The hash of the ``size`` codes from every place on: windows of doubling size are joined.  Where it is not ``mixed``,
    its upper half alone is spread."""

    def join(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        out = left * np.uint64(pow(_BASE, width, 1 << 64))
        return np.add(out, right, out=out)

    length, joined, power, width = 0, None, codes, 1
    while True:
        if size & width:
            joined = power if joined is None else join(joined[: len(power) - length], power[length:], width)
            length += width
        if 2 * width > size:
            joined = joined.copy() if joined is codes else joined
            return _mixed(joined) if mixed else np.multiply(joined, np.uint64(_SPREAD), out=joined)
        power = join(power[:-width], power[width:], width)
        width *= 2


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts) of the lines one after another, a gap behind each."""
    codes = np.frombuffer((_GAP.join(lines) + _GAP).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines)) + LONG_SHINGLE
    return codes, np.concatenate(([0], np.cumsum(lengths)[:-1]))


def _places(lengths: np.ndarray, size: int) -> np.ndarray:
    return np.maximum(lengths - size + 1, 1)


def shingles(lines: list[str], size: int = SHINGLE, mixed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the shingles of every line in order, repeats included."""
    codes, starts = _codes(lines)
    counts = _places(np.fromiter(map(len, lines), np.int64, len(lines)), size)
    at = np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)
    return _windows(codes, size, mixed)[at], counts


def _short_minima(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(lines, BINS): the minima of sixteen functions, halves of eight remixed hashes."""
    out = np.empty((len(counts), BINS), np.uint64)
    first = np.cumsum(counts) - counts
    for b in range(BANDS):
        h = _mixed(hashes + np.uint64((b + 1) * _BASE % (1 << 64)))
        out[:, ROWS * b] = np.minimum.reduceat(h & _NONE, first)
        out[:, ROWS * b + 1] = np.minimum.reduceat(h >> np.uint64(32), first)
    return out


def _long_minima(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS): the least upper half of the hashes, not mixed, in each bin; _NONE where a bin is empty."""
    out = np.full(n * BINS, _NONE, np.uint64)
    np.minimum.at(out, owner * BINS + (_mixed(hashes.copy()) % np.uint64(BINS)).astype(np.int64), hashes >> np.uint64(32))
    return out.reshape(n, BINS)


def _bands(minima: np.ndarray, long: bool) -> np.ndarray:
    """(lines, BANDS): a hash of each band's kind, number and minima, never 0; 0 where a long line's bin is empty."""
    x, y = (np.ascontiguousarray(minima[:, r::ROWS]) for r in range(ROWS))
    h = _mixed(_mixed(x << np.uint64(32) | y) + _BAND_SEEDS[int(long)]) | np.uint64(1)
    return np.where((x == _NONE) | (y == _NONE), np.uint64(0), h) if long else h


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, 2 BANDS + FEW_BANDS): the bands of each line by its short and its long signature and that of few shingles, 0
    where it has none."""
    out, few = np.zeros((len(lines), 2 * BANDS), np.uint64), np.zeros((len(lines), FEW_BANDS), np.uint64)
    held, size = [], 0
    for i in _look_few(lines):
        few[i] = _sign_few(lines[i])
    for i, line in enumerate(lines):
        if len(line) > SLICE:
            out[i] = _sign_one(line)
            continue
        held.append(i)
        size += len(line) + LONG_SHINGLE
        if size > SLICE:
            out[held] = _sign([lines[j] for j in held])
            held, size = [], 0
    if held:
        out[held] = _sign([lines[j] for j in held])
    return np.hstack((out, few))


def _look_few(lines: list[str]) -> list[int]:
    """Which lines may have few distinct shingles: their symbols make few, or they have few distinct words.  Symbols are
    looked at in a part of the line first, which has no more of them than the whole."""
    at = [i for i, line in enumerate(lines) if len(line) >= FEW_LEAST]
    if not at:
        return at
    most = ((np.fromiter((len(lines[i]) for i in at), np.int64, len(at)) / FEW_SYMBOLS) ** (1 / SHINGLE)).tolist()
    found = {i for i, n in zip(at, most) if len(set(lines[i][:FEW_LEAST])) <= n and len(set(lines[i])) <= n}
    return sorted(found.union(at[j] for j in _few_words([lines[i] for i in at])))


def _few_words(lines: list[str]) -> list[int]:
    """Which lines have few distinct words.  Words are first told apart by their length and first eight bytes alone, which
    finds no more of them than there are; the lines that are left are looked at as a whole."""
    _, offsets, data = pa.array(lines, pa.large_string()).buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(lines) + 1]
    data = np.append(np.frombuffer(data, np.uint8)[: offsets[-1]], np.zeros(8, np.uint8))
    blanks = np.flatnonzero(data == ord(" "))
    counts = np.diff(np.searchsorted(blanks, offsets)) + 1
    opens = np.zeros(counts.sum(), bool)
    opens[np.cumsum(counts) - counts] = True
    closes = np.append(opens[1:], True)
    starts, ends = np.empty(len(opens), np.int64), np.empty(len(opens), np.int64)
    starts[opens], starts[~opens], ends[closes], ends[~closes] = offsets[:-1], blanks + 1, offsets[1:], blanks
    sizes = ends - starts
    heads = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))[starts] & _HEADS[np.minimum(sizes, 8)]
    h = _mixed(heads + sizes.astype(np.uint64) * np.uint64(_BASE))
    keys = np.sort(np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(32), counts) | h >> np.uint64(32))
    distinct = np.bincount((keys[np.append(True, keys[1:] != keys[:-1])] >> np.uint64(32)).astype(np.int64), minlength=len(lines))
    limit = counts * FEW_WORDS
    return [j for j in np.flatnonzero((limit > 1) & (distinct <= limit)).tolist() if len(set(lines[j].split(" "))) <= limit[j]]


def _sign_few(line: str) -> np.ndarray:
    """The bands of a line by its distinct shingles; none where these are not few."""
    distinct = np.empty(0, np.uint64)
    for k in range(0, len(line) - SHINGLE + 1, SLICE):
        distinct = np.unique(np.concatenate((distinct, shingles([line[k : k + SLICE + SHINGLE - 1]])[0])))
    out = np.zeros(FEW_BANDS, np.uint64)
    if len(distinct) >= FEW_SHARE * (len(line) - SHINGLE + 1):
        return out
    least = np.full(FEW_BANDS * FEW_ROWS, ~np.uint64(0))
    for k in range(0, len(distinct), 1 << 12):
        least = np.minimum(least, _mixed(distinct[k : k + (1 << 12)] + _FEW_SEEDS).min(axis=1))
    band = _FEW_SEEDS[:FEW_BANDS, 0].copy()
    for r in range(FEW_ROWS):
        band = _mixed(band * np.uint64(_BASE) + least[r::FEW_ROWS])
    return band | np.uint64(1)


def _sign(lines: list[str]) -> np.ndarray:
    out = np.zeros((len(lines), 2 * BANDS), np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    n_short, n_long = _places(lengths, SHORT_SHINGLE), _places(lengths, LONG_SHINGLE)
    short = np.flatnonzero((n_short <= SHORT_MOST) | (n_long < LONG_LEAST))
    if len(short):
        out[short, :BANDS] = _bands(_short_minima(*shingles([lines[i] for i in short], SHORT_SHINGLE)), False)
    long = np.flatnonzero(n_long >= LONG_LEAST)
    if len(long):
        chosen = [lines[i] for i in long]
        codes, starts = _codes(chosen)
        n = n_long[long]
        limit = np.minimum(KEPT * BINS * 2.0**32 / n, 2.0**32).astype(np.uint64)
        ends = np.append(starts[1:], len(codes))
        h = _windows(codes, LONG_SHINGLE, mixed=False)
        spans = np.stack((n, ends - starts - n), axis=1).ravel()  # places of a shingle, then those that reach into the gap
        spans[-1] -= len(codes) - len(h)
        low = np.flatnonzero((h >> np.uint64(32)) < np.repeat(np.stack((limit, np.zeros_like(limit)), axis=1).ravel(), spans))
        minima = _long_minima(h[low], np.repeat(np.arange(len(chosen)), ends - starts)[low], len(chosen))
        out[long, BANDS:] = _bands(minima, True)
        for j in np.flatnonzero((minima == _NONE).sum(axis=1) > EMPTY_BINS):
            out[long[j]] = _sign_distinct(chosen[j])
    return out


def _sign_distinct(line: str) -> np.ndarray:
    """The bands of a line that repeats itself, by its distinct shingles."""
    out = np.zeros(2 * BANDS, np.uint64)
    long, short = (np.unique(shingles([line], size, mixed=size == SHORT_SHINGLE)[0]) for size in (LONG_SHINGLE, SHORT_SHINGLE))
    out[BANDS:] = _bands(_long_minima(long, np.zeros(len(long), np.int64), 1), True)[0]
    if len(short) <= SHORT_MOST:
        out[:BANDS] = _bands(_short_minima(short, np.array([len(short)])), False)[0]
    return out


def _sign_one(line: str) -> np.ndarray:
    """The bands of a line of more than SLICE characters, hashed a part at a time."""

    def parts(size):
        for k in range(0, len(line) - size + 1, SLICE):
            yield shingles([line[k : k + SLICE + size - 1]], size, mixed=size == SHORT_SHINGLE)[0]

    def least(limit):
        minima = np.full((1, BINS), _NONE, np.uint64)
        for h in parts(LONG_SHINGLE):
            low = h[(h >> np.uint64(32)) < limit]
            minima = np.minimum(minima, _long_minima(low, np.zeros(len(low), np.int64), 1))
        return minima

    out = np.zeros(2 * BANDS, np.uint64)
    minima = least(np.uint64(min(KEPT * BINS * 2.0**32 / (len(line) - LONG_SHINGLE + 1), 2.0**32)))
    if (minima == _NONE).sum() > EMPTY_BINS:
        minima, distinct = least(np.uint64(1 << 32)), np.empty(0, np.uint64)
        for h in parts(SHORT_SHINGLE):
            if len(distinct) <= SHORT_MOST:
                distinct = np.unique(np.concatenate((distinct, h)))
        if len(distinct) <= SHORT_MOST:
            out[:BANDS] = _bands(_short_minima(distinct, np.array([len(distinct)])), False)[0]
    out[BANDS:] = _bands(minima, True)[0]
    return out


# -- groups --------------------------------------------------------------------------------------------------------------


def bitmaps(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(lines, WORDS): the hashed places that a line's shingles take."""
    out = np.zeros(len(counts) * WORDS, np.uint64)
    place = (hashes >> np.uint64(20)) % np.uint64(64 * WORDS)
    owner = np.repeat(np.arange(len(counts)) * WORDS, counts)
    np.bitwise_or.at(out, owner + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.reshape(-1, WORDS)


class _Holders:
    """Which of a group's sets hold each value, so that one set is met with all others by counting."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.first = np.cumsum(self.sizes) - self.sizes
        _, self.values = np.unique(np.concatenate(sets), return_inverse=True)
        self.holders = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(self.values, kind="stable")]
        self.counts = np.bincount(self.values)
        self.starts = np.cumsum(self.counts) - self.counts

    def shared(self, i: int) -> np.ndarray:
        """How many values each set shares with the ``i``-th; a part of the values at a time, where many sets hold them."""
        out = np.zeros(len(self.sizes), np.int64)
        values = self.values[self.first[i] : self.first[i] + self.sizes[i]]
        step = max(SLICE // len(self.sizes), 1)
        for k in range(0, len(values), step):
            starts, counts = self.starts[values[k : k + step]], self.counts[values[k : k + step]]
            at = np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)
            out += np.bincount(self.holders[at], minlength=len(out))
        return out


def similar_forest(lines: list[str], groups: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links between lines of one group; ``groups`` numbers them, in order."""
    hashes, counts = shingles(lines)
    marks = bitmaps(hashes, counts)
    first = np.cumsum(counts) - counts
    known: dict[int, np.ndarray] = {}

    def own(i: int) -> np.ndarray:
        """The distinct shingles of a line, in order."""
        if i not in known:
            h = np.sort(hashes[first[i] : first[i] + counts[i]])
            new = h[1:] != h[:-1]
            known[i] = h if new.all() else np.concatenate((h[:1], h[1:][new]))
        return known[i]

    def linked(i: int, j: int) -> bool:
        a, b = own(i), own(j)
        merged = np.sort(np.concatenate((a, b)))
        both = np.count_nonzero(merged[1:] == merged[:-1])
        return both + 1e-9 >= similarity * (len(a) + len(b) - both)

    def in_reach(i, j) -> np.ndarray:
        """Whether bitmaps leave two lines a chance: what one alone has is not shared."""
        x = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=-1, dtype=np.int64)
        return x * (1 + similarity) <= (counts[i] + counts[j]) * (1 - similarity) + 1e-9

    found = []
    label = np.arange(len(lines))
    bounds = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)) if len(groups) else np.empty(0, np.int64)
    sizes = np.diff(np.append(bounds, len(lines)))
    lead = np.repeat(bounds, sizes)
    every, before = np.arange(len(lines)), -1
    for i in np.flatnonzero(in_reach(lead, every) & (lead != every)).tolist():
        if lead[i] != before:  # sets are kept for one group at a time
            known.clear()
            before = int(lead[i])
        if linked(before, i):
            found.append((before, i))
            label[i] = before
    known.clear()
    for start, size in zip(bounds[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own_label, held = label[start : start + size], None
        for i in np.flatnonzero(own_label != start).tolist():
            if own_label[i] == own_label[0]:
                continue
            others = np.flatnonzero(own_label != own_label[i])
            others = others[(others > 0) & ((others > i) | (own_label[others] == own_label[0]))]  # the lead has met all
            if size >= MANY:  # sets of too unequal sizes are left out first
                held = held or _Holders([own(start + j) for j in range(size)])
                others = others[np.minimum(held.sizes[i], held.sizes[others]) + 1e-9 >= similarity * np.maximum(held.sizes[i], held.sizes[others])]
            others = others[in_reach(start + i, start + others)]
            met = len(others) >= MANY  # all at once
            if met:
                both = held.shared(i)[others]
                others = others[both + 1e-9 >= similarity * (held.sizes[i] + held.sizes[others] - both)]
            for j in others.tolist():
                if own_label[j] != own_label[i] and (met or linked(start + i, start + j)):
                    found.append((start + i, start + j))
                    least, most = sorted((int(own_label[i]), int(own_label[j])))
                    own_label[own_label == most] = least
        known.clear()
    return found


def similar_lines(docs: DataFrame, uses: DataFrame, groups: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between the ids of ``groups`` (k, m, id) that join every two candidate lines of ``docs`` of at least
    ``similarity``, directly or over others; ``uses`` (k, bands) has their bands."""
    spark = docs.sparkSession
    banded = uses.filter(F.size("bands") > 0).select("k", F.explode("bands").alias("band"))
    shared = banded.repartition("band").groupBy("band").agg(F.min("k").alias("lead"), F.max("k").alias("_last")).filter("lead <> _last").drop("_last")
    shared = materialize(shared, "shared-bands")
    spokes = materialize(banded.join(shared, "band").select("lead", "k").distinct(), "spokes")
    sizes = materialize(spokes.groupBy("lead").agg(F.count(F.lit(1)).alias("n")), "sizes")
    wanted = materialize(spokes.select("k").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    ids = groups.select("k", "m", "id").join(F.broadcast(wanted) if few else wanted, "k", "left_semi")
    lines = _texts(docs, np.sort(wanted.toArrow().column("k").to_numpy()) if few else None)
    lines = lines if few else lines.join(wanted, "k", "left_semi")
    texts = materialize(lines.dropDuplicates(["k", "m"]).join(ids, ["k", "m"]).select("k", "id", "line"), "texts")
    bounded_batches(spark)
    small = spokes.join(sizes.filter(F.col("n") <= GROUP_LIMIT), "lead").join(texts, "k").select("lead", "id", "line", (F.col("k") != F.col("lead")).alias("later"), F.lit(-1).cast("long").alias("part"))
    met = large_links = None
    if sizes.filter(F.col("n") > GROUP_LIMIT).limit(1).count():
        met = meet_lead(spokes.join(sizes.filter(F.col("n") > GROUP_LIMIT), "lead").join(texts, "k"), similarity)
        large_links = met.filter("linked and id <> lead_id").select(F.col("lead_id").alias("u"), F.col("id").alias("v"))
        small = small.unionByName(meet_rest(met).join(texts.select("id", "line"), "id"))
    keyed = small.select(F.xxhash64("lead", "part").alias("key"), "later", "id", "line").repartition("key").sortWithinPartitions("key", "later", "id")

    def run(batches):
        held: list[list] = [[], [], []]

        def close(upto: int):
            """The links among the first ``upto`` held rows, which are whole groups."""
            keys, ids, texts = (x[:upto] for x in held)
            for x in held:
                del x[:upto]
            u, v = [], []
            for a, b in _parts(keys, texts):
                for i, j in similar_forest(texts[a:b], _numbered(keys[a:b]), similarity):
                    u.append(ids[a + i])
                    v.append(ids[a + j])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for x, column in zip(held, (0, 2, 3)):
                x += batch.column(column).to_pylist()
            last = len(held[0])
            while last and held[0][last - 1] == held[0][-1]:  # the last group may go on
                last -= 1
            if last:
                yield close(last)
        if held[0]:
            yield close(len(held[0]))

    links = keyed.mapInArrow(run, "u long, v long")
    found = materialize((links if large_links is None else links.unionByName(large_links)).distinct(), "links")
    for table in (shared, spokes, sizes, wanted, texts, *([] if met is None else [met])):
        discard(table)
    return found


def meet_lead(members: DataFrame, similarity: float = SIMILARITY, salts: int = 64) -> DataFrame:
    """(lead, id, lead_id, linked): every line of a group compared with its lead; ``members`` are (lead, k, id, line)."""
    own = members.filter("k = lead").groupBy("lead").agg(F.min(F.struct("id", "line")).alias("own"))
    copies = own.select("lead", F.col("own.id").alias("lead_id"), F.col("own.line").alias("lead_line"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt = members.select("lead", "id", "line", F.pmod("id", F.lit(salts)).cast("int").alias("salt"))
    rows = dealt.join(copies, ["lead", "salt"]).select("lead", "id", "line", "lead_id", "lead_line")

    def run(batches):
        for batch in batches:
            at: dict[int, list[int]] = {}
            for i, lead in enumerate(batch.column(3).to_pylist()):
                at.setdefault(lead, []).append(i)
            linked = np.zeros(len(batch), bool)
            for where in at.values():
                lines = [batch.column(4)[where[0]].as_py(), *batch.column(2).take(pa.array(where)).to_pylist()]
                for a, b in _parts(list(range(len(lines))), lines):
                    part = lines[a:b] if a == 0 else [lines[0], *lines[a:b]]
                    first = np.array(where)[max(a - 1, 0) : b - 1]
                    linked[first] = _like_first(part, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(linked)], ["lead", "id", "lead_id", "linked"])

    return materialize(rows.mapInArrow(run, "lead long, id long, lead_id long, linked boolean"), "met")


def _like_first(lines: list[str], similarity: float) -> np.ndarray:
    """Whether each line but the first is similar to the first."""
    hashes, counts = shingles(lines)
    first = np.cumsum(counts) - counts
    lead = np.unique(hashes[: counts[0]])
    out = np.zeros(len(lines) - 1, bool)
    for i in range(1, len(lines)):
        own = np.unique(hashes[first[i] : first[i] + counts[i]])
        both = len(np.intersect1d(lead, own, assume_unique=True))
        out[i - 1] = both + 1e-9 >= similarity * (len(lead) + len(own) - both)
    return out


def meet_rest(met: DataFrame) -> DataFrame:
    """(lead, id, later, part): where the lines of large groups meet those that are not linked to their lead."""
    n = met.groupBy("lead").agg(F.count_if(~F.col("linked")).alias("rest"), F.count_if("linked").alias("linked_n")).filter("rest > 0")
    pieces = n.select("lead", F.ceil(F.col("rest") / GROUP_LIMIT).cast("int").alias("a"), F.ceil(F.col("linked_n") / GROUP_LIMIT).cast("int").alias("b"))
    own = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.when(F.col("linked"), F.col("b")).otherwise(F.col("a"))).cast("long")
    until = lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(c, F.lit(1)) - 1), lambda x: x < c), lambda x: x.cast("long"))
    cell = lambda x, y: x * 1_000_000_000 + y
    with_rest = F.transform(until(F.col("a")), lambda c: cell(F.least(c, own), F.greatest(c, own)))
    with_linked = F.transform(until(F.col("b")), lambda c: cell(own, F.col("a") + c))
    of_linked = F.transform(until(F.col("a")), lambda c: cell(c, F.col("a") + own))
    parts = F.when(F.col("linked"), of_linked).otherwise(F.concat(with_rest, with_linked))
    return met.join(pieces, "lead").select("lead", "id", F.lit(True).alias("later"), F.explode(parts).alias("part"))


def _parts(keys: list[int], texts: list[str]):
    """(start, end) of runs of whole groups with about SLICE characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size > SLICE and keys[i] != keys[i - 1]:
            yield start, i
            start, size = i, 0
        size += len(text) + LONG_SHINGLE
    yield start, len(texts)


def _numbered(keys: list[int]) -> np.ndarray:
    """The groups of rows, numbered in their order."""
    changed = np.diff(np.array(keys, np.int64), prepend=np.array(keys[:1], np.int64)) != 0
    return np.cumsum(changed)


def _hashes(line: str) -> tuple[int, int]:
    data = line.encode("utf-8", "surrogatepass")
    return xxhash.xxh64_intdigest(data), xxhash.xxh64_intdigest(data, 1)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _texts(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(k, m, line) of the lines whose k is among the sorted ``wanted``, or of all, once a batch."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        among = shipped.value
        for batch in batches:
            lines = list(dict.fromkeys(line for text in batch.column(0).to_pylist() if text for line in normal_lines(text) if line))
            pairs = [_hashes(line) for line in lines]
            k, m = (np.array([p[x] for p in pairs], np.uint64).view(np.int64) for x in (0, 1))
            if among is not None:
                at = np.flatnonzero(among[np.minimum(np.searchsorted(among, k), len(among) - 1)] == k) if len(among) else np.empty(0, np.int64)
                k, m, lines = k[at], m[at], [lines[i] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m), pa.array(lines, pa.string())], ["k", "m", "line"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "k long, m long, line string")


def _uses(docs: DataFrame) -> DataFrame:
    """(row, doc_id, no, k, m, bands) of every line, written once so that row numbers are fixed.  Blank lines are left
    out, a text without lines has one row without k, and of lines that a batch repeats the first has the bands."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows, numbers, k, m, new = [], [], [], [], []
            distinct: dict[str, tuple[int, int]] = {}
            for row, text in enumerate(batch.column(2).to_pylist()):
                before = len(rows)
                for no, line in enumerate(normal_lines(text) if text else ()):
                    if not line:
                        continue
                    pair = distinct.get(line)
                    new.append(pair is None)
                    if pair is None:
                        pair = distinct[line] = _hashes(line)
                    rows.append(row)
                    numbers.append(no)
                    k.append(pair[0])
                    m.append(pair[1])
                if len(rows) == before:
                    rows.append(row)
                    numbers.append(None)
                    k.append(0)
                    m.append(0)
                    new.append(False)
            signed = signatures(list(distinct))
            sizes = np.zeros(len(rows), np.int64)
            sizes[np.array(new, bool)] = (signed != 0).sum(axis=1)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(signed[signed != 0].view(np.int64)))
            blank = pa.array([n is None for n in numbers])
            taken = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            nothing = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(numbers, pa.int32()), pc.if_else(blank, nothing, _signed(k)), pc.if_else(blank, nothing, _signed(m)), bands], ["row", "doc_id", "no", "k", "m", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string"))
    return materialize(numbered.mapInArrow(run, f"row long, doc_id {kind}, no int, k long, m long, bands array<bigint>"), "lines")


# -- on tables ------------------------------------------------------------------------------------------------------------


def _classes(docs: DataFrame, uses: DataFrame, similarity: float) -> DataFrame:
    """(row, doc_id, no, component, first) of the uses in components of more than one use; ``first`` marks the one that
    stays, by doc_id (null last), row and number."""
    each = uses.filter("k is not null")
    groups = materialize(each.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "line-groups")
    found = connected_components(similar_lines(docs, uses, groups, similarity))
    named = groups.join(found.withColumnRenamed("node", "id"), "id", "left").filter("n > 1 or component is not null")
    classes = materialize(named.select("k", "m", F.coalesce("component", "id").alias("component")), "line-classes")
    placed = materialize(each.select("row", "doc_id", "no", "k", "m").join(classes, ["k", "m"]).drop("k", "m"), "placed")
    # written, so that the join can split the lines of a hot component
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row", "no")
    best = materialize(placed.groupBy("component").agg(F.min(place).alias("best")), "first-lines")
    stays = (F.col("row") == F.col("best.row")) & (F.col("no") == F.col("best.no"))
    return placed.join(best, "component").select("row", "doc_id", "no", "component", stays.alias("first"))


def judge_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row, doc_id, no, kept, component) for every line that is not blank of every row of ``docs``.

    Equal and similar lines form components; the first line of each, by doc_id (null last), row and number, stays.
    The component of a line that has no other is null.  Null and empty texts give no rows; rows that repeat are rows of
    their own; an empty table gives none; further columns are ignored.
    """
    uses = _uses(docs)
    judged = _classes(docs, uses, similarity).drop("doc_id")
    return uses.filter("k is not null").select("row", "doc_id", "no").join(judged, ["row", "no"], "left").select("row", "doc_id", "no", F.coalesce("first", F.lit(True)).alias("kept"), "component")


def deduplicated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_kept, dropped) for every row of ``docs`` (doc_id, text).

    ``n_lines`` counts lines that are not blank, ``dropped`` lists the numbers (from 0, blank lines counted) of the
    lines that go, comma-joined.  Null and empty texts have no lines; blank lines are never compared; rows that
    repeat are rows of their own, and the later one's lines go; an empty table gives no rows; further columns are
    ignored.
    """
    uses = _uses(docs)
    gone = _classes(docs, uses, similarity).filter("not first").groupBy("row").agg(F.array_sort(F.collect_list("no")).alias("gone"))
    rows = uses.groupBy("row", "doc_id").agg(F.count("k").alias("n_lines")).join(gone, "row", "left")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - n_gone).alias("n_kept"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with their texts less the lines that go.  ``docs`` must give its rows in the same order when it is read
    again, as stored tables do."""
    p = free_prefix(docs)
    row, out = p + "row", p + "gone"
    gone = judge_lines(docs, similarity).filter("not kept").groupBy(F.col("row").alias(row)).agg(F.collect_set("no").alias(out))
    rows = docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col(out), i))
    return rows.withColumn("text", F.when(F.col(out).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
