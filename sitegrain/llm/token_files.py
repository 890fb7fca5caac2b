"""Token ids as Arrow files of equal-length sequences.

A shard is one Arrow IPC file whose record batches hold two fixed-size lists, ``tokens`` and ``mask``; every row is a
sequence of the same length, so row r starts at a known offset and a memory map reads it without a copy.  Documents
follow one another without gaps; the last sequence of a shard is padded, with a mask that says so.  Beside it lies an
index file: doc_id, first token, number of tokens.  Shards follow ascending doc_id (null first).
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, open_output, scratch_path, write_atomically

END_ID = 2
SEQUENCE = 2048
BATCH_ROWS = 64
#: Pieces, and parts of pieces, whose ids a worker remembers.
PIECES, PARTS = 900_000, 500_000
_SPACE_RUN = re.compile(r" \s")
#: Characters below this code point are pre-tokenised here; no control signs that Python alone calls white space.
_FIRST_OTHER, _CONTROLS = "\u0250", "\x1c\x1d\x1e\x1f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The byte-level pre-tokenisation rule, for such characters.
_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W_{_NUMBERS}]+| ?[{_NUMBERS}]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def _byte_signs() -> dict[int, str]:
    """The visible sign that byte-level vocabularies write for each byte: itself if printable, else 256 and on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


class _Remembered(dict):
    """The ids of each word with a space before it."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.encoder, self.tokenize, self.space = encoder, encoder.model.tokenize, encoder.signs[32]

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one part, whose signs are the letters themselves
            ids = array("I", [t.id for t in self.tokenize(self.space + word)]).tobytes()
        else:
            ids = self.encoder._piece(" " + word)
        self[word] = ids
        return ids


class PieceEncoder:
    """Ids of whole texts from the tokenizers library, with the ids of each space-led piece remembered.

    Byte-level pre-tokenisation always begins a new token at a space that stands between two non-space characters,
    so the ids of a text are those of its pieces, one after another; a new piece is cut by the same rule and its parts
    go to the library's model.  Texts where a space has white space after it, and pieces with other characters than
    Latin ones or with a special token in them, go to the library whole; so does everything where the vocabulary file
    asks for any rule but these.  Tests hold all of this to the library's own encoding.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        rules = json.loads(tokenizer_json)
        self.special = [t["content"] for t in rules.get("added_tokens", [])]
        before = rules.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        other = any(rules.get(k) for k in ("normalizer", "truncation", "padding")) or any(rules["model"].get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        self.direct = byte_level and not other and rules["model"].get("type") == "BPE" and not any(re.search(r"\s", t) for t in self.special)
        self.signs = _byte_signs()
        self.known = _Remembered(self)
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        if len(self.known) > PIECES:
            self.known = _Remembered(self)
        if len(self.parts) > PARTS:
            self.parts = {}
        known, out, whole = self.known.__getitem__, [], []
        for text in texts:
            if not self.direct or _SPACE_RUN.search(text) or any(c in text for c in _CONTROLS):
                out.append(None)
                whole.append(text)
                continue
            first, *rest = text.split(" ")
            ids = b"".join(map(known, rest))
            out.append(self._piece(first) + ids if first else ids)
        direct = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else ())
        return [array("I", next(direct).ids).tobytes() if x is None else x for x in out]

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() and max(piece) >= _FIRST_OTHER or any(t in piece for t in self.special if t[0] in piece):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        parts, out, tokenize = self.parts, [], self.model.tokenize
        for part in _PRE_TOKEN.findall(piece):
            ids = parts.get(part)
            if ids is None:
                signs = part.encode().decode("latin-1").translate(self.signs)
                ids = parts[part] = array("I", [t.id for t in tokenize(signs)]).tobytes()
            out.append(ids)
        return b"".join(out)


_encoders: dict[int, PieceEncoder] = {}


def _encoder(tokenizer_json: str) -> PieceEncoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders.clear()
        _encoders[key] = PieceEncoder(tokenizer_json)
    return _encoders[key]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text) below ``path``; returns the manifest: shard, file, index, docs,
    tokens, first (tokens in all shards before).  A repeated task attempt replaces its shard whole."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or scratch_path(spark, "tokens", kept=True)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    width = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    shipped = spark.sparkContext.broadcast(tokenizer_json)
    tail = np.array([end_id], "<u4").tobytes()
    value = pa.uint16() if width == "<u2" else pa.uint32()
    schema = pa.schema([("tokens", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoder(shipped.value)
        shard = TaskContext.get().partitionId()
        name = f"{path}/shard-{shard:07d}"
        ids, counts = [], []

        def write(sink):
            held: list[bytes] = []
            size, full = 0, sequence * BATCH_ROWS * 4
            with pa.ipc.new_file(sink, schema) as out:

                def put(data: bytes):
                    tokens = np.frombuffer(data, "<u4").astype(width)
                    rows = -(-len(tokens) // sequence)
                    mask = np.arange(rows * sequence) < len(tokens)
                    tokens = np.concatenate((tokens, np.zeros(rows * sequence - len(tokens), width)))
                    out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(tokens), sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence)], schema=schema))

                for batch in batches:
                    ids.append(batch.column(0))
                    for data in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                        held += (data, tail)
                        counts.append(len(data) // 4 + 1)
                        size += len(data) + 4
                        if size >= full:
                            data = b"".join(held)
                            cut = size // full * full
                            for k in range(0, cut, full):
                                put(data[k : k + full])
                            held, size = [data[cut:]], size - cut
                if size:
                    put(b"".join(held))

        write_atomically(f"{name}.arrow", write)
        if not counts:
            open_output(f"{name}.arrow")[0].delete_file(open_output(f"{name}.arrow")[1])
            return
        n = np.array(counts, np.int64)
        index = pa.table({"doc_id": pa.chunked_array(ids), "first": np.cumsum(n) - n, "n_tokens": n})

        def write_index(sink):
            with pa.ipc.new_file(sink, index.schema) as out:
                out.write_table(index)

        write_atomically(f"{name}.index.arrow", write_index)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{name}.arrow"], "index": [f"{name}.index.arrow"], "docs": [len(n)], "tokens": [int(n.sum())]})

    text = F.col("text").cast("string")
    # the hash parts rows that share an id, or have none, among several tasks
    by = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    ordered = docs.select("doc_id", text.alias("text")).repartitionByRange(*by).sortWithinPartitions(*by)
    manifest = materialize(ordered.mapInArrow(run, "shard long, file string, index string, docs long, tokens long"), "manifest")
    first = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("first", first)


def read_tokens(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_shard(row)

    shards = manifest.select("shard", "file", "index", "first")
    return shards.repartition(max(1, min(manifest.count(), 100_000)), "shard").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def _open(uri: str):
    store, name = open_output(uri)
    return pa.memory_map(name) if store.type_name == "local" else store.open_input_file(name)


class Shard:
    """Random access to the sequences of a shard.

    ``shard[r]`` is (tokens, mask) of row r, wherever it lies: a numpy view and an Arrow array of bits.  Every batch but
    the last has as many rows as the first, so the batch of a row is known without reading others; on a local path
    both are views of the memory map and nothing is copied.
    """

    def __init__(self, uri: str):
        self._source = _open(uri)
        self._reader = pa.ipc.open_file(self._source)
        self._size = self._reader.schema.field("tokens").type.list_size
        self._batches = self._reader.num_record_batches
        self._rows = self._reader.get_batch(0).num_rows if self._batches else 0

    def __len__(self) -> int:
        return (self._batches - 1) * self._rows + self._reader.get_batch(self._batches - 1).num_rows if self._batches else 0

    def __getitem__(self, r: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= r < len(self):
            raise IndexError(r)
        batch = self._reader.get_batch(r // self._rows)
        at = r % self._rows * self._size
        return batch.column(0).values.slice(at, self._size).to_numpy(), batch.column(1).values.slice(at, self._size)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self._source.close()


def sequences(uri: str):
    """The (tokens, mask) numpy views of a shard, a batch at a time; on a local path they are not copied."""
    with _open(uri) as source:
        reader = pa.ipc.open_file(source)
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            size = batch.schema.field("tokens").type.list_size
            yield batch.column(0).flatten().to_numpy().reshape(-1, size), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _read_shard(row: dict):
    with _open(row["index"]) as source:
        index = pa.ipc.open_file(source).read_all()
    counts = index.column("n_tokens").to_numpy()
    stream = (tokens[mask] for tokens, mask in sequences(row["file"]))
    held, at, crcs = np.empty(0, "<u4"), 0, []
    for n in counts.tolist():
        crc, left = 0, n
        while left:
            if at == len(held):
                held, at = next(stream).astype("<u4"), 0
            part = held[at : at + left]
            crc = zlib.crc32(part.tobytes(), crc)
            at += len(part)
            left -= len(part)
        crcs.append(crc)
    starts = index.column("first").to_numpy() + row["first"]
    for k in range(0, len(crcs), 10_000):
        yield pa.RecordBatch.from_arrays([index.column("doc_id").slice(k, 10_000).combine_chunks(), pa.array(starts[k : k + 10_000]), pa.array(counts[k : k + 10_000]), pa.array(crcs[k : k + 10_000], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write, then read back: (doc_id, start, n_tokens, ids_crc32) of every row of ``docs``.

    Ids are those of the library's encoding of the whole text (see :class:`PieceEncoder` for how they are had).
    Null and empty texts have the end id alone; rows of one doc_id follow one another by a hash of their text; null
    ids come first; an empty table writes nothing and gives no rows; further columns are ignored.
    """
    return read_tokens(write_tokens(docs, tokenizer_path, path), docs.schema["doc_id"].dataType.simpleString())
