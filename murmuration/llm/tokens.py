"""Token ids of whole texts by the tokenizers library, and length-delimited record files of them.

File format, little-endian: uint64 payload length, uint32 masked checksum of those 8 bytes, payload, uint32 masked checksum
of the payload. The checksum is CRC-32, masked by rotating right 15 bits and adding 0xA282EAD8, so that a record which
itself holds checksums stays checkable. Payload: int64 document id, uint8 1 if the id is null, uint64 place of the
document's first id within the shard, uint8 width of an id in bytes (2 where the vocabulary allows, else 4), ids.
Beside each shard lies its offset index: per record uint64 offset and uint64 number of ids, for reads in any order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm import files
from murmuration.llm._common import TEXT_ROWS, kept, mapped, work_dir, written

#: Chunks, and characters of chunks, whose ids a Python worker remembers at most. When full it forgets the later half: what came first is mostly what is common.
CACHE, CACHE_CHARS = 320_000, 6_000_000
#: Bytes after which a shard is closed and a new one begun.
SHARD_BYTES = 64 << 20

_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_LATIN = r"A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r",.;:!?$%&#*|"
#: Chunks end only where the byte-level pre-tokenizer ends a piece too, so ids of a text are those of its chunks in turn.
_CHUNKS = re.compile(rf" ?[{_LATIN}]+(?=[{_MARK}{_SPACE}]|\Z)|[{_MARK}]+(?=[{_SPACE}]|\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


#: The sign that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """encode(text) gives the ids that Tokenizer.encode(text, add_special_tokens=False) gives; strings of added tokens become these.

    Each different chunk is encoded once and remembered, which is several times faster than whole texts; only texts that
    hold the string of an added token go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        pre = getattr(self.tokenizer, "pre_tokenizer", None)
        self.chunked = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Remember new chunks. A run of letters is one piece to the pre-tokenizer, so that the library's model can take it as it is, spelt in byte signs."""
        letters = [c for c in chunks if c.isalpha() or c[1:].isalpha() and c[0] == " "] if self.chunked else []
        model, kind = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        for c in letters:
            self.known[c] = array(kind, [t.id for t in model(c.encode().decode("latin-1").translate(_BYTE_SIGNS))]).tobytes()
        rest = [c for c in chunks if c not in self.known]
        self.known.update(zip(rest, self._bytes(rest), strict=True))
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 256):
            part = texts[i : i + 256]
            if not self.chunked:
                yield from (np.frombuffer(x, self.dtype) for x in self._bytes(part))
                continue
            if len(self.known) > CACHE or self.chars > CACHE_CHARS:
                for c in list(islice(self.known, len(self.known) // 2, None)):
                    del self.known[c]
                self.chars = sum(map(len, self.known))
            whole = [any(a in t for a in self.added) for t in part]
            chunks = [() if w else _CHUNKS.findall(t) for t, w in zip(part, whole, strict=True)]
            self._learn(list(set().union(*chunks).difference(self.known)))
            get = self.known.__getitem__
            for t, w, c in zip(part, whole, chunks, strict=True):
                yield np.frombuffer(self._bytes([t])[0] if w else b"".join(map(get, c)), self.dtype)


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return kept(path, lambda: Encoder(path))


def id_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


_HEAD = struct.Struct("<qBQB")


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def read_records(f, at: int = 0, end: int | None = None) -> Iterator[bytes]:
    """Payloads of the records from byte `at` on, checksums checked."""
    f.seek(at)
    while end is None or f.tell() < end:
        head = f.read(12)
        if not head:
            return
        (n,), (c,) = struct.unpack("<Q", head[:8]), struct.unpack("<I", head[8:])
        if masked(head[:8]) != c:
            raise ValueError(f"damaged record length at {f.tell() - 12}")
        payload, tail = f.read(n), f.read(4)
        if len(payload) != n or struct.unpack("<I", tail)[0] != masked(payload):
            raise ValueError(f"damaged record before {f.tell()}")
        yield payload


def record(key: int | None, start: int, ids: np.ndarray) -> bytes:
    return frame(_HEAD.pack(key or 0, key is None, start, ids.dtype.itemsize) + ids.tobytes())


def entry(offset: int, ids: int) -> bytes:
    """A record's place in the index file: byte offset, number of ids."""
    return struct.pack("<QQ", offset, ids)


def unpack(payload: bytes) -> tuple[int | None, int, np.ndarray]:
    """(document id, start within the shard, ids)."""
    doc, null, start, width = _HEAD.unpack_from(payload)
    return None if null else doc, start, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            c = b.slice(i, 1024)
            yield c.column(0).to_pylist(), [t or "" for t in c.column(1).to_pylist()]


SHARDS = "part int, seq int, path string, index string, records long, ids long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write every document's ids and end_id as record files, in ascending order of id; returns the shards, in order by (part, seq).

    Null texts count as empty, null ids come first; rows with the same id stay, dealt and ordered by text hash too, so
    that even one id on most rows is spread. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        tail, shard, seq, done = np.array(end_id, enc.dtype), None, 0, []

        def close() -> None:
            nonlocal shard, seq
            (path, f), (idx_path, idx), records, ids, _ = shard
            f.close(), idx.close()
            done.append((part, seq, path, idx_path, records, ids))
            shard, seq = None, seq + 1

        for keys, texts in _rows(batches):
            for key, ids in zip(keys, enc.encode(texts), strict=True):
                if shard is None:
                    shard = [files.create(folder, f"shard-{part:06d}-{seq:04d}", ".rec"), files.create(folder, f"shard-{part:06d}-{seq:04d}", ".idx"), 0, 0, 0]
                (_, f), (_, idx), records, n, at = shard
                data = record(key, n, np.append(ids, tail))
                f.write(data), idx.write(entry(at, len(ids) + 1))
                shard[2:] = records + 1, n + len(ids) + 1, at + len(data)
                if shard[4] >= SHARD_BYTES:
                    close()
        if shard is not None:
            close()
        if done:
            cols = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "index", "records", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    sorted_rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    return written(mapped(sorted_rows, run, SHARDS), folder, "shards", TEXT_ROWS)


def with_bases(shards: DataFrame) -> DataFrame:
    """Shards with base: the ids of all shards before. Parts are summed first, so that only one small row a part is ordered in one task."""
    parts = shards.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    before = F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.join(parts.select("part", before.alias("before")), "part").withColumn("base", F.col("before") + within).drop("before")


READ = "id long, start long, n_tokens long, ids_crc32 long"


def _out(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    arrays = [pa.array(c, pa.int64()) for c in zip(*[r[:4] for r in rows], strict=True)]
    if with_ids:
        arrays.append(pa.array([r[4].astype(np.int32) for r in rows], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def read_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every record, shard by shard in order of writing; start counts over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                with files.open_at(path) as f:
                    for payload in read_records(f):
                        doc, start, ids = unpack(payload)
                        rows.append((doc, first + start, len(ids), id_crc32(ids), ids))
                        size += len(ids)
                        if len(rows) >= 2000 or size > 4_000_000:
                            yield _out(rows, with_ids)
                            rows, size = [], 0
                if rows:
                    yield _out(rows, with_ids)

    paths = with_bases(shards).select("path", "base")
    return mapped(paths.repartition(max(1, min(shards.count(), 4096)), "path"), run, READ + ", ids array<int>" * with_ids)


def read_index(shards: DataFrame) -> DataFrame:
    """(path, offset, start, n_tokens) of every record, from the index files alone; start counts over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index, first in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with files.open_at(index) as f:
                    entries = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                offset, n = entries.astype(np.int64).T
                start = first + np.cumsum(n) - n
                for i in range(0, len(entries), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(n[part])), *(pa.array(x[part]) for x in (offset, start, n))], names=["path", "offset", "start", "n_tokens"])

    paths = with_bases(shards).select("path", "index", "base")
    return mapped(paths.repartition(max(1, min(shards.count(), 4096)), "path"), run, "path string, offset long, start long, n_tokens long")


def read_shuffled(shards: DataFrame, seed: int, parts: int | None = None, with_ids: bool = False) -> DataFrame:
    """The rows of read_shards in an order that hangs on the seed alone: place (from 0 within each partition) beside them.

    Index entries, not records, are shuffled: each is dealt and ordered by a hash of seed and start, and its record read at
    its offset, with no other byte of the shard. The same documents, seed and parts give the same order, however they were
    dealt into shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, pa.NativeFile] = {}
        place = 0
        try:
            for b in batches:
                rows, size = [], 0
                for path, offset, start, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if path not in open_:
                        if len(open_) >= 64:
                            open_.pop(next(iter(open_))).close()
                        open_[path] = files.open_at(path)
                    doc, _, ids = unpack(next(read_records(open_[path], offset)))
                    if len(ids) != n:
                        raise ValueError(f"index and record differ at {offset} of {path}")
                    rows.append((doc, start, n, id_crc32(ids), ids))
                    size += len(ids)
                    if size > 1_000_000:
                        yield placed(rows, place)
                        place, rows, size = place + len(rows), [], 0
                if rows:
                    yield placed(rows, place)
                    place += len(rows)
        finally:
            for f in open_.values():
                f.close()

    def placed(rows: list[tuple], place: int) -> pa.RecordBatch:
        out = _out(rows, with_ids)
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(np.arange(place, place + len(rows)))], names=[*out.schema.names, "place"])

    entries = read_index(shards).withColumn("lot", F.xxhash64(F.lit(seed), "start"))
    n = parts or int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(n, "lot").sortWithinPartitions("lot", "start").select("path", "offset", "start", "n_tokens")
    return mapped(dealt, run, READ + ", ids array<int>" * with_ids + ", place long")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Write all documents and read them back: (id, start, n_tokens, ids_crc32[, ids]). Empty table: empty result."""
    folder = work_dir(docs.sparkSession)
    return read_shards(write_shards(docs, tokenizer, folder, id_col, text_col, end_id), with_ids)
