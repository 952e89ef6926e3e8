"""SimHash near-duplicate detection with anchor-point covering.

A fingerprint is 64 bits of majority votes over word shingles. Two fingerprints that differ in at most 3 bits differ in
at most one bit in one of their two halves. In each half the anchors are the words of the perfect Hamming code of length
31: covering radius 1, so that every half has one home anchor, and those within 1 + 1 bits are the home anchors of all
halves one bit away. Fingerprints go to these anchors and are compared there, all 64 bits at a time. Two halves one bit
apart have different parity, so only the odd ones need to visit others: 1 or 16 rows for a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm._common import TEXT_ROWS, drop, join_groups, located, mapped, without, work_dir, written
from murmuration.llm.components import connected_components

SEED = 42
MAX_BITS = 3
#: Rows of one anchor that are compared in one task; a larger anchor is split into pairs of such blocks.
BLOCK = 8192


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles in order, repeats included: A-Z lowered, words split at ASCII white space.

    Fewer words than a shingle: the whole sequence is the shingle. Null or no words: none.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    flat = b" ".join(w)
    ends = [x - 1 for x in accumulate(len(x) + 1 for x in w)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(w) <= words:
        return np.array([digest(flat, seed)] if w else [], "<u8")
    starts = [0, *[x + 1 for x in ends]]
    return np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)), "<u8", len(w) - words + 1)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of one text: a bit is set if more than half of the shingle hashes have it. Null or no words: 0."""
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)  # eight byte counters a word, none overflows
        bits += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp the fingerprint as a signed long, for every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, fp long")


_POS = np.arange(1, 32, dtype=np.uint32)
_BIT = np.concatenate([[0], np.uint32(1) << (_POS - 1)]).astype(np.uint32)  # of a position; none for 0


def _syndrome(half: np.ndarray) -> np.ndarray:
    s = np.zeros(len(half), np.uint32)
    for p in range(1, 32):
        s ^= ((half >> np.uint32(p - 1)) & np.uint32(1)) * np.uint32(p)
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Halves (31 bits, uint32) -> (index of the half, anchor): the home anchor, and for odd halves those of all neighbours."""
    s = _syndrome(half)
    home = half ^ _BIT[s]
    index, where = [np.arange(len(half))], [home]
    odd = np.flatnonzero((np.bitwise_count(half) & 1).astype(bool) & (s != 0))
    if len(odd):
        j = _POS[None, :]
        other = s[odd][:, None] ^ j
        take = j < other  # each pair of positions once; position s itself leads home
        index.append(np.repeat(odd, take.sum(axis=1)))
        where.append((half[odd][:, None] ^ _BIT[j] ^ _BIT[other])[take])
    return np.concatenate(index), np.concatenate(where)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            c = b.slice(at, 4096)
            fp, rep = c.column(0).to_numpy(zero_copy_only=False).view(np.uint64), c.column(1).to_numpy(zero_copy_only=False)
            for side in (0, 1):
                half = ((fp >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
                i, a = anchors(half)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64) | (side << 31)), pa.array(fp[i].view(np.int64)), pa.array(rep[i])], names=["anchor", "fp", "rep"])


def spanning_links(fp: np.ndarray, rep: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components that links of at most `bits` differing bits make among these fingerprints."""
    order = np.argsort(rep, kind="stable")
    fp, rep = fp[order], rep[order]
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(fp[left] ^ fp[front.pop()]) <= bits
            if near.any():
                got = left[near]
                a.append(np.full(len(got), rep[root])), b.append(rep[got])
                front += got.tolist()
                left = left[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, block): runs of the same are compared; a run may go on in the next batch and has at most 2 BLOCK rows or so."""
    rest: tuple[np.ndarray, ...] | None = None

    def links(key: tuple[np.ndarray, ...], fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]) if len(fp) else np.empty(0, bool)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        run = np.repeat(np.arange(len(start)), size)
        few = np.repeat(size <= 12, size)
        for step in range(1, int(min(12, size.max(initial=1)))):
            same = (run[step:] == run[:-step]) & few[step:]
            i = np.flatnonzero(same)
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= MAX_BITS]
            a.append(rep[i]), b.append(rep[i + step])
        for at, n in zip(start[size > 12], size[size > 12], strict=True):
            x, y = spanning_links(fp[at : at + n], rep[at : at + n])
            a.append(x), b.append(y)
        none = [np.empty(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        rest = tuple(c[cut:] for c in cols)
        yield links((cols[0][:cut], cols[1][:cut]), cols[2][:cut].view(np.uint64), cols[3][:cut])
    if rest is not None:
        yield links((rest[0], rest[1]), rest[2].view(np.uint64), rest[3])


def fingerprint_links(distinct: DataFrame, folder: str) -> DataFrame:
    """Distinct fingerprints (fp, rep) -> links (a, b) between reps; a forest of each anchor's links, so that no link is lost in the closure.

    An anchor with more than BLOCK rows is split: its rows are dealt into blocks by hash, and every pair of blocks meets
    in a task of its own, so that a task never holds more than two blocks.
    """
    rows = mapped(distinct.select("fp", "rep"), _replicate, "anchor long, fp long, rep long")
    rows = written(rows, folder, "anchors")
    big = written(rows.groupBy("anchor").count().where(F.col("count") > BLOCK).select("anchor", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), folder, "big_anchors")
    if big.head(1):
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.least(i, own) * F.col("blocks") + F.greatest(i, own))
        rows = rows.join(big, "anchor", "left").select("anchor", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("block"), "fp", "rep")
    else:
        rows = rows.select("anchor", F.lit(0).alias("block"), "fp", "rep")
    return mapped(rows.repartition("anchor", "block").sortWithinPartitions("anchor", "block"), _compare, "a long, b long")


#: Bins of a similarity sketch (four bits each), mean shingles of a piece, rows of one piece or component compared all with all, bytes of shingles of such rows.
BINS, PIECE, DENSE, DENSE_BYTES = 256, 12, 2048, 16 << 20
#: Least share of pieces that documents of similarity 0.8 are taken to have in common; about 0.63 is usual.
SHARED = 0.4
#: Texts of so many shingles at most meet by single shingles, of which no like pair can escape.
SHORT = 128
#: What an agreement may fall short of the similarity asked for and still be checked; its standard error at 0.8 is 0.028 for long texts, less for texts of few shingles.
SLACK = 0.1


def sketch(h: np.ndarray) -> np.ndarray:
    """One-permutation MinHash, two bins a byte: of each bin (low bits of a hash) 1 + the least high part modulo 15; 0 if empty."""
    least = np.full(BINS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(least, (h % BINS).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32))
    value = np.where(least == 0xFFFFFFFF, 0, 1 + least % 15).astype(np.uint8)
    return value[::2] | value[1::2] << 4


class Sketches:
    """Some packed sketches, unpacked for comparison."""

    def __init__(self, packed: np.ndarray) -> None:
        self.value = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), BINS)
        self.some = np.packbits(self.value > 0, axis=1).view(np.uint64)
        self.size = np.bitwise_count(self.some).sum(axis=1, dtype=np.int64)

    def agreement(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity of each row of a with the row of b beside it; one of them may be a single row."""
        both = np.bitwise_count(self.some[a] & self.some[b]).sum(axis=1, dtype=np.int64)
        same = np.count_nonzero((self.value[a] == self.value[b]) & (self.value[a] > 0), axis=1)
        # of the bins that truly differ one in fifteen looks alike
        return np.maximum(0, same - (both - same) / 14) / np.maximum(1, self.size[a] + self.size[b] - both)


def alike_links(ids: np.ndarray, sketches: Sketches, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components that links of an agreement of at least `least` make among these rows."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left = rows
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = sketches.agreement(np.array([front.pop()]), left) >= least
            if near.any():
                got = left[near]
                a.append(np.full(len(got), ids[root])), b.append(ids[got])
                front += got.tolist()
                left = left[~near]
    return np.concatenate(a), np.concatenate(b)


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (piece, block, id, sketch) sorted by the first two: runs of the same are compared; a run may go on in the next batch and has at most 2 DENSE rows or so."""
    rest: tuple[np.ndarray, ...] | None = None

    def links(piece: np.ndarray, block: np.ndarray, ids: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        start = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (block[1:] != block[:-1])])) if len(ids) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(ids)))
        run, few = np.repeat(np.arange(len(start)), size), np.repeat(size <= 8, size)
        for at in range(0, len(ids), 8192):  # short runs, many at once
            s = Sketches(packed[at : at + 8200])
            for step in range(1, 8):
                i = at + np.arange(min(8192, len(ids) - step - at))
                i = i[(run[i] == run[i + step]) & few[i]]
                i = i[s.agreement(i - at, i - at + step) >= least]
                a.append(ids[i]), b.append(ids[i + step])
        for at, n in zip(start[size > 8], size[size > 8], strict=True):
            x, y = alike_links(ids[at : at + n], Sketches(packed[at : at + n]), np.arange(n), least)
            a.append(x), b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        packed = batch.column(3)
        flat = np.frombuffer(packed.buffers()[2], np.uint8)[packed.offset * BINS // 2 :][: batch.num_rows * BINS // 2] if batch.num_rows else np.empty(0, np.uint8)
        cols = [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), flat.reshape(-1, BINS // 2)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        rest = tuple(c[cut:] for c in cols)
        yield links(*(c[:cut] for c in cols))
    if rest is not None:
        yield links(*rest)


def piece_keys(h: np.ndarray) -> np.ndarray:
    """Keys of the pieces between shingles whose hash is divisible by PIECE: edits change the pieces they lie in, no others."""
    cuts = np.flatnonzero(h % PIECE == 0).tolist()
    data, digest = h.tobytes(), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(data[8 * a : 8 * b]) for a, b in zip([0, *cuts], [*cuts, len(h)], strict=True) if a < b], np.uint64))


def short_set(h: np.ndarray) -> np.ndarray:
    """A text's different shingles by the upper 32 bits of their hashes."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def _profiles(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    none = np.empty(0, np.int64)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                hs = [shingle_hashes(t.as_py(), words) for t in c.column(1)]
                sets = [np.unique(h) for h in hs]
                keys = [f"{majority(h):016x}{xxhash.xxh3_128_hexdigest(s.tobytes())}" for h, s in zip(hs, sets, strict=True)]
                pieces = [piece_keys(h).view(np.int64) if len(s) > SHORT else none for h, s in zip(hs, sets, strict=True)]
                singles = [s.view(np.int64) if len(s) <= SHORT / similarity else none for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), pa.array(keys), pa.array(np.array([int(k[:16], 16) for k in keys], np.uint64).view(np.int64)), pa.array([sketch(h).tobytes() for h in hs], pa.binary()), pa.array(pieces, pa.list_(pa.int64())), pa.array(singles, pa.list_(pa.int64())), pa.array([short_set(h).tobytes() for h in hs], pa.binary())],
                    names=["id", "key", "fp", "sketch", "pieces", "singles", "shingles"],
                )

    return mapped(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, key string, fp long, sketch binary, pieces array<long>, singles array<long>, shingles binary").withColumn("row", F.monotonically_increasing_id())


def true_links(ids: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components that links of Jaccard similarity of at least `least` make among these sets; empty sets are alike."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(ids) < 2:
        return a[0], b[0]
    size = np.array([len(x) for x in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start, mark, left = np.cumsum(size) - size, np.zeros(len(values), np.int64), np.arange(len(ids))
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            n = front.pop()
            own = flat[start[n] : start[n] + size[n]]
            mark[own] = 1
            fit = np.flatnonzero((size[left] >= least * size[n] - 1e-9) & (size[n] >= least * size[left] - 1e-9))
            common = np.fromiter((mark[flat[start[k] : start[k] + size[k]]].sum() for k in left[fit]), np.int64, len(fit))
            mark[own] = 0
            near = fit[common >= least * (size[left[fit]] + size[n] - common) - 1e-9]
            if len(near):
                got = left[near]
                a.append(np.full(len(got), ids[root])), b.append(ids[got])
                front += got.tolist()
                left = np.delete(left, near)
    return np.concatenate(a), np.concatenate(b)


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (group, block, id, shingles) sorted by the first two: those of one block are compared."""
    key, ids, sets = None, [], []
    for batch in batches:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        group, block, own = (batch.column(i).to_pylist() for i in range(3))
        for n in range(batch.num_rows):
            if (group[n], block[n]) != key:
                x, y = true_links(np.array(ids, np.int64), sets, least)
                a.append(x), b.append(y)
                key, ids, sets = (group[n], block[n]), [], []
            ids.append(own[n]), sets.append(np.frombuffer(batch.column(3)[n].as_py(), np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    a, b = true_links(np.array(ids, np.int64), sets, least)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _compared(rows: DataFrame, cargo: DataFrame, compare, known: DataFrame, folder: str, name: str) -> DataFrame:
    """Links (a, b) that compare() finds between rows (id, group, blocks, n) of one group; cargo (id, c) is what it compares.

    A group of several blocks is dealt by hash. First every block is compared in itself. Where these links, with the known
    ones, make one component of a group's rows, nothing is left to find there; else the rows outside its largest component,
    in blocks too, meet all others, each pair of blocks in a task of its own. So a large group of near copies moves its
    rows once, and no pair of rows that are not yet linked goes unseen.
    """

    def links(dealt: DataFrame) -> DataFrame:
        meet = dealt.join(cargo.hint("merge"), "id").select("group", "block", "id", "c").repartition("group", "block").sortWithinPartitions("group", "block")
        return mapped(meet, compare, "a long, b long")

    own = lambda blocks: F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    first = written(links(rows.select("id", "group", own(F.col("blocks")).alias("block"))), folder, f"{name}_links")
    big = written(rows.where("blocks > 1"), folder, f"{name}_big")
    if not big.head(1):
        return first
    roots = connected_components(known.union(first), f"{folder}/{name}_known")
    at = big.join(roots, F.col("id") == F.col("node"), "left").select("id", "group", "blocks", "n", F.coalesce("root", "id").alias("root"))
    at = written(at, folder, f"{name}_at")
    sizes = at.groupBy("group", "root").agg(F.count("*").alias("size"), F.first("n").alias("n"), F.first("blocks").alias("blocks"))
    tops = sizes.groupBy("group").agg(F.max(F.struct("size", "root")).alias("top"), F.first("n").alias("n"), F.first("blocks").alias("tops"))
    strays = F.col("n") - F.col("top.size")
    tops = written(tops.select("group", "n", "tops", F.col("top.root").alias("main"), F.ceil(strays * F.col("tops") / F.col("n")).cast("int").alias("strays")), folder, f"{name}_tops")
    at = join_groups(at.select("id", "group", "root"), tops.withColumn("rows", F.col("n")), "group", "rows", at.count()).where("strays > 0")
    t, s = F.col("tops"), F.col("strays")
    among = F.transform(F.sequence(F.lit(0), s - 1), lambda i: F.least(i, own(s)) * s + F.greatest(i, own(s)))
    to_main = F.transform(F.sequence(F.lit(0), t - 1), lambda i: s * s + own(s) * t + i)
    to_strays = F.transform(F.sequence(F.lit(0), s - 1), lambda i: s * s + i * t + own(t))
    second = at.select("id", "group", F.explode(F.when(F.col("root") == F.col("main"), to_strays).otherwise(F.concat(among, to_main))).alias("block"))
    return first.union(written(links(second), folder, f"{name}_more"))


def _meetings(reps: DataFrame, near: DataFrame, folder: str, similarity: float) -> DataFrame:
    """Links (a, b) of rows (id, sketch, pieces, singles) that meet in a piece or a shingle and whose sketches agree up to SLACK, as far as they are needed beside the links `near`."""
    family = lambda c, share: F.struct(F.lit(share).alias("share"), F.col(c).alias("keys"))
    held = reps.select("id", F.explode(F.array(family("pieces", SHARED), family("singles", similarity))).alias("f")).select("id", "f.share", F.size("f.keys").alias("total"), F.explode("f.keys").alias("piece"))
    often = written(held.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1"), folder, "pieces")
    counted = join_groups(held, often.withColumn("times", F.col("n")), "piece", "n", held.count(), grows=True, listed=True).where("times is not null")
    # a like document shares that part of the pieces, so one of them is among the rarest others and one more, those of no other document first
    shared = counted.groupBy("id", "share").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("times", "piece"))).alias("p"))
    first = F.col("total") - F.ceil(F.col("total") * F.col("share") - 1e-9) + 1 - (F.col("total") - F.size("p"))
    rarest = shared.select("id", F.explode(F.slice("p", F.lit(1), F.greatest(F.lit(0), first).cast("int"))).alias("q")).select("id", F.col("q.piece").alias("piece"))
    # a piece counts where two documents have it among their rarest
    rarest = written(rarest, folder, "rarest")
    often = rarest.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece", "n", F.col("n").alias("times"), F.ceil(F.col("n") / DENSE).cast("int").alias("blocks"))
    held = join_groups(rarest, written(often, folder, "rarest_pieces"), "piece", "times", rarest.count(), grows=True, listed=True).where("blocks is not null").withColumnRenamed("piece", "group")
    return _compared(held, reps.select("id", F.col("sketch").alias("c")), lambda it: _alike(it, similarity - SLACK), near, folder, "pieces")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component): documents linked by a Jaccard similarity of their word shingles of at least `similarity`; component is the smallest id.

    Candidates are documents whose fingerprints differ in at most 3 bits, by anchors, and, as a few percent of other words
    move more bits, those that meet by their rarest pieces (runs of a dozen shingles, in texts of SHORT shingles at most
    single ones), counted over all documents, as many as two that share SHARED of their pieces, or that similarity of
    their shingles, must have one in common, and whose sketches agree up to SLACK. Within the
    candidates' components whole sets of shingles are compared, so that every link that counts is true (but for equal 32-bit
    hashes, a shingle in some texts of tens of thousands of words); a component of more than DENSE documents or
    DENSE_BYTES of shingles is split into pairs of blocks.

    Ids are of any type that has an order. Null ids are left out; null, empty and blank texts are alike. Every row is a
    document: rows that repeat an id have a component each. Whole texts. Other columns are not read. Empty table: empty
    result.
    """
    folder = work_dir(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(_profiles(texts, words, similarity), folder, "profiles", TEXT_ROWS)
    # of the rows with the same shingles one speaks for all
    groups = rows.groupBy("key", "fp").agg(F.min(F.struct("id", "row")).alias("first"), F.max(F.octet_length("shingles")).alias("bytes"), F.count("*").alias("n"))
    groups = written(groups.select("key", "fp", F.col("first.row").alias("rep"), F.col("first.id").alias("id"), "bytes", "n"), folder, "groups")
    near = written(fingerprint_links(groups, folder), folder, "near")
    drop(docs.sparkSession, folder, "anchors", "big_anchors")
    # rows that another speaks for go where they are; no sketch moves
    n, at = rows.count(), located(rows, "place", folder)
    others = join_groups(at.select("row", "key", "place"), groups.where("n > 1").select("key", "rep", "n"), "key", "n", n).where("row != rep").select("place.*")
    reps = without(at.select(F.col("row").alias("id"), "sketch", "pieces", "singles", "place"), "place", others, f"{folder}/others")
    reps = written(reps, folder, "reps")
    maybe = connected_components(near.union(_meetings(reps, near, folder, similarity)), f"{folder}/maybe")
    drop(docs.sparkSession, folder, "reps", "pieces", "rarest", "rarest_pieces", "pieces_big", "pieces_at")
    members = maybe.union(maybe.select("root", "root").distinct()).toDF("rep", "group")
    members = written(members.join(groups.select("rep", "bytes"), "rep"), folder, "members")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.count("*").alias("times"), F.greatest(F.ceil(F.count("*") / DENSE), F.ceil(F.sum("bytes") / DENSE_BYTES)).cast("int").alias("blocks"))
    dealt = join_groups(members, written(sizes, folder, "sizes"), "group", "times", members.count()).select(F.col("rep").alias("id"), "group", "blocks", "n")
    none = near.where("false")
    true = _compared(dealt, rows.select(F.col("row").alias("id"), F.col("shingles").alias("c")), lambda it: _verify(it, similarity), none, folder, "true")
    roots = connected_components(true, f"{folder}/true")
    keys = written(rows.select("id", "key"), folder, "keys")
    drop(docs.sparkSession, folder, "profiles", "members", "sizes", "maybe")
    named = written(groups.join(roots, F.col("rep") == F.col("node"), "left").select("key", "id", F.coalesce("root", "rep").alias("root"), "n"), folder, "named")
    least = written(named.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("roots")), folder, "least")
    named = join_groups(named.select("key", "root", "n"), least, "root", "roots", named.count()).select("key", "component", "n")
    return join_groups(keys, written(named, folder, "components"), "key", "n", n, grows=True).select("id", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id reachable over links of at most 3 bits.

    Null ids have a fingerprint but no links (component null); null, empty and blank texts have fingerprint 0 and are
    linked like any other; repeated rows stay, each with the same component. Other columns are not read. Empty table:
    empty result.
    """
    folder = work_dir(docs.sparkSession)
    fps = written(fingerprints(docs, id_col, text_col, words), folder, "fingerprints", TEXT_ROWS)
    groups = written(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("rep is not null"), folder, "groups")
    roots = connected_components(fingerprint_links(groups, folder), folder)
    named = groups.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component"), "n")
    out = join_groups(fps, named, "fp", "n", fps.count())
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
